"""SQL (DuckDB) for the rows of the queries that SQL can express.

Fingerprints (XXH64 with a seed), packing, fitted models and page labels have none;
tests hold those against plain versions.  Windows are compared as texts here, not by hash.
"""

from .quality import QualityRules

_WORD = r"[^\x20\x09-\x0D]+"
_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every text with its words; row numbers stand for rows, since ids may repeat.
_DOCS = f"""docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from documents),
  worded as (select rid, doc_id, body, regexp_extract_all(body, '{_WORD}') as w from docs)"""


def _windows(name: str, n: int) -> str:
    """One row for each n-word window: where it starts and its words."""
    return f"""{name} as (select rid, doc_id, i, array_to_string(w[i : i + {n - 1}], ' ') as key
    from (select rid, doc_id, w, unnest(generate_series(1, len(w) - {n - 1})) as i from worded))"""


def _covered(name: str, starts: str, n: int) -> str:
    """Distinct word places inside the windows that begin at starts."""
    return f"{name} as (select distinct rid, i + k as pos from ({starts}), (select unnest(range({n})) as k))"


def quality_sql(rules: QualityRules | None = None) -> str:
    rules = rules or QualityRules()
    parts, shares, joins = [], [], []
    for n, most in rules.max_coverage.items():
        later = f"select rid, i from (select rid, i, row_number() over (partition by rid, key order by i) as nth from win{n}) where nth > 1"
        parts += [_windows(f"win{n}", n), _covered(f"cov{n}", later, n)]
        parts.append(f"share{n} as (select c.rid, sum(length(w[pos])) as chars from cov{n} c join worded using (rid) group by 1)")
        shares.append(f"coalesce(share{n}.chars, 0)::double / greatest(word_chars, 1) > {most}::double")
        joins.append(f"left join share{n} using (rid)")
    again = "select rid, i from (select rid, i, count(*) over (partition by rid, key) as n from win3) where n > 1"
    return f"""with {_DOCS}, {_windows("win3", 3)}, {_covered("cov3", again, 3)},
  repeated as (select rid, count(*) as n from cov3 group by 1), {", ".join(parts)},
  lines as (select rid, line, no, row_number() over (partition by rid, line order by no) as nth,
      list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: length(x))) as chars
    from (select rid, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as no from docs)
    where regexp_matches(line, '{_WORD}')),
  again as (select rid, count(*) as n, sum(chars) as chars from lines where nth > 1 group by 1),
  counted as (select rid, doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
      length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(again.n, 0)::bigint as n_dup_lines,
      coalesce(repeated.n, 0)::bigint as n_repeat_words, coalesce(again.chars, 0) as line_chars
    from worded left join again using (rid) left join repeated using (rid)),
  judged as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or line_chars::double / greatest(word_chars, 1) > {rules.max_line_share}::double or {" or ".join(shares)}) as kept
from judged {" ".join(joins)}"""


def repeats_sql(n_words: int = 20) -> str:
    later = "select rid, i from (select rid, i, rank() over (partition by key order by doc_id, i) as nth from win) where nth > 1"
    return f"""with {_DOCS}, {_windows("win", n_words)}, {_covered("gone", later, n_words)},
  placed as (select rid, unnest(w) as word, generate_subscripts(w, 1) as pos from worded),
  kept as (select rid, string_agg(word, ' ' order by pos) as body, count(*) as n from placed anti join gone using (rid, pos) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.body, '')) as kept_sha256
from worded left join kept using (rid)"""


def contamination_sql(n_words: int = 13, min_percent: int = 5) -> str:
    def words(table: str, key: str) -> str:
        return f"select row_number() over () as rid, {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_NORMAL}') as w from {table}"

    return f"""with items as ({words("benchmark", "item_id")}), worded as ({words("documents", "doc_id")}),
  item_windows as (select distinct item_id, least(len(w), {n_words}) as size, array_to_string(w[i : i + {n_words - 1}], ' ') as key
    from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - {n_words - 1}))) as i from items where len(w) > 0)),
  sizes as (select distinct size from item_windows),
  doc_windows as (select rid, i, size, array_to_string(w[i : i + size - 1], ' ') as key
    from (select rid, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from worded, sizes)),
  found as (select rid, i, size, item_id from doc_windows join item_windows using (size, key)),
  hit as (select rid, count(distinct pos) as n from (select rid, unnest(range(i, i + size)) as pos from found) group by 1),
  named as (select rid, count(*) as n, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct rid, item_id::varchar as item_id from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 and 100 * coalesce(hit.n, 0) >= {min_percent} * len(w) as contaminated
from worded left join hit using (rid) left join named using (rid)"""


def captures_sql(min_bytes: int = 100) -> str:
    return f"""with payloads as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
  led as (select *, case when payload_bytes >= {min_bytes} then min(page_id) over (partition by payload_digest) else page_id end as lead_id from payloads)
select page_id, payload_bytes, payload_digest, case when lead_id = page_id then 'response' else 'revisit' end as record_type,
  nullif(lead_id, page_id) as refers_to from led"""


#: CRC-32 of the decimal digits of doc_id, a bit at a time.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))))"""


def manifest_sql(fanout: int = 16) -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def climbed(name: str, base: str) -> str:
        """Nodes level by level, each with what stands to its left and right in its run."""
        run = f"partition by tree, level, pos // {fanout} order by pos rows between"
        beside = f"string_agg(digest, '') over ({run} unbounded preceding and 1 preceding), string_agg(digest, '') over ({run} 1 following and unbounded following)"
        left, right = beside.split(", string_agg")
        return f"""{name}_all(tree, level, pos, n, digest) as ({base} union all
    select tree, level + 1, pos // {fanout}, any_value(n + {fanout - 1}) // {fanout}, sha256(string_agg(digest, '' order by pos)) from {name}_all where n > 1 group by tree, level, pos // {fanout}),
  {name} as (select *, coalesce({left}, '') as lefts, coalesce(string_agg{right}, '') as rights from {name}_all)"""

    in_tree = "row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n"
    damaged = f"case when {_CRC32} % 5 = 0 then translate(text, '{_UPPER}', '{_LOWER}') else text end"
    return f"""with recursive plain as (select doc_id, coalesce('s' || source, '') as tree, {leaf("text")} as leaf, {leaf(damaged)} as own from documents),
  leaves as (select *, {in_tree} from plain),
  {climbed("node", "select tree, 0::bigint, pos::bigint, n::bigint, leaf from leaves")},
  subroots as (select tree, digest, row_number() over (order by tree) - 1 as nth, count(*) over () as sources from node where n = 1),
  {climbed("top", "select '', 0::bigint, nth::bigint, sources::bigint, digest from subroots")},
  apex as (select digest as root from top where n = 1),
  steps as (select doc_id, l.leaf, l.tree, l.pos as spot, x.level as seq, lefts, rights from leaves l join node x on x.tree = l.tree and x.pos = l.pos // ({fanout} ** x.level)::bigint and x.n > 1
    union all select doc_id, l.leaf, l.tree, l.pos, 100 + x.level, lefts, rights from leaves l join subroots s using (tree) join top x on x.pos = s.nth // ({fanout} ** x.level)::bigint and x.n > 1),
  ordered as (select *, row_number() over (partition by tree, spot order by seq) as k from steps),
  folded(tree, spot, k, digest) as (select tree, pos, 0::bigint, own from leaves
    union all select f.tree, f.spot, f.k + 1, sha256(lefts || digest || rights) from folded f join ordered o on o.tree = f.tree and o.spot = f.spot and o.k = f.k + 1),
  final as (select tree, spot, arg_max(digest, k) as folded_root from folded group by 1, 2),
  proofs as (select tree, spot, sha256(string_agg(lefts || rights, '' order by k)) as proof from ordered group by 1, 2)
select l.doc_id, l.leaf, s.digest as subroot, root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from leaves l join subroots s using (tree) cross join apex join final f on f.tree = l.tree and f.spot = l.pos left join proofs p on p.tree = l.tree and p.spot = l.pos"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op2_substring_dedup": repeats_sql(),
    "op3_decontamination": contamination_sql(),
    "op10_warc": captures_sql(),
    "op13_merkle_manifest": manifest_sql(),
}
