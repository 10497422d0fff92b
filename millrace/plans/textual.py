"""Retrieval, ranking, pages, addresses and the evidence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import passages, text
from ..operators import graph, rank
from ..sources import pages
from .registry import query
from .roles import table

_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ({_STOPS}))"
_DOC_TOKENS = f"doc_tokens as (select doc_id, {_TOKENS.format('text')} toks from documents)"


@query(f"with {_DOC_TOKENS} select doc_id, token, count(*) tf from (select doc_id, unnest(toks) as token from doc_tokens) group by 1, 2")
def token_counts(spark, sf):
    return rank.token_counts(table(spark, sf, "documents"), "doc_id", "text")


_BM25 = f"""{_DOC_TOKENS}, asked as (select item_id, unnest(list_distinct({_TOKENS.format('text')})) as token from benchmark),
  stats as (select count(*) n, avg(len(toks)) mean from doc_tokens), post as (select doc_id, len(toks) l, token, count(*) tf from (select doc_id, toks, unnest(toks) as token from doc_tokens)
    where token in (select token from asked) group by 1, 2, 3),
  df as (select token, count(*) df from post group by 1),
  scored as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) score
    from post join df using (token) join asked using (token), stats group by 1, 2)"""


@query(f"""with {_BM25} select item_id, doc_id, score, n as "rank" from (select *, row_number() over (partition by item_id order by score desc, doc_id) n from scored) where n <= 10""")
def bm25_rank(spark, sf):
    return rank.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 10)


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_RUNS = "unnest(list_transform(range(1, greatest(len(w) - n + 1, 1) + 1), lambda i: array_to_string(w[i : i + n - 1], ' ')))"
_RELEVANT = f"""iw as (select item_id, w, least(len(w), 8) n from (select item_id, {_WORDS} w from benchmark) where len(w) > 0), ir as (select distinct item_id, n, {_RUNS} as run from iw),
  dr as (select distinct doc_id, n, {_RUNS} as run from (select doc_id, {_WORDS} w, n from documents, (select distinct n from iw)) where len(w) >= n),
  relevant as (select distinct item_id, doc_id from ir join dr using (n, run))"""


@query(f"""with {_BM25}, ranked as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) k from scored) where k <= 10), {_RELEVANT},
  totals as (select item_id, count(*) w from relevant group by 1),
  hits as (select item_id, count(*) h, min(k) f, sum(1 / log2(k + 1)) g from ranked join relevant using (item_id, doc_id) group by 1)
  select item_id, cast(coalesce(h, 0) > 0 as integer) hit, round(coalesce(h, 0) / w, 4) recall, round(coalesce(h, 0) / 10, 4) as precision, round(coalesce(1 / f, 0), 4) mrr,
    round(coalesce(g, 0) / (select sum(1 / log2(i + 1)) from range(1, 1 + least(w, 10)) r(i)), 4) ndcg from totals left join hits using (item_id)""")
def retrieval_metrics(spark, sf):
    relevant = rank.mentions(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")
    return rank.retrieval_metrics(bm25_rank(spark, sf), relevant, "item_id", "doc_id", 10)


@query("""with s as (select q.vec_id as query, v.vec_id as key, round(list_dot_product(q.embedding::double[], v.embedding::double[]) /
  (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 6) score
  from embeddings v join embeddings q on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)
  select query, key, score, n as "rank" from (select *, row_number() over (partition by query order by score desc, key) n from s) where n <= 10""")
def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return rank.nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@query()
def hybrid_search(spark, sf):
    """The passages nearest to each benchmark question, by hashed embeddings and shared tokens."""
    return rank.hybrid_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 10)


@query()
def retrieved_passages(spark, sf):
    """Candidates of the hybrid search, ranked again by BM25 among them, coverage and word pairs."""
    return rank.retrieve(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


@query()
def cited_answers(spark, sf):
    return rank.answers(retrieved_passages(spark, sf), "item_id", "doc_id")


@query(
    f"""with d as (select item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ({_STOPS})) t from benchmark),
  p as (select a.item_id, a.t own, b.t want from d a join d b on b.item_id = a.item_id + 1), u as (select item_id, unnest(list_distinct(own)) w, own, want from p),
  s as (select item_id, sum(least(len(list_filter(own, lambda x: x = w)), len(list_filter(want, lambda x: x = w)))) shared from u group by 1)
  select p.item_id, case when len(want) > 0 then round(coalesce(case when shared > 0 then 2 * shared / (len(own) + len(want)) end, 0), 4) end token_f1, case when p.item_id % 3 > 0 then round(1 / (p.item_id % 3), 4) end citation_validity
  from p left join s using (item_id)"""
)
def answer_metrics(spark, sf):
    """Each benchmark item held against the next as its reference; one of its citations is given."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("answer"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("answer").alias("reference")), "item_id")
    cited = pairs.withColumns({"cited": F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("item_id") % 3).cast("int")), "given": F.array(F.lit("a"), F.lit("c"))})
    return rank.generation_metrics(cited, "answer", "reference", "cited", "given").select("item_id", "token_f1", "citation_validity")


@query()
def chunk_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(passages.chunked("text")).alias("chunk", "passage"))


@query()
def hashing_embedding(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", passages.embedded("text").alias("embedding"))


_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '')"


@query(f"""select page_id, 'https://' || {_HOST} || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') ||
  coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' and split_part(p, '=', 1) not in
    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))), 'string_agg', '&'), ''), '') as canonical from pages""")
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query("select page_id, cast(cast('0x' || substr(sha256(url), 1, 8) as bigint) % 100 < 20 as boolean) as holdout from pages")
def holdout_split(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.in_holdout(F.col("url"), 20).alias("holdout"))


@query()
def page_links(spark, sf):
    return pages.page_links(table(spark, sf, "pages"))


@query()
def page_text(spark, sf):
    return pages.page_text(table(spark, sf, "pages"))


@query("select conv_id, turn, len(list_filter(['ignore', 'system', 'please'], lambda p: contains(lower(text), p))) as n from conversations")
def untrusted_markers(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(text.warnings(F.col("text"), ["ignore", "system", "please"])).cast("long").alias("n"))


_EVIDENCE = """evidence as (select event_id evidence_id, user_id asset_id, case event_type when 'purchase' then 'site_link' when 'signup' then 'own_site' when 'error' then 'community_record' else 'listing' end kind,
  event_type channel, case when value < 40 then 'refutes' else 'supports' end polarity, ts observed_at from events)"""
_GRADED = f"""{_EVIDENCE}, r as (select asset_id, kind, channel, max(case when polarity = 'refutes' then observed_at end) t from evidence group by 1, 2, 3),
  held as (select e.* from evidence e join r using (asset_id, kind, channel) where polarity = 'supports' and (t is null or observed_at > t)),
  h as (select asset_id, count(distinct case when kind = 'community_record' then 'community' else channel end) channels, bool_or(kind = 'own_site') own, bool_or(kind = 'site_link') anchored from held group by 1),
  g as (select a.asset_id, case when own then 6 when anchored then 5 when channels >= 2 then 3 when channels = 1 then 2 when refuted then 0 else 1 end as rank, coalesce(channels, 0) channels
    from (select asset_id, bool_or(polarity = 'refutes') refuted from evidence group by 1) a left join h using (asset_id)),
  graded as (select asset_id, rank, case rank when 6 then 'O' when 5 then 'A' when 3 then 'B' when 2 then 'C' when 1 then 'unrated' else 'D' end grade, channels from g)"""


def evidence(spark, sf):
    kind = "case event_type when 'purchase' then 'site_link' when 'signup' then 'own_site' when 'error' then 'community_record' else 'listing' end as kind"
    return table(spark, sf, "events").selectExpr(
        "event_id as evidence_id", "user_id as asset_id", kind, "event_type as channel", "case when value < 40 then 'refutes' else 'supports' end as polarity", "ts as observed_at")


@query(f"with {_GRADED} select * from graded")
def evidence_grades(spark, sf):
    return graph.graded(evidence(spark, sf), ["asset_id", "kind", "channel"])


_ASSETS = "assets as (select asset_id, asset_id % 20 entity_id, asset_id % 3 platform, case when asset_id % 5 = 0 then 'fan' else 'official' end relation, rank from graded)"


def assets(spark, sf):
    return evidence_grades(spark, sf).selectExpr(
        "asset_id", "asset_id % 20 as entity_id", "asset_id % 3 as platform", "case when asset_id % 5 = 0 then 'fan' else 'official' end as relation", "rank")


@query(f"""with {_GRADED}, {_ASSETS}, o as (select *, case when relation = 'official' and rank >= 3 then 1 else 0 end f from assets)
  select asset_id, entity_id, platform, relation, rank, f = 1 and sum(f) over w >= 2 and max(case when f = 1 then rank end) over w < 5 as disputed from o window w as (partition by entity_id, platform)""")
def disputes(spark, sf):
    return graph.disputed(assets(spark, sf))


@query(f"""with {_EVIDENCE} select evidence_id from (select evidence_id, row_number() over (partition by asset_id, kind order by observed_at desc, evidence_id desc) a,
  row_number() over (partition by asset_id, channel, polarity order by observed_at desc, evidence_id desc) b from evidence) where a > 1 and b > 1""")
def superseded_evidence(spark, sf):
    return graph.superseded(evidence(spark, sf), [["asset_id", "kind"], ["asset_id", "channel", "polarity"]]).select("evidence_id")


@query(f"""with {_GRADED}, gold as (select distinct user_id k, case user_id % 4 when 0 then 'holdout' when 1 then 'canary' else 'seed' end split from events where user_id % 2 = 0 or user_id % 4 = 1),
  j as (select gold.*, coalesce(rank, -1) >= 3 good from gold left join graded on k = asset_id)
  select (select count(*) from graded) assets, (select count(*) from graded where rank >= 3) verified, count(*) filter (where split = 'canary' and good) canary_leaks,
    case when count(*) filter (where split = 'holdout') > 0 then round(count(*) filter (where split = 'holdout' and good) / count(*) filter (where split = 'holdout'), 4) end holdout_recall,
    case when count(*) filter (where split = 'seed') > 0 then round(count(*) filter (where split = 'seed' and good) / count(*) filter (where split = 'seed'), 4) end seed_rate from j""")
def map_metrics(spark, sf):
    gold = table(spark, sf, "events").where("user_id % 2 = 0 or user_id % 4 = 1").selectExpr(
        "user_id as asset_key", "case user_id % 4 when 0 then 'holdout' when 1 then 'canary' else 'seed' end as split").distinct()
    return graph.map_metrics(assets(spark, sf).withColumnRenamed("asset_id", "asset_key"), gold)


@query("""with a as (select user_id, user_id % 3 platform, bool_or(event_type = 'click') a, bool_or(event_type = 'purchase' and value > 90) b from events group by 1, 2),
  s as (select platform, count(*) filter (where a) n1, count(*) filter (where b) n2, count(*) filter (where a and b) as "both", count(*) filter (where a or b) f from a group by rollup (platform))
  select platform, n1, n2, "both", round((n1 + 1) * (n2 + 1) / ("both" + 1) - 1, 4) estimate, round(least(1.0, f / ((n1 + 1) * (n2 + 1) / ("both" + 1) - 1)), 4) coverage from s""")
def coverage_chapman(spark, sf):
    found = table(spark, sf, "events").groupBy("user_id", F.expr("user_id % 3 as platform")).agg(
        F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 90)).alias("b"))
    return graph.coverage(found, "platform", F.col("a"), F.col("b"))


@query(f"""with a as (select user_id, max(cast(ts as date)) v from events group by 1), d as (select date_diff('day', v, date '2024-01-31') age from a)
  select round(avg(case when age <= 7 then 1.0 else 0 end), 4) within_7, round(avg(case when age <= 30 then 1.0 else 0 end), 4) within_30, round(avg(case when age <= 90 then 1.0 else 0 end), 4) within_90, median(age) median_age from d""")
def evidence_freshness(spark, sf):
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("v"))
    return graph.freshness(seen, "v", F.lit("2024-01-31").cast("date"))
