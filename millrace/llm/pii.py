"""Personal data: base patterns, and boosted trees over high-recall candidates. JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  A run that a match may start in is taken whole (possessive), from its start
#: or from where the last match ended, so that long runs cost linear time; the matches are the same.
#: Runs of digits that cannot be a card by their number are left out by the pattern itself.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates, wide on purpose.
CANDIDATES = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT) ?[\])}] ?"
        r"[A-Za-z0-9-]++(?: ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: Words before a span that speak for its kind, and words that speak against any, in four languages.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|contacto|kontakt|courriel|correo|write|reach)\b",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|addr|address|adresse|client|gateway)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|carte|karte|tarjeta|pay|paid|debit|credit)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|anruf|portable|llame|telefono)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|isbn|version|ref|no|nr|id|date|token|page|release|build|sku|part|commande|pedido)\b"
FEATURES = ("kind_no", "digits", "marks", "luhn", "octets", "for_kind", "against", "brackets", "groups")
CONTEXT = 24
#: Items that a fold takes at a time, and code points of a piece of text.
GROUP, PIECE = 256, 1024
SEED_ROWS, PRECISION = 2400, 0.995
_models: dict[str, tuple[GBTClassificationModel, dict[str, float]]] = {}

SPAN = "struct<kind:string,start:long,end:long>"


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, -at, 1).cast("int")
        twice = F.when(at % 2 == 0, 2 * digit).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    n = F.length(digits)
    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    small = lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))
    return F.forall(F.split(match, r"\."), small)


def _passes(kind: str, match: Column) -> Column:
    n = F.length(only_digits(match))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: _octets(match),
        "card": lambda: n.between(13, 19) & luhn(only_digits(match)),
        "phone": lambda: n.between(9, 15),
    }[kind]()


def _passing(kind: str):
    return lambda x: _passes(kind, x["match"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where body looks at it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """A fold from the left that gives rows: step(state, item) makes the next state and an array (of type kind) of rows.

    An array cannot grow in place, so the fold goes over groups of GROUP items, and what a
    group gives is put aside: n items cost n * GROUP + (n / GROUP)**2 copies, not n**2.
    """
    none = F.expr(f"cast(array() as {kind})")

    def one(acc: Column, item: Column) -> Column:
        state, rows = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["rows"], rows).alias("rows"))

    def group(acc: Column, members: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), none.alias("rows"))
        end = lambda a: F.struct(a["state"].alias("state"), F.concat(acc["done"], F.array(a["rows"])).alias("done"))
        return F.aggregate(members, begin, one, end)

    def over(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / GROUP).cast("int")
        groups = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda g: F.slice(own, g * GROUP + 1, F.lit(GROUP)))
        start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("done"))
        return F.when(F.size(own) > 0, F.aggregate(groups, start, group, lambda acc: F.flatten(acc["done"]))).otherwise(none)

    return _let(items, over)


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """Matches with their places: struct(start, end, match), in code points.

    Splitting the text at the same pattern gives what lies between the matches; a fold
    over both adds up the lengths.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + x["size"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["match"].alias("match")))

    kind = "array<struct<start:bigint,end:bigint,match:string>>"
    return F.when(F.size(matches) > 0, _folded(pairs, F.lit(0).cast("long"), step, kind)).otherwise(F.expr(f"cast(array() as {kind})"))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that a stretch is reached without reading all that stands before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _stretch(pieces: Column, start: Column, end: Column) -> Column:
    """The text between two places."""
    first, last = F.floor(start / PIECE), F.floor((end - 1) / PIECE)
    piece = lambda i: F.coalesce(F.get(pieces, i.cast("int")), F.lit(""))
    cut_out = lambda i, a, b: F.substring(piece(i), (a - i * PIECE + 1).cast("int"), (b - a).cast("int"))
    between = F.array_join(F.slice(pieces, (first + 2).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int")), "")
    several = F.concat(cut_out(first, start, (first + 1) * PIECE), between, cut_out(last, last * PIECE, end))
    return F.when(end <= start, F.lit("")).when(first == last, cut_out(first, start, end)).otherwise(several)


def _find(text: Column, kind: str, pattern: str, need: Column) -> Column:
    """The placed matches of a pattern; need skips texts that cannot match."""
    none = F.expr("cast(array() as array<string>)")
    matches = F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return _let(matches, lambda m: _placed(text, m, pattern))


def _features(kind: str, match: Column, before: Column) -> list[Column]:
    """Numbers that describe the format of a candidate and what stands before it."""
    digits = only_digits(match)
    number = lambda c: c.cast("double")
    return [
        F.lit(float(KINDS.index(kind))),
        number(F.length(digits)),
        number(F.length(F.regexp_replace(match, "[0-9A-Za-z]", ""))),
        number(luhn(digits)),
        number(F.size(F.split(match, ":"))),
        number(before.rlike(FOR[kind])),
        number(before.rlike(AGAINST)),
        number(match.rlike(r"[\[({]")),
        number(F.size(F.split(match, r"[ ./_:-]"))),
    ]


def seed_candidates(spark: SparkSession, rows: int = SEED_ROWS) -> DataFrame:
    """Labelled candidates to fit on: kind, match, before, label (1.0 personal), made by expressions from a row number."""
    pick = lambda salt, *options: F.element_at(
        F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int")
    )
    number = lambda salt, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    hexa = lambda salt: F.substring(F.hex(F.xxhash64("id", F.lit(salt))), 1, 4)
    word = lambda salt: pick(salt, "anna", "j.smith", "info", "lee42", "maria-b", "sales")
    mark = pick(3, ".", "_", "/")
    card = F.concat_ws("|", number(4, 4), number(5, 4), number(6, 4), number(7, 4))
    shape = {
        "email": F.concat(word(1), pick(2, " [at] ", "(at)", " (AT) ", " {at} "), pick(8, "example", "mail", "corp"), pick(9, ".com", " [dot] org", "(dot)net")),
        "ip": F.array_join(F.array(*(hexa(20 + i) for i in range(8))), ":"),
        "card": F.replace(card, F.lit("|"), mark),
        "phone": F.concat(pick(10, "(", ""), number(11, 3), pick(12, "-", " ", "."), number(13, 3), pick(12, "-", " ", "."), number(14, 4)),
    }
    speak_for = {
        "email": pick(30, "email: ", "contact me at ", "Kontakt: ", "write to "),
        "ip": pick(30, "server ", "ip ", "host: ", "client address "),
        "card": pick(30, "card ", "visa no. ", "paid with card ", "tarjeta "),
        "phone": pick(30, "phone: ", "call me at ", "tel. ", "fax "),
    }
    neutral = pick(31, "see ", "the and of ", "then it was ", "", "bleeding with ", "les des aux ")
    against = pick(32, "order no ", "invoice ", "isbn ", "version ", "ref id ", "date ")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.col("id"), F.lit(4)) + 1).cast("int"))
    context = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(4))
    choose = lambda options: reduce(lambda c, k: c.when(F.col("kind") == k, options[k]), KINDS[1:], F.when(F.col("kind") == KINDS[0], options[KINDS[0]]))  # noqa: E731, E501
    good = (context <= 1) | ((context == 2) & (F.col("kind") == "email"))
    return spark.range(rows).withColumn("kind", kind).select(
        "id", "kind", choose(shape).alias("match"),
        F.when(context <= 1, choose(speak_for)).when(context == 2, neutral).otherwise(against).alias("before"),
        (good & (F.col("kind") != "card")
         | good & luhn(only_digits(choose(shape)))).cast("double").alias("label"),
    )


def fitted(spark: SparkSession) -> tuple[GBTClassificationModel, dict[str, float]]:
    """The trees and each kind's threshold, fitted once a session.

    Thresholds are calibrated on a third of the labelled rows that the trees have not
    seen: the least score above which the share of personal ones is PRECISION or more.
    """
    key = spark.sparkContext.applicationId
    if key not in _models:
        seed = seed_candidates(spark)
        vectors = [
            seed.where(F.col("kind") == k).select("id", "kind", "label", *(c.alias(n) for n, c in zip(FEATURES, _features(k, F.col("match"), F.col("before")), strict=True)))
            for k in KINDS
        ]
        rows = reduce(DataFrame.union, vectors)
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("id", "kind", "label", "features")
        rows = cut(rows.withColumn("held", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).coalesce(1))
        model = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(rows.where("not held"))
        thresholds = dict.fromkeys(KINDS, 1.0)
        scored = model.transform(rows.where("held")).select("kind", "label", "probability").collect()
        for k in KINDS:
            pairs = sorted(((float(r.probability[1]), r.label) for r in scored if r.kind == k), reverse=True)
            hits = 0.0
            for i, (p, label) in enumerate(pairs, 1):
                hits += label
                if hits >= PRECISION * i and (i == len(pairs) or pairs[i][0] < p):
                    thresholds[k] = p
        _models.clear()
        _models[key] = model, thresholds
    return _models[key]


def _tree(node, features: list[Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(features[split.featureIndex()] <= F.lit(float(split.threshold())), _tree(node.leftChild(), features)).otherwise(
        _tree(node.rightChild(), features)
    )


def score(model: GBTClassificationModel, features: list[Column]) -> Column:
    """The model's probability, as one expression."""
    parts = [F.lit(float(w)) * _tree(t._java_obj.rootNode(), features) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return 1 / (1 + F.exp(-2 * reduce(Column.__add__, parts)))


def _free(candidates: Column, base: Column) -> Column:
    """Candidates that touch no base span, by start."""
    kind = "array<struct<start:bigint,end:bigint,x:struct<kind:string,start:bigint,end:bigint,score:double>>>"
    both = F.concat(
        F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c.alias("x"))),
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.expr(f"cast(null as {kind[kind.index(',x:') + 3 : -2]})").alias("x"))),
    )

    def past_end(reach: Column, s: Column) -> tuple[Column, Column]:
        own = s["x"].isNotNull()
        keeps = ~own | (s["start"] >= reach)
        return F.when(own, reach).otherwise(F.greatest(reach, s["end"])), F.filter(F.array(s), lambda _: keeps)

    def before_start(reach: Column, s: Column) -> tuple[Column, Column]:
        own = s["x"].isNotNull()
        keeps = ~own | (s["end"] <= reach)
        return F.when(own, reach).otherwise(F.least(reach, s["start"])), F.filter(F.array(s), lambda _: keeps)

    first = lambda a, b: F.signum(a["start"] - b["start"]).cast("int")
    last = lambda a, b: F.signum(b["end"] - a["end"]).cast("int")
    forward = _folded(F.array_sort(both, first), F.lit(-1).cast("long"), past_end, kind)
    backward = _folded(F.array_sort(forward, last), F.lit(2**62), before_start, kind)
    return F.array_sort(F.transform(F.filter(backward, lambda s: s["x"].isNotNull()), lambda s: s["x"]), first)


def _best(candidates: Column) -> Column:
    """Of candidates in order of their starts, those that stay: of two that overlap the better one, from left to right."""
    span = "struct<kind:string,start:bigint,end:bigint,score:double>"
    order = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    none = F.expr(f"cast(array() as array<{span}>)")

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        clear = held.isNull() | (x["start"] >= held["end"])
        better = (x["score"] > held["score"]) | ((x["score"] == held["score"]) & (order(x) < order(held)))
        return F.when(clear | better, x).otherwise(held), F.when(clear & held.isNotNull(), F.array(held)).otherwise(none)

    # a last one past all ends makes the fold give up what it holds
    end = F.array(F.expr(f"named_struct('kind', '', 'start', {2**62}L, 'end', {2**62}L, 'score', 0D)"))
    return _folded(F.concat(candidates, end), F.expr(f"cast(null as {span})"), step, f"array<{span}>")


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_base and pii_spans: arrays of (kind, start, end) in code points, by kind as in KINDS, then start.

    Base spans are the matches of BASE that pass their kind's test.  The generators of
    CANDIDATES propose further spans; those that touch no base span are scored by the
    trees, from their format and the CONTEXT characters before them, and stay if the
    score reaches their kind's threshold; of those that overlap each other the better
    one stays, judged from left to right.

    Only JVM expressions run on the executors, in one pass and without a shuffle.

    Defined cases: null and empty texts have no spans; texts of any length are searched
    whole, in time that grows as they do (folds over n matches copy n * GROUP + (n / GROUP)**2
    values); rows are judged alone, so ids, null or repeated, and ties do not matter; no
    rows give no rows; own columns of the results' names give way to these, and columns
    of any other name are kept.
    """
    model, thresholds = fitted(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("pii_base", "pii_spans")]
    rows = docs.select(F.struct(*(docs[c] for c in own)).alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    digit, bracket = t.rlike("[0-9]"), t.rlike(r"[\[({] ?(?:at|AT) ?[\])}]")
    need = {"email": t.contains("@"), "ip": digit & t.contains("."), "card": digit, "phone": t.contains("+")}
    wider = {"email": bracket, "ip": digit & t.contains(":"), "card": digit, "phone": digit}

    def span(k: str, x: Column) -> Column:
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))

    base = [F.transform(F.filter(_find(t, k, BASE[k], need[k]), _passing(k)), partial(span, k)) for k in KINDS]
    rows = rows.withColumn("base", F.concat(*base)).withColumns({k: _find(t, k, CANDIDATES[k], wider[k]) for k in KINDS})

    def candidate(k: str, pieces: Column, x: Column) -> Column:
        before = _stretch(pieces, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"])
        numbers = (c.alias(n) for n, c in zip(FEATURES, _features(k, x["match"], before), strict=True))
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(thresholds[k]).alias("least"), *numbers)

    def judged(x: Column) -> Column:
        p = score(model, [x[n] for n in FEATURES])
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.when(p >= x["least"], p).alias("score"))

    def scored(pieces: Column) -> Column:
        proposed = F.concat(*(F.transform(F.col(k), partial(candidate, k, pieces)) for k in KINDS))
        return F.filter(F.transform(proposed, judged), lambda x: x["score"].isNotNull())

    plain = f"array<{SPAN}>"
    some = reduce(Column.__or__, (F.size(k) > 0 for k in KINDS))
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")
    rows = rows.withColumn("scored", F.when(some, _let(_pieces(t), scored)).otherwise(none))
    chosen = F.when(F.size("scored") > 0, _best(_free(F.col("scored"), F.col("base")))).otherwise(none)
    added = F.transform(chosen, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.withColumn("every", F.concat("base", added))
    of_kind = lambda k: lambda x: x["kind"] == k
    in_order = F.concat(*(F.array_sort(F.filter("every", of_kind(k))) for k in KINDS))
    out = [F.col("row")[c].alias(c) for c in own]
    return rows.select(*out, F.col("base").cast(plain).alias("pii_base"), in_order.cast(plain).alias("pii_spans"))


def digest(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, such as [EMAIL].

    Spans that overlap are replaced together, under the kind of the one that starts
    first (of two that start together, the longer one).

    Defined cases: null texts stay null, empty ones empty; texts of any length are
    redacted whole, in time that grows as they do; rows are judged alone, so repeated
    rows and null ids are redacted alike; no rows give no rows; all columns of docs but
    the text are returned as they are, also ones named as an intermediate result.
    """
    taken = {c.lower() for c in docs.columns}
    own = next(n for i in range(len(taken) + 1) if (n := f"spans{i}") not in taken)
    kept = [c for c in docs.columns if c.lower() in ("pii_base", "pii_spans")]
    held = docs.select(*(c for c in docs.columns if c not in kept), F.struct(F.lit(1), *kept).alias(own))
    found = find_personal_data(held, text)
    by_start = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["end"] - a["end"]).cast("int"))
    none = F.expr("cast(array() as array<string>)")

    def clean(pieces: Column, spans: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            fresh = F.array(_stretch(pieces, at, x["start"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
            return F.greatest(at, x["end"]), F.when(x["start"] < at, none).otherwise(fresh)

        length = F.length(F.col(text)).cast("long")
        ended = F.concat(spans, F.array(F.struct(F.lit("").alias("kind"), length.alias("start"), length.alias("end"))))
        # the closing span adds what follows the last one, and empty brackets that go again
        return _let(_folded(ended, F.lit(0).cast("long"), step, "array<string>"), lambda p: F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ""))

    spans = F.array_sort("pii_spans", by_start)
    new = F.when(F.size("pii_spans") == 0, F.col(text)).otherwise(_let(_pieces(F.col(text)), lambda p: _let(spans, lambda s: clean(p, s))))
    found = found.withColumn(text, new)
    return found.select(*(F.col(own)[c].alias(c) if c in kept else F.col(c) for c in docs.columns))
