"""Matching the headers of source tables with the fields of a schema.

Headers and fields are schema, not data: their number is bounded by a table's width,
and every header meets every field through one array literal, with no join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import header as normal
from ..functions.similarity import ratio

#: What each way to match scores, and the limits between them.
SCORES = {
    "exact": 1.0, "synonym": 0.97, "words": (0.55, 0.35), "contains": (0.6, 0.05), "spelling": (0.45, 0.4), "abbreviation": 0.66, "inexact_most": 0.9,
    "words_from": 0.5, "spelling_from": 0.82, "abbreviation_gap": 6, "least_letters": 3,
}
LEAST, THRESHOLD, CLOSE = 0.4, 0.8, 0.05
#: What the share of samples of a shape adds for the kind of a field.
BONUS = {
    "phone": {"phone": 0.35, "email": -0.3}, "email": {"email": 0.35}, "percent": {"percent": 0.15}, "date": {"date": 0.25, "email": -0.2},
    "integer": {"integer": 0.1, "email": -0.3, "phone": -0.3}, "identifier": {"identifier": 0.2, "email": -0.3}, "string": {"email": -0.25, "phone": -0.25}, "number": {},
}
LABELS, LABEL_PENALTY = ("program", "department"), -0.6
#: Shapes of sample values.
SHAPES = {
    "phone": r"^\+?[\d][\d\s()-]{6,17}\d$", "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", "percent": r"^\s*\d{1,3}(\.\d+)?\s*%?\s*$",
    "date": r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4})\s*$", "integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?$", "identifier": r"^[A-Za-z0-9/-]{4,20}$",
}
#: Words of headers that tell nothing, and headers about schooling before this one.
STOP_WORDS = ("of", "the", "no", "number", "and", "a", "an", "in")
SCHOOLING = r"\b(?:sslc|ssc|hsc|puc|10th|12th|x std|xii std)\b|\bequivalent\b"


@dataclass(frozen=True)
class Entity:
    """A kind of record: its fields with their kinds and other names, those required, and words that tell its tables."""

    fields: Mapping[str, tuple[str, ...]]  # name: (kind, other names ...)
    required: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()

    @property
    def names(self) -> dict[str, list[str]]:
        return {name: list(spec[1:]) for name, spec in self.fields.items()}


def words(normalised: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def value_shapes(samples: DataFrame, table: str = "source", header: str = "header", value: str = "value", order: str = "row", most: int = 50) -> DataFrame:
    """(source, header, one share for each of SHAPES) over the first samples of a header that are not blank."""
    text = F.trim(F.col(value).cast("string"))
    rows = samples.select(table, header, text.alias("_v"), F.row_number().over(Window.partitionBy(table, header).orderBy(order)).alias("_n")).where("_v <> ''")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(table, header).orderBy("_n"))).where(F.col("_n") <= most)
    digits = F.length(F.regexp_replace("_v", "[^0-9]", ""))
    more = {"phone": digits.between(7, 15), "identifier": F.col("_v").rlike("[0-9]") & F.col("_v").rlike("[A-Za-z]")}
    share = lambda k: F.avg((F.col("_v").rlike(SHAPES[k]) & more.get(k, F.lit(True))).cast("double"))
    return first.groupBy(table, header).agg(*(F.round(share(k), 6).alias(k) for k in SHAPES))


def _bonus(fields: Mapping[str, tuple[str, ...]]) -> Column:
    """What the shapes of a header's samples add for a field."""
    none = F.lit(0.0)
    out = none
    for name, spec in fields.items():
        part = sum((F.coalesce(F.col(k), none) * w for k, w in BONUS[spec[0]].items()), none)
        if name in LABELS:
            part = part + F.coalesce(F.col("number"), none) * LABEL_PENALTY
        out = F.when(F.col("field") == name, part).otherwise(out)
    return out


def scores(headers: DataFrame, fields: Mapping[str, list[str]], table: str = "source", header: str = "header", shapes: DataFrame | None = None, kinds: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(source, header, field, score): how well each header fits each field, over its names and (with shapes and kinds) its samples.

    A canonical name or a synonym fits exactly; otherwise the best of the rules counts: shared words, all
    words of a synonym in the header, likeness of spelling, abbreviation.  Blank headers fit nothing;
    fields of score 0 are left out.
    """
    names = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(s).alias("name"), F.lit(i == 0).alias("own")) for f, others in fields.items() for i, s in enumerate([f.replace("_", " "), *others])))
    pairs = headers.select(table, header, F.inline(names)).withColumns({"h": normal(F.col(header)), "s": normal(F.col("name"))}).where("h <> ''")
    both = pairs.withColumns({"hw": words(F.col("h")), "sw": words(F.col("s")), "like": ratio("h", "s")})
    shared, either, n = F.size(F.array_intersect("hw", "sw")), F.size(F.array_union("hw", "sw")), F.size("sw")
    overlap = F.when(either > 0, shared / either).otherwise(0.0)
    long_enough = lambda c: F.length(c) >= SCORES["least_letters"]
    rules = {
        "words": (overlap >= SCORES["words_from"], overlap),
        "contains": ((overlap < SCORES["words_from"]) & (n > 0) & (shared == n) & long_enough("name"), n),
        "spelling": (F.col("like") >= SCORES["spelling_from"], F.col("like")),
    }
    found = [F.when(holds, SCORES[rule][0] + SCORES[rule][1] * size) for rule, (holds, size) in rules.items()]
    short = ~rules["spelling"][0] & long_enough("h") & ~F.contains("h", F.lit(" ")) & F.startswith("s", "h") & (F.length("s") - F.length("h") <= SCORES["abbreviation_gap"])
    inexact = F.greatest(*(F.coalesce(w, F.lit(0.0)) for w in [*found, F.when(short, SCORES["abbreviation"])]))
    same = F.col("h") == F.col("s")
    raw = both.groupBy(table, header, "field").agg(
        F.max(F.when(same & F.col("own"), SCORES["exact"]).when(same, SCORES["synonym"])).alias("_exact"), F.max(F.when(F.col("own"), 0.0).otherwise(inexact)).alias("_inexact"),
    )
    added = F.lit(0.0)
    if shapes is not None and kinds is not None:
        raw, added = raw.join(shapes, [table, header], "left"), _bonus(kinds)
    score = F.when(F.col("_exact").isNotNull(), F.least(F.lit(1.0), F.col("_exact") + added)).when(
        F.col("_inexact") > 0, F.greatest(F.lit(0.0), F.least(F.lit(SCORES["inexact_most"]), F.col("_inexact") + added))
    )
    return raw.select(table, header, "field", F.round(score, 6).alias("score")).where("score > 0")


def detect_entity(headers: DataFrame, entities: Mapping[str, Entity], table: str = "source", header: str = "header", shapes: DataFrame | None = None) -> DataFrame:
    """(source, entity, confidence, runner_up): what the rows of each table are, by its headers.

    Each header's best score from 0.6 on counts; words that tell a kind of table add 0.12 each, required
    fields that are there 0.15.  Headers about earlier schooling have no vote unless there are no others.
    """
    marked = headers.select(table, header).withColumn("_old", normal(F.col(header)).rlike(SCHOOLING))
    others = F.max((~F.col("_old")).cast("int")).over(Window.partitionBy(table)) == 1
    voting = marked.withColumn("_others", others).where(~F.col("_others") | ~F.col("_old")).select(table, header)
    counts = voting.groupBy(table).agg(F.count(F.lit(1)).alias("_n"))
    parts = []
    for name, entity in entities.items():
        best = scores(voting, entity.names, table, header, shapes, entity.fields if shapes is not None else None).groupBy(table, header).agg(F.max("score").alias("_s"))
        matched = best.groupBy(table).agg(F.sum(F.when(F.col("_s") >= 0.6, F.col("_s"))).alias("_matched"))
        signal = F.lit(False)
        for word in entity.signals:
            signal |= F.contains(normal(F.col(header)), F.lit(word))
        hits = voting.groupBy(table).agg(F.count_if(signal).alias("_hits"))
        needed = scores(voting, {f: entity.names[f] for f in entity.required}, table, header).where("score >= 0.6").groupBy(table).agg(F.count_distinct("field").alias("_needed"))
        rows = counts.join(matched, table, "left").join(hits, table, "left").join(needed, table, "left")
        score = F.coalesce("_matched", F.lit(0.0)) / F.col("_n") + 0.12 * F.coalesce("_hits", F.lit(0)) + 0.15 * F.coalesce("_needed", F.lit(0))
        parts.append(rows.select(table, F.lit(name).alias("entity"), score.alias("score")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    w = Window.partitionBy(table).orderBy(F.desc("score"), "entity")
    top = every.withColumns({"_no": F.row_number().over(w), "_next": F.lead("score").over(w), "runner_up": F.lead("entity").over(w)}).where("_no = 1")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("score") - F.coalesce("_next", F.lit(0.0))))
    return top.select(table, "entity", F.round(confidence, 4).alias("confidence"), "runner_up")


def proposals(scored: DataFrame, table: str = "source", header: str = "header") -> DataFrame:
    """(source, header, field, score, ambiguous, conflict): the best field of each header, each field given once.

    A runner-up within CLOSE makes it ambiguous and its score at most THRESHOLD - CLOSE.  Of headers with
    one field the strongest keeps it; a weaker one takes its best other field that nobody holds (at most
    THRESHOLD - CLOSE), or is in conflict.  Ties go by name.  A table's headers are few and are settled together.
    """
    schema = f"{table} {scored.schema[table].dataType.simpleString()}, {header} string, field string, score double, ambiguous boolean, conflict boolean"

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["score"] >= LEAST].sort_values([header, "score", "field"], ascending=[True, False, True])
        best, others = {}, {}
        for h, own in rows.groupby(header, sort=True):
            pairs = list(zip(own["field"], own["score"], strict=True))
            close = len(pairs) > 1 and pairs[1][1] >= pairs[0][1] - CLOSE
            best[h] = [pairs[0][0], min(pairs[0][1], THRESHOLD - CLOSE) if close else pairs[0][1], close, False]
            others[h] = pairs[1:4]
        held: dict[str, str] = {}
        for h in sorted(best, key=lambda h: (-best[h][1], h)):
            held.setdefault(best[h][0], h)
        for h in sorted(best):
            field = best[h][0]
            if held[field] == h:
                continue
            free = next(((f, s) for f, s in others[h] if f not in held and s >= LEAST), None)
            if free:
                held[free[0]] = h
                best[h][:2] = free[0], min(free[1], THRESHOLD - CLOSE)
            else:
                best[h][3] = True
        name = rows[table].iloc[0] if len(rows) else None
        return pd.DataFrame([(name, h, *b) for h, b in best.items()], columns=[table, header, "field", "score", "ambiguous", "conflict"])

    return scored.groupBy(table).applyInPandas(settle, schema)


def remembered(headers: DataFrame, profile: Mapping[str, str], table: str = "source", header: str = "header") -> DataFrame:
    """(source, header, field): fields by an approved profile; a header it names exactly keeps its choice, and a look-alike of such a header gets none."""
    exact = F.create_map(*(F.lit(x) for kv in profile.items() for x in kv)) if profile else F.expr("map('', '')")
    alike = headers.sparkSession.createDataFrame([(h, f, i) for i, (h, f) in enumerate(profile.items())], "_h string, _f string, _i int")
    alike = alike.groupBy(normal(F.col("_h")).alias("_n")).agg(F.min_by("_f", "_i").alias("_alike"))
    rows = headers.select(table, header).withColumns({"_exact": F.try_element_at(exact, F.col(header)), "_n": normal(F.col(header))})
    named = F.max(F.col("_exact").isNotNull().cast("int")).over(Window.partitionBy(table, "_n")) == 1
    rows = rows.withColumn("_named", named).join(F.broadcast(alike), "_n", "left")  # as many rows as the profile has
    return rows.select(table, header, F.coalesce("_exact", F.when(~F.col("_named"), F.col("_alike"))).alias("field"))


def apply_mapping(records: DataFrame, mapping: Mapping[str, str], fields: list[str], values: str = "fields") -> DataFrame:
    """records with a column for each field of the mapping, and attributes: the map of what is not mapped and not blank.

    A blank name is made from first and last name.
    """
    by_field = {f: h for h, f in mapping.items() if f in fields}
    columns = {f: F.try_element_at(values, F.lit(by_field[f])) if f in by_field else F.lit(None).cast("string") for f in fields}
    if "name" in columns:
        parts = F.concat_ws(" ", *(F.nullif(F.trim(columns[p]), F.lit("")) for p in ("first_name", "last_name") if p in columns))
        columns["name"] = F.coalesce(F.nullif(columns["name"], F.lit("")), F.nullif(parts, F.lit("")))
    used = [h for h, f in mapping.items() if f in fields]
    rest = F.map_filter(values, lambda k, v: ~k.isin(used) & (F.coalesce(v, F.lit("")) != ""))
    return records.select(*(c for c in records.columns if c != values), *(c.alias(f) for f, c in columns.items()), rest.alias("attributes"))
