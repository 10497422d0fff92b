"""Decisions on incoming rows: marks that would replace stored ones, copies that a reviewer chose, sheets of marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marks_replaced(batch: DataFrame, stored: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """batch rows that would change marks stored under their key: action replaces_stored_marks and the differing columns, else update or insert."""
    old = stored.select(key, F.lit(True).alias("_known"), *(F.col(m).alias(f"_old_{m}") for m in marks))
    rows = batch.join(old, key, "left")
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))

    def differs(m: str) -> Column:
        numbers = F.col(m).try_cast("double"), F.col(f"_old_{m}").try_cast("double")
        same = F.coalesce(numbers[0] == numbers[1], text(m) == text(f"_old_{m}"), F.lit(False))
        return F.col("_known") & F.coalesce(text(m) != "", F.lit(False)) & ~same

    differing = F.array_compact(F.array(*(F.when(differs(m), F.lit(m)) for m in marks)))
    action = F.when(F.size("_diff") > 0, "replaces_stored_marks").when(F.col("_known"), "update").otherwise("insert")
    return rows.withColumn("_diff", differing).select(*batch.columns, action.alias("action"), F.array_join("_diff", ",").alias("differing"))


def skipped_rows(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(locator) of rows (locator, key, number) that a reviewer's decisions keep out.

    decisions: (locator, verdict).  keep_first skips the row it names; use_this keeps the row and skips
    all others of its key (of several such the last row); same_person drops the key of the row it names, with every copy.
    """
    named = decisions.join(rows, "locator")
    first = named.where("verdict = 'keep_first'").select("locator")
    chosen = named.where("verdict = 'use_this'").groupBy("key").agg(F.max_by("locator", "number").alias("_keep"))
    others = rows.join(chosen, "key").where(F.col("locator") != F.col("_keep")).select("locator")
    dropped = rows.join(named.where("verdict = 'same_person'").select("key").distinct(), "key", "left_semi").select("locator")
    return first.union(others).union(dropped).distinct()


def mark_columns(wide: DataFrame, columns: list[str], code: str = r"^[A-Za-z]{1,6}[ -]?[0-9]{1,4}[A-Za-z]?$|\([A-Za-z]{1,6}[0-9]{1,4}[A-Za-z]?\)", least: float = 0.6) -> DataFrame:
    """(column, course, filled, marks, chosen): which columns of a sheet are courses with marks.

    A course column has a course code in its header and numbers, or numbers with grace marks, in least of
    its filled cells.  One pass: each column is two conditional counts.
    """
    blank = lambda c: F.col(c).isNull() | F.trim(F.col(c).cast("string")).isin("", "-", "–", "—", "NaN", "nan")
    number = lambda c: F.col(c).cast("string").rlike(r"^\s*\d+(\.\d+)?\s*(\+\s*\d+(\.\d+)?)?\s*$")
    counts = wide.agg(*(F.count_if(~blank(c)).alias(f"f{i}") for i, c in enumerate(columns)), *(F.count_if(~blank(c) & number(c)).alias(f"m{i}") for i, c in enumerate(columns)))
    cells = counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col(f"m{i}").alias("marks")) for i, c in enumerate(columns)))))
    course = F.upper(F.regexp_extract("column", r"([A-Za-z]{1,6}[ -]?[0-9]{1,4}[A-Za-z]?)\)?$", 1))
    return cells.select("column", course.alias("course"), "filled", "marks", (F.col("column").rlike(code) & (F.col("filled") > 0) & (F.col("marks") >= least * F.col("filled"))).alias("chosen"))


def lapsed_names(checks: DataFrame, key: str, at: str, ok: Column, unresolved: Column, least: str = "24 hours") -> DataFrame:
    """(key, lapsed_at): the last failure of an unbroken run of failed look-ups that lasted least or longer; other failures neither end nor lengthen a run."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    runs = checks.withColumn("_run", F.sum(F.when(ok, 1).otherwise(0)).over(w)).where(unresolved)
    spans = runs.groupBy(key, "_run").agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where(F.col("_last") - F.col("_first") >= F.expr(f"interval {least}"))
    return spans.groupBy(key).agg(F.max("_last").alias("lapsed_at"))


def resolved(pages: DataFrame, names: list[str], location: str, programs: list[str], exclusions: list[str], official: Column) -> DataFrame:
    """pages (title, text) with score and level: how surely each is about the institution of these names.

    The first name that is found counts, the main one fully and others at 0.85: 0.5 in the title, 0.35 in
    the text.  The location adds 0.25 or 0.2, programmes 0.05 each up to 0.1, an excluded word takes 0.2,
    near the name 0.5.  A short name without location is capped at 0.45, any page without the location at 0.6,
    unless the site is official (1.0 more).
    """
    title, text = F.lower("title"), F.lower("text")
    word = lambda n: rf"(?<![a-z0-9]){n.lower()}(?![a-z0-9])"
    in_title = [title.rlike(word(n)) for n in names]
    in_text = [text.rlike(word(n)) for n in names]
    first = F.coalesce(*(F.when(a | b, F.lit(i)) for i, (a, b) in enumerate(zip(in_title, in_text, strict=True))))
    at = lambda cases, i: F.coalesce(*(F.when(first == k, c) for k, c in enumerate(cases)), F.lit(False))  # noqa: E731, ARG005
    weight = F.when(first == 0, 1.0).otherwise(0.85)
    found = F.when(first.isNotNull(), weight * (F.when(at(in_title, 0), 0.5).otherwise(0.0) + F.when(at(in_text, 0), 0.35).otherwise(0.0))).otherwise(0.0)
    place_title, place_text = F.contains(title, F.lit(location.lower())), F.contains(text, F.lit(location.lower()))
    place = F.when(place_title, 0.25).when(place_text, 0.2).otherwise(0.0) if location else F.lit(0.0)
    here = (place_title | place_text) if location else F.lit(False)
    hits = sum((F.contains(text, F.lit(p.lower())).cast("int") for p in programs), F.lit(0))
    taken = F.lit(0.0)
    for x in exclusions:
        near = F.lit(False)
        for n in names:
            near |= text.rlike(rf"(?s){word(n)}.{{0,120}}{x.lower()}|{x.lower()}.{{0,120}}{word(n)}")
        taken = taken + F.when(near, 0.5).when(F.contains(text, F.lit(x.lower())), 0.2).otherwise(0.0)
    score = F.when(official, 1.0).otherwise(0.0) + found + place + F.least(F.lit(0.1), 0.05 * hits) - taken
    short = F.coalesce(*(F.when(first == i, F.lit(len(n.split()) <= 2)) for i, n in enumerate(names)), F.lit(False))
    score = F.when(short & ~here & ~official, F.least(score, F.lit(0.45))).otherwise(score)
    score = F.when(first.isNotNull() & ~here & ~official & F.lit(bool(location)), F.least(score, F.lit(0.6))).otherwise(score)
    score = F.when(first.isNull() & ~official, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))
    level = F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("none")
    return pages.withColumns({"score": score, "level": level})


def matched(scored: DataFrame, key: str, margin: float = 0.2) -> DataFrame:
    """(key, entity, score, rival): the best entity of each page (high or medium), if it beats the best look-alike by the margin."""
    ours = (F.col("kind") != "lookalike") & (F.col("score") >= 0.5)
    best = scored.groupBy(key).agg(
        F.max_by(F.when(ours, F.col("entity")), F.when(ours, F.struct("score", "entity"))).alias("entity"), F.max(F.when(ours, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("kind") == "lookalike", F.col("score"))), F.lit(0.0)).alias("rival"),
    )
    return best.where(F.col("score") >= F.col("rival") + margin)
