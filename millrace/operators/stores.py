"""Merges, updates and retention of stored tables, as joins and conditional columns.

A store is a DataFrame; each operator returns the table as it is afterwards, or what each incoming row did to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import fingerprint


def replaced_partition(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """stored with all rows of the keys that rows have replaced by rows."""
    return stored.join(rows.select(key).distinct(), key, "left_anti").select(stored.columns).unionByName(rows.select(stored.columns))


def without_matches(stored: DataFrame, gone: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """stored less the rows that refer to a gone row, by any of the (own, other) key pairs."""
    for own, other in keys:
        stored = stored.join(gone.select(F.col(other).alias("_gone")).distinct(), F.col(own) == F.col("_gone"), "left_anti")
    return stored


def updated_fields(stored: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """stored after keyed updates: changes has (key, field, value as text); the last change of a field by order wins, other fields are refused.

    The key itself never changes.  Adds before and after: maps of what each row's updates touched.
    """
    held = changes.where(F.col("field").isin(allowed)).groupBy(key, "field").agg(F.max_by("value", "at").alias("value"))
    wide = held.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"))  # one entry a field
    rows = stored.join(wide, key, "left")
    touched = lambda c: F.map_contains_key("_new", F.lit(c))
    new = {c: F.when(touched(c), F.col("_new")[c].try_cast(stored.schema[c].dataType)).otherwise(F.col(c)) for c in allowed}
    before = F.map_filter(F.create_map(*(x for c in allowed for x in (F.lit(c), F.col(c).cast("string")))), lambda k, _: F.map_contains_key("_new", k))
    return rows.withColumns({"before": before, "after": F.col("_new")}).withColumns(new).drop("_new")


def merged_lists(old: Column, new: Column) -> Column:
    """Both lists in their order, each value once."""
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def filled(old: Column, new: Column) -> Column:
    """What is stored; what is new only fills a blank."""
    return F.coalesce(F.nullif(F.trim(old), F.lit("")), F.nullif(F.trim(new), F.lit("")))


def incident_verdicts(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """For each incident (fingerprint, severity 0 to 2): new, reopened, escalated or repeat, and its row afterwards."""
    old = stored.select("fingerprint", F.col("severity").alias("_severity"), F.col("status").alias("_status"), F.col("times_seen").alias("_times"))
    rows = seen.join(old, "fingerprint", "left")
    known, rises = F.col("_status").isNotNull(), F.col("severity") > F.col("_severity")
    reopened = F.col("_status") == "resolved"
    verdict = F.when(~known, "new").when(reopened, "reopened").when(rises, "escalated").otherwise("repeat")
    return rows.select(
        "fingerprint", verdict.alias("verdict"), F.greatest("severity", F.coalesce("_severity", F.lit(0))).alias("severity"),
        F.when(~known | reopened | rises, "open").otherwise(F.col("_status")).alias("status"), (F.coalesce("_times", F.lit(0)) + 1).alias("times_seen"), (~known | reopened | rises).alias("notify"),
    )


def document_verdicts(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """For each page (url, sha, extracted, status, reason): new, changed or duplicate, and the copy that is kept.

    A full copy is not given up for a snippet, nor is a switch between both a change; a row kept for the
    first time is new; what another run kept is not undone because it is outside this run's window.
    """
    old = stored.select("url", *(F.col(c).alias(f"_{c}") for c in ("sha", "extracted", "status", "first_kept")))
    rows = seen.join(old, "url", "left")
    known = F.col("_status").isNotNull()
    poorer = known & F.col("_extracted") & ~F.col("extracted")
    status = F.when(poorer, F.col("_status")).otherwise(F.col("status"))
    late = known & (F.col("_status") == "kept") & (status == "excluded") & (F.when(poorer, F.lit(None)).otherwise(F.col("reason")) == "outside_time_window")
    status = F.when(F.coalesce(late, F.lit(False)), "kept").otherwise(status)
    changed = (F.col("_extracted") == F.col("extracted")) & (F.col("_sha") != F.col("sha"))
    first = (status == "kept") & (F.col("_status") != "kept") & ~F.coalesce("_first_kept", F.lit(False))
    verdict = F.when(~known, "new").when(first, "new").when(changed, "changed").otherwise("duplicate")
    return rows.select("url", verdict.alias("verdict"), F.when(poorer, F.col("_sha")).otherwise(F.col("sha")).alias("sha"), status.alias("status"), F.when(poorer, True).otherwise(F.col("extracted")).alias("extracted"))


def review_items(open_items: DataFrame, proposed: DataFrame, parts: list[str]) -> DataFrame:
    """Proposed items that are new: one for each SHA-256 fingerprint of its parts, and none that is open already."""
    marked = proposed.withColumn("fingerprint", F.sha2(F.concat_ws("|", *(F.lower(F.col(p).cast("string")) for p in parts)), 256))
    one = marked.groupBy("fingerprint").agg(*(F.min(p).alias(p) for p in parts))
    return one.join(open_items.select("fingerprint"), "fingerprint", "left_anti")


def schedule_sources(stored: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Sources after an upsert: known ones keep their schedule and take the least hops, others come in."""
    new = found.groupBy(*key).agg(F.min("hops").alias("_hops"), F.min("due").alias("_due"))
    both = stored.join(new, key, "full_outer")
    return both.select(*key, F.least("hops", "_hops").alias("hops"), F.coalesce("due", "_due").alias("due"), F.col("due").isNull().alias("added"))


def completed_source(yields: Column, priority: Column, streak: Column, failed: Column) -> dict[str, Column]:
    """Priority and failure streak after a run."""
    return {"priority": F.round(priority * 0.7 + F.least(yields, F.lit(5)) * 0.3, 6), "failure_streak": F.when(failed, streak + 1).otherwise(0)}


def gap_sources(sources: DataFrame, gaps: DataFrame, target: str, now: Column, most: int) -> DataFrame:
    """Sources with topic gap where their target is one, due within most seconds of now and at least that often; other gap topics end."""
    rows = sources.join(gaps.select(target).distinct().withColumn("_gap", F.lit(True)), target, "left").withColumn("_gap", F.coalesce("_gap", F.lit(False)) & (F.col("status") == "active"))
    by = now + F.make_dt_interval(secs=F.lit(most).cast("decimal(18,6)"))
    return rows.withColumns({
        "topic": F.when(F.col("_gap"), "gap").when(F.col("topic") == "gap", "").otherwise(F.col("topic")),
        "interval": F.when(F.col("_gap"), F.least("interval", F.lit(most))).otherwise(F.col("interval")),
        "due": F.when(F.col("_gap"), F.least("due", by)).otherwise(F.col("due")),
    }).drop("_gap")


def retained(rows: DataFrame, at: str, before: Column, blank: list[str], baseline: Column | None = None) -> DataFrame:
    """rows less the old ones but the newest baseline; free text of old rows that stay is replaced by [expired]."""
    old = F.col(at) < before
    if baseline is not None:
        newest = rows.where(baseline).agg(F.max(at).alias("_newest"))
        rows = rows.join(F.broadcast(newest))  # one row
        rows = rows.where(~old | (baseline & (F.col(at) == F.col("_newest")))).drop("_newest")
    return rows.withColumns({c: F.when(old, "[expired]").otherwise(F.col(c)) for c in blank})


def fair_share(candidates: DataFrame, query: str, order: list[str], most: int) -> DataFrame:
    """The first most candidates, taken in turns: the best of each query, then the second best of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return candidates.withColumn("turn", turn).orderBy("turn", query).limit(most)


def empty_passes(runs: DataFrame, key: str, at: str, found: str, n: int = 2) -> DataFrame:
    """Keys whose n newest passes all found nothing; fewer passes are not enough."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    newest = runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return newest.groupBy(key).agg((F.count(F.lit(1)) == n).alias("_enough"), (F.sum(found) == 0).alias("_none")).select(key, (F.col("_enough") & F.col("_none")).alias("pause"))


def since_last(events: DataFrame, key: list[str], at: str, success: Column) -> DataFrame:
    """Events after the last success of their key before now; all of a key without one."""
    last = F.max(F.when(success, F.col(at))).over(Window.partitionBy(*key))
    return events.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(at) > F.col("_last"))).drop("_last")


def held_grades(before: DataFrame, after: DataFrame, key: str = "asset_id") -> DataFrame:
    """(key, old, new, published, held): changed ranks wait for the gate, but for falls to the lowest, which are published at once."""
    both = after.select(key, F.col("rank").alias("new")).join(before.select(key, F.col("rank").alias("old")), key, "left").where(~F.col("new").eqNullSafe(F.col("old")))
    drop = F.col("new") == 0
    return both.select(key, "old", "new", F.when(drop | F.col("old").isNull(), F.col("new")).otherwise(F.col("old")).alias("published"), (~drop & F.col("old").isNotNull()).alias("held"))


def work_claims(sources: DataFrame, classes: dict[str, int], now: Column) -> DataFrame:
    """The due sources of each class up to its quota, overdue ones by how late they are and how much they yield."""
    due = sources.where((F.col("due") <= now) & (F.col("status") == "active"))
    w = Window.partitionBy("work_class").orderBy(F.desc("priority"), "due", "source_id")
    quota = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in classes.items() for x in kv)), F.col("work_class")), F.lit(0))
    return due.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def adapted_interval(interval: Column, base: Column, yields: Column, streak: Column, most: int) -> Column:
    """The next interval: half (not under an eighth of the base) after a yield, 1.5 times as long without, doubled for each failure in a row; most at most."""
    calm = F.when(yields > 0, F.greatest(interval / 2, base / 8)).otherwise(interval * 1.5)
    return F.least(F.lit(most), F.when(streak > 0, base * F.pow(F.lit(2), F.least(streak, F.lit(10)))).otherwise(calm)).cast("long")


def first_wins(stored: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """stored and the first row of each key that it lacks; what is stored is never changed.  Null keys are one key."""
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in others))
    held = stored.select(*(F.col(k).alias(f"_held_{k}") for k in key)).distinct()
    known = [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in key]
    return stored.unionByName(first.join(held, known, "left_anti").select(stored.columns))


def suppressed(rows: DataFrame, fingerprints: DataFrame, tenant: str, identifier: str, key: bytes) -> DataFrame:
    """rows with suppressed: whether their tenant's list has the keyed fingerprint of their identifier.

    Lists hold (tenant, key_hmac) only, so an identifier cannot be read from them; repeats in a list say no more.
    """
    listed = fingerprints.select(F.col(tenant).alias("_tenant"), F.col("key_hmac").alias("_hmac"), F.lit(True).alias("_listed")).distinct()
    marked = rows.withColumn("_print", fingerprint(key, F.col(identifier)))
    return marked.join(listed, (F.col(tenant) == F.col("_tenant")) & (F.col("_print") == F.col("_hmac")), "left").select(*rows.columns, F.coalesce("_listed", F.lit(False)).alias("suppressed"))


def with_canaries(gold: DataFrame, lookalikes: DataFrame) -> DataFrame:
    """gold (asset_key, split, relation, least_grade, entity_name) after its items among the look-alikes (asset_key, entity_name) became canaries."""
    new = lookalikes.groupBy("asset_key").agg(F.min("entity_name").alias("_name"))
    rows = gold.join(new, "asset_key", "left")
    turned = F.col("_name").isNotNull() & (F.col("split") != "canary")
    values = {"split": F.lit("canary"), "relation": F.lit("third_party"), "least_grade": F.lit("D"), "entity_name": F.substring("_name", 1, 200)}
    return rows.withColumn("_turned", turned).select(*(F.when(F.col("_turned"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in gold.columns))
