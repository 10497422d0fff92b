"""Keys, batch duplicates, blocked pairs of probable duplicates, and merging upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio


def record_key(parts: list[str]) -> Column:
    """Natural key: parts trimmed, lower-cased, inner white space single, missing ones empty, joined by |."""
    clean = [F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(p).cast("string"), F.lit(""))), r"\s+", " ")) for p in parts]
    return F.concat_ws("|", *clean)


def missing_key(key: Column) -> Column:
    return key.rlike(r"^\|*$")


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns that are not blank, by name."""
    parts = [
        F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.trim(F.col(c).cast("string")))) for c in sorted(columns)
    ]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def duplicate_actions(batch: DataFrame, stored: DataFrame, key: str, content: list[str], order: list[str]) -> DataFrame:
    """batch with action: insert or update for the first row of a key, else duplicate_in_batch or conflict_in_batch.

    differing lists the columns in which a later copy departs from the first.
    """
    w = Window.partitionBy(key).orderBy(*order)
    marked = batch.withColumn("_n", F.row_number().over(w)).withColumns({f"_first_{c}": F.first(c).over(w) for c in content})
    differing = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_first_{c}")), F.lit(c)) for c in content)))
    known = stored.select(key, F.lit(True).alias("_stored")).distinct()
    action = (
        F.when((F.col("_n") > 1) & (F.size("_diff") == 0), "duplicate_in_batch")
        .when(F.col("_n") > 1, "conflict_in_batch")
        .when(F.col("_stored"), "update")
        .otherwise("insert")
    )
    return (
        marked.withColumn("_diff", differing).join(known, key, "left")
        .select(*batch.columns, action.alias("action"), F.array_join("_diff", ",").alias("differing"))
    )


def block_rows(people: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(key, name, block): a row for each value of the fields that is not blank, and one for first and last name together."""
    value = lambda f: F.nullif(F.lower(F.trim(F.col(f).cast("string"))), F.lit(""))
    words = F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")
    own = F.when(F.size(words) >= 2, F.concat(F.lit("name:"), F.get(words, F.lit(0)), F.lit("|"), F.element_at(words, -1)))
    blocks = F.array_compact(F.array(own, *(F.when(value(f).isNotNull(), F.concat(F.lit(f"{f}:"), value(f))) for f in fields)))
    return people.select(F.col(key).alias("key"), F.col(name).alias("name"), F.explode(blocks).alias("block"))


def oversize_blocks(rows: DataFrame, max_block: int = 200) -> DataFrame:
    """(block, members) of the blocks that blocked_pairs() leaves out: one row each, whatever their size."""
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > max_block)


def blocked_pairs(people: DataFrame, key: str, fields: list[str], name: str, max_block: int = 200) -> DataFrame:
    """(a, b, corroborating): pairs of keys that share a block, with the number of blocks that they share.

    As the rule has it, a value that over max_block people have (a shared telephone, a default date) says
    nothing about any two of them: such blocks neither pair nor corroborate, and oversize_blocks() lists
    them, so that none is lost unseen.
    """
    rows = block_rows(people, key, fields, name)
    small = rows.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where(F.col("members").between(2, max_block)).select("block")
    rows = rows.join(small, "block")
    a, b = (rows.select("block", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "name"))) for s in "ab")
    pairs = a.join(b, "block").where("key_a < key_b")
    return pairs.groupBy("key_a", "key_b", "name_a", "name_b").agg(F.count(F.lit(1)).alias("corroborating"))


def probable_people(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs whose names are alike: score = min(1, ratio + 0.1 for each field that agrees)."""
    alike = pairs.withColumn("ratio", ratio("name_a", "name_b")).where(F.col("ratio") >= least)
    return alike.withColumn("score", F.least(F.lit(1.0), F.round(F.col("ratio") + 0.1 * F.col("corroborating"), 4)))


def upsert_actions(batch: DataFrame, stored: DataFrame, key: str, columns: list[str], order: list[str], merge: bool = False) -> DataFrame:
    """Each batch row's fate: inserted, updated, unchanged, or skipped with a reason.

    With merge, only columns are written and a blank never erases what is stored.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    held = stored.select(key, *(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("_stored"))
    rows = batch.withColumn("_n", first).join(held, key, "left")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    new = {c: F.when(blank(c), F.col(f"_old_{c}")).otherwise(F.col(c)) if merge else F.col(c) for c in columns}
    same = F.lit(True)
    for c in columns:
        same &= new[c].eqNullSafe(F.col(f"_old_{c}"))
    action = (
        F.when(F.coalesce(missing_key(F.col(key).cast("string")), F.lit(True)), "skipped")
        .when(F.col("_n") > 1, "skipped")
        .when(F.col("_stored").isNull(), "inserted")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    reason = F.when(F.coalesce(missing_key(F.col(key).cast("string")), F.lit(True)), "missing_natural_key").when(F.col("_n") > 1, "duplicate_in_batch")
    rest = [c for c in batch.columns if c not in columns]
    return rows.select(*rest, *(new[c].alias(c) for c in columns), action.alias("action"), reason.alias("reason"))


def upsert(batch: DataFrame, stored: DataFrame, key: str, columns: list[str], order: list[str], merge: bool = False) -> DataFrame:
    """The table after the upsert: stored rows, with updates, and the inserted ones."""
    fate = upsert_actions(batch, stored, key, columns, order, merge)
    written = fate.where(F.col("action").isin("inserted", "updated")).select(key, *columns)
    kept = stored.select(key, *columns).join(written.select(key), key, "left_anti")
    return kept.unionByName(written)


def merge_derived(batch: DataFrame, stored: DataFrame, key: str, stated: list[str], derived: dict[str, Column]) -> DataFrame:
    """Rows of both, stated columns merged without erasing, derived columns recomputed unless the batch states them."""
    new = batch.select(key, *(F.col(c).alias(f"_new_{c}") for c in [*stated, *derived] if c in batch.columns))
    both = stored.join(new, key, "full_outer")
    merged = both.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in stated if f"_new_{c}" in both.columns})
    for c, formula in derived.items():
        said = F.col(f"_new_{c}") if f"_new_{c}" in both.columns else F.lit(None)
        merged = merged.withColumn(c, F.coalesce(said, formula, F.col(c)))
    return merged.select(key, *stated, *derived)
