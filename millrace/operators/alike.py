"""Names that are alike among all, exactly and without a cap: equal names are one class, and classes meet by their rarest letters in a row."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

from ..functions.similarity import ratio
from .joins import settled

#: Names of a part of a frequent key that one task compares with another part.
PART = 4096
#: Rows that a task holds against each other at a time (some 20 MB), besides those of a cell.
STEP_ROWS = 200_000
#: Letters in a row that make a gram, and the lengths of names up to and from which pairs meet by one gram instead of two.
GRAM, SHORT, LONG = 3, 6, 80


def name_classes(people: DataFrame, key: str, name: str) -> DataFrame:
    """(key, class): people by their name without case; those without one are in no class."""
    return people.select(F.col(key).alias("key"), F.lower(name).alias("class")).where(F.trim("class") != "")


@pandas_udf(ArrayType(StringType()))
def _grams(names: pd.Series) -> pd.Series:
    """Each GRAM neighbouring letters with how often they came before in the name, so that repeats count."""

    def of(name: str) -> list[str]:
        seen: dict[str, int] = defaultdict(int)
        out = []
        for i in range(len(name) - GRAM + 1):
            gram = name[i : i + GRAM]
            seen[gram] += 1
            out.append(f"{gram}{seen[gram]}")
        return out

    return names.map(of)


@lru_cache(4096)
def lost_grams(a: int, least: float) -> int:
    """How many grams of a name of a letters a name that is alike can lack at most."""
    lengths = range(math.ceil(a * least / (2 - least) - 1e-9), math.floor(a * (2 - least) / least + 1e-9) + 1)
    kept = ((b, math.ceil(least * (a + b) / 2 - 1e-9)) for b in lengths)
    return max((GRAM * (a - m) + (GRAM - 1) * (b - m) for b, m in kept if m <= min(a, b)), default=0)


def _rare(least: float) -> Callable:
    @pandas_udf(ArrayType(LongType()))
    def rare(ranked: pd.Series) -> pd.Series:
        return ranked.map(lambda g: g[: lost_grams(len(g) + GRAM - 1, least) + 2])

    return rare


@pandas_udf(ArrayType(LongType()))
def _twos(rare: pd.Series) -> pd.Series:
    """The key of each two grams of a list, the rarer first."""

    def of(grams: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(len(grams), 1)
        return grams[i] ^ (grams[j] << 1)

    return rare.map(lambda g: of(np.asarray(g, dtype=np.int64)))


@pandas_udf(ArrayType(LongType()))
def _letters(names: pd.Series) -> pd.Series:
    """Two numbers: of each of 32 kinds of letters as many bits of four as the name has of them."""

    def of(name: str) -> np.ndarray:
        seen, bits = [0] * 32, [0, 0]
        for c in name:
            k = ord(c) % 32
            if seen[k] < 4:
                bits[k // 16] |= 1 << (k % 16 * 4 + seen[k])
                seen[k] += 1
        return np.array(bits, np.uint64).view(np.int64)

    return names.map(of)


def _met(least: float) -> Callable:
    """Pairs of names of a cell (a key's names of one part, or of two) whose lengths and letters do not speak against them; rows are sorted by cell.

    Row by row is held against the next, the next but one and so on, for all cells at hand at once.
    """

    def pairs(columns: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
        long, _, part_a, part_b, part, own, size, low, high = columns
        low, high = low.view(np.uint64), high.view(np.uint64)
        end, i, d = np.repeat(at[1:], np.diff(at)), np.arange(at[-1]), 1
        while len(i := i[i + d < end[i]]):
            j = i + d
            both, most = size[i] + size[j], np.maximum(size[i], size[j])
            good = (2 * np.minimum(size[i], size[j]) >= least * both - 1e-9) & ((long[i] == 1) == ((most <= SHORT) | (most > LONG))) & (own[i] != own[j])
            good &= ((part[i] != part[j]) | (part_a[i] == part_b[i])) & (
                np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j]) <= (1 - least) * both + 1e-9
            )
            if good.any():
                a, b = own[i[good]], own[j[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["id_a", "id_b"])
            d += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            at = np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]])
            at = at if last else at[:-1]  # the last cell may go on
            yield from pairs([c[: at[-1]] for c in columns], at)
            held[:] = [[c[at[-1] :] for c in columns]]

        rows = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= STEP_ROWS:
                yield from settle(False)
                rows = 0
        if held:
            yield from settle(True)

    return run


def alike_classes(classes: DataFrame, least: float = 0.9) -> DataFrame:
    """(name_a, name_b, ratio): all pairs of different names, name_a before name_b, whose difflib ratio is at least so much (0.9 to 1).

    A ratio of r says that both names keep M >= r * (a + b) / 2 letters in order.  Taking a letter out spoils
    three grams (three letters in a row) and putting one in spoils two, so a name of a letters loses no more
    than 3 * (a - M) + 2 * (b - M) grams, and among two more than that, the rarest, both names have two in common.
    Names meet by two such grams.  Pairs of which the longer name has over LONG letters meet by one gram, as their twos would
    be many, and so do those of at most SHORT letters, which may share but one.
    What meets are numbers only: a name's own, its length, and bits that count its letters, of which a pair may differ in
    a + b - 2 * M at most.  The few pairs left, each once, are looked at by edit distance and by difflib.  A frequent key is cut
    into parts by a hash of the number, and each two parts meet in a cell of their own, so no task gets all names that have it.
    The rows of a cell lie one after another in a task, which is all that moves, once.
    Joins are told to sort: Spark takes the tables for as small as the file that the names came from, and would broadcast them.
    Rows grow with the names, and pairs with those of names that share two rare grams: as their square where names are numbered ("Customer 0001"), too slow for more than some hundreds.
    """
    if not 0.9 <= least <= 1:
        raise ValueError("least must be from 0.9 to 1")
    names = classes.select(F.col("class").alias("name")).where(F.length("class") >= GRAM).distinct()
    names = settled(names.withColumns({"id": F.monotonically_increasing_id(), "grams": _grams("name"), "letters": _letters("name")}))
    each = names.select("id", F.explode("grams").alias("gram"))
    counted = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.hint("merge").join(counted, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("gram").alias("gram")))).alias("grams"))  # a name's own
    own = names.select("id", F.length("name").alias("len"), F.col("letters")[0].alias("low"), F.col("letters")[1].alias("high"))
    rare = settled(
        ranked.select("id", F.size(F.filter("grams", lambda g: g["n"] <= PART)).alias("few"), _rare(least)(F.col("grams.gram")).alias("rare")).join(own.hint("merge"), "id")
    )
    with_twos, by_one = F.col("len") <= LONG, (F.col("len") <= SHORT) | (F.col("len") * ((2 - least) / least) > LONG)
    single = F.slice("rare", F.lit(1), F.greatest(F.size("rare") - 1, F.lit(1)))

    def keyed(columns: list[str], twos: Column, ones: Column) -> DataFrame:
        two = rare.where(with_twos).select(*columns, F.lit(False).alias("long"), F.explode(twos).alias("key"))
        return two.unionByName(rare.where(by_one).select(*columns, F.lit(True).alias("long"), F.explode(ones).alias("key")))

    by = ["long", "key"]
    # no key is more frequent than its rarer gram
    often = keyed([], _twos(F.slice("rare", F.col("few") + 1, F.size("rare"))), F.slice(single, F.col("few") + 1, F.size("rare")))
    frequent = F.broadcast(often.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART))  # one for each PART rows at most
    rows = keyed(["id", "len", "low", "high"], _twos("rare"), single).join(frequent, by, "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / PART).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = [*by, "part_a", "part_b"]
    rows = rows.select(F.col("long").cast("byte").alias("long"), "key", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "id", "len", "low", "high")
    met = rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_met(least), "id_a long, id_b long")
    met = met.select("id_a", "id_b").distinct()
    for s in "ab":
        met = met.hint("merge").join(names.select(F.col("id").alias(f"id_{s}"), F.col("name").alias(s)), f"id_{s}")
    met = met.where(F.levenshtein("a", "b") <= (1 - least) * (F.length("a") + F.length("b")) + 1e-9)
    met = met.select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b")).withColumn("ratio", ratio("name_a", "name_b")).where(F.col("ratio") >= least)
    return settled(met)


def alike_people(people: DataFrame, key: str, name: str, least: float = 0.9) -> DataFrame:
    """(key, class, copies, links) for each person: the smallest key of the same name, how many have that name, and how many people of other names are alike.

    A person without a name is a class alone, with no links.
    """
    named = name_classes(people, key, name)
    sizes = named.groupBy("class").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    pairs = alike_classes(named, least)
    ends = pairs.select(F.col("name_a").alias("class"), F.col("name_b").alias("_other")).unionByName(pairs.select(F.col("name_b").alias("class"), F.col("name_a").alias("_other")))
    links = ends.hint("merge").join(sizes.select(F.col("class").alias("_other"), F.col("copies").alias("_n")), "_other").groupBy("class").agg(F.sum("_n").alias("links"))
    told = sizes.hint("merge").join(links, "class", "left")
    every = people.select(F.col(key).alias("key"), F.lower(name).alias("class")).hint("merge").join(told, "class", "left")
    return every.select("key", F.coalesce("first", "key").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def corroborated(people: DataFrame, key: str, name: str, fields: list[str], least: float = 0.9) -> DataFrame:
    """(name_a, name_b, ratio, agree): classes of which two people share a value of a field, and the fields in which they do; name_a = name_b where both have one name.

    A value counts however many people have it.  Values are those of a class, each once, so a link costs as much as
    name_a has values and people are never paired; name_classes() tells who is in a class.
    """
    value = lambda f: F.nullif(F.lower(F.trim(F.col(f).cast("string"))), F.lit(""))
    held = F.explode(F.array_compact(F.array(*(F.when(value(f).isNotNull(), F.struct(F.lit(f).alias("field"), value(f).alias("value"))) for f in fields))))
    values = people.select(F.lower(name).alias("class"), held.alias("has")).where(F.trim("class") != "").groupBy("class", "has").agg(F.count(F.lit(1)).alias("n"))
    own = values.where("n > 1").select(F.col("class").alias("name_a"), F.col("class").alias("name_b"), F.lit(1.0).alias("ratio"), "has")
    a, b = (values.select(F.col("class").alias(f"name_{s}"), "has") for s in "ab")
    shared = alike_classes(name_classes(people, key, name), least).hint("merge").join(a, "name_a").hint("merge").join(b, ["name_b", "has"]).select("name_a", "name_b", "ratio", "has")
    found = shared.unionByName(own).groupBy("name_a", "name_b", "ratio").agg(F.array_sort(F.collect_set("has.field")).alias("agree"))  # as many as fields
    return found.withColumn("score", F.least(F.lit(1.0), F.round(F.col("ratio") + 0.1 * F.size("agree"), 4)))
