"""Sources that carry rows inside texts: form-like pages, sitemaps and seed sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a label, a colon or dash followed by white space, a value.
LABEL = r"^\s*([A-Za-z][A-Za-z0-9 ./'()-]{1,60}?)\s*[:\-]\s+(.+?)\s*$"
ADDRESS = r"<(?:[A-Za-z0-9_]+:)?loc>\s*(https?://[^<\s]+)\s*</"


def key_values(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, value, line) for each label of a text; of labels equal but for case the first stays.

    The choice is made inside the row, so no shuffle is needed however many lines a text has.
    """
    lines = F.split(F.col(text), r"\r\n?|\n")
    found = F.transform(
        lines,
        lambda x, i: F.struct(
            F.trim(F.regexp_replace(F.regexp_extract(x, LABEL, 1), r"\s+", " ")).alias("label"), F.trim(F.regexp_extract(x, LABEL, 2)).alias("value"), (i + 1).alias("line")
        ),
    )
    found = F.filter(found, lambda f: (f["label"] != "") & (f["value"] != ""))
    rows = texts.select(key, found.alias("found")).select(key, F.transform("found", lambda f: F.lower(f["label"])).alias("names"), F.posexplode("found").alias("no", "f"))
    return rows.where(F.array_position("names", F.lower(F.col("f.label"))) == F.col("no") + 1).select(key, "f.label", "f.value", "f.line")


def sitemap_addresses(files: DataFrame, key: str, xml: str, most: int | None = None) -> DataFrame:
    """(key, kind, address, place) for a sitemap ('page') or an index of sitemaps ('sitemap').

    A file that declares a document type or entities, or is neither, has none; most bounds the
    addresses of a file where the caller wants that.
    """
    body = F.col(xml)
    root = F.regexp_extract(body, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:[A-Za-z0-9_]+:)?([A-Za-z]+)", 1)
    kind = F.when(F.lower(root) == "urlset", "page").when(F.lower(root) == "sitemapindex", "sitemap")
    found = F.regexp_extract_all(body, F.lit(ADDRESS), F.lit(1))
    found = found if most is None else F.slice(found, 1, most)
    safe = files.where(~body.rlike(r"(?i)<!(?:doctype|entity)")).select(key, kind.alias("kind"), found.alias("_all"))
    rows = safe.where("kind is not null").select(key, "kind", F.posexplode("_all").alias("place", "address"))
    return rows.select(key, "kind", F.replace("address", F.lit("&amp;"), F.lit("&")).alias("address"), "place")


def read_seeds(spark: SparkSession, path: str, schema: T.StructType, lists: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated seeds with a strict header, # comments, and lists parted by a bar."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", schema=schema, mode="FAILFAST", enforceSchema=False)
    return rows.withColumns({c: listed(F.col(c)) for c in lists})


def listed(value: Column) -> Column:
    """The trimmed, non-empty parts of a list parted by a bar; null: none."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


#: Columns of the three seed sheets, those that are lists, grades and relations that may be claimed, kinds of entities.
SHEETS = {
    "sweep": "group subject subject_kind parent label url claimed_grade relation note".split(),
    "lookalikes": "name names locations url why".split(),
    "entities": "name kind parent names locations".split(),
}
LISTS = {"sweep": (), "lookalikes": ("names", "locations"), "entities": ("names", "locations")}
CLAIMED = ("A", "A-arch", "B", "C", "F")
RELATIONS = ("official", "affiliated", "community", "third_party", "unknown")
ENTITY_KINDS = ("organisation", "trust", "institution", "unit", "branch", "role")


def seed_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One of the three seed sheets, trimmed, without rows whose name (or subject) is blank; another header is an error.

    In a sweep, claims and relations that are not known are errors too: problem says which, null otherwise.  An entity
    of an unknown kind is an institution.
    """
    names = SHEETS[sheet]
    rows = read_seeds(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]), LISTS[sheet])
    rows = rows.withColumns({n: F.coalesce(F.trim(n), F.lit("")) for n in names if n not in LISTS[sheet]})
    first = "subject" if sheet == "sweep" else "name"
    if sheet == "sweep":
        problem = F.when(~F.col("claimed_grade").isin(*CLAIMED), F.concat(F.lit("unknown claimed grade "), "claimed_grade")).when(~F.col("relation").isin(*RELATIONS), F.concat(F.lit("unknown relation "), "relation"))
        rows = rows.withColumn("problem", problem)
    elif sheet == "entities":
        rows = rows.withColumn("kind", F.when(F.col("kind").isin(*ENTITY_KINDS), F.col("kind")).otherwise("institution"))
    return rows.where(F.col(first) != "")
