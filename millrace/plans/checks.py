"""Hashes of contents, citations, languages, passages of documents, gates and removals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import passages, text
from ..operators import dedupe, graph
from ..sources import tables
from . import ingest
from .registry import query
from .roles import table


@query("""select c_custkey, sha256(concat_ws(chr(10), 'c_mktsegment=' || c_mktsegment, case when c_custkey % 3 > 0 then 'c_name=' || c_name end)) as hash from customer""")
def content_hashes(spark, sf):
    """One hash for the columns of a row that are not blank, whatever their order."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("c_name"))
    return rows.select("c_custkey", dedupe.content_hash(["c_name", "c_mktsegment"]).alias("hash"))


@query("""select c_custkey, case c_custkey % 3 when 0 then ['doc-' || cast(c_custkey as varchar) || ':page 3', 'doc-x:page 12'] when 1 then ['doc-1:page 1'] else [] end as cited from customer""")
def citations(spark, sf):
    said = "case c_custkey % 3 when 0 then concat('As [doc-', c_custkey, ':page 3] and [doc-x:page 12] say') when 1 then '[doc-1:page 1][doc-1: page 2]' else 'none [page 1]' end"
    return table(spark, sf, "customer").select("c_custkey", text.citations(F.expr(said)).alias("cited"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'hi' when 1 then 'kn' else 'en' end as language from customer""")
def script_languages(spark, sf):
    said = F.element_at(F.array(F.lit("शुल्क fee"), F.lit("ಕಾಲೇಜು"), F.lit("college"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", text.language(said).alias("language"))


@query("select c_nationkey, 'main' as sheet, true as usable from customer group by 1")
def usable_workbook_sheets(spark, sf):
    part = lambda c: F.transform("rows", lambda r: r[c])
    made = ingest._by_nation(spark, sf).select(F.col("file").alias("path"), ingest.workbooks(part("c_custkey"), part("c_name"), part("c_acctbal")).alias("content"))
    found = tables.read_tables(made)
    return tables.usable_sheets(found).join(tables.largest_table(found), ["path", "sheet"]).select(ingest._nation("path").alias("c_nationkey"), "sheet", "usable").distinct()


@query()
def ingested_documents(spark, sf):
    """Documents of every nation as passages: the paragraphs and the rows of their tables, cut to size, with their embeddings' length."""
    part = lambda c: F.transform("rows", lambda r: r[c])
    made = ingest._by_nation(spark, sf).select(F.col("file").alias("path"), ingest.documents(part("c_custkey"), part("c_name")).alias("content"))
    return tables.document_passages(made).withColumn("norm", F.round(F.sqrt(text.dot(passages.embedded("passage"), passages.embedded("passage"))), 4))


_LEAKS = {"close": 51, "fallen": 60, "swapped": 51}


@query("""with m as (select avg(case when value > 50 then 1.0 else 0 end) as a, avg(case when value > 51 then 1.0 else 0 end) as b, avg(case when value > 60 then 1.0 else 0 end) as c, min(event_type) as low, max(event_type) as high from events)
  select 'close' as run, a - b <= 0.02 as publish, case when a - b > 0.02 then 'holdout_recall|precision' else '' end as reasons from m union all select 'fallen', a - c <= 0.02, case when a - c > 0.02 then 'holdout_recall|precision' else '' end from m
  union all select 'swapped', false, concat_ws('|', 'leaks ' || high, case when a - b > 0.02 then 'holdout_recall|precision' end) from m""")
def gate_verdicts(spark, sf):
    """New measures are published unless one falls by more than 0.02, or a look-alike leaks that did not before."""
    events = table(spark, sf, "events")

    def measured(least, leak):
        share = F.avg((F.col("value") > least).cast("double"))
        return events.agg(share.alias("holdout_recall"), F.lit(1.0).alias("seed_rate"), share.alias("precision"), F.array(leak("event_type")).alias("canary_leaks"))

    one = lambda name, least: graph.gate(measured(50, F.min), measured(least, F.max if name == "swapped" else F.min)).withColumn("run", F.lit(name))
    runs = [one(*x) for x in _LEAKS.items()]
    return runs[0].union(runs[1]).union(runs[2]).select("run", "publish", F.array_join("reasons", "|").alias("reasons"))


@query("""with l as (select user_id as asset_id, event_id % 3 as page, max_by(case when value < 40 then 'refutes' else 'supports' end, ts) as p, max(ts) as t from events group by 1, 2) select asset_id, page from l where p = 'supports' and ((page = 1 and t < timestamp '2024-01-25') or (page = 2 and t < timestamp '2024-01-02'))""")
def removed_links(spark, sf):
    """Links that a later clean fetch of their page no longer has."""
    links = table(spark, sf, "events").selectExpr("user_id as asset_id", "event_id % 3 as page", "case when value < 40 then 'refutes' else 'supports' end as polarity", "ts as observed_at")
    fetched = spark.createDataFrame([(1, "2024-01-25"), (2, "2024-01-02")], "page long, d string").select("page", F.col("d").cast("timestamp").alias("fetched_at"))
    return graph.removals(links, fetched)
