"""Forms, sitemaps and report cells, made from the driver's columns by expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import headers
from ..sources import forms, reports
from .registry import query
from .roles import table


@query("""select c_custkey, 'Full Name' as label, c_name as "value", 1 as line from customer
  union all select c_custkey, 'Program', c_mktsegment, 3 from customer where trim(c_mktsegment) <> ''
  union all select c_custkey, 'Time', '10:30', 6 from customer""")
def form_fields(spark, sf):
    pages = table(spark, sf, "customer").selectExpr(
        "c_custkey", r"concat(' Full   Name : ', c_name, '\n no label here\nProgram: ', c_mktsegment, '\nPROGRAM: other\nEmpty:  \nTime: 10:30') as page")
    return forms.key_values(pages, "c_custkey", "page")


@query("""select page_id, 'page' as kind, url || '?a=1&b=2' as address, 0 as place from pages where page_id % 3 = 0
  union all select page_id, 'page', url, 1 from pages where page_id % 3 = 0
  union all select page_id, 'sitemap', url, 0 from pages where page_id % 3 = 1""")
def sitemap_addresses(spark, sf):
    files = table(spark, sf, "pages").selectExpr("page_id", """case page_id % 3
      when 0 then concat('<?xml version="1.0"?><urlset xmlns="x"><url><loc>', url, '?a=1&amp;b=2</loc></url><url><loc> ', url, ' </loc></url></urlset>')
      when 1 then concat('<s:sitemapindex xmlns:s="x"><s:sitemap><s:loc>', url, '</s:loc></s:sitemap></s:sitemapindex>')
      else concat('<!DOCTYPE x><urlset><url><loc>', url, '</loc></url></urlset>') end as xml""")
    return forms.sitemap_addresses(files, "page_id", "xml")


@query("""select cast(o_orderkey as varchar) as o_orderkey, case o_orderkey % 4 when 0 then '''=SUM(A1)' when 1 then '''@' || o_orderstatus when 2 then '-15.50' else o_orderpriority end as note,
  case when o_orderkey % 5 = 0 then '' when o_orderstatus = 'F' then 'Yes' else 'No' end as done from orders""")
def report_cells(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case o_orderkey % 4 when 0 then '=SUM(A1)' when 1 then concat('@', o_orderstatus) when 2 then '-15.50' else o_orderpriority end as note",
        "case when o_orderkey % 5 <> 0 then o_orderstatus = 'F' end as done")
    return reports.safe_rows(rows)


@query("""select user_id, list(event_type order by ts, event_id) as kinds, min(ts) as first_seen, count(*) as n from events group by 1""")
def evidence_by_asset(spark, sf):
    seen = table(spark, sf, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("_all"), F.min("ts").alias("first_seen"), F.count("*").alias("n"))
    return seen.select("user_id", F.col("_all.event_type").alias("kinds"), "first_seen", "n")


@query("select distinct l_suppkey as cited, l_partkey % 50 as by_asset from lineitem where l_suppkey is not null and l_suppkey <> l_partkey % 50")
def cited_by(spark, sf):
    edges = table(spark, sf, "lineitem").selectExpr("l_suppkey as cited", "l_partkey % 50 as by_asset")
    return edges.where("cited is not null and cited <> by_asset").distinct()


#: Some fields of an attendance sheet and their usual names.
_FIELDS = {
    "student_name": ["student name", "name", "name of student"], "program": ["program", "programme", "degree", "stream"],
    "semester": ["semester", "sem", "term"], "classes_held": ["classes held", "total classes", "held", "conducted"],
    "classes_attended": ["classes attended", "attended", "present"],
}
_HEADERS = ("Student_Name", "PROGRAMME", "Prog", "Semster", "Total Classes", "Classes", "Present", "Remarks", "  ")


@query()
def header_proposals(spark, sf):
    """Nine headers for each market segment's sheet, matched with the fields of an attendance sheet."""
    sheets = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source")).distinct()
    rows = sheets.select("source", F.explode(F.array(*map(F.lit, _HEADERS))).alias("header"))
    return headers.proposals(headers.scores(rows, _FIELDS))
