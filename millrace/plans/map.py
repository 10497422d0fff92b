"""Entities and links of the map: names, queries, seeds, pages that identify, owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import entities, graph
from ..sources import pages
from . import stores, textual
from .registry import query
from .roles import table

NAMES = ["St. John and Mary College (SJMC)", "BGS & Sons", "A (B) C", "Hand and Heart", "AND", "R&D Institute", "x", "Anderson College"]
ACCOUNTS = [
    ("bgscet", "bgscet_cse", ""), ("bgscet", "bgscetalumni", ""), ("BGSCET", "x1", "BGSCET Official"), ("bgscet", "rahul_bgscet", "Rahul Kumar | BGSCET"), ("BGS College", "bgscollege", ""), ("BGS College", "bgs.college.mandya", ""),
    ("AIT", "aitofficial", ""), ("AIT", "ait_official", ""), ("bgscet", "rahulbgscet", "Rahul (@x)"), ("bgscet", "", "bgscet 2024 news on Instagram"), ("", "bgs", "bgs"), ("bgscet", "officialbgscetcollege", ""),
]


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(f"select c_custkey, regexp_replace(regexp_replace(regexp_replace(lower(x), '\\([^)]*\\)', ' ', 'g'), '\\band\\b|&', ' ', 'g'), '[^a-z0-9]', '', 'g') as key from (select c_custkey, ([{', '.join(map(_sql, NAMES))}])[cast(c_custkey % {len(NAMES)} as integer) + 1] as x from customer)")
def entity_keys(spark, sf):
    x = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", entities.entity_key(x).alias("key"))


@query()
def accounts_of_entities(spark, sf):
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(ACCOUNTS)], "i int, name string, handle string, title string")
    return rows.withColumn("own", entities.names_entity(F.col("name"), F.col("handle"), F.col("title"), ["Mandya"]))


@query()
def search_queries(spark, sf):
    """Queries for each nation as an institution, in turns."""
    rows = table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), F.array(F.lower("n_name")).alias("aliases"), F.when(F.col("n_nationkey") % 2 == 0, "North").alias("location"), F.array(F.lit("trade"), F.lit("school")).alias("keywords"),
        F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("hostel"), F.lit("fees"))).otherwise(F.array().cast("array<string>")).alias("terms"), F.col("n_nationkey").alias("rotation"),
    )
    return entities.search_queries(rows, "terms", {"news": "news", "event": "event", "fees": "fees"}).select("name", "queries")


@query("""with r as (select 'k' || cast(user_id as varchar) as key, event_type as claimed, event_id as line from events), f as (select key, min_by(case when claimed = 'error' then 'lookalike' else claimed end, line) as claimed from r group by 1)
  select key, claimed, case when claimed = 'lookalike' then 'canary' when cast('0x' || substr(sha256(key), 1, 8) as bigint) % 100 < 20 then 'holdout' else 'seed' end as split from f""")
def seed_splits(spark, sf):
    claimed = F.when(F.col("event_type") == "error", "lookalike").otherwise(F.col("event_type")).alias("claimed")
    rows = table(spark, sf, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), claimed, F.col("event_id").alias("line"))
    return entities.seed_rows(rows, "key").drop("line")


@query("""with e as (select c_custkey as entity_id, c_name as name, case c_custkey % 5 when 0 then 'self' when 1 then 'lookalike' else 'unit' end as kind, c_nationkey % 2 = 0 as under from customer),
  l as (select *, case when kind = 'self' then 0 when under then 1 else 2 end as level from e where kind <> 'lookalike') select entity_id, level, row_number() over (partition by level order by name, entity_id) as place from l""")
def ranked_entities(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey as entity_id", "c_name as name", "case c_custkey % 5 when 0 then 'self' when 1 then 'lookalike' else 'unit' end as kind", "c_nationkey % 2 = 0 as under_self")
    return entities.ranked_entities(rows).select("entity_id", "level", "place")


_LINKS = "links as (select c_nationkey as site, 'http://s' || cast(c_custkey % 7 as varchar) || '.org/' || case c_custkey % 4 when 0 then 'contact' when 1 then 'about-us' else 'x' end as target, case c_custkey % 5 when 0 then 'Connect' else 'Go' end as label, cast(c_custkey as integer) as position from customer)"


@query(f"""with {_LINKS}, r as (select site, target, min(position) as position from links where not contains(target, 's6') and regexp_matches(lower(target || ' ' || label), 'contact|about|imprint|impressum|social|connect') group by 1, 2),
  p as (select *, row_number() over (partition by site order by position, target) as place from r) select site, target, place from p where place <= 3""")
def candidate_pages(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_nationkey as site", "concat('http://s', c_custkey % 7, '.org/', case c_custkey % 4 when 0 then 'contact' when 1 then 'about-us' else 'x' end) as target", "case c_custkey % 5 when 0 then 'Connect' else 'Go' end as label", "cast(c_custkey as int) as position")
    return entities.candidate_pages(rows, ~F.contains("target", F.lit("s6")), 3).select("site", "target", "place")


@query()
def identity_links(spark, sf):
    """Links of the pages to accounts on platforms, from headers and footers."""
    links = pages.page_links(table(spark, sf, "pages")).join(table(spark, sf, "pages").select("page_id", F.col("url").alias("page")), "page_id")
    return entities.identity_links(links.withColumn("site", text.domain(F.col("page"))), text.platform(text.site(F.col("target"))))


@query(f"""with e as ({stores._EVIDENCE}), l as (select asset_id, source_url as page, max_by(polarity, observed_at) as polarity, max_by(detail, observed_at) as detail from e where kind = 'official_link' group by 1, 2)
  select asset_id, page, detail from l where polarity = 'supports' and page in ('page1', 'page2')""")
def reconfirmed_links(spark, sf):
    links = stores.evidence(spark, sf).where("kind = 'official_link'").withColumnRenamed("source_url", "page")
    return entities.reconfirmed(links, spark.createDataFrame([("page1",), ("page2",)], "page string"), F.lit("2024-03-01").cast("timestamp")).drop("observed_at")


@query("""with recursive placed as (select c_custkey as asset_id, case when c_custkey % 10 > 0 then c_custkey end as entity_id from customer),
  up as (select asset_id, entity_id from placed where entity_id % 9 <> 4 union all select asset_id, entity_id // 4 from up where entity_id // 4 > 0)
  select asset_id, entity_id as owner from up where entity_id in (1, 2, 3) union all select asset_id, unnest([1, 2, 3]) from placed where entity_id is null""")
def claimable_assets(spark, sf):
    """Accounts that three owners may confirm, in a tree of units in which some are persons."""
    tree = table(spark, sf, "customer").selectExpr("c_custkey as entity_id", "case when floor(c_custkey / 4) > 0 then cast(floor(c_custkey / 4) as bigint) end as parent_id", "case when c_custkey % 9 = 4 then 'person' else 'unit' end as kind")
    return entities.claimable(tree.selectExpr("entity_id as asset_id", "case when entity_id % 10 > 0 then entity_id end as entity_id"), tree, [1, 2, 3], ("person",))


@query(f"""with {textual._GRADED}, {textual._ASSETS}, gold as (select distinct user_id k, case user_id % 4 when 0 then 'holdout' when 1 then 'canary' else 'seed' end split from events where user_id % 2 = 0 or user_id % 4 = 1),
  j as (select platform, rank, split from assets left join gold on k = asset_id) select platform, count(*) as assets, count(*) filter (where rank >= 3) as verified, round(count(*) filter (where rank >= 3 and split in ('seed', 'holdout')) / nullif(count(*) filter (where rank >= 3 and split is not null), 0), 4) as precision,
    round(count(*) filter (where split = 'holdout' and rank >= 3) / nullif(count(*) filter (where split = 'holdout'), 0), 4) as holdout_recall from j group by rollup (platform)""")
def platform_metrics(spark, sf):
    """For each platform and in all: assets, verified ones, their precision against gold, and hold-out recall."""
    gold = table(spark, sf, "events").where("user_id % 2 = 0 or user_id % 4 = 1").selectExpr("user_id as asset_id", "case user_id % 4 when 0 then 'holdout' when 1 then 'canary' else 'seed' end as split").distinct()
    return graph.platform_metrics(textual.assets(spark, sf), gold)


@query(f"""with {textual._GRADED}, {textual._ASSETS}, f as (select asset_id, rank from assets where rank >= 3) select 'verified' as block, count(*) as n from f union all select 'assets', count(*) from assets union all select 'runs', count(*) from events""")
def reader_summary(spark, sf):
    """The map's summary for a reader, who sees published grades of B or better only."""
    assets = textual.assets(spark, sf)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("block"), "n")
    return one("verified", assets.where("rank >= 3")).union(one("assets", assets)).union(one("runs", table(spark, sf, "events")))
