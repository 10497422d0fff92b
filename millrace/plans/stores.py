"""Stored tables and the evidence graph: merges, updates, retention, grades; roles are made from the driver's tables by the same SQL on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, stores
from .registry import query
from .roles import table

_EVIDENCE = """select event_id as evidence_id, user_id as asset_id, case event_id % 16 when 0 then 'official_link' when 1 then 'hub_link' when 2 then 'subdomain' when 3 then 'backlink' when 4 then 'configured_domain'
  when 5 then 'directory_record' when 6 then 'community_record' when 7 then 'reviewer_confirm' when 8 then 'search_snippet' when 9 then 'imported_claim' when 10 then 'owner_claim' when 11 then 'api_identity'
  when 12 then 'anchor_lost' when 13 then 'source_refuted' when 14 then case when value > 80 then 'reviewer_reject' else 'identity_changed' end else 'integrity' end as kind,
  event_type as channel, case when event_id % 16 in (12, 13) or (value < 30 and event_id % 16 not in (7, 9)) or (event_id % 16 = 14) then 'refutes' else 'supports' end as polarity,
  case when event_id % 16 = 10 then 'owner' when event_id % 16 = 7 then 'reviewer' when event_id % 3 = 0 then 'archive' else 'live' end as observed_via,
  case when event_id % 16 = 15 then case when value < 4 then 'hijacked: x' when value < 8 then 'parked: y' else 'clean' end when event_id % 5 = 0 then 'O:footer' when event_id % 5 = 1 then 'A:header' when event_id % 5 = 2 then 'B:body'
    when event_id % 5 = 3 then 'authority:list' else 'C:body' end as detail,
  concat('page', cast(user_id % 3 + event_id % 2 as varchar(9))) as source_url, case when event_id % 16 in (0, 1, 2, 3, 12, 13) then (user_id + event_id % 3) % 40 end as source_asset_id, ts as observed_at from events"""


def evidence(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("_events_of_evidence")
    return spark.sql(_EVIDENCE.replace("from events", "from _events_of_evidence"))


_FULL = f"""e as ({_EVIDENCE}),
  m as (select *, max(case when polarity = 'refutes' and kind = 'source_refuted' then observed_at end) over s as sref, max(case when polarity = 'refutes' and kind = 'configured_domain' then observed_at end) over a as cref,
    max(case when kind = 'configured_domain' then observed_at end) over a as clast, max(case when polarity = 'refutes' and kind = 'identity_changed' then observed_at end) over a as moved,
    max(case when polarity = 'refutes' and kind = 'official_link' then observed_at end) over u as gone, max(case when polarity = 'refutes' and kind = 'anchor_lost' then observed_at end) over s as lost,
    max(case when polarity = 'refutes' and kind = 'owner_claim' then observed_at end) over c as back,
    max(case when polarity = 'refutes' and (kind in ('reviewer_reject', 'lookalike', 'impersonation') or kind = 'integrity' and regexp_matches(detail, '^(hijacked|parked)')) then observed_at end) over a as rejected,
    max(case when polarity = 'supports' and kind = 'reviewer_confirm' and observed_via = 'reviewer' then observed_at end) over a as confirmed
    from e window a as (partition by asset_id), s as (partition by asset_id, source_asset_id), u as (partition by asset_id, source_url), c as (partition by asset_id, channel)),
  t as (select *, polarity = 'supports' and not (sref is not null and source_asset_id is not null and kind in ('official_link', 'hub_link', 'subdomain', 'backlink')) and not (kind = 'configured_domain' and coalesce(cref >= clast, false))
    and coalesce(observed_at > moved, true) and not (kind = 'official_link' and coalesce(gone > observed_at, false)) as stands, source_asset_id is not null and coalesce(lost > observed_at, false) as stale, split_part(detail, ':', 1) as f from m),
  g as (select *, case when stale and kind = 'official_link' and observed_via = 'live' then 'archive' else observed_via end as via,
    case f when 'O' then 'A' when 'A' then 'B' else 'C' end as down from t),
  r as (select *, case when not stands then null when stale and kind in ('hub_link', 'subdomain') then 2 when kind = 'owner_claim' and via = 'owner' and not coalesce(back >= observed_at, false) then 6
      when kind = 'official_link' and via = 'live' then case when f in ('O', 'A') then 5 when f = 'B' then 3 else 2 end when kind = 'official_link' and via = 'archive' then case when f in ('O', 'A', 'A-arch') then 4 else 2 end
      when kind = 'official_link' then 2 when kind = 'configured_domain' then 5 when kind = 'hub_link' or (kind = 'subdomain' and via = 'live') then case down when 'A' then 5 when 'B' then 3 else 2 end
      when kind = 'directory_record' then case when f = 'authority' then 5 else 3 end when kind = 'reviewer_confirm' then 3 when kind in ('api_identity', 'search_snippet', 'backlink', 'community_record', 'imported_claim') then 2 end as rk,
    case when stands and kind in ('search_snippet', 'directory_record', 'community_record', 'hub_link', 'reviewer_confirm', 'backlink', 'api_identity') and not (stale and kind in ('hub_link', 'subdomain'))
      then case when kind = 'community_record' then 'community' else channel end end as ch from g),
  own as (select asset_id as src, list(distinct case when kind = 'community_record' then 'community' else channel end) as oc from e
    where polarity = 'supports' and kind in ('search_snippet', 'directory_record', 'community_record', 'hub_link', 'reviewer_confirm', 'backlink', 'api_identity') group by 1),
  sums as (select asset_id, max(rk) as best, list(distinct ch) filter (where ch is not null) as every, coalesce(max(rejected) >= coalesce(max(confirmed), timestamp '0001-01-01'), false) as dn from r group by 1),
  hub as (select distinct asset_id, ch, source_asset_id as src from r where ch is not null and kind in ('hub_link', 'backlink') and source_asset_id is not null),
  drops as (select asset_id, count(*) as fewer from (select h.asset_id, h.ch, bool_and(oc is not null and coalesce(len(list_filter(oc, lambda x: not list_contains(list_filter(every, lambda y: y <> h.ch), x))) = 0, false)) as leans
    from hub h left join own using (src) join sums on h.asset_id = sums.asset_id group by 1, 2) where leans group by 1),
  n as (select s.*, coalesce(len(every), 0) - coalesce(fewer, 0) as n from sums s left join drops using (asset_id)),
  graded as (select asset_id, case when dn then 0 else greatest(coalesce(best, 1), case when n >= 2 then 3 else 1 end) end as rank, n as channels from n)"""


@query(f"with {_FULL} select asset_id, rank, case rank when 6 then 'O' when 5 then 'A' when 4 then 'A-arch' when 3 then 'B' when 2 then 'C' when 1 then 'unrated' else 'D' end as grade, channels from graded")
def full_grades(spark, sf):
    return graph.full_grades(evidence(spark, sf)).drop("reason")


_OLD = "before as (select user_id as asset_id, cast(user_id % 7 as integer) as rank from events where user_id % 5 > 0 group by 1, 2)"


@query(f"""with {_FULL}, {_OLD} select g.asset_id, b.rank as old, g.rank as new, case when g.rank = 0 or b.rank is null then g.rank else b.rank end as published, g.rank <> 0 and b.rank is not null as held
  from graded g left join before b using (asset_id) where g.rank is distinct from b.rank""")
def held_grades(spark, sf):
    before = table(spark, sf, "events").where("user_id % 5 > 0").selectExpr("user_id as asset_id", "cast(user_id % 7 as int) as rank").distinct()
    return stores.held_grades(before, full_grades(spark, sf))


@query(f"with e as ({_EVIDENCE}) select asset_id as source_asset_id, len(list(distinct case when kind = 'community_record' then 'community' else channel end)) as n from e where polarity = 'supports' and kind in ('search_snippet', 'directory_record', 'community_record', 'hub_link', 'reviewer_confirm', 'backlink', 'api_identity') group by 1")
def source_channels(spark, sf):
    return graph.found_by(evidence(spark, sf)).select("source_asset_id", F.size("own_channels").cast("long").alias("n"))


@query("""with c as (select c_custkey, case c_custkey % 3 when 0 then 'c_acctbal' when 1 then 'c_mktsegment' else 'c_name' end as field, case c_custkey % 3 when 0 then cast(c_custkey as varchar) else 'NEW' end as value from customer where c_custkey % 2 = 0)
  select c_custkey, c_name, case when field = 'c_acctbal' then cast(value as double) else c_acctbal end as c_acctbal, case when field = 'c_mktsegment' then value else c_mktsegment end as c_mktsegment, case when field = 'c_mktsegment' then c_mktsegment end as old_segment
  from customer left join c using (c_custkey)""")
def field_updates(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changes = rows.where("c_custkey % 2 = 0").selectExpr(
        "c_custkey", "case c_custkey % 3 when 0 then 'c_acctbal' when 1 then 'c_mktsegment' else 'c_name' end as field", "case c_custkey % 3 when 0 then cast(c_custkey as string) else 'NEW' end as value", "1 as at")
    changes = changes.union(changes.selectExpr("c_custkey", "field", "'earlier'", "0"))
    done = stores.updated_fields(rows, changes, "c_custkey", ["c_acctbal", "c_mktsegment"])
    return done.select(*rows.columns, F.try_element_at("before", F.lit("c_mktsegment")).alias("old_segment"))


@query("""select o_orderkey, o_custkey, o_totalprice from orders where o_custkey % 10 > 0 union all select o_orderkey + 1000000000, o_custkey, 1.0 from orders where o_custkey % 10 = 0""")
def replaced_records(spark, sf):
    stored = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = stored.where("o_custkey % 10 = 0").selectExpr("o_orderkey + 1000000000 as o_orderkey", "o_custkey", "1.0D as o_totalprice")
    return stores.replaced_partition(stored, rows, "o_custkey")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 50 = 0) and l_suppkey not in (select s_suppkey from supplier where s_suppkey % 10 = 0)")
def forgotten_assets(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = stores.without_matches(rows, table(spark, sf, "orders").where("o_custkey % 50 = 0"), ("l_orderkey", "o_orderkey"))
    return stores.without_matches(rows, table(spark, sf, "supplier").where("s_suppkey % 10 = 0"), ("l_suppkey", "s_suppkey"))




@query("""with r as (select c_custkey, case c_custkey % 3 when 0 then ['a', 'b'] when 1 then ['b'] else [] end || [c_mktsegment, 'a', 'b'] as l from customer)
  select c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as names, case when c_custkey % 4 = 0 then c_name else c_mktsegment end as note from r join (select c_custkey, c_name, c_mktsegment from customer) using (c_custkey)""")
def merged_entities(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "case c_custkey % 3 when 0 then array('a', 'b') when 1 then array('b') end as old_names", "array(c_mktsegment, 'a', 'b') as new_names", "case when c_custkey % 4 = 0 then ' ' else c_mktsegment end as note")
    c = F.col
    return rows.select("c_custkey", F.array_join(stores.merged_lists(c("old_names"), c("new_names")), "|").alias("names"), stores.filled(c("note"), c("c_name")).alias("note"))


_INCIDENTS = """stored as (select user_id as fingerprint, cast(user_id % 3 as integer) as severity, case when user_id % 4 = 0 then 'resolved' else 'open' end as status, count(*) as times_seen from events where user_id % 2 = 0 group by 1, 2, 3),
  seen as (select user_id as fingerprint, cast(max(event_id) % 3 as integer) as severity from events group by 1)"""


@query(f"""with {_INCIDENTS} select s.fingerprint, case when o.status is null then 'new' when o.status = 'resolved' then 'reopened' when s.severity > o.severity then 'escalated' else 'repeat' end as verdict,
  greatest(s.severity, coalesce(o.severity, 0)) as severity, case when o.status is null or o.status = 'resolved' or s.severity > o.severity then 'open' else o.status end as status, coalesce(o.times_seen, 0) + 1 as times_seen,
  o.status is null or o.status = 'resolved' or s.severity > o.severity as notify from seen s left join stored o using (fingerprint)""")
def incident_verdicts(spark, sf):
    e = table(spark, sf, "events")
    stored = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("fingerprint")).agg(F.count("*").alias("times_seen")).selectExpr(
        "fingerprint", "cast(fingerprint % 3 as int) as severity", "case when fingerprint % 4 = 0 then 'resolved' else 'open' end as status", "times_seen")
    seen = e.groupBy(F.col("user_id").alias("fingerprint")).agg((F.max("event_id") % 3).cast("int").alias("severity"))
    return stores.incident_verdicts(stored, seen)


_PAGES = """stored as (select page_id as url, cast(page_id % 3 as varchar) as sha, page_id % 2 = 0 as extracted, case when page_id % 5 = 0 then 'excluded' else 'kept' end as status, page_id % 5 > 0 or page_id % 15 = 0 as first_kept from pages where page_id % 7 > 0),
  seen as (select page_id as url, cast(page_id % 4 as varchar) as sha, page_id % 3 > 0 as extracted, case when page_id % 4 = 1 then 'excluded' else 'kept' end as status, case when page_id % 8 = 1 then 'outside_time_window' when page_id % 4 = 1 then 'not_matched' end as reason from pages)"""


@query(f"""with {_PAGES}, j as (select n.*, o.status is not null as known, o.sha osha, o.extracted oex, o.status ost, o.first_kept ofk, coalesce(o.extracted and not n.extracted, false) as poorer from seen n left join stored o using (url)),
  s as (select *, case when poorer then ost else status end as st0 from j), t as (select *, case when known and ost = 'kept' and st0 = 'excluded' and coalesce(case when poorer then null else reason end = 'outside_time_window', false) then 'kept' else st0 end as st from s)
  select url, case when not known then 'new' when st = 'kept' and ost <> 'kept' and not coalesce(ofk, false) then 'new' when oex = extracted and osha <> sha then 'changed' else 'duplicate' end as verdict, case when poorer then osha else sha end as sha, st as status,
  poorer or extracted as extracted from t""")
def document_merge(spark, sf):
    p = table(spark, sf, "pages")
    stored = p.where("page_id % 7 > 0").selectExpr("page_id as url", "cast(page_id % 3 as string) as sha", "page_id % 2 = 0 as extracted", "case when page_id % 5 = 0 then 'excluded' else 'kept' end as status", "page_id % 5 > 0 or page_id % 15 = 0 as first_kept")
    seen = p.selectExpr("page_id as url", "cast(page_id % 4 as string) as sha", "page_id % 3 > 0 as extracted", "case when page_id % 4 = 1 then 'excluded' else 'kept' end as status",
                        "case when page_id % 8 = 1 then 'outside_time_window' when page_id % 4 = 1 then 'not_matched' end as reason")
    return stores.document_verdicts(stored, seen)


@query("""with p as (select distinct lower(event_type) || '|' || cast(user_id as varchar) as k, event_type, user_id from events), o as (select distinct sha256(lower(event_type) || '|' || cast(user_id as varchar)) as f from events where event_id % 3 = 0)
  select sha256(k) as fingerprint, event_type, user_id from p where sha256(k) not in (select f from o)""")
def new_review_items(spark, sf):
    e = table(spark, sf, "events")
    known = e.where("event_id % 3 = 0").select(F.sha2(F.concat_ws("|", F.lower("event_type"), F.col("user_id").cast("string")), 256).alias("fingerprint")).distinct()
    return stores.review_items(known, e, ["event_type", "user_id"])


_SOURCES = "sources as (select c_custkey as source_id, c_nationkey as target, case c_custkey % 3 when 0 then 'seed' when 1 then 'rotation' else 'gap' end as work_class, case when c_custkey % 11 = 0 then 'paused' else 'active' end as status, case when c_custkey % 3 = 2 then 'gap' else '' end as topic, cast(3600 * (c_custkey % 9 + 1) as bigint) as \"interval\", c_acctbal as priority, cast(c_custkey % 5 as integer) as hops, timestamp '2024-01-01' + interval '1 hour' * (c_custkey % 50) as due from customer)"


def sources(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as source_id", "c_nationkey as target", "case c_custkey % 3 when 0 then 'seed' when 1 then 'rotation' else 'gap' end as work_class", "case when c_custkey % 11 = 0 then 'paused' else 'active' end as status",
        "case when c_custkey % 3 = 2 then 'gap' else '' end as topic", "cast(3600 * (c_custkey % 9 + 1) as bigint) as interval", "c_acctbal as priority", "cast(c_custkey % 5 as int) as hops", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey % 50 as int)) as due",
    )


@query(f"""with {_SOURCES}, g as (select distinct n_nationkey as target from nation where n_nationkey % 4 = 0)
  select source_id, case when target in (select target from g) and status = 'active' then 'gap' when topic = 'gap' then '' else topic end as topic, case when target in (select target from g) and status = 'active' then least("interval", 7200) else "interval" end as "interval",
  case when target in (select target from g) and status = 'active' then least(due, timestamp '2024-01-01 10:00:00' + interval '2 hours') else due end as due from sources""")
def gap_sources(spark, sf):
    gaps = table(spark, sf, "nation").where("n_nationkey % 4 = 0").selectExpr("n_nationkey as target")
    return stores.gap_sources(sources(spark, sf), gaps, "target", F.lit("2024-01-01 10:00:00").cast("timestamp"), 7200).select("source_id", "topic", "interval", "due")


@query(f"""with {_SOURCES}, f as (select s_suppkey * 7 as source_id, cast(s_suppkey % 4 as integer) as hops, timestamp '2024-02-01' as due from supplier)
  select coalesce(s.source_id, f.source_id) as source_id, case when s.hops is null then f.hops when f.hops is null then s.hops else least(s.hops, f.hops) end as hops, coalesce(s.due, f.due) as due, s.due is null as added from sources s full outer join f on s.source_id = f.source_id""")
def scheduled_sources(spark, sf):
    found = table(spark, sf, "supplier").selectExpr("s_suppkey * 7 as source_id", "cast(s_suppkey % 4 as int) as hops", "timestamp'2024-02-01 00:00:00' as due")
    return stores.schedule_sources(sources(spark, sf).select("source_id", "hops", "due"), found, ["source_id"])


@query(f"""with {_SOURCES}, r as (select *, row_number() over (partition by work_class order by priority desc, due, source_id) as place from sources where due <= timestamp '2024-01-02 06:00:00' and status = 'active')
  select source_id, work_class, place from r where place <= case work_class when 'seed' then 5 when 'rotation' then 20 else 0 end""")
def work_claims(spark, sf):
    return stores.work_claims(sources(spark, sf), {"seed": 5, "rotation": 20}, F.lit("2024-01-02 06:00:00").cast("timestamp")).select("source_id", "work_class", "place")


@query(f"""with {_SOURCES} select source_id, round(priority * 0.7 + least(source_id % 9, 5) * 0.3, 6) as priority, case when source_id % 4 = 0 then hops + 1 else 0 end as failure_streak,
  cast(least(86400, case when source_id % 4 = 0 then "interval" * power(2, least(hops + 1, 10)) when source_id % 9 > 0 then greatest("interval" / 2, "interval" / 8) else "interval" * 1.5 end) as bigint) as next from sources""")
def completed_sources(spark, sf):
    rows = sources(spark, sf)
    done = stores.completed_source(F.col("source_id") % 9, F.col("priority"), F.col("hops"), F.col("source_id") % 4 == 0)
    rows = rows.withColumns(done)
    following = stores.adapted_interval(F.col("interval"), F.col("interval"), F.col("source_id") % 9, F.col("failure_streak"), 86400)
    return rows.select("source_id", "priority", "failure_streak", following.alias("next"))


@query("""with b as (select max(ts) m from events where event_type = 'signup') select event_id, case when ts < timestamp '2024-01-15' then '[expired]' else props end as props from events, b where ts >= timestamp '2024-01-15' or (event_type = 'signup' and ts = m)""")
def retention(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts", "props")
    return stores.retained(rows, "ts", F.lit("2024-01-15").cast("timestamp"), ["props"], F.col("event_type") == "signup").select("event_id", "props")


@query("""select event_id, user_id, turn from (select event_id, user_id, row_number() over (partition by user_id order by value desc, event_id) as turn from events) order by turn, user_id limit 200""")
def fair_candidates(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", (-F.col("value")).alias("worse"))
    return stores.fair_share(rows, "user_id", ["worse", "event_id"], 200).select("event_id", "user_id", "turn")


@query("""with r as (select user_id, case when value > 60 then 1 else 0 end as found, row_number() over (partition by user_id order by event_id desc) as n from events) select user_id, count(*) = 2 and sum(found) = 0 as pause from r where n <= 2 group by 1""")
def empty_passes(spark, sf):
    runs = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("value") > 60, 1).otherwise(0).alias("found"))
    return stores.empty_passes(runs, "user_id", "event_id", "found")


@query("""with l as (select *, max(case when event_type = 'purchase' then event_id end) over (partition by user_id) as last from events) select user_id, count(*) as incidents, count(*) filter (where value > 80) as high, round(sum(value), 4) as total from l where last is null or event_id > last group by 1""")
def incident_digest(spark, sf):
    """What happened to each user after the last success, as the daily digest counts it."""
    open_ = stores.since_last(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase")
    return open_.groupBy("user_id").agg(F.count("*").alias("incidents"), F.count_if(F.col("value") > 80).alias("high"), F.round(F.sum("value"), 4).alias("total"))


@query("""select event_type as connector, count(*) as runs, count(*) filter (where value > 50) as found, round(sum(value), 4) as cost, round(count(*) filter (where value > 50) / count(*), 4) as ratio from events group by 1""")
def source_yields(spark, sf):
    runs = table(spark, sf, "events").groupBy(F.col("event_type").alias("connector"))
    hits = F.count_if(F.col("value") > 50)
    return runs.agg(F.count("*").alias("runs"), hits.alias("found"), F.round(F.sum("value"), 4).alias("cost"), F.round(hits / F.count("*"), 4).alias("ratio"))


@query("select event_type as connector, cast(ts as date) as day, count(*) as calls, round(sum(value), 4) as units from events group by 1, 2")
def daily_spend(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("connector"), F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("units"))


@query("select o_orderpriority as kind, count(*) as open_items from orders where o_orderstatus = 'O' group by 1")
def review_counts(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("open_items"))


@query(f"""with {_FULL}, p as (select asset_id % 12 as entity_id, asset_id % 4 as platform, max(rank) as rank from graded group by 1, 2)
  select e.entity_id, q.platform, p.rank, coalesce(p.rank >= 3, false) as covered from (select distinct entity_id from p) e cross join (select distinct platform from p) q left join p on p.entity_id = e.entity_id and p.platform = q.platform""")
def gap_grid(spark, sf):
    """Entities by platforms (both are few: the map's own lists) with the best grade of each cell."""
    best = full_grades(spark, sf).groupBy((F.col("asset_id") % 12).alias("entity_id"), (F.col("asset_id") % 4).alias("platform")).agg(F.max("rank").alias("rank"))
    cells = best.select("entity_id").distinct().crossJoin(best.select("platform").distinct())
    return cells.join(best, ["entity_id", "platform"], "left").withColumn("covered", F.coalesce(F.col("rank") >= 3, F.lit(False)))


@query(f"""with {_FULL}, x as (select asset_id, asset_id % 12 as entity_id, rank from graded where rank >= 2) select asset_id, replace(replace(coalesce(n_name, ''), chr(9), ' '), chr(10), ' ') as entity, rank from x left join nation on n_nationkey = entity_id""")
def exported_assets(spark, sf):
    """Assets of grade C or better with their entity's name, tabs and line ends scrubbed."""
    rows = full_grades(spark, sf).where("rank >= 2").select("asset_id", (F.col("asset_id") % 12).alias("entity_id"), "rank")
    names = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = rows.join(names, F.col("entity_id") == F.col("n_nationkey"), "left")
    return joined.select("asset_id", F.translate(F.coalesce("n_name", F.lit("")), "\t\n", "  ").alias("entity"), "rank")


@query("""select distinct 'k' || cast(user_id % 97 as varchar) as tenant from events union select distinct 'k' || cast(o_custkey % 97 as varchar) from orders""")
def known_tenants(spark, sf):
    one = lambda name, c: table(spark, sf, name).select(F.concat(F.lit("k"), (F.col(c) % 97).cast("string")).alias("tenant")).distinct()
    return one("events", "user_id").union(one("orders", "o_custkey")).distinct()


@query("select sha256(cast(event_id as varchar)) as k, value from events where ts + interval '7 days' > timestamp '2024-01-20'")
def cache_entries(spark, sf):
    """Entries of a cache of seven days that are not out of date, by hashed key."""
    rows = table(spark, sf, "events").withColumn("expires_at", F.col("ts") + F.expr("interval 7 days"))
    return rows.where(F.col("expires_at") > F.lit("2024-01-20").cast("timestamp")).select(F.sha2(F.col("event_id").cast("string"), 256).alias("k"), "value")


@query("""select user_id as domain, coalesce(max(case when event_type = 'signup' then ts end) > max(case when event_type = 'error' then ts end), max(case when event_type = 'signup' then ts end) is not null) as nominated from events group by 1""")
def nominated_domains(spark, sf):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("domain")).agg(last("signup").alias("a"), last("error").alias("b"))
    return rows.select("domain", F.coalesce(F.col("a") > F.col("b"), F.col("a").isNotNull()).alias("nominated"))


@query("""with f as (select user_id as feed, max(cast(ts as date)) as latest from events group by 1) select feed, latest, date_diff('day', latest, date '2024-02-15') > 30 as dormant from f""")
def feed_states(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("feed")).agg(F.max(F.to_date("ts")).alias("latest"))
    return rows.withColumn("dormant", F.date_diff(F.lit("2024-02-15").cast("date"), F.col("latest")) > 30)


@query("""with have as (select distinct user_id % 25 as entity, event_type as platform from events where value > 99), every as (select n_nationkey as entity, t as platform from nation, (select distinct event_type as t from events))
  select cast(entity as bigint) as entity, platform from every where (entity, platform) not in (select entity, platform from have)""")
def search_plan(spark, sf):
    """Entities and platforms (the map's own short lists) between which no target is known."""
    events = table(spark, sf, "events")
    have = events.where("value > 99").select((F.col("user_id") % 25).alias("entity"), F.col("event_type").alias("platform")).distinct()
    every = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity")).crossJoin(events.select(F.col("event_type").alias("platform")).distinct())
    return every.join(have, ["entity", "platform"], "left_anti")


_WORDS = "words as (select event_id, user_id as page, cast(event_id % 7 as integer) as block, cast(event_id % 3 as integer) as line, event_type as word, value as conf from events)"


@query(f"""with {_WORDS}, l as (select page, block, line, string_agg(word, ' ' order by event_id) as text, avg(conf) as conf from words group by 1, 2, 3) select page, count(*) as lines, round(avg(conf), 6) as confidence, min(text) as first_text from l group by 1""")
def ocr_lines(spark, sf):
    """Words of recognised pages as lines, and each page's mean of the lines' mean confidence."""
    words = table(spark, sf, "events").selectExpr("event_id", "user_id as page", "event_id % 7 as block", "event_id % 3 as line", "event_type as word", "value as conf")
    lines = words.groupBy("page", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "word"))), lambda x: x["word"]), " ").alias("text"), F.avg("conf").alias("conf"))
    return lines.groupBy("page").agg(F.count("*").alias("lines"), F.round(F.avg("conf"), 6).alias("confidence"), F.min("text").alias("first_text"))


@query("""with c as (select user_id as t, event_id % 20 as r, case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as col, event_type as v, event_id from events)
  select t, r, max_by(v, event_id) filter (where col = 'a') as a, max_by(v, event_id) filter (where col = 'b') as b, max_by(v, event_id) filter (where col = 'c') as c from c group by 1, 2""")
def cell_grid(spark, sf):
    """Cells of recognised tables as rows of columns; of several words in a cell the last."""
    cells = table(spark, sf, "events").selectExpr("user_id as t", "event_id % 20 as r", "element_at(array('a', 'b', 'c'), cast(event_id % 3 as int) + 1) as col", "event_type as v", "event_id")
    one = cells.groupBy("t", "r", "col").agg(F.max_by("v", "event_id").alias("v"))
    return one.groupBy("t", "r").pivot("col", ["a", "b", "c"]).agg(F.first("v"))


@query("""with o as (select o_custkey, o_orderpriority, count(*) n from orders group by 1, 2) select o_custkey, string_agg(o_orderpriority || ':' || cast(n as varchar), ',' order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, n desc, o_orderpriority) as ranked from o group by 1""")
def severity_order(spark, sf):
    """Each customer's priorities with the urgent first, by a rank given to their names."""
    rows = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    listed = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), (-F.col("n")).alias("less"), "o_orderpriority", "n"))).alias("x"))  # priorities are few
    return listed.select("o_custkey", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["o_orderpriority"], x["n"].cast("string"))), ",").alias("ranked"))


@query("""select event_id, row_number() over (order by coalesce(case when event_id % 3 > 0 then ts end, ts - interval '10 days') desc, event_id) as place from events order by place limit 100""")
def newest_first(spark, sf):
    """The hundred newest by the time of publication, or where that is missing the time last seen."""
    at = F.coalesce(F.when(F.col("event_id") % 3 > 0, F.col("ts")), F.col("ts") - F.expr("interval 10 days"))
    rows = table(spark, sf, "events").select("event_id", at.alias("at")).orderBy(F.desc("at"), "event_id").limit(100)
    from pyspark.sql import Window

    return rows.select("event_id", F.row_number().over(Window.orderBy(F.desc("at"), "event_id")).alias("place"))  # a hundred rows
