"""Filters, roll-ups, joins, set operations and windows over the bound roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, joins, rollups, windows
from . import roles
from .registry import query
from .roles import ADMISSIONS, ATTENDANCE, EXAMS, FEES, STUDENTS, table

_ROLLUP = """rollup_ as (
  select a.student_id, coalesce(max(s.name), max(a.student_name)) as name, coalesce(max(a.program), max(s.program)) program,
    max(s.department) department, max(s.semester) semester, sum(coalesce(classes_held, 0)) held, sum(coalesce(classes_attended, 0)) attended,
    count(*) records,
    case when sum(coalesce(classes_held, 0)) > 0 then round(sum(coalesce(classes_attended, 0)) / sum(coalesce(classes_held, 0)) * 100, 2)
         else round(avg(attendance_percent), 2) end as percent
  from attendance a left join students s on a.student_id = s.student_id group by a.student_id)"""
_FEE_ROLLUP = """fee_rollup as (
  select f.student_id, max(s.name) as name, coalesce(max(f.program), max(s.program)) program, round(sum(coalesce(amount_due, 0)), 2) due,
    round(sum(coalesce(amount_paid, 0)), 2) paid, round(sum(coalesce(balance, coalesce(amount_due, 0) - coalesce(amount_paid, 0))), 2) balance,
    min(due_date) first_due, count(*) records
  from fees f left join students s on f.student_id = s.student_id group by f.student_id)"""
_BREAKDOWN = """breakdown as (
  select upper(coalesce(f.program, s.program)) program, academic_year, count(distinct f.student_id) students, count(*) records,
    round(sum(amount_due), 2) due, round(sum(amount_paid), 2) paid
  from fees f left join students s on f.student_id = s.student_id group by 1, 2)"""
_EXAM = """exam as (
  select course_code, exam_name, count(*) records,
    round(avg(case when max_marks > 0 and marks_obtained is not null then marks_obtained * 100 / max_marks end), 2) mean_percent,
    count(*) filter (where lower(result_status) in ('pass', 'passed', 'p')) passed,
    count(*) filter (where lower(result_status) in ('fail', 'failed', 'f', 'reappear', 'absent')) failed
  from exams group by 1, 2)"""


@query(f"with {STUDENTS}, {ATTENDANCE}, {_ROLLUP} select * from rollup_")
def attendance_rollup(spark, sf):
    return rollups.attendance_rollup(roles.attendance(spark, sf), roles.students(spark, sf))


@query(f"""with {STUDENTS}, all_attendance as (select * from (with {ATTENDANCE} select * from attendance)),
  attendance as (select a.* from all_attendance a left join students s on a.student_id = s.student_id
    where lower(coalesce(a.program, s.program)) = 'building' and lower(cast(s.semester as varchar)) = '3'), {_ROLLUP} select * from rollup_""")
def attendance_rollup_filtered(spark, sf):
    return rollups.attendance_rollup(roles.attendance(spark, sf), roles.students(spark, sf), {"program": "Building", "semester": 3})


@query(f"""with {STUDENTS}, {ATTENDANCE}, {_ROLLUP} select program, count(*) students, round(avg(percent), 2) mean_percent,
  count(*) filter (where percent < 75) below_75, count(*) filter (where percent < 65) below_65 from rollup_ group by 1""")
def attendance_summary(spark, sf):
    return rollups.attendance_summary(attendance_rollup(spark, sf))


@query(f"with {STUDENTS}, {ATTENDANCE}, {_ROLLUP} select * from rollup_ where percent < 75 order by percent, student_id limit 50")
def low_attendance_topn(spark, sf):
    return rollups.low_percent(attendance_rollup(spark, sf))


@query(f"with {STUDENTS}, {FEES}, {_FEE_ROLLUP} select * from fee_rollup")
def fee_rollup(spark, sf):
    return rollups.fee_rollup(roles.fees(spark, sf), roles.students(spark, sf))


@query(f"with {STUDENTS}, {FEES}, {_FEE_ROLLUP} select * from fee_rollup where balance > 0 order by balance desc, student_id limit 50")
def pending_fees(spark, sf):
    return rollups.pending(fee_rollup(spark, sf))


@query(f"with {STUDENTS}, {FEES}, {_BREAKDOWN} select * from breakdown")
def fee_breakdown(spark, sf):
    return rollups.fee_breakdown(roles.fees(spark, sf), roles.students(spark, sf))


@query(f"""with {STUDENTS}, {FEES}, {_BREAKDOWN} select program, academic_year, cast(grouping(program) * 2 + grouping(academic_year) as integer) as level,
  cast(sum(students) as bigint) students, cast(sum(records) as bigint) records, round(sum(due), 2) due, round(sum(paid), 2) paid,
  case when sum(due) > 0 then round(sum(paid) / sum(due) * 100, 2) end collected
  from breakdown group by grouping sets ((program), (academic_year), (program, academic_year), ())""")
def fee_summary_grouping_sets(spark, sf):
    return rollups.fee_summary(fee_breakdown(spark, sf))


@query(f"with {EXAMS}, {_EXAM} select * from exam")
def exam_rollup(spark, sf):
    return rollups.exam_rollup(roles.exams(spark, sf))


@query(f"""with {EXAMS}, {_EXAM} select course_code, cast(sum(passed) as bigint) passed, cast(sum(failed) as bigint) failed,
  case when sum(passed) + sum(failed) > 0 then round(sum(passed) / (sum(passed) + sum(failed)) * 100, 2) end pass_rate from exam group by 1""")
def exam_pass_rate(spark, sf):
    return rollups.exam_pass_rates(exam_rollup(spark, sf))


@query(f"""with {ADMISSIONS} select 'status' as dimension, coalesce(nullif(trim(lower(status)), ''), 'unknown') as value, count(*) n from admissions group by 1, 2
  union all select 'program', coalesce(nullif(trim(lower(program)), ''), 'unknown'), count(*) from admissions group by 1, 2""")
def admissions_summary(spark, sf):
    return rollups.counts_by(roles.admissions(spark, sf), ["status", "program"])


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" union all ".join(f"select '{t}' as entity, count(*) n from {t}" for t in _TABLES))
def entity_counts(spark, sf):
    return rollups.labelled_counts({t: table(spark, sf, t) for t in _TABLES})


@query(f"""with {STUDENTS}, {ATTENDANCE}, {_ROLLUP}, {FEES}, {_FEE_ROLLUP} select 'attendance' block, 'mean_percent' measure, round(avg(percent), 2) as value from rollup_
  union all select 'attendance', 'students', cast(count(*) as double) from rollup_
  union all select 'fees', 'outstanding', round(sum(case when balance > 0 then balance else 0 end), 2) from fee_rollup
  union all select 'fees', 'collected', round(sum(paid) / sum(due) * 100, 2) from fee_rollup""")
def institution_summary(spark, sf):
    a = attendance_rollup(spark, sf).agg(F.round(F.avg("percent"), 2).alias("mean_percent"), F.count("*").cast("double").alias("students"))
    f = fee_rollup(spark, sf).agg(
        F.round(F.sum(F.greatest("balance", F.lit(0.0))), 2).alias("outstanding"), F.round(F.sum("paid") / F.sum("due") * 100, 2).alias("collected")
    )
    return _measures(a, "attendance").unionByName(_measures(f, "fees"))


def _measures(df, block):
    cells = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in df.columns))
    return df.select(F.lit(block).alias("block"), F.inline(cells))


@query("select distinct upper(c_mktsegment) program from customer where trim(c_mktsegment) <> ''")
def distinct_programs(spark, sf):
    people = table(spark, sf, "customer").select(F.upper("c_mktsegment").alias("program"))
    return rollups.distinct_values(people, "program")


@query("select c_custkey, c_name from customer where lower(c_mktsegment) = 'building'")
def filter_equals_ignoring_case(spark, sf):
    return filters.where(table(spark, sf, "customer"), {"c_mktsegment": "BuildING", "c_name": ""}).select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where lower(c_name) like '%r#0_0%1'")
def filter_contains(spark, sf):
    return filters.where(table(spark, sf, "customer"), {"c_name__contains": "R#0_0%1"}).where(F.endswith("c_name", F.lit("1"))).select("c_custkey", "c_name")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')")
def filter_in(spark, sf):
    return filters.where(table(spark, sf, "orders"), {"o_orderstatus__in": ["F", "P"]}).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey from orders where 1 = 0")
def filter_in_nothing(spark, sf):
    return filters.where(table(spark, sf, "orders"), {"o_orderstatus__in": []}).select("o_orderkey")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 1000 and o_totalprice < 50000 and o_custkey <= 100")
def filter_range(spark, sf):
    wanted = {"o_totalprice__gte": 1000, "o_totalprice__lt": 50000, "o_custkey__lte": 100}
    return filters.where(table(spark, sf, "orders"), wanted).select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20 offset 40")
def ordered_page(spark, sf):
    return filters.ordered(table(spark, sf, "customer"), "-c_acctbal", "c_custkey", 20, 40).select("c_custkey", "c_acctbal")


@query("""select event_id, case when ts is null or ts > timestamp '2024-01-21' then 'unknown' when ts < timestamp '2024-01-20' - interval 7 day then 'old'
  else 'known' end as date_status from (select event_id, case when event_id % 11 <> 0 then ts end ts from events)""")
def date_window_status(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"))
    now = F.lit("2024-01-20").cast("timestamp")
    return events.select("event_id", filters.window_status(F.col("ts").cast("timestamp"), now, 7).alias("date_status"))


@query("select c_name, c_custkey from customer")
def minimized_projection(spark, sf):
    return filters.minimized(table(spark, sf, "customer"), ["c_name", "c_phone", "c_acctbal", "c_custkey"], ["c_custkey", "c_name", "c_nationkey"])


@query("select event_id, '[redacted]' as k from events where props is not null")
def redacted_properties(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.try_element_at(filters.redacted(props, ["K"]), F.lit("k")).alias("k"))


@query("""select n_nationkey, upper(n_name) as n_name from nation where n_nationkey < 15 union all
  select null, name from (select distinct upper(n_name) as name from nation join supplier on s_nationkey = n_nationkey) d
  where name not in (select upper(n_name) from nation where n_nationkey < 15)""")
def programs_with_derived(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.upper("n_name").alias("n_name"))
    used = nation.join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joins.completed(nation.where("n_nationkey < 15"), used, "n_name")


@query("""with s as (select n_nationkey, s_suppkey, s_name, 0 p from nation join supplier on s_nationkey = n_nationkey and s_acctbal > 8000
  union all select n_nationkey, s_suppkey, s_name, 1 from nation join supplier on s_nationkey = n_nationkey and s_acctbal > 0
  union all select n_nationkey, s_suppkey, s_name, 2 from nation join supplier on s_nationkey = n_nationkey)
  select n_nationkey, s_suppkey, s_name, p as priority from s where p = (select min(p) from s t where t.n_nationkey = s.n_nationkey)""")
def hod_cascade(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    both = both.select("n_nationkey", "s_suppkey", "s_name", "s_acctbal")
    tiers = [both.where("s_acctbal > 8000"), both.where("s_acctbal > 0"), both]
    return joins.first_hit([t.drop("s_acctbal") for t in tiers], "n_nationkey")


@query("""select c_custkey, c_name from customer where c_name in (select c_name from customer where c_custkey % 50 = 0)
  or c_mktsegment in (select case when c_custkey = 7 then c_mktsegment end from customer where c_custkey = 7)""")
def semi_lookup_people(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    probes = people.where("c_custkey % 50 = 0 or c_custkey = 7").select(
        F.when(F.col("c_custkey") % 50 == 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") == 7, F.col("c_mktsegment")).alias("c_mktsegment")
    )
    return joins.matches_any(people, probes, ["c_name", "c_mktsegment"], "c_custkey").select("c_custkey", "c_name")


@query("""with recursive e as (select c_custkey // 3 parent, c_custkey child from customer where c_custkey > 0),
  w(node, hops) as (select 1, 0 union all select child, hops + 1 from w join e on parent = node where hops < 2)
  select cast(node as bigint) node, min(hops) hops from w group by 1""")
def two_hop_leads(spark, sf):
    edges = table(spark, sf, "customer").where("c_custkey > 0").selectExpr("c_custkey div 3 as parent", "c_custkey as child")
    return joins.within_hops(edges, spark.range(1, 2).select(F.col("id").alias("node")), 2)


@query("""with recursive p as (select c_custkey node, c_custkey // 4 parent from customer where c_custkey // 4 > 0),
  w(node, ancestor, distance) as (select node, parent, 1 from p union all select w.node, p.parent, distance + 1 from w join p on w.ancestor = p.node where distance < 4)
  select node, ancestor, distance from w""")
def ancestor_chain(spark, sf):
    parents = table(spark, sf, "customer").selectExpr("c_custkey as node", "nullif(c_custkey div 4, 0) as parent")
    return joins.ancestors(parents, 4)


@query("""with recursive p as (select c_custkey node, case when c_custkey % 100 < 90 then nullif(c_custkey - c_custkey % 100 + c_custkey % 100 // 2, c_custkey) else c_custkey - 1 end parent from customer where c_custkey % 100 > 0),
  w(node, ancestor, distance) as (select node, parent, 1 from p union all select w.node, p.parent, distance + 1 from w join p on w.ancestor = p.node)
  select node, ancestor, distance from w where ancestor is not null""")
def ancestor_closure(spark, sf):
    """All ancestors at any depth: a tree in each hundred customers, with a chain at its end."""
    parent = "case when c_custkey % 100 < 90 then nullif(c_custkey - c_custkey % 100 + c_custkey % 100 div 2, c_custkey) else c_custkey - 1 end as parent"
    return joins.ancestry(table(spark, sf, "customer").where("c_custkey % 100 > 0").selectExpr("c_custkey as node", parent))


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n = 1""")
def latest_per_key(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return windows.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""select event_id, round(v - last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 6) as change
  from (select event_id, user_id, ts, case when event_id % 5 <> 0 then value end v from events)""")
def run_series_delta(spark, sf):
    runs = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return windows.series_change(runs, ["user_id"], ["ts", "event_id"], "v").select("event_id", F.round("change", 6).alias("change"))


@query("""select event_id, cast(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) island from events""")
def event_islands(spark, sf):
    return windows.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "island")


@query("""with m as (select user_id, ts, value < 30 failed from events), s as (select user_id, max(case when not failed then ts end) ok from m group by 1)
  select m.user_id, count(*) failures, min(ts) first_failure, max(ts) last_failure, max(ts) - min(ts) >= interval 24 hour as dead
  from m join s on m.user_id = s.user_id where failed and (ok is null or ts > ok) group by 1""")
def failure_runs(spark, sf):
    return windows.failure_runs(table(spark, sf, "events").select("user_id", "ts", "value"), "user_id", "ts", F.col("value") < 30)


@query("""select 'place' as "column", true as serial union all select 'l_linenumber', bool_and(l_linenumber = n) from (
  select l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) n from lineitem)""")
def serial_columns(spark, sf):
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").select("l_orderkey", *order)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    return windows.serial_columns(rows, ["l_orderkey"], "place", ["place", "l_linenumber"])


@query("""select event_id, round(running, 4) running from (select event_id, sum(value) over (partition by user_id order by ts, event_id) running from events) where running <= 500""")
def admitted_by_budget(spark, sf):
    got = windows.admitted(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 500)
    return got.select("event_id", F.round("running", 4).alias("running"))


@query("""select o_custkey, o_orderkey, n as "rank" from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) where n <= 3""")
def top_per_customer(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_per(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).drop("o_totalprice")


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, sf):
    return _nations(spark, sf, "customer", "c").union(_nations(spark, sf, "supplier", "s")).distinct()


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark, sf):
    return _nations(spark, sf, "customer", "c").intersect(_nations(spark, sf, "supplier", "s"))


@query("select n_nationkey as k from nation except select s_nationkey from supplier where s_suppkey < 20")
def set_except(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(
        _nations(spark, sf, "supplier", "s", "s_suppkey < 20"))


def _nations(spark, sf, name, prefix, condition="true"):
    return table(spark, sf, name).where(condition).select(F.col(f"{prefix}_nationkey").alias("k"))


@query("""select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders group by rollup (o_orderstatus, o_orderpriority)""")
def order_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), rollups.money("o_totalprice").alias("total"))


@query("""select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) quantity from lineitem group by cube (l_returnflag, l_linestatus)""")
def lineitem_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), rollups.money("l_quantity").alias("quantity"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events""")
def json_properties(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
