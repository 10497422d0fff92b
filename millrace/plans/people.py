"""Counts, lists and summaries of people's records, what a reader may see, and decisions on uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import filters, review, rollups
from . import relational, roles
from .registry import query
from .roles import ADMISSIONS, ATTENDANCE, EXAMS, FEES, STUDENTS, table

_ROLLUP, _FEE = relational._ROLLUP, relational._FEE_ROLLUP


@query("select o_orderstatus, count(*) as n from orders where lower(o_orderpriority) = '1-urgent' and o_totalprice >= 1000 group by 1")
def counted_records(spark, sf):
    rows = filters.where(table(spark, sf, "orders"), {"o_orderpriority": "1-Urgent", "o_totalprice__gte": 1000})
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("with v as (select distinct trim(c_name) as value from customer where trim(c_name) <> '' order by 1 limit 200) select value, row_number() over (order by value) as place from v")
def sorted_values(spark, sf):
    """The first 200 distinct values of a column, sorted."""
    from pyspark.sql import Window

    rows = table(spark, sf, "customer").select(F.trim("c_name").alias("value")).where("value <> ''").distinct().orderBy("value").limit(200)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("value")))  # 200 rows


@query("""with v as (select upper(c_mktsegment) as p from customer union select upper(n_name) from nation union select cast(s_suppkey as varchar) from supplier) select distinct p as program from v where p <> '' and not regexp_matches(p, '^-?\\d+(\\.\\d+)?%?$')""")
def known_programs(spark, sf):
    """Programmes of several tables, in capitals; bare numbers come from columns that were taken for programmes."""
    one = lambda name, c: table(spark, sf, name).select(F.upper(F.col(c).cast("string")).alias("program")).distinct()
    every = one("customer", "c_mktsegment").union(one("nation", "n_name")).union(one("supplier", "s_suppkey")).distinct()
    return every.where((F.col("program") != "") & ~clean.numeric_label(F.col("program")))


@query(f"with {STUDENTS}, {ATTENDANCE}, {_ROLLUP} select count(*) as evaluated, count(*) filter (where percent < 75) as below, count(*) filter (where percent is null) as unknown from rollup_")
def low_attendance_counts(spark, sf):
    rollup = relational.attendance_rollup(spark, sf)
    return rollup.agg(F.count("*").alias("evaluated"), F.count_if(F.col("percent") < 75).alias("below"), F.count_if(F.col("percent").isNull()).alias("unknown"))


@query(f"with {STUDENTS}, {FEES}, {_FEE} select count(*) as evaluated, count(*) filter (where balance > 0) as owing, round(sum(case when balance > 0 then balance else 0 end), 2) as outstanding, round(sum(due), 2) as due, round(sum(paid), 2) as paid, round(round(sum(paid), 2) / round(sum(due), 2) * 100, 2) as collected from fee_rollup")
def fee_totals(spark, sf):
    """What is owed, paid and outstanding in all; only positive balances are outstanding."""
    rollup = relational.fee_rollup(spark, sf)
    owed = F.when(F.col("balance") > 0, F.col("balance")).otherwise(0.0)
    due, paid = F.round(F.sum("due"), 2), F.round(F.sum("paid"), 2)
    return rollup.agg(F.count("*").alias("evaluated"), F.count_if(F.col("balance") > 0).alias("owing"), F.round(F.sum(owed), 2).alias("outstanding"), due.alias("due"), paid.alias("paid"), F.round(paid / due * 100, 2).alias("collected"))


@query(f"""with {STUDENTS}, {ATTENDANCE}, {_ROLLUP}, {FEES}, {_FEE}, {ADMISSIONS} select 'attendance' as block, 'mean_percent' as measure, round(avg(percent), 2) as value from rollup_ union all select 'fees', 'outstanding', round(sum(case when balance > 0 then balance else 0 end), 2) from fee_rollup
  union all select 'admissions', coalesce(nullif(trim(lower(status)), ''), 'unknown'), cast(count(*) as double) from admissions group by 2 union all select 'counts', 'students', cast(count(*) as double) from students union all select 'counts', 'suppliers', cast(count(*) as double) from supplier""")
def summary_blocks(spark, sf):
    """The four blocks of the summary page as labelled numbers."""
    a = relational.attendance_rollup(spark, sf).agg(F.round(F.avg("percent"), 2).alias("mean_percent"))
    f = relational.fee_rollup(spark, sf).agg(F.round(F.sum(F.greatest("balance", F.lit(0.0))), 2).alias("outstanding"))
    by = rollups.counts_by(roles.admissions(spark, sf), ["status"]).select(F.lit("admissions").alias("block"), F.col("value").alias("measure"), F.col("n").cast("double").alias("value"))
    n = rollups.labelled_counts({"students": roles.students(spark, sf), "suppliers": table(spark, sf, "supplier")}).select(F.lit("counts").alias("block"), F.col("entity").alias("measure"), F.col("n").cast("double").alias("value"))
    return relational._measures(a, "attendance").unionByName(relational._measures(f, "fees")).unionByName(by).unionByName(n)


@query(f"""with {STUDENTS}, {EXAMS}, x as (select e.*, s.program from exams e left join students s using (student_id)) select course_code, exam_name, count(*) as records, count(*) filter (where lower(result_status) = 'pass') as passed from x where lower(program) = 'building' group by 1, 2""")
def exams_of_a_program(spark, sf):
    """The exam roll-up for one programme: only then are the students joined."""
    rows = rollups.only(roles.exams(spark, sf), roles.students(spark, sf), "student_id", {"program": "Building"})
    return rows.groupBy("course_code", "exam_name").agg(F.count("*").alias("records"), F.count_if(F.lower("result_status") == "pass").alias("passed"))


@query("select d.doc_id, d.lang, length(d.text) as size, l.quality from documents d join labels l using (doc_id) where d.lang in ('en', 'fr')")
def chunks_with_documents(spark, sf):
    """Passages with their documents' class, those that a reader may see."""
    docs = filters.visible(table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("size")), "lang", ["en", "fr"])
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


_ROLES = {"reader": ["c_custkey", "c_mktsegment"], "officer": ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]}


@query("select 'reader' as role, c_custkey, null as c_name, c_mktsegment, null as c_acctbal from customer union all select 'officer', c_custkey, c_name, c_mktsegment, c_acctbal from customer")
def allowed_fields(spark, sf):
    """What each role may see of a customer: fields that it may not are not read for it."""
    parts = [filters.minimized(table(spark, sf, "customer"), ["c_name", "c_custkey", "c_mktsegment", "c_acctbal"], own).withColumn("role", F.lit(role)) for role, own in _ROLES.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@query("select c_custkey, c_name from customer where lower(c_mktsegment) = 'building' and c_custkey = 7 union all select c_custkey, c_name from customer where c_custkey = 12")
def point_lookups(spark, sf):
    rows = filters.for_tenant(table(spark, sf, "customer"), "BUILDING", "c_mktsegment")
    return filters.where(rows, {"c_custkey": 7}).select("c_custkey", "c_name").union(filters.where(table(spark, sf, "customer"), {"c_custkey": 12}).select("c_custkey", "c_name"))


@query("with newest as (select o_orderkey from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 1) select o_orderkey from orders where o_orderkey not in (select o_orderkey from newest) and o_custkey % 3 = 0")
def all_but_the_newest(spark, sf):
    orders = table(spark, sf, "orders")
    newest = orders.where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey")
    return orders.where("o_custkey % 3 = 0").join(newest, "o_orderkey", "left_anti").select("o_orderkey")


@query("select event_id, cast(k is not null as boolean) as kept from (select event_id, case when event_id % 2 = 0 then json_extract_string(props, '$.k') end as k from events)")
def without_contact(spark, sf):
    """Properties less the key that a reader may not see: it goes from odd events."""
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    m = F.when(F.col("event_id") % 2 == 0, F.col("m")).otherwise(filters.without_keys(F.col("m"), ["k"]))
    return rows.select("event_id", F.map_contains_key(m, F.lit("k")).alias("kept"))


@query("""with b as (select o_orderkey as k, case when o_orderkey % 4 = 0 then ' ' when o_orderkey % 4 = 1 then cast(o_totalprice as varchar) else '1' end as marks, o_orderstatus as grade from orders where o_orderkey % 2 = 1 or o_orderkey % 4 = 0)
  select k, marks, grade, case when o.o_orderkey is null then 'insert' when (trim(marks) <> '' and cast(marks as double) <> o.o_totalprice) or (lower(grade) <> 'f') then 'replaces_stored_marks' else 'update' end as action,
    case when o.o_orderkey is null then '' else concat_ws(',', case when trim(marks) <> '' and cast(marks as double) <> o.o_totalprice then 'marks' end, case when lower(grade) <> 'f' then 'grade' end) end as differing
  from b left join (select * from orders where o_orderkey % 3 > 0) o on b.k = o.o_orderkey""")
def marks_replaced(spark, sf):
    orders = table(spark, sf, "orders")
    batch = orders.where("o_orderkey % 2 = 1 or o_orderkey % 4 = 0").selectExpr("o_orderkey as k", "case when o_orderkey % 4 = 0 then ' ' when o_orderkey % 4 = 1 then cast(o_totalprice as string) else '1' end as marks", "o_orderstatus as grade")
    stored = orders.where("o_orderkey % 3 > 0").selectExpr("o_orderkey as k", "cast(o_totalprice as string) as marks", "'f ' as grade")
    return review.marks_replaced(batch, stored, "k", ["marks", "grade"])


@query("""with r as (select o_orderkey as locator, o_custkey as key, o_orderkey as number from orders), d as (select o_orderkey as locator, case o_orderkey % 3 when 0 then 'keep_first' when 1 then 'use_this' else 'same_person' end as verdict from orders where o_orderkey % 41 < 3),
  n as (select * from d join r using (locator)), c as (select key, max(locator) as keep from n where verdict = 'use_this' group by 1)
  select locator from n where verdict = 'keep_first' union select r.locator from r join c using (key) where r.locator <> keep union select locator from r where key in (select key from n where verdict = 'same_person')""")
def skipped_rows(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey as locator", "o_custkey as key", "o_orderkey as number")
    decided = table(spark, sf, "orders").where("o_orderkey % 41 < 3").selectExpr("o_orderkey as locator", "case o_orderkey % 3 when 0 then 'keep_first' when 1 then 'use_this' else 'same_person' end as verdict")
    return review.skipped_rows(rows, decided)


_WIDE = """select o_orderkey as "USN", cast(floor(o_totalprice / 1000) as integer) as "Accounts (MB101)", case when o_orderkey % 5 = 0 then '-' when o_orderkey % 7 = 0 then 'AB' else '45+2' end as "MB102", o_orderstatus as "MB103", cast(o_custkey as varchar) as "Phone" from orders"""


@query(f"""with w as ({_WIDE}), c as (select 'Accounts (MB101)' as "column", 'MB101' as course, count("Accounts (MB101)") as filled, count("Accounts (MB101)") as marks from w
  union all select 'MB102', 'MB102', count(*) filter (where "MB102" <> '-'), count(*) filter (where "MB102" = '45+2') from w union all select 'MB103', 'MB103', count(*), 0 from w union all select 'Phone', '', count(*), count(*) from w)
  select *, "column" <> 'Phone' and filled > 0 and marks >= 0.6 * filled as chosen from c""")
def mark_columns(spark, sf):
    wide = table(spark, sf, "orders").selectExpr(
        "o_orderkey as USN", "cast(floor(o_totalprice / 1000) as int) as `Accounts (MB101)`", "case when o_orderkey % 5 = 0 then '-' when o_orderkey % 7 = 0 then 'AB' else '45+2' end as MB102", "o_orderstatus as MB103", "cast(o_custkey as string) as Phone")
    return review.mark_columns(wide, ["Accounts (MB101)", "MB102", "MB103", "Phone"])


@query("""with c as (select user_id, ts, event_type = 'signup' as ok, event_type in ('click', 'view') as bad from events), r as (select *, sum(case when ok then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as run from c),
  s as (select user_id, run, min(ts) as a, max(ts) as b from r where bad group by 1, 2) select user_id, max(b) as lapsed_at from s where b - a >= interval '24 hours' group by 1""")
def lapsed_names(spark, sf):
    kind = F.col("event_type")
    return review.lapsed_names(table(spark, sf, "events"), "user_id", "ts", kind == "signup", kind.isin("click", "view"))


TITLES = ("BGS College of Engineering opens", "News from Mandya", "BGS wins", "Other school", "The Institute", "bgs college of engineering, Mysuru")
TEXTS = (
    "BGS College of Engineering in Mandya offers MBA and BE.", "BGS releases a geological map.", "Nothing here.", "BGS College of Engineering is not the London Geological Survey.", "The survey of BGS College of Engineering said that in Mandya", "",
    "In London. " + "x " * 200 + "BGS College of Engineering",
)
_N = ["BGS College of Engineering", "BGS"]


def _word(c: str, n: str) -> str:
    return f"regexp_matches({c}, '(^|[^a-z0-9]){n.lower()}([^a-z0-9]|$)')"


_RESOLVED = f"""p as (select c_custkey, lower(([{', '.join(repr(t) for t in TITLES)}])[cast(c_custkey % {len(TITLES)} as integer) + 1]) as ti, lower(([{', '.join(repr(t) for t in TEXTS)}])[cast(c_custkey % {len(TEXTS)} as integer) + 1]) as te, c_custkey % 11 = 0 as official from customer),
  f as (select *, case when {_word('ti', _N[0])} or {_word('te', _N[0])} then 0 when {_word('ti', _N[1])} or {_word('te', _N[1])} then 1 end as first from p),
  g as (select *, case first when 0 then {_word('ti', _N[0])} when 1 then {_word('ti', _N[1])} else false end as nt, case first when 0 then {_word('te', _N[0])} when 1 then {_word('te', _N[1])} else false end as nx, contains(ti, 'mandya') as pt, contains(te, 'mandya') as px,
    regexp_matches(te, '(?s)(^|[^a-z0-9])(bgs college of engineering|bgs)[^a-z0-9].{{0,119}}london|london.{{0,119}}[^a-z0-9](bgs college of engineering|bgs)([^a-z0-9]|$)') as near, contains(te, 'london') as out_ from f),
  s as (select *, case when official then 1.0 else 0 end + case when first is null then 0 else (case when first = 0 then 1.0 else 0.85 end) * (case when nt then 0.5 else 0 end + case when nx then 0.35 else 0 end) end + case when pt then 0.25 when px then 0.2 else 0 end
    + least(0.1, 0.05 * (cast(contains(te, 'mba') as integer) + cast(contains(te, 'be') as integer))) - case when near then 0.5 when out_ then 0.2 else 0 end as s0 from g),
  t as (select *, case when coalesce(first = 1, false) and not (pt or px) and not official then least(s0, 0.45) else s0 end as s1 from s), u as (select *, case when first is not null and not (pt or px) and not official then least(s1, 0.6) else s1 end as s2 from t),
  scored as (select c_custkey, case when first is null and not official then 0 else round(greatest(0, least(1, s2)), 4) end as score from u)"""


def _pages(spark, sf):
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", at(TITLES).alias("title"), at(TEXTS).alias("text"))


@query(f"with {_RESOLVED} select c_custkey, score, case when score >= 0.8 then 'high' when score >= 0.5 then 'medium' when score >= 0.3 then 'low' else 'none' end as level from scored")
def resolved_entities(spark, sf):
    return review.resolved(_pages(spark, sf), _N, "Mandya", ["MBA", "BE"], ["London"], F.col("c_custkey") % 11 == 0).select("c_custkey", "score", "level")


@query(f"""with {_RESOLVED}, e as (select c_custkey, 'bgs' as entity, 'own' as kind, score from scored union all select c_custkey, 'twin', 'own', round(score * 0.9, 4) from scored union all select c_custkey, 'alike', 'lookalike', case when c_custkey % 3 = 0 then 0.5 else 0.1 end from scored),
  b as (select c_custkey, max(score) filter (where kind = 'own' and score >= 0.5) as score, coalesce(max(score) filter (where kind = 'lookalike'), 0) as rival from e group by 1) select c_custkey, 'bgs' as entity, score, rival from b where score >= rival + 0.2""")
def matched_entities(spark, sf):
    s = resolved_entities(spark, sf).select("c_custkey", "score")
    every = s.select("c_custkey", F.lit("bgs").alias("entity"), F.lit("own").alias("kind"), "score").union(s.select("c_custkey", F.lit("twin"), F.lit("own"), F.round(F.col("score") * 0.9, 4)))
    every = every.union(s.select("c_custkey", F.lit("alike"), F.lit("lookalike"), F.when(F.col("c_custkey") % 3 == 0, 0.5).otherwise(0.1)))
    return review.matched(every, "c_custkey")


@query(f"""with {_RESOLVED}, q as (select c_custkey, score, c_custkey % 5 as q from scored where score >= 0.3), tq as (select *, row_number() over (partition by q order by score desc, c_custkey) as turn from q), c as (select * from tq order by turn, q limit 60)
  select c_custkey, score, case when score >= 0.8 then 3 when score >= 0.5 then 2 else 1 end as level from c order by level desc, score desc, c_custkey limit 20""")
def collected_findings(spark, sf):
    """Candidates by fair shares of five queries, judged, and the best twenty."""
    from ..operators.stores import fair_share

    rows = resolved_entities(spark, sf).where("score >= 0.3").select("c_custkey", "score", (F.col("c_custkey") % 5).alias("q"), (-F.col("score")).alias("less"))
    taken = fair_share(rows, "q", ["less", "c_custkey"], 60)
    level = F.when(F.col("score") >= 0.8, 3).when(F.col("score") >= 0.5, 2).otherwise(1)
    return taken.select("c_custkey", "score", level.alias("level")).orderBy(F.desc("level"), F.desc("score"), "c_custkey").limit(20)


@query(f"""with {STUDENTS}, {ATTENDANCE}, {_ROLLUP} select program, department, count(*) as students, round(avg(percent), 2) as mean_percent from rollup_ where lower(department) = 'nation_3' group by 1, 2 order by 1, 2 limit 1000""")
def scoped_report(spark, sf):
    """An aggregate view as a reader of one department sees it."""
    view = relational.attendance_rollup(spark, sf).groupBy("program", "department").agg(F.count("*").alias("students"), F.round(F.avg("percent"), 2).alias("mean_percent"))
    return filters.scoped(view, {"department": "Nation_3", "program": ""}, ["program", "department"])
