"""Cleaning, validation, duplicates, upserts and reshaping; dirt is made from the driver's columns by expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import dedupe, reshape
from .registry import query
from .roles import table

_BLANK = "case when trim(x) = '' or lower(trim(x)) in ('na', 'n/a', 'nil', 'null', 'none', '-', '--') then null else trim(x) end"


def _dirty(spark, sf, expression):
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{expression} as x")


@query(f"""select c_custkey, {_BLANK} as clean from (select c_custkey, case c_custkey % 5 when 0 then ' ' when 1 then 'N/A' when 2 then '--' else c_name end x from customer)""")
def clean_blank(spark, sf):
    rows = _dirty(spark, sf, "case c_custkey % 5 when 0 then ' ' when 1 then 'N/A' when 2 then '--' else c_name end")
    return rows.select("c_custkey", clean.blank_to_null(F.col("x")).alias("clean"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(case when l_linenumber % 2 = 0 then l_quantity end, greatest(0, l_quantity - 3)) as attended,
  case when l_quantity > 0 then round(coalesce(case when l_linenumber % 2 = 0 then l_quantity end, greatest(0, l_quantity - 3)) / l_quantity * 100, 2) end as percent from lineitem""")
def derive_attendance(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("said", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")))
    rows = rows.withColumn("attended", clean.attended(F.col("l_quantity"), F.col("said"), F.lit(3.0)))
    percent = F.when(F.col("l_quantity") > 0, F.round(F.col("attended") / F.col("l_quantity") * 100, 2))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "attended", percent.alias("percent"))


_PAID = "case o_orderstatus when 'F' then o_totalprice when 'P' then floor(o_totalprice / 2) else 0.0 end"


@query(f"""select o_orderkey, round(o_totalprice - {_PAID}, 2) as balance, case when {_PAID} >= o_totalprice then 'paid' when {_PAID} > 0 then 'partial' else 'pending' end as status from orders""")
def derive_fee(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice as due", f"cast({_PAID} as double) as paid")
    return rows.select("o_orderkey", F.round(F.col("due") - F.col("paid"), 2).alias("balance"), clean.fee_status(F.col("due"), F.col("paid")).alias("status"))


def _issues(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity as held", "l_quantity + l_linenumber - 4 as attended", "l_discount * 1100 as percent", "l_tax as tax"
    )
    rules = [
        (F.col("attended") > F.col("held"), "attended", "exceeds_held", "error"),
        (~F.col("percent").between(0, 100), "percent", "out_of_range", "error"),
        (F.col("tax") == 0, "tax", "missing", "warning"),
    ]
    return rows.withColumn("issues", clean.issues(rules))


_ISSUES = """issues as (select l_orderkey, l_linenumber, 'attended' as field, 'exceeds_held' as code, 'error' as severity from lineitem where l_linenumber - 4 > 0
  union all select l_orderkey, l_linenumber, 'percent', 'out_of_range', 'error' from lineitem where l_discount * 1100 > 100 or l_discount * 1100 < 0
  union all select l_orderkey, l_linenumber, 'tax', 'missing', 'warning' from lineitem where l_tax = 0)"""


@query(f"with {_ISSUES} select * from issues")
def validate_issues(spark, sf):
    return _issues(spark, sf).select("l_orderkey", "l_linenumber", F.inline("issues"))


@query(f"with {_ISSUES} select field || ':' || code as issue, severity, count(*) n from issues group by 1, 2 order by n desc, issue limit 30")
def issue_summary(spark, sf):
    found = _issues(spark, sf).select(F.inline("issues")).groupBy(F.concat_ws(":", "field", "code").alias("issue"), "severity").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "issue").limit(30)


@query("""select 'c_name' as "column", regexp_replace(regexp_replace(c_name, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') as shape, count(*) n from customer group by 1, 2
  having count(*) >= greatest(3, (select count(*) from customer) / 2) order by n desc, shape limit 1""")
def modal_pattern(spark, sf):
    names = table(spark, sf, "customer").select("c_name")
    every = names.agg(F.greatest(F.lit(3), F.count("*") / 2).alias("least"))
    shapes = names.groupBy(clean.shape(F.col("c_name")).alias("shape")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(every))
    return shapes.where("n >= least").orderBy(F.desc("n"), "shape").limit(1).select(F.lit("c_name").alias("column"), "shape", "n")


@query("""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_type || '_(' || p_brand || ')'), '[_\\-./()\\[\\]:]', ' ', 'g'), '[^a-z0-9_\\s%#]', '', 'g'), '\\s+', ' ', 'g')) as header from part""")
def normalized_headers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", clean.header(F.concat("p_type", F.lit("_("), "p_brand", F.lit(")"))).alias("header"))


@query("""select c_custkey, record_key, sha256(record_key) as key_hash from (select c_custkey, lower(c_name) || '|' || lower(c_mktsegment) || '|' || case when c_custkey % 4 = 0 then '' else cast(c_nationkey as varchar) end record_key from customer)""")
def record_key_hash(spark, sf):
    rows = table(spark, sf, "customer").withColumn("place", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey"))).withColumn("padded", F.concat(F.lit("  "), "c_name"))
    rows = rows.withColumn("record_key", dedupe.record_key(["padded", "c_mktsegment", "place"]))
    return rows.select("c_custkey", "record_key", F.sha2("record_key", 256).alias("key_hash"))


_LINES = "l_orderkey * 10 + l_linenumber as k, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag"


@query(f"""with b as (select {_LINES}, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as seq from lineitem),
  m as (select *, row_number() over w n, first_value(l_partkey) over w fp, first_value(l_returnflag) over w ff from b window w as (partition by k order by seq))
  select k, l_partkey, l_suppkey, l_extendedprice, case when n > 1 and l_partkey = fp and l_returnflag = ff then 'duplicate_in_batch' when n > 1 then 'conflict_in_batch'
    when k in (select o_orderkey * 10 + 1 from orders where o_orderkey % 2 = 0) then 'update' else 'insert' end as action,
    concat_ws(',', case when l_partkey <> fp then 'l_partkey' end, case when l_returnflag <> ff then 'l_returnflag' end) as differing from m""")
def dedupe_actions(spark, sf):
    batch = table(spark, sf, "lineitem").selectExpr(*_LINES.split(", "))
    stored = table(spark, sf, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey * 10 + 1 as k")
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    got = dedupe.duplicate_actions(batch, stored, "k", ["l_partkey", "l_returnflag"], order)
    return got.select("k", "l_partkey", "l_suppkey", "l_extendedprice", "action", "differing")


#: A shared value for some forty customers next to each other, a balance, a value that a third have, and a name of two words.
_BLOCKS = """b as (select c_custkey as k, 'n:n' || cast(c_custkey // 40 as varchar) as block from customer union all select c_custkey, 'b:' || cast(c_acctbal as varchar) from customer
  union all select c_custkey, 'd:default' from customer where c_custkey % 3 = 0 union all select c_custkey, 'name:ann|' || lower(substr(c_name, 10, 20)) from customer), z as (select block, count(*) as members from b group by 1)"""


def _people(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey as key", "concat('Ann ', substr(c_name, 10, 20)) as name", "concat('n', c_custkey div 40) as n", "c_acctbal as b", "case when c_custkey % 3 = 0 then 'Default ' end as d")


@query(f"""with {_BLOCKS} select x.k as key_a, y.k as key_b, count(*) as corroborating from b x join b y on x.block = y.block and x.k < y.k where x.block in (select block from z where members between 2 and 200) group by 1, 2""")
def block_pairs(spark, sf):
    return dedupe.blocked_pairs(_people(spark, sf), "key", ["n", "b", "d"], "name").select("key_a", "key_b", "corroborating")


@query(f"with {_BLOCKS} select * from z where members > 200")
def oversize_blocks(spark, sf):
    return dedupe.oversize_blocks(dedupe.block_rows(_people(spark, sf), "key", ["n", "b", "d"], "name"))


@query()
def probable_people(spark, sf):
    return dedupe.probable_people(dedupe.blocked_pairs(_people(spark, sf), "key", ["n", "b", "d"], "name"))


_COPIES = """c as (select c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as n, case when c_nationkey % 5 = 0 then '|' else cast(c_nationkey as varchar) end as k, c_nationkey % 2 = 0 as stored from customer)"""


@query(f"""with {_COPIES}, m as (select *, row_number() over (partition by k order by c_custkey) as copy from c) select c_custkey, case when k = '|' or copy > 1 then 'skipped' when stored then 'updated' else 'inserted' end as action,
  case when k = '|' then 'missing_natural_key' when copy > 1 then 'duplicate_in_batch' end as reason from m""")
def upsert_reasons(spark, sf):
    """Blank keys and later copies of a key are skipped, each with its reason."""
    key = F.when(F.col("c_nationkey") % 5 == 0, "|").otherwise(F.col("c_nationkey").cast("string"))
    batch = table(spark, sf, "customer").select("c_custkey", key.alias("k"), F.col("c_name").alias("name"))
    stored = table(spark, sf, "nation").where("n_nationkey % 2 = 0 and n_nationkey % 5 > 0").select(F.col("n_nationkey").cast("string").alias("k"), F.lit("old").alias("name"))
    return dedupe.upsert_actions(batch, stored, "k", ["name"], ["c_custkey"]).select("c_custkey", "action", "reason")


def _stored(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey as k", "c_name as name", "c_acctbal as balance")


def _incoming(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr(
        "c_custkey as k", "case when c_custkey % 4 = 0 then ' ' else c_name end as name", "case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as balance")


_SIDES = """stored as (select c_custkey k, c_name as name, c_acctbal balance from customer where c_custkey % 3 <> 0),
  batch as (select c_custkey k, case when c_custkey % 4 = 0 then ' ' else c_name end as name, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end balance from customer where c_custkey % 2 = 0)"""


@query(f"""with {_SIDES} select b.k, b.name, b.balance, case when s.k is null then 'inserted' when b.name = s.name and b.balance = s.balance then 'unchanged' else 'updated' end as action
  from batch b left join stored s on b.k = s.k""")
def upsert_replace(spark, sf):
    return dedupe.upsert_actions(_incoming(spark, sf), _stored(spark, sf), "k", ["name", "balance"], ["balance"]).drop("reason")


@query(f"""with {_SIDES} select coalesce(b.k, s.k) as k, case when trim(b.name) <> '' then b.name else s.name end as name, coalesce(b.balance, s.balance) as balance
  from stored s full outer join batch b on b.k = s.k""")
def upsert_merge(spark, sf):
    return dedupe.upsert(_incoming(spark, sf), _stored(spark, sf), "k", ["name", "balance"], ["balance"], merge=True)


@query(f"""with s as (select o_orderkey k, o_totalprice due, 0.0::double paid, o_totalprice balance from orders),
  n as (select o_orderkey k, {_PAID} paid, case when o_orderkey % 9 = 0 then 1.0 end balance from orders where o_orderkey % 2 = 0)
  select s.k, due, coalesce(n.paid, s.paid) paid, coalesce(n.balance, round(due - coalesce(n.paid, s.paid), 2)) balance from s left join n on s.k = n.k""")
def merge_rederive(spark, sf):
    stored = table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_totalprice as due", "0.0D as paid", "o_totalprice as balance")
    sheet = table(spark, sf, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey as k", f"cast({_PAID} as double) as paid", "case when o_orderkey % 9 = 0 then 1.0D end as balance")
    return dedupe.merge_derived(sheet, stored, "k", ["due", "paid"], {"balance": F.round(F.col("due") - F.col("paid"), 2)})


@query("""with w as (select o_orderkey, cast(cast(floor(o_totalprice / 1000) as integer) as varchar) as "M1", case when o_orderkey % 5 = 0 then ' - ' when o_orderkey % 7 = 0 then 'ab' else '45+2' end as "M2" from orders)
  select o_orderkey, 'M1' as course, cast("M1" as double) as marks, null as status from w union all
  select o_orderkey, 'M2', case when "M2" = '45+2' then 47.0 end, case when "M2" = 'ab' then 'AB' end from w where "M2" <> ' - '""")
def unpivot_marks(spark, sf):
    wide = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(cast(floor(o_totalprice / 1000) as int) as string) as M1",
        "case when o_orderkey % 5 = 0 then ' - ' when o_orderkey % 7 = 0 then 'ab' else '45+2' end as M2",
    )
    return reshape.unpivot_marks(wide, ["o_orderkey"], ["M1", "M2"])


@query("""select o_orderpriority, max(o_totalprice) filter (where o_orderstatus = 'F') as "F", max(o_totalprice) filter (where o_orderstatus = 'O') as "O", max(o_totalprice) filter (where o_orderstatus = 'P') as "P" from orders group by 1""")
def pivot_grid(spark, sf):
    return reshape.grid(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.max("o_totalprice"))


@query("""select 'one' as "Sheet", cast(s_suppkey as bigint) as row_number, s_name as name, null as extra from supplier where s_suppkey % 2 = 0
  union all select 'two', cast(s_suppkey + (select max(s_suppkey) from supplier where s_suppkey % 2 = 0) as bigint), s_name, s_acctbal from supplier where s_suppkey % 2 = 1""")
def merged_sheets(spark, sf):
    rows = table(spark, sf, "supplier")
    one = rows.where("s_suppkey % 2 = 0").selectExpr("s_suppkey as row_number", "s_name as name")
    two = rows.where("s_suppkey % 2 = 1").selectExpr("s_suppkey as row_number", "s_name as Name", "s_acctbal as extra")
    return reshape.merged_sheets([one, two], ["one", "two"])
