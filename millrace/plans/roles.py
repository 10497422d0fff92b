"""The engine's roles (students, attendance, fees ...) bound to the driver's tables.

The operators know column roles only; each binding is a projection that Catalyst
pushes into the Parquet scan.  SQL gives the same rows for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none (tests), one under the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), _same("c_nationkey", "n_nationkey"))
    return people.selectExpr(
        "c_custkey as student_id", "c_name as name", "c_mktsegment as program", "n_name as department",
        "cast(c_nationkey % 8 + 1 as int) as semester", "c_acctbal as score",
    )


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), _same("l_orderkey", "o_orderkey")
    )
    return held.selectExpr(
        "o_custkey as student_id", "cast(null as string) as student_name",
        "case when l_linenumber % 3 <> 0 then o_orderpriority end as program",
        "concat('C', l_partkey % 20) as course_code", "year(l_shipdate) as period", "l_quantity as classes_held",
        "floor(l_quantity * (1 - l_discount * 4)) * 1.0D as classes_attended",
        "case when l_linenumber <> 2 then round(100 * (1 - l_discount * 4), 2) end as attendance_percent",
    )


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as student_id", "cast(null as string) as program", "o_totalprice as amount_due",
        "case o_orderstatus when 'F' then o_totalprice when 'P' then floor(o_totalprice / 2) * 1.0D else 0.0D end as amount_paid",
        "case when o_orderkey % 4 <> 0 then case o_orderstatus when 'F' then 0.0D when 'P' then o_totalprice - floor(o_totalprice / 2) else o_totalprice end end as balance",
        "year(o_orderdate) as academic_year", "o_orderpriority as fee_type", "cast(o_orderdate as date) as due_date", "o_orderkey as receipt_no",
    )


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as student_id", "concat('C', l_partkey % 50) as course_code", "l_linestatus as exam_name",
        "case when l_linenumber <> 3 then l_quantity end as marks_obtained", "50.0D as max_marks",
        "case l_returnflag when 'A' then 'Pass' when 'R' then 'FAIL' end as result_status",
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as application_id", "case when o_orderkey % 7 = 0 then ' ' else o_orderstatus end as status",
        "o_orderpriority as program", "cast(o_orderdate as date) as applied_on",
    )


def _same(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)


STUDENTS = """students as (select c_custkey student_id, c_name as name, c_mktsegment program, n_name department,
  cast(c_nationkey % 8 + 1 as integer) semester, c_acctbal score from customer join nation on c_nationkey = n_nationkey)"""
ATTENDANCE = """attendance as (select o_custkey student_id, cast(null as varchar) student_name,
  case when l_linenumber % 3 <> 0 then o_orderpriority end program, 'C' || cast(l_partkey % 20 as varchar) course_code,
  cast(year(l_shipdate) as integer) period, l_quantity classes_held, floor(l_quantity * (1 - l_discount * 4)) classes_attended,
  case when l_linenumber <> 2 then round(100 * (1 - l_discount * 4), 2) end attendance_percent
  from lineitem join orders on l_orderkey = o_orderkey)"""
FEES = """fees as (select o_custkey student_id, cast(null as varchar) program, o_totalprice amount_due,
  case o_orderstatus when 'F' then o_totalprice when 'P' then floor(o_totalprice / 2) else 0.0 end amount_paid,
  case when o_orderkey % 4 <> 0 then case o_orderstatus when 'F' then 0.0 when 'P' then o_totalprice - floor(o_totalprice / 2) else o_totalprice end end balance,
  cast(year(o_orderdate) as integer) academic_year, o_orderpriority fee_type, cast(o_orderdate as date) due_date, o_orderkey receipt_no from orders)"""
EXAMS = """exams as (select l_suppkey student_id, 'C' || cast(l_partkey % 50 as varchar) course_code, l_linestatus exam_name,
  case when l_linenumber <> 3 then l_quantity end marks_obtained, 50.0::double max_marks,
  case l_returnflag when 'A' then 'Pass' when 'R' then 'FAIL' end result_status from lineitem)"""
ADMISSIONS = """admissions as (select o_orderkey application_id, case when o_orderkey % 7 = 0 then ' ' else o_orderstatus end status,
  o_orderpriority program, cast(o_orderdate as date) applied_on from orders)"""
