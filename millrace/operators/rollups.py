"""Roll-ups of facts with a dimension that fills in what facts leave out.

Facts are added up by their key before they meet the dimension, so a shuffle carries one
row for each key and map task, and the join is of two tables keyed alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSED, FAILED = ("pass", "passed", "p"), ("fail", "failed", "f", "reappear", "absent")


def money(column: Column | str) -> Column:
    return F.round(F.sum(column), 2)


def zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 2))


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """facts, and the dimension's columns as dim_<name>, by a left join on the key."""
    named = dimension.select(F.col(key), *(F.col(c).alias(f"dim_{c}") for c in columns))
    return facts.join(named, key, "left")


def only(facts: DataFrame, dimension: DataFrame, key: str, filters: dict[str, object]) -> DataFrame:
    """Facts whose own value, or the dimension's where they have none, equals each filter (text without case).

    The dimension is joined only if there is a filter.
    """
    filters = {k: v for k, v in filters.items() if v not in (None, "")}
    if not filters:
        return facts
    both = with_dimension(facts, dimension, key, list(filters))
    for name, value in filters.items():
        found = F.coalesce(F.col(name) if name in facts.columns else F.lit(None), F.col(f"dim_{name}"))
        both = both.where(F.lower(found.cast("string")) == str(value).lower())
    return both.select(facts.columns)


def attendance_rollup(facts: DataFrame, students: DataFrame, filters: dict[str, object] | None = None) -> DataFrame:
    """A row for each student: classes held and attended, percent, records.

    percent is that of the sums where classes were held, else the mean of stated
    percents, else null; the name and program come from the better of both tables.
    """
    facts = only(facts, students, "student_id", filters or {})
    sums = facts.groupBy("student_id").agg(
        F.sum(zero("classes_held")).alias("held"), F.sum(zero("classes_attended")).alias("attended"),
        F.avg("attendance_percent").alias("mean_percent"), F.count(F.lit(1)).alias("records"),
        F.max("student_name").alias("fact_name"), F.max("program").alias("fact_program"),
    )
    return with_dimension(sums, students, "student_id", ["name", "program", "department", "semester"]).select(
        "student_id", F.coalesce("dim_name", "fact_name").alias("name"), F.coalesce("fact_program", "dim_program").alias("program"),
        F.col("dim_department").alias("department"), F.col("dim_semester").alias("semester"), "held", "attended", "records",
        F.coalesce(percent(F.col("attended"), F.col("held")), F.round("mean_percent", 2)).alias("percent"),
    )


def attendance_summary(rollup: DataFrame) -> DataFrame:
    """By program: students, mean of their percents, and how many are under 75 and 65."""
    return rollup.groupBy("program").agg(
        F.count(F.lit(1)).alias("students"), F.round(F.avg("percent"), 2).alias("mean_percent"),
        F.count_if(F.col("percent") < 75).alias("below_75"), F.count_if(F.col("percent") < 65).alias("below_65"),
    )


def fee_rollup(facts: DataFrame, students: DataFrame, filters: dict[str, object] | None = None) -> DataFrame:
    """A row for each student: due, paid, balance (stated, else due less paid), first due date, records."""
    facts = only(facts, students, "student_id", filters or {})
    owed = F.coalesce(F.col("balance"), zero("amount_due") - zero("amount_paid"))
    sums = facts.groupBy("student_id").agg(
        money(zero("amount_due")).alias("due"), money(zero("amount_paid")).alias("paid"), money(owed).alias("balance"),
        F.min("due_date").alias("first_due"), F.count(F.lit(1)).alias("records"), F.max("program").alias("fact_program"),
    )
    return with_dimension(sums, students, "student_id", ["name", "program"]).select(
        "student_id", F.col("dim_name").alias("name"), F.coalesce("fact_program", "dim_program").alias("program"),
        "due", "paid", "balance", "first_due", "records",
    )


def fee_breakdown(facts: DataFrame, students: DataFrame) -> DataFrame:
    """By program and year: distinct students, records, due and paid."""
    small = facts.groupBy("student_id", "program", "academic_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_due").alias("due"), F.sum("amount_paid").alias("paid")
    )
    program = F.upper(F.coalesce("program", "dim_program")).alias("program")
    return (
        with_dimension(small, students, "student_id", ["program"])
        .select("student_id", program, "academic_year", "n", "due", "paid")
        .groupBy("program", "academic_year")
        .agg(F.countDistinct("student_id").alias("students"), F.sum("n").alias("records"), money("due").alias("due"), money("paid").alias("paid"))
    )


def fee_summary(breakdown: DataFrame) -> DataFrame:
    """Totals by program, by year, by both and in all: one pass over the breakdown as grouping sets.

    students is the sum of the cells' distinct counts, so one who pays in two cells counts twice.
    """
    return breakdown.groupingSets(
        [[F.col("program")], [F.col("academic_year")], [F.col("program"), F.col("academic_year")], []], "program", "academic_year"
    ).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("students").alias("students"), F.sum("records").alias("records"),
        money("due").alias("due"), money("paid").alias("paid"), percent(F.sum("paid"), F.sum("due")).alias("collected"),
    )


def exam_rollup(facts: DataFrame) -> DataFrame:
    """By course and exam: records, mean percent of the maximum, passed, failed."""
    share = F.when((F.col("max_marks") > 0) & F.col("marks_obtained").isNotNull(), F.col("marks_obtained") * 100 / F.col("max_marks"))
    status = F.lower("result_status")
    return facts.groupBy("course_code", "exam_name").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg(share), 2).alias("mean_percent"),
        F.count_if(status.isin(*PASSED)).alias("passed"), F.count_if(status.isin(*FAILED)).alias("failed"),
    )


def exam_pass_rates(rollup: DataFrame) -> DataFrame:
    """By course: passed, failed and the share that passed of both."""
    return rollup.groupBy("course_code").agg(
        F.sum("passed").alias("passed"), F.sum("failed").alias("failed"),
        percent(F.sum("passed"), F.sum("passed") + F.sum("failed")).alias("pass_rate"),
    )


def counts_by(facts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by each column's lower-cased value, blank as unknown: (dimension, value, n), in one pass."""
    cells = F.array(
        *(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(F.trim(F.lower(F.col(c))), F.lit("")), F.lit("unknown")).alias("value")) for c in columns)
    )
    return facts.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: its name and number of rows."""
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not blank."""
    return df.where(F.trim(F.col(column)) != "").select(column).distinct()


def low_percent(rollup: DataFrame, below: float = 75, limit: int = 50) -> DataFrame:
    """The students with the lowest known percent under a limit."""
    return rollup.where(F.col("percent") < below).orderBy("percent", "student_id").limit(limit)


def pending(rollup: DataFrame, limit: int = 50) -> DataFrame:
    """The largest balances that are still owed."""
    return rollup.where(F.col("balance") > 0).orderBy(F.desc("balance"), "student_id").limit(limit)
