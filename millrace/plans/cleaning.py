"""Cleaning of dirty cells: lists of values as people type them, dealt over the customers, and each rule as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from .registry import query
from .roles import table

NAMES = [
    "  MARY  ANN LEE", "McDonald Roy", "a.b. khan", "A . B . KHAN", "anna", "ANNA", "Dr. o'neil", "j.  k. rao", "LEE  J", "x", "Ravi Kumar", "ravi  KUMAR", "S.P.BALU",
    "mary-ann lee", " ", "m", "R. K. Narayan", "r.k.narayan", "ÉLISE MARTIN", "élise", "PROF. RAO", "123", "Kim . Li", "kim .li", "A.", "a b c", "VAN DER BERG", "van der Berg",
    "O'BRIEN", "st. john", "ST.JOHN", "Lee\tJ", "d'souza", "D'Souza", "M.S. Dhoni", "m.s. dhoni", "MS DHONI", "a. ", " .b", "B. Tech",
]
PROGRAMMES = [
    "MBA", "m.b.a.", "Master of Business Administration", "MBA Programme", "BBA", "Bachelor of Commerce", "B.Com", "bcom ", "B.E.", "Bachelor of Engineering", "B Tech", "b.tech",
    "Bachelor of Technology", "M.Tech", "M.E", "BSc", "Bachelor  of Science", "M.Sc.", "M Com", "B.A.", "Master of Arts", "B.Ed", "M.Ed", "LL.B", "Bachelor of Laws", "LLM", "MBBS",
    "BDS", "B.Pharm", "Bachelor of Pharmacy", "M.Pharm", "B.Arch", "Ph.D.", "Doctor of Philosophy", "Diploma", "PUC", "Pre-University", "civil works", "Nursing", "BCA", "mca",
]
SEMESTERS = [
    "Sem III", "2nd semester", "Fourth", "7", "99", "Semester 5", "sem. 6", "VIII", "tenth", "X", "term 2", "Term-3", "0", "20", "21", "semester", "First Sem", "1st", "ix", "nine",
    "Sem:4", "year 2 sem 3", "IV Semester", "5th Sem.", "six", "Third Term", "III/IV", "sem4", "12", " 8 ", "SEM VII", "2.", "- 3 -", "eleventh", "one", "semester - II", "10th", "v", "fifth ", "100",
]
NUMBERS = [
    "1,234.50", "₹ 500", "rs. 75", "rs 80", "inr 90", "Rs. 75", "INR 5", "12", " 12 ", "-3.5", "1e3", "abc", "", "12 000", "5%", "1,00,000", "0", "+7", ".5", "5.", "--", "r,s 4", "12.0",
    "7d", "NaN", "0x1F", "1.2.3", "₹1,250.75", "rs.1,000", "3 rs", "inr", "1e-2", "99.999", "-0", "1,2,3", "45+2", "½", "10 ", "2E2", "1_000",
]
PERCENTS = [
    "85%", "85", " 85.555 %", "0.5", "1", "100%", "101", "-2", "abc", "%", "", "1,000%", "85.5 percent", "0.85%", "99.999", "66.666", "12.345", "0", "1e1", "50 %", "50%%", "3/4", "75.", ".75",
    "7d", "NA", "8 5", "100.00", "33.333", "+5", "-0.5", "200%", "1%", "9,5", "5.005", "2.675", "87.125", "n/a", "60.1", "59.994",
]
FLAGS = [
    "Yes", "no", "Y", "N", "TRUE", "false", "1", "0", "HOD", "active", "Inactive", "t", "F", "-", "", " ", "maybe", "2", "yes ", " y", "ACTIVE", "in active", "hod.", "true", "False", "T", "f",
    "None", "na", "YES", "No.", "y/n", "on", "off", "oui", "10", "01", "tr", "hod", "inactive ",
]
DATES = [
    "2024-03-05", "2024-13-05", "2024-02-30", "05-03-2024", "5/3/2024", "31/12/2023", "12/31/2023", "5.3.2024", "2024/3/5", "5 Mar 2024", "5 March 2024", "Mar 5, 2024", "March 5, 2024",
    "5-Mar-2024", "5-March-2024", "5-Mar-24", "5/3/24", "5-3-69", "5-3-68", "2024-03-05T10:11:12", "2024-03-05 10:11:12", "5 MAR 2024", "5 mar 2024", " 2024-03-05 ", "2024-3-5", "13/13/2024",
    "1/1/2024", "yesterday", "", "45000", "5/3", "2024", "29/2/2024", "29/2/2023", "0/1/2024", "5/3/2024 x", "12-11-10", "31-4-2024", "7.7.2024", "30 Feb 2024",
]
PHONES = [
    "98765 43210", "+91 98765-43210", "919876543210", "09876543210", "(080) 2345-6789", "+1 (743) 555-3824", "1234567", "12345", "++91 9876543210", "91-98765-43210", "0919876543210", "+919876543210",
    "98765.43210", "tel: 9876543210", "", "abc", "080-23456789", "0 98765 43210", "+0 9876543210", "9876543210 ext 5",
]


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _dealt(values: list[str]) -> str:
    """SQL of the customers with one value each."""
    return f"(select c_custkey, ([{', '.join(map(_sql, values))}])[cast(c_custkey % {len(values)} as integer) + 1] as x from customer)"


def _rows(spark, sf, values: list[str]):
    x = F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", x.alias("x"))


#: White space to single blanks.
_WS = "trim(regexp_replace(x, '[\\s\\x{a0}]+', ' ', 'g'))"
_NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
_DOTTED = f"trim(regexp_replace(regexp_replace({_WS}, '\\s*\\.\\s*', '. ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"select c_custkey, case when t = upper(t) or t = lower(t) then array_to_string(list_transform(string_split(t, ' '), lambda p: upper(p[1]) || lower(p[2:])), ' ') else t end as clean "
    f"from (select c_custkey, {_DOTTED} as t from {_dealt(NAMES)})"
)
def clean_person_name(spark, sf):
    return _rows(spark, sf, NAMES).select("c_custkey", clean.person_name(F.col("x")).alias("clean"))


_CODES = " union all ".join(f"select {_sql(n)} as name, {_sql(code)} as code" for code, names in clean.PROGRAMS.items() for n in names)


@query(f"""select c_custkey, coalesce(code, upper({_WS})) as clean from {_dealt(PROGRAMMES)} left join ({_CODES}) p on regexp_replace(lower(x), '[^a-z0-9]', '', 'g') = p.name""")
def clean_program(spark, sf):
    return _rows(spark, sf, PROGRAMMES).select("c_custkey", clean.program(F.col("x")).alias("clean"))


_WORDS = " union all ".join(f"select {_sql(w)} as word, {n} as n" for n, ways in enumerate(clean.SEMESTERS, 1) for w in ways)


@query(
    f"""select c_custkey, coalesce(w.n, case when d between 1 and 20 then d end) as clean from (
      select c_custkey, bare, try_cast(regexp_extract(bare, '\\b(\\d{{1,2}})\\b', 1) as integer) as d from (
        select c_custkey, trim(regexp_replace(lower({_WS}), '\\b(sem(ester)?|term)\\b', ' ', 'g'), ' .-') as bare from {_dealt(SEMESTERS)})) left join ({_WORDS}) w on bare = w.word"""
)
def clean_semester(spark, sf):
    return _rows(spark, sf, SEMESTERS).select("c_custkey", clean.semester(F.col("x")).alias("clean"))


@query(
    f"""select c_custkey, case when starts_with(p, '91') and length(p) = 12 then '+' || p else p end as clean from (
      select c_custkey, case when starts_with(k, '0') and length(k) = 11 then k[2:] else k end as p from (
        select c_custkey, case when starts_with(d, '+') then '+' || replace(d, '+', '') else d end as k from (
          select c_custkey, regexp_replace(x, '[^0-9+]', '', 'g') as d from {_dealt(PHONES)})))"""
)
def clean_phone(spark, sf):
    return _rows(spark, sf, PHONES).select("c_custkey", clean.phone(F.col("x")).alias("clean"))


@query("select c_custkey, lower(replace(c_name, '#', '.')) || ' @example.org' as clean from customer")
def clean_email(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "concat('  ', upper(replace(c_name, '#', '.')), '   @Example.org ') as x")
    return rows.select("c_custkey", clean.email(F.col("x")).alias("clean"))


_PLAIN = "x"
for _mark in (",", "₹", "rs.", "rs", "inr"):
    _PLAIN = f"replace({_PLAIN}, '{_mark}', '')"


@query(f"select c_custkey, n as amount, case when n = floor(n) then cast(n as bigint) end as whole from (select c_custkey, case when regexp_matches(t, {_NUMBER}) then cast(t as double) end as n from (select c_custkey, trim({_PLAIN}) as t from {_dealt(NUMBERS)}))")
def clean_numbers(spark, sf):
    return _rows(spark, sf, NUMBERS).select("c_custkey", clean.number(F.col("x")).alias("amount"), clean.integer(F.col("x")).alias("whole"))


@query(f"select c_custkey, case when regexp_matches(t, {_NUMBER}) then round(cast(t as double), 2) end as clean from (select c_custkey, trim(regexp_replace(x, '[%,]', '', 'g')) as t from {_dealt(PERCENTS)})")
def clean_percent(spark, sf):
    return _rows(spark, sf, PERCENTS).select("c_custkey", clean.percent(F.col("x")).alias("clean"))


@query("select event_id, round(case when event_id % 2 = 0 then case when floor(value) / 1000 between 0 and 1 then floor(value) / 1000 * 100 else floor(value) / 1000 end when value between 0 and 1 then value * 100 else value end, 2) as clean from events")
def clean_scaled_percent(spark, sf):
    x = F.when(F.col("event_id") % 2 == 0, F.floor("value") / 1000).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", clean.scaled_percent(x).alias("clean"))


@query(f"select c_custkey, case when lower({_WS}) in ('yes', 'y', 'true', '1', 'hod', 'active', 't') then true when lower({_WS}) in ('no', 'n', 'false', '0', 'inactive', 'f', '-', '') then false end as clean from {_dealt(FLAGS)}")
def clean_boolean(spark, sf):
    return _rows(spark, sf, FLAGS).select("c_custkey", clean.boolean(F.col("x")).alias("clean"))


#: Formats of years of four digits and of two.
_LONG = "['%Y-%m-%d', '%d-%m-%Y', '%d/%m/%Y', '%d.%m.%Y', '%Y/%m/%d', '%d %b %Y', '%d %B %Y', '%b %d, %Y', '%B %d, %Y', '%d-%b-%Y', '%d-%B-%Y', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S']"
_SHORT = "['%d-%b-%y', '%d/%m/%y', '%d-%m-%y']"


@query(
    f"""select c_custkey, clean, coalesce(clean is not null and not a = b and a <= 12 and b <= 12, false) as ambiguous from (
      select c_custkey, cast(case when regexp_matches(t, '\\d{{4}}') then try_strptime(t, {_LONG}) else try_strptime(t, {_SHORT}) end as date) as clean,
        try_cast(regexp_extract(t, '^(\\d{{1,2}})[-/.](\\d{{1,2}})[-/.]\\d{{2,4}}$', 1) as integer) as a, try_cast(regexp_extract(t, '^(\\d{{1,2}})[-/.](\\d{{1,2}})[-/.]\\d{{2,4}}$', 2) as integer) as b
      from (select c_custkey, {_WS} as t from {_dealt(DATES)}))"""
)
def clean_date(spark, sf):
    return _rows(spark, sf, DATES).select("c_custkey", clean.date(F.col("x")).alias("clean"), clean.ambiguous_date(F.col("x")).alias("ambiguous"))


@query("select o_orderkey, case when d between 20000 and 80000 then cast(date '1899-12-30' + cast(d as integer) as date) end as clean from (select o_orderkey, date_diff('day', date '1899-12-30', cast(o_orderdate as date)) * case when o_orderkey % 5 = 0 then 3 else 1 end as d from orders)")
def clean_serial_date(spark, sf):
    days = F.datediff("o_orderdate", F.lit("1899-12-30")) * F.when(F.col("o_orderkey") % 5 == 0, 3).otherwise(1)
    return table(spark, sf, "orders").select("o_orderkey", clean.serial_date(days).alias("clean"))


#: A record with a cell of several kinds, from the lists above.
_FIELDS = {"name": "string", "program": "string", "semester": "integer", "phone": "phone", "attendance_percent": "percent", "status": "string", "student_id": "identifier"}


def _record(spark, sf):
    def cell(values: list[str], shift: int):
        every = ["N/A", "--", " ", *values, "45%"]
        return F.element_at(F.array(*map(F.lit, every)), (F.pmod(F.col("c_custkey") * 7 + shift, F.lit(len(every))) + 1).cast("int"))

    return table(spark, sf, "customer").select(
        "c_custkey", cell(NAMES, 1).alias("name"), cell(PROGRAMMES, 2).alias("program"), cell(SEMESTERS, 3).alias("semester"), cell(PHONES, 4).alias("phone"),
        cell(PERCENTS, 5).alias("attendance_percent"), cell(FLAGS, 6).alias("status"), F.concat(F.lit(" "), F.lower("c_name")).alias("student_id"),
    )


def _cell_sql(values: list[str], shift: int) -> str:
    every = ["N/A", "--", " ", *values, "45%"]
    return f"([{', '.join(map(_sql, every))}])[cast((c_custkey * 7 + {shift}) % {len(every)} as integer) + 1]"


_BLANK = "('na', 'n/a', 'nil', 'null', 'none', '-', '--', '')"


@query(
    f"""with r as (select c_custkey, {_cell_sql(PROGRAMMES, 2)} as p, {_cell_sql(PERCENTS, 5)} as q from customer), t as (select c_custkey, p, q, trim(regexp_replace(p, '\\s+', ' ', 'g')) tp, trim(regexp_replace(q, '\\s+', ' ', 'g')) tq from r),
      c as (select *, lower(tp) in {_BLANK} as bp, lower(tq) in {_BLANK} as bq, regexp_matches(tp, '^-?\\d+(\\.\\d+)?%?$') as np, trim(regexp_replace(tq, '[%,]', '', 'g')) as n from t)
      select c_custkey, case when not bp and not np then coalesce(code, upper(tp)) end as program, case when not bq and regexp_matches(n, {_NUMBER}) then round(cast(n as double), 2) end as percent,
        cast((not bp and np)::integer + (not bq and not regexp_matches(n, {_NUMBER}))::integer as bigint) as n_issues,
        cast((p <> tp)::integer + (tp <> '' and bp)::integer + coalesce((not bp and not np and coalesce(code, upper(tp)) <> tp)::integer, 0) + (q <> tq)::integer + (tq <> '' and bq)::integer + (not bq and regexp_matches(n, {_NUMBER}))::integer as bigint) as n_notes
      from c left join ({_CODES}) k on regexp_replace(lower(tp), '[^a-z0-9]', '', 'g') = k.name"""
)
def clean_records(spark, sf):
    rows = _record(spark, sf).select("c_custkey", *clean.clean_record({"program": "string", "attendance_percent": "percent"}))
    return rows.select("c_custkey", "program", F.col("attendance_percent").cast("double").alias("percent"), F.size("issues").cast("long").alias("n_issues"), F.size("notes").cast("long").alias("n_notes"))


@query()
def clean_record_notes(spark, sf):
    """Every note and issue of records of seven fields; held against a plain version in the tests."""
    return _record(spark, sf).select("c_custkey", *clean.clean_record(_FIELDS))


_VALIDATED = """select c_custkey, case when c_custkey % 6 = 0 then '' else c_name end as student_id, case when c_custkey % 5 = 0 then null else c_name end as name, case when c_custkey % 5 = 0 and c_custkey % 2 = 0 then 'Ann' end as first_name,
  case c_custkey % 4 when 0 then '12345' when 1 then '+91 98765 43210' when 2 then '1234567890123456' end as phone, case c_custkey % 3 when 0 then 'a@b.co' when 1 then 'a b@c.d' when 2 then 'x@y' end as email,
  c_acctbal / 50 as attendance_percent, c_acctbal as amount_due, cast(c_custkey % 7 as integer) - 2 as classes_held, cast(1890 + c_custkey % 300 as integer) as admission_year from customer"""


@query(
    f"""with r as ({_VALIDATED}) select c_custkey, 'student_id' as field, 'missing_required' as code, 'error' as severity from r where student_id = '' union all
      select c_custkey, 'name', 'missing_required', 'error' from r where name is null and first_name is null union all
      select c_custkey, 'student_id', 'invalid_identifier', 'warning' from r where student_id <> '' and not regexp_matches(student_id, '^[A-Za-z0-9][A-Za-z0-9/_.-]*$') union all
      select c_custkey, 'phone', 'invalid_phone', 'warning' from r where length(regexp_replace(phone, '[^0-9]', '', 'g')) not between 7 and 15 union all
      select c_custkey, 'email', 'invalid_email', 'warning' from r where not regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') union all
      select c_custkey, 'attendance_percent', 'percent_out_of_range', 'error' from r where attendance_percent not between 0 and 100 union all
      select c_custkey, 'amount_due', 'negative_amount', 'error' from r where amount_due < 0 union all
      select c_custkey, 'classes_held', 'negative_count', 'error' from r where classes_held < 0 union all
      select c_custkey, 'admission_year', 'year_out_of_range', 'warning' from r where admission_year not between 1900 and 2100"""
)
def validate_fields(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 6 = 0 then '' else c_name end as student_id", "case when c_custkey % 5 = 0 then null else c_name end as name",
        "case when c_custkey % 5 = 0 and c_custkey % 2 = 0 then 'Ann' end as first_name",
        "case c_custkey % 4 when 0 then '12345' when 1 then '+91 98765 43210' when 2 then '1234567890123456' end as phone",
        "case c_custkey % 3 when 0 then 'a@b.co' when 1 then 'a b@c.d' when 2 then 'x@y' end as email", "c_acctbal / 50 as attendance_percent", "c_acctbal as amount_due",
        "cast(c_custkey % 7 as int) - 2 as classes_held", "cast(1890 + c_custkey % 300 as int) as admission_year",
    )
    fields = {"student_id": "identifier", "name": "string", "first_name": "string", "phone": "phone", "email": "email", "attendance_percent": "percent", "amount_due": "number", "classes_held": "integer", "admission_year": "integer"}
    rules = clean.field_rules(fields, ["student_id", "name"], counts=("classes_held",), amounts=("amount_due",))
    return rows.select("c_custkey", F.inline(clean.issues(rules)))


@query(
    """with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 1 as held, l_quantity + l_linenumber - 4 as attended, case when l_linenumber % 2 = 0 then 1.0 end as percent, l_extendedprice as due, l_extendedprice * (1 + l_discount * 7) as paid from lineitem)
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'classes_attended' as field, 'attended_exceeds_held' as code, 'error' as severity from a where attended > held union all
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'attendance_percent', 'attendance_unknown', 'warning' from a where percent is null and held = 0 union all
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'marks_obtained', 'marks_exceed_maximum', 'error' from a where attended > 50 union all
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'amount_paid', 'paid_far_exceeds_due', 'warning' from a where due > 0 and paid > due * 1.5"""
)
def cross_field_issues(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity - 1 as held", "l_quantity + l_linenumber - 4 as attended", "case when l_linenumber % 2 = 0 then 1.0D end as percent",
        "l_extendedprice as due", "l_extendedprice * (1 + l_discount * 7) as paid",
    )
    c = F.col
    rules = [*clean.attendance_rules(c("held"), c("attended"), c("percent")), *clean.exam_rules(c("attended"), F.lit(50.0)), *clean.fee_rules(c("due"), c("paid"))]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.inline(clean.issues(rules)))


@query(
    """with i as (select c_custkey, case c_custkey % 4 when 0 then '1MS' || lpad(cast(c_custkey % 100 as varchar), 2, '0') || 'MBA' when 1 then 'IMS2' || cast(c_custkey % 10 as varchar) || 'MBA' when 2 then '1MSOSMBA' else '1MSXYMBA' end as x from customer)
      select c_custkey, case x[1:1] when 'I' then '1' || x[2:] else replace(replace(x[1:3], 'S', 'S'), 'O', 'O') || translate(x[4:5], 'IOLSBZ', '101582') || x[6:] end as meant from i where c_custkey % 4 in (1, 2)"""
)
def ocr_suspicions(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "case c_custkey % 4 when 0 then concat('1MS', lpad(c_custkey % 100, 2, '0'), 'MBA') when 1 then concat('IMS2', c_custkey % 10, 'MBA') when 2 then '1MSOSMBA' else '1MSXYMBA' end as x",
    )
    return rows.withColumn("meant", clean.likely_identifier(F.col("x"), F.lit("9AA99AAA"))).where("meant is not null").select("c_custkey", "meant")
