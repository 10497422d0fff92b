"""Headers of uploaded tables matched with kinds of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import headers
from ..operators.headers import Entity
from .registry import query
from .roles import table

#: Kinds of records, their fields with kinds and other names, the required ones, and words of their tables.
ENTITIES = {
    "student": Entity(
        {
            "student_id": ("identifier", "student id", "usn", "roll no", "roll number", "register number", "reg no", "enrollment no", "admission no", "prn", "id"),
            "name": ("string", "student name", "name", "full name", "candidate name", "name of student"), "first_name": ("string", "first name", "given name"), "last_name": ("string", "last name", "surname", "family name"),
            "program": ("string", "program", "programme", "course", "degree", "stream"), "department": ("string", "department", "dept", "branch"), "semester": ("integer", "semester", "sem", "term", "current semester"),
            "section": ("string", "section", "sec", "div", "division"), "date_of_birth": ("date", "dob", "date of birth", "birth date"), "gender": ("string", "gender", "sex"),
            "phone": ("phone", "phone", "mobile", "mobile no", "contact", "contact number", "phone number"), "email": ("email", "email", "e-mail", "email id", "email address"),
        },
        ("student_id", "name"), ("usn", "roll no", "roll number", "student name", "student id", "register number", "admission no", "prn"),
    ),
    "attendance": Entity(
        {
            "student_id": ("identifier", "student id", "usn", "roll no", "id"), "student_name": ("string", "student name", "name"), "course_code": ("string", "course code", "subject code", "subject"),
            "period": ("string", "period", "month"), "classes_held": ("integer", "classes held", "total classes", "held", "conducted"), "classes_attended": ("integer", "classes attended", "attended", "present"),
            "attendance_percent": ("percent", "attendance percent", "attendance %", "percentage", "attendance"),
        },
        ("student_id",), ("attendance", "classes held", "classes attended", "present", "absent"),
    ),
    "fee": Entity(
        {
            "student_id": ("identifier", "student id", "usn", "roll no", "id"), "student_name": ("string", "student name", "name"), "fee_type": ("string", "fee type", "fee head", "particulars"),
            "amount_due": ("number", "amount due", "total fee", "demand", "payable"), "amount_paid": ("number", "amount paid", "paid", "received"), "balance": ("number", "balance", "pending", "due"),
            "receipt_no": ("identifier", "receipt no", "receipt number", "challan no"), "paid_on": ("date", "paid on", "payment date", "receipt date"),
        },
        ("student_id",), ("fee", "receipt", "balance", "paid", "challan"),
    ),
    "exam": Entity(
        {
            "student_id": ("identifier", "student id", "usn", "roll no", "seat no", "id"), "student_name": ("string", "student name", "name"), "course_code": ("string", "course code", "subject code"),
            "exam_name": ("string", "exam name", "exam", "test"), "marks_obtained": ("number", "marks obtained", "marks", "score"), "max_marks": ("number", "max marks", "maximum marks", "out of"), "grade": ("string", "grade"),
            "result_status": ("string", "result", "result status"),
        },
        ("student_id",), ("marks", "grade", "result", "exam"),
    ),
}
SHEETS = {
    "a": ("USN", "Student Name", "Mobile No", "Email ID", "10th marks", "SSLC percentage"), "b": ("USN", "Classes Held", "Classes Attended", "Percentage"),
    "c": ("Roll No", "Fee Type", "Amount Due", "Amount Paid", "Receipt No"), "d": ("Seat No", "Subject Code", "Marks", "Max Marks", "Result"), "e": ("10th marks", "12th board"),
}


def sheet_headers(spark):
    return spark.createDataFrame([(s, h) for s, all_ in SHEETS.items() for h in all_], "source string, header string")


@query()
def detected_entities(spark, sf):
    return headers.detect_entity(sheet_headers(spark), ENTITIES)


_CELL = """case c_custkey % 6 when 0 then '+91 98765 ' || cast(10000 + c_custkey as varchar) when 1 then 'a' || cast(c_custkey as varchar) || '@b.co' when 2 then cast(c_custkey % 100 as varchar) || '%'
  when 3 then '12/' || cast(c_custkey % 12 + 1 as varchar) || '/2024' when 4 then ' ' else '1MS' || cast(c_custkey as varchar) end"""
_SHARES = ", ".join(
    f"round(avg(cast(regexp_matches(v, '{p}'){{}} as integer)), 6) as {k}".replace("{}", {"phone": " and length(regexp_replace(v, '[^0-9]', '', 'g')) between 7 and 15", "identifier": " and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')"}.get(k, ""))
    for k, p in ((k, p.replace("'", "''")) for k, p in headers.SHAPES.items())
)


@query(
    f"""with v as (select c_mktsegment as source, 'h' || cast(c_custkey % 2 as varchar) as header, c_custkey, trim({_CELL}) as v from customer), f as (select *, row_number() over (partition by source, header order by c_custkey) as n from v where v <> '')
      select source, header, {_SHARES} from f where n <= 50 group by 1, 2"""
)
def value_shapes(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_mktsegment as source", "concat('h', c_custkey % 2) as header", "c_custkey as row", f"{_CELL.replace('varchar', 'string')} as value")
    return headers.value_shapes(rows)


_PROFILE = {"Mobile No": "phone", "Full Name": "name", "full name": "student_name", "Id": "student_id"}
_SEEN = ("Mobile No", "Mobile No.", "FULL NAME", "id", "Other")


@query(
    """with p as (select 'Mobile No' as h, 'phone' as f, 'mobile no' as n, 0 as i union all select 'Full Name', 'name', 'full name', 1 union all select 'full name', 'student_name', 'full name', 2 union all select 'Id', 'student_id', 'id', 3),
      s as (select distinct c_mktsegment as source from customer), t as (select source, unnest(['Mobile No', 'Mobile No.', 'FULL NAME', 'id', 'Other']) as header from s),
      m as (select *, trim(regexp_replace(regexp_replace(lower(header), '[_\\-./()\\[\\]:]', ' ', 'g'), '\\s+', ' ', 'g')) as n from t)
      select source, header, case when header in (select h from p) then (select f from p where p.h = m.header) when not bool_or(header in (select h from p)) over (partition by source, n) then (select f from p where p.n = m.n order by i limit 1) end as field from m"""
)
def remembered_headers(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source")).distinct().select("source", F.explode(F.array(*map(F.lit, _SEEN))).alias("header"))
    return headers.remembered(rows, _PROFILE)


@query("""select c_custkey, 'K' || cast(c_custkey as varchar) as student_id, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then 'Ann ' || c_mktsegment end as name, case when c_custkey % 2 = 0 then cast(c_acctbal as varchar) end as extra from customer""")
def mapped_records(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.create_map(
            F.lit("USN"), F.concat(F.lit("K"), "c_custkey"), F.lit("Name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit("")),
            F.lit("First"), F.when(F.col("c_custkey") % 3 == 1, F.lit(" Ann")), F.lit("Last"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")),
            F.lit("Balance"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")), F.lit("Blank"), F.lit(""),
        ).alias("fields"),
    )
    mapping = {"USN": "student_id", "Name": "name", "First": "first_name", "Last": "last_name"}
    done = headers.apply_mapping(rows, mapping, ["student_id", "name", "first_name", "last_name"])
    return done.select("c_custkey", "student_id", "name", F.try_element_at("attributes", F.lit("Balance")).alias("extra"))
