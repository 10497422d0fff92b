"""Records cleaned by kind of field, with their notes and issues."""

from pyspark.sql import functions as F

from millrace.functions import clean

FIELDS = {"name": "string", "program": "string", "semester": "integer", "due_date": "date", "student_id": "identifier", "status": "string", "paid": "boolean"}


def test_records_say_what_was_put_right(spark):
    rows = [
        ("  anna LEE", "45%", "Sem III", "5/3/2024", "1ms 1", "ACTIVE", "yes"),
        ("N/A", "m.b.a.", "eleventh", "2024-03-05", "A1", "paid", "maybe"),
        (None, None, None, "13/13/2024", " ", "--", None),
    ]
    made = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in FIELDS)).select(*clean.clean_record(FIELDS)).collect()
    plain = [(*r[:7], r.notes, [(i.field, i.code, i.severity, i.value) for i in r.issues]) for r in made]
    assert plain[0] == (
        "anna LEE", None, "3", "2024-03-05", "1MS 1", "active", "true", ["name:whitespace", "semester:semester_parsed", "due_date:date_parsed", "student_id:identifier_case", "status:case", "paid:boolean_parsed"],
        [("program", "numeric_program", "warning", "45%"), ("due_date", "ambiguous_date_day_month", "info", "5/3/2024")],
    )
    assert plain[1] == (
        None, "MBA", None, "2024-03-05", "A1", "paid", None, ["name:placeholder_to_empty", "program:program_alias"],
        [("semester", "invalid_semester", "warning", "eleventh"), ("paid", "invalid_boolean", "warning", "maybe")],
    )
    assert plain[2] == (None, None, None, None, None, None, None, ["student_id:whitespace", "status:placeholder_to_empty"], [("due_date", "invalid_date", "warning", "13/13/2024")])


def test_identifiers_with_confused_letters(spark):
    rows = spark.createDataFrame([("1MS23MBA001",), ("IMS2OMBAOO1",), ("1MSXXMBA001",), ("short",)], "x string")
    got = [r[0] for r in rows.select(clean.likely_identifier(F.col("x"), F.lit("9AA99AAA999"))).collect()]
    assert got == [None, "1MS20MBA001", None, None]
