from millrace.operators import headers
from millrace.plans import mapping
from millrace.plans.files import _FIELDS, _HEADERS


def test_headers_find_their_fields(spark):
    rows = spark.createDataFrame([("t", h) for h in _HEADERS], "source string, header string")
    got = {r.header: r for r in headers.proposals(headers.scores(rows, _FIELDS)).collect()}
    assert (got["Student_Name"].field, got["Student_Name"].score) == ("student_name", 1.0)
    assert (got["PROGRAMME"].field, got["PROGRAMME"].score, got["PROGRAMME"].conflict) == ("program", 0.97, False)
    assert (got["Prog"].field, got["Prog"].conflict) == ("program", True)
    assert got["Semster"].field == "semester" and 0.8 < got["Semster"].score <= 0.9
    assert (got["Total Classes"].field, got["Present"].field) == ("classes_held", "classes_attended")
    assert got["Classes"].ambiguous and got["Classes"].score <= 0.75
    assert "Remarks" not in got and "  " not in got


def test_tables_tell_what_they_hold(spark):
    got = {r.source: (r.entity, r.confidence) for r in headers.detect_entity(mapping.sheet_headers(spark), mapping.ENTITIES).collect()}
    assert {s: e for s, (e, _) in got.items()} | {"e": None} == {"a": "student", "b": "attendance", "c": "fee", "d": "exam", "e": None}
    assert all(c > 0.6 for s, (_, c) in got.items() if s != "e") and "e" in got


def test_samples_speak_for_and_against_fields(spark):
    rows = spark.createDataFrame([("t", "Contact"), ("t", "Course")], "source string, header string")
    samples = spark.createDataFrame([("t", "Contact", i, f"a{i}@b.co") for i in range(9)] + [("t", "Course", i, str(i)) for i in range(9)], "source string, header string, row int, value string")
    student = mapping.ENTITIES["student"]
    got = {(r.header, r.field): r.score for r in headers.scores(rows, student.names, shapes=headers.value_shapes(samples), kinds=student.fields).collect()}
    assert got["Contact", "phone"] == 0.67 and got["Course", "program"] == 0.37  # 0.97 less 0.3 for addresses, 0.97 less 0.6 for numbers


def test_a_weaker_header_takes_its_next_free_field(spark):
    scored = [("t", "A", "x", 0.97), ("t", "A", "y", 0.5), ("t", "B", "x", 0.9), ("t", "B", "y", 0.7), ("t", "C", "x", 0.8), ("t", "C", "y", 0.6)]
    got = {r.header: (r.field, r.score, r.conflict) for r in headers.proposals(spark.createDataFrame(scored, "source string, header string, field string, score double")).collect()}
    assert got == {"A": ("x", 0.97, False), "B": ("y", 0.7, False), "C": ("x", 0.8, True)}
