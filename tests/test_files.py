"""Sinks and sources of files, written and read again."""

from pyspark.sql import types as T

from millrace.sources import forms, reports


def test_report_cells_cannot_start_a_formula(spark, tmp_path):
    rows = spark.createDataFrame(
        [("=1+1", -2.5, True), ("+919876543210", 3.0, False), ("\tx", None, None), (None, 0.126, True)], "a string, b double, c boolean"
    )
    got = [tuple(r) for r in reports.safe_rows(rows).collect()]
    assert got == [("'=1+1", "-2.5", "Yes"), ("+919876543210", "3", "No"), ("'\tx", "", ""), ("", "0.13", "Yes")]
    reports.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4


def test_zero_and_tens_keep_their_digits(spark):
    rows = spark.createDataFrame([(100.0,), (0.0,), (20.5,)], "b double")
    assert [r[0] for r in reports.safe_rows(rows).collect()] == ["100", "0", "20.5"]


def test_tsv_has_one_line_a_row(spark, tmp_path):
    reports.write_tsv(spark.createDataFrame([("a\tb\r\nc", 1)], "a string, n int"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()] == [("a b c", "1")]


def test_seeds(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("name\tnames\n# a comment\nX\ta | b||\nY\t\n")
    schema = T.StructType.fromDDL("name string, names string")
    got = forms.read_seeds(spark, str(tmp_path / "s.tsv"), schema, ("names",)).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("X", ["a", "b"]), ("Y", [])]


def test_form_fields_of_nothing(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "ab: 1\r\nAB: 2\nhttp: //x\nhttp://y\na: 5")], "k int, t string")
    assert [tuple(r) for r in forms.key_values(texts, "k", "t").collect()] == [(3, "ab", "1", 1), (3, "http", "//x", 3)]


def test_reports_by_kind(spark, tmp_path):
    import pytest

    from millrace.operators.filters import page_size
    from millrace.sources import reports

    rows = spark.createDataFrame([(1, "a\tb"), (2, "=1+1")], "k int, v string").coalesce(1)
    for kind in ("csv", "tsv", "json"):
        reports.write_report(rows, f"{tmp_path}/{kind}", kind)
    read = lambda kind: sorted(line for r in spark.read.text(f"{tmp_path}/{kind}").collect() for line in [r.value])
    assert "2,'=1+1" in read("csv") and "1\ta b" in read("tsv") and '{"k":2,"v":"=1+1"}' in read("json")
    with pytest.raises(ValueError):
        reports.write_report(rows, f"{tmp_path}/x", "pdf")
    assert [page_size(x) for x in (None, 0, 7, 9999)] == [100, 1, 7, 500]


def test_seed_sheets(spark, tmp_path):
    from millrace.sources import forms

    (tmp_path / "e.tsv").write_text("# map\nname\tkind\tparent\tnames\tlocations\nBGS\tcollege\tMath\tA | B|\t Mandya\n\tx\t\t\t\n")
    assert [tuple(r) for r in forms.seed_sheet(spark, str(tmp_path / "e.tsv"), "entities").collect()] == [("BGS", "institution", "Math", ["A", "B"], ["Mandya"])]
    (tmp_path / "s.tsv").write_text("\t".join(forms.SHEETS["sweep"]) + "\ng\tBGS\tcollege\t\tsite\thttp://a.org\tA\tofficial\t\ng\tBGS\tcollege\t\tsite\thttp://b.org\tQ\tofficial\t\n")
    assert [(r.url, r.problem) for r in forms.seed_sheet(spark, str(tmp_path / "s.tsv"), "sweep").collect()] == [("http://a.org", None), ("http://b.org", "unknown claimed grade Q")]
