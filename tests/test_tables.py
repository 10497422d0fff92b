"""Files: encodings, header rows, workbooks, documents, damaged files, and a database."""

import io
import zipfile

import pytest

from millrace.plans import ingest
from millrace.sources import databases, tables


def read(spark, **files):
    made = spark.createDataFrame([(n.replace("_", "."), c) for n, c in files.items()], "path string, content binary")
    return tables.read_tables(made).collect()


def test_header_rows_and_their_groups():
    grid = [["Marks of the second semester"], [], ["USN", "Name", "Internal", "", "External", ""], ["", "", "IA1", "IA2", "Theory", "Total"], ["1MS1", "Ann", "20", "21", "60", "80"], ["1MS2", "Bob", "", "19", "55", "70"]]
    rows = list(tables.grid_records(grid))
    names = ["USN", "Name", "Internal IA1", "Internal IA2", "External Theory", "External Total"]
    assert rows[0] == (5, names, dict(zip(names, ["1MS1", "Ann", "20", "21", "60", "80"])), "Marks of the second semester")
    one = [["USN", "Name", "External"], ["", "", "Total"], ["1MS1", "Ann", "60"]]  # under a label of one column there are no others
    assert [h for _, h, _, _ in tables.grid_records(one)][0] == ["USN", "Name", "External"]
    assert tables.distinct_headers(["a", "", "a", "a"]) == ["a", "column_2", "a (2)", "a (3)"]
    assert tables.header_row([["1", "2"], ["3", "4"]]) is None and tables.text_grid("a  b\nc\n") is None


def test_delimiters_and_encodings():
    assert tables.delimiter("a;b;c\n1,5;2;3\n4;5;6") == ";" and tables.delimiter("a|b\n1|2") == "|" and tables.delimiter("word") == ","
    assert tables.decoded("é,ü".encode("cp1252")) == ("é,ü", "cp1252") and tables.decoded("﻿a".encode())[0] == "a" and tables.decoded("a,b".encode("utf-16"))[1] == "utf-16"


def test_workbooks_documents_and_what_is_no_table(spark):
    book = ingest.workbook({"s": [[("", "Id"), ("", "Rate"), ("", "On")], [("", 1), ("percent", 0.005), ("date", 45000.5)]], "h": [[("", "x"), ("", "y")], [("", "1"), ("", "2")]]}, ("h",))
    paper = ingest.document(["Intro", "More"], [["Key", "Value"], ["a", "1"]])
    bomb = ingest.archive({"xl/workbook.xml": "0" * 300_000_000})
    got = {r.path: r for r in read(spark, b_xlsx=book, d_docx=paper, x_xlsx=b"PK\x03\x04broken", bomb_xlsx=bomb, e_csv=b"", p_pdf=b"%PDF-1", j_json=b'[{"a": 1, "b": null}, 5]', t_txt=b"just words")}
    assert got["b.xlsx"].fields == {"Id": "1", "Rate": "0.5%", "On": "2023-03-15T12:00:00"} and got["b.xlsx"].sheet == "s"
    assert got["d.docx"].fields == {"Key": "a", "Value": "1"} and got["j.json"].fields == {"a": "1", "b": None}
    assert got["e.csv"].problem == "empty file" and got["p.pdf"].problem == "no reader for pdf" and got["t.txt"].problem == "no table" and got["x.xlsx"].problem and "inflates" in got["bomb.xlsx"].problem
    made = spark.createDataFrame([("d", paper)], "path string, content binary")
    assert [r.passage for r in tables.section(tables.document_passages(made), "d", 0, 9).collect()] == ["Intro\nMore Key: a | Value: 1"]


def test_tables_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(50).selectExpr("id", "id * 2 as twice").write.format("jdbc").options(url=url, dbtable="numbers", **options).save()
    except Exception as error:  # no such driver here
        pytest.skip(str(error)[:80])
    assert databases.fetch_table(spark, url, "numbers", key="id", **options).selectExpr("sum(twice)").first()[0] == 2450
    assert databases.fetch_table(spark, url, "numbers", limit=3, **options).count() == 3
    names = databases.list_tables(spark, url, "select tablename from sys.systables where tabletype = 'T'", **options)
    assert [r[0] for r in names.collect()] == ["NUMBERS"]
    with pytest.raises(ValueError):
        databases.fetch_table(spark, url, "numbers; drop table numbers")


def test_packed_bytes_of_a_document_may_spell_the_folder_of_workbooks(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as made, zipfile.ZipFile(io.BytesIO(ingest.document(["about xl/ folders"], [["Key", "Value"], ["a", "1"]]))) as packed:
        for name in packed.namelist():
            made.writestr(name, packed.read(name))
    paper, book = out.getvalue(), ingest.workbook({"s": [[("", "word/"), ("", "On")], [("", 1), ("", 2)]]})
    assert b"xl/" in paper and tables.kind_of("d", paper) == "docx" and tables.kind_of("b", book) == "xlsx"
    made = spark.createDataFrame([("d", paper), ("b", book)], "path string, content binary")
    assert [(r.path, r.kind, r.problem) for r in tables.read_tables(made).orderBy("path").collect()] == [("b", "xlsx", None), ("d", "docx", None)]
