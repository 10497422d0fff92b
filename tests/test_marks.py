"""Headers of two rows, merged ranges, notes, and wide sheets of marks to exam rows."""

from millrace.operators.marks import EXAM, reshape_marks
from millrace.plans import ingest
from millrace.sources import tables

SUBJECTS = ["Botany (BS111)", "Zoology (BS112)", "Optics (BS113)"]
GROUPED = [
    ["BSc THIRD SEMESTER RESULT"],
    ["Sl. No", "USN No", "Name", *(f"EXTERNAL MARKS {s}" for s in SUBJECTS), *(f"INTERNAL MARKS {s}" for s in SUBJECTS), "Total", "Percentage"],
    [1, "9AB21BS001", "Asha", 61, 55, 70, 42, 38.5, 45, 311.5, 62.3],
    [2, "9AB21BS002", "Bela", "AB", 48, 52, 40, 35, "", 215, 43],
    [3, "9AB21BS003", "Chand", 30, "F", "45+2", 44, 41, 47, 228, 45.6],
    ["", "", "Prepared by the cell"],
]


def records(spark, *named):
    rows = []
    for i, (sheet, grid) in enumerate(named):
        rows += [(f"upload{i or ''}.csv", sheet, title, n, headers, fields) for n, headers, fields, title in tables.grid_records(grid)]
    return spark.createDataFrame(rows, "path string, sheet string, title string, row_number int, headers array<string>, fields map<string,string>")


def reshaped(spark, grid, sheet="3rd Sem"):
    return reshape_marks(records(spark, (sheet, grid)))


def test_grouped_columns_become_exam_rows(spark):
    found = reshaped(spark, GROUPED)
    rows = {(r.student_id, r.course_code, r.exam_name): r for r in found.exams.collect()}
    assert len(rows) == found.exams.count() == 17 and [f.split()[0] for f in EXAM.split(", ")] == found.exams.columns[4:]
    first = rows["9AB21BS001", "BS111", "SEE (External)"]
    assert (first.student_name, first.course_name, first.marks_obtained, first.result_status, first.locator, first.row_number) == ("Asha", "Botany", 61, None, "sheet=3rd Sem;row=3;col=D", 3)
    assert rows["9AB21BS001", "BS112", "CIE (Internal)"].locator.endswith("col=H") and rows["9AB21BS001", "BS112", "CIE (Internal)"].marks_obtained == 38.5
    absent, grace = rows["9AB21BS002", "BS111", "SEE (External)"], rows["9AB21BS003", "BS113", "SEE (External)"]
    assert (absent.marks_obtained, absent.result_status) == (None, "AB") and (grace.marks_obtained, grace.result_status) == (47, "45+2")
    s = found.summary.collect()[0]
    assert (s.wide_rows, s.exam_rows, s.student_rows, s.skipped_rows, s.blank_mark_cells, s.grace_mark_cells) == (4, 17, 3, 1, 1, 1)
    assert s.left_out_columns == ["Sl. No", "Total", "Percentage"] and s.exam_names == ["SEE (External)", "CIE (Internal)"] and s.course_codes == ["BS111", "BS112", "BS113"]
    assert [tuple(r) for r in found.skipped.collect()] == [("upload.csv", "3rd Sem", 6)]
    assert ("INTERNAL MARKS Optics (BS113)", "BS113", "Optics", "CIE (Internal)") in {tuple(r)[3:] for r in found.columns.collect()}


def test_plain_codes_repeats_and_rows_without_identifier(spark):
    plain = [["USN", "Student Name", "Botany (BS111)", "Zoology [BS112]", "BS113", "Botany (BS111)", "", "Result"], ["u1", "One", 61, 55, 70, 20, "", "PASS"], ["", "Nobody", 50, 48, 52, "–", "", "PASS"], ["u3", "Three", "", "-", "", "", "", ""], ["", "", "LJ", "HK", "SS"]]
    found = reshaped(spark, plain, "Sheet1")
    rows = {(r.student_id, r.course_code, r.exam_name): r for r in found.exams.collect()}
    assert len(rows) == 7 and rows["u1", "BS111", "Marks (2)"].marks_obtained == 20 and rows["u1", "BS113", "Marks"].course_name is None
    s = found.summary.collect()[0]
    assert (s.rows_without_marks, s.skipped_rows, s.blank_mark_cells) == (1, 1, 5) and s.left_out_columns == ["Result"]
    assert {r.student_id for r in found.exams.collect()} == {"u1", None}


def test_names_of_exams(spark):
    plain = ["Botany (BS111)", "Zoology (BS112)", "Optics (BS113)"]
    cases = [
        ("Marks", "", plain, "Marks"), ("IA-2", "Marks", plain, "IA-2"), ("Sheet1", "FIRST INTERNAL ASSESSMENT MARKS", plain, "FIRST INTERNAL ASSESSMENT"),
        ("results of march", "", plain, "results of march"), ("Internal marks", "", ["Internal Audit (BS111)", *plain[1:]], "CIE (Internal)"),
    ]
    students = [[f"u{i}", f"N {i}", 40, 50, 60] for i in range(3)]
    found = reshape_marks(records(spark, *((sheet, [[title], ["USN", "Name", *labels], *students]) for sheet, title, labels, _ in cases)))
    assert {(r.sheet, r.exam_name) for r in found.exams.collect()} == {(sheet, exam) for sheet, _, _, exam in cases}


def test_groups_from_what_columns_of_a_course_share(spark):
    grid = [["USN", "MID TERM Botany (BS111)", "FINAL Botany (BS111)", "MID TERM Optics (BS113)", "FINAL Optics (BS113)", "Total Marks"], ["u1", 10, 20, 30, 40, 100], ["u2", 11, 21, 31, 41, 104]]
    rows = {(r.course_name, r.exam_name) for r in reshaped(spark, grid, "Sheet1").exams.collect()}
    assert rows == {("Botany", "MID TERM"), ("Botany", "FINAL"), ("Optics", "MID TERM"), ("Optics", "FINAL")}


#: Sheets of attendance, of few courses, of words, of large numbers, of no word of marks, of grade points, of lost headers, of percentages and of credits.
OTHERS = [
    ("Attendance Aug", [["USN", "Name", *SUBJECTS], ["u1", "One", 85, 90, 72]]),
    ("Marks", [["Name", *SUBJECTS, "Total"], ["One", 85, 90, 72, 247]]),
    ("Marks", [["USN", "Name", *SUBJECTS[:2], "Total"], ["u1", "One", 85, 90, 175]]),
    ("Marks", [["USN", "Name", *SUBJECTS, "Total"], ["u1", "One", "AB", "CD", "EF", "GH"]]),
    ("Marks", [["USN", "Name", *SUBJECTS], ["u1", "One", 850, 900, 720]]),
    ("Sheet1", [["USN", "Name", *SUBJECTS], ["u1", "One", 85, 90, 72]]),
    ("Marks", [["USN", "Name", *SUBJECTS, "SGPA"], ["u1", "One", 8, 9, 7, 8.1]]),
    ("Marks", [["USN", "Name", "Botany (BS111)", "", "Zoology (BS112)", "Optics (BS113)"], ["u1", "One", 8, 9, 7, 8], ["u2", "Two", 8, 9, 7, 8]]),
    ("Marks", [["USN", "Name", *(f"{s[:-8]} % {s[-7:]}" for s in SUBJECTS)], ["u1", "One", 85, 90, 72]]),
    ("Credits", [["USN", "Name", *SUBJECTS], ["u1", "One", 4, 3, 4]]),
]


def test_other_sheets_are_left_alone(spark):
    found = reshape_marks(records(spark, *OTHERS, ("3rd Sem", GROUPED)))
    assert [r.path for r in found.summary.collect()] == [f"upload{len(OTHERS)}.csv"] and found.exams.count() == 17


def test_merged_headers_and_a_row_of_notes(spark):
    none = [None] * 2
    head = ["Sl. No", "USN No", "Name", "EXTERNAL MARKS", *none, "INTERNAL MARKS", *none, "Total", None, "Legend: AB means absent"]
    grid = [
        [None, "BSc THIRD SEMESTER RESULT"], head, [None, None, None, *SUBJECTS, *SUBJECTS, *none, None, "Pass - external filled"], [None, None, None, *["PQ", "RS", "TU"] * 2],
        *[[i, f"9AB21BS00{i}", f"Student {i}", *(40 + i + c for c in range(6)), 300 + i] for i in range(1, 5)],
    ]
    merges = ["B1:J1", "A2:A4", "B2:B4", "C2:C4", "D2:F2", "G2:I2", "J2:J4"]
    book = ingest.workbook({"3rd Sem": [[("", v) for v in row] for row in grid]}, merged={"3rd Sem": merges})
    found = tables.read_tables(spark.createDataFrame([("m.xlsx", book)], "path string, content binary"))
    rows = found.collect()
    assert [r.row_number for r in rows] == [5, 6, 7, 8] and rows[0].title == "BSc THIRD SEMESTER RESULT"
    assert rows[0].headers[:11] == ["Sl. No", "USN No", "Name", *(f"EXTERNAL MARKS {s}" for s in SUBJECTS), *(f"INTERNAL MARKS {s}" for s in SUBJECTS), "Total", "column_11"]
    marks = reshape_marks(found)
    assert marks.exams.count() == 24 and {r.exam_name for r in marks.exams.collect()} == {"SEE (External)", "CIE (Internal)"}


def test_notes_and_absence(spark):
    under = lambda *row: [r[0] for r in tables.grid_records([["USN", "Botany (BS111)", "Optics (BS113)"], list(row), ["u1x", "5", "6"], ["u2x", "7", "8"]])]
    assert under("", "PQ", "RS") == [3, 4] and under("", "AB", "A") == [2, 3, 4] and under("u0x", "PQ", "RS") == [2, 3, 4] and under("", "PQ", "9") == [2, 3, 4]
    days = [["Register"], ["USN", "1", "2", "3"], ["u1x", "P", "A", "P"], ["u2x", "A", "A", "P"]]
    assert [(n, h) for n, h, _, _ in tables.grid_records(days)] == [(3, ["USN", "1", "2", "3"]), (4, ["USN", "1", "2", "3"])]
    years = [["Town", "2023", "2024"], ["Aa", "ten", "few"], ["Bb", "ten", "low"]]
    assert [h for _, h, _, _ in tables.grid_records(years)][0] == ["Town", "2023", "2024"]


def test_files_are_opened_once_for_all_that_is_made_of_them(spark):
    opened = spark.sparkContext.accumulator(0)
    records = tables.read_tables(ingest._marks_books(spark, "/root/testdata/sf0.001"))

    def counted(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    seen = records.mapInArrow(counted, records.schema)
    found = reshape_marks(seen)
    assert found.exams.count() and found.summary.count() and opened.value == records.count()
