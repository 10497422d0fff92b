"""Wide sheets of marks, all sheets of all files at once, to one exam row for each student, course and exam.

Records (path, sheet, title, row_number, headers, fields) come from the readers of tables.  Each header is
one row with what can be read off it; counts of each column's cells join it, and the sheet is judged by
sums over its columns.  Only sheets that are surely of marks are unpivoted; the rest is left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import header
from .joins import stored

#: What headers, titles and names of sheets say (after header()); the best identifier first.
IDENTIFIERS = (
    r"\b(usn|regno)\b|\b(student|reg|register|registration)\s(id|no|number)\b|^(student id|id|sid)$",
    r"\broll\s(id|no|number)\b|^roll$",
    r"\bprn\b|\b(enrol+ment|admission)\s(id|no|number)\b",
)
STUDENT_NAME = r"^(students?(\ss)?\s)?name(\sof(\sthe)?\sstudent)?$"
ATTENDANCE = r"\battend|\batt(d|n|en)?\b|\bpresent\b|\babsent\b|\bclasses\b|\bconducted\b|\bheld\b"
GRADE_POINTS = r"\bcredits?\b(?!\s(based|system|scheme))|\bgrade\s?points?\b|\bgp\b|\bgpa\b"
GRADE_AVERAGE, PERCENT = r"\b[sc]?gpa\b", r"\bpercent|%"
SAYS_MARKS = r"\b(marks?|results?|scores?|grades?|sgpa|cgpa)\b"
PLAIN_SHEET = r"^((sheet|table|data|page|worksheet|tab)\s?\d*\s?)+$"
NO_COURSE = r"^([A-Z]{1,2}(19|20)\d\d|(SEM|BATCH|YEAR).*)$"
BRACKETED, BARE = r"^(.*?)\s*[(\[]\s*([A-Za-z0-9]{4,12})\s*[)\]]$", r"^(?:(.*)\s)?([A-Z0-9]{4,12})$"
GROUP = (
    r"(?i)^((?:external|internal|see|cie|ia|semester end|continuous internal)"
    r"(?:\s(?:marks?|exam|examination|assessment|evaluation|test))?(?:\s?-?\s?\d{1,2})?)(?:\s(.+))?$"
)
EXTERNAL = r"^(external|see|semester end)( marks?| exam| examination| evaluation)?$"
INTERNAL = r"^(internal|cie|ia|continuous internal)( marks?| assessment| evaluation| exam)?$"
EXAM_WORD = r"^(ia|cie|see|tests?|exams?|examinations?|assessments?|internals?|mid|midterms?|terms?|quiz(zes)?|assignments?)\d{0,2}$"
EXAM_QUALIFIER = (
    r"^(\d{1,2}|[1-9](st|nd|rd|th)|first|second|third|fourth|fifth|i{1,3}|iv|vi{0,3}"
    r"|final|unit|end|class|model|prelims?|preliminary|periodic|supplementary|annual|semester|sem)$"
)
GRACE = r"^(\d+(?:\.\d+)?)\s*(?:\+\s*(\d+(?:\.\d+)?))?\s*\*?$"
#: What a sheet of marks has at least (columns of courses, courses, the share of numbers in a column), and the highest mark and grade point.
LEAST_COLUMNS, LEAST_COURSES, LEAST_SHARE, MOST_MARK, MOST_POINT = 3, 2, 0.6, 200, 10
EXAM = "student_id string, student_name string, course_code string, course_name string, exam_name string, marks_obtained double, result_status string"
SHEET = ("path", "sheet")


@dataclass
class Marks:
    """exams: path, sheet, row_number, locator and the columns of EXAM; summary: one row for each sheet that was reshaped;
    columns: its columns of courses; skipped: its rows that name nobody and have no marks."""

    exams: DataFrame
    summary: DataFrame
    columns: DataFrame
    skipped: DataFrame


def is_empty(cell: Column) -> Column:
    """No mark: nothing but blanks, dots and dashes."""
    return F.coalesce(F.regexp_replace(cell, r"[\s.\-–—]", "") == "", F.lit(True))


def plain_number(cell: Column) -> Column:
    return F.when(F.trim(cell).rlike(r"^[-+]?\d+(\.\d+)?$"), F.trim(cell).try_cast("double"))


def mark_of(cell: Column) -> Column:
    """The mark of a cell: a number, or the total of one with grace marks (45+2 is 47, 40* is 40)."""
    base, grace = (F.regexp_extract(F.trim(cell), GRACE, i).try_cast("double") for i in (1, 2))
    return F.coalesce(plain_number(cell), base + F.coalesce(grace, F.lit(0.0)))


def course_of(text: Column) -> Column:
    """(label, code) of the header of a course, such as 'HRM (MBA201)' or 'MBA201'; null for others."""
    bare = F.trim(F.regexp_replace(text, r"\s\(\d+\)$", ""))
    pattern = F.when(bare.rlike(BRACKETED), F.lit(0)).when(bare.rlike(BARE), F.lit(1))
    part = lambda i: F.when(pattern == 0, F.regexp_extract(bare, BRACKETED, i)).when(pattern == 1, F.regexp_extract(bare, BARE, i))
    code = F.upper(part(2))
    enough = (F.regexp_count(code, F.lit("[A-Z]")) >= 2) & (F.regexp_count(code, F.lit("[0-9]")) >= 2) & ~code.rlike(NO_COURSE)
    return F.when(enough, F.struct(F.trim(part(1)).alias("label"), code.alias("code")))


def exam_phrase(text: Column) -> Column:
    """The words that name an exam ('FIRST INTERNAL ASSESSMENT', 'IA-2'): the first exam word with the exam words, ordinals and kinds around it."""
    words = F.filter(
        F.transform(F.split(text, r"[\s_]+"), lambda w: F.struct(F.regexp_replace(w, r"^[()\[\]{}.,:;-]+|[()\[\]{}.,:;-]+$", "").alias("word"), F.regexp_replace(F.lower(w), "[^a-z0-9]", "").alias("key"))),
        lambda w: w["key"] != "",
    )
    kinds = F.array_join(F.transform(words, lambda w: F.when(w["key"].rlike(EXAM_WORD), "E").when(w["key"].rlike(EXAM_QUALIFIER), "Q").otherwise("-")), "")
    found = F.regexp_extract(kinds, "([EQ]*E[EQ]*)", 1)
    start = F.regexp_instr(kinds, F.lit("[EQ]*E[EQ]*"))
    return F.when(found != "", F.substring(F.array_join(F.slice(F.transform(words, lambda w: w["word"]), start, F.length(found)), " "), 1, 60))


def _known_exam(group: Column) -> Column:
    plain = header(group)
    return F.when(plain.rlike(EXTERNAL), "SEE (External)").when(plain.rlike(INTERNAL), "CIE (Internal)").when(group != "", group)


def exam_name(group: Column, sheet: Column, title: Column, path: Column) -> Column:
    """The exam of a column: its group label, else what the sheet's name, the title or the file's name say, else the sheet's name, else Marks."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    phrase = F.coalesce(exam_phrase(sheet), exam_phrase(title), exam_phrase(stem))
    own = F.substring(F.trim(F.regexp_replace(sheet, r"\s+", " ")), 1, 60)
    return F.coalesce(_known_exam(group), _known_exam(phrase), F.when((header(own) != "") & ~header(own).rlike(PLAIN_SHEET), own), F.lit("Marks"))


def _letter(position: Column) -> Column:
    """A, B, ... Z, AA ... of a column's place from 0; sheets have 16384 columns at most."""
    letter = lambda n: F.chr(n + 65)
    one, two = position - 26, position - 702
    return (
        F.when(position < 26, letter(position)).when(position < 702, F.concat(letter(F.floor(one / 26)), letter(one % 26)))
        .otherwise(F.concat(letter(F.floor(two / 676)), letter(F.floor(two / 26) % 26), letter(two % 26)))
    )


def _tail(labels: Column) -> Column:
    """How many words at the end all labels of an array share, whatever their case."""
    words = F.transform(labels, lambda s: F.reverse(F.split(F.lower(F.trim(s)), r"\s+")))
    first = words[0]
    same = F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.forall(words, lambda w: F.coalesce(F.get(w, i) == F.get(first, i), F.lit(False))))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(first).cast("long"))


def _columns(records: DataFrame) -> DataFrame:
    """A row for each header of each sheet that names students: its place, what it says, and the columns of ids and names."""
    sheets = records.where("headers is not null").groupBy(*SHEET).agg(F.first("headers").alias("headers"), F.first(F.coalesce("title", F.lit(""))).alias("title"), F.count("*").alias("wide_rows"))
    said = F.transform("headers", lambda h: header(F.regexp_replace(h, r"\s\(\d+\)$", "")))
    first = lambda pattern, but=None: F.array_min(F.filter(F.transform(said, lambda s, i: F.when(s.rlike(pattern) & (F.lit(True) if but is None else (i != but)), i)), lambda i: i.isNotNull()))
    sheets = sheets.withColumn("id_at", F.coalesce(*map(first, IDENTIFIERS))).where("id_at is not null")
    sheets = sheets.withColumn("name_at", first(STUDENT_NAME, F.col("id_at")))
    get = lambda at: F.get("headers", F.col(at))
    return sheets.select(*SHEET, "title", "wide_rows", "id_at", "name_at", get("id_at").alias("id_header"), get("name_at").alias("name_header"), F.posexplode("headers").alias("at", "header"))


def _judged(columns: DataFrame, records: DataFrame) -> DataFrame:
    """Columns with the counts of their cells over rows that name a student, and the verdict on their sheet."""
    ids = columns.where("at = id_at").select(*SHEET, "id_header")
    cells = records.join(ids, [*SHEET]).where(~is_empty(F.col("fields")[F.col("id_header")])).select(*SHEET, F.posexplode("headers").alias("at", "_h"), "fields")
    cells = cells.select(*SHEET, "at", F.col("fields")[F.col("_h")].alias("cell")).where(~is_empty(F.col("cell")))
    mark = mark_of(F.col("cell"))
    counts = cells.groupBy(*SHEET, "at").agg(F.count("*").alias("filled"), F.count(mark).alias("numbers"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    over = Window.partitionBy(*SHEET)
    known = columns.join(counts, [*SHEET, "at"], "left").na.fill(0, ["filled", "numbers"])
    known = known.withColumn("course", F.when((F.col("at") != F.col("id_at")) & ~F.col("at").eqNullSafe(F.col("name_at")), course_of(F.col("header"))))
    later = over.orderBy("at")
    lost = F.col("course").isNotNull() & F.lead("header").over(later).rlike(r"^column_\d+$") & (F.lead("numbers").over(later) > 0)
    known = known.withColumns({"lost": F.coalesce(lost, F.lit(False)), "chosen": F.col("course").isNotNull() & (F.col("numbers") > 0) & (F.col("numbers") >= LEAST_SHARE * F.col("filled"))})
    plain, own, sheet, title = header(F.col("header")), F.col("chosen"), header(F.col("sheet")), header(F.col("title"))
    says = lambda pattern: sheet.rlike(pattern) | title.rlike(pattern)
    any_ = lambda c: F.coalesce(F.bool_or(c).over(over), F.lit(False))
    high = F.max(F.when(own, F.col("high"))).over(over)
    refused = (
        says(ATTENDANCE) | any_(plain.rlike(ATTENDANCE) & (F.col("filled") > 0)) | any_(F.col("lost"))
        | any_(own & F.lower("header").rlike(PERCENT)) | (F.min(F.when(own, F.col("low"))).over(over) < 0) | (high > MOST_MARK)
        | says(GRADE_POINTS) | any_(own & plain.rlike(GRADE_POINTS)) | ((high <= MOST_POINT) & (says(GRADE_AVERAGE) | any_(plain.rlike(GRADE_AVERAGE))))
    )
    enough = (F.count_if(own).over(over) >= LEAST_COLUMNS) & (F.size(F.collect_set(F.when(own, F.col("course.code"))).over(over)) >= LEAST_COURSES)
    marked = says(SAYS_MARKS) | any_(plain.rlike(SAYS_MARKS))
    return known.withColumns({"sheet_ok": enough & ~refused, "says_marks": marked})


def _named(known: DataFrame) -> DataFrame:
    """Columns of courses with group, subject and exam; sheets without any group label must say that they hold marks.

    A label such as EXTERNAL or CIE 1 groups where two columns have it.  Otherwise the words that all columns
    of one course share at the end are the subject, and what stands before them is the group.
    """
    chosen = known.where("sheet_ok and chosen").select("*", "course.label", "course.code")
    group = F.when(F.col("label").rlike(GROUP), F.regexp_extract("label", GROUP, 1))
    chosen = chosen.withColumns({"group": group, "_key": header(group)})
    chosen = chosen.withColumn("group", F.when(F.count("_key").over(Window.partitionBy(*SHEET, "_key")) >= 2, F.col("group")))
    of_course = Window.partitionBy(*SHEET, "code", F.col("group").isNull())
    labels = F.collect_list("label").over(of_course)
    words = F.split(F.trim("label"), r"\s+")
    shared = F.when(F.size(labels) > 1, _tail(labels)).otherwise(F.lit(0))
    chosen = chosen.withColumn("_shared", shared.cast("int"))
    front = F.array_join(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - F.col("_shared"))), " ")
    split = (F.col("_shared") > 0) & (front != "")
    named = chosen.withColumns({
        "subject": F.when(F.col("group").isNotNull(), F.trim(F.regexp_extract("label", GROUP, 2))).when(split, F.array_join(F.slice(words, -F.col("_shared"), F.col("_shared")), " ")).otherwise(F.col("label")),
        "group": F.coalesce("group", F.when(split, front), F.lit("")),
    })
    grouped = F.bool_or((F.col("group") != "") & F.col("group").rlike(GROUP) & (F.regexp_extract("group", GROUP, 2) == "")).over(Window.partitionBy(*SHEET))
    named = named.withColumn("grouped", grouped).where("grouped or says_marks")
    named = named.withColumn("exam", exam_name(F.col("group"), F.col("sheet"), F.col("title"), F.col("path")))
    again = F.row_number().over(Window.partitionBy(*SHEET, "code", "exam").orderBy("at"))
    return named.withColumn("exam", F.when(again > 1, F.concat("exam", F.lit(" ("), again, F.lit(")"))).otherwise(F.col("exam")))


def reshape_marks(records: DataFrame) -> Marks:
    """The exam rows of all wide sheets of marks among the records of read_tables(), and what was made of them.

    A sheet is one of marks if a header names students, three columns or more (of two courses or more) have a course
    code and mostly numbers up to 200, and it speaks of marks or groups its courses (EXTERNAL, CIE ...); a word
    of attendance, percentages, grade points or lost sub-headers rule it out.  A cell without a number is the result
    (AB), one with grace marks is both.  Rows without identifier are kept if they have marks.
    """
    records = stored(records.select(*SHEET, "row_number", "headers", "fields", "title"))  # read several times; files are opened once
    known = _judged(_columns(records), records)
    columns = _named(known)
    per_sheet = columns.groupBy(*SHEET).agg(
        F.first("id_header").alias("id_header"), F.first("name_header").alias("name_header"), F.first("wide_rows").alias("wide_rows"),
        F.array_sort(F.collect_list(F.struct("at", "header", "code", "subject", "exam"))).alias("courses"),
    )
    fields = F.col("fields")
    cell = F.transform("courses", lambda c: F.struct(c["at"].alias("at"), c["code"].alias("code"), c["subject"].alias("subject"), c["exam"].alias("exam"), fields[c["header"]].alias("cell")))
    cell = F.when(fields.isNotNull(), cell)  # the optimizer does not see what only a lambda refers to
    rows = records.join(per_sheet, [*SHEET]).select(*SHEET, "row_number", F.when(~is_empty(fields[F.col("id_header")]), fields[F.col("id_header")]).alias("student_id"), fields[F.col("name_header")].alias("student_name"), cell.alias("cells"))
    rows = rows.withColumn("some", F.exists("cells", lambda c: mark_of(c["cell"]).isNotNull()))
    kept, filled = rows.where("student_id is not null or some"), F.filter("cells", lambda c: ~is_empty(c["cell"]))
    long = kept.select(*SHEET, "row_number", "student_id", "student_name", F.explode(filled).alias("c"))
    long = long.select("*", mark_of(F.col("c.cell")).alias("marks"), plain_number(F.col("c.cell")).alias("plain"))
    exams = long.select(
        *SHEET, "row_number", F.concat(F.lit("sheet="), "sheet", F.lit(";row="), "row_number", F.lit(";col="), _letter(F.col("c.at"))).alias("locator"), "student_id", "student_name",
        F.col("c.code").alias("course_code"), F.nullif("c.subject", F.lit("")).alias("course_name"), F.col("c.exam").alias("exam_name"),
        F.col("marks").alias("marks_obtained"), F.when(F.col("plain").isNull(), F.trim("c.cell")).alias("result_status"),
    )
    n_filled, grace = F.size(filled), F.size(F.filter("cells", lambda c: mark_of(c["cell"]).isNotNull() & plain_number(c["cell"]).isNull()))
    is_kept = F.col("student_id").isNotNull() | F.col("some")
    counts = rows.groupBy(*SHEET).agg(
        F.sum(F.when(is_kept, n_filled).otherwise(0)).alias("exam_rows"), F.count_if(is_kept & (n_filled > 0)).alias("student_rows"), F.count_if(~is_kept).alias("skipped_rows"),
        F.count_if(is_kept & (n_filled == 0)).alias("rows_without_marks"), F.sum(F.when(is_kept, F.size("cells") - n_filled).otherwise(0)).alias("blank_mark_cells"),
        F.sum(F.when(is_kept, grace).otherwise(0)).alias("grace_mark_cells"),
    )
    used = F.transform("courses", lambda c: c["at"])
    out = known.join(per_sheet.select(*SHEET, used.alias("used")), [*SHEET]).where(~F.array_contains("used", F.col("at")) & (F.col("at") != F.col("id_at")) & ~F.col("at").eqNullSafe(F.col("name_at")))
    out = out.where(~F.col("header").rlike(r"^column_\d+$") | (F.col("filled") > 0)).groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "header"))), lambda c: c["header"]).alias("left_out_columns"))
    part = lambda c: F.array_distinct(F.transform("courses", lambda x: x[c]))
    summary = per_sheet.select(*SHEET, "wide_rows", "id_header", "name_header", part("exam").alias("exam_names"), part("code").alias("course_codes")).join(counts, [*SHEET]).join(out, [*SHEET], "left")
    summary = summary.withColumn("left_out_columns", F.coalesce("left_out_columns", F.array().cast("array<string>")))
    listed = columns.select(*SHEET, "at", "header", F.col("code").alias("course_code"), F.nullif("subject", F.lit("")).alias("course_name"), F.col("exam").alias("exam_name"))
    return Marks(exams, summary, listed, rows.where("student_id is null and not some").select(*SHEET, "row_number"))
