"""Files of several kinds, made from the driver's rows, and what their readers find in them."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..operators import marks
from ..sources import office, tables
from .registry import query
from .roles import shared_folder, table

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        for name, text in parts.items():
            made.writestr(name, text)
    return out.getvalue()


def workbook(sheets: dict[str, list[list[tuple[str, object]]]], hidden: tuple[str, ...] = (), merged: dict[str, list[str]] | None = None) -> bytes:
    """A workbook of cells (style, value); styles: '' general, 'date', 'percent'."""
    styles = {"": 0, "date": 1, "percent": 2}
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"{" state=%shidden%s" % (chr(34), chr(34)) if n in hidden else ""}/>' for i, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>",
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs></styleSheet>',
    }
    for i, (name, rows) in enumerate(sheets.items()):
        cell = lambda at, s, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}" s="{styles[s]}"><v>{v}</v></c>'
        body = "".join(f'<row r="{y}">' + "".join(cell(f"{chr(65 + x)}{y}", s, v) for x, (s, v) in enumerate(row) if v is not None) + "</row>" for y, row in enumerate(rows, 1))
        ranges = "".join(f'<mergeCell ref="{r}"/>' for r in (merged or {}).get(name, []))
        parts[f"xl/worksheets/s{i}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData>{ranges}</worksheet>'
    return archive(parts)


def document(paragraphs: list[str], rows: list[list[str]]) -> bytes:
    said = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(map(said, paragraphs)) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{said(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    return archive({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'})


def _made(make, *columns: pa.Array) -> pa.Array:
    """A file of each row, one in hand at a time."""
    return pa.array((make(*(x.as_py() for x in row)) for row in zip(*columns, strict=True)), pa.binary())


@arrow_udf(T.BinaryType())
def workbooks(ids: pa.Array, names: pa.Array, balances: pa.Array) -> pa.Array:
    head = [("", "Id"), ("", "Name"), ("", "Joined"), ("", "Share")]

    def one(*rows) -> bytes:
        return workbook({"main": [[("", "List")], [], head, *([("", int(i)), ("", n), ("date", 45000 + int(i) % 100), ("percent", 0.25)] for i, n, _ in zip(*rows, strict=True))], "secret": [head, head]}, ("secret",))

    return _made(one, ids, names, balances)


@arrow_udf(T.BinaryType())
def documents(ids: pa.Array, names: pa.Array) -> pa.Array:
    return _made(lambda *rows: document(["A list of customers", "as of today"], [["Id", "Name"], *([str(i), n] for i, n in zip(*rows, strict=True))]), ids, names)


#: Customers of a file at most; c_custkey div that is the number of the file of a nation.
FILE_ROWS = 500


def _by_nation(spark, sf):
    """(c_nationkey, file, rows): files of a nation's customers, of bounded size."""
    files = table(spark, sf, "customer").withColumn("file", F.concat_ws("-", "c_nationkey", F.expr(f"c_custkey div {FILE_ROWS}")))
    return files.groupBy("c_nationkey", "file").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("rows"))


def _nation(path):
    return F.regexp_extract(path, r"(\d+)-\d+", 1).cast("int")


_PLACES = "r as (select c_nationkey, c_custkey, c_name, c_acctbal, cast(row_number() over (partition by c_nationkey, c_custkey // 500 order by c_custkey) as integer) as n, count(*) over (partition by c_nationkey, c_custkey // 500) as size from customer)"


def _lines(separator: str):
    line = lambda r: F.concat_ws(separator, r["c_custkey"].cast("string"), F.concat(F.lit('"'), r["c_name"], F.lit('"')), r["c_acctbal"].cast("string"))
    return F.array_join(F.transform("rows", line), "\n")


@query(f"with {_PLACES} select 'file' || cast(c_nationkey as varchar) as path, n + 3 as row_number, cast(c_custkey as varchar) as id, c_name as name, cast(c_acctbal as double) as balance from r")
def csv_tables(spark, sf):
    """Files with a title, an empty line and a header, in three encodings and with two delimiters."""
    made = _by_nation(spark, sf)
    body = lambda s: F.concat(F.lit(f"Customers of a nation\n\nCustomer id{s}Full name{s}Balance\n"), _lines(s))
    content = F.when(F.col("c_nationkey") % 3 == 0, F.encode(body(";"), "UTF-16")).when(F.col("c_nationkey") % 3 == 1, F.encode(body(","), "UTF-8")).otherwise(F.encode(body("\t"), "ISO-8859-1"))
    found = tables.read_tables(made.select(F.concat(F.lit("file"), "file", F.lit(".csv")).alias("path"), content.alias("content")))
    f = F.col("fields")
    return found.select(F.concat(F.lit("file"), _nation("path")).alias("path"), "row_number", f["Customer id"].alias("id"), f["Full name"].alias("name"), f["Balance"].cast("double").alias("balance"))


@query(f"with {_PLACES} select c_nationkey, n as row_number, cast(c_custkey as varchar) as id, c_name as name from r")
def json_tables(spark, sf):
    made = _by_nation(spark, sf).select(F.concat("file", F.lit(".json")).alias("path"), F.to_json(F.struct(F.lit("x").alias("note"), "rows")).cast("binary").alias("content"))
    found = tables.read_tables(made)
    return found.select(_nation("path").alias("c_nationkey"), "row_number", F.col("fields")["c_custkey"].alias("id"), F.col("fields")["c_name"].alias("name"))


@query(f"with {_PLACES} select c_nationkey, n + 2 as row_number, cast(c_custkey as varchar) as id, c_name as name from r where size >= 2")
def text_tables(spark, sf):
    """Columns of plain text, set apart by wide blanks; two lines are not yet a table."""
    line = lambda r: F.concat_ws("   ", r["c_custkey"].cast("string"), r["c_name"], F.lit("active"))
    body = F.concat(F.lit("A plain report\nId   Name   State\n"), F.array_join(F.transform("rows", line), "\n"))
    found = tables.read_tables(_by_nation(spark, sf).select(F.concat("file", F.lit(".txt")).alias("path"), body.cast("binary").alias("content"))).where("problem is null")
    return found.select(_nation("path").alias("c_nationkey"), "row_number", F.col("fields")["Id"].alias("id"), F.col("fields")["Name"].alias("name"))


@query(f"with {_PLACES} select c_nationkey, 'main' as sheet, n + 3 as row_number, cast(c_custkey as varchar) as id, c_name as name, cast(date '1899-12-30' + cast(45000 + c_custkey % 100 as integer) as date) as joined, '25' as share from r")
def workbook_tables(spark, sf):
    """Workbooks with a title, a hidden sheet, dates and percentages."""
    part = lambda c: F.transform("rows", lambda r: r[c])
    made = _by_nation(spark, sf).select(F.col("file").alias("path"), workbooks(part("c_custkey"), part("c_name"), part("c_acctbal")).alias("content"))
    f = F.col("fields")
    return tables.read_tables(made).select(_nation("path").alias("c_nationkey"), "sheet", "row_number", f["Id"].alias("id"), f["Name"].alias("name"), f["Joined"].cast("date").alias("joined"), f["Share"].alias("share"))


@query(f"with {_PLACES} select c_nationkey, 'table_1' as sheet, n + 1 as row_number, cast(c_custkey as varchar) as id, c_name as name from r")
def document_tables(spark, sf):
    part = lambda c: F.transform("rows", lambda r: r[c])
    made = _by_nation(spark, sf).select(F.col("file").alias("path"), documents(part("c_custkey"), part("c_name")).alias("content"))
    return tables.read_tables(made).select(_nation("path").alias("c_nationkey"), "sheet", "row_number", F.col("fields")["Id"].alias("id"), F.col("fields")["Name"].alias("name"))


_KINDS = {
    "x.pdf": "text", "a.bin": "%PDF-1.4", "b": "{\"a\": 1}", "c": "a\tb\n", "d": "a,b\n", "e": "plain words", "f.tsv": "x", "g.JSON": "x", "h.png": "x", "i": " ", "j.unknown": "a,b\tc\t", "k.md": "x", "l.docx": "x", "m": "BM rest", "n": "[1]",
}


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"


_DEALT = f"select c_custkey, ([{', '.join(map(_sql, _KINDS))}])[cast(c_custkey % {len(_KINDS)} as integer) + 1] as path, ([{', '.join(map(_sql, _KINDS.values()))}])[cast(c_custkey % {len(_KINDS)} as integer) + 1] as t from customer"


@query(
    f"""with f as ({_DEALT}), e as (select *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as x from f)
      select c_custkey, case when starts_with(t, '%PDF') then 'pdf' when starts_with(t, 'BM') then 'image' when x in ('csv', 'tsv', 'xls', 'docx', 'pdf', 'json', 'xlsx') then x when x in ('txt', 'md') then 'text'
        when x in ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp') then 'image' when x = 'xlsm' then 'xlsx' when trim(t) = '' then 'unknown' when regexp_matches(ltrim(t), '^[{{\\[]') then 'json'
        when contains(t, chr(9)) and length(t) - length(replace(t, chr(9), '')) >= length(t) - length(replace(t, ',', '')) then 'tsv' when contains(t, ',') then 'csv' else 'text' end as kind from e"""
)
def file_kinds(spark, sf):
    at = (F.col("c_custkey") % len(_KINDS) + 1).cast("int")
    rows = table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, _KINDS)), at).alias("path"), F.element_at(F.array(*map(F.lit, _KINDS.values())), at).cast("binary").alias("content"))
    return rows.select("c_custkey", tables.file_kind(F.col("path"), F.col("content")).alias("kind"))


@query("""select c_nationkey, 'c' || cast(c_custkey as varchar) as title, 'http://a.org/' || cast(c_custkey as varchar) as link, '2024-01-01' as published from customer where c_nationkey % 3 < 2""")
def feed_items(spark, sf):
    rss = lambda r: F.concat(F.lit("<item><title>c"), r["c_custkey"], F.lit("</title><link>http://a.org/"), r["c_custkey"], F.lit("</link><pubDate>2024-01-01</pubDate></item>"))
    atom = lambda r: F.concat(F.lit("<entry><title>c"), r["c_custkey"], F.lit('</title><link href="http://a.org/'), r["c_custkey"], F.lit('"/><updated>2024-01-01</updated></entry>'))
    items = lambda f: F.array_join(F.transform("rows", f), "")
    kind = F.col("c_nationkey") % 3
    xml = (
        F.when(kind == 0, F.concat(F.lit("<rss><channel><title>t</title>"), items(rss), F.lit("</channel></rss>")))
        .when(kind == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), items(atom), F.lit("</feed>")))
        .otherwise(F.concat(F.lit("<!DOCTYPE rss><rss>"), items(rss), F.lit("</rss>")))
    )
    return tables.feed_items(_by_nation(spark, sf).select("c_nationkey", xml.alias("xml")), "c_nationkey", "xml")


@query("""with g as (select c_nationkey % 2 = 0 as even, case when c_nationkey % 2 = 0 then 'balance|id|name' else 'balance|customer id|full name' end as signature from customer group by 1, 2) select distinct signature from g""")
def sheet_signatures(spark, sf):
    """Tables whose headers are the same in any order are one group."""
    head = F.when(F.col("c_nationkey") % 4 == 0, "Id,Name,Balance\n").when(F.col("c_nationkey") % 2 == 0, "Balance,NAME,id\n").otherwise("Customer id,Full name,Balance\n")
    made = _by_nation(spark, sf).select(F.concat("file", F.lit(".csv")).alias("path"), F.concat(head, _lines(",")).cast("binary").alias("content"))
    return tables.sheet_groups(tables.read_tables(made)).select("signature").distinct()


#: Orders as a sheet of marks: three courses with two kinds of marks each, made of the keys, and what else a sheet holds.
_COURSES = ("Accounts (MB101)", "Economics (MB102)", "Statistics (MB103)")
_EXAM_SQL = """x as (select o_orderkey, i, o_orderkey // 2000 as sheet, row_number() over (partition by o_orderkey // 2000, i order by o_orderkey) + 4 as row_number, (o_orderkey * (i + 3) + o_custkey) % 90 as n,
      case when o_orderkey % 7 = 0 and i = 3 then 'blank' when o_orderkey % 7 = 1 and i = 1 then 'absent' when o_orderkey % 7 = 2 and i = 5 then 'grace' else '' end as kind from orders, (select unnest(range(1, 7)) as i)),
  e as (select 'Batch ' || cast(sheet as varchar) as sheet, cast(row_number as integer) as row_number, 'U' || cast(o_orderkey as varchar) as student_id, 'Student ' || cast(o_orderkey as varchar) as student_name,
      'MB10' || cast((i - 1) % 3 + 1 as varchar) as course_code, (['Accounts', 'Economics', 'Statistics'])[(i - 1) % 3 + 1] as course_name, case when i <= 3 then 'SEE (External)' else 'CIE (Internal)' end as exam_name,
      case kind when 'absent' then null when 'grace' then n + 2.0::double else n::double end as marks_obtained, case kind when 'absent' then 'AB' when 'grace' then cast(n as varchar) || '+2' end as result_status,
      'sheet=Batch ' || cast(sheet as varchar) || ';row=' || cast(row_number as varchar) || ';col=' || chr(cast(67 + i as integer)) as locator
    from x where kind <> 'blank')"""


def _marks_books(spark, sf):
    """(path, content): a workbook for each two thousand order keys; a title, two rows of headers with merged groups, a row of initials, and the orders as students."""

    def cell(i: int):
        n, seventh = F.expr(f"(o_orderkey * {i + 3} + o_custkey) % 90").cast("string"), F.col("o_orderkey") % 7
        odd = {3: F.when(seventh == 0, ""), 1: F.when(seventh == 1, "AB"), 5: F.when(seventh == 2, F.concat(n, F.lit("+2")))}
        return odd[i].otherwise(n) if i in odd else n

    orders = table(spark, sf, "orders").select(F.expr("o_orderkey div 2000").alias("sheet"), F.struct("o_orderkey", *(cell(i).alias(f"m{i}") for i in range(1, 7))).alias("row"))
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sheet")  # packed marks are small, books are not
    sheets = orders.groupBy("sheet").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # two thousand at most
    return sheets.select(F.concat("sheet", F.lit(".xlsx")).alias("path"), marks_books("sheet", F.transform("rows", lambda r: F.array(r["o_orderkey"].cast("string"), *(r[f"m{i}"] for i in range(1, 7))))).alias("content"))


@arrow_udf(T.BinaryType())
def marks_books(sheets: pa.Array, rows: pa.Array) -> pa.Array:
    text = lambda row: [("", v) for v in row]
    head = [["Result of the examination"], ["Sl. No", "USN", "Name", "EXTERNAL MARKS", None, None, "INTERNAL MARKS", None, None, "Remarks"], [None, None, None, *_COURSES, *_COURSES], [None, None, None, *["PQ", "RS", "TU"] * 2]]
    merges = ["A1:J1", "A2:A4", "B2:B4", "C2:C4", "D2:F2", "G2:I2", "J2:J4"]
    number = lambda v: int(v) if v.isdigit() else v or None

    def one(n, students) -> bytes:
        body = [[i, f"U{r[0]}", f"Student {r[0]}", *map(number, r[1:])] for i, r in enumerate(students, 1)]
        return workbook({f"Batch {n}": [text(r) for r in [*head, *body]]}, merged={f"Batch {n}": merges})

    return _made(one, sheets, rows)


@query(f"with {_EXAM_SQL} select sheet, row_number, locator, student_id, student_name, course_code, course_name, exam_name, marks_obtained, result_status from e")
def marks_sheets(spark, sf):
    """Exam rows of sheets with one column for each course and kind of marks."""
    return marks.reshape_marks(tables.read_tables(_marks_books(spark, sf))).exams.drop("path")


@query(f"""with {_EXAM_SQL}, w as (select 'Batch ' || cast(o_orderkey // 2000 as varchar) as sheet, count(*) as wide_rows from orders group by 1)
  select sheet, count(*) as exam_rows, count(distinct student_id) as student_rows, 6 * any_value(wide_rows) - count(*) as blank_mark_cells, count(*) filter (where result_status <> 'AB') as grace_mark_cells,
  any_value(wide_rows) as wide_rows, 'CIE (Internal)|SEE (External)' as exams, 'MB101|MB102|MB103' as courses, 'Sl. No|Remarks' as left_out from e join w using (sheet) group by sheet""")
def marks_summary(spark, sf):
    """What was made of each sheet of marks."""
    found = marks.reshape_marks(tables.read_tables(_marks_books(spark, sf))).summary
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return found.select("sheet", "exam_rows", "student_rows", "blank_mark_cells", "grace_mark_cells", "wide_rows", joined("exam_names").alias("exams"), joined("course_codes").alias("courses"), F.array_join("left_out_columns", "|").alias("left_out"))


@query("select c_custkey, c_name as name, cast(round(c_acctbal, 2) as double) as balance, case when c_acctbal > 0 then 'TRUE' else 'FALSE' end as active from customer")
def workbook_reports(spark, sf):
    """Customers written as workbooks, one for each task, and read again, each workbook or sheet in a partition of its own."""
    path = f"{shared_folder(spark)}/workbooks-{uuid.uuid4().hex}"
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("balance"), (F.col("c_acctbal") > 0).alias("active"))
    office.write_office(rows, path, "xlsx", "Customers")
    f = F.col("fields")
    read = spark.read.format("tables").load(path).where("sheet = 'Customers'")
    return read.select(f["c_custkey"].cast("long").alias("c_custkey"), f["c_name"].alias("name"), f["balance"].cast("double").alias("balance"), f["active"].alias("active"))


@query("select n_nationkey, n_name as name, n_regionkey as region from nation")
def document_reports(spark, sf):
    """Nations written as documents and read again."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    office.write_office(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "docx", "Nations")
    f = F.col("fields")
    return spark.read.format("tables").load(path).select(f["n_nationkey"].cast("int").alias("n_nationkey"), f["n_name"].alias("name"), f["n_regionkey"].cast("int").alias("region"))
