"""Cleaning, derivation and validation of single values, as column expressions.

Casts are try_cast throughout: a value that cannot be read is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean "nothing here".
PLACEHOLDERS = ("na", "n/a", "nil", "null", "none", "-", "--")
#: Yes and no.
YES, NO = ("yes", "y", "true", "1", "hod", "active", "t"), ("no", "n", "false", "0", "inactive", "f", "-", "")
#: Programmes, and their names in small letters and digits only (the code itself is one of them).
PROGRAMS = {
    "MBA": ("mba", "masterofbusinessadministration", "mbaprogram", "mbaprogramme"),
    "BBA": ("bba", "bachelorofbusinessadministration"),
    "BCA": ("bca", "bachelorofcomputerapplications", "bachelorofcomputerapplication"),
    "MCA": ("mca", "masterofcomputerapplications", "masterofcomputerapplication"),
    "BE": ("be", "bachelorofengineering"),
    "BTECH": ("btech", "bachelooftechnology", "bacheloroftechnology"),
    "MTECH": ("mtech", "masteroftechnology"),
    "ME": ("me", "masterofengineering"),
    "BSC": ("bsc", "bachelorofscience"),
    "MSC": ("msc", "masterofscience"),
    "BCOM": ("bcom", "bachelorofcommerce"),
    "MCOM": ("mcom", "masterofcommerce"),
    "BA": ("ba", "bachelorofarts"),
    "MA": ("ma", "masterofarts"),
    "BED": ("bed", "bachelorofeducation"),
    "MED": ("med", "masterofeducation"),
    "LLB": ("llb", "bachelooflaws", "bacheloroflaws"),
    "LLM": ("llm",),
    "MBBS": ("mbbs",),
    "BDS": ("bds",),
    "BPHARM": ("bpharm", "bachelorofpharmacy"),
    "MPHARM": ("mpharm",),
    "BARCH": ("barch", "bachelorofarchitecture"),
    "PHD": ("phd", "doctorofphilosophy"),
    "DIPLOMA": ("diploma",),
    "PUC": ("puc", "preuniversity"),
}
#: How semesters one to ten are written.
SEMESTERS = (
    ("first", "1st", "i", "one"), ("second", "2nd", "ii", "two"), ("third", "3rd", "iii", "three"), ("fourth", "4th", "iv", "four"),
    ("fifth", "5th", "v", "five"), ("sixth", "6th", "vi", "six"), ("seventh", "7th", "vii", "seven"), ("eighth", "8th", "viii", "eight"),
    ("ninth", "9th", "ix", "nine"), ("tenth", "10th", "x", "ten"),
)
#: Date formats in order, day before month; those with yy read 69 to 99 as 1969 to 1999.
DATES = (
    "yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy", "d/M/yy", "d-M-yy", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s",
)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def white_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def blank_to_null(c: Column) -> Column:
    """Null for blank text and for words that stand for nothing."""
    text = white_space(c)
    return F.when((text != "") & ~F.lower(text).isin(*PLACEHOLDERS), text)


def person_name(c: Column) -> Column:
    """One blank after dots and none before; title case only where the name is all upper or all lower case."""
    text = white_space(F.regexp_replace(white_space(c), r"\s*\.\s*", ". "))
    return F.when((text == F.upper(text)) | (text == F.lower(text)), F.initcap(text)).otherwise(text)


def _choice(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def program(c: Column) -> Column:
    """The code of a known name, whatever its blanks and dots; else the text in upper case."""
    codes = {name: code for code, names in PROGRAMS.items() for name in names}
    return F.coalesce(_choice(codes, F.regexp_replace(F.lower(c), "[^a-z0-9]", "")), F.upper(white_space(c)))


def numeric_label(c: Column) -> Column:
    """A programme that is a mere number, such as 45 or 82.5%, is none."""
    return F.trim(c).rlike(r"^-?\d+(\.\d+)?%?$")


def semester(c: Column) -> Column:
    """1 to 20 from a number anywhere in the text, or an ordinal, Roman number or word, less 'sem', 'semester' and 'term'."""
    bare = F.btrim(F.regexp_replace(F.lower(white_space(c)), r"\b(sem(ester)?|term)\b", " "), F.lit(" .-"))
    words = {word: n for n, ways in enumerate(SEMESTERS, 1) for word in ways}
    number = F.regexp_extract(bare, r"\b(\d{1,2})\b", 1).try_cast("int")
    return F.coalesce(_choice(words, bare), F.when(number.between(1, 20), number))


def phone(c: Column) -> Column:
    """Digits and a leading plus; a leading 0 of eleven goes; ten digits after 91 get a plus."""
    kept = F.regexp_replace(c, r"[^0-9+]", "")
    kept = F.when(kept.startswith("+"), F.concat(F.lit("+"), F.replace(kept, F.lit("+")))).otherwise(kept)
    local = F.when(kept.startswith("0") & (F.length(kept) == 11), F.substring(kept, 2, 10)).otherwise(kept)
    return F.when(local.startswith("91") & (F.length(local) == 12), F.concat(F.lit("+"), local)).otherwise(local)


def email(c: Column) -> Column:
    return F.lower(white_space(c))


def _double(c: Column) -> Column:
    text = white_space(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number(c: Column) -> Column:
    """Without thousands commas and the currency marks that are written in small letters."""
    text = c
    for mark in (",", "₹", "rs.", "rs", "inr"):
        text = F.replace(text, F.lit(mark))
    return _double(text)


def integer(c: Column) -> Column:
    """Only where the number is whole."""
    n = number(c)
    return F.when(n == F.floor(n), n.try_cast("bigint"))


def percent(c: Column) -> Column:
    """Text loses % and commas and is not scaled; two decimals."""
    return F.round(_double(F.regexp_replace(c, "[%,]", "")), 2)


def scaled_percent(c: Column) -> Column:
    """A fraction (no whole-number type) from 0 to 1 as hundredths; other numbers as they are; two decimals."""
    return F.round(F.when(c.between(0, 1), c * 100).otherwise(c), 2)


def boolean(c: Column) -> Column:
    text = F.lower(white_space(c))
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


def serial_date(c: Column) -> Column:
    """A number from 20000 to 80000 as days since 1899-12-30."""
    return F.when(c.between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), c.cast("int")))


def date(c: Column) -> Column:
    """The first of DATES that reads the whole text; what has the shape of an ISO date is read as such only."""
    text = white_space(c)

    def read(form: str) -> Column:
        day = F.to_date(F.try_to_timestamp(text, F.lit(form)))
        return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day) if "yyyy" not in form else day

    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), read("yyyy-MM-dd"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso).otherwise(F.coalesce(*map(read, DATES)))


def ambiguous_date(c: Column) -> Column:
    """Whether day and month of a date that can be read could be exchanged."""
    text = white_space(c)
    day, month = (F.regexp_extract(text, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}$", i).try_cast("int") for i in (1, 2))
    return F.coalesce(day.between(0, 12) & month.between(0, 12) & (day != month) & date(c).isNotNull(), F.lit(False))


def shape(c: Column) -> Column:
    """Digits as 9, letters as A."""
    return F.regexp_replace(F.regexp_replace(c, r"[A-Za-z]", "A"), r"[0-9]", "9")


def header(c: Column) -> Column:
    """Lower case, punctuation to single blanks, only letters, digits, % and # kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"[_\-./()\[\]:]", " "), r"[^\w\s%#]", ""), r"\s+", " "))


def header_signature(headers: Column) -> Column:
    """Normalised headers of a table, sorted and joined: the same whatever their order."""
    return F.array_join(F.array_sort(F.transform(headers, header)), "|")


def attended(held: Column, attended_: Column, absent: Column) -> Column:
    return F.coalesce(attended_, F.greatest(F.lit(0), held - absent))


def fee_status(due: Column, paid: Column) -> Column:
    return F.when(paid >= due, "paid").when(paid > 0, "partial").otherwise("pending")


def issues(rules: list[tuple[Column, str, str, str]]) -> Column:
    """An array of (field, code, severity) for each rule (failed, field, code, severity) that fails."""
    found = [
        F.when(failed, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))
        for failed, field, code, severity in rules
    ]
    return F.array_compact(F.array(*found))


#: What identifiers and addresses look like.
VALID = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "identifier": r"^[A-Za-z0-9][A-Za-z0-9/_.-]*$"}
#: Fields of STRING type whose case is put right, and how.
CASES = {"course_code": "upper", "section": "upper", "status": "lower", "result_status": "lower", "gender": "lower"}
NAMES = ("name", "student_name", "guardian_name", "hod_name")


def clean_field(kind: str, name: str, c: Column) -> Column:
    """struct(value, notes, issues) of one text cell, by the kind of its field.

    notes name what was put right (field:what), issues are (field, code, severity, value) of what could
    not be read; such a value is null.  Blank cells and words that stand for nothing are null with no issue.
    """
    none, said = F.lit(None).cast("string"), white_space(c)
    empty = blank_to_null(c).isNull()
    trimmed = F.when(said != c, F.lit(f"{name}:whitespace"))
    issue = lambda code, severity: F.struct(F.lit(name).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.left(said, F.lit(40)).alias("value"))
    problem: Column = F.lit(None)
    if kind == "string" and name in NAMES:
        value, note = person_name(said), "name_case"
    elif kind == "string" and name == "program":
        value, note = F.when(~numeric_label(said), program(said)), "program_alias"
        problem = F.when(numeric_label(said), issue("numeric_program", "warning"))
    elif kind == "string":
        value, note = {"upper": F.upper, "lower": F.lower}.get(CASES.get(name, ""), lambda x: x)(said), "case"
    elif kind == "identifier":
        value, note = F.upper(said), "identifier_case"
    elif kind == "phone":
        value, note = phone(said), "phone_format"
    elif kind == "email":
        value, note = email(said), "email_case"
    else:
        how = {"semester": semester, "integer": integer, "number": number, "percent": percent, "boolean": boolean, "date": date}
        rule = "semester" if (kind, name) == ("integer", "semester") else kind
        value, note = how[rule](said).cast("string"), f"{rule}_parsed"
        problem = F.when(value.isNull(), issue(f"invalid_{rule}", "warning"))
        if kind == "date":
            problem = F.when(ambiguous_date(said), issue("ambiguous_date_day_month", "info")).otherwise(problem)
    parsed = kind in ("integer", "number", "percent", "boolean")
    changed = F.when(value.isNotNull() & (F.lit(True) if parsed else (value != said)), F.lit(f"{name}:{note}"))
    blank_word = F.when(said != "", F.lit(f"{name}:placeholder_to_empty"))
    notes = F.array_compact(F.when(empty, F.array(trimmed, blank_word)).otherwise(F.array(trimmed, changed)))
    shape_ = "array<struct<field:string,code:string,severity:string,value:string>>"
    issues_ = F.when(~empty & problem.isNotNull(), F.array(problem)).otherwise(F.expr(f"cast(array() as {shape_})")).cast(shape_)
    return F.struct(F.when(empty, none).otherwise(value).alias("value"), F.when(c.isNull(), F.array().cast("array<string>")).otherwise(notes).alias("notes"), issues_.alias("issues"))


def clean_record(fields: dict[str, str]) -> list[Column]:
    """Of a row with text cells: each field (name to kind) cleaned, and all notes and issues."""
    found = {name: clean_field(kind, name, F.col(name)) for name, kind in fields.items()}
    values = [x["value"].alias(name) for name, x in found.items()]
    return [*values, F.flatten(F.array(*(x["notes"] for x in found.values()))).alias("notes"), F.flatten(F.array(*(x["issues"] for x in found.values()))).alias("issues")]


def field_rules(fields: dict[str, str], required: list[str], counts: tuple[str, ...] = (), amounts: tuple[str, ...] = ()) -> list[tuple[Column, str, str, str]]:
    """Rules (failed, field, code, severity) for issues(): by kind of field, missing ones first.

    A required name is there if a first or last name is.  counts and amounts are the whole and
    decimal fields that must not be negative.
    """
    missing = lambda n: F.coalesce(F.trim(F.col(n).cast("string")) == "", F.lit(True))
    parts = [n for n in ("first_name", "last_name") if n in fields]
    rules = []
    for n in required:
        lacks = missing(n)
        for part in parts if n == "name" else []:
            lacks &= missing(part)
        rules.append((lacks, n, "missing_required", "error"))
    for n, kind in fields.items():
        c, there = F.col(n), ~missing(n)
        digits = F.length(F.regexp_replace(c.cast("string"), "[^0-9]", ""))
        if kind == "identifier":
            rules.append((there & ~c.rlike(VALID["identifier"]), n, "invalid_identifier", "warning"))
        elif kind == "phone":
            rules.append((there & ~digits.between(7, 15), n, "invalid_phone", "warning"))
        elif kind == "email":
            rules.append((there & ~c.rlike(VALID["email"]), n, "invalid_email", "warning"))
        elif kind == "percent":
            rules.append((there & ~c.between(0, 100), n, "percent_out_of_range", "error"))
        if n in amounts:
            rules.append((there & (c < 0), n, "negative_amount", "error"))
        if n in counts:
            rules.append((there & (c < 0), n, "negative_count", "error"))
        if n == "admission_year":
            rules.append((there & ~c.between(1900, 2100), n, "year_out_of_range", "warning"))
    return rules


def attendance_rules(held: Column, attended_: Column, percent_: Column) -> list[tuple[Column, str, str, str]]:
    unknown = percent_.isNull() & (F.coalesce(held == 0, F.lit(True)) | attended_.isNull())
    return [(attended_ > held, "classes_attended", "attended_exceeds_held", "error"), (unknown, "attendance_percent", "attendance_unknown", "warning")]


def exam_rules(marks: Column, most: Column) -> list[tuple[Column, str, str, str]]:
    return [(marks > most, "marks_obtained", "marks_exceed_maximum", "error")]


def fee_rules(due: Column, paid: Column) -> list[tuple[Column, str, str, str]]:
    return [((due > 0) & (paid > due * 1.5), "amount_paid", "paid_far_exceeds_due", "warning")]


#: Letters that readers of images take digits for, and those digits.
CONFUSED, MEANT = "IOLSBZ", "101582"


def likely_identifier(c: Column, pattern: Column) -> Column:
    """The identifier that was probably meant, where letters stand in places that have digits in the column's usual pattern (9 and A); else null."""
    chars, places = F.split(c, ""), F.split(pattern, "")
    both = F.zip_with(chars, places, lambda x, p: F.struct(x.alias("x"), (x.rlike("[A-Za-z]") & (p == "9")).alias("off")))
    wrong = F.filter(both, lambda s: s["off"])
    meant = F.array_join(F.transform(both, lambda s: F.when(s["off"], F.translate(s["x"], CONFUSED, MEANT)).otherwise(s["x"])), "")
    likely = (F.length(c) == F.length(pattern)) & (F.size(wrong) > 0) & F.forall(wrong, lambda s: s["x"].isin(*CONFUSED))
    return F.when(likely, meant)
