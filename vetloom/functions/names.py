"""Names, labels, exports: scalar helpers as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import trimmed

# Categories in the order they are offered.
DOC_CATEGORIES = ["Access Control Policy", "Disaster Recovery Plan", "Business Continuity Plan", "SOC 2 Report", "Information Security Policy", "Incident Response Plan", "Data Classification Policy", "Vendor Management Policy", "Risk Assessment", "Penetration Test Report", "Business Associate Agreement", "Other"]
# What in a file name hints at a category, the first hit in this order counting.
CATEGORY_HINTS = [
    ("SOC 2 Report", ["soc2", "soc 2", "soc-2", "soc_2", "sox2", "type ii", "typeii", "type-ii"]),
    ("Business Continuity Plan", ["business continuity", "business-continuity", "businesscontinuity", "bcp"]),
    ("Business Associate Agreement", ["business associate", "business-associate", "baa"]),
    ("Disaster Recovery Plan", ["disaster recovery", "disaster-recovery", "disasterrecovery", "dr plan", "dr-plan", "drp"]),
    ("Incident Response Plan", ["incident response", "incident-response", "incidentresponse", "irp"]),
    ("Access Control Policy", ["access control", "access-control", "accesscontrol", "iam policy", "identity and access"]),
    ("Data Classification Policy", ["data classification", "data-classification", "dataclassification"]),
    ("Vendor Management Policy", ["vendor management", "vendor-management", "third party", "third-party", "tprm"]),
    ("Penetration Test Report", ["penetration test", "pen test", "pentest", "pen-test"]),
    ("Risk Assessment", ["risk assessment", "risk-assessment", "riskassessment", "risk register"]),
    ("Information Security Policy", ["information security", "infosec", "security policy", "isms"]),
]
# Names that file systems reserve.
RESERVED = ["con", "prn", "aux", "nul", *[f"com{n}" for n in range(1, 10)], *[f"lpt{n}" for n in range(1, 10)]]
MAX_NAME = 200


def guess_category(name: Column) -> Column:
    """The category that a file name hints at, else Other."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\.[a-z0-9]{1,8}$", ""), "_+", " ")
    out = F.lit("Other")
    for category, hints in reversed(CATEGORY_HINTS):
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(low, F.lit(h))
        out = F.when(hit, category).otherwise(out)
    return out


def guess_category_sql(expr: str) -> str:
    low = f"regexp_replace(regexp_replace(lower(coalesce({expr}, '')), '\\.[a-z0-9]{{1,8}}$', ''), '_+', ' ', 'g')"
    cases = " ".join(f"WHEN {' OR '.join(f'''contains(n, '{h}')''' for h in hints)} THEN '{c}'" for c, hints in CATEGORY_HINTS)
    return f"(SELECT CASE {cases} ELSE 'Other' END FROM (SELECT {low} AS n))"


def csv_field(value: Column) -> Column:
    """A field of a CSV file, safe against being read as a formula, quoted where needed."""
    t = F.coalesce(value.cast("string"), F.lit(""))
    t = F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)
    return F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, values))


def csv_field_sql(expr: str) -> str:
    t = f"CASE WHEN regexp_matches(coalesce(CAST({expr} AS VARCHAR), ''), '^[=+\\-@\\t\\r]') THEN '''' || coalesce(CAST({expr} AS VARCHAR), '') ELSE coalesce(CAST({expr} AS VARCHAR), '') END"
    return f"CASE WHEN regexp_matches({t}, '[\",\\n\\r]') THEN '\"' || replace({t}, '\"', '\"\"') || '\"' ELSE {t} END"


def extension(name: Column) -> Column:
    """`.pdf` of a name, or empty where it has no sane one."""
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    return F.when(ext.rlike(r"[\s ]") | (F.length(ext) > 12), "").otherwise(ext)


def document_name(name: Column, previous: Column | None = None) -> Column:
    """A name that is safe to store and show, keeping the previous one's file ending; null if nothing usable is left."""
    v = F.regexp_replace(F.coalesce(name, F.lit("")), r"[\t\n\r\f\x0b]", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"[\x00-\x1f\x7f-\x9f]", ""), r'[/\\:*?"<>|]', "")
    v = trimmed(F.regexp_replace(v, r"[\s\xa0]+", " "))
    v = trimmed(F.regexp_replace(v, r"^\.+", ""))
    ext = extension(v)
    stem = F.substring(v, F.lit(1), F.length(v) - F.length(ext))
    safe = F.when(F.lower(trimmed(stem)).isin(RESERVED), F.concat(trimmed(stem), F.lit("_"))).otherwise(stem)
    last = F.when(ext != "", ext).otherwise(extension(F.coalesce(previous, F.lit(""))) if previous is not None else F.lit(""))
    full = F.concat(safe, last)
    cut = F.concat(trimmed(F.substring(safe, F.lit(1), F.greatest(F.lit(1), MAX_NAME - F.length(last)))), last)
    return F.when(trimmed(stem) != "", F.nullif(trimmed(F.when(F.length(full) > MAX_NAME, cut).otherwise(full)), F.lit("")))


def document_name_sql(expr: str) -> str:
    v = f"regexp_replace(coalesce({expr}, ''), '[\\t\\n\\r\\f\\x0b]', ' ', 'g')"
    v = f"regexp_replace(regexp_replace({v}, '[\\x00-\\x1f\\x7f]|[\\x{{80}}-\\x{{9f}}]', '', 'g'), '[/\\\\:*?\"<>|]', '', 'g')"
    v = f"trim(regexp_replace({v}, '[\\s\\x{{a0}}]+', ' ', 'g'))"
    v = f"trim(regexp_replace({v}, '^\\.+', ''))"
    reserved = ", ".join(f"'{r}'" for r in RESERVED)
    return (
        f"(SELECT CASE WHEN trim(stem) <> '' THEN nullif(trim(left(CASE WHEN lower(trim(stem)) IN ({reserved}) THEN trim(stem) || '_' ELSE stem END || ext, {MAX_NAME})), '') END FROM "
        f"(SELECT v, ext, left(v, length(v) - length(ext)) AS stem FROM (SELECT v, CASE WHEN regexp_matches(e, '\\s') OR length(e) > 12 THEN '' ELSE e END AS ext FROM (SELECT v, regexp_extract(v, '(?s)^.+(\\.[^.]+)$', 1) AS e FROM (SELECT {v} AS v)))))"
    )


def export_name(kind: str, ending: str, as_of: date) -> str:
    return f"vetloom-{kind}-{as_of.isoformat()}.{ending}"


def shown_bytes(size: Column) -> Column:
    n = F.coalesce(size, F.lit(0))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.format_string("%.1f MB", n / 1048576))


def safe_name(name: Column) -> Column:
    return F.right(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_.-]+", "_"), F.lit(120))


def initials(name: Column) -> Column:
    parts = F.filter(F.split(trimmed(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.coalesce(F.nullif(F.upper(F.substring(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""), 1, 2)), F.lit("")), F.lit("Y"))


def time_ago(at: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 60)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))


def column_index(label: Column) -> Column:
    """Place of a spreadsheet column from a cell reference such as C7, counted from 0; -1 without letters."""
    letters = F.regexp_extract(F.upper(F.coalesce(label, F.lit(""))), "^([A-Z]+)", 1)
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def column_label(place: Column) -> Column:
    """The letters of a spreadsheet column counted from 0: A, Z, AA; `?` for what is no place. Up to four letters."""
    n = place.cast("long")
    first = [0, 26, 26 + 26**2, 26 + 26**2 + 26**3, 26 + 26**2 + 26**3 + 26**4]  # where labels of one, two, ... letters begin
    out = F.lit("?")
    for k in range(4, 0, -1):
        rest = n - first[k - 1]
        letters = F.concat(*[F.char(F.lit(65) + F.pmod(F.floor(rest / 26**i), F.lit(26))) for i in range(k - 1, -1, -1)])
        out = F.when((n >= first[k - 1]) & (n < first[k]), letters).otherwise(out)
    return out


def without_ending(name: Column) -> Column:
    """A file name without its last ending: what a vendor is called until someone says otherwise."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+$", "")


def delimiter(sample: Column) -> Column:
    """The most frequent of comma, semicolon and tab in the first 4,000 characters; ties in that order, a comma without any."""
    head = F.substring(F.coalesce(sample, F.lit("")), 1, 4000)
    n = {c: F.length(head) - F.length(F.replace(head, F.lit(c), F.lit(""))) for c in ",;\t"}
    return F.when((n[","] >= n[";"]) & (n[","] >= n["\t"]), ",").when(n[";"] >= n["\t"], ";").otherwise("\t")


def file_ref(path: Column, name: Column, content_type: Column, size: Column) -> Column:
    """Where a file lies: on the device, in a bucket or nowhere."""
    p = F.coalesce(path, F.lit(""))
    return F.struct(
        F.when(p.startswith("idb://"), "device").when(p != "", "s3").otherwise("none").alias("scheme"), F.nullif(p, F.lit("")).alias("ref"), F.nullif(F.coalesce(name, F.lit("")), F.lit("")).alias("name"),
        F.nullif(F.coalesce(content_type, F.lit("")), F.lit("")).alias("content_type"), F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).alias("size_bytes"), F.lit(False).alias("bytes_included"),
    )


def embedding_key(text: Column, model: Column) -> Column:
    """Key under which a text's vector is kept."""
    return F.xxhash64(F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), model)


# Words that switch the shared library on or off.
ON, OFF = frozenset("1 true yes on shared".split()), frozenset(["", *"0 false no off".split()])


def library_mode(value: str | None) -> tuple[bool, str | None]:
    """(shared, unrecognised word): anything that is not clearly on is off."""
    v = (value or "").strip().lower()
    return v in ON, None if v in ON or v in OFF else v
