"""Queries of the readers, and their SQL: round trips of the questions through files of each kind.

The questions are laid out as files of up to PER_FILE rows (a questionnaire of any size is several files), written as real
workbooks, documents, archives and delimited texts, and read back by the operators; the SQL says what must come out.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.questions import trimmed
from ..functions.text import SPACE
from ..sources import readers as R
from .library_queries import _T, once

PER_FILE = 200
#: What XML cannot hold.
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _files(spark, sf_dir) -> DataFrame:
    """(file, rows array<struct<n, question, answer>>): questions in order of their ids, without what XML cannot hold."""
    q = once(spark, sf_dir, "questions", "question_id", ["question_id", "questionnaire_id", "question_text", "answer_text"])

    def clean(c: str):
        return trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), _CONTROL, ""))

    row = F.struct("question_id", clean("question_text").alias("question"), clean("answer_text").alias("answer"))
    name = F.concat_ws("-", "questionnaire_id", F.floor(F.col("question_id") / PER_FILE).cast("string"))
    return q.filter("questionnaire_id is not null").groupBy(name.alias("file")).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def _workbook(rows: list[dict]) -> bytes:
    """Two sheets: questions as shared strings in column B of every second row with answers in column AA, and a hidden empty one."""
    strings = list(dict.fromkeys(r["question"] for r in rows))
    at = {s: n for n, s in enumerate(strings)}
    body = "".join(
        f'<row r="{2 * n + 1}"><c r="B{2 * n + 1}" t="s"><v>{at[r["question"]]}</v></c><c r="C{2 * n + 1}" t="b"><v>{int(bool(r["answer"]))}</v></c><c r="D{2 * n + 1}" t="e"><v>#N/A</v></c>'
        f'<c r="E{2 * n + 1}"><f>ROW()</f><v>{n}</v></c><c r="AA{2 * n + 1}" t="inlineStr"><is><t>{escape(r["answer"])}</t></is></c></row><row r="{2 * n + 2}"/>'
        for n, r in enumerate(rows)
    )
    half = [(s[: len(s) // 2], s[len(s) // 2 :]) for s in strings]
    return _zip(
        {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr("Q & A")} sheetId="1" r:id="a"/><sheet name="Old" sheetId="2" state="hidden" r:id="b"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">' + "".join(f"<si><r><t>{escape(a)}</t></r><r><t>{escape(b)}</t></r></si>" for a, b in half) + "</sst>",
            "xl/worksheets/one.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>',
            "xl/worksheets/two.xml": f'<worksheet xmlns="{_MAIN}"><sheetData><row r="7"><c r="A7" t="inlineStr"><is><t>old</t></is></c></row></sheetData></worksheet>',
        }
    )


def _document(rows: list[dict]) -> bytes:
    """A paragraph for each question; line breaks as breaks of a run."""
    runs = ("".join(f"<w:r>{'<w:br/>' if n else ''}<w:t>{escape(part)}</w:t></w:r>" for n, part in enumerate(r["question"].split("\n"))) for r in rows)
    return _zip({"word/document.xml": '<w:document xmlns:w="w"><w:body>' + "".join(f"<w:p>{r}</w:p>" for r in runs) + "</w:body></w:document>"})


def _archive(rows: list[dict]) -> bytes:
    parts = {f"texts/{r['question_id']}.txt": r["question"] for r in rows}
    return _zip(parts | {"__MACOSX/._x.txt": "x", "texts/.hidden.txt": "x", "picture.png": "x", "texts/": ""})


def _made(files: DataFrame, ending: str, make) -> DataFrame:
    """(path, content) of the files in a format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f"{n}.{ending}" for n in batch.column(0).to_pylist()], pa.string()), pa.array([make(r) for r in batch.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return files.select("file", "rows").mapInArrow(run, "path string, content binary")


def workbook_cells(spark, sf_dir):
    return R.workbook_cells(_made(_files(spark, sf_dir), "xlsx", _workbook)).select("workbook", "sheet_ord", "sheet", "hidden", "row_idx", "row_no", "col", "cell")


def workbook_pages(spark, sf_dir):
    e = R.extract(_made(_files(spark, sf_dir), "xlsx", _workbook))
    return e.select("path", "kind", F.size("pages").alias("pages"), F.element_at("pages", 2)["text"].alias("hidden"), F.size("warnings").alias("warnings"), "error")


def document_texts(spark, sf_dir):
    return R.extract(_made(_files(spark, sf_dir), "docx", _document)).select("path", "kind", "text", "error")


def archive_entries(spark, sf_dir):
    e = R.zip_entries(_made(_files(spark, sf_dir), "zip", _archive))
    return e.select("archive", "path", F.decode("content", "UTF-8").alias("text"), "error")


def delimited_files(spark, sf_dir):
    """Questions and answers as CSV files with CR LF ends, read back as lines of filled cells."""
    lines = F.transform("rows", lambda r: N.csv_line(r["question_id"], r["question"], r["answer"]))
    return R.delimited_lines(_files(spark, sf_dir).select(F.col("file").alias("path"), F.array_join(lines, "\r\n").alias("text")))


def file_kinds(spark, sf_dir):
    d = once(spark, sf_dir, "kb_documents", "id", ["id", "name", "content_type"])
    return d.select("id", R.kind(F.col("name"), F.col("content_type")).alias("kind"), R.tidy_space(F.col("name")).alias("tidy"))


def import_outcomes(spark, sf_dir):
    """A bulk import of good, empty, broken and unreadable files, by outcome."""
    f = _files(spark, sf_dir)
    broken = f.select(F.concat("file", F.lit(".docx")).alias("path"), F.encode(F.lit("no archive"), "UTF-8").alias("content"))
    scans = f.select(F.concat("file", F.lit(".pdf")).alias("path"), F.encode(F.lit("%PDF"), "UTF-8").alias("content"))
    empty = f.select(F.concat("file", F.lit(".txt")).alias("path"), F.encode(F.lit(" \n"), "UTF-8").alias("content"))
    return R.import_summary(R.extract(_made(f, "docx", _document).unionByName(broken).unionByName(scans).unionByName(empty)))


def fragment_lines(spark, sf_dir):
    """Lines joined again from the words of each question, as a page's text fragments come."""
    q = once(spark, sf_dir, "questions", "question_id", ["question_id", "question_text"])
    words = F.split(F.regexp_replace(F.coalesce("question_text", F.lit("")), r"[ \n]+", " "), " ")
    return q.select("question_id", R.joined_fragments(F.transform(words, lambda w, i: F.struct(w.alias("text"), (i % 5 == 4).alias("ends_line")))).alias("text"))


QUERIES = {f.__name__: f for f in (workbook_cells, workbook_pages, document_texts, archive_entries, delimited_files, file_kinds, import_outcomes, fragment_lines)}


def _clean(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]|[\\x{{80}}-\\x{{9f}}]', '', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _tidy(e: str) -> str:
    inner = SPACE.replace(r"\s", r" \t\x0b\x0c")
    t = f"regexp_replace(regexp_replace(regexp_replace({e}, '\\r\\n?', chr(10), 'g'), '[{inner}]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"


_F = _T + f", f AS (SELECT questionnaire_id || '-' || (question_id // {PER_FILE}) AS file, question_id, {_clean('question_text')} AS question, {_clean('answer_text')} AS answer FROM q WHERE questionnaire_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY question_id) - 1 AS n FROM f)"
_CSV = N.csv_field_sql

SQL = {
    "workbook_cells": _F
    + """ SELECT file || '.xlsx' AS workbook, CAST(0 AS INTEGER) AS sheet_ord, 'Q & A' AS sheet, false AS hidden, CAST(n AS INTEGER) AS row_idx, CAST(2 * n + 1 AS INTEGER) AS row_no, CAST(x.col AS INTEGER) AS col, x.cell AS cell
FROM r, LATERAL (SELECT unnest([{'col': 1, 'cell': question}, {'col': 2, 'cell': CASE WHEN answer <> '' THEN 'TRUE' ELSE 'FALSE' END}, {'col': 4, 'cell': CAST(n AS VARCHAR)}, {'col': 26, 'cell': answer}]) AS x) WHERE x.cell <> ''
UNION ALL SELECT DISTINCT file || '.xlsx', 1, 'Old', true, 0, 7, 0, 'old' FROM r""",
    "workbook_pages": _F + " SELECT DISTINCT file || '.xlsx' AS path, 'xlsx' AS kind, CAST(2 AS INTEGER) AS pages, 'Sheet \"Old\"' || chr(10) || 'old' AS hidden, CAST(0 AS INTEGER) AS warnings, CAST(NULL AS VARCHAR) AS error FROM r",
    "document_texts": _F + f", t AS (SELECT file || '.docx' AS path, string_agg(question, chr(10) || chr(10) ORDER BY question_id) FILTER (question <> '') AS t FROM r GROUP BY file) SELECT path, 'docx' AS kind, {_tidy('coalesce(t, chr(32))')} AS text, CAST(NULL AS VARCHAR) AS error FROM t",
    "archive_entries": _F + " SELECT file || '.zip' AS archive, 'texts/' || question_id || '.txt' AS path, question AS text, CAST(NULL AS VARCHAR) AS error FROM r",
    "delimited_files": _F
    + f""", l AS (SELECT file, question_id, concat_ws(' | ', CAST(question_id AS VARCHAR), nullif(CASE WHEN regexp_matches(question, '^[=+\\-@\\t\\r]') THEN '''' || question ELSE question END, ''), nullif(CASE WHEN regexp_matches(answer, '^[=+\\-@\\t\\r]') THEN '''' || answer ELSE answer END, '')) AS line FROM r)
SELECT file AS path, string_agg(line, chr(10) ORDER BY question_id) AS text FROM l GROUP BY file""",
    "file_kinds": _T
    + f""", x AS (SELECT id, name, regexp_extract(lower(coalesce(name, '')), '\\.([^./\\\\]+)$', 1) AS e, lower(coalesce(content_type, '')) AS m FROM d)
SELECT id, CASE e {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.KINDS.items())} ELSE CASE {' '.join(f"WHEN contains(m, '{k}') THEN '{v}'" for k, v in R.MIMES.items())} ELSE 'unknown' END END AS kind, {_tidy("coalesce(name, '')")} AS tidy FROM x""",
    "import_outcomes": _F + " , g AS (SELECT file, max(question) AS m FROM r GROUP BY file) SELECT status, count(*) AS files FROM (SELECT CASE WHEN m <> '' THEN 'imported' ELSE 'empty' END AS status FROM g UNION ALL SELECT 'failed' FROM g UNION ALL SELECT 'failed' FROM g UNION ALL SELECT 'empty' FROM g) GROUP BY status",
    "fragment_lines": _T + """, w AS (SELECT question_id, unnest(string_split(regexp_replace(coalesce(question_text, ''), '[ \\n]+', ' ', 'g'), ' ')) AS w, generate_subscripts(string_split(regexp_replace(coalesce(question_text, ''), '[ \\n]+', ' ', 'g'), ' '), 1) - 1 AS i FROM q),
  j AS (SELECT question_id, string_agg(w || CASE WHEN i % 5 = 4 THEN chr(10) ELSE ' ' END, '' ORDER BY i) AS t FROM w GROUP BY question_id) SELECT question_id, trim(regexp_replace(regexp_replace(t, ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text FROM j""",
}
