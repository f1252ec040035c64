import io
import zipfile

from pyspark.sql import functions as F

from vetloom.functions import names as N
from vetloom.operators import passages as P
from vetloom.operators import questions as QO
from vetloom.sources import readers as R

REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def book(sheets) -> bytes:
    """sheets: (name, state, rows of (number, cells as XML))."""
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{DOC_REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}" state="{s}"/>' for i, (n, s, _) in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": REL.format("".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))),
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>Deck</t></si><si><r><t>Upper </t></r><r><t>hold</t></r></si><si><t>Rum &amp; rope</t></si></sst>',
    }
    for i, (_, _, rows) in enumerate(sheets):
        files[f"xl/worksheets/s{i}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f'<row r="{n}">{cells}</row>' for n, cells in rows) + "</sheetData></worksheet>"
    return archive(**files)


def inline(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


QUESTIONS = ["Are the ferry's door codes changed after each season?", "Describe how lost luggage lists are kept.", "Who may read the passenger register at night?", "Please attach the plan of the engine room."]


def test_workbook_cells_and_questions(spark):
    rows = [(1, inline("A1", "Harbour survey")), (2, ""), (3, inline("A3", "Ref") + inline("C3", "Question") + inline("D3", "Response"))]
    rows += [(4 + n, inline(f"C{4 + n}", q) + inline(f"A{4 + n}", f"Q{n}")) for n, q in enumerate(QUESTIONS)]
    rows += [(9, '<c r="A9" t="s"><v>2</v></c><c r="B9" t="s"><v>99</v></c><c r="D9" t="b"><v>1</v></c><c r="E9" t="e"><v>#REF!</v></c><c r="F9"><v>45000</v></c>')]
    content = book([("Instructions", "visible", [(1, inline("A1", "Can you reach the harbour office by phone?"))]), ("Full", "visible", rows), ("Old", "hidden", rows)])
    files = spark.createDataFrame([("w.xlsx", content), ("bad.xlsx", b"no archive")], "path string, content binary")
    cells = R.workbook_cells(files)
    last = {r.col: r.cell for r in cells.filter("sheet = 'Full' and row_no = 9").collect()}
    assert last == {0: "Rum & rope", 3: "TRUE", 5: "45000"}
    (choice,) = QO.column_choice(cells).collect()
    assert (choice.sheet, choice.col, choice.hits, choice.header) == ("Full", 2, 4, "Question")
    found = QO.from_grid(cells).orderBy("index").collect()
    assert [r.text for r in found] == QUESTIONS and [r.row for r in found] == [4, 5, 6, 7]
    skipped = {r.sheet: r.reason for r in QO.kept_sheets(cells).filter("not keep").collect()}
    assert skipped == {"Instructions": "looks like guidance", "Old": "hidden sheet"}


def test_extract(spark):
    doc = archive(**{"word/document.xml": '<w:document xmlns:w="x"><w:body><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>part</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>'})
    zipped = archive(**{"a/one.txt": "text", "__MACOSX/._one.txt": "x", ".DS_Store": "x", "pic.png": "x", "t.csv": "a;b\nc;\"d\ne\""})
    files = spark.createDataFrame([("d.docx", doc), ("n.md", "a\r\n\r\n\r\n\r\nb  c ".encode()), ("t.csv", b'x,"y, z"\n,'), ("p.pdf", b"%PDF"), ("e.txt", b"  "), ("z.zip", zipped), ("broken.docx", b"1")], "path string, content binary")
    got = {r.path: r for r in R.extract(files).collect()}
    assert got["d.docx"].text == "First part\n\nSecond" and got["n.md"].text == "a\n\nb c" and got["t.csv"].text == "x | y, z"
    assert got["e.txt"].warnings == ["no text was found"] and all(got[p].error for p in ("p.pdf", "z.zip", "broken.docx"))
    entries = {r.path: r.error for r in R.zip_entries(files.filter("path in ('z.zip', 'broken.docx')")).collect()}
    assert set(entries) == {"a/one.txt", "t.csv", None} and entries[None]
    assert {r.status: r.files for r in R.import_summary(R.extract(files)).collect()} == {"imported": 3, "empty": 1, "failed": 3}


def test_delimited():
    assert R.parse_delimited('a,"b ""x""\n1",c\r\nd,e"f"g,', ",") == [["a", 'b "x"\n1', "c"], ["d", "efg", ""]]
    assert R.parse_delimited("", ",") == []


def test_questions_from_text(spark):
    text = "HARBOUR SURVEY\nPage 4 of 9\n1. Do you lock the fuel store whenever no deckhand\nis on watch?\n2) Describe the route of mail bags.\nHB3.2 | Are life jackets counted once a month? | Yes/No | Comments\nVendor name | Fjordlines\n3. Describe the route of mail bags\n"
    df = spark.createDataFrame([("d", text), ("e", None), ("f", " \n ")], "doc_id string, text string")
    got = [r.text for r in QO.from_text(df).orderBy("index").collect()]
    assert got == ["Do you lock the fuel store whenever no deckhand is on watch?", "Describe the route of mail bags.", "Are life jackets counted once a month?"]
    (stats,) = QO.extraction_stats(df).collect()
    assert (stats.extracted, stats.duplicates) == (3, 1)
    typed = spark.createDataFrame([("d", "7. Which pier is ours?\n\n8) Which rope is spare?\nTide tables")], "doc_id string, text string")
    assert [r.text for r in QO.from_lines(typed).orderBy("index").collect()] == ["Which pier is ours?", "Which rope is spare?", "Tide tables"]


def test_passages(spark):
    page = "The first sentence of the page is about access. The second one is about backups and keys. " * 20
    pages = [(1, page), (2, "Too short."), (3, "x" * 3000)]
    df = spark.createDataFrame([("d", pages), ("e", None)], "doc_id string, pages array<struct<page:int,text:string>>")
    got = P.passages(df).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and {r.page for r in got} == {1, 3}
    assert all(P.LEAST <= len(r.text) <= P.MOST for r in got) and all(r.text[0] in "Tx" for r in got)
    long = spark.createDataFrame([("d", [(1, page * 200)])], "doc_id string, pages array<struct<page:int,text:string>>")
    assert P.passages(long).count() > 300 and P.passages(long, most=300).count() == 300


def test_names(spark):
    rows = [("../../etc/passwd",), ("CON.txt",), (".pdf",), ("..",), (None,), ("a" * 300 + ".pdf",), (" My  report\t.docx ",)]
    df = spark.createDataFrame(rows, "n string")
    out = [r.x for r in df.select(N.document_name(F.col("n"), F.lit("old.xlsx")).alias("x")).collect()]
    assert out == ["etcpasswd.xlsx", "CON_.txt", "pdf.xlsx", None, None, "a" * 196 + ".pdf", "My report .docx"]
    again = spark.createDataFrame([(o,) for o in out if o], "n string").select(N.document_name(F.col("n")).alias("x")).collect()
    assert [r.x for r in again] == [o for o in out if o]
    fields = spark.createDataFrame([("a,b",), ('q"q',), ("=1+1",), ("-1",), ("\tx",), (None,), ("plain",), ("l\nm",)], "v string").select(N.csv_field(F.col("v")).alias("x")).collect()
    assert [r.x for r in fields] == ['"a,b"', '"q""q"', "'=1+1", "'-1", "'\tx", "", "plain", '"l\nm"']
    labels = spark.createDataFrame([("A",), ("C7",), ("Z",), ("AA",), ("AB12",), ("12",)], "v string").select(N.column_index(F.col("v")).alias("x")).collect()
    assert [r.x for r in labels] == [0, 2, 25, 26, 27, -1]
    assert N.library_mode("Yes") == (True, None) and N.library_mode("ture") == (False, "ture") and N.library_mode(None) == (False, None)
    got = spark.createDataFrame([("Acme_SOC2_2024.pdf",), ("business-continuity-plan.pdf",), ("notes.baa",), (None,)], "v string").select(N.guess_category(F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == ["SOC 2 Report", "Business Continuity Plan", "Other", "Other"]
