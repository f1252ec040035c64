import pytest
from pyspark.sql import functions as F

from vetloom.operators import library as L
from vetloom.plans import library_queries as LQ
from vetloom.streaming import live


def test_store(spark):
    log = spark.createDataFrame([("c", "1", "put", 1, 1, "a"), ("c", "1", "put", 2, 2, "b"), ("c", "2", "put", 1, 3, "x"), ("c", "2", "delete", 2, 4, None), ("c", "3", "delete", 1, 5, None), ("c", "3", "put", 2, 6, "y")], "collection string, id string, op string, version long, seq long, body string")
    assert {(r.id, r.body) for r in L.replayed(log).collect()} == {("1", "b"), ("3", "y")}
    stored = spark.createDataFrame([("1", "old"), ("2", "old"), ("3", "old")], "id string, v string")
    local = spark.createDataFrame([("1", "new"), ("9", "new")], "id string, v string")
    gone = spark.createDataFrame([("3",)], "id string")
    assert {tuple(r) for r in L.merged(stored, local, gone).collect()} == {("1", "new"), ("2", "old"), ("9", "new")}
    assert {tuple(r) for r in L.restored(stored, local).collect()} == {("1", "old"), ("2", "old"), ("3", "old"), ("9", "new")}
    assert {tuple(r) for r in L.restored(stored, local, overwrite=True).collect()} == {("1", "new"), ("2", "old"), ("3", "old"), ("9", "new")}
    assert {tuple(r) for r in L.patched(stored, F.col("id") == "2", v=F.lit("p")).collect()} == {("1", "old"), ("2", "p"), ("3", "old")}
    with pytest.raises(ValueError):
        L.guarded_overwrite(stored.limit(0), "/nowhere", True)


def test_transfer(spark):
    rows = spark.createDataFrame([("1", "Ann"), ("2", "ANN"), ("3", None), ("4", "Bob")], "id string, owner string")
    new, audit = L.transferred(rows, spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), "ann", F.lit("2026-01-01"))
    assert {tuple(r) for r in new.collect()} == {("1", "Ann"), ("2", "ANN"), ("3", "ann"), ("4", "Bob")}
    assert [r.entity_id for r in audit.collect()] == ["3"]


def test_current_sources(spark):
    c = spark.createDataFrame([("c1", "document", "d1", "Old.pdf"), ("c2", "document", "gone", "Kept.pdf"), ("c3", "qa", "e1", "Acme · May")], "id string, source_type string, source_id string, source_name string")
    d = spark.createDataFrame([("d1", "New.pdf", "3 May", None)], "id string, name string, doc_date string, saved_at timestamp")
    e = spark.createDataFrame([("e1", "4 May", None)], "id string, entry_date string, saved_at timestamp")
    got = {r.id: (r.source_name, r.source_date) for r in L.current_sources(c, d, e).collect()}
    assert got == {"c1": ("New.pdf", "3 May"), "c2": ("Kept.pdf", None), "c3": ("Acme · May", "4 May")}


def test_csv_file(spark, tmp_path):
    e = spark.createDataFrame([("1", "Acme", "May", "Tech", ["SOC 2", "HIPAA"], 90, [("Q, one?", "=yes", None), ("Two", "no", "s")]), ("2", "None", None, None, None, None, None)], "id string, vendor string, entry_date string, industry string, tags array<string>, confidence int, qa_data array<struct<text:string,answer:string,source:string>>")
    L.csv_file(["Vendor", "Date"], L.answer_history(e), str(tmp_path / "out"), ["id", "pos"])
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "﻿Vendor,Date\r\nAcme,May,Tech,SOC 2; HIPAA,90,\"Q, one?\",'=yes,\r\nAcme,May,Tech,SOC 2; HIPAA,90,Two,no,s\r\n"


REVIEW = "question_id long, status string, answer string, confidence int, chunk_id string, source_id string, source_name string, saved_at timestamp"


def test_refresh_and_actions(spark):
    cur = spark.createDataFrame([(1, "needs-input", "", 0, None, None, None, None, False), (2, "answered", "mine", 50, "c1", "s1", "S1", None, True), (3, "needs-input", " ", 0, None, None, None, None, True), (4, "auto-filled", "x", 80, "c4", "s4", "S4", None, False)], REVIEW + ", touched boolean")
    new = spark.createDataFrame([(1, "flagged", "", 60, "c9", "s9", "S9", None), (2, "flagged", "", 60, "c9", "s9", "S9", None), (4, "auto-filled", "y", 84, "c8", "s8", "S8", None)], REVIEW)
    got = {r.question_id: r for r in live.refreshed(cur, new).collect()}
    assert (got[1].status, got[1].chunk_id, got[1].update) == ("flagged", "c9", None)
    assert got[2].answer == "mine" and got[2].update.score == 60 and got[2].update.previous_score == 50
    assert got[3].status == "needs-input" and got[3].touched and got[4].answer == "x" and got[4].update is None
    events = spark.createDataFrame([(1, 1, "edit", "a", None), (1, 2, "edit", "b", None), (4, 1, "choose", "doc", "document"), (3, 1, "accept", "ok", "qa")], "question_id long, seq long, kind string, text string, source_type string")
    acted = {r.question_id: r for r in live.acted(cur, events).collect()}
    assert (acted[1].answer, acted[1].status, acted[1].touched) == ("b", "answered", True)
    assert acted[4].status == "flagged" and acted[3].status == "auto-filled" and acted[2].answer == "mine"


def test_stream_equals_batch(spark, tmp_path):
    schema = "id string, op string, version long, body string"
    parts = [[("1", "put", 1, "a"), ("2", "put", 1, "b")], [("1", "put", 2, "c"), ("2", "delete", 3, None)], [("2", "put", 2, "late"), ("3", "put", 1, "d")]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.on_change(stream, live.upserts(str(tmp_path / "out"), "id", ["version"]), str(tmp_path / "check"))
    q.awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    state = {r.id: r.body for r in spark.read.parquet(str(last)).filter("op = 'put'").collect()}
    assert state == {"1": "c", "3": "d"}


def test_sessions(spark):
    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:01"), ("a", "2026-01-01 00:00:09"), ("b", "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.k, r.events) for r in live.coalesced(df, "k", "t").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_grid_cells_keep_quoted_delimiters(spark, tmp_path):
    asks = ['Who must lock the doors, and what happens if the clerk is away?', 'Do you sign "all" changes, at night?', "Is data encrypted,\nat rest?"]
    rows = [("f1", n + 1, d, f'{n + 1}{d or ","}Acme{d or ","}"' + q.replace('"', '""').replace(",", d or ",") + f'"{d or ","}Yes') for d in (",", None, ";") for n, q in enumerate(asks)]
    rows = [(f"{f}{n // 3}", *r) for n, (f, *r) in enumerate(rows)] + [("f9", 1, ",", "1,two\nlines,x"), ("f9", 2, ",", ""), ("f9", 3, ",", None), ("f9", 4, "||", "a||b")]
    spark.createDataFrame(rows, "file_id string, line_no int, delimiter string, record string").write.parquet(f"{tmp_path}/question_csv.parquet")
    got = {}
    for r in LQ.grid_cells(spark, str(tmp_path)).orderBy("workbook", "row_no", "col").collect():
        got.setdefault((r.workbook, r.row_no), []).append(r.cell)
        assert r.row_idx == r.row_no - 1
    for k, d in enumerate((",", ",", ";")):
        assert [got[f"f1{k}", n + 1] for n in range(3)] == [[str(n + 1), "Acme", q.replace(",", d), "Yes"] for n, q in enumerate(asks)]
    assert {k: v for k, v in got.items() if k[0] == "f9"} == {("f9", 1): ["1", "two\nlines", "x"], ("f9", 2): [""], ("f9", 4): ["a", "b"]}
    assert {r.text for r in LQ.grid_questions(spark, str(tmp_path)).filter("workbook = 'f10'").collect()} >= {asks[0], asks[1]}


def test_manifest_has_the_real_sizes(spark, tmp_path):
    sizes = {"a": (0, "0 B"), "b": (1023, "1023 B"), "c": (1536, "2 KB"), "d": (1048575, "1024 KB"), "e": (3 * 1048576 // 2, "1.5 MB"), "f": (None, "0 B"), "g": (10 * 1048576, "10.0 MB")}
    docs = [(i, "Policy.pdf", "Security", "2025-01-01", n, "", [], "", 1) for i, (n, _) in sizes.items()]
    spark.createDataFrame(docs, "id string, name string, category string, doc_date string, size_bytes long, note string, tags array<string>, storage_path string, ingested_at long").write.parquet(f"{tmp_path}/kb_documents.parquet")
    spark.createDataFrame([("k", "a", 1)], "id string, source_id string, ingested_at long").write.parquet(f"{tmp_path}/kb_index_chunks.parquet")
    got = {r.id: r.line.split(",")[3].strip('"') for r in LQ.document_manifest(spark, str(tmp_path)).collect()}
    assert got == {i: shown for i, (_, shown) in sizes.items()}
