"""Queries of questions, passages, the library, its exports and the record store, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import questions as Q
from ..functions.text import SPACE
from ..operators import library as L
from ..operators import passages as P
from ..operators import questions as QO
from ..session import table
from ..sources.readers import record_cells
from ..streaming import live

NEEDLE, TAG, SPLIT_AT = "policy", "SOC 2", "2025-06-01"


def once(spark: SparkSession, sf_dir: str, name: str, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    """A table, or some of its columns, with each record once, as last delivered."""
    return L.latest(table(spark, sf_dir, name), key, F.col("ingested_at"), columns)


def entries(spark, sf_dir):
    return once(spark, sf_dir, "kb_entries")


def docs(spark, sf_dir):
    return once(spark, sf_dir, "kb_documents")


def chunks(spark, sf_dir, *columns):
    """The chunks with these columns; has_vector stands for the vectors where only their being there counts."""
    c = table(spark, sf_dir, "kb_index_chunks")
    if "has_vector" in columns:
        c = c.withColumn("has_vector", F.col("embedding").isNotNull())
    return L.latest(c, "id", F.col("ingested_at"), ["id", *columns])


def questions(spark, sf_dir):
    return once(spark, sf_dir, "questions", "question_id")


def drafts(spark, sf_dir):
    d = once(spark, sf_dir, "questionnaires")
    done = L.status_counts(once(spark, sf_dir, "questions", "question_id", ["question_id", "questionnaire_id", "answer_text", "status"])).select(F.col("questionnaire_id").alias("id"), "answered", "questions")
    return d.join(done, "id", "left").fillna(0, ["answered", "questions"])


def question_line_scores(spark, sf_dir):
    q = once(spark, sf_dir, "questions", "question_id", ["question_id", "question_text"])
    return Q.with_scored(q, "question_text").select("question_id", "s.*")


def question_dedupe(spark, sf_dir):
    q = once(spark, sf_dir, "questions", "question_id", ["question_id", "questionnaire_id", "question_text"])
    s = Q.with_scored(q, "question_text").select("questionnaire_id", "question_id", "s.text", "s.score")
    return QO.deduped(s, ["questionnaire_id"], "question_id", spread=True).select("questionnaire_id", "question_id", "text", "score", "index")


def extract_questions(spark, sf_dir):
    return QO.from_text(table(spark, sf_dir, "documents").select("doc_id", "text"))


def extraction_stats(spark, sf_dir):
    return QO.extraction_stats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def grid_cells(spark, sf_dir):
    """The rows of the question files as workbooks: one sheet a file, cells in long form."""
    rec = table(spark, sf_dir, "question_csv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [record_cells(r, d) for r, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.string()))], ["file_id", "line_no", "parts"])

    src = rec.filter("record is not null").select("file_id", F.col("line_no").cast("long").alias("line_no"), "record", F.coalesce("delimiter", F.lit(",")).alias("sep"))
    rows = src.mapInArrow(run, "file_id string, line_no long, parts array<string>").withColumn("line_no", F.col("line_no").cast(rec.schema["line_no"].dataType))
    c = rows.select(F.col("file_id").alias("workbook"), (F.col("line_no") - 1).alias("row_idx"), F.col("line_no").alias("row_no"), F.posexplode("parts").alias("col", "cell"))
    return c.select("workbook", F.lit(0).alias("sheet_ord"), F.lit("Questions").alias("sheet"), F.lit(False).alias("hidden"), "row_idx", "row_no", "col", "cell")


def grid_column_choice(spark, sf_dir):
    return QO.column_choice(grid_cells(spark, sf_dir)).select("workbook", "col", F.round("mean", 6).alias("mean"), "hits")


def grid_questions(spark, sf_dir):
    return QO.from_grid(grid_cells(spark, sf_dir)).select("workbook", "index", "col", "row", "text", "score")


def chunk_passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return P.passages(d.select("doc_id", F.array(F.struct(F.lit(1).alias("page"), "text")).alias("pages")))


def qa_pairs(spark, sf_dir):
    return L.qa_rows(entries(spark, sf_dir))


def current_sources(spark, sf_dir):
    c = L.current_sources(chunks(spark, sf_dir, "source_type", "source_id", "source_name"), docs(spark, sf_dir), entries(spark, sf_dir))
    return c.select("id", "source_name", "source_date", "source_saved_at")


def index_coverage(spark, sf_dir):
    return L.coverage(docs(spark, sf_dir), entries(spark, sf_dir), chunks(spark, sf_dir, "source_id", "source_type", "has_vector"))


def pending_backfill(spark, sf_dir):
    return L.pending(docs(spark, sf_dir), entries(spark, sf_dir), chunks(spark, sf_dir, "source_id"))


def document_manifest(spark, sf_dir):
    return L.manifest(docs(spark, sf_dir), chunks(spark, sf_dir, "source_id"))


def answer_history_csv(spark, sf_dir):
    return L.answer_history(entries(spark, sf_dir))


def assessments_csv(spark, sf_dir):
    return L.assessments(drafts(spark, sf_dir))


def library_filter(spark, sf_dir):
    d = L.filtered(docs(spark, sf_dir), NEEDLE, ["name", "category", "note"])
    e = L.filtered(entries(spark, sf_dir), "", ["vendor"], [TAG])
    return d.select(F.lit("document").alias("kind"), "id").unionByName(e.select(F.lit("entry").alias("kind"), "id"))


def library_kpis(spark, sf_dir):
    return L.kpis(entries(spark, sf_dir))


def distinct_tags(spark, sf_dir):
    return L.distinct_tags(entries(spark, sf_dir), docs(spark, sf_dir))


def questionnaires_union(spark, sf_dir):
    return L.questionnaires(entries(spark, sf_dir), drafts(spark, sf_dir))


def questionnaire_progress(spark, sf_dir):
    return L.status_counts(questions(spark, sf_dir))


def export_counts(spark, sf_dir):
    return L.export_counts(entries(spark, sf_dir), drafts(spark, sf_dir), docs(spark, sf_dir), chunks(spark, sf_dir, "source_id", "has_vector"))


def export_nested_answers(spark, sf_dir):
    return L.nested_answers(entries(spark, sf_dir)).select("id", F.size("answers").alias("n"), F.transform("answers", lambda a: F.concat_ws("|", a["position"].cast("string"), a["question"], a["answer"], a["status"], F.coalesce(a["citation"], F.lit("-")))).alias("answers"))


def export_bundle(spark, sf_dir):
    return L.export_bundle(entries(spark, sf_dir), drafts(spark, sf_dir), docs(spark, sf_dir), once(spark, sf_dir, "kb_index_chunks"))


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("records").alias("collection"), F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") == "purchase", "delete").otherwise("put").alias("op"), F.unix_micros(F.col("ts").cast("timestamp")).alias("version"), F.col("event_id").alias("seq"), F.col("props").alias("body"))


def merge_latest_wins(spark, sf_dir):
    return L.replayed(_log(spark, sf_dir))


def tombstone_anti(spark, sf_dir):
    d = docs(spark, sf_dir)
    old, new = d.filter(F.col("saved_at") < SPLIT_AT), d.filter(F.coalesce(F.col("saved_at") >= SPLIT_AT, F.lit(True))).withColumn("category", F.lit("local"))
    return L.merged(old, new, d.filter("size_bytes = 0").select("id")).select("id", "category")


def session_coalesce(spark, sf_dir):
    return live.coalesced(table(spark, sf_dir, "events"), "user_id", "ts", "600 seconds")


def _runs(spark, sf_dir):
    """Two runs over the same questions, made of the answers of each question's neighbour, for the refresh."""
    q = questions(spark, sf_dir).filter("saved_at is not null")
    return q.select("question_id", "status", F.col("answer_text").alias("answer"), F.col("confidence").cast("int").alias("confidence"), F.col("source_citation").alias("chunk_id"), F.col("questionnaire_id").alias("source_id"), F.col("source_citation").alias("source_name"), "saved_at", (F.col("question_id") % 7 == 0).alias("touched"))


def refresh_merge(spark, sf_dir):
    cur = _runs(spark, sf_dir)
    nxt = cur.select((F.col("question_id") + 1).alias("question_id"), *[c for c in cur.columns if c not in ("question_id", "touched")])
    r = live.refreshed(cur, nxt)
    return r.select("question_id", "status", "answer", "confidence", "chunk_id", "touched", F.col("update.score").alias("update_score"), F.col("update.previous_score").alias("update_previous"))


def worth_flagging(spark, sf_dir):
    return refresh_merge(spark, sf_dir).filter("update_score is not null").select("question_id", "update_score", "update_previous")


def knowledge_signature(spark, sf_dir):
    return L.signature(docs(spark, sf_dir), entries(spark, sf_dir))


def guess_category(spark, sf_dir):
    return docs(spark, sf_dir).select("id", N.guess_category(F.col("name")).alias("category"))


def normalise_doc_name(spark, sf_dir):
    return docs(spark, sf_dir).select("id", N.document_name(F.concat(F.lit("../"), F.col("name"))).alias("name"))


def delimiter_guess(spark, sf_dir):
    r = table(spark, sf_dir, "question_csv")
    return r.select("line_id", N.delimiter(F.col("record")).alias("guessed"))


def notification_filter(spark, sf_dir):
    n = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), (F.col("value") > 50).alias("read"))
    return L.notifications(n, "unread").select("event_id", "type")


QUERIES = {
    f.__name__: f
    for f in (
        question_line_scores, question_dedupe, extract_questions, extraction_stats, grid_column_choice, grid_questions, chunk_passages, qa_pairs, current_sources, index_coverage, pending_backfill, document_manifest, answer_history_csv,
        assessments_csv, library_filter, library_kpis, distinct_tags, questionnaires_union, questionnaire_progress, export_counts, export_nested_answers, export_bundle, merge_latest_wins, tombstone_anti, session_coalesce, refresh_merge,
        worth_flagging, knowledge_signature, guess_category, normalise_doc_name, delimiter_guess, notification_filter,
    )
}


def _once(name: str, key: str = "id") -> str:
    return f"(SELECT DISTINCT ON ({key}) * FROM {name} ORDER BY {key}, ingested_at DESC)"


_T = f"WITH e AS {_once('kb_entries')}, d AS {_once('kb_documents')}, c AS {_once('kb_index_chunks')}, q AS {_once('questions', 'question_id')}, n AS {_once('questionnaires')}"
_LINE, _PLAIN, _TEXT, _SCORE, _SIGNALS = Q.scored_sql("question_text")
_SCORED = _T + f", l AS (SELECT *, {_LINE} AS l FROM q), p AS (SELECT *, {_PLAIN} AS p FROM l), s AS (SELECT question_id, questionnaire_id, {_TEXT} AS text, {_SCORE} AS score, {_SIGNALS} AS signals FROM p)"
_DRAFT = _T + ", g AS (SELECT questionnaire_id AS id, count(*) AS questions, count(*) FILTER (regexp_matches(coalesce(answer_text, ''), '__NB__')) AS answered, count(*) FILTER (status = 'needs-input') AS needs_input, count(*) FILTER (status = 'flagged') AS flagged FROM q GROUP BY 1), dr AS (SELECT n.*, coalesce(answered, 0) AS done FROM n LEFT JOIN g USING (id))"
_UNION = (
    _DRAFT
    + """, u AS (
  SELECT id, coalesce(vendor, '') AS vendor, 'complete' AS status, NULL AS step, CAST(coalesce(question_count, len(coalesce(qa_data, []))) AS BIGINT) AS question_count,
    CAST(coalesce(answered, len(list_filter(coalesce(qa_data, []), lambda x: regexp_matches(coalesce(x.answer, ''), '__NB__')))) AS BIGINT) AS answered_count, saved_at FROM e
  UNION ALL SELECT id, coalesce(vendor, ''), 'in_progress', coalesce(step, 'intake'), CAST(coalesce(question_count, 0) AS BIGINT), CAST(done AS BIGINT), saved_at FROM dr)"""
)
_RUNS = (
    _T
    + """, cur AS (SELECT question_id, status, answer_text AS answer, CAST(trunc(confidence) AS INTEGER) AS confidence, source_citation AS chunk_id, questionnaire_id AS source_id, saved_at, question_id % 7 = 0 AS touched FROM q WHERE saved_at IS NOT NULL
), j AS (SELECT cur.*, x.question_id IS NOT NULL AS has, x.status AS ns, x.answer AS na, x.confidence AS nc, x.chunk_id AS nch, x.source_id AS nsi, x.saved_at AS nsa FROM cur LEFT JOIN cur x ON cur.question_id = x.question_id + 1
), k AS (SELECT *, has AND NOT regexp_matches(coalesce(answer, ''), '__NB__') AND NOT touched AS free FROM j
), r AS (SELECT question_id, CASE WHEN free THEN ns ELSE status END AS status, CASE WHEN free THEN na ELSE answer END AS answer, CASE WHEN free THEN nc ELSE confidence END AS confidence, CASE WHEN free THEN nch ELSE chunk_id END AS chunk_id,
    CASE WHEN free THEN false ELSE touched END AS touched,
    NOT free AND has AND nch IS NOT NULL AND nch IS DISTINCT FROM chunk_id AND coalesce(nsi, '') <> coalesce(nullif(source_id, ''), chr(1)) AND (coalesce(nc, 0) - coalesce(confidence, 0) >= 5 OR (nsa > saved_at AND coalesce(nc, 0) - coalesce(confidence, 0) >= -5)) AS flag, nc, confidence AS oc FROM k
), f AS (SELECT question_id, status, answer, confidence, chunk_id, touched, CASE WHEN flag THEN nc END AS update_score, CASE WHEN flag THEN coalesce(oc, 0) END AS update_previous FROM r)"""
)


def _csv(*exprs: str) -> str:
    return " || ',' || ".join(f"({N.csv_field_sql(x)})" for x in exprs)


_GRID_L, _GRID_P, _GRID_T, _GRID_S, _ = Q.scored_sql("cell")

SQL = {
    "question_line_scores": _SCORED + " SELECT question_id, text, score, signals FROM s",
    "question_dedupe": _SCORED
    + """, k AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM s), b AS (SELECT *, min(question_id) OVER (PARTITION BY questionnaire_id, key) AS first, row_number() OVER (PARTITION BY questionnaire_id, key ORDER BY score DESC, question_id) AS r FROM k WHERE key <> '')
SELECT questionnaire_id, question_id, text, score, CAST(row_number() OVER (PARTITION BY questionnaire_id ORDER BY first) - 1 AS INTEGER) AS index FROM b WHERE r = 1""",
    "qa_pairs": _T
    + """, p AS (SELECT id, vendor, entry_date, industry, unnest(qa_data) AS x, generate_subscripts(qa_data, 1) AS pos FROM e)
SELECT 'qa' AS source_type, id AS source_id, coalesce(nullif(concat_ws(' · ', nullif(vendor, ''), nullif(entry_date, '')), ''), 'Previous questionnaire') AS source_name, coalesce(industry, '') AS category, regexp_replace(x.text, '__TR__', '', 'g') AS question, regexp_replace(x.answer, '__TR__', '', 'g') AS text, CAST(NULL AS INTEGER) AS page,
  CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS chunk_index FROM p WHERE regexp_matches(coalesce(x.text, ''), '__NB__') AND regexp_matches(coalesce(x.answer, ''), '__NB__')""",
    "current_sources": _T
    + """ SELECT c.id, coalesce(nullif(d.name, ''), c.source_name) AS source_name, CASE WHEN c.source_type = 'document' THEN d.doc_date ELSE e.entry_date END AS source_date, CASE WHEN c.source_type = 'document' THEN d.saved_at ELSE e.saved_at END AS source_saved_at
FROM c LEFT JOIN d ON c.source_type = 'document' AND d.id = c.source_id LEFT JOIN e ON c.source_type = 'qa' AND e.id = c.source_id""",
    "index_coverage": _T
    + """, have AS (SELECT DISTINCT source_id AS id FROM c WHERE source_id IS NOT NULL), pd AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM have)), pe AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM have) AND len(list_filter(qa_data, lambda x: regexp_matches(coalesce(x.answer, ''), '__NB__'))) > 0)
SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c WHERE embedding IS NULL) AS without_vectors, (SELECT count(*) FROM c WHERE source_type = 'document') AS document_chunks, (SELECT count(*) FROM c WHERE source_type = 'qa') AS qa_chunks,
  (SELECT count(*) FROM pd WHERE coalesce(storage_path, '') <> '') AS pending_docs, (SELECT count(*) FROM pe) AS pending_entries, (SELECT count(*) FROM pd WHERE coalesce(storage_path, '') = '') AS unindexable_docs""",
    "pending_backfill": _T
    + """, have AS (SELECT DISTINCT source_id AS id FROM c WHERE source_id IS NOT NULL)
SELECT 'document' AS kind, id, CASE WHEN coalesce(storage_path, '') <> '' THEN 'pending' ELSE 'unindexable' END AS state FROM d WHERE id NOT IN (SELECT id FROM have)
UNION ALL SELECT 'entry', id, 'pending' FROM e WHERE id NOT IN (SELECT id FROM have) AND len(list_filter(qa_data, lambda x: regexp_matches(coalesce(x.answer, ''), '__NB__'))) > 0""",
    "document_manifest": _T + f", x AS (SELECT d.*, array_to_string(coalesce(tags, []), '; ') AS t, CASE WHEN coalesce(size_bytes, 0) < 1024 THEN coalesce(size_bytes, 0) || ' B' WHEN size_bytes < 1048576 THEN CAST(round(size_bytes / 1024.0) AS BIGINT) || ' KB' ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS sz, CASE WHEN coalesce(storage_path, '') <> '' THEN 'stored' ELSE 'metadata only' END AS st, CASE WHEN id IN (SELECT source_id FROM c WHERE source_id IS NOT NULL) THEN 'searchable' ELSE 'not indexed' END AS ix FROM d) SELECT id, {_csv('name', 'category', 'doc_date', 'sz', 'note', 't', 'st', 'ix')} AS line FROM x",
    "answer_history_csv": _T + f", x AS (SELECT id, vendor, entry_date, industry, array_to_string(coalesce(tags, []), '; ') AS t, confidence, unnest(qa_data) AS p, generate_subscripts(qa_data, 1) - 1 AS pos FROM e), y AS (SELECT *, p.text AS pt, p.answer AS pa, p.source AS ps FROM x) SELECT id, CAST(pos AS INTEGER) AS pos, {_csv('vendor', 'entry_date', 'industry', 't', 'confidence', 'pt', 'pa', 'ps')} AS line FROM y",
    "assessments_csv": _T + f", x AS (SELECT *, coalesce(progress, 0) || '%' AS pr, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved FROM n) SELECT id, {_csv('vendor', 'step', 'owner', 'assignee', 'pr', 'question_count', 'saved')} AS line FROM x",
    "library_filter": _T
    + f""" SELECT 'document' AS kind, id FROM d WHERE contains(lower(coalesce(name, '')), '{NEEDLE}') OR contains(lower(coalesce(category, '')), '{NEEDLE}') OR contains(lower(coalesce(note, '')), '{NEEDLE}') OR len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), '{NEEDLE}'))) > 0
UNION ALL SELECT 'entry', id FROM e WHERE list_contains(coalesce(tags, []), '{TAG}')""",
    "library_kpis": _T + " SELECT count(*) FILTER (source = 'Complete questionnaire') AS completed, coalesce(sum(coalesce(question_count, 0)), 0) AS questions, coalesce(CAST(floor(avg(coalesce(confidence, 0)) + 0.5) AS INTEGER), 0) AS mean_confidence FROM e",
    "distinct_tags": _T + " SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag FROM e UNION ALL SELECT unnest(tags) FROM d) WHERE tag IS NOT NULL",
    "questionnaires_union": _UNION + " SELECT * FROM u",
    "questionnaire_progress": _DRAFT + " SELECT id AS questionnaire_id, questions, answered, needs_input, flagged, CAST(floor(100 * answered / questions + 0.5) AS INTEGER) AS progress FROM g",
    "export_counts": _UNION
    + """ SELECT (SELECT count(*) FROM u) AS questionnaires, (SELECT count(*) FROM e) AS completed, (SELECT count(*) FROM n) AS in_progress, CAST((SELECT coalesce(sum(len(coalesce(qa_data, []))), 0) FROM e) + (SELECT count(*) FROM q WHERE questionnaire_id IN (SELECT id FROM n)) AS BIGINT) AS answers, (SELECT count(*) FROM d) AS documents,
  (SELECT count(*) FROM d WHERE id IN (SELECT source_id FROM c WHERE source_id IS NOT NULL)) AS indexed_documents, (SELECT count(*) FROM c) AS passages, (SELECT count(embedding) FROM c) AS passages_with_vectors""",
    "export_nested_answers": _T
    + """ SELECT id, len(coalesce(qa_data, [])) AS n, list_transform(coalesce(qa_data, []), lambda x, i: concat_ws('|', i, coalesce(x.text, ''), coalesce(x.answer, ''), CASE WHEN regexp_matches(coalesce(x.answer, ''), '__NB__') THEN 'answered' ELSE 'unanswered' END, coalesce(nullif(x.source, ''), '-'))) AS answers FROM e""",
    "merge_latest_wins": "SELECT 'records' AS collection, id, version, body FROM (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'put' END AS op, epoch_us(ts) AS version, props AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND op = 'put'",
    "tombstone_anti": _T + f" SELECT id, CASE WHEN saved_at < TIMESTAMP '{SPLIT_AT}' THEN category ELSE 'local' END AS category FROM d WHERE coalesce(size_bytes, -1) <> 0",
    "session_coalesce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 600 SECOND THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS events FROM h GROUP BY user_id, k""",
    "refresh_merge": _RUNS + " SELECT * FROM f",
    "worth_flagging": _RUNS + " SELECT question_id, update_score, update_previous FROM f WHERE update_score IS NOT NULL",
    "knowledge_signature": _T + " SELECT (SELECT count(*) FROM d) || ':' || (SELECT count(*) FROM e) || ':' || coalesce(strftime((SELECT max(saved_at) FROM (SELECT saved_at FROM d UNION ALL SELECT saved_at FROM e)), '%Y-%m-%dT%H:%M:%S.%gZ'), '') AS signature",
    "guess_category": _T + f" SELECT id, {N.guess_category_sql('name')} AS category FROM d",
    "normalise_doc_name": _T + ", x AS (SELECT id, '../' || name AS name FROM d) SELECT id, " + N.document_name_sql("x.name") + " AS name FROM x",
    "delimiter_guess": """SELECT line_id, CASE WHEN c >= s AND c >= t THEN ',' WHEN s >= t THEN ';' ELSE chr(9) END AS guessed FROM (SELECT line_id, length(h) - length(replace(h, ',', '')) AS c, length(h) - length(replace(h, ';', '')) AS s, length(h) - length(replace(h, chr(9), '')) AS t FROM (SELECT line_id, left(coalesce(record, ''), 4000) AS h FROM question_csv))""",
    "notification_filter": "SELECT event_id, event_type AS type FROM events WHERE NOT (value > 50)",
}

_NOT_BLANK, _ENDS = f"[^{SPACE}]", f"^[{SPACE}]+|[{SPACE}]+$"
SQL = {k: v.replace("__NB__", _NOT_BLANK).replace("__TR__", _ENDS) for k, v in SQL.items()}
