"""Queries of collections: scopes, orders, projections, migrations, totals and scalar helpers; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import questions as Q
from ..functions.text import SPACE
from ..operators import passages as P
from ..operators import store as S
from ..session import table
from .library_queries import _T, SPLIT_AT, chunks, docs, drafts, entries, once

NEEDLE, OWNER = "retention", "shared"


def owner_listing(spark, sf_dir):
    d = docs(spark, sf_dir)
    return S.listed(d, gone=d.filter("size_bytes = 0")).select("owner_key", "id", "place")


def chunks_by_field(spark, sf_dir):
    return S.by_field(chunks(spark, sf_dir, "source_type", "source_id"), "source_type", "qa").select("id", "source_id")


def chunk_order(spark, sf_dir):
    return S.in_chunk_order(chunks(spark, sf_dir, "source_id", "chunk_index")).select("source_id", "id", "place")


def trimmed_suggestions(spark, sf_dir):
    q = once(spark, sf_dir, "questions", "question_id", ["question_id", "answer_text"])
    return S.trimmed_suggestions(q.withColumn("alternatives", F.array("answer_text")), "answer_text")


def mirror_rows(spark, sf_dir):
    return S.mirrored(chunks(spark, sf_dir, "source_id", "text", "embedding_dims"))


def embedding_targets(spark, sf_dir):
    return chunks(spark, sf_dir, "source_type", "question", "text").select("id", S.embedding_target().alias("target"))


def vectors_joined(spark, sf_dir):
    """Chunks of answers with the vectors that the index already has for the same words."""
    c = chunks(spark, sf_dir, "source_type", "question", "text", "has_vector", "embedding_dims").filter(F.col("has_vector") & (F.col("embedding_dims") > 0))
    known = c.groupBy(S.embedding_target().alias("text")).agg(F.max("embedding_dims").alias("d")).select("text", F.array_repeat(F.lit(0.5), F.col("d")).alias("vector"))
    rows = chunks(spark, sf_dir, "source_type", "question", "text")
    return S.with_vectors(rows, known, "table").select("id", "embedding_dims", "embedding_model")


def document_index_rows(spark, sf_dir):
    """The corpus indexed as documents: passages with the rows they become."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("vendor").alias("category"), "text")
    p = P.passages(d.select(F.col("id").alias("doc_id"), F.array(F.struct(F.lit(1).alias("page"), "text")).alias("pages")))
    return S.passage_rows(p, d)


def backfill_totals(spark, sf_dir):
    """What indexing the pending documents and entries gave: their texts are their notes and answers."""
    from ..operators import library as L

    d, e = docs(spark, sf_dir), entries(spark, sf_dir)
    p = L.pending(d, e, chunks(spark, sf_dir, "source_id"))
    rows = L.qa_rows(e).select("source_id").unionByName(d.filter("length(note) >= 10").select(F.col("id").alias("source_id")))
    return S.backfill_totals(p, rows)


def reindex(spark, sf_dir):
    """Answers of all entries indexed anew: their old chunks go, those of other sources stay."""
    from ..operators import library as L

    rows = L.qa_rows(entries(spark, sf_dir)).select("source_type", "source_id", "chunk_index")
    return S.reindexed(chunks(spark, sf_dir, "source_type", "source_id", "chunk_index").drop("id"), rows).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last"))


def review_seed(spark, sf_dir):
    return S.review_seed(once(spark, sf_dir, "questions", "question_id", ["question_id", "questionnaire_id", "question_text", "sort_order"]))


def completed_entries(spark, sf_dir):
    q = once(spark, sf_dir, "questions", "question_id", ["question_id", "questionnaire_id", "question_text", "answer_text", "source_citation", "sort_order"])
    e = S.completed(q, once(spark, sf_dir, "questionnaires"))
    flat = F.transform("qa_data", lambda p: F.concat_ws("|", F.coalesce(p["text"], F.lit("-")), F.coalesce(p["answer"], F.lit("-")), F.coalesce(p["source"], F.lit("-"))))
    return e.select("id", "vendor", "question_count", "answered", "confidence", "source", flat.alias("pairs"))


def profile_defaults(spark, sf_dir):
    d = once(spark, sf_dir, "questionnaires")
    prefs = S.merged_prefs(F.create_map(F.lit("mail"), F.lit(True), F.lit("feed"), F.lit(True)), F.create_map(F.lit("mail"), F.col("progress") > 50))
    out = S.without_blanks(d, owner="nobody", assignee="nobody", step="intake")
    return out.select("id", "owner", "assignee", "step", F.coalesce(prefs["mail"], F.lit(False)).alias("mail"), prefs["feed"].alias("feed"), N.initials(F.col("owner")).alias("initials"))


def migration_missing(spark, sf_dir):
    d = docs(spark, sf_dir)
    remote, gone = d.filter(F.col("saved_at") < SPLIT_AT), d.filter("size_bytes = 0")
    return S.rekeyed(S.missing(d, remote, gone), OWNER).select("id", "owner_key")


def restore_counts(spark, sf_dir):
    d = docs(spark, sf_dir)
    return S.restore_counts(d.filter(F.col("saved_at") < SPLIT_AT), table(spark, sf_dir, "kb_documents"))


def dashboard_kpis(spark, sf_dir):
    feed = table(spark, sf_dir, "events").select((F.col("value") > 50).alias("read"))
    return S.dashboard(entries(spark, sf_dir), once(spark, sf_dir, "questionnaires"), feed)


def people(spark, sf_dir):
    return S.people(once(spark, sf_dir, "questionnaires"))


def article_search(spark, sf_dir):
    return S.found_in(table(spark, sf_dir, "documents"), NEEDLE, "source", "text").select("doc_id")


def documents_of_owner(spark, sf_dir):
    d = docs(spark, sf_dir)
    n = S.nested(once(spark, sf_dir, "questionnaires").select(F.col("vendor").alias("id")).filter("id is not null").distinct(), entries(spark, sf_dir).select("id", "vendor", "source").unionByName(d.select("id", F.lit("none").alias("vendor"), "source")), "vendor", ["id", "source"])
    return n.select("id", F.transform("children", lambda c: F.concat_ws("|", c["id"], c["source"])).alias("children"))


def positions_zipped(spark, sf_dir):
    """The questions of each two neighbouring questionnaires side by side, by their place."""
    q = review_seed(spark, sf_dir).select(F.concat_ws("/", "questionnaire_id", "position").alias("position"), "question_id")
    e = entries(spark, sf_dir).select("id", F.posexplode("qa_data").alias("n", "p")).select(F.concat_ws("/", "id", F.col("n") + 1).alias("position"), F.col("p.answer").alias("answer"))
    return S.zipped(q, e)


def coerced_fields(spark, sf_dir):
    d = docs(spark, sf_dir)
    sizes = F.when(F.col("size_bytes") % 3 == 0, F.lit("n/a")).otherwise((F.col("size_bytes") / 7).cast("string"))
    return d.select("id", S.iso(F.col("saved_at")).alias("saved"), S.count(sizes).alias("size"), S.count((-F.col("size_bytes")).cast("string")).alias("below"), S.texts(F.col("tags")).alias("tags"), F.coalesce("note", F.lit("")).alias("note"))


def name_helpers(spark, sf_dir):
    d = docs(spark, sf_dir)
    age = N.time_ago(F.col("saved_at"), F.col("ingested_at"))
    return d.select("id", N.safe_name(F.col("name")).alias("safe"), N.without_ending(F.col("name")).alias("vendor"), N.initials(F.col("category")).alias("initials"), age.alias("age"), N.shown_bytes(F.col("size_bytes")).alias("bytes"))


def column_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.column_label(F.col("p_partkey") - 1).alias("label"), N.column_index(N.column_label(F.col("p_partkey") - 1)).alias("place"))


def typed_questions(spark, sf_dir):
    from ..operators import questions as QO

    q = once(spark, sf_dir, "questions", "question_id", ["question_id", "question_text"])
    return QO.from_lines(q.select(F.col("question_id").cast("string").alias("doc_id"), F.col("question_text").alias("text"))).select("doc_id", "index", "text", "score")


def feed_counts(spark, sf_dir):
    """Messages under each filter of the feed."""
    from ..operators import library as L

    kinds = F.create_map(*[F.lit(x) for x in ("view", "review", "click", "approval", "purchase", "assigned", "signup", "vendor")])
    n = table(spark, sf_dir, "events").select(F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("vendor")).alias("type"), (F.col("value") > 50).alias("read"))
    one = [L.notifications(n, k).agg(F.lit(k).alias("filter"), F.count(F.lit(1)).alias("n")) for k in ("all", "unread", "review", "assigned", "vendor")]
    return one[0].union(one[1]).union(one[2]).union(one[3]).union(one[4])


QUERIES = {
    f.__name__: f
    for f in (
        owner_listing, chunks_by_field, chunk_order, trimmed_suggestions, mirror_rows, embedding_targets, vectors_joined, document_index_rows, backfill_totals, reindex, review_seed, completed_entries, profile_defaults, migration_missing,
        restore_counts, dashboard_kpis, people, article_search, documents_of_owner, positions_zipped, coerced_fields, name_helpers, column_labels, typed_questions, feed_counts,
    )
}

_NB, _ENDS = f"[^{SPACE}]", f"^[{SPACE}]+|[{SPACE}]+$"
_QA = f", p AS (SELECT id, unnest(qa_data) AS x, generate_subscripts(qa_data, 1) AS pos FROM e), u AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS k FROM p WHERE regexp_matches(coalesce(x.text, ''), '{_NB}') AND regexp_matches(coalesce(x.answer, ''), '{_NB}'))"
_TARGET = "CASE WHEN source_type = 'qa' THEN coalesce(nullif(question, ''), text) ELSE text END"
_SEED = _T + ", s AS (SELECT questionnaire_id, question_id, CAST(row_number() OVER (PARTITION BY questionnaire_id ORDER BY sort_order NULLS FIRST, question_id) AS INTEGER) AS position, coalesce(question_text, '') AS text FROM q)"


def _initials(e: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace(coalesce({e}, ''), '{_ENDS}', '', 'g'), '\\s+'), lambda w: w <> '')"
    return f"coalesce(nullif(upper(left(array_to_string(list_transform({words}, lambda w: left(w, 1)), ''), 2)), ''), 'Y')"


def _line_sql() -> str:
    def trim(e: str) -> str:
        return f"regexp_replace({e}, '{_ENDS}', '', 'g')"

    line = trim("l")
    for p in (Q.CONTROL_ID, Q.MARKER, Q.BULLET):
        line = f"regexp_replace({line}, '{p.replace(chr(92) + 's', f'[{SPACE}]')}', '')"
    line = trim(line)
    line = f"regexp_replace({line}, '[{SPACE}]*\\|[{SPACE}]*', ' — ', 'g')"
    line = f"regexp_replace({line}, '[{SPACE}]{{2,}}', ' ', 'g')"
    line = f"regexp_replace({line}, '[{SPACE}]+([?.,;:])', '\\1', 'g')"
    return trim(f"regexp_replace({line}, '[{SPACE}—–-]+$', '')")


SQL = {
    "owner_listing": _T + " SELECT owner_key, id, CAST(row_number() OVER (PARTITION BY owner_key ORDER BY saved_at DESC NULLS LAST, id) - 1 AS INTEGER) AS place FROM d WHERE id NOT IN (SELECT id FROM d WHERE size_bytes = 0)",
    "chunks_by_field": _T + " SELECT id, source_id FROM c WHERE source_type = 'qa'",
    "chunk_order": _T + " SELECT source_id, id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY chunk_index NULLS FIRST, id) - 1 AS INTEGER) AS place FROM c",
    "trimmed_suggestions": _T + " SELECT question_id, CASE WHEN length(answer_text) > 240 THEN trim(left(answer_text, 240)) || '…' ELSE answer_text END AS answer_text, coalesce(length(answer_text) > 240, false) AS truncated FROM q",
    "mirror_rows": _T + " SELECT id, source_id, text, embedding_dims FROM c",
    "embedding_targets": _T + f" SELECT id, {_TARGET} AS target FROM c",
    "vectors_joined": _T + f", t AS (SELECT id, {_TARGET} AS t, embedding, embedding_dims FROM c), k AS (SELECT t, max(embedding_dims) AS d FROM t WHERE embedding IS NOT NULL AND embedding_dims > 0 GROUP BY t) SELECT t.id, CAST(k.d AS INTEGER) AS embedding_dims, CASE WHEN k.d IS NOT NULL THEN 'table' END AS embedding_model FROM t LEFT JOIN k ON t.t = k.t",
    "backfill_totals": _T
    + _QA
    + f""", have AS (SELECT DISTINCT source_id AS id FROM c WHERE source_id IS NOT NULL), due AS (SELECT id FROM d WHERE id NOT IN (SELECT id FROM have) AND coalesce(storage_path, '') <> '' UNION ALL SELECT id FROM e WHERE id NOT IN (SELECT id FROM have) AND len(list_filter(qa_data, lambda x: regexp_matches(coalesce(x.answer, ''), '{_NB}'))) > 0),
  r AS (SELECT id, count(*) AS n FROM (SELECT id FROM u UNION ALL SELECT id FROM d WHERE length(note) >= 10) GROUP BY id)
SELECT count(*) AS due, count(r.n) AS indexed, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS rows, count(*) FILTER (r.n IS NULL) AS without_text FROM due LEFT JOIN r USING (id)""",
    "reindex": _T + _QA + " SELECT source_id, count(*) AS n, CAST(max(k) AS INTEGER) AS last FROM (SELECT source_id, chunk_index AS k FROM c WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM u) UNION ALL SELECT id, k FROM u) GROUP BY source_id",
    "review_seed": _SEED + " SELECT questionnaire_id, question_id, position, text, '' AS answer, CAST(0 AS INTEGER) AS confidence, '' AS source, 'needs-input' AS status FROM s",
    "completed_entries": _T
    + f""", g AS (SELECT questionnaire_id AS id, count(*) AS question_count, count(*) FILTER (regexp_matches(coalesce(answer_text, ''), '{_NB}')) AS answered, list(concat_ws('|', coalesce(question_text, '-'), coalesce(answer_text, '-'), coalesce(source_citation, '-')) ORDER BY sort_order NULLS FIRST, question_id) AS pairs FROM q GROUP BY 1)
SELECT n.id, coalesce(nullif(n.vendor, ''), 'Unnamed vendor') AS vendor, g.question_count, g.answered, CAST(floor(100 * g.answered / g.question_count + 0.5) AS INTEGER) AS confidence, 'Complete questionnaire' AS source, g.pairs FROM n JOIN g USING (id)""",
    "profile_defaults": _T
    + f", x AS (SELECT id, CASE WHEN regexp_matches(coalesce(owner, ''), '{_NB}') THEN owner ELSE 'nobody' END AS owner, CASE WHEN regexp_matches(coalesce(assignee, ''), '{_NB}') THEN assignee ELSE 'nobody' END AS assignee, CASE WHEN regexp_matches(coalesce(step, ''), '{_NB}') THEN step ELSE 'intake' END AS step, coalesce(progress > 50, false) AS mail FROM n) SELECT id, owner, assignee, step, mail, true AS feed, {_initials('owner')} AS initials FROM x",
    "migration_missing": _T + f" SELECT id, '{OWNER}' AS owner_key FROM d WHERE NOT coalesce(saved_at < TIMESTAMP '{SPLIT_AT}', false) AND NOT coalesce(size_bytes = 0, false)",
    "restore_counts": _T + f", h AS (SELECT id FROM d WHERE saved_at < TIMESTAMP '{SPLIT_AT}') SELECT count(DISTINCT id) FILTER (id NOT IN (SELECT id FROM h)) AS added, count(DISTINCT id) FILTER (id IN (SELECT id FROM h)) AS skipped FROM kb_documents",
    "dashboard_kpis": _T + " SELECT (SELECT count(*) FROM e) AS completed, CAST((SELECT coalesce(sum(question_count), 0) FROM e) AS BIGINT) AS questions_answered, (SELECT count(*) FROM n) AS in_progress, (SELECT count(*) FROM events WHERE NOT value > 50) AS unread",
    "people": _T + f" SELECT DISTINCT person FROM (SELECT owner AS person FROM n UNION ALL SELECT assignee FROM n) WHERE regexp_matches(coalesce(person, ''), '{_NB}')",
    "article_search": f"SELECT doc_id FROM documents WHERE contains(lower(coalesce(source, '')), '{NEEDLE}') OR contains(lower(coalesce(text, '')), '{NEEDLE}')",
    "documents_of_owner": _T + ", g AS (SELECT vendor AS id, list(concat_ws('|', id, source) ORDER BY id, source) AS children FROM e GROUP BY vendor) SELECT v.id, coalesce(g.children, []) AS children FROM (SELECT DISTINCT vendor AS id FROM n WHERE vendor IS NOT NULL) v LEFT JOIN g USING (id)",
    "positions_zipped": _SEED + ", a AS (SELECT id || '/' || generate_subscripts(qa_data, 1) AS position, unnest(qa_data).answer AS answer FROM e), b AS (SELECT questionnaire_id || '/' || position AS position, question_id FROM s) SELECT coalesce(b.position, a.position) AS position, b.question_id, a.answer FROM b FULL JOIN a ON a.position = b.position",
    "coerced_fields": _T + " SELECT id, strftime(saved_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS saved, CASE WHEN size_bytes IS NULL OR size_bytes % 3 = 0 THEN 0 ELSE CAST(greatest(0, floor(size_bytes / 7 + 0.5)) AS BIGINT) END AS size, CAST(0 AS BIGINT) AS below, list_filter(coalesce(tags, []), lambda x: x IS NOT NULL AND x <> '') AS tags, coalesce(note, '') AS note FROM d",
    "name_helpers": _T
    + f""", x AS (SELECT *, floor((epoch_ms(ingested_at) // 1000 - epoch_ms(saved_at) // 1000) / 60) AS m FROM d) SELECT id, right(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), 120) AS safe, regexp_replace(coalesce(name, ''), '\\.[^.]+$', '') AS vendor, {_initials('category')} AS initials,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm ago' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || 'h ago' WHEN m IS NOT NULL THEN CAST(floor(m / 1440) AS BIGINT) || 'd ago' END AS age,
  CASE WHEN coalesce(size_bytes, 0) < 1024 THEN coalesce(size_bytes, 0) || ' B' WHEN size_bytes < 1048576 THEN CAST(round(size_bytes / 1024.0) AS BIGINT) || ' KB' ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS bytes FROM x""",
    "column_labels": """WITH RECURSIVE l(p, n, label) AS (SELECT p_partkey, p_partkey, '' FROM part UNION ALL SELECT p, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || label FROM l WHERE n > 0) SELECT p AS p_partkey, CASE WHEN p < 1 THEN '?' ELSE label END AS label, CAST(p - 1 AS INTEGER) AS place FROM l WHERE n = 0""",
    "typed_questions": _T + f", s AS (SELECT question_id, unnest(string_split(coalesce(question_text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(question_text, ''), chr(10)), 1) AS o FROM q), t AS (SELECT question_id, o, {_line_sql()} AS text FROM s) SELECT CAST(question_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY o) - 1 AS INTEGER) AS index, text, CAST(99 AS INTEGER) AS score FROM t WHERE text <> ''",
    "feed_counts": """WITH n AS (SELECT CASE event_type WHEN 'view' THEN 'review' WHEN 'click' THEN 'approval' WHEN 'purchase' THEN 'assigned' ELSE 'vendor' END AS type, value > 50 AS read FROM events)
SELECT 'all' AS filter, count(*) AS n FROM n UNION ALL SELECT 'unread', count(*) FILTER (NOT read) FROM n UNION ALL SELECT 'review', count(*) FILTER (type IN ('review', 'approval')) FROM n UNION ALL SELECT 'assigned', count(*) FILTER (type = 'assigned') FROM n UNION ALL SELECT 'vendor', count(*) FILTER (type = 'vendor') FROM n""",
}
