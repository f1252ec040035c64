"""Queries of retrieval and review, and their SQL.

The search queries are a stated set: every row whose id is divisible by 100, against all passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import lexical, review
from ..session import table

DIVISOR = 100


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of the index, each once."""
    c = table(spark, sf_dir, "kb_index_chunks").withColumnRenamed("id", "passage_id").withColumn("ord", F.col("chunk_ord").cast("long"))
    return c.select("passage_id", "ord", "source_type", "source_id", "source_name", "category", "question", "text", "page", "embedding", "embedding_dims", "saved_at").dropDuplicates(["passage_id"])


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("passage_id", "ord", review.passage_text().alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the questionnaires that are searched for by words."""
    q = table(spark, sf_dir, "questions").filter(F.col("question_id") % DIVISOR == 0)
    return q.select(F.col("question_id").cast("string").alias("query_id"), F.col("question_text").alias("text")).dropDuplicates(["query_id"])


def past(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of past answers, which have vectors: each is searched for among all other passages."""
    c = chunks(spark, sf_dir).filter((F.col("source_type") == "qa") & (F.regexp_extract("passage_id", "([0-9]+)$", 1).cast("long") % DIVISOR == 0))
    usable = F.when(F.size("embedding") == F.col("embedding_dims"), V.usable_vector(F.col("embedding")))
    return c.select(F.col("passage_id").alias("query_id"), F.col("question").alias("text"), usable.alias("embedding"))


def sound(c: DataFrame) -> DataFrame:
    """Chunks whose vector contradicts its stated width lose it."""
    return c.withColumn("embedding", F.when(F.size("embedding") == F.col("embedding_dims"), F.col("embedding")))


def _index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.build(passages(spark, sf_dir))


def tokenize_passages(spark, sf_dir):
    return passages(spark, sf_dir).select("passage_id", T.tokenize(F.col("text")).alias("tokens"))


def term_frequency(spark, sf_dir):
    return _index(spark, sf_dir).postings()


def document_frequency(spark, sf_dir):
    return _index(spark, sf_dir).terms


def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n", F.round("mean_size", 6).alias("mean_size"))


def bm25_scores(spark, sf_dir):
    s = lexical.top(_index(spark, sf_dir), asked(spark, sf_dir), review.LEXICAL_CANDIDATES)
    return s.select("query_id", "passage_id", F.col("matched").cast("long").alias("matched"), F.round("coverage", 6).alias("coverage"), F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


def lexical_topk(spark, sf_dir):
    return lexical.top(_index(spark, sf_dir), asked(spark, sf_dir), 10).select("query_id", "place", "passage_id", F.round("score", 6).alias("score"))


def matched_terms(spark, sf_dir):
    index, q = _index(spark, sf_dir), asked(spark, sf_dir)
    m = lexical.matched_terms(index, q, lexical.top(index, q, 10))
    return m.select("query_id", "passage_id", "matched_on", T.shown(F.col("matched_on")).alias("shown"))


def phrase_bonus(spark, sf_dir):
    return lexical.top(_index(spark, sf_dir), asked(spark, sf_dir), review.LEXICAL_CANDIDATES).filter("phrase > 0").select("query_id", "passage_id", "phrase")


def vector_validity(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("passage_id", (V.usable_vector(F.col("embedding")).isNotNull() & (F.size("embedding") == F.col("embedding_dims"))).alias("usable")).select("passage_id", F.coalesce("usable", F.lit(False)).alias("usable"))


def vector_report(spark, sf_dir):
    return review.vector_report(past(spark, sf_dir), sound(chunks(spark, sf_dir)))


def semantic_per_source(spark, sf_dir):
    s = review.semantic_best(past(spark, sf_dir), sound(chunks(spark, sf_dir)))
    return s.select("query_id", "passage_id", F.round("semantic", 6).alias("semantic"))


def _cands(spark, sf_dir):
    return review.candidates(past(spark, sf_dir), sound(chunks(spark, sf_dir)))


def hybrid_best(spark, sf_dir):
    b = review.best_by_kind(_cands(spark, sf_dir))
    return b.select("query_id", "source_type", "passage_id", *[F.round(c, 6).alias(c) for c in ("lexical", "semantic", "score")], "method", "matched_on")


def alternatives_per_source(spark, sf_dir):
    a = review.alternatives(_cands(spark, sf_dir))
    return a.select("query_id", "place", "passage_id", F.round("score", 6).alias("score"), "kind")


def review_classify(spark, sf_dir):
    """The flagship: every verdict with its citation."""
    r = review.classified(past(spark, sf_dir), review.best_by_kind(_cands(spark, sf_dir)))
    return r.select("query_id", "status", "confidence", "answer", "source", "flag_reason", "recommendation", F.col("suggestion.chunk_id").alias("chunk_id"), F.col("suggestion.method").alias("method"), F.col("suggestion.matched_on").alias("matched_on"))


def review_summary(spark, sf_dir):
    return review.summary(review.classified(past(spark, sf_dir), review.best_by_kind(_cands(spark, sf_dir))))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_passages, term_frequency, document_frequency, corpus_stats, bm25_scores, lexical_topk, matched_terms, phrase_bonus, vector_validity, vector_report, semantic_per_source, hybrid_best, alternatives_per_source,
        review_classify, review_summary,
    )
}

_BASE = f"""
WITH chunk AS (
  SELECT DISTINCT ON (id) id AS passage_id, chunk_ord AS ord, source_type, coalesce(source_id, '') AS source_id, source_name, question, text, page, embedding, embedding_dims,
    CASE WHEN source_type = 'qa' THEN concat_ws(' ', coalesce(question, ''), coalesce(text, '')) ELSE coalesce(text, '') END AS body
  FROM kb_index_chunks ORDER BY id, ingested_at
), toks AS (SELECT passage_id, ord, {T.tokens_sql("body")} AS tokens FROM chunk
), post AS (SELECT passage_id, token, count(*) AS tf FROM (SELECT passage_id, unnest(tokens) AS token FROM toks) GROUP BY ALL
), df AS (SELECT token, count(*) AS df FROM post GROUP BY token
), stats AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS mean_size FROM toks
)"""

_SEARCH = """, qt AS (SELECT *, list_transform(range(0, least(48, greatest(len(t) - 2, 0))), lambda i: ' ' || array_to_string(t[i + 1:i + 3], ' ') || ' ') AS runs FROM qtok
), qs AS (SELECT query_id, runs, u, len(u) AS asked FROM (SELECT *, list_transform(list_sort(list_transform(list_distinct(t), lambda x: {'p': list_position(t, x), 'x': x})), lambda s: s.x) AS u FROM qt)
), hits AS (
  SELECT qs.query_id, qs.asked, qs.runs, p.passage_id, t.ord, t.tokens, p.tf, greatest(0.05::DOUBLE, ln(1 + (s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE))) AS idf, len(t.tokens) AS size, s.mean_size
  FROM (SELECT query_id, asked, runs, unnest(u) AS token FROM qs) qs JOIN post p USING (token) JOIN df USING (token) JOIN toks t USING (passage_id) CROSS JOIN stats s
), sums AS (
  SELECT query_id, passage_id, ord, asked, count(*) AS matched, sum(idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean_size))) AS bm25,
    any_value(' ' || array_to_string(tokens, ' ') || ' ') AS phrase_text, any_value(runs) AS runs
  FROM hits GROUP BY query_id, passage_id, ord, asked
), scored AS (
  SELECT query_id, passage_id, ord, matched, matched / asked AS coverage, bm25, CASE WHEN len(list_filter(runs, lambda r: contains(phrase_text, r))) > 0 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS phrase
  FROM sums
), lex AS (SELECT *, round(least(1::DOUBLE, 0.6::DOUBLE * coverage + 0.4::DOUBLE * bm25 / (bm25 + 6) + phrase), 9) AS score FROM scored)"""

_ASKED = _BASE + f""", qtok AS (SELECT DISTINCT ON (question_id) CAST(question_id AS VARCHAR) AS query_id, {T.tokens_sql("question_text")} AS t FROM questions WHERE question_id % {DIVISOR} = 0)""" + _SEARCH

_PAST = f""", past AS (
  SELECT passage_id AS query_id, question AS text, CASE WHEN len(embedding) = embedding_dims AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding END AS v
  FROM chunk WHERE source_type = 'qa' AND CAST(regexp_extract(passage_id, '([0-9]+)$', 1) AS BIGINT) % {DIVISOR} = 0
), width AS (SELECT min_by(len(v), query_id) AS width FROM past WHERE v IS NOT NULL
), vec AS (
  SELECT chunk.*, CASE WHEN len(embedding) = embedding_dims AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding END AS u FROM chunk
)"""

_SEM = """, sem AS (
  SELECT p.query_id, c.passage_id, c.ord, c.source_type, c.source_id, round(greatest(0::DOUBLE, coalesce(list_dot_product(p.v, c.u) / nullif(sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(c.u, c.u)), 0), 0)), 9) AS semantic
  FROM past p, vec c, width w WHERE p.v IS NOT NULL AND c.u IS NOT NULL AND len(p.v) = w.width AND len(c.u) = w.width
)"""

_CANDS = (
    _BASE
    + _PAST
    + f""", qtok AS (SELECT query_id, {T.tokens_sql("text")} AS t FROM past)"""
    + _SEARCH
    + _SEM
    + """, lex25 AS (
  SELECT * FROM (SELECT query_id, passage_id, score AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, passage_id) AS rank FROM lex WHERE query_id <> passage_id) WHERE rank <= 25
), joined AS (
  SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.passage_id, s.passage_id) AS passage_id, coalesce(l.lexical, 0) AS lexical, coalesce(s.semantic, 0) AS semantic, l.rank
  FROM lex25 l FULL JOIN (SELECT * FROM sem WHERE query_id <> passage_id) s ON l.query_id = s.query_id AND l.passage_id = s.passage_id
), cand AS (
  SELECT b.*, round(least(1::DOUBLE, greatest(lexical, semantic) + 0.05::DOUBLE * least(lexical, semantic)), 9) AS score,
    CASE WHEN lexical >= 0.35 AND semantic >= 0.6 THEN 'keyword + semantic' WHEN semantic >= 0.6 AND semantic > lexical THEN 'semantic' ELSE 'keyword' END AS method,
    CASE WHEN b.rank IS NULL THEN []::VARCHAR[] ELSE list_filter(qs.u, lambda x: list_contains(t.tokens, x)) END AS matched_on,
    c.ord, c.source_type, c.source_id, c.source_name, c.text, c.page
  FROM joined b JOIN chunk c USING (passage_id) JOIN toks t USING (passage_id) LEFT JOIN qs USING (query_id)
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, rank NULLS LAST, ord, passage_id) AS p FROM cand WHERE score > 0) WHERE p = 1
)"""
)


def _shown_sql(expr: str, most: int) -> str:
    keys, names = list(T.SHOWN), list(T.SHOWN.values())
    return f"list_transform({expr}, lambda x: coalesce({T._list(names)}[list_position({T._list(keys)}, x)], x))[1:{most}]"


_VERDICT = (
    _CANDS
    + f""", wide AS (
  SELECT p.query_id, p.text, q.score AS qs_, q.source_name AS qname, q.text AS qtext, q.passage_id AS qid, q.method AS qmethod, q.matched_on AS qterms, q.semantic AS qsem,
    d.score AS ds_, d.source_name AS dname, d.page AS dpage, d.passage_id AS did, d.method AS dmethod, d.matched_on AS dterms
  FROM past p LEFT JOIN best q ON q.query_id = p.query_id AND q.source_type = 'qa' LEFT JOIN best d ON d.query_id = p.query_id AND d.source_type = 'document'
  WHERE length(trim(coalesce(p.text, ''))) > 0
), state AS (
  SELECT *, coalesce(qs_ >= 0.72 AND (len(qterms) >= 2 OR qsem >= 0.85), false) AS fill, coalesce(qs_ >= 0.45, false) AS alike, coalesce(ds_ >= 0.40, false) AS covered,
    CAST(floor(coalesce(qs_, 0) * 100 + 0.5) AS INTEGER) AS qp, CAST(floor(coalesce(ds_, 0) * 100 + 0.5) AS INTEGER) AS dp, {_shown_sql("dterms", 4)} AS dshown
  FROM wide
), verdict AS (
  SELECT query_id, CASE WHEN fill THEN 'auto-filled' WHEN alike OR covered THEN 'flagged' ELSE 'needs-input' END AS status,
    CASE WHEN fill OR alike THEN qp WHEN covered THEN dp ELSE 0 END AS confidence,
    CASE WHEN fill THEN coalesce(qtext, '') ELSE '' END AS answer,
    CASE WHEN fill OR alike THEN 'Previously answered — ' || coalesce(nullif(qname, ''), 'knowledge base')
      WHEN covered THEN CASE WHEN coalesce(dpage, 0) <> 0 THEN coalesce(nullif(dname, ''), 'Document') || ' · p.' || dpage ELSE coalesce(nullif(dname, ''), 'Knowledge base document') END ELSE '' END AS source,
    CASE WHEN fill THEN NULL WHEN alike AND qs_ >= 0.72 THEN 'Possible repeat (' || qp || '%), but matched on only one term' WHEN alike THEN 'Similar question answered before (' || qp || '% match)'
      WHEN covered THEN 'Covered by ' || coalesce(nullif(dname, ''), 'a knowledge base document') ELSE 'Needs a manual answer' END AS flag_reason,
    CASE WHEN fill THEN NULL WHEN alike THEN 'Check the previous answer from ' || coalesce(nullif(qname, ''), 'your history') || ' — accept it if it still holds.'
      WHEN covered AND len(dshown) > 0 THEN 'Draft from the cited passage — matched on ' || array_to_string(dshown, ', ') || '.' WHEN covered THEN 'Draft from the cited passage below.'
      ELSE CASE WHEN qid IS NULL AND did IS NULL THEN 'No related material in the knowledge base.' ELSE 'Closest match was only ' || CASE WHEN qid IS NOT NULL THEN qp ELSE dp END || '% (' ||
        coalesce(nullif(CASE WHEN qid IS NOT NULL THEN qname ELSE dname END, ''), 'knowledge base') || ').' END || ' Answer it here and it will be reusable next time.' END AS recommendation,
    CASE WHEN fill OR alike THEN qid WHEN covered THEN did END AS chunk_id, CASE WHEN fill OR alike THEN qmethod WHEN covered THEN dmethod END AS method,
    CASE WHEN fill OR alike THEN {_shown_sql("qterms", 5)} WHEN covered THEN {_shown_sql("dterms", 5)} END AS matched_on
  FROM state
)"""
)

_TOP25 = ", lex25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, passage_id) AS place FROM lex) WHERE place <= 25)"

SQL = {
    "tokenize_passages": _BASE + " SELECT passage_id, tokens FROM toks",
    "term_frequency": _BASE + " SELECT passage_id, token, tf FROM post",
    "document_frequency": _BASE + " SELECT token, df FROM df",
    "corpus_stats": _BASE + " SELECT n, round(mean_size, 6) AS mean_size FROM stats",
    "bm25_scores": _ASKED + _TOP25 + " SELECT query_id, passage_id, matched, round(coverage, 6) AS coverage, round(bm25, 6) AS bm25, round(score, 6) AS score FROM lex25",
    "lexical_topk": _ASKED + " SELECT query_id, place, passage_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, passage_id) AS place FROM lex) WHERE place <= 10",
    "matched_terms": _ASKED
    + f""", top AS (SELECT query_id, passage_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, passage_id) AS place FROM lex) WHERE place <= 10
), m AS (SELECT top.query_id, top.passage_id, list_filter(qs.u, lambda x: list_contains(t.tokens, x)) AS matched_on FROM top JOIN qs USING (query_id) JOIN toks t USING (passage_id))
SELECT query_id, passage_id, matched_on, {_shown_sql("matched_on", 4)} AS shown FROM m""",
    "phrase_bonus": _ASKED + _TOP25 + " SELECT query_id, passage_id, phrase FROM lex25 WHERE phrase > 0",
    "vector_validity": _BASE + _PAST + " SELECT passage_id, u IS NOT NULL AS usable FROM vec",
    "vector_report": _BASE + _PAST + " SELECT count(*) AS chunks, count(*) FILTER (u IS NOT NULL AND len(u) = width) AS comparable, count(*) FILTER (u IS NOT NULL AND len(u) <> width) AS stale, count(*) FILTER (u IS NULL) AS without_vector FROM vec, width",
    "semantic_per_source": _BASE + _PAST + _SEM + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type, source_id ORDER BY semantic DESC, ord, passage_id) AS p FROM sem WHERE semantic > 0) WHERE p = 1
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, ord, passage_id) AS a, row_number() OVER (PARTITION BY query_id, source_type = 'qa' ORDER BY semantic DESC, ord, passage_id) AS k FROM one)
SELECT query_id, passage_id, round(semantic, 6) AS semantic FROM placed WHERE a <= 6 OR k = 1""",
    "hybrid_best": _CANDS + " SELECT query_id, source_type, passage_id, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(score, 6) AS score, method, matched_on FROM best",
    "alternatives_per_source": _CANDS
    + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type, source_id ORDER BY score DESC, rank NULLS LAST, ord, passage_id) AS p FROM cand WHERE score >= 0.18) WHERE p = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank NULLS LAST, ord, passage_id) AS place FROM one)
SELECT query_id, place, passage_id, round(score, 6) AS score, CASE WHEN source_type <> 'qa' THEN 'document' WHEN score >= 0.72 THEN 'reused' ELSE 'previous-answer' END AS kind FROM ranked WHERE place <= 6""",
    "review_classify": _VERDICT + " SELECT * FROM verdict",
    "review_summary": _VERDICT
    + " SELECT count(*) AS total, count(*) FILTER (status = 'auto-filled') AS auto_filled, count(*) FILTER (status = 'flagged') AS suggested, count(*) FILTER (status = 'needs-input') AS needs_input, CAST(floor(100 * count(*) FILTER (status <> 'needs-input') / count(*) + 0.5) AS INTEGER) AS coverage FROM verdict",
}
