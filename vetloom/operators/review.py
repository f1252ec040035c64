"""Hybrid review of questions: lexical and semantic candidates, fusion, classification, alternatives, summary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..session import stored
from . import lexical

LEXICAL_CANDIDATES, AGREEMENT = 25, 0.05
ALTERNATIVE_FLOOR, ALTERNATIVES = 0.18, 6
#: Most bytes of question vectors that are broadcast at once; more questions are compared in blocks of this size.
BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Thresholds:
    qa_autofill: float = 0.72
    qa_suggest: float = 0.45
    doc_suggest: float = 0.40
    corroborated_by: float = 0.85


def passage_text(kind: str = "source_type") -> Column:
    """What is searched of a chunk: question and answer of a past answer, else its text."""
    both = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("text", F.lit("")))
    return F.when(F.col(kind) == "qa", both).otherwise(F.coalesce("text", F.lit("")))


def percent(score: Column) -> Column:
    """A score of 0 to 1 as a whole percentage, halves up."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)))) * 100 + 0.5).cast("int")


def method(lex: Column, sem: Column) -> Column:
    return F.when((lex >= 0.35) & (sem >= 0.6), "keyword + semantic").when((sem >= 0.6) & (sem > lex), "semantic").otherwise("keyword")


def fused(lex: Column, sem: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(lex, sem) + AGREEMENT * F.least(lex, sem)), lexical.DIGITS)


def semantic_best(questions: DataFrame, chunks: DataFrame, pairs: DataFrame | None = None, own: bool = True) -> DataFrame:
    """(query_id, passage_id, semantic): of each question's vector, the best chunks of its ALTERNATIVES best sources, the best of each kind, and the given pairs.

    Only those can win anything later: alternatives take one chunk from each of so many sources, citations one of a kind,
    and what words find is among the pairs. Question vectors are a stated set: they are sent to the chunks in blocks of a
    checked size, and each batch of chunks keeps those few rows of a question before anything is shuffled. Without `own`,
    the passage that a question is itself (same id) is left out before the best is taken, so that it doesn't stand in for
    the rest of its source.
    """
    spark = questions.sparkSession
    rows = questions.filter(V.usable_vector(F.col("embedding")).isNotNull()).select("query_id", "embedding").orderBy("query_id")
    blocks, size, block = [], 0, []
    for r in rows.toLocalIterator():
        block.append((r.query_id, np.array(r.embedding)))
        size += 8 * len(r.embedding)
        if size >= BLOCK_BYTES:
            blocks.append(block)
            block, size = [], 0
    if block:
        blocks.append(block)
    src = chunks.filter("embedding is not null").select("passage_id", "ord", "source_type", F.coalesce("source_id", F.lit("")).alias("source_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id string, passage_id string, ord long, source_type string, source_id string, semantic double"

    def best(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, width = shared.value
            asks: dict[str, list[int]] = {}
            for i, name in enumerate(ids):
                asks.setdefault(name, []).append(i)
            for batch in batches:
                x, at = V.unit_rows(batch.column(4), width)
                if not len(at):
                    continue
                score = np.maximum(0.0, unit @ x.T)
                kept = batch.take(pa.array(at))
                if not own:
                    for j, passage in enumerate(kept.column(0).to_pylist()):
                        score[asks.get(passage, []), j] = 0  # as little as no similarity: never a hit
                names = np.array([f"{a}\0{b}" for a, b in zip(kept.column(2).to_pylist(), kept.column(3).to_pylist())])
                places, is_doc = kept.column(1).to_numpy(), np.array([x != "qa" for x in kept.column(2).to_pylist()])
                group = np.unique(names, return_inverse=True)[1]
                order = np.lexsort((places, group))
                first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
                q, c = [], []
                for i in range(len(ids)):
                    s = np.round(score[i][order], lexical.DIGITS)
                    top = np.maximum.reduceat(s, first)
                    hit = np.flatnonzero((s == np.repeat(top, np.diff(np.append(first, len(s))))) & (s > 0))
                    keep = hit[np.append(True, np.diff(group[order][hit]) != 0)] if len(hit) else hit
                    keep = keep[np.lexsort((places[order[keep]], -s[keep]))]
                    doc = is_doc[order[keep]]
                    keep = keep[(np.arange(len(keep)) < ALTERNATIVES) | (doc & (np.cumsum(doc) == 1)) | (~doc & (np.cumsum(~doc) == 1))]
                    q += [ids[i]] * len(keep)
                    c.append(order[keep])
                cols = np.concatenate(c) if c else np.zeros(0, np.int64)
                qi = np.repeat(np.arange(len(ids)), [len(v) for v in c])
                took = kept.take(pa.array(cols))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), *took.columns[:4], pa.array(np.round(score[qi, cols], lexical.DIGITS))], ["query_id", "passage_id", "ord", "source_type", "source_id", "semantic"])

        return src.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for block in blocks:
        # The width of a run is that of its first usable question vector; others are not comparable.
        width = len(block[0][1]) if block is blocks[0] else width
        same = [(i, v) for i, v in block if len(v) == width]
        if same:
            m = np.array([v for _, v in same])
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            out = out.unionByName(best(spark.sparkContext.broadcast(([i for i, _ in same], m, width))))
    key = F.struct((-F.col("semantic")).alias("s"), "ord", "passage_id")
    out = out.groupBy("query_id", "source_type", "source_id").agg(F.min_by(F.struct("passage_id", "ord", "semantic"), key).alias("b")).select("query_id", "source_type", "b.*")
    first = [F.desc("semantic"), F.col("ord"), F.col("passage_id")]
    out = out.withColumn("_p", F.row_number().over(W.partitionBy("query_id").orderBy(*first))).withColumn("_k", F.row_number().over(W.partitionBy("query_id", F.col("source_type") == "qa").orderBy(*first)))
    out = out.filter((F.col("_p") <= ALTERNATIVES) | (F.col("_k") == 1)).select("query_id", "passage_id", "semantic")
    if pairs is not None and blocks:
        vectors = chunks.select("passage_id", F.col("embedding").cast("array<double>").alias("v"))
        exact = pairs.select("query_id", "passage_id").join(questions.select("query_id", F.col("embedding").alias("u")), "query_id").join(vectors, "passage_id")
        exact = exact.filter(F.size("u") == width).select("query_id", "passage_id", F.round(F.greatest(F.lit(0.0), V.cosine(F.col("u"), F.col("v"))), lexical.DIGITS).alias("semantic"))
        out = out.unionByName(exact).groupBy("query_id", "passage_id").agg(F.max("semantic").alias("semantic"))
    return out


def candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused candidates of each question: (query_id, passage_id, lexical, semantic, score, matched_on, method, chunk columns).

    questions: query_id, text, embedding. chunks: passage_id, ord, source_type, source_id, source_name, category, question,
    text, page, embedding; a question never meets the passage it is itself (same id).
    """
    index = lexical.build(chunks.select("passage_id", "ord", passage_text().alias("text")))
    asked = questions.select("query_id", "text")
    # Written once: the 25 best of each query are read by the exact cosines, the fusion and the matched terms.
    lex = stored(lexical.top(index, asked, LEXICAL_CANDIDATES, own=False).select("query_id", "passage_id", F.col("score").alias("lexical"), F.col("place").alias("rank")))
    sem = semantic_best(questions, chunks, lex, own=False)
    both = lex.join(sem, ["query_id", "passage_id"], "full")
    both = both.withColumn("lexical", F.coalesce("lexical", F.lit(0.0))).withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    both = stored(both.withColumn("score", fused(F.col("lexical"), F.col("semantic"))).filter(F.col("score") > 0))
    terms = lexical.matched_terms(index, asked, both.filter(F.col("rank").isNotNull()))
    both = both.join(terms, ["query_id", "passage_id"], "left").withColumn("matched_on", F.coalesce("matched_on", F.array().cast("array<string>")))
    meta = chunks.select("passage_id", "ord", "source_type", "source_id", "source_name", "category", "question", "text", "page")
    return both.withColumn("method", method(F.col("lexical"), F.col("semantic"))).join(meta, "passage_id")


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("rank"), F.col("ord"), F.col("passage_id")]


def best_by_kind(cands: DataFrame) -> DataFrame:
    """The best candidate of each question for past answers and for documents."""
    w = W.partitionBy("query_id", "source_type").orderBy(*_order())
    return cands.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def alternatives(cands: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Up to six candidates of each question above the floor, the best of each source, with what each may be used for."""
    per = W.partitionBy("query_id", "source_type", "source_id").orderBy(*_order())
    one = cands.filter(F.col("score") >= ALTERNATIVE_FLOOR).withColumn("p", F.row_number().over(per)).filter("p = 1")
    out = one.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*_order()))).filter(F.col("place") <= ALTERNATIVES)
    return out.withColumn("kind", F.when(F.col("source_type") != "qa", "document").when(F.col("score") >= th.qa_autofill, "reused").otherwise("previous-answer")).drop("p")


def suggestion(c: str, kind: Column) -> Column:
    """What is offered of a candidate struct."""

    def t(name: str) -> Column:
        return F.coalesce(F.col(f"{c}.{name}"), F.lit(""))

    return F.struct(
        kind.alias("kind"), F.col(f"{c}.passage_id").alias("chunk_id"), F.col(f"{c}.source_type").alias("source_type"), t("source_name").alias("source_name"), t("source_id").alias("source_id"), t("category").alias("category"),
        F.col(f"{c}.page").alias("page"), t("question").alias("question"), t("text").alias("text"), percent(F.col(f"{c}.score")).alias("score"), percent(F.col(f"{c}.lexical")).alias("lexical"),
        percent(F.col(f"{c}.semantic")).alias("semantic"), F.col(f"{c}.method").alias("method"), T.shown(F.col(f"{c}.matched_on"), 5).alias("matched_on"),
    )


def classified(questions: DataFrame, best: DataFrame, th: Thresholds = Thresholds(), semantic_on: bool = True, empty: bool = False) -> DataFrame:
    """One verdict for each question: (query_id, text, answer, confidence, source, status, flag_reason, recommendation, suggestion)."""
    pick = F.struct(*[c for c in best.columns if c != "query_id"])
    wide = best.groupBy("query_id").agg(F.max(F.when(F.col("source_type") == "qa", pick)).alias("qa"), F.max(F.when(F.col("source_type") == "document", pick)).alias("doc"))
    q = questions.filter(F.length(F.btrim(F.coalesce("text", F.lit("")))) > 0).join(wide, "query_id", "left")
    score, backed = F.col("qa.score"), (F.size("qa.matched_on") >= 2) | (F.col("qa.semantic") >= th.corroborated_by)

    def name(c: str, other: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"{c}.source_name"), F.lit("")), F.lit(other))

    fill = F.coalesce((score >= th.qa_autofill) & backed, F.lit(False))
    similar = F.coalesce(score >= th.qa_suggest, F.lit(False))
    covered = F.coalesce(F.col("doc.score") >= th.doc_suggest, F.lit(False))
    terms = T.shown(F.col("doc.matched_on"))
    answered = F.concat(F.lit("Previously answered — "), name("qa", "knowledge base"))
    place = F.when(F.coalesce(F.col("doc.page"), F.lit(0)) != 0, F.concat(name("doc", "Document"), F.lit(" · p."), F.col("doc.page").cast("string"))).otherwise(name("doc", "Knowledge base document"))
    near = F.coalesce("qa", "doc")
    closest = F.when(near.isNotNull(), F.format_string("Closest match was only %d%% (%s).", percent(near["score"]), F.coalesce(F.nullif(near["source_name"], F.lit("")), F.lit("knowledge base")))).otherwise("No related material in the knowledge base.")
    hint = " Answer it here and it will be reusable next time." if semantic_on else " Keyword matching only — semantic matching is unavailable, so paraphrased matches may have been missed."
    return q.select(
        "query_id",
        "text",
        F.when(fill, F.coalesce("qa.text", F.lit(""))).otherwise("").alias("answer"),
        F.when(similar | fill, percent(score)).when(covered, percent(F.col("doc.score"))).otherwise(0).alias("confidence"),
        F.when(similar | fill, answered).when(covered, place).otherwise("").alias("source"),
        F.when(fill, "auto-filled").when(similar | covered, "flagged").otherwise("needs-input").alias("status"),
        F.when(fill, F.lit(None).cast("string"))
        .when(similar & (score >= th.qa_autofill), F.format_string("Possible repeat (%d%%), but matched on only one term", percent(score)))
        .when(similar, F.format_string("Similar question answered before (%d%% match)", percent(score)))
        .when(covered, F.concat(F.lit("Covered by "), name("doc", "a knowledge base document")))
        .otherwise("The knowledge base is empty" if empty else "Needs a manual answer")
        .alias("flag_reason"),
        F.when(fill, F.lit(None).cast("string"))
        .when(similar, F.concat(F.lit("Check the previous answer from "), name("qa", "your history"), F.lit(" — accept it if it still holds.")))
        .when(covered & (F.size(terms) > 0), F.concat(F.lit("Draft from the cited passage — matched on "), F.array_join(terms, ", "), F.lit(".")))
        .when(covered, "Draft from the cited passage below.")
        .otherwise(F.concat(closest, F.lit(hint)))
        .alias("recommendation"),
        F.when(fill, suggestion("qa", F.lit("reused"))).when(similar, suggestion("qa", F.lit("previous-answer"))).when(covered, suggestion("doc", F.lit("document"))).alias("suggestion"),
    )


def reviewed(questions: DataFrame, chunks: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """The verdict on each question with its alternatives: the whole review."""
    cands = candidates(questions, chunks)
    empty = chunks.isEmpty()
    semantic_on = not empty and not questions.filter(V.usable_vector(F.col("embedding")).isNotNull()).isEmpty()
    out = classified(questions, best_by_kind(cands), th, semantic_on or empty, empty)
    alt = alternatives(cands, th)
    item = alt.withColumn("c", F.struct(*alt.columns))
    item = item.select("query_id", "place", suggestion("c", F.col("kind")).alias("s"))
    listed = item.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("alternatives"))
    return out.join(listed, "query_id", "left")


def summary(verdicts: DataFrame) -> DataFrame:
    """Counts by outcome and the share that needs no manual answer."""
    n = F.count(F.lit(1))
    done = F.count_if(F.col("status") != "needs-input")
    return verdicts.agg(
        n.alias("total"),
        F.count_if(F.col("status") == "auto-filled").alias("auto_filled"),
        F.count_if(F.col("status") == "flagged").alias("suggested"),
        F.count_if(F.col("status") == "needs-input").alias("needs_input"),
        F.coalesce(F.floor(100 * F.try_divide(done, n) + 0.5), F.lit(0)).cast("int").alias("coverage"),
    )


def vector_report(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many chunk vectors can be compared with the questions', how many are stale or missing."""
    width = questions.filter(V.usable_vector(F.col("embedding")).isNotNull()).agg(F.min_by(F.size("embedding"), "query_id").alias("width"))
    v = V.usable_vector(F.col("embedding"))
    return chunks.crossJoin(F.broadcast(width)).agg(  # one row
        F.count(F.lit(1)).alias("chunks"), F.count_if(v.isNotNull() & (F.size(v) == F.col("width"))).alias("comparable"), F.count_if(v.isNotNull() & (F.size(v) != F.col("width"))).alias("stale"), F.count_if(v.isNull()).alias("without_vector")
    )
