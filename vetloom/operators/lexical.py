"""Lexical retrieval: term statistics, BM25 with coverage and phrase bonus, top k.

The index is three tables: passages with their terms, terms with document frequencies, one row of statistics. Queries are a
stated set: the terms that they ask for are sent to the passages in blocks of a checked size, each task scores its passages
against a block with matrix products and hands on its k best of each query, so neither a common term nor a common
passage ever becomes a pair that is shuffled.

Defined results: a null or empty passage has no term and is no hit, but counts in the statistics; a query without terms
has no hit; ties go to the smaller ord, then passage_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import spread, stored

K1, B, SATURATION, IDF_FLOOR = 1.5, 0.75, 6.0, 0.05
COVERAGE, STRENGTH, PHRASE_BONUS = 0.6, 0.4, 0.15
#: Scores are ordered by so many decimals, so that equal ones tie whatever the order of summing.
DIGITS = 9
#: Queries that are sent to the passages at once, and passages that are scored at once.
BLOCK, ROWS = 1000, 1024
_HITS = "query_id string, passage_id string, ord long, matched int, coverage double, bm25 double, phrase double, score double"


@dataclass
class LexicalIndex:
    passages: DataFrame  # passage_id, ord, tokens, size
    terms: DataFrame  # token, df
    stats: DataFrame  # n, mean_size

    def postings(self) -> DataFrame:
        """(passage_id, token, tf)"""
        return self.passages.select("passage_id", F.explode("tokens").alias("token")).groupBy("passage_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def build(passages: DataFrame) -> LexicalIndex:
    """The index of (passage_id, ord, text); the terms of passages are written once into the shared folder."""
    tok = spread(passages).select("passage_id", "ord", T.tokenize(F.col("text")).alias("tokens"))
    tok = stored(tok.withColumn("size", F.size("tokens")))
    terms = tok.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = tok.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("mean_size"))
    return LexicalIndex(tok, terms, stats)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(IDF_FLOOR), F.log(1 + (n - df + 0.5) / (df + 0.5)))


class Block:
    """Queries (id, terms in order with repeats) as matrices over the terms that they ask for."""

    def __init__(self, queries: list[tuple[str, list[str]]], idfs: dict[str, float], mean_size: float):
        self.ids, self.mean = [q for q, _ in queries], mean_size if mean_size > 0 else 1.0
        self.terms = sorted({t for _, ts in queries for t in ts})
        at = {t: n for n, t in enumerate(self.terms)}
        self.asked = np.array([len(set(ts)) for _, ts in queries])
        self.has = np.zeros((len(at), len(queries)), np.float32)
        runs: dict[int, list[int]] = {}
        for q, (_, ts) in enumerate(queries):
            k = [at[t] for t in ts]
            self.has[k, q] = 1
            for run in {self.run(*k[i : i + 3]) for i in range(min(len(k) - 2, 48))}:
                runs.setdefault(run, []).append(q)
        self.weight = self.has.astype(np.float64) * np.array([idfs.get(t, 0.0) for t in self.terms])[:, None]
        #: runs of three terms in order of their numbers, with the queries that hold each
        self.runs = np.array(sorted(runs), np.int64)
        self.run_queries = [runs[r] for r in sorted(runs)]

    def run(self, a, b, c):
        return (a * len(self.terms) + b) * len(self.terms) + c

    def score(self, tokens: pa.ListArray) -> tuple[np.ndarray, ...]:
        """(matched, bm25, phrase) of passages, each (passages, queries)."""
        off = tokens.offsets.to_numpy()
        flat = tokens.values.slice(off[0], off[-1] - off[0])
        term = pc.fill_null(pc.index_in(flat, value_set=pa.array(self.terms, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(off)
        row = np.repeat(np.arange(len(size)), size)
        known = term >= 0
        tf = np.zeros((len(size), len(self.terms)))
        np.add.at(tf, (row[known], term[known]), 1)
        held = (tf > 0).astype(np.float32)
        rate = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[:, None] / self.mean))
        phrase = np.zeros((len(size), len(self.ids)), bool)
        three = np.flatnonzero(known[:-2] & known[1:-1] & known[2:] & (row[:-2] == row[2:])) if len(term) > 2 else np.zeros(0, np.int64)
        if len(three) and len(self.runs):
            own = self.run(term[three], term[three + 1], term[three + 2])
            k = np.minimum(np.searchsorted(self.runs, own), len(self.runs) - 1)
            for r, n in set(zip(row[three[self.runs[k] == own]].tolist(), k[self.runs[k] == own].tolist())):
                phrase[r, self.run_queries[n]] = True
        return np.rint(held @ self.has).astype(np.int32), rate @ self.weight, phrase


def _blocks(index: LexicalIndex, queries: DataFrame) -> Iterator[Block]:
    """The queries in blocks, with the frequencies of their terms."""
    asked = queries.select("query_id", T.tokenize(F.col("text")).alias("t")).filter(F.size("t") > 0)
    (stats,) = index.stats.collect()
    block: list[tuple[str, list[str]]] = []

    def ready() -> Block:
        wanted = index.passages.sparkSession.createDataFrame([(t,) for t in sorted({t for _, ts in block for t in ts})], "token string")
        rows = index.terms.join(F.broadcast(wanted), "token").select("token", idf(F.lit(stats.n), F.col("df")).alias("idf")).collect()  # the block's terms
        return Block(block, {r.token: r.idf for r in rows}, stats.mean_size)

    for r in asked.toLocalIterator():
        block.append((r.query_id, r.t))
        if len(block) >= BLOCK:
            yield ready()
            block = []
    if block:
        yield ready()


def top(index: LexicalIndex, queries: DataFrame, k: int = 10, own: bool = True) -> DataFrame:
    """The k best passages of each query: (query_id, passage_id, ord, matched, coverage, bm25, phrase, score, place).

    Without `own`, a passage with the query's id is no hit.
    """
    spark = index.passages.sparkSession

    def best(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            floor = np.full(len(block.ids), -np.inf)
            names, hits, waiting = np.array(block.ids, dtype=object), None, []

            def compact() -> None:
                nonlocal hits, waiting
                t = pa.Table.from_batches(([hits] if hits is not None else []) + waiting)
                q, score = t["q"].to_numpy(), t["score"].to_numpy()
                order = np.lexsort((np.unique(t["passage_id"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1], t["ord"].to_numpy(), -score, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                full = order[place == k - 1]
                floor[q[full]] = score[full]
                hits, waiting = t.take(pa.array(order[place < k])).combine_chunks().to_batches()[0] if len(q) else None, []

            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    matched, bm25, phrase = block.score(batch.column("tokens"))
                    score = np.round(np.minimum(1.0, COVERAGE * matched / block.asked + STRENGTH * bm25 / (bm25 + SATURATION) + PHRASE_BONUS * phrase), DIGITS)
                    good = (matched > 0) & (score >= floor)
                    if not own:
                        good &= np.array(batch.column("passage_id").to_pylist(), dtype=object)[:, None] != names[None, :]
                    p, q = np.nonzero(good)
                    took = batch.select(["passage_id", "ord"]).take(pa.array(p))
                    cols = [pa.array(q, pa.int32()), *took.columns, pa.array(matched[p, q], pa.int32()), pa.array(bm25[p, q]), pa.array(PHRASE_BONUS * phrase[p, q]), pa.array(score[p, q])]
                    waiting.append(pa.RecordBatch.from_arrays(cols, ["q", "passage_id", "ord", "matched", "bm25", "phrase", "score"]))
                    if sum(b.num_rows for b in waiting) > 200_000:
                        compact()
            if waiting:
                compact()
            if hits is not None:
                q = hits.column("q").to_numpy()
                matched = hits.column("matched")
                cover = pa.array(matched.to_numpy() / block.asked[q])
                yield pa.RecordBatch.from_arrays([pa.array(names[q].tolist(), pa.string()), hits.column("passage_id"), hits.column("ord"), matched, cover, hits.column("bm25"), hits.column("phrase"), hits.column("score")], [c.split()[0] for c in _HITS.split(", ")])

        return index.passages.select("passage_id", "ord", "tokens").mapInArrow(run, _HITS)

    parts = [best(spark.sparkContext.broadcast(b)) for b in _blocks(index, queries)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _HITS)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "ord", "passage_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def matched_terms(index: LexicalIndex, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, passage_id, matched_on): the query's terms that each of the pairs has, in query order."""
    asked = queries.select("query_id", F.array_distinct(T.tokenize(F.col("text"))).alias("asked"))
    both = pairs.select("query_id", "passage_id").join(asked, "query_id").join(index.passages.select("passage_id", "tokens"), "passage_id")
    return both.select("query_id", "passage_id", F.filter("asked", lambda t: F.array_contains("tokens", t)).alias("matched_on"))
