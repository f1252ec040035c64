"""Splitting oversized texts at natural boundaries with a stated overlap (problem 1).

Cuts are chosen by dynamic programming over all boundary positions of a text: each cut costs by its kind (paragraph,
row, sentence, word, none), each piece by how far it is from an even share, and no piece may be longer than the limit,
the overlap included. The overlap in front of a piece starts at a sentence where one begins in the window, else at a
word, else exactly at the window's start.

Defined results: null texts give no piece, texts of white space only give none either; a text within the limit stays as
it is, as one piece; a text without any boundary is cut at the limit, never before a combining mark; repeated rows of
one id are one text; empty tables give empty results; columns besides the named ones are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, spread

LIMIT, OVERLAP = 1100, 120
#: What is not counted at either end of a text.
SPACE = " \t\r\n"
#: Cost of a cut by kind, and weight of the squared deviation from an even share.
COST = {"paragraph": 0.0, "row": 0.35, "sentence": 0.6, "word": 2.0, "none": 12.0}
EVENNESS = 1.0
#: Distance of the cuts that are tried where a run of characters has no boundary.
STEP = 10
#: A sentence start is preferred for the overlap if at least so many characters remain.
USEFUL = 40

_WORD = re.compile(r"\s+(?=\S)")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'»”’)\]]*\s*$")


def _boundaries(text: str, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions after which a piece may end, their costs, and whether a sentence or more starts there."""
    at, cost = [], []
    for m in _WORD.finditer(text):
        gap = m.group()
        breaks = gap.count("\n") or gap.count("\r")
        if breaks > 1:
            kind = "paragraph"
        elif breaks:
            kind = "row"
        elif _SENTENCE.search(text, max(0, m.start() - 4), m.start()):
            kind = "sentence"
        else:
            kind = "word"
        at.append(m.end())
        cost.append(COST[kind])
    at.append(len(text))
    cost.append(0.0)
    extra, last = [], 0
    for p in at:
        if p - last > room // 2:
            extra += [q for q in range(last + STEP, p, STEP) if not unicodedata.combining(text[q]) and text[q] not in "‍️" and text[q - 1] != "‍"]
            if not extra or extra[-1] <= last:  # nothing but marks: cut among them
                extra += range(last + STEP, p, STEP)
        last = p
    pos = np.array(at + extra, dtype=np.int64)
    pen = np.array(cost + [COST["none"]] * len(extra))
    order = np.argsort(pos, kind="stable")
    pos, pen = pos[order], pen[order]
    return pos, pen, pen <= COST["sentence"]


def _overlap_starts(pos: np.ndarray, pen: np.ndarray, clean: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after each cut begins: within overlap characters before it."""
    words = np.append(0, pos[pen < COST["none"]])
    heads = np.append(0, pos[clean])
    floor = np.maximum(pos - overlap, 0)
    word = words[np.minimum(np.searchsorted(words, floor), len(words) - 1)]
    head = heads[np.minimum(np.searchsorted(heads, floor), len(heads) - 1)]
    start = np.where(word < pos, word, floor)
    return np.where((head <= pos - USEFUL) & (head >= floor), head, start)


def piece_spans(body: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, start without overlap, end) of each piece of a text that is longer than the limit."""
    overlap = min(overlap, limit // 2)
    pos, pen, clean = _boundaries(body, limit - overlap)
    lead = np.append(0, _overlap_starts(pos, pen, clean, overlap))  # of the piece that follows each cut, the first being 0
    cuts = np.append(0, pos)
    share = len(body) / np.ceil(len(body) / (limit - overlap / 2))
    best = np.full(len(cuts), np.inf)
    back = np.zeros(len(cuts), dtype=np.int64)
    best[0] = 0.0
    low = np.maximum.accumulate(lead)
    first = np.searchsorted(low, cuts - limit)  # the earliest start whose piece is within the limit
    for j in range(1, len(cuts)):
        i = first[j]
        off = (cuts[j] - cuts[i:j]) / share - 1.0
        total = best[i:j] + EVENNESS * off * off
        total[cuts[j] - lead[i:j] > limit] = np.inf
        k = int(np.argmin(total)) if len(total) else 0
        if len(total) and total[k] < np.inf:
            best[j], back[j] = total[k] + pen[j - 1], i + k
    out, j = [], len(cuts) - 1
    while j > 0:
        i = back[j]
        if body[cuts[i] : cuts[j]].strip(SPACE):
            out.append((int(lead[i]), int(cuts[i]), int(cuts[j])))
        j = i
    return out[::-1]


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text; one that is within the limit comes back unchanged."""
    body = (text or "").strip(SPACE)
    if not body:
        return []
    if len(body) <= limit:
        return [text]
    return [body[a:c].rstrip(SPACE) for a, _, c in piece_spans(body, limit, overlap)]


def split_pieces(chunks: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no int, n_pieces int, piece string) of each oversized text: its length without outer white space is above the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [split_text(t, limit, overlap) for t in batch.column(1).to_pylist()]
            size = [len(p) for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))),
                    pa.array([n for s in size for n in range(s)], pa.int32()),
                    pa.array([s for s in size for _ in range(s)], pa.int32()),
                    pa.array([p for ps in pieces for p in ps], pa.string()),
                ],
                [key, "piece_no", "n_pieces", "piece"],
            )

    long = chunks.select(key, F.col(text).cast("string").alias("_text")).filter(F.length(F.btrim("_text", F.lit(SPACE))) > limit)
    return spread(long).mapInArrow(run, f"`{key}` {long.schema[0].dataType.simpleString()}, piece_no int, n_pieces int, piece string")


def renumbered(parts: DataFrame, group: str, order: list[str], count: str) -> DataFrame:
    """parts with `first_no` long: the running sum of `count` before each row within its group, in the given order.

    A group may hold any share of the rows: rows are range-partitioned over group and order, so a large group spans many
    tasks, and each task's offset comes from the sums of the tasks before it.
    """
    spark = parts.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = cut(parts.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(group, "_part").agg(F.sum(count).alias("_n"))
    w = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(group, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = W.partitionBy(group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.join(sums, [group, "_part"])
        .withColumn("first_no", F.col("_before") + F.coalesce(F.sum(count).over(own), F.lit(0)))
        .drop("_part", "_before")
    )


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All passages of an index with the oversized ones in pieces: (chunk_id, source_id, page, chunk_index long, piece_no, text).

    chunk_index counts anew within each source_id, in the order of the old chunk_index (nulls last), chunk_ord and id.
    """
    cols = chunks.select("id", F.coalesce("source_id", F.lit("")).alias("source_id"), "page", "chunk_index", "chunk_ord", "text")
    one = cols.filter(F.col("id").isNotNull()).dropDuplicates(["id"])
    size = F.length(F.btrim("text", F.lit(SPACE)))
    kept = one.filter((size > 0) & (size <= limit)).select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.col("text").alias("piece"))
    pieces = cut(kept.unionByName(split_pieces(one, "id", "text", limit, overlap)))
    heads = pieces.filter("piece_no = 0").select("id", "n_pieces").join(one.drop("text"), "id")
    heads = heads.withColumn("_ord", F.coalesce(F.col("chunk_index"), F.lit(2**31 - 1)))
    heads = renumbered(heads.select("id", "source_id", "page", "_ord", "chunk_ord", "n_pieces"), "source_id", ["_ord", "chunk_ord", "id"], "n_pieces")
    return pieces.drop("n_pieces").join(heads, "id").select(
        F.col("id").alias("chunk_id"), "source_id", "page", (F.col("first_no") + F.col("piece_no")).alias("chunk_index"), "piece_no", F.col("piece").alias("text")
    )


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id): the ids whose text came out in more than one piece."""
    return split_pieces(chunks.filter(F.col("id").isNotNull()), "id", "text", limit, overlap).filter("n_pieces > 1 and piece_no = 0").select(F.col("id").alias("chunk_id")).distinct()
