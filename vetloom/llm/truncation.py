"""Texts that were cut off by field limits or in transfer (problem 2).

Lengths of every text are recomputed as different stores would count them: characters, UTF-8 bytes, UTF-16 units, with
entities escaped, as JSON, with line breaks as CR LF. Grouped by table, source and length, a hidden limit shows as a
length at which far more texts stop without a closing mark than at the lengths around it. Then the ends are inspected:
a text is cut if its end is broken, if it stands at a hidden limit without a closing mark, or if by the statistics of
the whole corpus nothing ends where it does (endings).

Defined results: null, empty and blank texts are whole; repeated rows of one id are one record; a null source is a source
of its own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from . import endings

#: Names of the ways to count a text's length.
MEASURES = ("characters", "utf8_bytes", "utf16_units", "entities", "json", "crlf")
#: A limit needs so many open ends at one length, so many times the mean of the lengths within REACH, this share, and a field this wide.
LEAST, TIMES, REACH, SHARE, NARROWEST = 8, 10.0, 15, 0.5, 32


def lengths(t: str) -> list[int]:
    """The text's length by each of MEASURES."""
    n, wide = len(t), 0 if t.isascii() else sum(c > "￿" for c in t)
    lone = t.count("\n") - t.count("\r\n")
    return [
        n,
        n if t.isascii() else len(t.encode("utf-8")),
        n + wide,
        n + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * (t.count('"') + t.count("'")),
        n + t.count("\\") + t.count('"') + t.count("\n") + t.count("\r") + t.count("\t") + (0 if t.isascii() else 5 * (sum(c > "\x7f" for c in t) + wide) + wide),
        n + lone,
    ]


def ends(table: DataFrame, name: str, key: str, text: str, source: str) -> DataFrame:
    """One row for each text: its key and source, how it ends, and its lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            verdict, pair, last, proper = zip(*map(endings.tail, texts), strict=True) if texts else ((), (), (), ())
            closed = [v == "whole" and endings._CLOSED.search(t.rstrip()[-1:]) is not None and t[-1:] == t.rstrip()[-1:] or not t.strip() for t, v in zip(texts, verdict)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(verdict, pa.string()), pa.array(pair, pa.string()), pa.array(last, pa.string()), pa.array(proper, pa.bool_()), pa.array(closed, pa.bool_()), pa.array([lengths(t) for t in texts], pa.list_(pa.int32()))],
                ["record_id", "source", "verdict", "pair", "last", "proper", "closed", "sizes"],
            )

    src = table.select(F.col(key).cast("string").alias("record_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("t")).filter("record_id is not null and t is not null")
    out = spread(src).mapInArrow(run, "record_id string, source string, verdict string, pair string, last string, proper boolean, closed boolean, sizes array<int>")
    return out.withColumn("table_name", F.lit(name)).withColumn("source", F.coalesce("source", F.lit("")))


def limits(all_ends: DataFrame) -> DataFrame:
    """(table_name, source, measure, size, open, total): the hidden limits of each source."""
    flat = all_ends.select("table_name", "source", "closed", F.posexplode("sizes").alias("measure", "size"))
    hist = stored(flat.groupBy("table_name", "source", "measure", "size").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("closed")).alias("open")))
    peak = hist.filter((F.col("open") >= LEAST) & (F.col("open") >= SHARE * F.col("total")) & (F.col("size") >= NARROWEST))
    around = peak.select("table_name", "source", "measure", F.col("size").alias("at"), F.explode(F.sequence(F.col("size") - REACH, F.col("size") + REACH)).alias("size"))
    near = around.filter("size <> at").join(hist, ["table_name", "source", "measure", "size"]).groupBy("table_name", "source", "measure", F.col("at").alias("size")).agg(F.sum("open").alias("around"))
    found = peak.join(near, ["table_name", "source", "measure", "size"], "left")
    return found.filter(F.col("open") >= TIMES * F.greatest(F.lit(0.1), F.coalesce("around", F.lit(0)) / (2 * REACH))).drop("around")


class Truncation:
    """The ends of all texts of several tables (name, frame, key column, text column, source column), judged."""

    def __init__(self, tables: list[tuple[str, DataFrame, str, str, str]], also: list[DataFrame] | None = None):
        """also: further texts, in their first column, that only the statistics of ends read."""
        pairs = stored(endings.follow([t.select(text) for _, t, _, text, _ in tables] + (also or [])))
        parts = [ends(t, name, key, text, source) for name, t, key, text, source in tables]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = stored(rows.dropDuplicates(["table_name", "record_id"]))
        words = endings.words_of(pairs)
        self.limits = stored(limits(rows))
        at = self.limits.select("table_name", "source", "measure", "size", F.lit(True).alias("hit"))
        open_ = rows.filter(~F.col("closed")).select("table_name", "record_id", "source", F.posexplode("sizes").alias("measure", "size"))
        stopped = open_.join(at, ["table_name", "source", "measure", "size"]).select("table_name", "record_id").distinct().withColumn("limit", F.lit(True))
        judged = endings.judged(rows.drop("sizes"), pairs, words, endings.stems(words))
        self.rows = judged.join(stopped, ["table_name", "record_id"], "left").withColumn("cut", F.col("cut") | F.coalesce("limit", F.lit(False)))

    def found(self) -> DataFrame:
        """(table_name, record_id) of the texts that lost their end."""
        return self.rows.filter("cut").select("table_name", "record_id")

    def report(self) -> DataFrame:
        """How often each source truncates, and where its limit lies in characters, if it has one."""
        sums = self.rows.groupBy("table_name", "source").agg(F.count(F.lit(1)).alias("records"), F.count_if("cut").alias("truncated"), F.count_if("limit").alias("at_limit"))
        limit = self.limits.groupBy("table_name", "source").agg(F.max_by("size", F.struct("open", -F.col("measure"))).alias("limit_size"), F.max_by(F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1), F.struct("open", -F.col("measure"))).alias("limit_measure"))
        return sums.join(limit, ["table_name", "source"], "left").withColumn("share", F.round(F.col("truncated") / F.col("records"), 6))
