"""Questions from text and from grids of cells.

Stitching wrapped lines and grouping them into items depend on what was joined before, so each document is folded once in
Python; scoring, filtering, de-duplication and numbering are column expressions and aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..session import cut, spread

STITCH_BELOW, ITEM_BELOW = 300, 400
# Least mean score of a question column, weight of its header, rows that are scored, rows a header is looked for in, longest header cell.
MIN_COLUMN_SCORE, HEADER_WEIGHT, SAMPLE_ROWS, HEADER_SCAN, HEADER_CELL = 1.2, 3, 400, 25, 40

# Sheets that hold no questions, and header cells.
SKIP_SHEET = r"(?i)^\s*(instructions?|how to|guidance|read ?me|cover|title|front ?page|about|glossary|definitions?|terms|legend|key|revision history|version history|change ?log|contents?|index|toc|scoring|rating|scale|reference|lookup|dropdowns?|lists?|validation|data ?validation)\b"
QUESTION_HEADER = r"(?i)^\s*(question|questions|control question|requirement|requirements|control|control description|description|criteria|inquiry|ask|item|assessment question|control objective)\s*$"
NON_QUESTION_HEADER = r"(?i)^\s*(#|no\.?|num|number|id|ref|ref\.?|reference|control ?id|question ?(?:id|no|number|#)|domain|category|section|area|family|group|type|response|answer|reply|comments?|notes?|remarks?|evidence|attachments?|status|owner|assignee|due|date|score|weight|priority|applicab\w*|in ?scope|yes\/no|y\/n)\s*$"
HEADER_WORD = r"(?i)^\s*(#|no\.?|id|ref|reference|control|domain|category|section|question|requirement|description|response|answer|comments?|notes?|evidence|status|owner|score|weight|priority|applicab\w*|yes\/no|y\/n|criteria|guidance)\b"

_MARKER, _CONTROL, _BULLET = (re.compile(p) for p in (Q.MARKER, Q.CONTROL_ID, Q.BULLET))
_BOILER = re.compile(Q.BOILERPLATE[:-2] + "(?![A-Za-z0-9_])")


def _mark(line: str) -> str | None:
    m = _CONTROL.match(line) or _MARKER.match(line)
    return m.group(1) if m else ("•" if _BULLET.match(line) else None)


def _heading(line: str) -> bool:
    return bool(_BOILER.match(line)) or (len(line) < 60 and line[-1] not in ".?" and line == line.upper() and re.search("[A-Z]{3}", line) is not None)


def items(text: str | None) -> tuple[int, list[tuple[str, str | None]]]:
    """How many lines a text has after stitching, and its items as (joined lines, marker)."""
    lines: list[str] = []
    for raw in (text or "").split("\n"):
        line = raw.strip()
        if not line:
            continue
        if lines and len(lines[-1]) < STITCH_BELOW and lines[-1][-1] not in ".?!:;|" and re.match(r"[a-z(\[]", line) and _mark(line) is None:
            lines[-1] += " " + line
        else:
            lines.append(line)
    out: list[tuple[str, str | None]] = []
    for line in lines:
        mark = _mark(line)
        if mark is None and out:
            before = out[-1][0]
            if before[-1] not in ".?!" and "|" not in line and "|" not in before and not _heading(line) and len(before) < ITEM_BELOW:
                out[-1] = (f"{before} {line}", out[-1][1])
                continue
        out.append((line, mark))
    return len(lines), out


def extracted_items(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, joined, marker, lines) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, joined, mark, size) for d, t in zip(*(c.to_pylist() for c in batch.columns)) for size, found in [items(t)] for n, (joined, mark) in enumerate(found)]
            d, n, j, m, s = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(n, pa.int32()), pa.array(j, pa.string()), pa.array(m, pa.string()), pa.array(s, pa.int32())], ["doc_id", "ord", "joined", "marker", "lines"])

    return spread(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))).mapInArrow(run, "doc_id string, ord int, joined string, marker string, lines int")


def numbered(rows: DataFrame, group: str, order: str, into: str = "index") -> DataFrame:
    """rows with their place within their group, from 0; a group may hold any share of the rows.

    Rows are range-partitioned over group and order, so a large group spans many tasks; each adds what the tasks before it hold.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = cut(rows.repartitionByRange(n, group, order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each group and task
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy(group, "_part").orderBy(order)))
    out = own.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q")))
    return out.withColumn(into, (F.col("_before") + F.col("_own") - 1).cast("int")).drop("_part", "_own", "_before", "_g", "_q")


def deduped(scored: DataFrame, group: list[str], order: str, spread: bool = False) -> DataFrame:
    """One row for each text within its group, letters and digits only: the best score, else the earliest, at the first one's place.

    Columns besides the key travel in a struct; partial aggregation collapses repeated texts before the shuffle. Groups
    that may be of any size are to be `spread` over tasks when they are numbered; those of one document need not.
    """
    keyed = scored.withColumn("_key", Q.dedupe_key(F.col("text"))).filter("_key <> ''")
    row = F.struct(*[c for c in scored.columns if c not in group])
    best = keyed.groupBy(*group, "_key").agg(F.max_by(row, F.struct("score", -F.col(order))).alias("r"), F.min(order).alias("_first"))
    if spread:
        (name,) = group
        return numbered(best.select(name, "r.*", "_first"), name, "_first").drop("_first")
    w = W.partitionBy(*group).orderBy("_first")
    return best.select(*group, "r.*", (F.row_number().over(w) - 1).alias("index"))


def from_text(docs: DataFrame, min_score: int = Q.MIN_SCORE) -> DataFrame:
    """(doc_id, index, text, marker, score, signals): the questions of each document."""
    it = Q.with_scored(extracted_items(docs), "joined", "marker").select("doc_id", "ord", "marker", "s.*")
    kept = it.filter((F.col("score") >= min_score) & (F.length("text") >= Q.MIN_LENGTH))
    out = deduped(kept, ["doc_id"], "ord").withColumn("text", Q.truncated(F.col("text")))
    return out.select("doc_id", "index", "text", "marker", "score", "signals")


def extraction_stats(docs: DataFrame, min_score: int = Q.MIN_SCORE) -> DataFrame:
    """Lines, candidates, extracted, rejected and duplicate items of each document."""
    it = Q.with_scored(extracted_items(docs), "joined", "marker").select("doc_id", "lines", "s.*")
    ok = (F.col("score") >= min_score) & (F.length("text") >= Q.MIN_LENGTH)
    key = F.when(ok, F.nullif(Q.dedupe_key(F.col("text")), F.lit("")))
    out = it.groupBy("doc_id").agg(F.max("lines").alias("lines"), F.count(F.lit(1)).alias("candidates"), F.count_if(ok).alias("kept"), F.count_distinct(key).alias("extracted"))
    return out.select("doc_id", "lines", "candidates", "extracted", (F.col("candidates") - F.col("kept")).alias("rejected"), (F.col("kept") - F.col("extracted")).alias("duplicates"))


def from_lines(docs: DataFrame) -> DataFrame:
    """Typed-in questions, one a line: only markers and layout go."""
    line = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "line"))
    clean = line.select("doc_id", "ord", Q.tidy(Q.without_marker(Q.trimmed(F.col("line")))).alias("text")).filter("text <> ''")
    w = W.partitionBy("doc_id").orderBy("ord")
    return clean.select("doc_id", (F.row_number().over(w) - 1).alias("index"), "text", F.lit(99).alias("score"), F.array(F.lit("manual entry")).alias("signals"))


def kept_sheets(cells: DataFrame, include_hidden: bool = False) -> DataFrame:
    """(workbook, sheet_ord, sheet, keep, reason): sheets that are looked at, and why others are not."""
    s = cells.groupBy("workbook", "sheet_ord", "sheet").agg(F.max("hidden").alias("hidden"), F.count("cell").alias("filled"))
    out = F.when(F.col("hidden") & F.lit(not include_hidden), "hidden sheet").when(F.col("filled") == 0, "empty")
    # What a sheet's name makes of it, and how that is told.
    named = F.col("sheet").rlike(Q.spark_pattern(SKIP_SHEET))
    s = s.withColumn("reason", out).withColumn("named", named & F.col("reason").isNull())
    other = F.max(F.col("reason").isNull() & ~F.col("named")).over(W.partitionBy("workbook"))
    low = F.lower("sheet")
    why = (
        F.when(low.rlike("gloss|definit|term|legend|key"), "looks like a glossary")
        .when(low.rlike("instruct|how to|guidance|read ?me"), "looks like guidance")
        .when(low.rlike("cover|title|front|about"), "looks like a cover page")
        .when(low.rlike("revision|version|change ?log"), "looks like a change log")
        .when(low.rlike("scor|rating|scale"), "looks like a scoring key")
        .when(low.rlike("content|index|toc"), "looks like a contents page")
        .otherwise("not a questionnaire sheet")
    )
    s = s.withColumn("reason", F.when(F.col("named") & other, why).otherwise(F.col("reason")))
    return s.select("workbook", "sheet_ord", "sheet", F.col("reason").isNull().alias("keep"), "reason")


def _header(row_wide: DataFrame) -> DataFrame:
    """(workbook, sheet_ord, header_idx): the first header row of each sheet among its first rows, unless a question comes before it."""
    header = (F.col("filled") >= 2) & (F.col("headerish") >= 2)
    data = (F.col("filled") >= 2) & ~header & (F.col("best") >= Q.MIN_SCORE + 1)
    first = row_wide.filter(F.col("row_idx") < HEADER_SCAN).groupBy("workbook", "sheet_ord").agg(F.min(F.when(header, F.col("row_idx"))).alias("h"), F.min(F.when(data, F.col("row_idx"))).alias("d"))
    return first.select("workbook", "sheet_ord", F.when(F.col("h").isNotNull() & (F.col("d").isNull() | (F.col("h") < F.col("d"))), F.col("h")).alias("header_idx"))


def column_choice(cells: DataFrame) -> DataFrame:
    """(workbook, sheet_ord, sheet, col, mean, hits, header_idx, header): the question column of each sheet that is looked at.

    cells: workbook, sheet_ord, sheet, hidden, row_idx, row_no, col, cell; blank cells count as none.
    """
    return _choice(_scored_cells(cells))


def _scored_cells(cells: DataFrame) -> DataFrame:
    c = cells.join(kept_sheets(cells).filter("keep").select("workbook", "sheet_ord"), ["workbook", "sheet_ord"])
    c = c.withColumn("cell", Q.trimmed(F.col("cell").cast("string"))).filter("cell <> ''")
    c = Q.with_scored(c, "cell")
    headerish = (F.length("cell") <= HEADER_CELL) & F.col("cell").rlike(Q.spark_pattern(HEADER_WORD))
    rows = c.groupBy("workbook", "sheet_ord", "row_idx").agg(F.count(F.lit(1)).alias("filled"), F.count_if(headerish).alias("headerish"), F.max("s.score").alias("best"))
    return c.join(_header(rows), ["workbook", "sheet_ord"], "left").withColumn("body_start", F.coalesce(F.col("header_idx") + 1, F.lit(0)))


def _hit() -> Column:
    return (F.col("s.score") >= Q.MIN_SCORE) & (F.length("cell") >= Q.MIN_LENGTH)


def _choice(c: DataFrame) -> DataFrame:
    body = c.filter((F.col("row_idx") >= F.col("body_start")) & (F.col("row_idx") < F.col("body_start") + SAMPLE_ROWS))
    col = body.groupBy("workbook", "sheet_ord", "sheet", "col").agg(F.avg("s.score").alias("mean"), F.count_if(_hit()).alias("hits"))
    head = c.filter(F.col("row_idx") == F.col("header_idx")).select("workbook", "sheet_ord", "col", F.col("cell").alias("header"), "header_idx")
    col = col.join(head, ["workbook", "sheet_ord", "col"], "left")
    h = F.coalesce("header", F.lit(""))
    bonus = F.when(h.rlike(Q.spark_pattern(QUESTION_HEADER)), HEADER_WEIGHT).when(h.rlike(Q.spark_pattern(NON_QUESTION_HEADER)), -HEADER_WEIGHT).otherwise(0)
    col = col.withColumn("mean", F.round(F.col("mean") + bonus, 9))
    w = W.partitionBy("workbook", "sheet_ord").orderBy(F.desc("mean"), "col")
    best = col.withColumn("p", F.row_number().over(w)).filter("p = 1").drop("p")
    return best.filter((F.col("mean") >= MIN_COLUMN_SCORE) & (F.col("hits") > 0)).select("workbook", "sheet_ord", "sheet", "col", "mean", "hits", "header_idx", "header")


def from_grid(cells: DataFrame) -> DataFrame:
    """(workbook, index, sheet, col, row, text, score, signals): questions of each workbook, from the chosen column or whole rows."""
    c = _scored_cells(cells)
    choice = _choice(c).select("workbook", "sheet_ord", F.col("col").alias("best"))
    c = c.join(choice, ["workbook", "sheet_ord"], "left").filter(F.col("row_idx") >= F.col("body_start"))
    one = c.filter((F.col("col") == F.col("best")) & _hit()).select("workbook", "sheet_ord", "sheet", "col", "row_idx", F.col("row_no").alias("row"), "cell", "s.*")
    rows = c.filter(F.col("best").isNull()).groupBy("workbook", "sheet_ord", "sheet", "row_idx", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), " ").alias("cell"))
    rows = Q.with_scored(rows, "cell").filter(_hit()).select("workbook", "sheet_ord", "sheet", F.lit(None).cast("int").alias("col"), "row_idx", F.col("row_no").alias("row"), "cell", "s.*")
    found = one.unionByName(rows).withColumn("text", Q.truncated(F.when(F.col("text") == "", F.col("cell")).otherwise(F.col("text"))))
    found = found.withColumn("ord", F.col("sheet_ord").cast("long") * 1_000_000 + F.col("row_idx")).drop("cell", "row_idx", "sheet_ord")
    return deduped(found, ["workbook"], "ord").drop("ord")
