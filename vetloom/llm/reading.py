"""Reading level of each document by harmonic propagation over a similarity graph (problem 9).

Two documents are linked if their profiles are close: the share of long words and the logarithm of the mean sentence
length, each on a fine grid, and the language. Graded documents are clamped to their level; every other one takes the
weighted mean of its neighbours, round after round, until no value moves by more than TOLERANCE. Documents of one grid
cell and language have the same neighbours and therefore the same value, so the graph is folded exactly to its cells: a
cell carries the sum of its clamped levels and its numbers of graded and ungraded documents. Rounds run as aggregations
over cells, whose number is bounded by the grid whatever the corpus holds; only profiling reads texts. Weak links at coarser grids, and to all languages, tie cells
without close neighbours to the rest.

Defined results: null and empty texts and those below `least_words` get no row, nor do graded documents; graded levels
outside 1 to 4 or null are no examples; a document graded several times counts with its mean; without any usable example
there are no rows; repeated rows of one id give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread, stored

#: Grid steps of the share of long words and of the logarithm of the mean sentence length; letters of a long word.
STEP_SHARE, STEP_LENGTH, LONG = 0.015, 0.05, 9
#: (grid factor, reach in cells, bandwidth in cells, weight) of the links.
SCALES = ((1, 4, 2.0, 1.0), (4, 2, 1.0, 1e-3), (16, 2, 1.0, 1e-5), (1 << 20, 0, 1.0, 1e-8))
#: Weight of links across languages, and of an ungraded neighbour against a graded one.
ACROSS, UNGRADED = 0.02, 0.25
#: Rounds end when the largest change of a value is below this; so many are allowed, and more are an error, not a cut.
TOLERANCE, MOST_ROUNDS = 0.005, 200
LEAST_WORDS = 40

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of to in is for with on by at each our does do how not what who that before while because so as are this we it",
    "de": "der die das und den dem des ist für mit von wie nicht ein eine im zu auf vor nach jede jeder durch denn aber wir oft doch",
    "fr": "le la les et des du est pour avec dans une un chaque que qui par sur au aux mais nous pas car puis en ce cette",
    "es": "el la los las y de del es para con en una un cada que por al pero no se su como porque luego lo nos",
}
# Abbreviations that are no words and whose full stop ends no sentence; the second line's only before a number.
ABBREVIATIONS = "e.g i.e z.B d.h p.ex p.ej etc bzw vgl ca cf vs"
NUMBERING = "no nr núm art sec"

_STOPS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY, _NUMBERED = ("|".join(re.escape(a) for a in t.split()) for t in (ABBREVIATIONS, NUMBERING))
#: Abbreviations and reference numbers (neither word nor end), words, and what ends a sentence: closing marks before white
#: space, a line break, a cell's border.
_UNIT = re.compile(
    rf"(?<![^\W_])(?i:(?:{_ANY})\.|(?:{_NUMBERED})\.(?=\s*[0-9]))|(?:(?<![^\W_])[A-Z]{{1,3}}[-.])?[0-9]+(?:[.,:]+[0-9]+)*"
    r"|[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?…。！？]+(?=\s|$)|[\n\r|]+"
)
_ENDS = frozenset(".!?…。！？\n\r|")
_NOT_WORD = frozenset(".0123456789")


def profile(text: str) -> tuple[str, int, int]:
    """Language, share cell and length cell of a text."""
    units = [u for u in _UNIT.findall(text) if u[-1] not in _NOT_WORD or u[0] in _ENDS]
    length = np.fromiter(map(len, units), np.int64, len(units))
    end = np.fromiter((u[0] in _ENDS for u in units), bool, len(units))
    size = np.diff(np.append(np.flatnonzero(end), len(units)), prepend=-1) - 1  # words between two ends
    full = np.repeat(size >= 3, size + 1)[: len(units)] & ~end
    seen = {u.lower() for u in set(units)}
    hits = {k: len(seen & v) for k, v in _STOPS.items()}
    lang = max(hits, key=hits.get)
    words, sentences = int(full.sum()), int((size >= 3).sum())
    share = float((length[full] >= LONG).sum()) / max(words, 1)
    return lang if hits[lang] > 1 else "", int(share / STEP_SHARE), int(np.log(max(words, 1) / max(sentences, 1)) / STEP_LENGTH)


def profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words long, lang, a int, b int) of each text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, a, b = zip(*map(profile, texts), strict=True) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(lang, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], [key, "words", "lang", "a", "b"])

    src = docs.select(key, F.col(text).cast("string")).dropna()
    return spread(src).mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, words long, lang string, a int, b int")


def _offsets() -> list[tuple[int, int, int, float]]:
    """(scale, offsets, kernel weight) of the cells in reach."""
    return [
        (n, i, j, float(np.exp(-0.5 * (i * i + j * j) / width**2)))
        for n, (_, reach, width, _) in enumerate(SCALES)
        for i in range(-reach, reach + 1)
        for j in range(-reach, reach + 1)
    ]


def _keys(weighted: bool) -> F.Column:
    """The cell itself at each scale, within its language and across all."""
    rows = []
    for n, (factor, _, _, weight) in enumerate(SCALES):
        for lang, part in ((F.col("lang"), 1.0), (F.lit("*"), ACROSS)):
            cell = [F.lit(n).alias("n"), lang.alias("l"), F.floor(F.col("a") / factor).cast("int").alias("x"), F.floor(F.col("b") / factor).cast("int").alias("y")]
            rows.append(F.struct(*cell, *([F.lit(weight * part).alias("w")] if weighted else [])))
    return F.array(*rows)


def propagated(cells: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> tuple[DataFrame, int, float]:
    """cells (lang, a, b, ys, graded, rest) with `u`, the value of their ungraded documents, the rounds made and the last change.

    The rounds stop when no value changes by more than the tolerance: then the values are harmonic but for that residual.
    Links are written once, as (cell, cell sum of a scale, weight); a round sums the cells of each scale, then the links.
    """
    own = F.xxhash64("lang", "a", "b").alias("cell")
    cells = cut(cells.withColumn("cell", own).withColumn("u", F.lit(None).cast("double")))
    reach = F.broadcast(cells.sparkSession.createDataFrame(_offsets(), "n int, i int, j int, k double"))  # 132 fixed rows
    node = F.xxhash64("n", "l", "x", "y").alias("node")
    inside = stored(cells.select("cell", F.explode(_keys(False)).alias("c")).select("cell", "c.*").select("cell", node))
    links = cells.select("cell", F.explode(_keys(True)).alias("c")).select("cell", "c.*").join(reach, "n")
    links = links.select("cell", "n", "l", (F.col("x") - F.col("i")).alias("x"), (F.col("y") - F.col("j")).alias("y"), (F.col("w") * F.col("k")).alias("w"))
    links = stored(links.select("cell", node, "w").join(inside.select("node").distinct(), "node", "left_semi"))
    for n in range(most):
        open_ = F.when(F.col("u").isNull(), 0.0).otherwise(F.col("rest") * UNGRADED)
        mass = cells.select("cell", (F.col("ys") + open_ * F.coalesce("u", F.lit(0.0))).alias("s"), (F.col("graded") + open_).alias("m")).filter("m > 0")
        at = inside.join(mass, "cell").groupBy("node").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
        new = links.join(at, "node").groupBy("cell").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("m"))).alias("u"))
        cells = cut(cells.withColumnRenamed("u", "_u").join(new, "cell", "left"))
        change = cells.agg(F.max(F.abs(F.col("u") - F.coalesce("_u", F.lit(0.0))))).first()[0] or 0.0
        cells = cells.drop("_u")
        if change <= tolerance:
            return cells.drop("cell"), n + 1, change
    raise RuntimeError(f"the levels still change by {change} after {most} rounds")


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "level", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, level int, difficulty double) of the documents that are not graded and have enough words."""
    known = stored(profiles(docs, key, text).filter(F.col("words") > 0).dropDuplicates([key]))
    graded = labels.select(key, F.col(level).cast("double").alias("y")).filter("y between 1 and 4").groupBy(key).agg(F.avg("y").alias("y"))
    marked = labels.select(key).distinct()
    cells = known.join(graded, key, "left").groupBy("lang", "a", "b").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("ys"), F.count("y").alias("graded"), F.sum(F.when(F.col("y").isNull(), 1).otherwise(0)).alias("rest"))
    value = propagated(cells)[0].select("lang", "a", "b", "u").filter("u is not null")
    asked = known.filter(F.col("words") >= least_words).join(marked, key, "left_anti")
    out = asked.join(value, ["lang", "a", "b"])
    return out.select(key, F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.col("u") + 0.5))).cast("int").alias("level"), F.round("u", 4).alias("difficulty"))
