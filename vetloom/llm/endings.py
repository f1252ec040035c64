"""What the ends of texts look like, learned from the whole corpus: shared by the operators on cut-off values.

`follow` counts, for every pair of neighbouring words, how often a word comes after it and how often a mark, a line or a
paragraph ends there. A pair after which nearly always a word comes is no place where a text ends by itself. `stems`
holds the beginnings of known words. Both are tables keyed by strings and stay distributed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Entries a task gathers before it hands them on.
FLUSH = 400_000
#: Least share of ends after a pair of words, and least count of a word, to be trusted.
ENDS, KNOWN = 0.05, 3
#: Texts of so few tokens tell by their end too: set phrases that stand alone recur, cut-off ones hardly do.
SHORT = 5
#: Longest beginning of a word that is looked up.
STEM = 48

_WRAP = re.compile(r"\n(?=[a-zà-ÿ])")
_TOKEN = re.compile(r"\w+(?:[-'’./]\w+)*|[^\w\s]|\n")
#: What can only stand at the end of a value that was cut: a broken character, entity, tag or escape, an open mark.
_BROKEN = re.compile(r"(?:�|&#?\w{0,8}|<[^<>]{0,40}|\\u?[0-9a-fA-F]{0,3}|(?:^|\s)[(\[{/\"“«„¿¡]|[,;(\[{¿¡]|\w-|[—–&+=]|\b(?:d|l|qu|n|s|j|c|m|t)['’])$", re.I)
#: An ellipsis that stands in for the rest; one inside brackets belongs to the text.
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)[\"'”’]?$")
_CLOSED = re.compile(r"[.!?。！？)\]}»”\"|]$")
# Abbreviations whose full stop is no end.
_ABBREVIATION = re.compile(r"\((?:[^()]*\s)?(?:e\.g|i\.e|e|i|no|nr|z\.B|z|p\.ex|p\.ej|cf|vgl)\.?$", re.I)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(_WRAP.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n")).lower())


def follow(texts: Iterable[DataFrame]) -> DataFrame:
    """(pair, word long, mark long): what comes after two neighbouring words; '^' stands for a line's start. Column 0 of each table is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array([f"{a} {b}" for a, b, _ in keys], pa.string()), pa.array([n if k else 0 for (_, _, k), n in seen.items()], pa.int64()), pa.array([0 if k else n for (_, _, k), n in seen.items()], pa.int64())],
                ["pair", "word", "mark"],
            )
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = tokens(text)
                if len(t) <= SHORT:
                    t.append("\n")
                isword = [x[0].isalnum() or x[0] == "_" for x in t]
                before = ["^", *(x if w else "^" for x, w in zip(t, isword))]
                seen.update(x for x, w in zip(zip(before, t, isword[1:]), isword) if w)
            if len(seen) > FLUSH:
                yield flush()
        yield flush()

    parts = [spread(t.select(F.col(t.columns[0]).cast("string").alias("t")).dropna()).mapInArrow(run, "pair string, word long, mark long") for t in texts]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("pair").agg(F.sum("word").alias("word"), F.sum("mark").alias("mark"))


def words_of(pairs: DataFrame) -> DataFrame:
    """(token, word, mark): the same for single words."""
    return pairs.groupBy(F.substring_index("pair", " ", -1).alias("token")).agg(F.sum("word").alias("word"), F.sum("mark").alias("mark"))


def stems(words: DataFrame) -> DataFrame:
    """(stem, more long): beginnings of known words, and how often the most frequent longer word occurs."""
    known = words.filter((F.col("word") + F.col("mark") >= KNOWN) & (F.length("token") > 1))
    cut = known.select((F.col("word") + F.col("mark")).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("token") - 1, F.lit(STEM))), lambda k: F.substring(F.col("token"), F.lit(1), k))).alias("stem"))
    return cut.groupBy("stem").agg(F.max("n").alias("more"))


def tail(text: str) -> tuple[str, str, str, bool]:
    """(verdict, pair, last word, proper) of a text's end.

    The verdict is 'cut' or 'whole' where the end shows it by itself, 'open' where the words must tell; then pair and word
    are keys into follow() and stems(), and proper says that a capital letter stands inside the sentence.
    """
    t = text.rstrip()
    if not t:
        return "whole", "", "", False
    if _ELLIPSIS.search(t) or _BROKEN.search(t[-48:]) or _ABBREVIATION.search(t, max(t.rfind("("), 0)):  # what is broken has at most 41 characters
        return "cut", "", "", False
    if not (t[-1].isalnum() or t[-1] == "_"):
        return "whole", "", "", False
    line = re.split(r"[\r\n]", t)[-1]
    t = _TOKEN.findall(line)
    low = [x.lower() for x in t]
    before = low[-2] if len(t) > 1 and (low[-2][0].isalnum() or low[-2][0] == "_") else "^"
    if any(c.isdigit() for c in low[-1]):
        return "whole", f"{before} {low[-1]}", low[-1], False
    short_line = len(t) <= SHORT and line.strip() != text.strip() and not t[0].islower() and t[0] not in "-*•|"
    proper = before != "^" and t[-1][0].isupper() and len(t[-1]) > 3
    return "line" if short_line else "open", f"{before} {low[-1]}", low[-1], proper


def judged(ends: DataFrame, pairs: DataFrame, words: DataFrame, more: DataFrame) -> DataFrame:
    """ends (verdict, pair, last, proper, lead, ...) with `cut` boolean.

    An open end is a cut if words nearly always follow there, or if its last word is the beginning of a more frequent one
    and not known itself. Short last lines of their own (footers) are judged by their last word's being a beginning only
    if their first word commonly opens long lines.
    """
    # Each distinct end is judged once; the join back is on a key whose other side is unique.
    asked = ends.filter("verdict in ('open', 'line')").groupBy("pair", "last", "proper", "verdict").agg(F.count(F.lit(1)).alias("same"))
    p = pairs.select("pair", F.col("word").alias("pw"), F.col("mark").alias("pm"))
    w = words.select(F.col("token").alias("last"), F.col("word").alias("ww"), F.col("mark").alias("wm"))
    s = more.select(F.col("stem").alias("last"), "more")
    known = asked.join(p, "pair", "left").join(w, "last", "left").join(s, "last", "left").fillna(0, ["pw", "pm", "ww", "wm", "more"])
    seen = F.col("ww") + F.col("wm")
    stem = (F.col("more") > 3 * seen) & (seen < KNOWN + F.col("more") / 1000)
    rarely = F.col("pm") < ENDS * (F.col("pm") + F.col("pw"))
    unlikely = (F.col("wm") < 0.02 * seen) | (F.col("pw") >= 3)
    name = F.col("proper") & (seen > 0) & ~stem
    inside = F.when(stem, True).when(name, False).when(F.col("pw") + F.col("pm") > 0, rarely & unlikely).otherwise((seen > 0) & (F.col("wm") < ENDS * seen))
    verdicts = known.select("pair", "last", "proper", "verdict", F.when(F.col("verdict") == "line", stem & (F.length("last") > 1) & (seen < KNOWN)).otherwise(inside).alias("inside"))
    # Only ends that words must tell are joined: all others would share one empty key.
    told = ends.filter("verdict in ('open', 'line')").join(verdicts, ["pair", "last", "proper", "verdict"], "left").withColumn("cut", F.coalesce("inside", F.lit(False))).drop("inside")
    return told.unionByName(ends.filter("verdict not in ('open', 'line')").withColumn("cut", F.col("verdict") == "cut"))
