"""Mapping freely typed values to the entries of a reference list (problem 6).

Distinct values are normalised (file endings, versions, remarks and separators go, joined words are taken apart), and
candidates come from an inverted index of character trigrams, scored by weighted cosine. All candidates above the least
cosine are then checked, the best first, unless the letters alone show that they can't come close, by an alignment that forgives what people do to a label: typing errors cost one, letters left out of a word's
inside little (abbreviations), the last word may come first. A value is accepted if its alignment costs little enough and
clearly less than that of any other entry; a short word may also be the initials of a single entry.

The reference list is held by every worker; its size is checked against MAX_LABELS.

Defined results: null and blank values are not looked at, nor are exact labels; values that mean no entry are reported
with `none`; repeated rows of one id are one record; an empty reference list maps everything to `none`; labels that occur
twice within a field map to the smaller id.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 50_000
#: Least cosine of candidates, most cost for each letter of the value, least lead over the second, most cost less lead.
LEAST_COSINE, COST, LEAD, BALANCE = 0.12, 0.25, 0.03, 0.17
#: Cost of a letter that is left out inside a word, of a word's first letter, of all that follows after at least two letters.
LEFT_OUT, FIRST_LEFT_OUT, REST_LEFT_OUT = 0.3, 0.9, 0.4

# Remarks that people add to a name, and words before it.
REMARKS = "draft final signed copy general old new latest approved version rev scan scanned"
LEADING = "the our a an my"
# File endings.
ENDINGS = "pdf docx doc xlsx xls txt png jpg jpeg csv pptx ppt odt rtf zip md html htm tif tiff msg eml"

_ENDING = re.compile(r"(?:\.(?:" + "|".join(ENDINGS.split()) + r"))+$", re.I)
_BRACKET = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_VERSION = re.compile(r"(?<![a-z0-9])(?:v|ver|rev)\.? ?\d+(?:\.\d+)*(?![a-z0-9])|(?<![a-z0-9])\d[\d.\-]*(?![a-z0-9])", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_REMARKS = frozenset(REMARKS.split())
_LEADING = frozenset(LEADING.split())


def normalised(value: str) -> tuple[list[str], str]:
    """The words of a value, and its letters if it may be initials."""
    v = "".join(c for c in unicodedata.normalize("NFKC", value) if unicodedata.category(c)[0] != "C" or c in "\t\n\r")
    v = _BRACKET.sub(" ", _ENDING.sub("", v.strip()))
    v = _VERSION.sub(" ", v.replace("_", " "))
    dotted = re.search(r"(?<![^\W_])(?:[A-Za-z]\.){2,}", v)
    if dotted:
        rest = (v[: dotted.start()] + v[dotted.end() :]).lower().split()
        if all(w in _LEADING or w in _REMARKS for w in re.findall(r"[^\W_]+", " ".join(rest))):
            return [], dotted.group().replace(".", "").lower()
    words = [w for w in re.split(r"[\W_]+", _HUMP.sub(" ", v)) if w]
    low = [w.lower() for w in words]
    while low and low[0] in _LEADING:
        low, words = low[1:], words[1:]
    while len(low) > 1 and low[-1] in _REMARKS:
        low, words = low[:-1], words[:-1]
    initials = low[0] if len(low) == 1 and 2 <= len(low[0]) <= 6 else ""
    return low, initials


def grams(words: list[str]) -> set[str]:
    joined = "".join(words)
    return {joined[i : i + 3] for i in range(max(1, len(joined) - 2))} | {" " + w[:2] for w in words}


def alignment(value: str, words: tuple[str, ...], most: float) -> float:
    """Cost of turning the words of a label, joined, into a value; above `most` it may be any larger number."""
    label = "".join(words)
    skip, place, last = [], [], []
    for w in words:
        skip += [FIRST_LEFT_OUT] + [LEFT_OUT] * (len(w) - 1)
        place += range(len(w))
        last += [False] * (len(w) - 1) + [True]
    n = len(value)
    rest: list[float] = []
    before2: list[float] = []
    before = list(map(float, range(n + 1)))
    for i, c in enumerate(label):
        row = [before[0] + skip[i]]
        for j in range(n):
            best = before[j] + (c != value[j])
            other = before[j + 1] + skip[i]
            if other < best:
                best = other
            other = row[j] + 1.0
            if other < best:
                best = other
            if i and j and c == value[j - 1] and label[i - 1] == value[j]:
                other = before2[j - 1] + 1.0
                if other < best:
                    best = other
            row.append(best)
        if place[i] == 0:
            rest = [math.inf] * (n + 1)
        elif last[i]:
            row = [min(a, b + REST_LEFT_OUT) for a, b in zip(row, rest)]
        if place[i] > 0:
            rest = [min(a, b) for a, b in zip(row, rest)]
        if min(row) > most and min(rest) > most:
            return most + 1.0
        before2, before = before, row
    return before[n]


class Labels:
    """The entries of one field with their inverted trigram index."""

    def __init__(self, rows: list[tuple[str, str]]):
        first: dict[str, str] = {}
        for ref, label in sorted(rows):
            first.setdefault(label, ref)
        self.refs, self.words = [], []
        for label, ref in first.items():
            w = tuple(normalised(label)[0])
            if w:
                self.refs.append(ref)
                self.words.append(w)
        self.letters = [Counter("".join(w)) for w in self.words]
        sets = [grams(list(w)) for w in self.words]
        count = Counter(g for s in sets for g in s)
        self.idf = {g: math.log(1 + len(sets) / n) for g, n in count.items()}
        self.plain = math.log(1 + len(sets))
        self.post: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, s in enumerate(sets):
            norm = math.sqrt(sum(self.idf[g] ** 2 for g in s)) or 1.0
            for g in s:
                self.post[g].append((i, self.idf[g] / norm))
        self.whole: dict[str, set[int]] = defaultdict(set)
        self.initials: dict[str, set[int]] = defaultdict(set)
        for i, w in enumerate(self.words):
            for form in {"".join(w), w[-1] + "".join(w[:-1])}:
                self.whole[form].add(i)
            if len(w) > 2:
                self.initials["".join(x[0] for x in w)].add(i)

    def match(self, value: str) -> str | None:
        words, initials = normalised(value)
        if initials and len(self.initials.get(initials, ())) == 1:
            return self.refs[next(iter(self.initials[initials]))]
        joined = "".join(words)
        if not joined:
            return None
        if len(self.whole.get(joined, ())) == 1:
            return self.refs[next(iter(self.whole[joined]))]
        own = grams(words)
        score: dict[int, float] = defaultdict(float)
        for g in own:
            for i, w in self.post.get(g, ()):
                score[i] += w * self.idf[g]
        norm = math.sqrt(sum(self.idf.get(g, self.plain) ** 2 for g in own)) or 1.0
        near = sorted(((s / norm, -i) for i, s in score.items() if s / norm >= LEAST_COSINE), reverse=True)
        best = second = math.inf
        found = None
        has = Counter(joined)
        for _, i in near:
            w = self.words[-i]
            # A label that costs more than the second so far, or so much that the lead is full anyway, changes nothing.
            most = min(2 * COST, second) * max(len(joined), 6)
            if sum((has - self.letters[-i]).values()) > most:  # each letter that the label lacks costs one
                continue
            cost = min(alignment(joined, w, most), alignment(joined, (w[-1], *w[:-1]), most) if len(w) > 1 else math.inf) / max(len(joined), 6)
            if cost < best:
                best, second, found = cost, best, -i
            elif cost < second:
                second = cost
        lead = min(second - best, COST) if near else 0.0
        return self.refs[found] if best <= COST and lead >= LEAD and best - lead <= BALANCE else None


def mapped(docs: DataFrame, reference: DataFrame, key: str = "id", fields: tuple[str, ...] = ("name", "category")) -> DataFrame:
    """(document_id, field, ref_id) of each value that is neither null nor blank nor a label; ref_id is `none` without a match."""
    rows = reference.select("field", "ref_id", "label").dropna().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"the reference list has more than {MAX_LABELS} entries")
    lists = {f: [(r.ref_id, r.label) for r in rows if r.field == f] for f in fields}
    shared = docs.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {f: Labels(r) for f, r in shared.value.items()}
        for batch in batches:
            refs = [index[f].match(v) or "none" for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(refs, pa.string())], ["field", "value", "ref_id"])

    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    values = docs.select(F.col(key).cast("string").alias("document_id"), F.explode(pairs).alias("p")).select("document_id", "p.*")
    values = values.filter("document_id is not null").filter(F.col("value").rlike(r"[^\s\p{Z}]"))
    labels = docs.sparkSession.createDataFrame([(f, label) for f, r in lists.items() for _, label in r], "field string, value string").distinct()
    values = values.join(F.broadcast(labels), ["field", "value"], "left_anti").distinct()  # at most MAX_LABELS rows
    # Matching costs far more than moving: the distinct values are spread over all tasks, however few bytes they are.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    known = values.select("field", "value").distinct().repartition(tasks).mapInArrow(run, "field string, value string, ref_id string")
    return values.join(known, ["field", "value"]).select("document_id", "field", "ref_id")
