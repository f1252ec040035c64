"""Mixing sources to target weights by capped water-filling (problem 8).

Sizes are counted in tokens of a public tokenizer. A source whose share would need more than its allowed repetitions is
clamped at them, and what it leaves over is spread over the others in proportion to their weights, until no further
source is clamped. A source then gets its whole repetitions of all documents and a seeded part of its documents once more:
documents are taken in the order of a seeded hash until their tokens reach the fraction. The place in that order is
found by summing tokens over hash ranges, twice refined, so no task ever sorts a source.

The driver holds the target table, which has one row for each source, and for each source the sums of RANGES hash ranges.

Defined results: documents of sources without target, or with a null source, are left out; sources without documents, and
those whose documents hold no token, fall short and are reported with a reached share of 0; null and empty texts have no
token and are used like the others of their source; repeated rows of one id are one document; without any target or
document the mix is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .bpe import TOKENIZER_DIR, token_counts

#: Hash ranges at each refinement.
RANGES = 1024
SEED = 17


def water_fill(sizes: dict[str, float], shares: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens that each source gives: proportional to its share, at most its repetitions of its size."""
    caps = {s: sizes.get(s, 0) * repeats[s] for s in shares}
    given: dict[str, float] = {}
    while len(given) < len(shares):
        free = [s for s in shares if s not in given]
        left, weight = total - sum(given.values()), sum(shares[s] for s in free)
        over = [s for s in free if weight <= 0 or left * shares[s] / weight >= caps[s]]
        if not over:
            return given | {s: left * shares[s] / weight for s in free}
        given |= {s: min(caps[s], 0.0 if shares[s] <= 0 else caps[s]) for s in over}
    return given


def _range(level: int) -> F.Column:
    """The hash range of a document at this refinement."""
    return F.pmod(F.shiftright("h", 10 * (2 - level)), F.lit(RANGES)).cast("int")


class Mix:
    """Counted documents with what each source gives; rows() are the documents used, report() the shares reached."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR):
        self.spark, self.key = docs.sparkSession, key
        goal = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).filter("source is not null").dropDuplicates(["source"])
        self.goal = {r.source: (max(r.target_share or 0.0, 0.0), max(r.max_repeats or 0, 0)) for r in goal.collect()}
        counted = token_counts(docs.filter(F.col("source").isin(list(self.goal))), key, text, name, tokenizer_dir, ("source",))
        self.docs = stored(counted.dropDuplicates([key]).withColumn("h", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30))))
        stats = self.docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
        self.stats = {r.source: (r.documents, r.tokens) for r in stats.collect()}
        sizes = {s: t for s, (_, t) in self.stats.items()}
        total = float(sum(sizes.values())) if total is None else total
        self.given = water_fill(sizes, {s: v[0] for s, v in self.goal.items()}, {s: v[1] for s, v in self.goal.items()}, total)

    def rows(self) -> DataFrame:
        """(key, source, n_tokens, copies int): each document that is used, and how often."""
        whole, part = {}, {}
        for s, (_, size) in self.stats.items():
            epochs = self.given[s] / size if size else 0.0
            whole[s] = min(int(epochs + 1e-9), self.goal[s][1])
            rest = self.given[s] - whole[s] * size
            if whole[s] < self.goal[s][1] and rest > 0.5:
                part[s] = rest
        # Refinement: ranges before `at` are taken whole, the one at `at` is looked into.
        at: dict[str, list[int]] = {s: [] for s in part}
        for level in range(2):
            inner = F.lit(False)
            for s, path in at.items():
                inner = inner | ((F.col("source") == s) & self._inside(path))
            sums: dict[str, list[float]] = {s: [0.0] * RANGES for s in part}
            for r in self.docs.filter(inner).groupBy("source", _range(level).alias("r")).agg(F.sum("n_tokens").alias("n")).collect():
                sums[r.source][r.r] = r.n
            for s, per in sums.items():
                k = 0
                while k < RANGES - 1 and part[s] >= per[k]:
                    part[s] -= per[k]
                    k += 1
                at[s].append(k)
        plan = self.spark.createDataFrame(
            [(s, whole[s], *(at[s] if s in part else [-1, -1]), float(part.get(s, 0.0))) for s in self.stats] or [("", 0, -1, -1, 0.0)], "source string, whole int, r0 int, r1 int, rest double"
        )
        d = self.docs.join(F.broadcast(plan), "source")  # one row for each source
        edge = (_range(0) == F.col("r0")) & (_range(1) == F.col("r1"))
        before = (_range(0) < F.col("r0")) | ((_range(0) == F.col("r0")) & (_range(1) < F.col("r1")))
        near = W.partitionBy("source").orderBy("h", self.key)
        last = d.filter(edge).withColumn("more", (F.sum("n_tokens").over(near) - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
        rest = d.filter(~edge).withColumn("more", before.cast("int"))
        out = rest.unionByName(last).withColumn("copies", F.col("whole") + F.col("more")).filter("copies > 0")
        return out.select(self.key, "source", "n_tokens", "copies")

    @staticmethod
    def _inside(path: list[int]) -> F.Column:
        cond = F.lit(True)
        for level, k in enumerate(path):
            cond = cond & (_range(level) == k)
        return cond

    def report(self) -> DataFrame:
        """One row for each source of the targets, with the share it reached and whether it falls short of its target."""
        used = self.rows().groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("given"), F.max("copies").alias("most"))
        rows = [(s, share, most, *map(int, self.stats.get(s, (0, 0)))) for s, (share, most) in self.goal.items()]
        base = self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents long, tokens long")
        out = base.join(used, "source", "left").fillna(0, ["used", "given", "most"])
        share = F.try_divide("given", F.sum("given").over(W.partitionBy()))  # one row for each source
        return out.select(
            "source", "target_share", "max_repeats", "documents", "tokens", F.col("used").alias("documents_used"), F.col("given").alias("tokens_given"), F.col("most").alias("most_repeats"),
            F.round(F.coalesce(share, F.lit(0.0)), 6).alias("reached_share"), (F.coalesce(share, F.lit(0.0)) < F.col("target_share") * 0.995).alias("falls_short"),
        )
