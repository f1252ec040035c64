"""The k most similar vectors of every vector (problem 4).

A hierarchical k-means tree is fitted on a bounded sample for each vector width; where the vectors outnumber what its
leaves can hold, a second tree, fitted on what the sample's vectors differ from their leaves' centres, divides each leaf
again, so the cells grow with the data while both trees stay bounded. Every vector is indexed in the cell it falls into.
A query walks the trees best bin first: a priority queue holds the open nodes by their cosine to the query, the best is
opened, and leaves are visited in the order they come up. How many a query visits is calibrated: held-out queries, which
the trees were not fitted on, are compared with all rows by brute force, and the visits are widened until the wanted
share of their true neighbours lies in visited cells; where MAX_VISITS cells don't reach it, the width is searched
exactly, each query meeting all vectors. Queries and members of a cell meet in one block matrix product per task.

Vectors travel in half precision, or in one byte a component where only cosines above a least one are asked for; that moves
a cosine by at most the MARGIN of the kind. A query keeps k + SPARE candidates; those whose
place or side of the least cosine that error could change are ranked again by full-precision cosines, and where even the
spare candidates lie within the error of the k-th place (dense groups), the query meets its cells again in full precision.

Scale: exact copies are collapsed to one representative before anything else, so a group of copies of any size is one
vector. A cell that holds more than BLOCK_ROWS (a dense spot) is cut into blocks that are searched in separate tasks, a
query going to each of them. The driver sees the sample, the sizes of the crowded cells and the calibration result.
Trees are fitted for the TREES most frequent widths; vectors of rarer ones all meet each other.

Defined results: null, empty, non-finite, all-zero vectors and those whose length contradicts their stated width are
left out; vectors are compared only within one width; ties go to the smaller id; repeated rows of one id are one vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: Most vectors of one width that its trees are fitted on, most bytes of all of them, and the vectors a cell should hold.
SAMPLE_ROWS, SAMPLE_BYTES, LEAF_ROWS = 24_000, 128 << 20, 512
#: Least sample vectors for each leaf, children of a node, rounds of k-means, widths that get trees.
LEAF_SAMPLE, BRANCH, ROUNDS, TREES = 12, 16, 6, 16
#: Members of a cell that one task compares with at once.
BLOCK_ROWS = 8192
#: Held-out queries of the calibration, share of their neighbours to be found (of those above a least cosine: their number
#: gives an estimate to some 0.015 only, so no share closer to 1 can be told), most cells a query visits before all are compared.
CALIBRATION, RECALL, RECALL_ABOVE, MAX_VISITS = 768, 0.995, 0.98, 256
#: Neighbours above the least cosine that the held-out queries must have between them; with fewer, the nearest count whatever their cosine.
ENOUGH = 32
#: How far rounding moves a cosine. Half precision keeps 11 bits: a unit vector moves by at most 2**-11, a cosine by twice
#: that. Bytes move each component by up to 1/254 of the largest; as these errors are independent, a cosine moves by some
#: 0.0005, and more than 20 times that never occurs.
MARGIN = {np.float16: 0.001, np.int8: 0.012, np.float64: 1e-12}
#: Candidates kept beyond the k-th.
SPARE = 22
#: Most classes of copies, or ids, that are broadcast (some 60 bytes each).
FEW = 200_000


class Tree:
    """Hierarchical k-means over unit vectors; nodes are numbered, leaves are numbered apart."""

    def __init__(self, x: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 7):
        rnd = np.random.default_rng(seed)
        centres, self.kids, self.leaf = [np.zeros(x.shape[1], np.float32)], {}, [-1]
        todo, leaves = [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            parts = _kmeans(x[rows], min(branch, -(-len(rows) // leaf)), rnd) if len(rows) > leaf else None
            if parts is None or len(parts[0]) < 2:
                self.leaf[node] = leaves
                leaves += 1
                continue
            ids = []
            for k, c in enumerate(parts[0]):
                ids.append(len(centres))
                centres.append(c)
                self.leaf.append(-1)
                todo.append((ids[-1], rows[parts[1] == k]))
            self.kids[node] = np.array(ids)
        self.centres, self.leaf, self.leaves = np.array(centres, np.float32), np.array(self.leaf), leaves
        #: the centre of each leaf
        self.middle = self.centres[np.argsort(np.where(self.leaf < 0, len(self.leaf), self.leaf), kind="stable")[:leaves]]

    def route(self, x: np.ndarray, visits: int) -> np.ndarray:
        """(rows, visits) leaves in the order a best-bin-first walk reaches them; -1 where the tree has no more."""
        n, visits = len(x), min(visits, self.leaves)
        out = np.full((n, visits), -1, np.int64)
        if 0 not in self.kids:
            out[:, :1] = 0
            return out
        got = np.zeros(n, np.int64)
        node = np.zeros(n, np.int64)  # the node each row has just taken from its queue
        live = np.arange(n)
        score, queue = np.full((n, 0), -np.inf, np.float32), np.zeros((n, 0), np.int64)
        while len(live):
            inner = self.leaf[node[live]] < 0
            done = live[~inner]
            out[done, got[done]] = self.leaf[node[done]]
            got[done] += 1
            opened = live[inner]
            if len(opened):
                add_s, add_q = np.full((n, BRANCH), -np.inf, np.float32), np.zeros((n, BRANCH), np.int64)
                order = opened[np.argsort(node[opened], kind="stable")]
                for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    kids = self.kids[node[group[0]]]
                    add_s[group, : len(kids)] = x[group] @ self.centres[kids].T
                    add_q[group, : len(kids)] = kids
                score, queue = np.hstack([score, add_s]), np.hstack([queue, add_q])
            live = live[got[live] < visits]
            if not len(live):
                break
            best = np.argmax(score[live], axis=1)
            some = score[live, best] > -np.inf
            live, best = live[some], best[some]
            node[live] = queue[live, best]
            score[live, best] = -np.inf
        return out


def _kmeans(x: np.ndarray, k: int, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    c = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = np.argmax(x @ c.T, axis=1)
        new = np.zeros((k, x.shape[1]), np.float64)
        np.add.at(new, at, x) if len(x) < 256 else _sum_by(new, at, x)
        norm = np.linalg.norm(new, axis=1)
        c = np.where((norm > 0)[:, None], new / np.maximum(norm, 1e-12)[:, None], c).astype(np.float32)
    at = np.argmax(x @ c.T, axis=1)
    size = np.bincount(at, minlength=k)
    keep = np.flatnonzero(size)
    return c[keep], np.searchsorted(keep, at)


def _sum_by(out: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
    out[at[order][first]] = np.add.reduceat(x[order], first, axis=0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Cells:
    """A tree over unit vectors and, where `fine` is above 1, a second one over their differences from its leaves' centres."""

    def __init__(self, x: np.ndarray, leaf: int, fine: int = 1):
        self.tree, self.fine = Tree(x, leaf), None
        if fine > 1:
            self.fine = Tree(_unit(x - self.tree.middle[self.tree.route(x, 1)[:, 0]]), max(LEAF_SAMPLE, -(-len(x) // fine)))
        self.per = self.fine.leaves if self.fine else 1

    def second(self, x: np.ndarray, first: np.ndarray, visits: int) -> np.ndarray:
        """(rows, visits) leaves of the second tree for vectors in these leaves of the first, -1 where there are no more."""
        return self.fine.route(_unit(x - self.tree.middle[first]), visits) if self.fine else np.zeros((len(x), 1), np.int64)

    def route(self, x: np.ndarray, visits: tuple[int, int]) -> np.ndarray:
        """(rows, most visits) cells, the vector's own first; -1 where the trees have no more."""
        first = self.tree.route(x, visits[0])
        if not self.fine:
            return first
        out = []
        for leaf in first.T:
            inner = self.second(x, np.maximum(leaf, 0), visits[1])
            out.append(np.where((leaf[:, None] < 0) | (inner < 0), -1, leaf[:, None] * self.per + inner))
        return np.hstack(out)


#: What stands in for the trees of a width that has none: one cell for all.
FLAT = Cells(np.zeros((1, 1), np.float32), 1)


def units(codes: pa.Array, kind: type = np.float16) -> np.ndarray:
    """Unit float vectors of packed ones of one width."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    x = np.frombuffer(b"".join(codes.to_pylist()), kind).astype(np.float64 if kind is np.float64 else np.float32).reshape(len(codes), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(chunks: DataFrame, key: str, vector: str, width: str, kind: type = np.float16) -> DataFrame:
    """(id, d int, digest binary, code binary) of the usable vectors: their directions in half precision or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, dims = batch.columns
            off = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            size = np.diff(off)
            want = dims.fill_null(-1).to_numpy(zero_copy_only=False)
            at, d, digest, code = [], [], [], []
            for w in np.unique(want[(want > 0) & (size == want)]):
                rows = np.flatnonzero((want == w) & (size == w))
                x = flat[off[rows][:, None] + np.arange(w)]
                top = np.abs(x).max(axis=1)
                ok = np.isfinite(top) & (top > 0)
                x, rows, top = np.ascontiguousarray(x[ok]), rows[ok], top[ok]
                c = x / top[:, None]
                c = np.rint(c * 127).astype(np.int8) if kind is np.int8 else (c / np.linalg.norm(c, axis=1, keepdims=True)).astype(kind)
                at.append(rows)
                d += [int(w)] * len(rows)
                digest += [hashlib.blake2b(v, digest_size=16).digest() for v in x + 0.0]
                code += [v.tobytes() for v in c]
            rows = np.concatenate(at) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(d, pa.int32()), pa.array(digest, pa.binary()), pa.array(code, pa.binary())], ["id", "d", "digest", "code"])

    src = chunks.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(width).cast("int").alias("w"))
    src = src.filter("id is not null and v is not null and w > 0 and size(v) = w")
    return src.mapInArrow(run, "id string, d int, digest binary, code binary")


def _few(ids: DataFrame) -> DataFrame:
    """ids, computed once; to be broadcast if they are at most FEW, so that the vectors they are looked up in need no shuffle."""
    ids = stored(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


class Index:
    """Packed vectors, one per class of exact copies, with the fitted trees; search() finds neighbours."""

    def __init__(self, chunks: DataFrame, key: str = "id", vector: str = "embedding", width: str = "embedding_dims", kind: type = np.float16):
        rows = stored(packed(chunks, key, vector, width, kind))
        self.kind, self.margin = kind, MARGIN[kind]
        self.spark = chunks.sparkSession
        #: (id, v): the vectors in full precision
        self.raw = chunks.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        per = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
        self.several = stored(per.filter("n > 1"))
        # Few classes are sent to the vectors, so that these need not be shuffled to be told apart; many are joined by shuffle.
        few = self.several.count() <= FEW
        classes = F.broadcast(self.several) if few else self.several
        many = rows.join(classes.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("id"), F.first("d").alias("d"), F.first("code").alias("code"))
        #: one row for each distinct vector
        self.rows = rows.join(classes.select("digest"), "digest", "left_anti").select("id", "d", "code").unionByName(many.select("id", "d", "code"))
        #: (rep, id) of all members of classes that hold more than one id
        self.members = rows.join(classes.select("digest", "rep"), "digest").select("rep", "id").distinct()
        counts = {r.d: r.n for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(TREES).collect()}
        most = {d: min(SAMPLE_ROWS, max(LEAF_SAMPLE, SAMPLE_BYTES // (4 * d * len(counts)))) for d in counts}
        chosen = F.lit(False)
        for d, n in counts.items():
            chosen = chosen | ((F.col("d") == d) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.1 * (most[d] + CALIBRATION) / n)) + 1))
        got = rows.filter(chosen).select("d", "digest", "id", "code").toArrow()
        self.cells: dict[int, Cells] = {}
        #: held-out queries of each width: their ids and vectors
        self.asked: dict[int, tuple[list[str], np.ndarray]] = {}
        dims = got["d"].to_numpy()
        for d, n in counts.items():
            part = got.take(pa.array(np.flatnonzero(dims == d)))
            _, one = np.unique(np.array(part["digest"].to_pylist()), return_index=True)  # in order of the digests: shuffled
            part = part.take(pa.array(one[: most[d] + CALIBRATION]))
            x = units(part["code"], kind)
            held = min(CALIBRATION, len(x) // 4)
            self.asked[d] = (part["id"].to_pylist()[:held], x[:held])
            x = x[held:]
            leaves = max(1, min(n // LEAF_ROWS, len(x) // LEAF_SAMPLE))
            self.cells[d] = Cells(x, max(LEAF_SAMPLE, len(x) // leaves), min(n // LEAF_ROWS // leaves, len(x) // LEAF_SAMPLE))

    def calibrate(self, k: int, least: float, recall: float = RECALL) -> dict[int, tuple[int, int] | None]:
        """Leaves to visit in the first and second tree, by width, so that the share of the held-out queries' true neighbours is reached.

        None where MAX_VISITS cells miss it. Where hardly any held-out query has a neighbour above the least cosine, the k
        nearest count whatever their cosine.
        """
        shipped, kind = self.spark.sparkContext.broadcast((self.cells, self.asked)), self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, asked = shipped.value
            best: dict[int, tuple] = {}
            for batch in batches:
                dims = batch.column("d").to_numpy()
                for d in np.unique(dims):
                    if not len(asked.get(int(d), ((), ()))[0]):
                        continue
                    ids, q = asked[int(d)]
                    part = batch.take(pa.array(np.flatnonzero(dims == d)))
                    x = units(part.column("code"), kind)
                    s = q @ x.T
                    s[np.array(ids, dtype=object)[:, None] == np.array(part.column("id").to_pylist(), dtype=object)[None, :]] = -2
                    top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
                    score, vector = np.take_along_axis(s, top, 1), x[top]
                    if int(d) in best:
                        score, vector = np.hstack([best[int(d)][0], score]), np.concatenate([best[int(d)][1], vector], axis=1)
                        keep = np.argsort(-score, axis=1)[:, :k]
                        score, vector = np.take_along_axis(score, keep, 1), np.take_along_axis(vector, keep[:, :, None], 1)
                    best[int(d)] = (score, vector)
            for d, (score, vector) in best.items():
                q, j = np.nonzero(score > -2)
                home = cells[d].route(vector[q, j], (1, 1))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(q), pa.int32()), pa.array(q, pa.int32()), pa.array(score[q, j], pa.float32()), pa.array(home, pa.int64())], ["d", "q", "s", "cell"])

        near = self.rows.select("id", "d", "code").mapInArrow(run, "d int, q int, s float, cell long")
        near = near.withColumn("r", F.row_number().over(W.partitionBy("d", "q").orderBy(F.desc("s")))).filter(F.col("r") <= k).toPandas()
        visits: dict[int, tuple[int, int] | None] = {}
        for d, cells in self.cells.items():
            mine = near[near.d == d]
            mine = mine[mine.s >= least] if (mine.s >= least).sum() >= ENOUGH else mine
            if mine.empty:  # too few vectors to hold any out
                visits[d] = None
                continue
            q, cell = mine.q.to_numpy(), mine.cell.to_numpy()
            one = self._place(cells.tree.route(self.asked[d][1], MAX_VISITS)[q], cell // cells.per)
            two = self._place(cells.second(self.asked[d][1][q], cell // cells.per, 64), cell % cells.per)
            options = [(a * b, a, b) for b in sorted({*two[two < 64] + 1}) for a in range(1, MAX_VISITS // b + 1) if ((one < a) & (two < b)).mean() >= recall]
            visits[d] = min(options)[1:] if options else None
        return visits

    @staticmethod
    def _place(order: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """At which place of its row's order each leaf comes up; MAX_VISITS where it does not."""
        hit = order == leaf[:, None]
        return np.where(hit.any(axis=1), hit.argmax(axis=1), MAX_VISITS)

    def search(self, k: int = 10, least: float = -1.0, queries: str | None = None, recall: float = RECALL) -> DataFrame:
        """(id, other, cosine double, place int): the k nearest representatives of each, or of those with a member that matches the condition.

        Cosines above the least only; they are exact where a rank or the least cosine hangs on them, else to within the margin of the kind.
        """
        visits = self.calibrate(k, least, recall)
        # A width without trees, or whose visits miss the recall, has one cell, cut into blocks that every query goes to.
        shipped, kind = self.spark.sparkContext.broadcast({d: (c, visits[d]) for d, c in self.cells.items() if visits[d]}), self.kind
        rows = self.rows.withColumn("asks", F.lit(True))
        if queries:
            asking = self.members.filter(queries).select(F.col("rep").alias("id")).distinct().withColumn("copy_asks", F.lit(True))
            rows = self.rows.join(asking, "id", "left").select("id", "d", "code", (F.coalesce(F.expr(queries), F.lit(False)) | F.col("copy_asks").isNotNull()).alias("asks"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, asks = batch.column("d").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                for d in np.unique(dims):
                    cells, wide = shipped.value.get(int(d), (FLAT, (1, 1)))
                    for mine, visit in ((asks, wide), (~asks, (1, 1))):
                        rows = np.flatnonzero((dims == d) & mine)
                        if len(rows):
                            part = batch.take(pa.array(rows))
                            at = cells.route(units(part.column("code"), kind), visit)
                            keep = at >= 0
                            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep.sum(axis=1))), pa.int32()), pa.array(at[keep], pa.int64()))
                            yield pa.RecordBatch.from_arrays([*part.select(["id", "d", "code", "asks"]).columns, lists], ["id", "d", "code", "asks", "cells"])

        routed = stored(rows.mapInArrow(route, "id string, d int, code binary, asks boolean, cells array<long>"))
        crowded = routed.groupBy("d", F.element_at("cells", 1).alias("cell")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS)
        parts = [(r.d, r.cell, -(-r.n // BLOCK_ROWS)) for r in crowded.collect()]
        several = self.spark.createDataFrame(parts, "d int, cell long, n long") if parts else None
        near = stored(self._ranked(self._met(routed, several, k, least, kind), k + SPARE))
        # Dense groups: the spare candidates are all within the error of the k-th place, so there may be more such.
        at = F.max(F.when(F.col("place") == k, F.col("cosine"))).over(W.partitionBy("id"))
        last = near.withColumn("kth", at).filter((F.col("place") == k + SPARE) & (F.col("cosine") >= F.col("kth") - 2 * self.margin)).select("id")
        dense = stored(last)
        exact = near.limit(0)
        if not dense.isEmpty():
            cells = routed.join(dense, "id", "left_semi").select("d", F.explode("cells").alias("cell")).distinct()
            some = routed.join(dense.withColumn("dense", F.lit(True)), "id", "left").withColumn("asks", F.col("dense").isNotNull()).drop("dense")
            some = some.withColumn("cells", F.when(F.col("asks"), F.col("cells")).otherwise(F.slice("cells", 1, 1)))
            need = some.select("id", "d", "asks", F.posexplode("cells").alias("pos", "cell")).join(cells, ["d", "cell"], "left_semi")
            need = need.groupBy("id", "d", "asks").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda x: x["cell"]).alias("cells"))
            exact = self._ranked(self._met(self._full(stored(need)), several, k, least, np.float64), k).select(near.columns)
        rest = near.join(dense, "id", "left_anti")
        # The others: full precision where the error could change who is among the k, or on which side of the least a pair lies.
        w = W.partitionBy("id")
        kth = F.max(F.when(F.col("place") == k, F.col("cosine"))).over(w)
        rest = rest.withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("cosine") >= F.col("kth") - 2 * self.margin))
        unsure = (F.count(F.lit(1)).over(w) > k) | (F.max((F.abs(F.col("cosine") - least) <= self.margin).cast("int")).over(w) > 0) | F.lit(least <= -1)
        rest = stored(rest.withColumn("unsure", unsure).drop("kth", "place"))
        sure = rest.filter(~F.col("unsure")).drop("unsure")
        again = self._cosines(rest.filter("unsure").select("id", "other"))
        return self._ranked(sure.unionByName(again), k).unionByName(exact).filter(F.col("cosine") >= least)

    def _full(self, rows: DataFrame) -> DataFrame:
        """rows (id, d, ...) with `code`: their vectors in full precision."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = [(x / np.abs(x).max()).tobytes() for x in map(np.array, batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.binary())], ["id", "code"])

        full = self.raw.join(_few(rows.select("id").distinct()), "id", "left_semi").filter("v is not null and size(v) > 0").dropDuplicates(["id"]).mapInArrow(run, "id string, code binary")
        return rows.join(full, "id")

    def _met(self, routed: DataFrame, several: DataFrame | None, k: int, least: float, kind: type) -> DataFrame:
        """(id, other, cosine): of each query the k + SPARE best members of each block of the cells it goes to."""
        sent = routed.select("id", "d", "code", "asks", F.posexplode("cells").alias("pos", "cell"))
        # Without any crowded cell there is no join: an empty side found while running would make the exchange be planned and written again.
        if several is None:
            sent = sent.withColumn("n", F.lit(1).cast("long"))
        else:
            sent = sent.join(F.broadcast(several), ["d", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(1)))  # a row for each crowded cell
        own = F.pmod(F.xxhash64("id"), F.col("n"))
        sent = sent.withColumn("block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array(own))))
        sent = sent.withColumn("member", (F.col("pos") == 0) & (F.col("block") == own)).select("id", "d", "code", "asks", "cell", "block", "member")
        wanted, floor = k + SPARE, least - self.margin

        def meet(table: pa.Table) -> pa.Table:
            x = units(table["code"], kind)
            ids = np.array(table["id"].to_pylist(), dtype=object)
            mine = np.flatnonzero(table["member"].to_numpy())
            asks = np.flatnonzero(table["asks"].to_numpy())
            name = np.unique(ids, return_inverse=True)[1]
            out: list = [[], [], []]
            for at in range(0, len(asks) if len(mine) else 0, 1024):
                q = asks[at : at + 1024]
                s = x[q] @ x[mine].T
                s[name[q][:, None] == name[mine][None, :]] = -2
                if floor > -1:
                    i, j = np.nonzero(s >= floor)
                    score = s[i, j]
                    order = np.lexsort((name[mine[j]], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < wanted
                else:
                    top = np.argpartition(-s, min(wanted, s.shape[1] - 1), axis=1)[:, :wanted]
                    i, j = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
                    score = s[i, j]
                    keep = score > -2
                i, j, score = i[keep], j[keep], score[keep]
                out[0].append(ids[q[i]])
                out[1].append(ids[mine[j]])
                out[2].append(score)
            a, b, s = (np.concatenate(o) if o else np.zeros(0) for o in out)
            return pa.table({"id": pa.array(a.tolist(), pa.string()), "other": pa.array(b.tolist(), pa.string()), "cosine": pa.array(s.astype(np.float64), pa.float64())})

        return sent.groupBy("d", "cell", "block").applyInArrow(meet, "id string, other string, cosine double")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        w = W.partitionBy("id").orderBy(F.desc("cosine"), "other")
        return found.select("id", "other", "cosine").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)

    def _cosines(self, pairs: DataFrame) -> DataFrame:
        """(id, other, cosine): the pairs with their cosines in full precision."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = []
                for u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = np.array(u), np.array(v)
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    got.append(float(x @ y / np.sqrt((x @ x) * (y @ y))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["id", "other", "cosine"])

        need = pairs.select("id").union(pairs.select("other")).distinct()
        raw = stored(self.raw.join(_few(need), "id", "left_semi").filter("v is not null and size(v) > 0").dropDuplicates(["id"]))
        both = pairs.join(raw.select("id", F.col("v").alias("u")), "id").join(raw.select(F.col("id").alias("other"), "v"), "other")
        return both.select("id", "other", "u", "v").mapInArrow(run, "id string, other string, cosine double")

    def expanded(self, near: DataFrame, k: int, queries: str | None = None) -> DataFrame:
        """(id, other, cosine, place): search()'s result for all ids, copies included, or for those that match the condition.

        Of an id's neighbours, its own copies come first, the smallest ids before others; a neighbour that has copies is
        followed by them.
        """
        heads = stored(_heads(self.members, k))
        asked = self.members.filter(queries) if queries else self.members
        own = asked.join(heads, "rep").select("id", F.posexplode(F.slice(F.filter("head", lambda x: x != F.col("id")), 1, k)).alias("pos", "other"))
        own = own.select("id", "other", F.lit(1.0).alias("cosine"), (F.col("pos") + 1).alias("place"))
        # Classes of copies: every member has the neighbours of its representative, behind its own copies.
        size = heads.select(F.col("rep").alias("id"), (F.col("n") - 1).alias("copies"))
        wide = near.select("id", "other", "cosine").join(size, "id", "left").filter(F.coalesce("copies", F.lit(0)) < k)
        wide = wide.join(heads.select(F.col("rep").alias("other"), "head"), "other", "left")
        wide = wide.select("id", "cosine", F.coalesce("copies", F.lit(0)).alias("copies"), F.explode(F.coalesce("head", F.array("other"))).alias("other"))
        w = W.partitionBy("id").orderBy(F.desc("cosine"), "other")
        wide = wide.withColumn("place", (F.row_number().over(w) + F.col("copies")).cast("int")).filter(F.col("place") <= k)
        wide = wide.join(self.members.select(F.col("rep").alias("id"), F.col("id").alias("mine")), "id", "left")
        wide = wide.select(F.coalesce("mine", "id").alias("id"), "other", "cosine", "place")
        out = own.unionByName(wide).filter("id <> other")
        return out.filter(queries) if queries else out


def similar_pairs(chunks: DataFrame, least: float = 0.90, k: int = 10, key: str = "id", vector: str = "embedding", width: str = "embedding_dims", recall: float = RECALL_ABOVE) -> DataFrame:
    """(chunk_id_a, chunk_id_b): pairs of ids with at least this cosine, one being among the k most similar of the other.

    Of more than k exact copies each has the k with the smallest ids.
    """
    index = Index(chunks, key, vector, width, np.int8)
    pairs = index.expanded(stored(index.search(k, least, recall=recall)), k)
    return pairs.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def _heads(members: DataFrame, k: int) -> DataFrame:
    """(rep, head, n): the k + 1 smallest ids of each class and its size; a large class is ranked in salted parts first."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = salted.groupBy("rep", "salt").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("rep", "salt").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    head = few.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("head"))
    return head.join(part.groupBy("rep").agg(F.sum("n").alias("n")), "rep")


def nearest(chunks: DataFrame, queries: str, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(chunk_id, place, neighbour_id, cosine): the k most similar ids of every id that matches the condition, copies included."""
    index = Index(chunks)
    found = index.expanded(stored(index.search(k, -1.0, queries, recall)), k, queries)
    return found.select(F.col("id").alias("chunk_id"), "place", F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))
