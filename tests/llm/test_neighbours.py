import numpy as np

from vetloom.llm import neighbours as nb


def exact(vectors, least, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in top[i] if s[i, j] >= least}


def test_tree_reaches_every_leaf_best_first():
    x = np.random.default_rng(0).normal(size=(600, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = nb.Tree(x, 20)
    order = tree.route(x, tree.leaves)
    assert tree.leaves > 10 and (np.sort(order, axis=1) == np.arange(tree.leaves)).all()
    assert (tree.route(x, 3) == order[:, :3]).all()
    assert nb.Tree(np.ones((50, 4), np.float32) / 2, 5).leaves >= 1


def test_pairs_match_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(150, 24))
    vectors = {f"v{n:04d}": base[n] for n in range(150)}
    for n in range(60):
        vectors[f"w{n:04d}"] = (base[n] + rnd.normal(size=24) * rnd.choice([0.05, 0.2, 0.6])) * rnd.uniform(0.5, 3)
    rows = [(i, v.tolist(), 24) for i, v in vectors.items()]
    rows += rows[:7]  # delivered again
    rows += [("n1", None, 24), ("n2", [], 0), ("n3", [1.0] * 24, 25), ("n4", [float("nan")] * 24, 24), ("n5", [0.0] * 24, 24), ("n6", [None] + [1.0] * 23, 24), ("n7", [float("inf")] * 24, 24), (None, [1.0] * 24, 24)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, embedding_dims int")
    got = {tuple(r) for r in nb.similar_pairs(df, key="id").collect()}
    assert got == exact(vectors, 0.90, 10)


def test_copies_and_other_widths(spark):
    rows = [(f"c{n:02d}", [1.0, 2.0, 3.0], 3) for n in range(15)] + [("d1", [1.0, 2.0, 3.01], 3), ("e1", [1.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, embedding_dims int")
    got = {tuple(r) for r in nb.similar_pairs(df).collect()}
    heads = [f"c{n:02d}" for n in range(11)]
    for n in range(15):  # each copy has the ten smallest other ids
        assert {a if b == f"c{n:02d}" else b for a, b in got if f"c{n:02d}" in (a, b)} >= set([h for h in heads if h != f"c{n:02d}"][:10])
    assert {p for p in got if "d1" in p} == {(f"c{n:02d}", "d1") for n in range(10)}
    assert not [p for p in got if "e1" in p]


def test_empty(spark):
    df = spark.createDataFrame([("a", None, 3)], "id string, embedding array<double>, embedding_dims int")
    assert nb.similar_pairs(df).count() == 0 and nb.nearest(df, "true").count() == 0


def ten_nearest(vectors, asked, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = x @ (vectors[i] / np.linalg.norm(vectors[i]))
        s[ids.index(i)] = -2
        out[i] = [ids[n] for n in np.argsort(-np.round(s, 12), kind="stable")[:k]]
    return out


def frame(spark, vectors, width):
    return spark.createDataFrame([(i, [float(x) for x in v], width) for i, v in vectors.items()], "id string, embedding array<double>, embedding_dims int").repartition(3)


def test_nearest_of_copies_and_where_the_visits_fall_short(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(3000, 16))
    vectors = {f"v{n:05d}": x[n] for n in range(3000)}
    for n in range(3000, 3600, 50):
        vectors[f"v{n:05d}"] = x[n - 2999]  # every second of these ids asks, its representative doesn't
    asks = "cast(substring(id, 2) as int) % 100 = 0"
    monkeypatch.setattr(nb, "MAX_VISITS", 1)
    monkeypatch.setattr(nb, "LEAF_ROWS", 64)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 1000)
    got = {}
    for r in nb.nearest(frame(spark, vectors, 16), asks, 5).orderBy("chunk_id", "place").collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour_id)
    assert got == ten_nearest(vectors, [i for i in vectors if int(i[1:]) % 100 == 0], 5)


def test_second_tree_reaches_the_recall(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 24))
    vectors = {f"v{n:05d}": base[n % 40] + 0.5 * rnd.normal(size=24) for n in range(4000)}
    monkeypatch.setattr(nb, "SAMPLE_ROWS", 400)
    monkeypatch.setattr(nb, "CALIBRATION", 100)
    monkeypatch.setattr(nb, "LEAF_ROWS", 32)
    df = frame(spark, vectors, 24)
    index = nb.Index(df)
    (cells,) = index.cells.values()
    assert cells.per > 1 and len(index.asked[24][0]) == 100
    assert index.calibrate(10, -1.0, 0.95)[24] is not None
    want = ten_nearest(vectors, [i for i in vectors if int(i[1:]) % 100 == 0], 10)
    got = nb.nearest(df, "cast(substring(id, 2) as int) % 100 = 0", 10, 0.95).collect()
    assert sum(r.neighbour_id in want[r.chunk_id] for r in got) >= 0.92 * 10 * len(want) and len(got) == 10 * len(want)


def test_dense_group_is_ranked_in_full_precision(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    centre = rnd.normal(size=12)
    vectors = {f"v{n:05d}": centre + 0.005 * rnd.normal(size=12) for n in range(120)}  # all within the error of half precision
    vectors |= {f"w{n:05d}": rnd.normal(size=12) for n in range(200)}
    monkeypatch.setattr(nb, "BLOCK_ROWS", 50)
    assert {tuple(r) for r in nb.similar_pairs(frame(spark, vectors, 12)).collect()} == exact(vectors, 0.90, 10)
