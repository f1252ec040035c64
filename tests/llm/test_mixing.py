import pytest

from vetloom.llm import mixing


def test_water_fill():
    got = mixing.water_fill({"a": 100, "b": 10}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 2, "c": 3}, 110)
    assert got == {"c": 0.0, "b": 20.0, "a": 90.0}
    assert sum(mixing.water_fill({"a": 100}, {"a": 1.0}, {"a": 1}, 500).values()) == 100
    assert mixing.water_fill({}, {}, {}, 5) == {}
    assert mixing.water_fill({"a": 5}, {"a": 0.0}, {"a": 1}, 5) == {"a": 0.0}


TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, text string"


def test_mix(spark):
    docs = [(n, "big", "some words in a text " * (1 + n % 7)) for n in range(400)] + [(1000 + n, "small", "other words here") for n in range(40)]
    docs += [(2000, "loose", "x"), (2001, None, "x"), (2002, "small", None), (0, "big", "some words in a text ")]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.05, 4), ("gone", 0.05, 2)], TARGETS)
    mix = mixing.Mix(df, targets, total=9000)
    rows = mix.rows().collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {r.source for r in rows} <= {"big", "small"}
    assert all(1 <= r.copies <= {"big": 1, "small": 4}[r.source] for r in rows)
    for s in ("big", "small"):
        assert sum(r.n_tokens * r.copies for r in rows if r.source == s) == pytest.approx(mix.given[s], abs=40)
    report = {r.source: r for r in mix.report().collect()}
    assert report["gone"].reached_share == 0 and report["gone"].falls_short
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1, abs=1e-5)
    assert sorted(map(tuple, mixing.Mix(df, targets, total=9000).rows().collect())) == sorted(map(tuple, rows))


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.Mix(docs, targets).rows().count() == 0
    assert [r.reached_share for r in mixing.Mix(docs, targets).report().collect()] == [0.0]
    assert mixing.Mix(docs, targets.limit(0)).rows().count() == 0
