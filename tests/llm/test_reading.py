import pytest

from vetloom.llm import reading

EASY = "The team reads the list. The guard locks the door. We keep the log. "
HARD = "The organisational resilience programme comprehensively inventories interoperability certification documentation notwithstanding jurisdictional limitations, because the accountable executive representative retrospectively reconciles environmental contingency provisions. "


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, level int")


def test_levels(spark):
    rows = [(n, EASY * (4 + n % 3), None) for n in range(10)] + [(100 + n, HARD * (3 + n % 3), None) for n in range(10)]
    rows += [(200, None, None), (201, "", None), (202, "too short", None), (9, EASY * 4, None)]
    got = reading.reading_levels(docs(spark, rows), labels(spark, [(0, 1), (1, 1), (1, 1), (100, 4), (101, 4), (102, 9), (300, 2), (103, None)])).collect()
    assert {r.doc_id: r.level for r in got} == {n: 1 for n in range(2, 10)} | {100 + n: 4 for n in range(4, 10)}
    assert len(got) == 14


def test_without_examples(spark):
    df = docs(spark, [(1, EASY * 5, None)])
    assert reading.reading_levels(df, labels(spark, [])).count() == 0
    assert reading.reading_levels(df.limit(0), labels(spark, [(1, 1)])).count() == 0


def test_profile_is_free_of_numbering():
    plain, noisy = reading.profile(EASY * 4), reading.profile((EASY * 4).replace("list.", "list (e.g. no. 7.2)."))
    assert plain == noisy and plain[0] == "en"
    assert reading.profile("12 34") == reading.profile("...")
    assert reading.profile("The answer is no. We keep the log.")[2] == reading.profile("The answer is yes. We keep the log.")[2]
    assert reading.profile((EASY + "See art. 7 of A-1.2, vgl. no. 3, etc. now. ") * 3) == reading.profile((EASY + "See of now. ") * 3)


def test_values_are_harmonic(spark):
    # Two graded ends and a few ungraded cells between them: values rise from one end to the other.
    rows = [("en", n, 40, {0: 1.0, 8: 12.0}.get(n, 0.0), {0: 1, 8: 3}.get(n, 0), 0 if n in (0, 8) else 1) for n in range(9)]
    cells, rounds, change = reading.propagated(spark.createDataFrame(rows, "lang string, a int, b int, ys double, graded long, rest long"), 0.01)
    u = [r.u for r in cells.orderBy("a").collect()]
    assert rounds > 2 and change <= 0.01 and 1 <= u[0] < 2 < 3 < u[-1] <= 4
    assert all(x < y for x, y in zip(u, u[1:]))
    with pytest.raises(RuntimeError):
        reading.propagated(cells.drop("u"), 0.0, 1)
