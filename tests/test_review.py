import pytest
from pyspark.sql import functions as F

from vetloom.functions import text as T
from vetloom.functions import vectors as V
from vetloom.operators import lexical, review

CHUNKS = "passage_id string, ord long, source_type string, source_id string, source_name string, category string, question string, text string, page int, embedding array<double>"
ROWS = [
    ("qa1", 0, "qa", "kb1", "Harbourline spring round", "", "Is multi-factor authentication needed to open the harbour console?", "Console operators confirm each login with a key fob.", None, [1.0, 0, 0, 0, 0, 0, 0]),
    ("qa2", 1, "qa", "kb1", "Harbourline spring round", "", "Name the recovery time objective of the ticket shop", "Six hours for the shop, two for the timetable.", None, [0, 1.0, 0, 0, 0, 0, 0]),
    ("qa3", 2, "qa", "kb2", "Fjordlines", "", "Are background checks made on deckhands?", "The crew office does so before a first trip.", None, [0, 0, 1.0, 0, 0, 0, 0]),
    ("doc1", 3, "document", "d1", "Passenger data rules.pdf", "", None, "Passenger lists are encrypted at rest and in transit; the keys change every quarter.", 12, [0, 0, 0, 1.0, 0, 0, 0]),
    ("doc2", 4, "document", "d2", "Storm handbook.pdf", "", None, "Each spring the disaster recovery plan is rehearsed by moving the booking system to the island site.", 3, [0, 0, 0, 0, 1.0, 0, 0]),
    ("doc3", 5, "document", "d3", "Carriers.pdf", "", None, "Third-party carriers pass an assessment ahead of their first contract.", 5, [0, 0, 0, 0, 0, 1.0, 0.2]),
]
MFA, DATA, DR, BIRD, ADMIN, VETS, RTO = (
    "Is multi-factor authentication needed to open the harbour console?", "Are passenger lists encrypted at rest and in transit?", "How often is the disaster recovery plan rehearsed?", "Which colour do penguins prefer?",
    "Do console operators use MFA daily?", "Who inspects the firms that ship spare parts?", "And the RTO?",
)


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(*r[:-1], [float(x) for x in r[-1]]) for r in ROWS], CHUNKS).cache()


def run(spark, chunks, **vectors):
    vectors = {k: [float(x) for x in v] for k, v in vectors.items()}
    asked = [(q, q, vectors.get(k)) for k, q in {"mfa": MFA, "data": DATA, "dr": DR, "bird": BIRD, "admin": ADMIN, "vets": VETS, "rto": RTO}.items()] + [("blank", " ", None)]
    questions = spark.createDataFrame(asked, "query_id string, text string, embedding array<double>")
    return {r.query_id: r for r in review.reviewed(questions, chunks).collect()}


def test_lexical_review(spark, chunks):
    got = run(spark, chunks)
    assert set(got) == {MFA, DATA, DR, BIRD, ADMIN, VETS, RTO}
    assert got[MFA].status == "auto-filled" and "key fob" in got[MFA].answer and got[MFA].source.startswith("Previously answered")
    assert got[DATA].status == "flagged" and got[DATA].answer == "" and got[DATA].suggestion.page == 12 and got[DATA].source.endswith("p.12")
    assert got[DR].suggestion.source_name == "Storm handbook.pdf"
    assert got[BIRD].status == "needs-input" and got[BIRD].confidence == 0 and got[BIRD].suggestion is None and not got[BIRD].alternatives
    assert got[ADMIN].status == "flagged" and got[VETS].status == "needs-input"
    assert got[RTO].status == "flagged" and got[RTO].suggestion.matched_on == ["RTO"]


def test_hybrid_review(spark, chunks):
    got = run(spark, chunks, admin=[0.95, 0.0, 0, 0, 0, 0, 0], vets=[0.0, 0, 0, 0, 0, 0.9, 0], rto=[0.0, 1, 0, 0, 0, 0, 0])
    assert got[ADMIN].status == "auto-filled" and got[ADMIN].suggestion.method == "keyword + semantic"
    assert got[VETS].status == "flagged" and got[VETS].suggestion.method == "semantic" and got[VETS].suggestion.lexical == 0
    assert got[RTO].status == "auto-filled"


def test_bad_vectors_and_empty_library(spark, chunks):
    bad = chunks.withColumn("embedding", F.when(F.col("passage_id") == "doc1", F.array(*[F.lit(float("nan"))] * 7)).when(F.col("passage_id") == "doc2", F.array().cast("array<double>")).otherwise(F.concat("embedding", F.array(F.lit(0.0), F.lit(0.0)))))
    got = run(spark, bad, mfa=[1.0, 0, 0, 0, 0, 0, 0])
    assert got[MFA].status == "auto-filled" and 0 < got[MFA].confidence <= 100
    questions = spark.createDataFrame([("q", MFA, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "query_id string, text string, embedding array<double>")
    (report,) = review.vector_report(questions, bad).collect()
    assert (report.comparable, report.stale, report.without_vector) == (0, 4, 2)
    (none,) = review.reviewed(questions, chunks.limit(0)).collect()
    assert none.status == "needs-input" and none.alternatives is None
    assert review.summary(review.reviewed(questions.limit(0), chunks)).collect()[0].total == 0


def test_tokens(spark):
    # What phrases, synonyms and stems become.
    cases = {"multi-factor authentication": ["mfa"], "is 2FA required": ["mfa", "required"], "encrypted at rest": ["encryption", "atrest"], "SOC 2 Type II report": ["soc2", "report"], "policies": ["policy"], "it's schön": ["sch"], None: []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.x for r in df.select("t", T.tokenize(F.col("t")).alias("x")).collect()}
    assert got == cases | {"is 2FA required": got["is 2FA required"]} and got["is 2FA required"][0] == "mfa"
    (r,) = spark.createDataFrame([(["a", "b", "c", "d"],)], "t array<string>").select(T.runs(F.col("t")).alias("x")).collect()
    assert r.x == ["a b c", "b c d"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [1.0], 0.0), (None, [1.0], 0.0), ([0.0], [1.0], 0.0), ([float("nan")], [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(abs(r.x - r.want) < 1e-12 for r in df.select("want", V.cosine(F.col("a"), F.col("b")).alias("x")).collect())
    read = spark.createDataFrame([("[1, 2.5]",), ("[]",), ("no",), (None,)], "t string").select(V.parsed_vector(F.col("t")).alias("v")).collect()
    assert [r.v for r in read] == [[1.0, 2.5], None, None, None]


def test_bm25_order(spark):
    docs = spark.createDataFrame([("a", 0, "firewall rules and firewall logs"), ("b", 1, "rules of the canteen"), ("c", 2, None)], "passage_id string, ord long, text string")
    q = spark.createDataFrame([("q", "firewall rules"), ("none", "of the")], "query_id string, text string")
    got = [(r.query_id, r.passage_id) for r in lexical.top(lexical.build(docs), q).orderBy("query_id", "place").collect()]
    assert got == [("q", "a"), ("q", "b")]


def test_own_passage_does_not_stand_in_for_its_source(spark):
    rows = [
        ("q100", 0, "qa", "hot", "Hot", "", "alpha", "one", None, [1.0, 0.0]),
        ("q101", 1, "qa", "hot", "Hot", "", "beta", "two", None, [0.9, 0.1]),
        ("q102", 2, "qa", "hot", "Hot", "", "gamma", "three", None, [0.5, 0.5]),
        ("q103", 3, "qa", "cold", "Cold", "", "delta", "four", None, [0.2, 0.8]),
    ]
    asked = spark.createDataFrame([("q100", "alpha", [1.0, 0.0])], "query_id string, text string, embedding array<double>")
    # One partition for all and one for each: the own passage is in the same batch as the rest, or in another.
    for parts in (1, 4):
        c = spark.createDataFrame(rows, CHUNKS).repartition(parts, "ord")
        cands = review.candidates(asked, c)
        assert {r.passage_id for r in cands.collect()} == {"q101", "q103"}
        assert [r.passage_id for r in review.alternatives(cands).orderBy("place").collect()] == ["q101", "q103"]
        assert [r.passage_id for r in review.best_by_kind(cands).collect()] == ["q101"]
        assert {r.passage_id for r in review.semantic_best(asked, c).collect()} == {"q100", "q103"}
