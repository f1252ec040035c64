import random

import numpy as np

from vetloom.llm import pairs as pr

SUBJECTS = ["the guard", "the help desk", "our staff", "the identity administration department"]
VERBS = ["locks", "reads", "retrospectively reconciles", "formally documents"]
OBJECTS = ["the log", "the fire door", "supplementary attestation requirements", "each ticket"]
GERMAN = ["Die Wache sperrt die Tür mit dem Kunden.", "Das Team liest alle Konten und das Log.", "Der Dienst prüft den Plan nach der Schicht."]

QUESTIONS = "question_id long, status string, ingest_source string, question_text string, answer_text string, pair_no int"
ENTRIES = "id string, qa_data array<struct<text:string,answer:string,source:string>>"


def make():
    r = random.Random(2)

    def s():
        return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)}".capitalize() + "."

    def q():
        return f"Do you keep proof that {r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} at night?"

    rows = [[n, "answered", "web", q(), "Yes. " + " ".join(s() for _ in range(r.randint(1, 3)))] for n in range(300)]
    for n in range(300, 340):
        rows.append([n, "answered", "web", f"Sperrt {r.choice(['die Wache', 'das Team', 'der Dienst'])} die Tür mit dem Kunden nach der Schicht?", r.choice(GERMAN)])
    return rows


def test_defects(spark):
    rows = make()
    want = {}
    special = {
        0: (None, "empty"), 1: (" -- ", "empty"), 2: ("___", "empty"), 3: ("Sorry, but we won't comment on this topic.", "refusal"), 4: ("Declined", "refusal"),
        5: ("Die Wache sperrt die Tür mit dem Kunden und das Team liest den Plan.", "language"), 6: ("Yes. The guard locks the fire door, and the identity administra", "truncated"),
        7: ("Yes. The help desk reads the log �", "truncated"), 10: ("Sorry for the late reply: yes, the guard locks the fire door.", None), 11: ("Not applicable", None), 12: ("Not applicable", None),
        13: ("Yes. The guard locks the fire door", None),
    }
    special |= {
        21: ("Thank you for asking, however we must decline to provide these details.", "refusal"), 22: ("Nobody can disclose a password here because the guard locks the fire door and reads the log.", None),
        23: ("Please ask us something else.", "refusal"), 24: ("Yes. " + "The guard locks the fire door, and the help desk reads the log. " * 60, None),
    }
    for n, (answer, defect) in special.items():
        rows[n][4] = answer
        if defect:
            want["questions", str(n), 0] = defect
    for n, form in ((14, "{}"), (15, "Q: {}"), (16, '"{}"')):
        rows[n][4] = form.format(rows[n][3])
        want["questions", str(n), 0] = "copy"
    rows[25][4] = rows[25][3].replace("Do you", "Do we") + " -"
    want["questions", "25", 0] = "copy"
    rows[17][4] = rows[17][3] + " The help desk formally documents each ticket."
    rows += [rows[3], [900, "pending", "web", "Do you?", None]]
    questions = spark.createDataFrame([(*r, 5) for r in rows], QUESTIONS)
    entries = spark.createDataFrame([("k1", [(rows[20][3], rows[20][4], None), ("A question?", None, None)]), ("k2", None), ("k3", []), (None, [("x", None, None)])], ENTRIES)
    want["kb_entries", "k1", 2] = "empty"
    got = {(r.table_name, r.record_id, r.pair_no): r.defect for r in pr.broken_pairs(pr.pairs_of(questions, entries)).collect()}
    assert got == want
    assert pr.broken_pairs(pr.pairs_of(questions.limit(0), entries.limit(0))).count() == 0


def test_field_learns_a_chain():
    rnd = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(200):
        y = np.repeat(rnd.integers(0, 5), rnd.integers(2, 6))
        x = np.eye(5)[np.where(rnd.random(len(y)) < 0.3, rnd.integers(0, 5, len(y)), y)]
        xs.append(x)
        ys.append(y)
    field = pr.Field(5)
    field.fit(xs, ys)
    right = np.mean([(field.tag(x) == y).mean() for x, y in zip(xs, ys)])
    assert right > np.mean([(x.argmax(1) == y).mean() for x, y in zip(xs, ys)]) + 0.05


def test_counts_cover_all_pairs(spark):
    rows = [(f"Who is it that the team of the firm asks for item{n % 3}?", "The plan is with the owner of the list." if n % 2 else None) for n in range(900)] + [(None, "Das ist der Plan für den Kunden mit der Liste.")] * 3
    n, vocabulary, grams = pr.counts(spark.createDataFrame(rows, "question string, answer string"))
    assert n == 900 and vocabulary["team"] == 900 and vocabulary["item1"] == 300 and "plan" not in vocabulary
    assert grams["en"][" te"] == 900 and grams["en"][" ow"] == 450 and grams["de"][" ku"] == 3
    assert pr.counts(spark.createDataFrame([], "question string, answer string"))[0] == 0
