import random

from vetloom.llm import endings, truncation

SUBJECTS = ["the guard", "the help desk", "our staff", "the identity administration department"]
VERBS = ["locks", "reads", "retrospectively reconciles", "formally documents"]
OBJECTS = ["the log", "the fire door", "supplementary attestation requirements", "each ticket"]


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)}".capitalize()


def test_tail():
    for text in ("It ends.", "Does it?", "a list (x, y, ...)", "", "AES-256", "Yes.\nPage 3 of 4"):
        assert endings.tail(text)[0] == "whole", text
    for text in ("It goes on…", "It goes on...", "broken �", "one, two,", "entity &quo", "entity &#82", "tag <", "tag </sp", "open (", "see (e.g.", "aux exigences d'"):
        assert endings.tail(text)[0] == "cut", text
    assert endings.tail("It ends\nAnnex B")[0] == "line" and endings.tail("The guard locks")[0] == "open"


def test_lengths():
    sizes = dict(zip(truncation.MEASURES, truncation.lengths('é<"&\n😀')))
    assert sizes == {"characters": 6, "utf8_bytes": 10, "utf16_units": 7, "entities": 18, "json": 6 + 2 + 5 + 11, "crlf": 7}


def test_found_and_limits(spark):
    r = random.Random(4)
    rows, cut = [], set()
    for n in range(1200):
        text = ". ".join(sentence(r) for _ in range(r.randint(1, 6)))
        source = "old" if n % 3 == 0 else "new"
        whole = text + ("." if n % 2 else "")
        if source == "old" and len(text) > 120:
            whole = text[:120]
            if not whole.endswith("."):  # else nothing shows
                cut.add(n)
        if source == "new" and n % 50 == 1:
            if n % 100 != 1:
                whole = text + ", and the identity administra"
                cut.add(n)
            else:
                whole = text + "."
        rows.append((n, source, whole, "x"))
    rows += rows[:5] + [(5000, None, None, "x"), (5001, "old", "", "x"), (5002, "old", "  ", "x"), (5003, "new", "short", "x")]
    df = spark.createDataFrame(rows, "question_id long, source string, text string, record_id string")
    t = truncation.Truncation([("questions", df, "question_id", "text", "source")])
    got = {int(x.record_id) for x in t.found().collect()}
    assert got == cut
    report = {x.source: x for x in t.report().collect()}
    assert (report["old"].limit_size, report["old"].limit_measure) == (120, "characters") and report["new"].limit_size is None
    assert report["old"].truncated == sum(n % 3 == 0 for n in cut)
    empty = truncation.Truncation([("questions", df.limit(0), "question_id", "text", "source")])
    assert empty.found().count() == 0 and empty.report().count() == 0
