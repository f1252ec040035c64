import pytest

from vetloom.sources import records

GOOD = ["1", "Vendor", "Do you?", "Yes", "answered", "50", "2024-02-29"]


def line(**change):
    row = list(GOOD)
    for k, v in change.items():
        row[records.FIELDS.index(k)] = v
    return row


CASES = [
    (",".join(GOOD), ",", None),
    (";".join(line(question_text='"a; ""b"";\r\nc"', confidence="", saved_date="")), ";", None),
    ("|".join(line(answer_text='""')), "|", None),
    ("\t".join(line(vendor="")), None, "column_count"),
    (",".join(line(question_text="one\ntwo")), ",", None),
    (",".join(line(question_text='"open')), ",", "quoting"),
    (",".join(line(question_text='"closed" then')), ",", "quoting"),
    (",".join(line(question_text='in "the" field')), ",", "quoting"),
    (",".join(line(question_text=' "x"')), ",", "quoting"),
    (",".join(line(question_text='"""')), ",", "quoting"),
    (",".join(line(question_text='"""x"""')), ",", None),
    (",".join([*GOOD, ""]), ",", "column_count"),
    (",".join(GOOD[:6]), ",", "column_count"),
    (None, ",", "column_count"),
    ("", ",", "column_count"),
    (",".join(GOOD), ";;", "quoting"),
    (",".join(line(question_number="0")), ",", "value"),
    (",".join(line(question_number="١")), ",", "value"),
    (",".join(line(question_number=" 1")), ",", "value"),
    (",".join(line(question_number="1\n")), ",", "value"),
    (",".join(line(question_number="00012345678901234567")), ",", None),
    (",".join(line(question_text=" \u00a0")), ",", "value"),
    (",".join(line(status="Answered")), ",", "value"),
    (",".join(line(confidence="101")), ",", "value"),
    (",".join(line(confidence="5.0")), ",", "value"),
    (",".join(line(confidence="100")), ",", None),
    (",".join(line(saved_date="2023-02-29")), ",", "value"),
    (",".join(line(saved_date="2024-2-01")), ",", "value"),
    (",".join(line(question_text='"' + 'long ""text"" ' * 20000 + '"')), ",", None),
]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(n, "f", n, sep, rec, "x") for n, (rec, sep, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "line_id long, file_id string, line_no int, delimiter string, record string, reason_before string").cache()


def test_reasons(df):
    got = {r.line_id: r.reason for r in records.rejected(df).collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(CASES) if want}


def test_rows(df):
    got = {r.line_id: r for r in records.loaded(df).collect()}
    assert sorted(got) == [n for n, (_, _, want) in enumerate(CASES) if not want]
    assert got[1].question_text == 'a; "b";\r\nc' and got[1].confidence is None and got[1].saved_date is None
    assert got[0].confidence == 50 and str(got[0].saved_date) == "2024-02-29" and got[2].answer_text == ""
    assert got[4].question_text == "one\ntwo" and got[10].question_text == '"x"' and len(got[28].question_text) == 12 * 20000


def test_empty_and_report(df):
    assert records.rejected(df.limit(0)).count() == 0 and records.loaded(df.limit(0)).count() == 0
    (r,) = records.by_file(df).collect()
    assert (r.records, r.quoting, r.column_count, r["value"]) == (len(CASES), *[sum(c[2] == k for c in CASES) for k in records.REASONS])
