import pytest

from vetloom.llm import canonical as cn

NAMES = [("t1", "Identity Lifecycle Policy"), ("t2", "Identity Lifecycle Report"), ("t3", "Database Masking Handbook"), ("t4", "Code Review Procedure"), ("t5", "Code Review Handbook"), ("t6", "Source Escrow Report"), ("t7", "Crisis Communication Policy"), ("t8", "Crisis Communication Procedure"), ("t9", "Travel Equipment Procedure")]
CATEGORIES = [("c1", "Backup Rotation Schedule"), ("c2", "Data Retention Schedule"), ("c3", "Logging Baseline"), ("c4", "Mobile Device Agreement"), ("c5", "Cloud Hosting Agreement")]


@pytest.mark.parametrize(
    "value, ref",
    [
        ("Identity_Lifecycle_Policy_v3.1.pdf", "t1"), ("POLICY - identity lifecycle (1).PDF", "t1"), ("IdentityLifecycleRpt FINAL.docx", "t2"), ("identity lifecyle reprot.txt", "t2"),
        ("DB Masking HB 2024-11.pdf", "t3"), ("Code Rvw HB.png.pdf", "t5"), ("Proc: code review", "t4"), ("crisiscommspooolicy.PDF", "t7"), ("Crisis Comms Proc", "t8"),
        ("Snow Report.pdf", None), ("Jury Duty Policy", None), ("Recipe Procedure", None), ("IMG_2291", None), ("untitled.pdf", None), ("???", None), ("2024-11.pdf", None), ("Identity Lifecycle", None), ("x" * 5000, None),
    ],
)
def test_names(value, ref):
    assert cn.Labels(NAMES).match(value) == ref


@pytest.mark.parametrize("value, ref", [("our B.R.S.", "c1"), ("drs (general)", "c2"), ("MDA 2025", "c4"), ("logging-baselin", "c3"), ("ScheduleDataRetention", "c2"), ("Zoo Agreement", None), ("the x.y.z.", None), ("song sheet / desk move", None)])
def test_categories(value, ref):
    assert cn.Labels(CATEGORIES).match(value) == ref


def test_rows(spark):
    docs = [("d1", "Identity Lifecycle Policy.pdf", "our BRS", "x"), ("d1", "Identity Lifecycle Policy.pdf", "our BRS", "x"), ("d2", "Identity Lifecycle Policy", " ", "x"), ("d3", None, "", "x"), ("d4", "holiday menu", "Logging Baseline", "x"), (None, "Code Review HB", None, "x")]
    df = spark.createDataFrame(docs, "id string, name string, category string, ref_id string")
    ref = spark.createDataFrame([("name", *r) for r in NAMES] + [("category", *r) for r in CATEGORIES], "field string, ref_id string, label string")
    got = sorted(map(tuple, cn.mapped(df, ref).collect()))
    assert got == [("d1", "category", "c1"), ("d1", "name", "t1"), ("d4", "name", "none")]
    assert cn.mapped(df.limit(0), ref).count() == 0
    assert {r.ref_id for r in cn.mapped(df, ref.limit(0)).collect()} == {"none"}


def _all_aligned(labels, value):
    """match() with every label above the least cosine aligned in full."""
    joined = "".join(cn.normalised(value)[0])
    size, own = max(len(joined), 6), cn.grams(cn.normalised(value)[0])
    norm = sum(labels.idf.get(g, labels.plain) ** 2 for g in own) ** 0.5
    costs = []
    for i, w in enumerate(labels.words):
        if sum(x * labels.idf[g] for g in own for j, x in labels.post.get(g, ()) if j == i) / norm >= cn.LEAST_COSINE:
            costs.append((min(cn.alignment(joined, v, 1e9) for v in (w, (w[-1], *w[:-1]))) / size, labels.refs[i]))
    costs.sort()
    lead = min(costs[1][0] - costs[0][0] if len(costs) > 1 else cn.COST, cn.COST) if costs else 0.0
    return costs[0][1] if costs and costs[0][0] <= cn.COST and lead >= cn.LEAD and costs[0][0] - lead <= cn.BALANCE else None


def test_no_label_above_the_floor_is_cut():
    # Eight labels share more of their trigrams with the abbreviated value than the right one does.
    tail = "Access Assessment Form"
    labels = cn.Labels([(f"r{n}", f"{x} {tail}") for n, x in enumerate("Tax Fee Gas Job Pay Ads Oil Law".split())] + [("ok", f"Human Resources {tail}"), ("no", "Travel Policy")])
    value = f"Hmn Rsrcs {tail}"
    assert labels.match(value) == _all_aligned(labels, value) == "ok"
    many = cn.Labels(NAMES + [(f"x{n}", f"{a} {b} {c}") for n, (a, b, c) in enumerate((a, b, c) for a in ("Identity", "Code", "Crisis") for b in ("Retention", "Recovery", "Register") for c in ("Policy", "Report", "Plan"))])
    for value in ("Identity Lifecyle Reprot", "Crss Rcvry Plan", "Code Rgstr Rpt", "Ident Retent Pol", "Snow Report", "Code Review Plan", "Policy Crisis Recovry"):
        assert many.match(value) == _all_aligned(many, value)
