from vetloom.llm import split

TEXTS = [
    "x" * 5000,
    "word " * 4000,
    "a" + " " * 5000 + "b",
    "́" * 3000,
    "x" * 1101,
    "A sentence that ends here. " * 120,
    "\n\n".join("Paragraph number %d is of some length, and it goes on. It ends." % k for k in range(60)),
    "\n".join("row %d | value | other value" % k for k in range(200)),
    "日本" * 2000,
]


def test_pieces_cover_and_keep_the_limit():
    for text in TEXTS:
        body = text.strip(split.SPACE)
        spans = split.piece_spans(body)
        assert len(spans) > 1 and spans[0][0] == 0 and spans[-1][2] == len(body)
        for start, fresh, end in spans:
            assert 0 <= fresh - start <= split.OVERLAP and end - start <= split.LIMIT
        for (_, _, end), (_, fresh, _) in zip(spans, spans[1:]):
            assert fresh >= end and not body[end:fresh].strip(split.SPACE)


def test_boundaries():
    for piece in split.split_text(TEXTS[5]):
        assert piece.startswith("A sentence") and piece.endswith("here.")
    assert all(p.endswith("It ends.") for p in split.split_text(TEXTS[6]))
    assert all(p.startswith("row") and p.endswith("value") for p in split.split_text(TEXTS[7]))
    assert all(p.startswith("word") and p.endswith("word") for p in split.split_text(TEXTS[1]))


def test_defined_results():
    assert split.split_text(None) == [] and split.split_text(" \n") == []
    assert split.split_text(" short ") == [" short "]
    assert split.split_text(" " * 2000 + "x" * 1100) == [" " * 2000 + "x" * 1100]


def test_numbering(spark):
    schema = "id string, source_id string, page int, chunk_index int, chunk_ord int, text string"
    rows = [("c1", "s", 1, 0, 0, TEXTS[5]), ("c2", "s", 2, 1, 1, "short"), ("c2", "s", 2, 1, 1, "short"), ("c3", "s", None, None, 2, TEXTS[0]), ("c4", None, 1, 0, 3, "other"), ("c5", "s", 1, 1, 4, None)]
    df = spark.createDataFrame(rows, schema)
    out = split.split_chunks(df).orderBy("source_id", "chunk_index").collect()
    own = [r for r in out if r.source_id == "s"]
    n1, n3 = len(split.split_text(TEXTS[5])), len(split.split_text(TEXTS[0]))
    assert [r.chunk_id for r in own] == ["c1"] * n1 + ["c2"] + ["c3"] * n3
    assert [r.chunk_index for r in own] == list(range(n1 + 1 + n3))
    assert [(r.chunk_id, r.chunk_index) for r in out if r.source_id == ""] == [("c4", 0)]
    assert {r.chunk_id for r in split.oversized(df).collect()} == {"c1", "c3"}
    assert split.split_chunks(df.limit(0)).count() == 0
