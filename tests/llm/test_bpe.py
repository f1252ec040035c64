import random

import pytest
from tokenizers import Tokenizer

from vetloom.llm import bpe


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.NumpyBpe(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")


def same(reference, ours, texts):
    ids, n = ours.encode(texts)
    at = 0
    for text, size in zip(texts, n):
        assert ids[at : at + size].tolist() == reference.encode(text or "", add_special_tokens=False).ids, repr(text)
        at += size
    assert at == len(ids)
    assert ours.count(texts).tolist() == n.tolist()


def test_random_texts(reference, ours):
    rnd = random.Random(0)
    some = " \t\n\r\x1c\x85\xa0 abAB'sdmtlrve019½²Ⅷäßéمرحبا日本🧪|<endoftext>..--\0"
    same(reference, ours, ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(3000)])


def test_edges(reference, ours):
    same(reference, ours, [None, "", " ", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000, "a  b", "a \n b", "\0 \0x x"])


def test_forgetting(reference):
    small = bpe.NumpyBpe(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json", max_words=20)
    for k in range(5):
        same(reference, small, [f"some words {k} and {k + 1} more words to forget", "other words"])


def test_rows(spark, ours):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (1, "Hello world")], "doc_id long, text string")
    rows = sorted((r.doc_id, list(r.ids)) for r in bpe.token_ids(df).collect())
    hello = ours.encode(["Hello world"])[0].tolist()
    assert rows == [(1, hello), (1, hello), (2, []), (3, [])]
    assert bpe.token_ids(df.limit(0)).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in bpe.token_counts(df).collect()} == {(1, len(hello)), (2, 0), (3, 0)}
