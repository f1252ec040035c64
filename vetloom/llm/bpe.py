"""Byte-level BPE encoding of whole corpora in numpy (problem 7).

Units (a word with the space before it) of a batch that the worker has not met yet are encoded together: their symbols lie in one flat array, a round
looks up every adjacent pair in the sorted table of pair keys by binary search, and merges in each word all places of
its lowest-ranked pair. Encoded words stay in a bounded table of the worker, so a batch costs little more than
splitting its texts into words.

Defined results: a null or empty text gives an empty array (count 0), strings of special tokens are ordinary text, lone
surrogates cannot occur in Spark strings. Rows are kept one to one; columns other than the key and the text are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("VETLOOM_TOKENIZERS", "/opt/tokenizers")
#: Words a worker remembers before it starts afresh.
MAX_WORDS = 400_000
#: Characters of text that are handled at once.
BATCH_CHARS = 4_000_000
#: Marks a unit without a space before it; a lone surrogate, so no text of Spark holds it.
MARK = "\ud800"

# The public pre-tokenizer pattern of this vocabulary, in general and spelled out for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for themselves, the others follow from U+0100."""
    seen = {b: chr(b) for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    spare = (b for b in range(256) if b not in seen)
    return seen | {b: chr(256 + n) for n, b in enumerate(spare)}


class NumpyBpe:
    """Encoder made from a tokenizer's JSON file; encode() gives flat ids and the number of ids of each text."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        key = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]
        of = byte_symbols()
        self.of_byte = np.array([vocab[of[b]] for b in range(256)], dtype=np.int64)
        self.split = regex.compile(PATTERN.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]")).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall
        self.run = regex.compile(rf"[{WHITE}] ").search
        self.max_words = max_words
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.starts, self.lens, self.vals, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words in order, and how many each has."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        never = np.int64(len(self.ranks))
        while len(sym):
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where((word[:-1] == word[1:]) & (self.keys[at] == key), self.ranks[at], never), never)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, np.diff(np.append(first, len(sym))))
            whole = best == never
            if whole.any():
                done_sym.append(sym[whole])
                done_word.append(word[whole])
            hit = np.flatnonzero((rank == best) & ~whole)
            if len(hit) == 0:
                break
            # In a run such as "aaaa" the pair overlaps itself: every second place counts, from the left.
            begin = np.append(True, np.diff(hit) != 1)
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))) % 2 == 0]
            sym[hit] = self.merged[at[hit]]
            keep = ~whole
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        flat, of = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(of, kind="stable")
        return flat[order].astype(np.int32), np.bincount(of, minlength=len(words))

    def _words(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split)(text)

    def _learn(self, units: list[str]) -> range:
        """Rows of the table for new units, each of which becomes its pre-tokenizer words and then their ids."""
        words = [self._words(u) for u in units]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, count = self.merge([w.encode("utf-8") for ws in words for w in ws])
        count = self._sums(count, sizes)
        n = len(self.row) + len(self.first)
        m = n + len(units)
        while len(self.starts) < m:
            self.starts, self.lens = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.lens, np.zeros_like(self.lens))
        while len(self.vals) < self.used + len(flat):
            self.vals = np.append(self.vals, np.zeros_like(self.vals))
        self.vals[self.used : self.used + len(flat)] = flat
        self.lens[n:m] = count
        self.starts[n:m] = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return range(n, m)

    def _whole(self, text: str) -> bool:
        """Whether white space stands before a space, so that a cut at each space could split a run of white space."""
        return self.run(text) is not None if not text.isascii() else any(x in text for x in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c "))

    def _rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of the texts' units, and how many units each text has.

        A text is cut before each space, which is where the pattern cuts too unless the space stands within a run of
        white space; such a text is cut by the pattern itself. The first unit has no space before it, all others have.
        """
        units: list[str] = []
        firsts: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for n, t in enumerate(texts):
            if not t:
                firsts.append("")
                continue
            if self._whole(t):
                head, *rest = self._words(t)
                cut = [head]
                for w in rest:  # the table knows units by what follows their space
                    cut.append(w[1:] if w[0] == " " else MARK + w)
            else:
                cut = t.split(" ")
            firsts.append(cut[0])
            units += cut[1:]
            sizes[n] = len(cut) - 1
        new, new_first = set(units).difference(self.row), set(firsts).difference(self.first)
        if len(new) + len(new_first) + len(self.row) + len(self.first) > self.max_words:
            self._forget()
            new, new_first = set(units), set(firsts)
        if new_first:
            known = sorted(new_first)
            self.first.update(zip(known, self._learn(known), strict=True))
        if new:
            known = sorted(new)
            self.row.update(zip(known, self._learn([u[1:] if u[:1] == MARK else " " + u for u in known]), strict=True))
        rows = np.fromiter(map(self.row.__getitem__, units), np.int64, len(units))
        start = np.cumsum(sizes) - sizes
        return np.insert(rows, start, np.fromiter(map(self.first.__getitem__, firsts), np.int64, len(firsts))), sizes + 1

    @staticmethod
    def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        end = np.cumsum(sizes)
        return total[end] - total[end - sizes]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        rows, sizes = self._rows(texts)
        lens = self.lens[rows]
        shift = np.repeat(self.starts[rows] - (np.cumsum(lens) - lens), lens)
        return self.vals[shift + np.arange(len(shift))], self._sums(lens, sizes)

    def count(self, texts: list[str | None]) -> np.ndarray:
        rows, sizes = self._rows(texts)
        return self._sums(self.lens[rows], sizes)


_LOADED: dict[str, NumpyBpe] = {}


def encoder(path: str) -> NumpyBpe:
    """The worker's encoder of this file, made once for each Python process."""
    if path not in _LOADED:
        _LOADED[path] = NumpyBpe(path)
    return _LOADED[path]


def _pieces(batch: pa.RecordBatch, most: int = BATCH_CHARS) -> Iterator[tuple[pa.Array, list]]:
    """Parts of a (key, text) batch of about so many characters, a text never being cut."""
    texts, start, size = batch.column(1).to_pylist(), 0, 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield batch.column(0).slice(start, n + 1 - start), texts[start : n + 1]
            start, size = n + 1, 0
    if start < len(texts):
        yield batch.column(0).slice(start), texts[start:]


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids array<int>): one row per input row; an empty array for a null or empty text."""
    path = f"{tokenizer_dir}/{name}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _pieces(batch):
                ids, n = encoder(path).encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys, lists], [key, "ids"])

    src = docs.select(F.col(key), F.col(text).cast("string"))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens long): the number of ids token_ids() would give, without shipping them."""
    path = f"{tokenizer_dir}/{name}.json"
    names = [key, *keep, "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.zeros(0, np.int64)] + [encoder(path).count(texts) for _, texts in _pieces(batch.select([0, 1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.concatenate(n), pa.int64())], names)

    src = docs.select(F.col(key), F.col(text).cast("string"), *keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for i, f in enumerate(src.schema) if i != 1]
    return src.mapInArrow(run, ", ".join([*kinds, "n_tokens long"]))
