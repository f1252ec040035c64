"""Broken question-answer pairs (problem 5).

An answer is cut into clauses, and a linear-chain conditional random field tags each as answer, refusal, echo, foreign or
unfinished. Its observations compare the clause with the question (runs of words in common, language by character
trigrams), with the vocabulary of the questions at large, with cue words of refusals, and with what the corpus shows
about ends (endings: hidden field limits and places where nothing ends). The share of the answer that each tag covers
then gives the pair's defect.

The field is trained on a bounded sample of pairs (SAMPLE), tagged by seed rules, and on corruptions made of them: the
question in place of the answer, the answer of a pair in another language, an answer cut in its midst, stated refusals.
Everything else covers all pairs: tagging, the vocabulary of the questions, the trigrams of the languages and the
statistics of ends. Vocabulary and trigrams are kept by their share of all questions (or of a language's trigrams), so
what is broadcast is bounded by the shares, not by the data.

Defined results: a null answer, or one without letter or digit, is `empty`; with a null or blank question an answer can be
neither echo nor foreign; null and empty arrays of pairs have no pair; repeated rows of one id are one record; empty
tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .reading import FUNCTION_WORDS
from .truncation import Truncation

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Pairs the classifier is fitted on, rounds and step of the fit, weight decay.
SAMPLE, ROUNDS, STEP, DECAY = 3000, 80, 0.3, 1e-3
#: Log-likelihood by which another language must win, in all and for each trigram.
MARGIN, MARGIN_EACH = 6.0, 0.45
#: Weight of the mean of all languages in the likelihood of a trigram.
SHARED = 0.01
#: Words whose likelihoods a worker remembers, and counts a task gathers before it hands them on.
WORDS, FLUSH = 200_000, 400_000
#: Least share of the questions that a content word occurs in, of a language's trigrams that one must have to be kept.
WORD_SHARE, GRAM_SHARE = 1 / 400, 1e-6
#: Clauses of a longer answer are fitted in stretches of so many; it bounds the padding, no clause is left out.
STRETCH = 40

# Words and phrases that refusals are made of, by language. A strong one is a refusal where no content stands beside it.
STRONG = """
decline | declined | declines | disclose | disclosed | won't comment | no comment | will not comment | refuse | refused | withheld | withhold | reveal
unable to help | unable to answer | unable to provide | unable to share | not able to discuss | not able to share | cannot assist | can't assist | cannot help | cannot answer
cannot share | can't share | cannot provide | cannot discuss | not possible for us | keep quiet | unanswered | rather not | prefer not | nothing can be said | nothing to say | to ourselves | in-house
external eyes | forbid | forbids | not permitted | not allowed to | not authorised | not at liberty | not in a position | signed nda | under nda | leave this blank | in writing
language model | no means to respond | ask someone else | ask us something else | skip this item | pass | classified | company secret | stays between us | not for the public
keine auskunft | nichts sagen | lehnen wir | lehnen eine | antwort ablehnen | verweigern | nicht preisgeben | keine angaben | nicht beantworten | nicht äußern | nicht mitteilen | kein kommentar | geben wir nicht | dürfen wir nicht
refusons | refusé | impossible de communiquer | impossible de répondre | pouvons rien dire | pouvons pas | ne souhaitons pas | pas de commentaire | ne pas répondre | ne divulguons | ne communiquons | aucun commentaire
no podemos responder | no podemos | nos negamos | preferimos no | no hablar | sin comentarios | no estamos autorizados | no divulgamos | no revelamos | no queremos
"""
WEAK = """
sorry | apologies | unfortunately | regret | confidential | counsel | comment | discuss | share | answer | answers | request | topic | details | information | matter | internals | management | secret | sensitive | proprietary
leider | bedauerlicherweise | bedauern | vertraulich | geheim | thema | frage | auskunft | antwort | désolé | malheureusement | confidentiel | sujet | point | détails | répondre
lamentablemente | lo sentimos | confidencial | tema | punto | detalles | responder
"""
# Refusals and answers outside the questions' vocabulary, that the fit starts from.
REFUSALS = """
I'm sorry, we are not able to discuss this. | We won't comment on that information, as it is confidential. | Unfortunately our counsel does not let us reveal these details. | No comment. | We must decline to provide this.
I would rather not say. | Apologies - it is not possible for us to give out this topic. Please ask someone else. | We prefer not to answer questions on this. | That stays in-house. | Information withheld at the request of management.
As a language model I cannot assist with that request. | With regret: nothing can be said about the matter. | Declined. | Leider dürfen wir zu diesem Thema keine Auskunft geben. | Bedauerlicherweise lehnen wir eine Antwort zu dieser Frage ab.
Dazu können wir nichts sagen. | Désolé, nous refusons de répondre sur ce point. | Il nous est impossible de communiquer sur ce sujet. | Malheureusement, nous ne pouvons rien dire sur ces détails.
Lo sentimos, preferimos no hablar de este tema. | Lamentablemente, no podemos responder sobre este punto. | Nos negamos a dar datos sobre estos detalles.
"""
PLAIN = """
All of them, without exception. | We are working on it right now. | Our partner takes care of that. | It is kept for a year. | Only the shift lead may do that. | Yes, annually | See annex C | Not applicable | None to date | 4 hours | Yes, with SSO and MFA
We cannot be reached on public holidays. | Sorry for the late reply: yes. | Unable to log in? | Ausnahmslos alle. | Daran arbeiten wir gerade noch. | Siehe Anlage C | Tous sans exception. | Nous y travaillons encore. | Todos sin excepción. | Se encarga nuestro socio.
"""

_WORD = re.compile(r"[^\W_]+(?:[-'’.][^\W_]+)*")
_CLAUSE = re.compile(r"(?<=[.!?;:…])\s+|[\r\n]+|\s+[-–—]\s+|,\s+(?=(?:but|however|because|so|and|while|aber|doch|denn|und|weil|mais|car|puis|et|pero|porque|luego|y)\b)", re.I)
_SUBSTANCE = re.compile(r"[^\W_]")
# Labels that stand before a repeated question or an empty answer.
LABELS = frozenset("question answer q a frage antwort f réponse r pregunta respuesta p re no nr".split())
#: Who answers speaks of themselves where the question speaks to them; an echo may turn one into the other.
TURNED = {"we": "you", "our": "your", "us": "you", "wir": "sie", "unser": "ihr", "unsere": "ihre", "unseren": "ihren", "uns": "ihnen", "nous": "vous", "notre": "votre", "nos": "vos"}
YES_NO = frozenset("yes no partly ja nein teilweise oui non sí en".split())


def _phrases(text: str) -> list[str]:
    return [p.strip().lower() for line in text.strip().splitlines() for p in line.split("|")]


_STRONG = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in sorted(_phrases(STRONG), key=len, reverse=True)) + r")(?!\w)", re.I)
_WEAK = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in sorted(_phrases(WEAK), key=len, reverse=True)) + r")(?!\w)", re.I)
#: A text without any of these holds no cue: the longest word of each.
_STRONG_KEYS, _WEAK_KEYS = (frozenset(re.split(r"[-']", max(p.split(), key=len))[-1] for p in _phrases(t)) for t in (STRONG, WEAK))
#: Words that cues are made of: beside a cue they are no content.
_CUE_WORDS = frozenset(w for t in (STRONG, WEAK) for p in _phrases(t) for w in p.split())
_STOPS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
LANGS = tuple(FUNCTION_WORDS)


def words(text: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in _WORD.findall(text)]


def _grams(word: str) -> list[str]:
    if any(c.isdigit() for c in word):
        return []
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def counts(pairs: DataFrame) -> tuple[int, dict[str, int], dict[str, dict[str, int]]]:
    """How many questions there are, in how many each content word occurs, and the trigrams of each language, over all of (question, answer).

    A question or an answer counts for a language if its function words show it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kinds, keys = zip(*seen, strict=True) if seen else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "key", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text, asks in ((t, n == 0) for n, c in enumerate(batch.columns) for t in c.to_pylist() if t is not None):
                w = words(text)
                own = set(w)
                if asks:
                    seen["all", ""] += 1
                    seen.update(("word", x) for x in own)
                hits = {k: len(v & own) for k, v in _STOPS.items()}
                best = max(hits, key=hits.get)
                if hits[best] >= 3 and sorted(hits.values())[-2] * 2 <= hits[best]:
                    grams = [(best, g) for x in w for g in _grams(x)]
                    seen.update(grams)
                    seen[f"{best} all", ""] += len(grams)
            if len(seen) > FLUSH:
                yield flush()
        yield flush()

    src = spread(pairs.select(F.col("question").cast("string"), F.col("answer").cast("string")))
    sums = stored(src.mapInArrow(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = {r.kind: r.n for r in sums.filter("key = ''").collect()}  # a row for each language
    n = total.get("all", 0)
    keep = (F.col("kind") == "word") & (F.col("n") >= max(2, n * WORD_SHARE)) & (F.length("key") > 2)
    for k in LANGS:
        keep = keep | ((F.col("kind") == k) & (F.col("n") >= total.get(f"{k} all", 0) * GRAM_SHARE))
    vocabulary: dict[str, int] = {}
    grams: dict[str, dict[str, int]] = {k: {} for k in LANGS}
    for r in sums.filter("key <> ''").filter(keep).collect():
        (vocabulary if r.kind == "word" else grams[r.kind])[r.key] = r.n
    return n, vocabulary, grams


class Languages:
    """Naive Bayes over character trigrams of words."""

    def __init__(self, grams: dict[str, dict[str, int]]):
        count = {k: Counter(grams.get(k, {})) for k in LANGS}
        for k in LANGS:
            for x in _STOPS[k]:
                for g in _grams(x):
                    count[k][g] += 20
        share = {k: {g: n / c.total() for g, n in c.items()} for k, c in count.items()}
        # What a language has never shown counts alike for all, however much text each has: a small share of their mean.
        self.log = {}
        for g in set().union(*count.values()):
            own = [share[k].get(g, 0.0) for k in LANGS]
            self.log[g] = tuple(math.log((1 - SHARED) * x + SHARED * sum(own) / len(own)) for x in own)
        self.known: dict[str, tuple[float, ...]] = {}

    def word(self, w: str) -> tuple[float, ...]:
        """Log-likelihoods of a word by language, and the number of its trigrams; remembered for WORDS words."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= WORDS:
                self.known.clear()
            logs = [self.log[g] for g in _grams(w) if g in self.log]
            got = self.known[w] = (*map(sum, zip(*logs)), float(len(logs))) if logs else (0.0,) * (len(LANGS) + 1)
        return got

    def table(self, ws: list[str]) -> np.ndarray:
        """(words, languages + 1): what word() says of each."""
        return np.array([self.word(w) for w in ws]).reshape(len(ws), len(LANGS) + 1)

    def of(self, ws: list[str]) -> int:
        """The language of a text with function words, or -1."""
        *s, n = self.table(ws).sum(axis=0)
        top = np.sort(s)
        return int(np.argmax(s)) if n and top[-1] - top[-2] > 3 else -1

    @staticmethod
    def other(sums: np.ndarray, sizes: np.ndarray, lang: int) -> np.ndarray:
        """Which of several texts, given by their summed tables and numbers of words that have trigrams, clearly are in another language than this."""
        if lang < 0:
            return np.zeros(len(sums), bool)
        s, n = sums[:, :-1], sums[:, -1]
        return (n > 0) & (s.max(axis=1) - s[:, lang] > np.maximum(np.where(sizes > 1, MARGIN, 2 * MARGIN), MARGIN_EACH * n * 0.5))


def echoed(ws: list[str], question: list[str]) -> np.ndarray:
    """Which words lie in a run of at least three that the question has in the same order."""
    ws, question = ([TURNED.get(w, w) for w in t] for t in (ws, question))
    hit = np.zeros(len(ws), bool)
    if len(question) < 3:
        return hit
    known = set(zip(question, question[1:], question[2:]))
    for i in range(len(ws) - 2):
        if (ws[i], ws[i + 1], ws[i + 2]) in known:
            hit[i : i + 3] = True
    return hit


class Observer:
    """Clauses of a pair and their observations; it holds what was learned from the sample."""

    NAMES = tuple(
        [f"echo{i}" for i in range(5)] + [f"content{i}" for i in range(5)] + [f"strong{i}" for i in range(3)] + [f"weak{i}" for i in range(3)] + [f"size{i}" for i in range(4)]
        + ["foreign", "whole_foreign", "cut", "last", "first", "yes", "digit", "label", "strong_bare", "weak_bare", "echo_pair", "tells", "told", "bias"]
    )
    AT = {n: i for i, n in enumerate(NAMES)}

    def __init__(self, questions: int, vocabulary: dict[str, int], grams: dict[str, dict[str, int]]):
        """What counts() gave."""
        self.languages = Languages(grams)
        stop = frozenset().union(*_STOPS.values())
        self.content = frozenset(w for w, n in vocabulary.items() if n >= max(2, questions * WORD_SHARE) and w not in stop and len(w) > 2)

    def clauses(self, question: str | None, answer: str, cut: bool) -> tuple[list[list[str]], np.ndarray]:
        """The clauses of an answer as words, and their observations; cut tells that the answer's end shows a cut."""
        parts = [(p, words(p)) for p in _CLAUSE.split(answer) if p]
        parts = [(p, w) for p, w in parts if w]
        x = np.zeros((len(parts), len(self.NAMES)), np.float32)
        if not parts:
            return [], x
        q = words(question or "")
        lang = self.languages.of(q) if question else -1
        everything = [v for _, w in parts for v in w]
        size = np.array([len(w) for _, w in parts])
        start = np.cumsum(size) - size
        hit = echoed(everything, q)
        table = self.languages.table(everything)
        echo = np.add.reduceat(hit.astype(float), start) / size
        content = np.add.reduceat(np.fromiter((v in self.content for v in everything), float, len(everything)), start) / size
        loose = {v for w in everything for v in re.split(r"[-'.]", w)}
        strong = np.array([len(_STRONG.findall(p)) for p, _ in parts] if not _STRONG_KEYS.isdisjoint(loose) else [0] * len(parts))
        weak = np.array([len(_WEAK.findall(p)) for p, _ in parts] if not _WEAK_KEYS.isdisjoint(loose) else [0] * len(parts))
        for i in np.flatnonzero(strong + weak):
            content[i] = sum(v in self.content and v not in _CUE_WORDS for v in parts[i][1]) / size[i]
        at, row = self.AT, np.arange(len(parts))
        for name, value, steps in (("echo", echo, (0.01, 0.4, 0.75, 0.95)), ("content", content, (0.01, 0.15, 0.3, 0.5)), ("size", size, (1, 3, 8))):
            x[row, at[f"{name}0"] + np.searchsorted(steps, value)] = 1
        for name, value in (("strong", strong), ("weak", weak)):
            x[row, at[f"{name}0"] + np.minimum(value, 2)] = 1
        told = np.add.reduceat((table[:, -1] > 0).astype(int), start)
        x[:, at["foreign"]] = (size > 1) & self.languages.other(np.add.reduceat(table, start, axis=0), told, lang)
        x[:, at["whole_foreign"]] = self.languages.other(table.sum(axis=0, keepdims=True), told.sum(keepdims=True), lang)[0]
        x[-1, at["cut"]] = cut
        x[-1, at["last"]] = x[0, at["first"]] = 1
        x[:, at["yes"]] = [w[0] in YES_NO for _, w in parts]
        x[:, at["digit"]] = [any(c.isdigit() for c in p) for p, _ in parts]
        x[:, at["label"]] = [all(v in LABELS or v.isdigit() for v in w) for _, w in parts]
        tells = (content >= 0.25) & (content * size > 2.5)  # three words of content
        x[:, at["strong_bare"]] = (strong > 0) & (content < 0.3) & ~tells
        x[:, at["weak_bare"]] = (weak > 1) & (content < 0.3) & ~tells
        x[:, at["echo_pair"]] = (echo > 0.7) & (hit.mean() > 0.7)
        # Beside a clause that tells something, a cue is part of what is told.
        x[:, at["tells"]] = content * size > 1.5
        x[:, at["told"]] = (tells & (echo < 0.5)).any()
        x[:, at["bias"]] = 1
        return [w for _, w in parts], x

    def seed(self, x: np.ndarray) -> np.ndarray:
        """Tags by plain rules, for the clauses the fit starts from."""
        at = self.AT
        tag = np.zeros(len(x), np.int64)
        tag[((x[:, at["strong_bare"]] > 0) | ((x[:, at["weak_bare"]] > 0) & (x[:, at["content0"]] > 0))) & (x[:, at["told"]] == 0)] = REFUSAL
        tag[x[:, at["echo_pair"]] > 0] = ECHO
        tag[x[:, at["whole_foreign"]] > 0] = FOREIGN
        tag[(x[:, at["cut"]] > 0) & (tag == ANSWER)] = UNFINISHED
        return tag


class Field:
    """A linear-chain conditional random field over clause observations."""

    def __init__(self, features: int):
        self.w = np.zeros((features, len(TAGS)))
        self.t = np.zeros((len(TAGS), len(TAGS)))

    @staticmethod
    def _pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = max(map(len, xs))
        x, mask = np.zeros((len(xs), n, xs[0].shape[1])), np.zeros((len(xs), n), bool)
        for i, v in enumerate(xs):
            x[i, : len(v)], mask[i, : len(v)] = v, True
        return x, mask

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray]) -> None:
        x, mask = self._pad(xs)
        y = np.zeros(mask.shape, np.int64)
        for i, v in enumerate(ys):
            y[i, : len(v)] = v
        gold = np.eye(len(TAGS))[y] * mask[..., None]
        both = mask[:, 1:] & mask[:, :-1]
        seen_t = np.einsum("nka,nkb->ab", gold[:, :-1] * both[..., None], gold[:, 1:])
        sw, st = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        n, size = len(xs), x.shape[1]
        for _ in range(ROUNDS):
            e = x @ self.w
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for k in range(1, size):
                m = a[:, k - 1][:, :, None] + self.t[None]
                a[:, k] = np.where(mask[:, k, None], np.logaddexp.reduce(m, axis=1) + e[:, k], a[:, k - 1])
            for k in range(size - 2, -1, -1):
                m = self.t[None] + (e[:, k + 1] + b[:, k + 1])[:, None, :]
                b[:, k] = np.where(mask[:, k + 1, None], np.logaddexp.reduce(m, axis=2), 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            pt = a[:, :-1, :, None] + self.t[None, None] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
            gt = (seen_t - (np.exp(np.minimum(pt, 0)) * both[..., None, None]).sum((0, 1))) / n - DECAY * self.t
            gw = np.einsum("nkf,nka->fa", x, gold - p) / n - DECAY * self.w
            sw += gw * gw
            st += gt * gt
            self.w += STEP * gw / np.sqrt(sw)
            self.t += STEP * gt / np.sqrt(st)

    def tag(self, x: np.ndarray) -> np.ndarray:
        e = x @ self.w
        best, back = e[0], []
        for k in range(1, len(e)):
            m = best[:, None] + self.t
            back.append(m.argmax(0))
            best = m.max(0) + e[k]
        out = [int(best.argmax())]
        for bp in reversed(back):
            out.append(int(bp[out[-1]]))
        return np.array(out[::-1])


def verdict(tags: np.ndarray, clauses: list[list[str]], bare: np.ndarray) -> str | None:
    """The defect by the share of words that each tag covers; an answer without any clause is empty.

    bare says which clauses hold at most one word of the questions' vocabulary: beside a refusal or an echo they add nothing.
    """
    if not clauses:
        return "empty"
    size = np.array([sum(w not in LABELS and not w.isdigit() for w in c) for c in clauses])
    cover = np.bincount(tags, weights=size, minlength=len(TAGS))
    told = size[(tags == ANSWER) & (size >= 3) & ~bare].sum()
    total = max(cover.sum(), 1)
    if cover[FOREIGN] >= 0.5 * total and cover[FOREIGN] > 0:
        return "language"
    if cover[ECHO] >= 0.7 * total and told == 0 and cover[ECHO] > 0 and clauses[0][0] not in YES_NO:
        return "copy"
    if cover[REFUSAL] > 0 and told == 0 and cover[ECHO] < cover[REFUSAL]:
        return "refusal"
    return "truncated" if tags[-1] == UNFINISHED else None


def fitted(sample: list[tuple[str | None, str, bool]], seer: Observer, seed: int = 5) -> Field:
    """The field learned from sampled pairs (question, answer, whether its end shows a cut)."""
    rnd = np.random.default_rng(seed)
    xs, ys = [], []

    def add(question: str | None, answer: str, cut: bool, tag: int | None = None) -> None:
        c, x = seer.clauses(question, answer, cut)
        if len(x):
            y = seer.seed(x) if tag is None else np.full(len(x), tag)
            if tag == UNFINISHED:
                y[:-1] = ANSWER
            for k in range(0, len(x), STRETCH):
                xs.append(x[k : k + STRETCH])
                ys.append(y[k : k + STRETCH])

    pairs = [p for p in sample if p[1] and _SUBSTANCE.search(p[1])]
    lang = [seer.languages.of(words(q or "")) for q, _, _ in pairs]
    refusals, plain = _phrases(REFUSALS), _phrases(PLAIN)
    for n, (q, a, cut) in enumerate(pairs):
        add(q, a, cut)
        kind = n % 8
        if kind == 0 and q:
            add(q, q if n % 16 else f"{q} {q}", False, ECHO)
        elif kind == 1 and len(pairs) > 1:
            k = int(rnd.integers(len(pairs)))
            if lang[k] >= 0 and lang[n] >= 0 and lang[k] != lang[n] and len(words(pairs[k][1])) > 3:
                add(q, pairs[k][1], False, FOREIGN)
        elif kind == 2 and len(a) > 40:
            add(q, a[: int(rnd.integers(20, len(a) - 5))], True, UNFINISHED)
        elif kind == 3:
            add(None, refusals[int(rnd.integers(len(refusals)))], False, REFUSAL)
        elif kind == 4:
            add(None, plain[int(rnd.integers(len(plain)))], False, ANSWER)
    field = Field(len(Observer.NAMES))
    if xs:
        field.fit(xs, ys)
    return field


def pairs_of(questions: DataFrame, entries: DataFrame, statuses: tuple[str, ...] = ("answered", "auto-filled")) -> DataFrame:
    """(table_name, record_id, pair_no, source, question, answer): all pairs of both tables, repeated deliveries once."""
    q = questions.filter(F.col("status").isin(*statuses) & F.col("question_id").isNotNull()).select(
        F.lit("questions").alias("table_name"), F.col("question_id").cast("string").alias("record_id"), F.lit(0).alias("pair_no"), F.col("ingest_source").alias("source"), F.col("question_text").alias("question"), F.col("answer_text").alias("answer")
    )
    e = entries.filter("id is not null").select("id", F.posexplode("qa_data").alias("n", "p"))
    e = e.select(F.lit("kb_entries").alias("table_name"), F.col("id").alias("record_id"), (F.col("n") + 1).alias("pair_no"), F.lit("").alias("source"), F.col("p.text").alias("question"), F.col("p.answer").alias("answer"))
    return q.unionByName(e).dropDuplicates(["table_name", "record_id", "pair_no"])


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(table_name, record_id, pair_no, defect) of each pair that has one."""
    pairs = stored(pairs.withColumn("key", F.concat_ws("/", "table_name", "record_id", F.col("pair_no").cast("string"))))
    ends = Truncation([("answers", pairs.filter("answer is not null"), "key", "answer", "source")], [pairs.select("question")])
    marked = stored(pairs.join(ends.found().select(F.col("record_id").alias("key"), F.lit(True).alias("cut")), "key", "left").withColumn("cut", F.coalesce("cut", F.lit(False))))
    seer = Observer(*counts(pairs))
    sample = marked.select("question", "answer", "cut", F.xxhash64("key").alias("h")).filter("answer is not null").orderBy("h").limit(SAMPLE).collect()
    spark = pairs.sparkSession
    model = spark.sparkContext.broadcast((seer, fitted([(r.question, r.answer, r.cut) for r in sample], seer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seer, field = model.value
        for batch in batches:
            out = []
            for q, a, cut in zip(*(c.to_pylist() for c in batch.columns[3:6]), strict=True):
                clauses, x = seer.clauses(q, a or "", cut)
                out.append(verdict(field.tag(x) if len(x) else np.zeros(0, np.int64), clauses, x[:, Observer.AT["tells"]] == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], ["table_name", "record_id", "pair_no", "defect"])

    asked = marked.select("table_name", "record_id", "pair_no", "question", "answer", "cut")
    asked = spread(asked)  # tagging costs far more than moving
    return asked.mapInArrow(run, "table_name string, record_id string, pair_no int, defect string").filter("defect is not null")
