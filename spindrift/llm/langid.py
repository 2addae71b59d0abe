"""Language identification of mixed text: spans by Viterbi over words, the document by its spans.

A word has a score in every language: the log-likelihood of its byte trigrams and of the word itself, both
hashed into tables of fixed size. The scripts of its letters narrow the languages it may be in. Viterbi
finds the labelling of all words of a text with the best sum of scores, less a penalty for each switch of
language, so a span of several foreign words is labelled as foreign and a stray word is not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import PUNCTUATION, U64, Words, column, mix, pieces, words

TRIGRAMS, WORDS = 1 << 16, 1 << 17
#: Labelled documents that the tables are counted from, about, at most, and as many of each language as of any
#: other as far as it has them; LEAST of each, however many languages there are.
SAMPLE, LEAST = 20_000, 50
#: Tables of more languages than this hold only what was seen.
DENSE = 64
SWITCH, FLOOR = 12.0, 6.0
SLICE_BYTES, PIECE_BYTES = 2 << 20, 1 << 18
#: Where the code points of a script begin (public Unicode block ranges); "-" has no letters of one script.
SCRIPTS = [
    (0x0, "-"), (0x41, "Latin"), (0x5B, "-"), (0x61, "Latin"), (0x7B, "-"), (0xAA, "Latin"), (0xAB, "-"), (0xB5, "Latin"), (0xB6, "-"), (0xC0, "Latin"), (0xD7, "-"), (0xD8, "Latin"), (0xF7, "-"), (0xF8, "Latin"),
    (0x2B0, "-"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "-"), (0x2C00, "Other"), (0x3000, "-"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "-"), (0xF900, "Han"), (0xFB00, "Other"), (0xFE00, "-"), (0xFE70, "Arabic"), (0xFF00, "-"), (0x10000, "Other"),
]
_NAMES = sorted({s for _, s in SCRIPTS} - {"-"})
_BEGINS = np.array([b for b, _ in SCRIPTS])
_CODES = np.array([_NAMES.index(s) if s != "-" else -1 for _, s in SCRIPTS])
#: Beyond this code point there are no letters.
_LAST = 0x33480


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    """Script of each code point that is a letter, by the script that its range has; -1 for all others, such as
    digits, signs and pictures, also inside such a range."""
    points = np.arange(_LAST)
    script = _CODES[np.searchsorted(_BEGINS, points, "right") - 1]
    script[[c for c in range(_LAST) if not chr(c).isalpha()]] = -1
    return script


@dataclass
class Table:
    """Log-likelihoods of features by language: of one never seen (base), and what seen ones have more, in the order
    of features, those of feature f at begin[f]:begin[f+1]; or all of them as rows[feature, language]."""

    base: np.ndarray
    begin: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    rows: np.ndarray | None = None

    def sums(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[k, language]: sums over the features first[k]:first[k+1], of which there is at least one."""
        if self.rows is not None:
            return np.add.reduceat(self.rows[features], first[:-1], 0)
        n, languages, size = len(first) - 1, len(self.base), np.diff(first)
        there = self.begin[features + 1] - self.begin[features]
        at = np.repeat(self.begin[features] - (np.cumsum(there) - there), there) + np.arange(there.sum())
        owner = np.repeat(np.repeat(np.arange(n), size), there)
        seen = np.bincount(owner * languages + self.language[at], self.gain[at], n * languages).reshape(n, languages)
        return (seen + size[:, None] * self.base).astype(np.float32)


def make_table(feature: np.ndarray, language: np.ndarray, n: np.ndarray, features: int, languages: int, add: float, dense: bool) -> Table:
    """From counts n of (feature, language), each pair once; ``add`` is added to every count."""
    total = np.bincount(language, n, languages) + add * features
    base = np.log(add / total)
    order = np.argsort(feature, kind="stable")
    begin = np.searchsorted(feature[order], np.arange(features + 1))
    table = Table(base, begin, language[order], np.log((n[order] + add) / add).astype(np.float32))
    if dense:
        counts = np.zeros((features, languages))
        counts[feature, language] = n
        table = Table(base, begin[:1], language[:0], table.gain[:0], np.log((counts + add) / total).astype(np.float32))
    return table


@dataclass
class Model:
    """languages in code-point order; trigrams and words: log-likelihoods by bucket and language;
    scripts[script, language]: whether a language may have words in a script; commonest: the one with most texts."""

    languages: list[str]
    trigrams: Table
    words: Table
    scripts: np.ndarray
    commonest: int


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case, for ASCII and the two-byte letters from U+00C0."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 32
    return out


def _features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words in a row, where each word's begin, word buckets, and a script per word
    (that of its first letter; -1 without letters). A word of n bytes has n trigrams, edges marked by 0."""
    low = _lowered(w.data)
    n, length = len(w.starts), w.ends - w.starts
    first = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(first[-1]) + np.repeat(w.starts - first[:-1], length)
    middle = low[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
    before, after = np.zeros_like(middle), np.zeros_like(middle)
    before[1:], after[:-1] = middle[:-1], middle[1:]
    if n:
        before[first[:-1]] = 0
        after[first[1:] - 1] = 0
    tri = ((before * 0x9E3B + middle * 0x85EB + after * 0xC2B3) ^ (before << 7) ^ (after << 3)) & (TRIGRAMS - 1)
    with np.errstate(over="ignore"):
        word = (w.hashes >> U64(20)).astype(np.int64) & (WORDS - 1)
    # Code points at the bytes that begin one, and the first of them in each word that is a letter.
    lead = middle.copy()
    raw = w.data[at].astype(np.int64) if len(at) else middle
    next1 = np.append(raw[1:], 0)
    next2 = np.append(raw[2:], [0, 0]) if len(raw) > 1 else np.zeros_like(raw)
    next3 = np.append(raw[3:], [0, 0, 0]) if len(raw) > 2 else np.zeros_like(raw)
    three = (raw & 15) << 12 | (next1 & 63) << 6 | next2 & 63
    four = (raw & 7) << 18 | (next1 & 63) << 12 | (next2 & 63) << 6 | next3 & 63
    lead = np.where(raw < 0x80, raw, np.where(raw >= 0xF0, four, np.where(raw >= 0xE0, three, np.where(raw >= 0xC0, (raw & 31) << 6 | next1 & 63, 0))))
    script = _scripts()[np.minimum(lead, _LAST - 1)]
    letters = np.flatnonzero(script >= 0)
    own = np.searchsorted(first, letters, "right") - 1
    per_word = np.full(n, -1)
    per_word[own[::-1]] = script[letters[::-1]]
    return tri, first, word, per_word


def _sampled(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """About ``sample`` of the rows, kept by a hash of the text: all of rare languages, an equal number of others."""
    left, least = sample, LEAST
    for k, n in enumerate(sorted(counts.values())):
        least = max(LEAST, left // (len(counts) - k))
        if n > least:
            break
        left -= n
    shares = [(x, math.ceil(min(1.0, least / n) * (1 << 30))) for x, n in counts.items()]
    shares_ = rows.sparkSession.createDataFrame(shares, "lang string, _share long")
    kept = rows.join(F.broadcast(shares_), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("_share"))
    return kept.select("text", "lang")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Tables of all languages of labelled texts; rows with a null in either are not used.

    Counted from whole texts, from about ``sample`` of them if there are more. No rows: no language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(counts.values()) > sample:
        rows = _sampled(rows, counts, sample)
    languages = sorted(counts)
    place = {x: i for i, x in enumerate(languages)}
    width = TRIGRAMS + WORDS + len(_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([x[1] for x in held]), len(keys)).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array(keys % width), pa.array(n)], ["language", "feature", "n"])

        for batch in batches:
            for piece in pieces(batch, size=PIECE_BYTES):
                w = words(column(piece, "text"), PUNCTUATION)
                tri, first, word, script = _features(w)
                of_word = np.array([place[x] for x in column(piece, "lang").to_pylist()], np.int64)[w.owners()] * width
                lettered = script >= 0
                found = [np.repeat(of_word, np.diff(first)) + tri, of_word + TRIGRAMS + word, (of_word + TRIGRAMS + WORDS + script)[lettered]]
                held.append(np.unique(np.concatenate(found), return_counts=True))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield out()
        if held:
            yield out()

    counted = rows.mapInArrow(count, "language int, feature long, n long").groupBy("language", "feature").agg(F.sum("n").alias("n")).toArrow()
    feature, language, n = (counted.column(c).to_numpy() for c in ("feature", "language", "n"))
    many = max(1, len(languages))

    def part(begin: int, size: int, add: float) -> Table:
        own = (feature >= begin) & (feature < begin + size)
        return make_table(feature[own] - begin, language[own], n[own], size, many, add, many <= DENSE)

    script, own = np.zeros((len(_NAMES), many)), feature >= TRIGRAMS + WORDS
    script[feature[own] - TRIGRAMS - WORDS, language[own]] = n[own]
    share = script / np.maximum(script.sum(0), 1)
    commonest = max(range(len(languages)), key=lambda k: counts[languages[k]], default=0)
    return Model(languages, part(0, TRIGRAMS, 0.05), part(TRIGRAMS, WORDS, 0.02), share >= 0.002, commonest)


def word_scores(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """[word, language]: scores, at most 0 and at least -FLOOR, and the number of bytes of each word that has
    letters (else 0). Words without letters, and words in a script that no language uses, score 0 everywhere."""
    tri, first, word, script = _features(w)
    n, languages = len(word), len(model.languages)
    if n == 0:
        return np.zeros((0, languages), np.float32), np.zeros(0, np.int64)
    scores = model.trigrams.sums(tri, first) * np.float32(0.5) + model.words.sums(word, np.arange(n + 1)) * np.float32(0.7)
    allowed = model.scripts[script] & (script >= 0)[:, None]
    some = allowed.any(1)
    scores[~allowed] = -np.inf
    scores[~some] = 0
    scores = np.maximum(scores - scores.max(1, keepdims=True), np.float32(-FLOOR))
    return scores, np.where(script >= 0, w.ends - w.starts, 0)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word of all texts: first[i]:first[i+1] are text i's rows of scores.

    All texts advance together by one word at a time, the longest first, so that each step is a few array
    operations. Ties keep the language, else the first in order.
    """
    n, languages = scores.shape
    out = np.zeros(n, np.int32)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    if n == 0 or languages == 1:
        return out
    best = np.zeros((len(order), languages), np.float32)
    came = np.zeros(n, np.int32)
    stayed = np.zeros((n, languages), bool)
    alive = len(order) - np.searchsorted(length[::-1], np.arange(length[0]), "right")
    for t in range(length[0]):
        m = alive[t]
        at, v = begin[:m] + t, best[:m]
        if t:
            top = v.argmax(1)
            change = v[np.arange(m), top] - np.float32(switch)
            keep = v >= change[:, None]
            came[at], stayed[at] = top, keep
            v = np.where(keep, v, change[:, None])
        v = v + scores[at]
        best[:m] = v - v.max(1, keepdims=True)
    now = best.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        out[at] = now[:m]
        if t:
            now[:m] = np.where(stayed[at, now[:m]], now[:m], came[at])
    return out


def label(model: Model, batch: pa.RecordBatch, switch: float = SWITCH) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Language, score and spans (first byte, last byte + 1, language) of each text of a batch. Scores are
    made for a piece of the batch at a time; only they are held for all of it."""
    n = batch.num_rows
    if not model.languages:
        return ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    parts, words_in, begins, ends = [], [0], [], []
    for piece in pieces(batch, size=PIECE_BYTES):
        w = words(column(piece, "text"), PUNCTUATION)
        parts.append(word_scores(model, w))
        base = w.texts[w.owners()]
        begins.append((w.starts - base).astype(np.int32))
        ends.append((w.ends - base).astype(np.int32))
        words_in += np.diff(w.first).tolist()
    scores, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    begin, end, first = np.concatenate(begins), np.concatenate(ends), np.cumsum(words_in)
    del parts, begins, ends
    path = viterbi(scores, first, switch)
    owner, languages = np.repeat(np.arange(n), np.diff(first)), len(model.languages)
    letters = np.bincount(owner * languages + path, size, n * languages).reshape(n, languages)
    top = letters.argmax(1)
    total = letters.sum(1)
    sums = np.zeros((n, languages))
    for k in range(languages):
        sums[:, k] = np.bincount(owner[size > 0], scores[size > 0, k], n)
    sure = 1 / np.exp(np.clip(sums - sums[np.arange(n), top][:, None], -50, 50)).sum(1)
    share = letters[np.arange(n), top] / np.maximum(total, 1)
    names = [model.languages[k] if t else "und" for k, t in zip(top, total, strict=True)]
    texts = column(batch, "text")
    for i in np.flatnonzero(total == 0):
        # Letters outside the table of scripts still make a text one of some language: the commonest.
        if any(c.isalpha() for c in texts[int(i)].as_py() or ""):
            names[i], sure[i], share[i] = model.languages[model.commonest], 1 / languages, 1.0
    turn = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])]) if len(path) else np.zeros(0, int)
    spans: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
    for a, b in zip(turn, np.append(turn[1:], len(path)), strict=True):
        spans[owner[a]].append((int(begin[a]), int(end[b - 1]), model.languages[path[a]]))
    score = np.where([x == "und" for x in names], 0.0, np.clip(share * np.minimum(sure, 1.0), 0, 1))
    return names, score, spans


SPANS = "doc_id long, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, keep: list[str] | None = None) -> DataFrame:
    """Language of every whole text: (doc_id, lang_pred, score, spans), and the columns named in ``keep``.

    Only the text is looked at. ``und`` and score 0 for null, empty and letterless texts. ``lang_pred`` is
    the language with the most bytes in its spans (of equal ones the first by name); ``score`` is its share
    of them times the probability that the text as a whole is in it. Spans count bytes of UTF-8. Rows are
    kept, with null and repeated ids; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep and f.name != "doc_id")
    others = [f.name for f in docs.schema if f.name in keep and f.name != "doc_id"]
    sources = ["doc_id", *others, *(["text"] if "text" not in others else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            # Scores are dense, so slices are smaller with many languages.
            for piece in pieces(batch, size=SLICE_BYTES * DENSE // max(DENSE, len(shared.value.languages))):
                names, score, spans = label(shared.value, piece, switch)
                rows = pa.array([[{"begin": a, "end": b, "lang": x} for a, b, x in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array(names, pa.string()), pa.array(score), rows, *(column(piece, x) for x in others)], ["doc_id", "lang_pred", "score", "spans", *others])

    return docs.select(*sources).mapInArrow(run, SPANS + (", " + kept if kept else ""))


def predict(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learns from the documents that are not held out and labels all: (doc_id, held_out, lang_pred, score).
    A null ``held_out`` counts as false."""
    out = F.coalesce(held_out, F.lit(False))
    model = train(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
