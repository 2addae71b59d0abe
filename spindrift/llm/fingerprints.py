"""I-Match fingerprints of documents: hashes over randomised parts of a lexicon of middling frequency.

Terms are lower-cased words. The lexicon holds the terms whose document frequency lies in a band of shares
of all documents; at most (mean number of distinct terms of a document) / (lower share) terms can reach the
lower share, so the lexicon is bounded however large the corpus is, and may be broadcast.

The lexicon is dealt at random into PARTS parts, and thinned at random to 1/2, 1/4, ... of its terms. For
each part at each thinning the set of distinct terms of a document is hashed. Equal texts have equal
hashes; each edit disturbs only the parts that its terms are in. Two fingerprints are compared at the
strongest thinning at which most parts still hold a term. The hash of a set is that of the sum of its terms' hashes:
like the hash of the sorted list it depends on the distinct terms alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import U64, column, mix, pieces, words

PARTS, LEVELS = 16, 8
LOWER, UPPER = 1e-4, 0.05
#: A term outside the lexicon is taken for one inside with probability (size of the lexicon) / 2**TERM_BITS.
TERM_BITS = 40
FLUSH = 1 << 22
#: Characters of a range of documents that are walked in order, such ranges at most, and documents drawn for each
#: to find where they end.
PLACE_CHARS, PLACES, DRAWS = 4_000_000, 50_000, 16
_HALF = U64(0xFFFFFFFF)


def distinct_terms(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct terms of each text, told apart by TERM_BITS bits, and the number of the text of each."""
    hashes = hashes >> U64(64 - TERM_BITS)
    found = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return (np.concatenate(found) if found else np.zeros(0, U64)), np.repeat(np.arange(len(found)), sizes)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): in how many documents each hashed term occurs. Counted inside tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            terms, df = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            unique, at = np.unique(terms, return_inverse=True)
            return unique, np.bincount(at, df, len(unique)).astype(np.int64)

        for batch in batches:
            for piece in pieces(batch):
                w = words(column(piece, "text"))
                terms, _ = distinct_terms(w.hashes, w.first)
                held.append(np.unique(terms, return_counts=True))
            if sum(len(x[0]) for x in held) > FLUSH:
                held = [merged()]
                if len(held[0][0]) > FLUSH // 2:
                    yield _frequencies(*held.pop())
        if held:
            yield _frequencies(*merged())

    partial = docs.select("text").mapInArrow(run, "term long, df long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


def _frequencies(terms: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], ["term", "df"])


def lexicon(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> np.ndarray:
    """Sorted hashes of the terms whose share of all documents lies in [lower, upper]; see above for its bound.
    In a small corpus it may be empty; fingerprints then take all terms. Null texts have no terms, repeated rows count
    each, columns other than text are ignored."""
    total = docs.count()
    band = document_frequencies(docs).where(F.col("df").between(lower * total, upper * total))
    terms = band.select("term").toArrow().column("term").to_numpy()
    return np.sort(terms.astype(np.int64).view(U64))


def hashes_of(hashes: np.ndarray, first: np.ndarray, lex: np.ndarray) -> np.ndarray:
    """[text, level, part]: 16-bit hashes, 0 for parts without a term. A text with words but no term of the
    lexicon is hashed over all its terms; a text without words has no hash at all."""
    terms, owner = distinct_terms(hashes, first)
    n = len(first) - 1
    if len(lex):
        at = np.searchsorted(lex, terms)
        inside = lex[np.minimum(at, len(lex) - 1)] == terms
    else:
        inside = np.zeros(len(terms), bool)
    none_in = np.ones(n, bool)
    none_in[owner[inside]] = False
    inside |= none_in[owner]
    terms, owner = terms[inside], owner[inside]
    out = np.zeros((n, LEVELS, PARTS), U64)
    draw = mix(terms ^ U64(0x5851F42D4C957F2D))
    value, part = mix(terms + U64(0x14057B7EF767814F)), (draw & U64(PARTS - 1)).astype(np.int64)
    for level in range(LEVELS):
        if level:
            keep = (draw >> U64(8)) & U64((1 << level) - 1) == 0
            value, part, owner, draw = value[keep], part[keep], owner[keep], draw[keep]
        place, sums = owner * PARTS + part, np.zeros(n * PARTS, U64)
        with np.errstate(over="ignore"):
            np.add.at(sums, place, value)
        full = np.zeros(n * PARTS, bool)
        full[place] = True
        out[:, level] = np.where(full, mix(sums) % U64(0xFFFF) + U64(1), U64(0)).reshape(n, PARTS)
    return out.astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal parts, 0 to 1, of fingerprints [text, level, part] at the strongest thinning at which
    three quarters of the parts are filled in either; without thinning if there is none. Two empty
    fingerprints are alike, an empty one is like no other."""
    filled = (a > 0) | (b > 0)
    same = ((a == b) & filled).sum(2)
    count = filled.sum(2)
    enough = count >= PARTS * 3 // 4
    level = np.where(enough.any(1), LEVELS - 1 - np.argmax(enough[:, ::-1], 1), 0)
    row = np.arange(len(a))
    return np.where(count[row, level] > 0, same[row, level] / np.maximum(count[row, level], 1), 1.0)


def _texts(found: np.ndarray) -> list[str]:
    big = found.astype(">u2")
    return [x.tobytes().hex() for x in big]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null is empty. One row per row; ids may be null or repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                w = words(column(piece, "text"))
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array(_texts(hashes_of(w.hashes, w.first, shared.value)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many characters from the start of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(ids: list, texts: list[str], after: list[str], lex: np.ndarray) -> list[pa.Array]:
    """Columns of SCHEMA for texts and the texts that follow them, about a piece at a time."""
    changed = [edited(t, f) for t, f in zip(texts, after, strict=True)]
    prints = []
    for group in (texts, changed, after):
        w = words(pa.array(group, pa.large_string()))
        prints.append(hashes_of(w.hashes, w.first, lex))
    own, new, following = prints
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(_texts(own), pa.string()), pa.array(_texts(new), pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, following)),
    ]


def _keys(ids: pa.Array, ties: pa.Array) -> np.ndarray:
    """Byte strings in the order of (doc_id, tie), null ids first."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = np.asarray(ids.is_valid())
    for k, values in ((1, ids.fill_null(0)), (9, ties)):
        out[:, k : k + 8] = (np.asarray(values).astype(np.int64).view(U64) ^ U64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    # A last byte that is never 0, as numpy takes zeros at the end for padding.
    return np.ascontiguousarray(np.column_stack([out, np.ones(len(ids), np.uint8)])).view("S18").ravel()


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tie, place): consecutive ranges in the order of doc_id and a hash of the text, null ids
    first, with about PLACE_CHARS characters each (more if that made over PLACES ranges).

    The ranges are cut at quantiles of a sample of (doc_id, tie), drawn by a hash with odds by size, DRAWS for
    each range; so ids need not be evenly spread, and rows of one id, or without, are cut by their texts."""
    size = F.length("text") + 1
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    chars = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    places = max(1, min(PLACES, math.ceil(chars / PLACE_CHARS)))
    odds = size * (DRAWS * places / max(1, chars) * (1 << 40))
    drawn = rows.where(F.pmod(F.xxhash64("tie", "doc_id", F.lit("draw")), F.lit(1 << 40)) < odds).select("doc_id", "tie").distinct().toArrow()
    keys = np.sort(_keys(*(drawn.column(c).combine_chunks() for c in ("doc_id", "tie"))))
    shared = docs.sparkSession.sparkContext.broadcast(keys[DRAWS // 2 :: DRAWS])

    @F.arrow_udf("int")
    def place(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, _keys(ids, ties), "right").astype(np.int32))

    return rows.withColumn("place", place("doc_id", "tie"))


def edit_probe(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """How well fingerprints stand an edit: SCHEMA, one row per row of docs (doc_id, text).

    The next document is the next in ascending doc_id, after the last the first; null ids come first, equal
    ids in the order of a hash of their texts. Null text is empty. A single document follows itself.

    Documents are put in consecutive ranges of doc_id and walked in order inside each. The last document of a
    range meets the first of the next one apart from these: only first and last documents of ranges, found by
    an aggregate, travel for that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in pieces(batch):
                ids, texts, places = column(piece, "doc_id").to_pylist(), [t or "" for t in column(piece, "text").to_pylist()], column(piece, "place").to_pylist()
                if held is not None:
                    ids, texts, places = [held[0], *ids], [held[1], *texts], [held[2], *places]
                held = ids[-1], texts[-1], places[-1]
                inner = [k for k in range(len(ids) - 1) if places[k] == places[k + 1]]
                if inner:
                    yield pa.RecordBatch.from_arrays(_compare([ids[k] for k in inner], [texts[k] for k in inner], [texts[k + 1] for k in inner], shared.value), names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays(_compare(column(piece, "doc_id").to_pylist(), column(piece, "text").to_pylist(), column(piece, "after").to_pylist(), shared.value), names)

    placed = _placed(docs)
    in_order = [F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    inner = placed.repartitionByRange("place").sortWithinPartitions(*in_order).mapInArrow(walk, SCHEMA)
    key = F.struct("doc_id", "tie", "text")  # nulls come first
    ends = placed.groupBy("place").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    # One row per range.
    along = Window.partitionBy(F.lit(0)).orderBy("place")
    start = F.first("first.text").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = ends.select(F.col("last.doc_id").alias("doc_id"), F.col("last.text").alias("text"), F.coalesce(F.lead("first.text").over(along), start).alias("after"))
    return inner.unionByName(last.mapInArrow(close, SCHEMA))
