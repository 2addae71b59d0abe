"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Training counts single words exactly and word pairs roughly: a pair seen c times goes into the filter with
the levels 1 to 1 + floor(log2 c). Whoever holds the filter asks for level 1, 2, ... until one is missing,
and takes the middle of the last level's range as the count. A pair that was never seen is found with the
filter's error rate, and a level too high with the square of it.

Neither word counts nor the filter fit into a broadcast for a large corpus. Documents are dealt to batches; the
distinct words and pairs of each batch are counted up across batches in a shuffle on hashes, and each batch
gets back just what it asked for: the counts of its own words, the levels of its own pairs. The filter lies in
segments, as many as the batches need. The task that has counted a segment's pairs fills that segment, sized to
hold them all, and probes it for every batch, so no pair is left out, and no task ever holds more than a segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import written
from ._text import U64, column, mix, pieces, words

#: Hash of the token that ends a text; no word has it but by chance.
END = U64(0x2545F4914F6CDD1D)
#: The filter has 2**SEGMENT_BITS segments at least, and more for a corpus of more than so many batches.
SEGMENT_BITS = 8
BITS_PER_PAIR = 10
PROBES = 2
#: Weight of the pair's share against the word's own.
PAIR_WEIGHT = 0.4
BATCH_CHARS = 8_000_000
_PAIR = U64(0x9E3779B97F4A7C15)


class Filter(NamedTuple):
    """bits: the filter, of 2**segment_bits equal parts of ``span`` bits."""

    bits: np.ndarray
    span: int
    segment_bits: int


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * _PAIR + right)


def _short(pairs: np.ndarray, segment_bits: int) -> np.ndarray:
    """Segment number above the 32 low bits: all that is kept of a pair's hash."""
    return (pairs >> U64(64 - segment_bits)) << U64(32) | (pairs & U64(0xFFFFFFFF))


def _places(short: np.ndarray, level: int, span: int) -> list[np.ndarray]:
    """Bit positions of pairs at a level, inside their segment."""
    with np.errstate(over="ignore"):
        h = mix(short + U64(level) * U64(0xA0761D6478BD642F))
    return [((h >> U64(32 * k)) & U64(0xFFFFFFFF)) % U64(span) for k in range(PROBES)]


def probed_levels(found: Filter, pairs: np.ndarray) -> np.ndarray:
    """Level of each pair: how many levels in a row the filter holds."""
    short = _short(pairs, found.segment_bits)
    return _probed(found.bits, found.span, short, (short >> U64(32)) * U64(found.span))


def _probed(bits: np.ndarray, span: int, short: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Levels of pairs whose segments begin at the bits ``base``."""
    out = np.zeros(len(short), np.int64)
    open_ = np.arange(len(short))
    level = 1
    while len(open_) and level < 50:
        there = np.ones(len(open_), bool)
        for place in _places(short[open_], level, span):
            at = base[open_] + place
            there &= (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        open_ = open_[there]
        out[open_] = level
        level += 1
    return out


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def _filled(short: np.ndarray, top: np.ndarray, span: int) -> np.ndarray:
    """The bits of a segment that holds each pair with the levels 1 to ``top``."""
    bits = np.zeros(span, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        for place in _places(short[top >= level], level, span):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def level_counts(levels: np.ndarray) -> np.ndarray:
    """Counts that levels stand for: 0, 1, then the geometric middle of 2**(k-1) to 2**k."""
    return np.where(levels < 2, levels, 2.0 ** (levels - 0.5))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end behind the words of each text, and where each text's begin."""
    w = words(texts)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(first[-1], END, U64)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    out[inner] = w.hashes
    return out, first


def pairs_of(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the hash of it and the one before; a text's first stands behind an end."""
    left = np.empty_like(found)
    left[1:] = found[:-1]
    left[first[:-1]] = END
    return pair_hashes(left, found)


def _trained(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(column(batch, "train"))


def _pair_parts(batches: Iterator[pa.RecordBatch], segment_bits: int) -> Iterator[pa.RecordBatch]:
    """Counted pairs of a task, a row per segment that has any: 32 bits of each pair and its count."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        unique, at = np.unique(keys, return_inverse=True)
        return unique, np.bincount(at, n, len(unique)).astype(np.uint32)

    def packed() -> pa.RecordBatch:
        keys, n = merged()
        held.clear()
        segment = (keys >> U64(32)).astype(np.int64)
        order = np.lexsort((keys, n > 1, segment))
        keys, n, segment = keys[order], n[order], segment[order]
        there, at = np.unique(segment, return_index=True)
        short, cut = (keys & U64(0xFFFFFFFF)).astype(np.uint32), [*at, len(keys)]
        rows = []
        for s, a, b in zip(there, cut[:-1], cut[1:], strict=True):
            once = a + int(np.count_nonzero(n[a:b] == 1))
            rows.append((s, short[a:once].tobytes(), short[once:b].tobytes(), n[once:b].tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["segment", "once", "more", "counts"])

    for batch in batches:
        batch = _trained(batch)
        for piece in pieces(batch):
            found, first = tokens(column(piece, "text"))
            keys = pairs_of(found, first)
            held.append(np.unique(_short(keys, segment_bits), return_counts=True))
        if sum(len(x[0]) for x in held) > 3_000_000:
            unique, n = merged()
            held[:] = [(unique, n)]
            if len(unique) > 3_000_000:
                yield packed()
    if any(len(x[0]) for x in held):
        yield packed()


def _counted_pairs(parts: Iterator[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for once, more, n in parts:
        keys += [np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)]
        counts += [np.ones(len(once) // 4, np.int64), np.frombuffer(n, np.uint32).astype(np.int64)]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)


def build_filter(docs: DataFrame, max_bits: int | None = None, segment_bits: int = SEGMENT_BITS) -> Filter:
    """The filter of all pairs of the rows with ``train``. docs: text, train. No rows: an empty filter.

    It is gathered in the driver, so it is for tables whose filter fits there; score_documents does without.
    The counted pairs of a segment are written once as a table; from how many pairs reach each level follow
    the filter's size and, if ``max_bits`` is given and it would pass that, the least count that goes in.
    """

    def count(key: tuple, table: pa.Table) -> pa.Table:
        pairs, n = _counted_pairs(zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True))
        levels = _levels(n)
        # For each least level the bits' worth of entries: pairs at or above it, with all their levels.
        entries = [int(levels[levels >= k].sum()) for k in range(1, 41)]
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "pairs": pa.array([pairs.tobytes()], pa.binary()), "levels": pa.array([levels.astype(np.uint8).tobytes()], pa.binary()), "entries": pa.array([entries], pa.list_(pa.int64()))})

    parts = docs.select("text", "train").mapInArrow(lambda batches: _pair_parts(batches, segment_bits), "segment int, once binary, more binary, counts binary")
    counted = written(parts.groupBy("segment").applyInArrow(count, "segment int, pairs binary, levels binary, entries array<long>"))
    totals = counted.select(F.posexplode("entries").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    wanted = [max(1, r["n"]) * BITS_PER_PAIR for r in totals] or [8]
    most = max(wanted) if max_bits is None else max_bits
    least = next((k for k, bits in enumerate(wanted) if bits <= most), len(wanted) - 1)
    span = max(64, math.ceil(min(wanted[least], most) / (1 << segment_bits) / 8) * 8)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, keys, levels in zip(*(column(batch, c).to_pylist() for c in ("segment", "pairs", "levels")), strict=True):
                pairs = np.frombuffer(keys, np.uint32).astype(U64) | U64(segment) << U64(32)
                top = np.frombuffer(levels, np.uint8)
                bits = _filled(pairs[top > least], top[top > least], span)
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["segment", "bits"])

    out = np.zeros((1 << segment_bits) * span // 8, np.uint8)
    for row in counted.select("segment", "pairs", "levels").mapInArrow(fill, "segment int, bits binary").toLocalIterator():
        at = row["segment"] * span // 8
        out[at : at + span // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out, span, segment_bits)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


#: What a batch asks for. Of words: hashes and counts in its training documents. Of pairs, by segment and in 32
#: bits each: those in no training document of the batch (tokens), in one place (once), in more, with counts.
ASKED = "batch long, pairs boolean, bucket int, tokens binary, once binary, more binary, counts binary"
#: Counts of words as int64, in the order asked; levels of pairs as uint8, in the order of the pairs.
REPLIED = "batch long, pairs boolean, bucket int, tokens binary, counts binary, `all` long, `distinct` long"
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.replace("`", "").split(", ")]
    return pa.table([pa.array([r[k] for r in rows], _KINDS[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(np.concatenate([np.zeros(0, U64), *keys]), return_inverse=True)
    return unique, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), len(unique)).astype(np.int64)


def _parts(batches: int) -> tuple[int, int]:
    """Buckets of words, and bits of the segments of pairs, for so many batches: as many as keep what all batches ask of
    one below some 40 MB. A batch puts out a row for each bucket and segment that it asks of, at least one word or pair a
    row, so rows never outgrow what is asked, which follows the text."""
    return max(8, batches // 16), max(SEGMENT_BITS, math.ceil(math.log2(max(1, batches / 8))))


def _batch_asks(batch: int, table: pa.Table, buckets: int, segment_bits: int) -> pa.Table:
    """The distinct tokens and pairs of a batch of documents and their counts in its training documents."""
    words_, pairs_ = ([], []), ([], [])
    for part in table.combine_chunks().to_batches():
        for piece in pieces(part):
            found, first = tokens(column(piece, "text"))
            train = np.repeat(column(piece, "train").to_numpy(zero_copy_only=False), np.diff(first))
            for keys, (held, counts) in ((found, words_), (_short(pairs_of(found, first), segment_bits), pairs_)):
                unique, n = _summed([keys], [train])
                held.append(unique)
                counts.append(n)
    unique, n = _summed(*words_)
    bucket = (unique >> U64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    unique, n = unique[order], n[order].astype(np.uint32)
    rows = [(batch, False, k, unique[a:b].tobytes(), None, None, n[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    unique, n = _summed(*pairs_)
    there, at = np.unique((unique >> U64(32)).astype(np.int64), return_index=True)
    short, n = (unique & U64(0xFFFFFFFF)).astype(np.uint32), n.astype(np.uint32)
    for segment, a, b in zip(there.tolist(), at, [*at[1:], len(unique)], strict=True):
        keys, c = short[a:b], n[a:b]
        rows.append((batch, True, segment, keys[c == 0].tobytes(), keys[c == 1].tobytes(), keys[c > 1].tobytes(), c[c > 1].tobytes()))
    return _table(rows, ASKED)


def _reply(pairs: bool, bucket: int, table: pa.Table) -> pa.Table:
    """Counts over all batches of a bucket's words, or levels of a segment's pairs, for the batches that asked."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    batches, n = table.column("batch").to_pylist(), get("counts", np.uint32)
    if pairs:
        none, once, more = (get(c, np.uint32) for c in ("tokens", "once", "more"))
        base = U64(bucket) << U64(32)
        short, count = _summed([x.astype(U64) | base for x in [*once, *more]], [*(np.ones(len(x), np.int64) for x in once), *n])
        top = _levels(count)
        span = max(64, math.ceil(int(top.sum()) * BITS_PER_PAIR / 64) * 64)
        bits = _filled(short, top, span)
        rows = []
        for batch, *parts in zip(batches, none, once, more, strict=True):
            asked = np.sort(np.concatenate(parts)).astype(U64) | base
            rows.append((batch, True, bucket, None, _probed(bits, span, asked, np.zeros(len(asked), U64)).astype(np.uint8).tobytes(), 0, 0))
        return _table(rows, REPLIED)
    asked = get("tokens", U64)
    unique, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, np.concatenate(n), len(unique)).astype(np.int64)
    cut = np.cumsum([0, *map(len, asked)])
    replies = [total[at[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    every, distinct = int(total.sum()), int(np.count_nonzero(total))
    return _table([(batch, False, bucket, x.tobytes(), r, every, distinct) for batch, x, r in zip(batches, asked, replies, strict=True)], REPLIED)


def score_documents(docs: DataFrame, held_out: Column, pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """SCHEMA for every whole text. docs: doc_id, text; other columns are ignored.

    held_out: a boolean of the documents not to learn from, null counts as false. Null text is empty and has one token, the end.
    ``base_score`` is the sum of log10((c+1)/(N+V+1)) over exact word counts; ``score`` the log10 probability
    of the text if each token comes with probability w * min(1, pairs / count of the word in front) +
    (1 - w) * (c+1)/(N+V+1), pairs from the filter; behind a word never learned the second part alone counts.
    Rows are kept as they are, with null or repeated ids. If nothing can be learned, N and V are 0.
    """
    # The hash of the text keeps rows with one id, or none, from piling up in one batch.
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("train", ~F.col("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("n")).first()
    batches = max(1, math.ceil(size["chars"] / BATCH_CHARS))
    buckets, segment_bits = _parts(batches)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    asked = dealt.groupBy("batch").applyInArrow(lambda key, table: _batch_asks(key[0].as_py(), table, buckets, segment_bits), ASKED)
    replies = written(asked.groupBy("pairs", "bucket").applyInArrow(lambda key, table: _reply(key[0].as_py(), key[1].as_py(), table), REPLIED))
    per = replies.where("not pairs").groupBy("bucket").agg(F.max("all").alias("n"), F.max("distinct").alias("v")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = per["n"] or 0, per["v"] or 0

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        replied = list(zip(*(right.column(c).to_pylist() for c in ("pairs", "bucket", "tokens", "counts")), strict=True))
        known = np.concatenate([np.zeros(0, U64), *(np.frombuffer(t, U64) for pairs, _, t, _ in replied if not pairs)])
        n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c, np.int64) for pairs, _, _, c in replied if not pairs)])
        # Segments in order, and each one's pairs in order: the order of the batch's distinct pairs.
        levels = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(c, np.uint8) for _, c in sorted((k, c) for pairs, k, _, c in replied if pairs))])
        parts = left.combine_chunks().to_batches()
        each = [np.unique(_short(pairs_of(*tokens(column(piece, "text"))), segment_bits)) for part in parts for piece in pieces(part)]
        distinct_pairs = np.unique(np.concatenate([np.zeros(0, U64), *each]))
        if len(distinct_pairs) != len(levels):
            raise ValueError("a batch's texts changed between two reads")
        order = np.argsort(known)
        known, n = known[order], n[order]
        end_count = int(n[np.searchsorted(known, END)]) if len(known) else 0
        out = []
        for batch in parts:
            for piece in pieces(batch):
                found_, first = tokens(column(piece, "text"))
                own, at = np.unique(found_, return_inverse=True)
                c = n[np.searchsorted(known, own)][at]
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[first[:-1]] = end_count
                pairs = level_counts(levels[np.searchsorted(distinct_pairs, _short(pairs_of(found_, first), segment_bits))].astype(np.int64))
                word = (c + 1) / (total + distinct + 1)
                share = np.minimum(1.0, pairs / np.maximum(before, 1))
                p = np.where(before > 0, pair_weight * share + (1 - pair_weight) * word, word)
                at = first[:-1]
                out.append(pa.table({
                    "doc_id": column(piece, "doc_id"), "held_out": column(piece, "held_out"), "n_tokens": pa.array(np.diff(first)),
                    "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(len(at), total, np.int64)),
                    "base_score": pa.array(np.add.reduceat(np.log10(word), at)), "score": pa.array(np.add.reduceat(np.log10(p), at)),
                }))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    texts = dealt.select("batch", "doc_id", "text", "held_out")
    return texts.groupBy("batch").cogroup(replies.select("batch", "pairs", "bucket", "tokens", "counts").groupBy("batch")).applyInArrow(score, SCHEMA)
