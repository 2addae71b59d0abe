"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets.

Two sets of sizes a and b that are similar enough differ in at most H = floor((a + b) (1 - s) / (1 + s))
tokens. Tokens are hashed into m segments, m fixed by the size band of the larger set. If the segments
together may differ in H places and the options taken for them (skipped: 0, equal: 1, equal up to one
deletion: 2) add up to more than H, at least one option holds. So each set is

- indexed in its own band: the hash of every segment, and for some segments the hashes of the segment with
  one token left out (the one-deletion neighbourhood);
- probed in its own band and the next larger one: it buys just H + 1 from the segments where agreement by
  chance is least likely, that is, it skips empty and nearly empty segments, which half of a band shares.

Equal sets are joined first and count once. Sets that share a signature are a group; all groups with the same
least id meet in one task, with their sets, which verifies them and puts out a spanning forest of the links it
finds, never the pairs. Groups too large for a task are first tried against that least id alone; what then
still falls into several components is cut into blocks, and a task takes two of them. Number of links: a link
lies inside a component, so each component's sets are compared in blocks, and a task puts out a count per set.

Tokens are 64-bit hashes of n-grams. Two sets of a and b tokens get a wrong intersection with odds of
a * b / 2 ** 64: one in 10 ** 13 for sets of 1,000 tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._compare import linked, overlap, spanning
from ._stage import written
from ._text import U64, Words, column, mix, pieces, release, words

N, SIMILAR = 5, (80, 100)
#: Sizes below EACH have bands of their own; above, a band ends at a quarter more than its beginning.
EACH = 24
#: Segments more than needed, as a share, so that poor ones can be skipped.
SPARE = 0.08
BUCKET_BYTES = 6_000_000
#: Bytes of sets, and sets, in one block of a large group; a task holds two blocks.
BLOCK_BYTES, BLOCK = 4_000_000, 4000
#: A signature that so many sets of one task share leaves that task as rows instead of in its bucket.
HOT = 200
#: Ids broadcast at most; beyond that they are joined by a shuffle.
FEW = 1_000_000


def _ends() -> np.ndarray:
    out = list(range(1, EACH + 1))
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4)
    return np.array(out)


#: Band k holds the sizes ENDS[k] <= size < ENDS[k + 1].
ENDS = _ends()


def most_apart(sizes: np.ndarray | int, similar: tuple[int, int] = SIMILAR) -> np.ndarray | int:
    """In how many tokens two similar sets whose sizes add up to ``sizes`` differ at most."""
    s, of = similar
    return sizes * (of - s) // (of + s)


def segments_of_band(band: int, similar: tuple[int, int] = SIMILAR) -> tuple[int, int]:
    """Segments of a band, and how many of them are indexed with their one-deletion neighbourhoods."""
    apart = int(most_apart(2 * (int(ENDS[band + 1]) - 1), similar))
    m = math.ceil((apart + 1) * (1 + SPARE)) + 1
    return m, min(m, 8 + m // 64)


def shingles(w: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word n-grams of each text, sorted, and where each text's begin. A text with
    fewer words is one n-gram as a whole; one without words has none."""
    out, sizes = [], np.zeros(len(w.first) - 1, np.int64)
    h = w.hashes
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(h) - n + 1), U64)
        for k in range(n):
            whole = mix(whole * U64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]) if len(whole) else whole
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b - a >= n:
                found = np.unique(whole[a : b - n + 1])
            elif b > a:
                found = np.zeros(1, U64)
                for x in h[a:b]:
                    found = mix(found * U64(0x94D049BB133111EB) + x + U64(b - a))
            else:
                found = np.zeros(0, U64)
            out.append(found)
            sizes[i] = len(found)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens).sum(dtype=U64), mix(tokens ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def signatures(tokens: np.ndarray, similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set (distinct tokens), and for each whether it is probed; the others are only indexed.

    A probed signature finds all indexed and probed ones with its value.
    """
    size = len(tokens)
    s, of = similar
    largest = size * of // s
    own = int(np.searchsorted(ENDS, size, "right")) - 1
    found, probed = [], []
    for band in range(own, int(np.searchsorted(ENDS, largest, "right"))):
        m, near = segments_of_band(band, similar)
        top = min(largest, int(ENDS[band + 1]) - 1)
        needed = int(most_apart(size + top, similar)) + 1
        with np.errstate(over="ignore"):
            segment = (mix(tokens + U64(0x632BE59BD9B4E019)) % U64(m)).astype(np.int64)
            value = mix(tokens ^ U64(band * 0x9E3779B1))
            sums = np.zeros(m, U64)
            np.add.at(sums, segment, value)
            count = np.bincount(segment, minlength=m)
            tag = mix(np.arange(m, dtype=U64) + U64(band << 32))
            equal = mix(sums + tag)
            # One token left out, for the first ``near`` segments.
            inner = segment < near
            left_out = mix(sums[segment[inner]] - value[inner] + tag[segment[inner]])
        # What is bought: first equality, then deletion on top, where a segment says most; chance agreement
        # falls with the number of tokens.
        worth = np.concatenate([count.astype(float), count[:near] - 1.5])
        order = np.argsort(-worth, kind="stable")[:needed]
        bought = np.zeros(m + near, bool)
        bought[order] = True
        # A deletion bought without its equality would count twice for nothing.
        bought[:near] |= bought[m:]
        if band == own:
            found += [equal, left_out]
            probed += [bought[:m], bought[m:][segment[inner]]]
        else:
            found += [equal[bought[:m]], left_out[bought[m:][segment[inner]]]]
            probed += [np.ones(len(found[-2]), bool), np.ones(len(found[-1]), bool)]
    return np.concatenate(found), np.concatenate(probed)


def links(a: np.ndarray, b: np.ndarray, similar: tuple[int, int] = SIMILAR) -> bool:
    both = overlap(a, b) if len(a) <= len(b) else overlap(b, a)
    return both > 0 and similar[1] * both >= similar[0] * (len(a) + len(b) - both)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, key1, key2) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                tokens, first = shingles(words(column(piece, "text")), n)
                keys = [set_key(tokens[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array(np.diff(first)), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["doc_id", "size", "key1", "key2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, key1 long, key2 long")


def _rows(bucket: np.ndarray, signatures: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([x.tobytes() for x in signatures], pa.binary()), pa.array([x.tobytes() for x in owners], pa.binary())], ["bucket", "signatures", "owners"])


def _signed(reps: DataFrame, n: int, similar: tuple[int, int], buckets: int) -> DataFrame:
    """Packed (signature, 2 * id + probed) of all sets, dealt by signature: a row holds what one task has for
    one bucket. Signatures shared by HOT sets or more in a task come as (group, id) in rows of buckets below
    0, and as one mark (owner -1) in their bucket, so that no bucket gathers all sets of a large group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def packed() -> Iterator[pa.RecordBatch]:
            sig, owner = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            order = np.argsort(sig, kind="stable")
            sig, owner = sig[order], owner[order]
            begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[begin, len(sig)])
            if size.max() >= HOT:
                hot = size >= HOT
                rows = np.repeat(hot, size)
                # Its bucket only hears that the signature is hot.
                names, members = mix(sig[rows]), owner[rows] >> 1
                # Dealt by group and member over as many buckets of their own.
                apart = ((names ^ mix(members.astype(U64))) % U64(buckets)).astype(np.int64)
                there = np.unique(apart)
                yield _rows(-1 - there, [names[apart == k] for k in there], [members[apart == k] for k in there])
                sig, owner = np.concatenate([sig[~rows], sig[begin[hot]]]), np.concatenate([owner[~rows], np.full(hot.sum(), -1)])
            bucket = ((sig >> U64(33)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            there, at = np.unique(bucket[order], return_index=True)
            cut = [*at.tolist(), len(order)]
            sig, owner = sig[order], owner[order]
            yield _rows(there, [sig[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], [owner[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])

        for batch in batches:
            for piece in pieces(batch):
                tokens, first = shingles(words(column(piece, "text")), n)
                ids = column(piece, "id").to_numpy()
                for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    if b > a:
                        sig, probed = signatures(tokens[a:b], similar)
                        # The lowest bit of the owner says whether the signature is probed.
                        held.append((sig, np.int64(ids[i]) * 2 + probed))
                        total += len(sig)
                if total > 400_000:
                    yield from packed()
                    total = 0
        if held:
            yield from packed()

    return reps.select("id", "text").mapInArrow(run, "bucket long, signatures binary, owners binary")


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Groups of two or more sets with a signature of this bucket in common, one of them probing: (grp, id).
    Buckets below 0 hold members of large groups that need no search."""
    if key[0].as_py() < 0:
        return pa.table({"grp": pa.array(np.concatenate([np.frombuffer(x, np.int64) for x in table.column("signatures").to_pylist()])), "id": pa.array(np.concatenate([np.frombuffer(x, np.int64) for x in table.column("owners").to_pylist()]))})
    sig = np.concatenate([np.frombuffer(x, U64) for x in table.column("signatures").to_pylist()])
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("owners").to_pylist()])
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    ident, probed = owner >> 1, owner & 1
    new = np.r_[True, sig[1:] != sig[:-1]]
    begin = np.flatnonzero(new)
    some = np.maximum.reduceat(probed, begin) > 0
    hot = ident[begin] < 0
    several = np.minimum.reduceat(ident, begin) != np.maximum.reduceat(ident, begin)
    take, marked = (np.repeat(x, np.diff(np.r_[begin, len(sig)])) for x in (some & several, hot))
    take &= ident >= 0
    sig, ident, marked = sig[take], ident[take], marked[take]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1])] if len(sig) else np.zeros(0, bool)
    sig, ident, marked = sig[keep], ident[keep], marked[keep]
    # Groups of the same members are one group.
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix(ident.astype(U64) + U64(1)), begin) if len(begin) else np.zeros(0, U64)
    if len(begin):
        name = np.where(marked[begin], mix(sig[begin]), name)
    size = np.diff(np.r_[begin, len(sig)])
    _, first = np.unique(name, return_index=True)
    chosen = np.zeros(len(begin), bool)
    chosen[first] = True
    rows = np.repeat(chosen, size)
    return pa.table({"grp": pa.array(np.repeat(name, size)[rows].view(np.int64)), "id": pa.array(ident[rows])})


def _contents(texts: DataFrame, n: int) -> DataFrame:
    """(id, key1, key2, size, tokens): the sorted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                tokens, first = shingles(words(column(piece, "text")), n)
                parts = [tokens[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                keys = [set_key(x) for x in parts]
                yield pa.RecordBatch.from_arrays([column(piece, "id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(np.diff(first)), pa.array([x.tobytes() for x in parts], pa.binary())], ["id", "key1", "key2", "size", "tokens"])

    return texts.select("id", "text").mapInArrow(run, "id long, key1 long, key2 long, size long, tokens binary")


def _cut(members: DataFrame) -> DataFrame:
    """members (grp, id, key1, key2, size, ...) with ``parts``, the blocks of the group, and ``block``, the member's own."""
    full = F.greatest(F.ceil(F.sum("size") * 8 / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK))
    large = written(members.groupBy("grp").agg(full.alias("parts")).where("parts > 1"))
    cut = members.join(large, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return cut.withColumn("block", F.pmod(F.xxhash64("key1", "key2"), "parts"))


def _met(cut: DataFrame, sets: DataFrame, star: bool) -> DataFrame:
    """Rows of tasks: (task, i, j, grp, left, right, ...) with the sets. Blocks i and j of a large group meet,
    or, for a star, block i and the member that the group is named after; groups of one block are dealt in
    bundles and meet as a whole."""
    total = cut.where("parts = 1").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bundles = F.lit(max(1, math.ceil(total * 8 / BLOCK_BYTES)))
    small, every = F.col("parts") == 1, F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.array("block")
    other = F.when(F.col("id") == F.col("grp"), every).otherwise(own) if star else every
    rows = cut.withColumn("other", F.explode(F.when(small, own).otherwise(other)))
    centre = (F.col("id") == F.col("grp")) & ~small if star else F.lit(False)
    i = F.col("other") if star else F.least("block", "other")
    j = F.col("other") if star else F.greatest("block", "other")
    left = F.when(small, True).otherwise(centre if star else F.col("block") == i)
    right = F.when(small, True).otherwise(~centre if star else F.col("block") == j)
    rows = rows.select(F.when(small, F.pmod(F.xxhash64("grp"), bundles)).otherwise(F.col("grp")).alias("task"), F.when(small, -1).otherwise(i).alias("i"), F.when(small, -1).otherwise(j).alias("j"), left.alias("left"), right.alias("right"), *[c for c in cut.columns if c not in ("parts", "block")])
    return rows.join(sets, ["id", "key1", "key2"])


def _groups_of(table: pa.Table) -> Iterator[tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]]:
    """The groups of a task: rows, sets, and which of them are left and right."""
    grp = table.column("grp").to_numpy()
    order = np.argsort(grp, kind="stable")
    cut = np.flatnonzero(np.r_[True, grp[order][1:] != grp[order][:-1], True]) if len(grp) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        rows = table.take(pa.array(order[a:b]))
        sets = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("tokens")]
        left, right = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("left", "right"))
        yield rows, sets, left, right


def _forest(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join the same ids as all links between sets that meet: fewer than there are members.
    rows as of _met, with ``component``: what is joined already."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, sets, left, right in _groups_of(table):
            if len(left) and len(right):
                ident, comp = (rows.column(c).to_numpy() for c in ("id", "component"))
                x, y = spanning(sets, left, right, comp, similar)
                a.append(ident[x])
                b.append(ident[y])
        release()
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return rows.groupBy("task", "i", "j").applyInArrow(run, "a long, b long")


def _counted(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(key1, key2, n): documents with other sets that each set links with, a row for each task. rows as of
    _met, with ``copies``: the documents that have the set."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for rows, sets, left, right in _groups_of(table):
            key1, key2, copies = (rows.column(c).to_numpy() for c in ("key1", "key2", "copies"))
            # A set that several rows of one id have stands for all of them once.
            _, once = np.unique(np.stack([key1, key2]), axis=1, return_index=True)
            left, right = np.intersect1d(left, once), np.intersect1d(right, once)
            if not len(left) or not len(right):
                continue
            n = np.zeros(len(sets), np.int64)
            for part, links in linked(sets, left, right, similar):
                n[part] += links @ copies[right]
                # A block against itself has each link twice, and each set with itself.
                if np.array_equal(left, right):
                    n[part] -= copies[part]
                else:
                    n[right] += copies[part] @ links
            for k, v in enumerate((key1, key2, n)):
                out[k].append(v[n > 0])
        return pa.table({k: pa.array(np.concatenate(v)) for k, v in zip(("key1", "key2", "n"), out, strict=True)})

    return rows.groupBy("task", "i", "j").applyInArrow(run, "key1 long, key2 long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b); ids without an edge are left out.

    Each round gives every node the least label among its neighbours and itself, then the label of its
    label, until nothing changes; the rounds grow with the logarithm of the longest way, not its length.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        nearer = labels.join(around, "id").select("id", "component", F.least("component", "c").alias("c"))
        # What a node learns is passed to the node that it was named after, then names are followed one step.
        told = nearer.groupBy(F.col("component").alias("id")).agg(F.min("c").alias("t"))
        root = nearer.join(told, "id", "left").select("id", F.col("component").alias("old"), F.least("c", F.coalesce("t", "c")).alias("c"))
        after = root.select(F.col("id").alias("c"), F.col("c").alias("next"))
        labels = written(root.join(after, "c").select("id", "old", F.least("c", "next").alias("component")))
        if labels.where("old <> component").limit(1).count() == 0:
            return labels.select("id", "component")


def similar_components(docs: DataFrame, n: int = N, similar: tuple[int, int] = SIMILAR, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    docs: doc_id, text; other columns are ignored. Two documents link if ``similar[1]`` times the size of the
    intersection of their sets of word n-grams is at least ``similar[0]`` times that of their union;
    component_id is the least doc_id reachable over links; n_links is the number of other documents that the
    document links with (left out unless ``count``). Documents without words, null texts among them, have no
    shingles and no links and are their own component. Rows with the same doc_id are joined by it, and each
    comes back with the links of its own text; a null doc_id is kept and is its own component (null), never a
    link between others, and its n_links is null.
    """
    sets = written(_sets(docs, n))
    filled = sets.where("size > 0 and doc_id is not null")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # Some words in two have a signature of 16 bytes with its owner.
    buckets = max(8, math.ceil(chars / 6 * 0.55 * 16 / BUCKET_BYTES))
    # One document stands for all with the same set.
    first = written(filled.groupBy("key1", "key2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("size").alias("size")))
    placed = written(filled.join(first.drop("size"), ["key1", "key2"]))
    copies = placed.groupBy("doc_id").agg(F.min("id").alias("x"), F.max("id").alias("y"))
    # Rows with one id and several texts stay, so that each text is seen.
    copies = copies.where("x = y and x <> doc_id").select(F.col("doc_id").alias("id"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    alone = matching(texts, copies, "left_anti")
    parts = _signed(alone, n, similar, buckets)
    groups = written(parts.groupBy("bucket").applyInArrow(_shared, "grp long, id long").distinct())
    involved = written(_contents(matching(texts, groups.select("id").distinct(), "left_semi"), n))
    tokens, sizes = involved.select("id", "key1", "key2", "tokens"), involved.select("id", "key1", "key2", "size").distinct()
    # Groups with the same least id are one.
    named = groups.join(written(groups.groupBy("grp").agg(F.min("id").alias("leader"))), "grp")
    members = written(named.select(F.col("leader").alias("grp"), "id").distinct().join(sizes, "id").withColumn("component", F.col("id")))
    cut = written(_cut(members))
    edges = written(_forest(_met(cut, tokens, star=True), similar))
    large = cut.where("parts > 1").select(F.col("grp").alias("leader")).distinct()
    if not large.isEmpty():
        labels = components(edges)
        rest = named.join(large, "leader", "left_semi").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = rest.groupBy("grp").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("grp")
        rest = rest.join(split, "grp", "left_semi").select(F.col("leader").alias("grp"), "id", "component").distinct().join(sizes, "id")
        edges = edges.union(written(_forest(_met(written(_cut(written(rest))), tokens, star=False), similar)))
    # Sets that rows of one id have.
    together = placed.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("y")).where("a <> y").select("doc_id", "a")
    together = placed.join(together, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    final = components(edges.union(together))
    linked_rows = placed.join(final, "id", "left").select("doc_id", "size", "key1", "key2", "copies", F.coalesce("component", "id").alias("component_id"))
    rest = sets.where("size = 0 or doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if not count:
        return linked_rows.select("doc_id", F.col("size").alias("n_shingles"), "component_id").union(rest)
    inside = first.join(final, "id").select(F.col("component").alias("grp"), "id", "key1", "key2", "size", "copies")
    inside = written(inside)
    several = inside.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    inside = written(inside.join(written(several), "grp", "left_semi"))
    counted = written(_counted(_met(written(_cut(inside)), tokens, star=False), similar))
    others = counted.groupBy("key1", "key2").agg(F.sum("n").alias("n"))
    n_links = (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    linked_rows = written(linked_rows).join(written(others), ["key1", "key2"], "left").select("doc_id", F.col("size").alias("n_shingles"), "component_id", n_links)
    return linked_rows.union(rest.withColumn("n_links", F.when(F.col("doc_id").isNotNull(), F.lit(0)).cast("long")))


def matching(texts: DataFrame, ids: DataFrame, how: str, on: str = "id") -> DataFrame:
    """Texts whose id is (or is not) among ids: by broadcast if there are at most FEW, else by a shuffle."""
    ids = written(ids)
    return texts.join(F.broadcast(ids) if ids.count() <= FEW else ids, on, how)


def one_of_each(docs: DataFrame, n: int = N, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents without those that are similar to one with a smaller id, through links of others too.

    All columns stay. Of rows with one id the one with the least text stays; null ids are kept.
    """
    found = written(similar_components(docs, n, similar, count=False).where("doc_id is not null"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    single = matching(docs, gone.union(repeated).distinct(), "left_anti", "doc_id")
    rows = matching(docs, repeated.join(gone, "doc_id", "left_anti"), "left_semi", "doc_id")
    kept = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.struct("text", F.xxhash64(*rows.columns))).alias("row")).select("row.*")
    return single.unionByName(kept)
