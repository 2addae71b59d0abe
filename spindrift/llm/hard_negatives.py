"""Hard negatives: for an anchor and one of its nearest rows of the same label, rows of other labels that come close.

Scores are inner products of integers, taken exactly by Kronecker packing: component i of many candidates, made
positive by a bias, stands in separate fields of one wide integer, which is multiplied once by the anchor's component i.
The sum of these products over the components holds all scores in its fields; what the biases add is known and taken off.
Fields are as wide as the largest sum that the block's values allow, so no score runs into its neighbour.

All candidates are scored for all anchors, in blocks: a task holds a block of anchors and a part of the candidates, both
of a bounded size whatever the data, and puts out no more than its best few for each anchor. Rows are dealt to parts
at random, so no label, id or repeated vector fills one. A pass finds the positives, another the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import written

#: Components of the candidates, and of the anchors, that a task holds at once.
CELLS, ANCHOR_CELLS = 1 << 22, 1 << 17
#: A part is not made smaller than this for the sake of more tasks.
LEAST = 512
NO_ID = np.iinfo(np.int64).max


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles, as integers of 64 bits where they are exact, else as Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(256.0 * vectors)
    if not scaled.size or np.abs(scaled).max() < 1 << 53:
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():
        raise ArithmeticError("256 times a component is beyond the range of doubles")
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


class Packed:
    """Candidates, a row each, ready to be multiplied by anchors whose components are at most ``most`` in size."""

    def __init__(self, candidates: np.ndarray, most: int):
        self.rows, self.width = candidates.shape
        self.most = most
        self.bias = int(max(abs(candidates.min()), abs(candidates.max()))) if candidates.size else 0
        bits = (self.width * (2 * most) * (2 * self.bias)).bit_length()
        self.bytes = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)
        self.sums = candidates.sum(1) if self.width else np.zeros(self.rows, np.int64)
        self.wide = [self._pack(candidates[:, i] + self.bias) for i in range(self.width)]

    def _pack(self, fields: np.ndarray) -> int:
        if self.bytes <= 8:
            return int.from_bytes(fields.astype(f"<u{self.bytes}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in fields), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with all candidates, in their order; integers of 64 bits if 100 times a score fits, else
        Python's."""
        total = 0
        for a, wide in zip(anchor, self.wide, strict=True):
            total += (a + self.most) * wide
        raw = total.to_bytes(self.rows * self.bytes, "little")
        off = self.bias * sum(anchor) + self.width * self.most * self.bias
        small = self.bytes <= 4 or 4 * self.width * self.most * self.bias < 1 << 55
        if self.bytes <= 8 and small:
            fields = np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64)
            return fields - off - self.most * self.sums
        fields = [int.from_bytes(raw[k : k + self.bytes], "little") for k in range(0, len(raw), self.bytes)]
        return np.array([f - off - self.most * int(s) for f, s in zip(fields, self.sums, strict=True)] + [None], object)[:-1]


class Block:
    """Columns row_no, vec_id, label, embedding of a block of rows."""

    def __init__(self, table: pa.Table):
        self.row_no = table["row_no"].to_numpy()
        self.ids = table["vec_id"].fill_null(NO_ID).to_numpy()
        self.labels = table["label"].to_numpy()
        vectors = table["embedding"].combine_chunks()
        self.widths = vectors.value_lengths().to_numpy()
        self.begins = np.r_[0, np.cumsum(self.widths)].astype(np.int64)
        self.values = np.asarray(vectors.flatten(), np.float64)

    def matrix(self, at: np.ndarray, width: int) -> np.ndarray:
        """Integer vectors of the rows at these places, all of one width."""
        return whole(self.values[self.begins[at][:, None] + np.arange(width)])


Pick = Callable[[int, np.ndarray, np.ndarray, np.ndarray], list[tuple]]


def _scored(anchors: Block, rows: Block, same_label: bool, pick: Pick) -> list[tuple]:
    """What ``pick`` makes of each anchor and its candidates, which stand by score, highest first, then by id: it gets
    the anchor's place, the candidates' places, scores and ids."""
    out: list[tuple] = []
    by_id = np.argsort(rows.ids, kind="stable")
    keys = sorted({(int(w), int(x) if same_label else None) for w, x in zip(anchors.widths, anchors.labels, strict=True)}, key=str)
    for width, label in keys:
        mine, there = anchors.widths == width, rows.widths[by_id] == width
        if label is not None:
            mine, there = mine & (anchors.labels == label), there & (rows.labels[by_id] == label)
        mine, there = np.flatnonzero(mine), by_id[there]
        if not len(there):
            continue
        vectors = anchors.matrix(mine, width)
        most = int(max(abs(vectors.min()), abs(vectors.max()))) if vectors.size else 0
        packed = Packed(rows.matrix(there, width), most)
        for k, vector in zip(mine.tolist(), vectors.tolist(), strict=True):
            other = rows.row_no[there] != anchors.row_no[k] if same_label else rows.labels[there] != anchors.labels[k]
            scores = packed.scores([int(x) for x in vector])[other]
            order = np.argsort(-scores, kind="stable")
            places = there[other][order]
            out += pick(k, places, scores[order], rows.ids[places])
    return out


def _long(score: object) -> int:
    if not -(1 << 63) <= int(score) < 1 << 63:
        raise ArithmeticError("a score does not fit into 64 bits")
    return int(score)


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    arrays = [pa.array([None if n.endswith("_id") and x == NO_ID else x for x in c], t) for n, c, t in zip(names, columns, kinds, strict=True)]
    return pa.table(arrays, names)


def _in_blocks(anchors: DataFrame, rows: DataFrame, parts: int, blocks: int, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """find over every block of anchors with every part of the rows."""
    key = ["block", "part"]
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(find, schema)


def _first(found: DataFrame, by: list[str], name: str, score: str, n: int) -> DataFrame:
    """The n rows of the highest score for each ``by``, of equal ones those of the smaller id, null ids last, and their
    ``rank``. Spark keeps n rows of each key in every task before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(name).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def finite(embedding: Column) -> Column:
    """Whether a vector is there and has no null, NaN or infinite component."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(embedding, good), F.lit(False))


def mine(
    vectors: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 10, low: int = 30, high: int = 90,
    cells: int = CELLS, anchor_cells: int = ANCHOR_CELLS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its
    first n_positive other rows of the same label, the first n_negative rows of other labels whose scores are from low
    to high percent of the positive's.

    vectors: vec_id long, label integer, embedding array of float or double; other columns are ignored. Rows without a
    label or vector, or with a null, NaN or infinite component, take no part. A component x counts as floor(256 * x);
    rows whose vector has another length than the anchor's are no candidates of it. Higher scores come first, ties by
    the smaller id, null ids last. Repeated rows count each, the copies of an anchor as other rows of it. An anchor
    with no positive, or no row in the range, gives nothing, as an empty table does. A score beyond 64 bits that would be
    returned raises ArithmeticError.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    kept = kept.where(F.col("label").isNotNull() & finite(F.col("embedding"))).withColumn("row_no", F.monotonically_increasing_id())
    kept = written(kept.withColumn("embedding", F.col("embedding").cast("array<double>")))
    size = kept.agg(F.count("*").alias("n"), F.count_if("anchor").alias("m"), F.coalesce(F.sum(F.size("embedding") + 1), F.lit(0)).alias("cells"), F.coalesce(F.sum(F.when(F.col("anchor"), F.size("embedding") + 1)), F.lit(0)).alias("anchor_cells")).first()
    busy = min(4 * kept.sparkSession.sparkContext.defaultParallelism, math.ceil(size.n / LEAST))
    parts, blocks = max(1, math.ceil(size.cells / cells), busy), max(1, math.ceil(size.anchor_cells / anchor_cells))
    columns = ["row_no", "vec_id", "label", "embedding"]
    # The written table gives each task the same rows in the same order if it has to run again.
    rows = kept.select(*columns, F.floor(F.rand(7) * parts).cast("int").alias("part"))
    anchors = written(kept.where("anchor").select(*columns, F.floor(F.rand(11) * blocks).cast("int").alias("block")))

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = Block(left)

        def pick(k: int, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> list[tuple]:
            return [(int(mine.row_no[k]), int(i), _long(s)) for i, s in zip(ids[:n_positive], scores[:n_positive], strict=True)]

        found = _scored(mine, Block(right), True, pick) if left.num_rows and right.num_rows else []
        return _columns(found, ["row_no", "positive_id", "positive_score"], [pa.int64()] * 3)

    near = _first(_in_blocks(anchors, rows, parts, blocks, positives, "row_no long, positive_id long, positive_score long"), ["row_no"], "positive_id", "positive_score", n_positive)
    near = written(near.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("near")))

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = Block(left)
        near = left["near"].to_pylist()

        def pick(k: int, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> list[tuple]:
            falling, out = -100 * scores, []
            for p in near[k]:
                begin = int(np.searchsorted(falling, -high * p["positive_score"], "left"))
                end = min(begin + n_negative, int(np.searchsorted(falling, -low * p["positive_score"], "right")))
                out += [(int(mine.row_no[k]), p["rank"], int(i), _long(s)) for i, s in zip(ids[begin:end], scores[begin:end], strict=True)]
            return out

        found = _scored(mine, Block(right), False, pick) if left.num_rows and right.num_rows else []
        return _columns(found, ["row_no", "place", "negative_id", "negative_score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    asked = anchors.join(near, "row_no")
    hard = _in_blocks(asked, rows, parts, blocks, negatives, "row_no long, place int, negative_id long, negative_score long")
    hard = _first(hard, ["row_no", "place"], "negative_id", "negative_score", n_negative)
    named = asked.select("row_no", F.col("vec_id").alias("anchor_id"), F.explode("near").alias("p")).withColumn("place", F.col("p.rank"))
    return hard.join(named, ["row_no", "place"]).select("anchor_id", "p.positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "p.positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding with the label moved on where the id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")


ORACLE = """
WITH kept AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.row_no, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM kept a JOIN kept b ON a.row_no <> b.row_no AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.row_no, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST))::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.row_no = n.row_no AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""
