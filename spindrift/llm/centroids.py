"""Nearest centroids of integer vectors by a Walsh-Hadamard progressive search, and clusters made with it.

A Walsh-Hadamard transform without a norm keeps squared distances but for the factor 64, in integers. The first
coefficients add up whole stretches of a vector, the last ones compare neighbours, so the differences of coefficients
are taken from coarse to fine. Their running sum is a lower bound of a distance. The centroid that leads after the
first level is finished at once; whatever already lies strictly beyond the least finished distance is out, and what is
left finishes all 64 coefficients. So the nearest centroid and its distance are exact, ties included.

Vectors stay where they lie: every round reads the written table, sums up by cluster inside each task, and shuffles
a row for each task and cluster. Only the centroids, a fixed small number of 64 components, go to the driver and back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import written

WIDTH = 64
#: Coefficients that a level adds.
LEVELS = (8, 24, 64)
#: Integers of 64 bits hold 64 times a squared distance of components up to this one; beyond it Python's are used.
SMALL = 1 << 21
#: Vectors that are compared with all centroids at once.
ROWS = 1024
PARTIAL = "cluster int, sums array<long>, n long"


def hadamard(vectors: np.ndarray) -> np.ndarray:
    """The transform of every row, in the order of sign changes: coarse coefficients first. Exact in integers."""
    out, half = vectors.copy(), 1
    while half < WIDTH:
        pairs = out.reshape(len(out), WIDTH // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), WIDTH)
        half *= 2
    return out[:, _by_changes()]


def _by_changes() -> np.ndarray:
    """Coefficients by the number of sign changes of their functions."""
    i = np.arange(WIDTH)
    signs = np.array([[bin(a & b).count("1") % 2 for b in i] for a in i])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as integers of 64 bits if all are small enough for exact distances, else as Python's."""
    scaled = np.floor(256.0 * values.astype(np.float64))
    if not len(scaled) or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64)
    if np.abs(scaled).max() >= 1 << 28:
        raise ArithmeticError("a component of 2^20 or more, whose squared distances do not fit into 64 bits")
    return scaled.astype(np.int64).astype(object)


@dataclass(frozen=True)
class Centroids:
    """The centroids, a row each, and their transforms."""

    rows: np.ndarray

    @property
    def transformed(self) -> np.ndarray:
        return hadamard(self.rows)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r.tolist())).encode()).hexdigest() for r in self.rows]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row; of equal ones the smallest number.
    vectors, centroids: both transformed. No more than ROWS times the centroids are held at once."""
    number, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), vectors.dtype)
    for at in range(0, len(vectors), ROWS):
        part = vectors[at : at + ROWS]
        row, of = np.divmod(np.arange(len(part) * len(centroids)), len(centroids))
        partial = np.zeros(len(row), vectors.dtype)
        begin = 0
        for end in LEVELS:
            partial = partial + ((part[row, begin:end] - centroids[of, begin:end]) ** 2).sum(1)
            if end < WIDTH:
                # Rows stand together, so the first place of a row is where its number changes.
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                leads = _least(partial, first, row)
                rest = ((part[row[leads], end:] - centroids[of[leads], end:]) ** 2).sum(1)
                most = (partial[leads] + rest)[row]
                stays = np.asarray(partial <= most, bool)
                row, of, partial = row[stays], of[stays], partial[stays]
            begin = end
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = _least(partial, first, row)
        number[at : at + ROWS], distance[at : at + ROWS] = of[best], partial[best] // WIDTH
    return number, distance


def _least(values: np.ndarray, first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Place of the least value of each row, the first of equal ones. Every row has a place."""
    low = np.minimum.reduceat(values, first)
    at = np.flatnonzero(np.asarray(values == low[row], bool))
    return at[np.flatnonzero(np.r_[True, row[at][1:] != row[at][:-1]])]


def usable(embedding: Column) -> Column:
    """Whether a vector has just 64 components, none of them null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size("embedding") == WIDTH) & F.forall(embedding, finite), F.lit(False))


def first_centroids(kept: DataFrame, k: int = 40, seed: str = "2") -> Centroids:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, of equal ones the smaller vector; null ids last. If
    there are fewer vectors, all."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(mark.alias("mark"), "embedding").orderBy(F.col("mark").asc_nulls_last(), "embedding").limit(k).collect()
    return Centroids(whole(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), WIDTH)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), WIDTH)


def next_centroids(kept: DataFrame, now: Centroids) -> Centroids:
    """Each centroid's exact floor of the mean of the vectors nearest to it; those without vectors stay."""
    transformed = now.transformed

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(transformed), WIDTH), np.int64), np.zeros(len(transformed), np.int64)
        for batch in batches:
            vectors = whole(_matrix(batch.column(0)))
            number, _ = nearest(*_alike(hadamard(vectors), transformed))
            np.add.at(total, number, vectors.astype(np.int64))
            n += np.bincount(number, minlength=len(n))
        used = np.flatnonzero(n)
        out = [pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64())), pa.array(n[used], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["cluster", "sums", "n"])

    partial = kept.select("embedding").mapInArrow(sums, PARTIAL)
    added = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(WIDTH)])
    rows = now.rows.copy()
    for r in added.collect():
        rows[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(WIDTH)]
    return Centroids(rows)


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with Python's integers if one of them has these."""
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


def assigned(kept: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance): each vector's nearest centroid and the squared distance to it."""
    transformed = centroids.transformed

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(*_alike(hadamard(whole(_matrix(batch.column(1)))), transformed))
            out = [batch.column(0), pa.array(number, pa.int32()), pa.array(distance.astype(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "embedding").mapInArrow(find, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for every vector that is usable.

    vectors: vec_id long, embedding array of float or double; other columns are ignored. Vectors of another length than
    64, null ones and those with a null, NaN or infinite component give no row; null and repeated ids do. A component x
    counts as floor(256 * x). Of equally near centroids the smaller number wins. A component of 2^20 or more raises
    ArithmeticError, as squared distances would not fit into 64 bits. An empty table gives no rows.
    """
    kept = written(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable(F.col("embedding"))))
    centroids = first_centroids(kept, k, seed)
    if not len(centroids.rows):
        return assigned(kept, centroids).select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    found = written(assigned(kept, centroids))
    # One row for each centroid.
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = per.agg(F.sum("cluster_inertia").alias("inertia"))
    names = F.array(*map(F.lit, centroids.digests()))
    return found.join(F.broadcast(per), "cluster").crossJoin(F.broadcast(every)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.get(names, F.col("cluster")).alias("centroid_sha256"))


def _round(n: int, last: bool = False) -> str:
    """SQL of one round: a<n> assigns, c<n + 1> moves the centroids."""
    moved = "" if last else f""",
    m{n} AS (SELECT a.number, i.i, floor(sum(v.v[i.i])::DECIMAL(38,0) / count(*))::BIGINT AS m FROM a{n} a JOIN kept v USING (row_no), dims i GROUP BY ALL),
    c{n + 1} AS (SELECT c.number, CASE WHEN n.m IS NULL THEN c.v ELSE n.m END AS v FROM c{n} c LEFT JOIN (SELECT number, list(m ORDER BY i) AS m FROM m{n} GROUP BY number) n USING (number))"""
    return f"""
    a{n} AS MATERIALIZED (SELECT row_no, arg_min(number, (d, number)) AS number, min(d) AS d FROM (
      SELECT v.row_no, c.number, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept v, c{n} c) GROUP BY row_no){moved}"""


ORACLE = f"""
WITH dims AS (SELECT unnest(range(1, 65)) AS i),
    kept AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS number, v FROM kept
      ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, v LIMIT 40),
    {", ".join(_round(n) for n in range(5))}, {_round(5, last=True)}
SELECT v.vec_id, a.number::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.number))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 a JOIN kept v USING (row_no) JOIN c5 c USING (number)
"""
