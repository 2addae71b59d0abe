"""Tables that move from version to version together: rows by key in buckets that split as they grow, and one manifest.

A table's rows lie in buckets by the low bits of a hash of their key. A bucket that has too many rows is split by more
bits, so their number follows the table and each stays of a bounded size. Writing touches only the buckets that incoming
rows fall into; all others stay where they are and are named again by the next manifest. The manifest of a version, written
last and by one rename, names the files of all tables: a reader sees all of them before or after, and a version that is
written again, after a failure or twice, is made from the one before it and comes out the same.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a bucket beyond which it is split; bits by which it is split at most in one version.
BUCKET_ROWS, MOST_BITS = 2_000_000, 10
#: Rows that one task writes, about; a bucket of more is written by several, as rows may hold whole texts.
TASK_ROWS = 20_000
#: Parts of a table that rows are only added to, beyond which they are written together.
MOST_PARTS = 32


@dataclass(frozen=True)
class Bucket:
    """Rows whose hash ends in the ``bits`` low bits of ``value``; path: where they lie, null for none."""

    bits: int
    value: int
    rows: int
    path: str | None


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 60) - 1))


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class Versions:
    """The tables in one folder. A table is known by its name from the first version on that has rows of it."""

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = BUCKET_ROWS, task_rows: int = TASK_ROWS):
        self.spark, self.folder, self.bucket_rows, self.task_rows = spark, folder.rstrip("/"), bucket_rows, task_rows

    def numbers(self) -> list[int]:
        """Versions that are there."""
        files, path = _file_system(self.spark, f"{self.folder}/manifest-*.json")
        return sorted(int(f.getPath().getName()[9:-5]) for f in files.globStatus(path) or [])

    def manifest(self, before: int | None = None) -> dict[str, list[Bucket]]:
        """Buckets of all tables in the newest version, or the newest before a number."""
        there = [n for n in self.numbers() if before is None or n < before]
        if not there:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifest-{there[-1]}.json", wholetext=True).first()[0]
        return {name: [Bucket(*b) for b in buckets] for name, buckets in json.loads(text).items()}

    def read(self, name: str, schema: StructType | str, before: int | None = None) -> DataFrame:
        """The rows of a table; none if there is no such table yet."""
        return self._rows(self.manifest(before).get(name, []), schema)

    def _rows(self, buckets: list[Bucket], schema: StructType | str) -> DataFrame:
        paths = [b.path for b in buckets if b.path and b.rows]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, name: str, rows: DataFrame, number: int, alive: DataFrame) -> list[Bucket]:
        """Writes rows with keys that a table does not have yet, so that nothing of it is written again; ``commit`` of the same
        version names the parts that are returned. When there are MOST_PARTS, they are written together, then without the
        rows that match none in ``alive``, a table of keys."""
        parts = self.manifest(before=number).get(name, [])
        if len(parts) >= MOST_PARTS:
            rows, parts = rows.unionByName(self._rows(parts, rows.schema).join(alive, alive.columns, "left_semi")), []
        path = f"{self.folder}/{name}/{number}-{uuid.uuid4().hex}/rows"
        rows.write.parquet(path)
        part = Bucket(0, len(parts), self.spark.read.schema(rows.schema).parquet(path).count(), path)
        return [*parts, part] if part.rows else parts

    def rows(self, parts: list[Bucket], schema: StructType | str) -> DataFrame:
        """The rows of parts that ``add`` has written."""
        return self._rows(parts, schema)

    def commit(self, number: int, changes: dict[str, tuple[DataFrame, list[str], str]], keep: int = 2, added: dict[str, list[Bucket]] | None = None) -> None:
        """Writes version ``number``. changes: name -> (rows, keys, order): of each key the row that is last by ``order``
        stays, of incoming rows and those of the version before; rows equal in ``order`` by all their columns. Incoming
        rows are read twice, so what costs much to make is better written before. added: name -> parts, see ``add``. The newest ``keep`` versions stay, with the files that they name."""
        tables = self.manifest(before=number) | (added or {})
        for name, (rows, keys, order) in changes.items():
            tables[name] = self._merged(name, tables.get(name) or [Bucket(0, 0, 0, None)], rows, keys, order, number)
        text = json.dumps({name: [[b.bits, b.value, b.rows, b.path] for b in buckets] for name, buckets in tables.items()})
        self._write(f"manifest-{number}.json", text)
        self._clean(keep)

    def _placed(self, rows: DataFrame, buckets: list[Bucket], keys: list[str]) -> DataFrame:
        """rows with ``_bucket``, the place in ``buckets`` of the one that they belong to: a row has one value for each number
        of bits that occurs, and just one of these is a bucket's."""
        names = self.spark.createDataFrame([(b.bits, b.value, k) for k, b in enumerate(buckets)], "_bits int, _value long, _bucket int")
        bits = F.array(*(F.struct(F.lit(n).alias("_bits"), _hash(keys).bitwiseAND(F.lit((1 << n) - 1)).alias("_value")) for n in sorted({b.bits for b in buckets})))
        found = rows.withColumn("_x", F.explode(bits)).select(*rows.columns, "_x.*").join(F.broadcast(names), ["_bits", "_value"])
        return found.drop("_bits", "_value")

    def _merged(self, name: str, buckets: list[Bucket], rows: DataFrame, keys: list[str], order: str, number: int) -> list[Bucket]:
        counts = {r[0]: r[1] for r in self._placed(rows, buckets, keys).groupBy("_bucket").count().collect()}
        if not counts:
            return buckets
        # A bucket that may become too large is split by as many bits as bring its parts to half of what is allowed.
        # A bucket's rows are dealt to tasks by another hash of their key: ``tasks`` has how many each takes.
        after: list[Bucket] = []
        tasks: list[int] = []
        for k, n in counts.items():
            b = buckets[k]
            more = 0 if b.rows + n <= self.bucket_rows else min(MOST_BITS, math.ceil(math.log2(2 * (b.rows + n) / self.bucket_rows)))
            after += [Bucket(b.bits + more, b.value | part << b.bits, 0, None) for part in range(1 << more)]
            tasks += [max(1, math.ceil((b.rows + n) / (1 << more) / self.task_rows))] * (1 << more)
        both = rows.unionByName(self._rows([buckets[k] for k in counts], rows.schema))
        others = [c for c in rows.columns if c not in keys]
        last = both.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_order"), *others)).alias("_row")).select(*keys, "_row.*") if others else both.distinct()
        path = f"{self.folder}/{name}/{number}-{uuid.uuid4().hex}"
        ends = list(itertools.accumulate(tasks))
        shares = self.spark.createDataFrame([(k, end - n, n) for k, (end, n) in enumerate(zip(ends, tasks))], "_bucket int, _first int, _tasks int")
        task = F.col("_first") + F.pmod(F.xxhash64(F.lit("task"), *keys), F.col("_tasks")).cast("int")
        dealt = self._placed(last.select(*rows.columns), after, keys).join(F.broadcast(shares), "_bucket").withColumn("_task", task)
        dealt.repartitionById(ends[-1], F.col("_task")).drop("_first", "_tasks", "_task").write.partitionBy("_bucket").parquet(path)
        written = {r["_bucket"]: r["count"] for r in self.spark.read.parquet(path).groupBy("_bucket").count().collect()}
        new = [Bucket(b.bits, b.value, written.get(k, 0), f"{path}/_bucket={k}" if k in written else None) for k, b in enumerate(after)]
        return [b for k, b in enumerate(buckets) if k not in counts] + new

    def _write(self, name: str, text: str) -> None:
        """One file by its whole content, under its name only when it is complete."""
        files, hidden = _file_system(self.spark, f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        out = files.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, path = _file_system(self.spark, f"{self.folder}/{name}")
        if files.exists(path):
            files.delete(path, False)
        files.rename(hidden, path)

    def _clean(self, keep: int) -> None:
        """Deletes old manifests, and folders of tables that none of the others names."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            files, path = _file_system(self.spark, f"{self.folder}/manifest-{n}.json")
            files.delete(path, False)
        named = {b.path.rsplit("/", 1)[0].rsplit("/", 1)[1] for n in numbers[-keep:] for buckets in self.manifest(n + 1).values() for b in buckets if b.path}
        files, path = _file_system(self.spark, f"{self.folder}/*/*-*")
        for f in files.globStatus(path) or []:
            if f.isDirectory() and f.getPath().getName() not in named:
                files.delete(f.getPath(), True)
