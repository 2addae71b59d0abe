import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import hard_negatives as H

WIDE = "vec_id long, label int, embedding array<double>, block int, part string, row_no int"


def table(spark, rows, parts=3):
    made = [(i, x, None if v is None else [None if c is None else float(c) for c in v], 1, "p", 2) for i, x, v in rows]
    return spark.createDataFrame(made, WIDE).repartition(parts)


def plain(rows, every=10):
    """All pairs, one by one, in Python's integers."""
    kept = [(i, x, [int(np.floor(256 * c)) for c in v]) for i, x, v in rows if x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (i, x, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, y) for n, (j, y, w) in enumerate(kept) if n != at and len(w) == len(v)]
        for p, j, _ in sorted([s for s in scored if s[2] == x], key=key)[:5]:
            hard = sorted([s for s in scored if s[2] != x and 30 * p <= 100 * s[0] <= 90 * p], key=key)[:10]
            out += [(i, j, r + 1, n, p, s) for r, (s, n, _) in enumerate(hard)]
    return sorted(map(str, out))


def got(spark, rows, parts=3, **options):
    return sorted(str(tuple(r)) for r in H.mine(table(spark, rows, parts), F.col("vec_id") % 10 == 0, **options).collect())


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for most, bias in ((0, 0), (1, 3), (160, 160), (1 << 14, 1 << 15), (1 << 26, 1 << 26), (1 << 52, 1 << 52)):
        rows = rng.integers(-bias, bias + 1, (50, 9))
        rows[0] = bias
        for anchor in ([most] * 9, [-most] * 9, rng.integers(-most, most + 1, 9).tolist()):
            assert [int(x) for x in H.Packed(rows, most).scores(anchor)] == [sum(int(a) * int(b) for a, b in zip(anchor, r, strict=True)) for r in rows]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 3, rng.normal(0, 0.2, 8)) for k in range(150)]
    rows += [(500 + k, 1, rows[4][2]) for k in range(60)] + [(700 + k, 2, [1.0] * 8) for k in range(40)] + rows[10:25] + rows[20:21]
    rows += [(None, 1, rows[3][2]), (None, 2, [0.9] * 8), (800, None, [1.0] * 8), (810, 1, None), (820, 1, [None] * 8), (830, 1, [float("nan")] * 8), (840, 1, [float("-inf")] * 8)]
    rows += [(900 + k, k % 2, rng.normal(0, 0.2, 3)) for k in range(30)] + [(950 + k, k % 2, []) for k in range(15)]
    want = plain(rows)
    assert got(spark, rows) == want and len(want) > 300
    assert got(spark, rows, 5, cells=100, anchor_cells=100) == want


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 2, rng.normal(0, 1e6, 4)) for k in range(60)] + [(k, k % 2, rng.normal(0, 1e5, 2)) for k in range(60, 90)]
    assert got(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        got(spark, [(k, 0, [1e30]) for k in range(30)])


def test_few_and_none(spark):
    assert got(spark, [(10, 0, [1.0])]) == [] == got(spark, [(11, None, [1.0])])
    assert H.mine(table(spark, [(10, 0, [1.0])]).where("vec_id > 99"), F.col("vec_id") % 10 == 0).collect() == []
    rows = [(10, 0, [1.0]), (11, 0, [1.0]), (12, 1, [0.5]), (13, 1, [0.5]), (14, 1, [0.95]), (15, 1, [0.1])]
    assert got(spark, rows) == plain(rows) == sorted(map(str, [(10, 11, 1, 12, 65536, 32768), (10, 11, 2, 13, 65536, 32768)]))


def test_relabelled(spark):
    rows = H.relabelled(table(spark, [(7, 9, [1.0]), (8, 9, [1.0]), (None, 9, [1.0]), (14, None, [1.0])])).collect()
    assert {(r.vec_id, r.label) for r in rows} == {(7, 0), (8, 9), (None, 9), (14, None)}
