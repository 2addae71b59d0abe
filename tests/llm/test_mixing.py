from spindrift.llm import mixing as M


def water(sizes, weights, most=3):
    """Targets by sharing anew until none is above its limit."""
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in sizes if s not in full]
        share = {s: (left - sum(full.values())) * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(docs):
    rows = [(k, "w " * (k % 7 + 1), None, ["b", "a", "c", None][min(3, k % 9)]) for k in range(900)]
    got = M.mix_sources(docs(rows)).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
    want = water(sizes, {"a": 1, "b": 2, "c": 3, None: 1})
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= 30
    again = M.mix_sources(docs(rows, parts=5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edges(docs):
    rows = [(None, None, None, None), (1, "", None, "a"), (1, "", None, "a"), (2, "x y", None, "a"), (2, "x y", None, "a")]
    got = M.mix_sources(docs(rows)).collect()
    assert len(got) == 5 and sum(r.taken for r in got) <= 4
    assert M.mix_sources(docs(rows).where("doc_id > 5")).collect() == []
    assert [r.taken for r in M.mix_sources(docs([(1, "  ", None, "a")])).collect()] == [0]


def test_mixed_repeats_rows(docs):
    rows = [(k, "w " * 10, None, "a" if k < 10 else "b") for k in range(100)]
    table = docs(rows)
    taken = {r.doc_id: r.copies for r in M.mix_sources(table).collect()}
    out = M.mixed(table)
    assert out.columns == table.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: v for k, v in taken.items() if v}
