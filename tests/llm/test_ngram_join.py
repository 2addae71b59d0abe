import random

import pytest

from spindrift.llm import ngram_join as J


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(rows):
    sets = [(i, shingled(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if similar(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def links(rows):
    sets = [(i, shingled(t)) for i, t in rows if i is not None]
    return sorted((i, sum(similar(a, b) for _, b in sets) - bool(a)) for i, a in sets)


def check(docs, rows):
    got = J.similar_components(docs(rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.doc_id, r.n_links) for r in got if r.doc_id is not None) == links(rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(i, set()).add(len(shingled(t)))
    assert all(r.n_shingles in by_text[r.doc_id] for r in got)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice("abcdefgh") * 3
    return " ".join(words)


def test_random_edits(docs):
    r = random.Random(5)
    rows = []
    for size in (3, 5, 6, 9, 14, 25, 60, 150, 400):
        for _ in range(3):
            base = [r.choice(["a", "be", "sea", "dee"]) + str(r.randrange(300)) for _ in range(size)]
            for n in (0, 0, 1, 2, size // 50 + 1):
                rows.append((len(rows), edited(r, base, n)))
            rows.append((len(rows), " ".join(base[: size - size // 6])))
            rows.append((len(rows), " ".join(base + base[: size // 8])))
    r.shuffle(rows)
    check(docs, rows)


def test_chain_is_one_component(docs):
    """Each is similar to the next only, so the group can't be settled by one member."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 120])) for k in range(30)]
    check(docs, rows)


@pytest.mark.parametrize("block", [3, 7, 4000])
def test_large_group_leaves_its_task(docs, monkeypatch, block):
    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "BLOCK", block)
    r = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, edited(r, base, 3)) for k in range(40)] + [(100 + k, "shared words of a common line " * 2 + f"own{k} text{k}") for k in range(30)]
    check(docs, rows)


def test_nulls_empties_and_repeats(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e f"), (6, "x y z u v w q"), (7, "X y z u v w q"), (None, "a b c d e f"), (None, None), (8, "ä" * 5000 + " b c d e f g")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.similar_components(docs(rows)).collect()}
    assert got == {(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 1), (5, 1, 4, 1), (6, 2, 6, 0), (6, 3, 6, 1), (7, 3, 6, 1), (None, 2, None, None), (None, 0, None, None), (8, 3, 8, 0)}


def test_repeated_rows(docs):
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(k % 7, edited(r, base, k % 4)) for k in range(30)]
    check(docs, rows + rows[:12])


@pytest.mark.parametrize("block", [30, 4000])
def test_rows_put_out_grow_with_a_group(docs, monkeypatch, block):
    """Sets just too far from each other: nearly all pairs are candidates, yet what tasks put out stays below
    the number of sets."""
    monkeypatch.setattr(J, "BLOCK", block)
    out = []
    forest = J._forest
    monkeypatch.setattr(J, "_forest", lambda *a: out.append(forest(*a)) or out[-1])
    for n in (50, 100, 200):
        r = random.Random(n)
        base = [f"w{k}" for k in range(300)]
        rows = [(k, edited(r, base, 7)) for k in range(n)]
        out.clear()
        check(docs, rows)
        assert sum(x.count() for x in out) <= 2 * n


def test_intersections():
    import numpy as np

    from spindrift.llm import _compare as C

    rng = np.random.default_rng(1)
    for n in (1, 3, 6, 40, 90):
        sets = [np.unique(rng.integers(0, 400, rng.integers(0, 120)).astype(np.uint64)) for _ in range(n)]
        left, right = np.flatnonzero(rng.random(n) < 0.6), np.flatnonzero(rng.random(n) < 0.7)
        for a, b in ((left, right), (np.arange(n), np.arange(n))):
            if len(a) and len(b):
                got = np.concatenate([m for _, m in C.intersections(sets, a, b)])
                assert got.tolist() == [[len(set(sets[x].tolist()) & set(sets[y].tolist())) for y in b] for x in a]


def test_empty_table(docs):
    assert J.similar_components(docs([(1, "a")]).where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 4, 5, 9, 23, 24, 25, 40, 111, 500])
def test_similar_sets_share_a_probed_signature(size):
    import numpy as np

    rng = np.random.default_rng(size)
    for _ in range(40):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        apart = int(J.most_apart(2 * len(a)))
        gone, new = rng.integers(0, apart // 2 + 1), rng.integers(0, apart // 2 + 1)
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
        if not J.links(a, b):
            continue
        (sa, pa), (sb, pb) = J.signatures(a), J.signatures(b)
        assert set(sa[pa].tolist()) & set(sb.tolist()) or set(sb[pb].tolist()) & set(sa.tolist())


def test_one_of_each(docs):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "other words stand in this text"), (4, None)]
    assert sorted(r.doc_id for r in J.one_of_each(docs(rows)).collect()) == [1, 2, 4]
