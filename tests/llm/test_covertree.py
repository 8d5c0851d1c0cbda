import math
import random

import numpy as np
import pytest

from lonja.llm import covertree as C

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, least=80):
    e = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows
         if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(e):
        if i % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(v, w)), j, b) for b, (j, w, _) in enumerate(e) if b != a)
        for ps, pj, _ in [t for t in s if e[t[2]][2] == y][:5]:
            fits = [t for t in s if e[t[2]][2] != y and least * -ps <= 100 * -t[0] <= 100 * -ps][:5]
            out += [(i, pj, k + 1, j, -ps, -ns) for k, (ns, j, _) in enumerate(fits)]
    return sorted(out)


def corpus(seed, n=500, d=6, spread=0.3):
    rng = random.Random(seed)
    hubs = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(8)]
    rows = []
    for k in range(n):
        v = [x + rng.gauss(0, spread) for x in rng.choice(hubs)]
        rows.append((k, v, rng.randint(0, 9)))
    hot = hubs[0]
    return rows + [(n + k, hot, k % 3) for k in range(n // 3)] + [
        (None, hot, 1), (5000, None, 1), (5100, hot, None), (5200, [1.0, float("nan")], 1), (5300, [float("inf")], 1), (5400, [1.0, None], 1),
        (5500, [], 2), (5600, [0.0] * d, 3), (5700, [2.0], 4), (100, hot, 5), (100, hot, 5), (5800, [-x for x in hot], -4)]


@pytest.mark.parametrize("part", [C.PART, 40])
def test_equals_brute_force(frame, part):
    rows = corpus(part)
    found = C.hard_negatives(frame(rows, VECTORS, ("row", "x", "cell", "anchor")), part=part).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_empty_tables(frame):
    assert C.hard_negatives(frame([], VECTORS)).collect() == []
    assert C.hard_negatives(frame([(1, [1.0], 2), (2, [1.0], 3)], VECTORS)).collect() == []  # no anchor


def tree_of(x, labels=None, leaf=8):
    m2 = float((x.astype(float) ** 2).sum(1).max())
    n = len(x)
    return C.CoverTree.build(x, np.arange(n), np.arange(n), np.zeros(n, int) if labels is None else labels, m2, leaf)


def test_covering_and_bounds():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (600, 3))
    tree = C.CoverTree.loads(tree_of(x).dumps())
    assert sorted(tree.rows.tolist()) == list(range(600))
    top = C.lifted(tree.x, tree.m2)

    def under(node):
        a, b = tree.own[node]
        return [*range(a, b), *(r for k in range(*tree.kids[node]) for r in under(k))]

    q = rng.integers(-200, 200, 3)
    for node in range(len(tree.radius)):
        rows = under(node)
        assert C.chords(top[rows], C.lifted(tree.centre[[node]], tree.m2)[0], tree.m2).max() <= tree.radius[node] + 1e-6 * tree.m
        low, high = C.interval(tree.centre[[node]] @ q, tree.radius[[node]], float(np.sqrt(q @ q)), tree.m)
        s = tree.x[rows] @ q
        assert low[0] <= s.min() and s.max() <= high[0]


def test_search_is_exact_and_skips_most_rows():
    rng = np.random.default_rng(4)
    hubs = rng.normal(0, 300, (40, 16))
    x = np.floor(hubs[rng.integers(0, 40, 4000)] + rng.normal(0, 10, (4000, 16))).astype(np.int64)
    labels = rng.integers(0, 5, 4000)
    tree, scored = tree_of(x, labels, 32), 0
    for a in range(40):
        s = x @ x[a]
        for lo, hi in ((-C.FAR, C.FAR), (int(0.8 * s[a]), int(0.95 * s[a]))):
            best = C.Best([lo], [hi], [lo], 5)
            scored += tree.search(x[a], labels[a], a, False, best)
            want = [r for r in np.lexsort((np.arange(4000), -s)) if labels[r] != labels[a] and lo <= s[r] <= hi][:5]
            assert best.found[0][2].tolist() == want
    assert scored < 0.2 * 80 * 4000


def test_large_components():
    x = np.array([[C.LARGEST, 0], [C.LARGEST, 1], [C.LARGEST, 2], [-C.LARGEST, 5]], np.int64)
    best = C.Best([-C.FAR], [C.FAR], [-C.FAR], 2)
    tree_of(x, leaf=1).search(x[1], 0, 1, True, best)
    assert best.found[0][0].tolist() == [C.LARGEST ** 2 + 2, C.LARGEST ** 2]
