import random
from fractions import Fraction

import numpy as np
import pytest

from lonja.llm import minhash as M
from lonja.llm.components import components

DOCS = "doc_id long, text string"


def brute(rows, limit=Fraction(4, 5)):
    """Class and links of every row by comparing all pairs of shingle sets."""
    hashes = M.WordHashes()
    sets = [set(M.shingles(t, 5, hashes).tolist()) for _, t in rows]
    ids, up, links = [d for d, _ in rows], list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if union == 0 or limit.denominator * both >= limit.numerator * union:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                if a != b:
                    up[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return sorted((ids[i], ids[root(i)], links[i]) for i in range(len(rows)))


def corpus(seed, groups=12, most=30):
    rng = random.Random(seed)
    rows = [(1000, ""), (1001, None), (1002, "two words"), (1003, "Two words!"), (1004, "...")]
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(4, 160))]
        for _ in range(rng.randint(1, most)):
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [400, 5])
def test_equals_brute_force(frame, block):
    rows = corpus(3)
    found = M.link_documents(frame(rows, DOCS, ("key", "node", "digest")), block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == brute(rows)


def test_one_of_each(frame):
    rows = [(5, "a b c d e f", "en"), (2, "A b c d e, f", "de"), (7, "other text that stands alone here", None), (7, "other text that stands alone here", None), (None, "no id here at all today", "x"), (9, None, "y"), (8, "", "y")]
    docs = frame(rows, DOCS + ", lang string", ("key", "class_id", "c0"))
    out = M.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.lang or "") for r in out.collect()) == [(0, "x"), (2, "de"), (7, ""), (8, "y")]


def test_empty_table(frame):
    assert M.link_documents(frame([], DOCS)).collect() == []
    assert M.one_of_each(frame([], DOCS)).collect() == []


def test_recall_of_the_forest():
    depth = M.matched_depth(0.8, 0.9999, 8, 32)
    assert M.recall(0.8, depth, 32) >= 0.9999 > M.recall(0.8, depth + 1, 32)
    forest, rng, hit = M.Forest(32, 8), np.random.default_rng(1), 0
    for _ in range(400):
        a = rng.integers(0, 1 << 63, 160).astype(np.uint64)
        b = np.concatenate([a[:142], rng.integers(0, 1 << 63, 18).astype(np.uint64)])  # similarity 0.798
        hit += bool((forest.labels(np.unique(a)) == forest.labels(np.unique(b)))[:, :depth].all(axis=1).any())
    assert hit >= 398


@pytest.mark.parametrize("part_rows", [100_000, 7])
def test_sorted_tries_hold_every_shared_prefix(spark, part_rows):
    rng, forest = np.random.default_rng(5), M.Forest(6, 5)
    labels = rng.integers(0, 2, (70, 6, 5))
    labels[40:65, :3] = labels[0, :3]  # a hot prefix over many parts
    rows = [(100 - k, bytearray(x.astype(">u2").tobytes())) for k, x in enumerate(labels)]
    links = [tuple(r) for r in M.trie_links(spark.createDataFrame(rows, "node long, labels binary"), forest, 2, part_rows).collect()]
    for depth in (5, 4, 3, 2):
        up = {n: n for n, _ in rows}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for u, v, d in links:
            if d >= depth:
                up[max(root(u), root(v))] = min(root(u), root(v))
        found = {n: root(n) for n in up}
        up = {n: n for n, _ in rows}
        for tree in range(6):
            first = {}
            for k, x in enumerate(labels):
                a, b = root(first.setdefault(tuple(x[tree, :depth]), 100 - k)), root(100 - k)
                up[max(a, b)] = min(a, b)
        assert found == {n: root(n) for n in up}


def near(count, words, changes, seed):
    """Pairs of texts of which the second has ``changes`` words of the first replaced, far apart."""
    rng, rows = random.Random(seed), []
    for k in range(count):
        w = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(words)]
        rows.append((2 * k, " ".join(w)))
        for j in range(changes):
            w[10 + j * 30] = "other"
        rows.append((2 * k + 1, " ".join(w)))
    return rows


def test_prefixes_are_shortened_by_what_the_corpus_holds(frame, monkeypatch):
    stopped, inner = [], M.verified_links
    monkeypatch.setattr(M, "verified_links", lambda *a: stopped.append(inner(*a)) or stopped[-1])
    for rows in (near(30, 400, 2, 1), near(30, 400, 8, 2)):  # similarities of 0.95 and 0.82
        found = M.link_documents(frame(rows, DOCS)).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == brute(rows)
    assert [depth for _, depth in stopped] == [8, 6]


def test_recall_against_all_pairs(frame):
    rows = near(150, 300, 6, 3) + [(1000 + d, t) for d, t in corpus(8, 10, 20)[5:]]
    found = {r.doc_id: r.n_links for r in M.link_documents(frame(rows, DOCS)).collect()}
    expected = {d: n for d, _, n in brute(rows)}
    assert sum(found.values()) >= 0.999 * sum(expected.values()) > 300 and all(found[d] <= n for d, n in expected.items())


def test_intersections_in_column_blocks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(25)]
    got = M.intersections(sets[:12], sets[12:], columns=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 180)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(500, k) for k in range(501, 540)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    found = {r["node"]: r["class"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for x in list(up)}
