import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lonja.llm import outliers as O
from lonja.llm.textstats import rule_counts

DOCS = "doc_id long, text string, lang string, source string"


def brute_counts(text):
    text = text or ""
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    w = [text[a:b] for a, b in words]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(600):
        text = "".join(rng.choice(["a ", "b ", "é\t", "a b c ", "\n", "#|", "\x85", "\xa0", "a\r\n", "a"]) for _ in range(rng.randint(0, 40)))
        assert rule_counts(text) == brute_counts(text), repr(text)
    assert rule_counts(None) == (0, 0, 0, 0, 0)


def test_chi_square():
    assert math.isclose(O.tail(O.quantile(0.05, 4), 4), 0.05) and math.isclose(O.quantile(0.05, 4), 9.487729, abs_tol=1e-5)
    z = np.random.default_rng(0).normal(size=(200_000, 4))
    d = (z ** 2).sum(1)
    core = d <= np.quantile(d, 0.75)
    assert math.isclose(O.consistency(0.75) * (z[core] ** 2).mean(), 1, rel_tol=0.02)


def test_estimate_finds_the_bulk(spark):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([1.6, 0.5, 0.3, 0.4], np.diag([0.3, 0.2, 0.2, 0.3]) ** 2, 3000)
    bad = rng.normal([6, 4, 3, 5], 0.2, (700, 4))
    rows = [("g", *map(float, x)) for x in np.vstack([good, bad])]
    r = O.mcd(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double")).collect()[0]
    assert np.allclose([r[f"m{i}"] for i in range(4)], good.mean(0), atol=0.05)
    prec = np.zeros((4, 4))
    for i, j in O.PAIRS:
        prec[i, j] = prec[j, i] = r[f"p{i}{j}"] / (1 if i == j else 2)
    scale = np.sqrt(np.diag(np.linalg.inv(prec)))
    assert np.allclose(scale, np.hypot(good.std(0), O.FLOORS), rtol=0.25)


def test_smallest_determinant_on_a_small_group(spark):
    """The core found has a determinant near that of the best of all cores."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (9, 4)), rng.normal(9, 1, (3, 4))])
    rows = [("g", *map(float, v)) for v in x]
    r = O.mcd(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double")).collect()[0]
    floor = np.diag(np.square(O.FLOORS))
    best = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) * O.consistency(0.75) + floor)[1] for c in combinations(range(12), 9))
    assert r.logdet <= best + 0.5


def text(rng, n, junk=False):
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + ("###" if junk else "") for _ in range(12)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(k, text(rng, rng.randint(6, 30), k % 10 == 3), ["en", "de", None][k % 3], None if k % 5 == 0 else "s") for k in range(900)]
    return out + [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "few words", "xx", "new"), (None, text(rng, 10), "en", "s"), (2003, text(rng, 20, True), "xx", "new"), (2004, text(rng, 20), "xx", "new"), (2004, "same " * 80, "xx", "new"), (2004, "same " * 80, "xx", "new")]


def test_robust_outliers(frame, rows):
    out = O.robust_outliers(frame(rows, DOCS, ("grp", "x0", "n", "kept"))).collect()
    assert len(out) == len(rows)
    counts = Counter((d, *brute_counts(t)) for d, t, *_ in rows)
    assert Counter(tuple(r)[:6] for r in out) == counts
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out if not r.base_failed}
    clean = [d for d in kept if d is None or d < 2000 and d % 10 != 3]
    assert sum(kept[d] for d in clean) >= 0.99 * len(clean) and not any(kept[d] for d in kept if d is not None and (d == 2003 or d < 2000 and d % 10 == 3))
    assert kept[2004]


def test_empty_table(frame):
    assert O.robust_outliers(frame([], DOCS)).collect() == []


def repeating(rng, share):
    """About 150 words, of which ``share`` lie in one phrase said again and again, the others random."""
    words = text(rng, 13).split()[:150]
    k = int(150 * share) // 3
    return " ".join(["one two three"] * k + words[3 * k:])


def test_repeats_and_a_block_of_junk_are_rejected(frame):
    rng = random.Random(11)
    clean = [(k, text(rng, rng.randint(8, 30)), "en", "s") for k in range(600)]
    repeats = [(1000 + k, repeating(rng, 0.45), "en", "s") for k in range(20)]
    block = [(2000 + k, text(rng, rng.randint(8, 30)), "de", "s") for k in range(400)] + [(3000 + k, text(rng, 12, True), "de", "s") for k in range(200)]
    out = O.robust_outliers(frame(clean + repeats + block, DOCS)).collect()
    assert not any(r.base_failed for r in out)
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[d] for d in kept if 1000 <= d < 2000) and not any(kept[d] for d in kept if d >= 3000)
    good = [d for d in kept if d < 1000 or 2000 <= d < 3000]
    assert sum(kept[d] for d in good) >= 0.99 * len(good)


def test_mcd_does_not_depend_on_the_way_of_the_join(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(g, *map(float, x)) for g, n in (("a", 300), ("b", 120), ("c", 9)) for x in rng.normal(size=(n, 4))]
    points = spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double")
    whole, inner = O.mcd(points).orderBy("grp").collect(), O.join_groups
    monkeypatch.setattr(O, "join_groups", lambda *a: inner(*a, heavy=2))  # nearly all groups by the shuffle
    split = O.mcd(points).orderBy("grp").collect()
    assert [r.grp for r in whole] == [r.grp for r in split] == ["a", "b", "c"]
    for a, b in zip(whole, split):
        assert a.n == b.n and np.allclose([a.m0, a.m3, a.p00, a.p13], [b.m0, b.m3, b.p00, b.p13])
