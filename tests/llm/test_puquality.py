import random
import zlib

import numpy as np

from lonja.llm import puquality as Q

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int"


def test_risk_and_slopes():
    rng = np.random.default_rng(1)
    p, u = rng.normal(size=20), rng.normal(size=30)
    for prior in (0.3, 0.7):
        value, sp, su = Q.risk_slopes(p, u, prior)
        plus = prior * np.log1p(np.exp(-p)).mean()
        minus = np.log1p(np.exp(u)).mean() - prior * np.log1p(np.exp(p)).mean()
        assert np.isclose(value, plus + max(minus, 0))
        if minus > 0:
            for k in range(3):
                d = np.zeros(20)
                d[k] = 1e-6
                assert np.isclose((Q.risk_slopes(p + d, u, prior)[0] - value) / 1e-6, sp[k], atol=1e-4)
    value, sp, su = Q.risk_slopes(np.full(5, 4.0), np.full(5, -4.0), 0.9)  # the negative part is below 0: its slope is reversed
    assert np.isclose(value, 0.9 * np.log1p(np.exp(-4))) and (su < 0).all()


def test_class_prior():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.6, 0.85):
        u = np.concatenate([rng.normal(2, 1, int(8000 * prior)), rng.normal(-2, 1, 8000 - int(8000 * prior))])
        assert abs(Q.class_prior(rng.normal(2, 1, 4000), u) - prior) < 0.06


def corpus(n=1500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.75
        words = [word() for _ in range(rng.randint(30, 200))]
        if not good:
            words = [w + "$$$" for w in words] if k % 2 else words[:5] * 30
        rows.append((k, " ".join(words), "en"))
        if k % 2:
            labels.append((k, int(good)))
    return rows, labels, {k: int(" $" not in t and "$$$" not in t and len(set(t.split())) > 5) for k, t, _ in rows}


def test_held_out_accuracy_and_columns(frame):
    rows, labels, truth = corpus()
    extra = [(5000, None, None), (5001, "", "x"), (None, "some text", "x"), (1, rows[1][1], "en")]
    docs = frame(rows + extra, DOCS, ("x", "score", "c1"))
    lab = frame(labels + [(1, 0), (7, None), (None, 1)], LABELS)
    out = Q.score(docs, lab).collect()
    assert len(out) == len(rows) + len(extra)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [(truth[r.doc_id], r.score) for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([y == (s >= 0.5) for y, s in test]) > 0.97
    kept = Q.keep_good(docs, lab)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.predicted)


def test_labels_of_the_held_out_fold_do_not_matter(frame):
    rows, labels, _ = corpus(500)
    fold = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    a = Q.score(frame(rows, DOCS), frame(labels, LABELS))
    b = Q.score(frame(rows, DOCS), frame([(d, 1 - q if fold(d) else q) for d, q in labels], LABELS))
    assert sorted(a.collect()) == sorted(b.collect())


def test_empty_tables(frame):
    assert Q.score(frame([], DOCS), frame([], LABELS)).collect() == []
    assert [r.score for r in Q.score(frame([(1, "a b", "x")], DOCS), frame([], LABELS)).collect()] == [0.5]


def test_sample_is_bounded_on_hot_keys(frame, monkeypatch):
    rows, labels, _ = corpus(600)
    hot = [(None, f"text number {k} of no id", "en") for k in range(600)] + [(None, "the same text", "en")] * 600 + [(3, f"other text {k}", "en") for k in range(600)]
    seen = []
    monkeypatch.setattr(Q, "scouted", lambda p, u, *_: seen.append((u, p)) or (p[:, 0], u[:, 0]))
    Q.train(frame(rows + hot, DOCS), frame(labels, LABELS), sample=200)
    x, positive = seen[0]
    same = np.isclose(x, Q.quality_vector("the same text")).all(axis=1).sum()
    fold = sum(zlib.crc32(str(d).encode() if d is not None else b"") % 3 != 1 for d, *_ in rows + hot)
    assert 150 < len(x) <= 200 and positive.any() and abs(same - 600 / fold * 200) <= 2  # equal rows keep their share


def test_few_positives_in_a_large_table_are_all_used(frame, monkeypatch):
    rows, labels, truth = corpus(4000)
    fold = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    few = [(d, 1) for d, q in labels if q and not fold(d)][:50]
    seen, inner = [], Q.scouted
    monkeypatch.setattr(Q, "scouted", lambda p, u, *folds: seen.append((len(p), len(u))) or inner(p, u, *folds))
    out = Q.score(frame(rows, DOCS), frame(few, LABELS), sample=600).collect()
    assert seen[0][0] == 50 and 500 < seen[0][1] <= 600
    test = [(truth[r.doc_id], r.score) for r in out if r.held_out]
    good, bad = [s for y, s in test if y], [s for y, s in test if not y]
    assert np.mean([g > b for g in good[:300] for b in bad]) > 0.97
