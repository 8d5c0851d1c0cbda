import os
import random
import re
import subprocess
import sys
from itertools import product

import numpy as np
import pytest

from lonja.llm import semicrf as C

DOCS = "doc_id long, text string"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and C.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


def sample(rng):
    parts = ["a@b.co", "x.y@z", "@", "a@b.c.d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (286) 555-5136", "+12", "+44 20 7946 0958)", "word", "ä", "5",
             "é@x.yz", "%+@a-b.c", "+1+2 345 678 901", "\n", ".", "--", "12345678901234567890123"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", ",", ". "]) for _ in range(rng.randint(0, 14)))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        text = sample(rng)
        assert C.base_spans(text) == plain_base(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 100_000, "+" * 100_000, "a@" * 60_000, "1.2." * 50_000, "9 " * 100_000, "+1 " * 60_000):
        C.base_spans(text)
        list(C.islands(text))


def every_segmentation(n, segments):
    def go(at):
        if at == n:
            yield []
            return
        for rest in go(at + 1):
            yield rest
        for x, (i, j, _) in enumerate(segments):
            if i == at:
                for k in range(len(C.KINDS)):
                    for rest in go(j):
                        yield [(x, k), *rest]

    return list(go(0))


def test_dynamic_program_and_likelihood_equal_enumeration():
    rng = np.random.default_rng(4)
    tokens, segments = C.candidates("id 12-3 (4)", 3, 11)
    w = rng.normal(size=(len(segments), len(C.KINDS)))
    listed = [(i, j, [x]) for x, (i, j, _) in enumerate(segments)]
    ways = every_segmentation(len(tokens), segments)
    score = np.array([sum(w[x, k] for x, k in way) for way in ways])
    gold_way = max(ways, key=len)
    gold = {(segments[x][0], segments[x][1]): k for x, k in gold_way}
    value, slope = C.log_likelihood(len(tokens), listed, gold, w)
    z = np.log(np.exp(score).sum())
    assert np.isclose(value, sum(w[x, k] for x, k in gold_way) - z)
    p = np.exp(score - z)
    for x, k in product(range(len(segments)), range(len(C.KINDS))):
        expected = sum(q for q, way in zip(p, ways) if (x, k) in way) - ((x, k) in gold_way)
        assert np.isclose(slope[x, k], expected)
    model = C.SemiMarkov({f"f{x}": w[x].tolist() for x in range(len(segments))})
    steps = [(*span, [(j - i, tokens[j - 1][1], (f"f{x}",)) for x, (i, j, _) in enumerate(segments) if i == t]) for t, span in enumerate(tokens)]
    best = model.best(iter(steps))
    found = sum(max(w[x]) for _, a, b in best for x, (i, j, _) in enumerate(segments) if (tokens[i][0], tokens[j - 1][1]) == (a, b))
    assert np.isclose(found, score.max())


def listed_spans(model, text):
    """Spans from the list of all candidates of every island."""
    out = []
    for start, end in C.islands(text):
        tokens, segments = C.candidates(text, start, end)
        value, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            value[j] = value[j - 1]
            for i, k, features in segments:
                s, kind = model.top(features)
                if k == j and s > 0 and value[i] + s > value[j]:
                    value[j], back[j] = value[i] + s, (i, kind)
        j, found = len(tokens), []
        while j:
            if back[j] is None:
                j -= 1
            else:
                found.append((C.KINDS[back[j][1]], tokens[back[j][0]][0], tokens[j - 1][1]))
                j = back[j][0]
        out += found[::-1]
    return out


def test_the_streamed_program_equals_the_listed_one():
    rng, model = random.Random(3), C.fit(texts(1, 100))
    parts = ["12", "ab", "a1b2", "@", ".", " ", "  ", "+", "(", ")", "-", "key=", "\n", "1.2.3.4", "4111 1111 1111 1111", "0f" * 9]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert model.spans(text) == listed_spans(model, text)


@pytest.mark.parametrize("text", ["' '.join(map(str, range(100_000)))", "'1.' * 300_000"])
def test_memory_on_long_numeric_texts(text):
    """About 0.6 MB of numbers in one island; lists of all its candidates would take some 2 GB."""
    code = f"import resource; from lonja.llm import semicrf as C; C.all_spans({text}, C.fit(['tel +1 (286) 555-5136 x', 'at 10.1.2.3 x'])); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(out.stdout) < 300


def texts(seed, n):
    rng = random.Random(seed)
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    mail = lambda: f"{rng.choice(['ann', 'bob', 'eve'])}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"
    other = lambda: rng.choice(["Version 2.0.", "chapter 12", "in 1999", "at 4.0", "3,500 items"])
    out = []
    for _ in range(n):
        bits = [rng.choice([ip, phone, mail, other, lambda: "password=" + hexa(18), lambda: f'token = "{hexa(40)}"'])() for _ in range(3)]
        out.append(" then some words ".join(bits) + " end.")
    return out


def test_held_out_spans():
    model = C.fit(texts(1, 300))
    right = wrong = missed = 0
    for text in texts(2, 200):
        truth = {(k, s, e) for k, s, e in C.truth_of(text)}
        found = set(model.spans(text))
        right, wrong, missed = right + len(truth & found), wrong + len(found - truth), missed + len(truth - found)
    assert right / (right + missed) > 0.97 and right / (right + wrong) > 0.97


def test_find_and_mask(frame):
    rows = [(k, t, "en", 1) for k, t in enumerate(texts(3, 150))] + [(500, None, "en", 0), (501, "", None, 0), (None, "mail a@b.cd now", "de", 3), (3, "same 1.2.3.4", "en", 2), (3, "same 1.2.3.4", "en", 2)]
    docs = frame(rows, DOCS + ", lang string, n_chars int", ("spans", "c0"))
    model = C.train(docs)
    found = C.find_pii(docs, model).collect()
    assert len(found) == len(rows)
    for (d, text, *_), r in zip(rows, found):
        base = plain_base(text or "")
        assert (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) == (d, *(sum(k == kind for k, _, _ in base) for kind in C.BASE_KINDS))
        assert {C.joined([s]) for s in base} <= set(r.spans.split(","))
    masked = C.mask_pii(docs, model)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert not r.text or (not plain_base(r.text) and r.n_chars == len(r.text))
    assert C.masked("ab cd ef", [("ip", 0, 5), ("card", 3, 5)]) == "[IP] ef"


def test_empty_table(frame):
    assert C.find_pii(frame([], DOCS)).collect() == []


def test_digits_that_are_no_numbers(frame):
    signs = ["10.0.0.1\u00b2", "1.2.3.\u00b2", "see 1.\u2460.3.4 there", "\u00b9.\u00b2.\u00b3.4", "1.2.3.\u0664", "at 10.0.0.1\u2075 a@b.cd"]
    model = C.fit(texts(1, 100) + signs)
    for text in signs:
        assert set(C.base_spans(text)) <= set(C.all_spans(text, model)[1])
    docs = frame([(k, t) for k, t in enumerate(texts(3, 60) + signs)], DOCS)
    assert C.find_pii(docs).count() == 66 and C.mask_pii(docs).filter("text is not null").count() == 66
