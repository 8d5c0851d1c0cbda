import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lonja.llm import exactdedup as X

DOCS = "doc_id long, text string"


def brute(rows):
    """Rows by normalised text, the best row first."""
    groups = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[re.sub("[ \t-\r]", "", t or "")].append((-len(t or ""), d is None, d or 0, k, d))
    out = []
    for norm, members in groups.items():
        members.sort()
        for m in members:
            out.append((m[4], members[0][4], len(members), m is members[0], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "a\x0b\x0cb"), (904, "ab"), (905, "a b"), (906, "\U0001f600 x"), (None, "ab"), (None, None),
            (907, "long " * 50_000), (908, "long" * 50_000)]
    for _ in range(40):
        base = "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        rows += [(rng.randint(0, 60), " " * rng.randint(0, 2) + " ".join(base)) for _ in range(rng.randint(1, 12))]
    return rows + [(77, "hot copy")] * 300


# a weak hash makes nearly every group a collision, which the comparison of bytes has to undo
@pytest.mark.parametrize("digest", [X.content_hash, lambda t: F.unhex(F.substring(F.md5(t), 1, 2)), lambda t: F.lit(b"")])
def test_equals_brute_force(frame, digest):
    rows = corpus(5)
    out = X.exact_groups(frame(rows, DOCS, ("h", "norm", "kept", "row", "group_size")), digest)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute(rows)


def test_rows_that_stay(frame):
    docs = frame([(1, "a b", "x"), (2, "a  b", "y"), (2, "a  b", "y"), (3, None, "z"), (4, "", "z"), (None, "q", None)], DOCS + ", lang string", ("_id", "h"))
    out = X.without_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.lang) for r in out.collect()) == [(0, "q", None), (2, "a  b", "y"), (3, None, "z")]


def test_empty_table_and_shuffled_hashes(frame, monkeypatch):
    assert X.exact_groups(frame([], DOCS)).collect() == []
    monkeypatch.setattr(X, "BROADCAST_KEYS", 1)
    rows = corpus(6)
    assert sorted([tuple(r) for r in X.exact_groups(frame(rows, DOCS)).collect()], key=str) == brute(rows)
