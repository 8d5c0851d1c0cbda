import hashlib
import random
from zlib import crc32

import pytest

from lonja.llm import convtrie as C

TURNS = "conv_id long, turn long, role string, text string"


def brute(paths):
    """All nodes of {conv_id: list of (role, text)}."""
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    out = []
    for pre, members in nodes.items():
        under = [p for p in nodes if p[:len(pre)] == pre]
        kids = sum(len(p) == len(pre) + 1 for p in under)
        leaves = sum(not any(q[:len(p)] == p and len(q) > len(p) for q in under) for p in under)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p)
        out.append((min(members), len(pre), min(nodes[pre[:-1]]) if pre else None, len(members), kids, leaves, saved, sha([c for c in members if len(paths[c]) == len(pre)])))
    return sorted(out, key=lambda r: r[:2])


def ordered(rows):
    paths = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        paths.setdefault(c, []).append((r or "", x or ""))
    return paths


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h, base = crc32(str(c).encode()) % 6, c - int(c / 100) * 100
        out[c] = paths.get(c - base, [])[:h] + own[h:]
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "no conversation"), (700, None, None, None), (700, 0, "user", "\U0001f600"), (700, 1, "user", ""), (-5, 0, "a", "b"), (-205, 2, "a", "bc")]
    for c in range(n):
        c = rng.choice([c, 100 + c, 300 + c])
        rows = [r for r in rows if r[0] != c]
        rows += [(c, t, rng.choice("ua"), rng.choice(["x", "yy", ""])) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    return rows


@pytest.mark.parametrize("width", [8, 1, 2])
def test_equals_brute_force(frame, width):
    rows = corpus(width)
    found = C.prefix_trie(*C.with_shared_heads(*C.placed(frame(rows, TURNS, ("top", "len", "tid")))), width=width, widest=2).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[:2]) == brute(rebuilt(ordered(rows)))


def test_long_shared_and_lone_conversations(frame, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 7)
    same = [(c, t, "user", f"turn {t}") for c in range(50, 80) for t in range(45)]  # shared over several blocks
    rows = same + [(50, 45, "bot", "one more")] + [(9, t, "user", f"turn {t}" if t < 20 else f"own {t}") for t in range(90)] + [(8, t, "u", "alone") for t in range(30)]
    found = C.conversation_trie(frame(rows, TURNS)).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[:2]) == brute(ordered(rows))


def test_repeated_rows_and_empty_table(frame):
    rows = [(1, 3, "u", "same")] * 40 + [(2, 3, "u", "same")] * 39
    found = C.conversation_trie(frame(rows, TURNS)).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[:2]) == brute(ordered(rows))
    assert C.conversation_trie(frame([], TURNS)).collect() == []
