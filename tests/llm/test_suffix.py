import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from lonja.llm import suffix as S
from lonja.llm.common import word_bytes

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, window):
    out = []
    for d, text in docs:
        words = word_bytes(text)
        hit, found = set(), set()
        for i, t in items:
            w = word_bytes(t)
            n = min(window, len(w))
            for j in range(len(w) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p:p + n] == w[j:j + n]:
                        hit |= set(range(p, p + n))
                        found.add("" if i is None else str(i))
        out.append((d, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["Der", "a", "b", "c,", "Ä", "7"]) for _ in range(n))
    items = [(k, say(rng.randint(0, 9))) for k in range(6)] + [(2, "a b c"), (None, "c a c"), (9, None), (10, "a a a a a a a")]
    docs = [(k, say(rng.randint(0, 60))) for k in range(25)] + [(1, None), (None, "a b c a b"), (3, ""), (3, "")] + [(50, "a " * 300)]
    docs.append((51, "x y " + items[0][1] + " z"))
    return docs, items


def test_equals_brute_force(frame):
    for seed, (shard, block) in enumerate([(2_000_000, 32 << 20), (40, 24), (1, 60)]):
        docs, items = cases(seed)
        found = S.find_contamination(frame(docs, DOCS, ("state", "items", "n_words")), frame(items, ITEMS), window=4, block_bytes=block, shard_words=shard).collect()
        assert sorted((tuple(r)[:6] for r in found), key=str) == brute(docs, items, 4)


def test_longest_match_and_place(frame):
    item = "one two three four five six"
    r = S.find_contamination(frame([(1, "zero two three four five nine"), (2, "nothing here")], DOCS), frame([(5, item)], ITEMS), window=2).collect()
    r = {x.doc_id: x for x in r}
    assert (r[1].longest_match, r[1].longest_item, r[1].longest_start, r[1].spans) == (4, "5", 1, [1, 5])
    assert (r[2].longest_match, r[2].longest_item, r[2].spans) == (0, None, [])


def test_removal_keeps_columns(frame):
    docs = frame([(1, "a b c d", "en"), (2, "x", "de"), (3, None, None)], DOCS + ", lang string", ("state", "c1"))
    out = S.remove_contaminated(docs, frame([(1, "b c d")], ITEMS))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_empty_tables(frame):
    none, one = frame([], DOCS), frame([(1, "a")], DOCS)
    assert S.find_contamination(none, frame([(1, "a")], ITEMS)).collect() == []
    assert [r.contaminated for r in S.find_contamination(one, frame([], ITEMS)).collect()] == [False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(words):
    w = np.array(words, dtype=np.uint32)
    order = S.suffix_array(w, 64).tolist()
    assert order == sorted(range(len(words)), key=lambda p: words[p:])


def test_memory_of_a_book_length_item():
    import tracemalloc

    rng = random.Random(6)
    words = ["w%d" % rng.randrange(5000) for _ in range(6000)]
    text = " ".join(words)
    tracemalloc.start()
    bench = S.Benchmark([("book", text), ("copy", text), ("tail", " ".join(words[3000:])), ("flat", "la " * 3000)], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # whole suffixes as keys took 97 MB
    state = S.scan_texts([None, "x " + " ".join(words[2000:4000]) + " y", "la " * 50], [None] * 3, bench, 2_000_000)
    assert [x["items"] for x in state] == [[], ["book", "copy", "tail"], ["flat"]]
    assert (state[1]["longest"], state[1]["longest_item"], state[1]["longest_start"], state[1]["spans"]) == (2000, "book", 1, [1, 2001])
    assert state[2]["longest"] == 50
