import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from lonja.llm import packing as P

DOCS = "doc_id long, text string"


def brute(sizes, capacity):
    """Fill lengths by trying every open sequence and adding up all squares."""
    fill = []
    for s in sizes:
        fits = [i for i, b in enumerate(fill) if b + s <= capacity]
        if not fits:
            fill.append(s)
            continue

        def cost(i):
            count = Counter(b + s * (j == i) for j, b in enumerate(fill))
            return sum(v * v for k, v in count.items() if k < capacity), -fill[i]

        fill[min(fits, key=cost)] += s
    return sorted(fill)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=50))))
def test_places_where_squares_become_smallest(case):
    capacity, sizes = case
    sizes = sorted(sizes, reverse=True)
    number, offset = P.sum_of_squares(np.array(sizes, dtype=np.int64), capacity)
    fill = defaultdict(int)
    for n, o, s in zip(number.tolist(), offset.tolist(), sizes):
        assert fill[n] == o
        fill[n] += s
    assert sorted(fill.values()) == brute(sizes, capacity)


def test_cuts():
    assert P.cuts(1, 4) == [(0, 1)] and P.cuts(4, 4) == [(0, 4)] and P.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and P.cuts(8, 4) == [(0, 4), (4, 4)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.sampled_from(["<|endoftext|>", "a <|endoftext|>b", "aaaa" * 40, "  \n\n x", "it's 123 ÄÖ 漢字 😀"]))
def test_same_ids_as_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    test_same_ids_as_the_tokenizers_library.t = t = getattr(test_same_ids_as_the_tokenizers_library, "t", None) or Tokenizer.from_file(P.default_vocabulary())
    text = text.encode("utf-8", "ignore").decode()
    assert P.token_ids(text, P.default_vocabulary(), 2).tolist() == t.encode(text, add_special_tokens=False).ids + [2]


def test_pack_documents(frame):
    rows = [(1, "word " * 700), (2, ""), (None, None), (3, "x y z"), (3, "x y z"), (4, "lorem ipsum " * 40)] + [(k, "a " * (k % 90)) for k in range(10, 300)]
    out = P.pack_documents(frame(rows, DOCS, ("piece", "length", "grp")), capacity=256).collect()
    expected = []
    for d, t in rows:
        ids = P.token_ids(t, P.default_vocabulary(), 2)
        expected += [(d, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(P.cuts(len(ids), 256))]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in out)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(places) <= 1.02 * -(-sum(r.length for r in out) // 256) + 1


def test_equal_rows_are_spread(frame):
    rows = [(None, "the same text")] * 1500 + [(7, "another one")] * 500 + [(k, f"text {k}") for k in range(2000)]
    out = P.pack_documents(frame(rows, DOCS), capacity=64, group_rows=200).collect()
    groups = Counter(r.sequence_id >> 36 for r in out)
    assert len(out) == 4000 and len(groups) == 20 and max(groups.values()) < 300


def test_empty_table(frame):
    assert P.pack_documents(frame([], DOCS)).collect() == []


def test_white_space_runs_of_a_million(frame):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(P.default_vocabulary()), P.default_vocabulary()
    for text in (" " * 1_200_000, "a <|endoftext|>" + "\n" * 1_200_000 + "b"):
        assert P.token_ids(text, path, 2).tolist() == library.encode(text, add_special_tokens=False).ids + [2]
    out = P.pack_documents(frame([(1, " " * 1_200_000), (2, "x y z")], DOCS)).collect()
    assert {r.doc_id for r in out} == {1, 2} and sum(r.length for r in out if r.doc_id == 1) == len(P.token_ids(" " * 1_200_000, path, 2))
