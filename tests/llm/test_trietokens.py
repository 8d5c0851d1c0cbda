import math

from hypothesis import given, settings, strategies as st

from lonja.llm import trietokens as K

DOCS = "doc_id long, text string"
SCORES = {K.MARK: -1.0, "a": -1.5, "b": -2.0, "ab": -2.2, K.MARK + "a": -2.0, "abc": -6.0, "bc": -2.5, "aa": -3.0, K.MARK + "ab": -3.5}


def brute(word, scores):
    """Every segmentation of a pre-token."""
    path, low = K.MARK + word, min(scores.values()) - 10.0

    def go(at):
        if at == len(path):
            yield 0.0, 0
            return
        n = len(path[at].encode())
        for s, k in go(at + 1):
            yield s + n * low, k + n
        for end in range(at + 1, len(path) + 1):
            if path[at:end] in scores:
                for s, k in go(end):
                    yield s + scores[path[at:end]], k + 1

    found = list(go(0))
    top = max(s for s, _ in found)
    return {k for s, k in found if math.isclose(s, top, abs_tol=1e-9)}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=6), max_size=8))
def test_equals_every_segmentation(words):
    counter = K.TrieCounter(SCORES)
    distinct, tokens = counter.counts(words)
    assert distinct == len(set(words))
    assert tokens == sum(counter.terminal[w] for w in words)
    for w in words:
        assert counter.terminal[w] in brute(w, SCORES)


def test_shared_prefixes_are_computed_once():
    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            Counting.asked += 1
            return super().get(key, default)

    words = {"a" * 30 + x for x in "abcdefgh"}
    counter = K.TrieCounter(Counting(SCORES))
    counter.add(words)
    together, Counting.asked = Counting.asked, 0
    for w in words:
        K.TrieCounter(Counting(SCORES)).add({w})
    assert together < Counting.asked / 5


def test_bounded_store_gives_the_same():
    words = [f"w{k % 50}" for k in range(300)]
    assert K.TrieCounter(SCORES, keep=7).counts(words) == K.TrieCounter(SCORES).counts(words)


def test_count_tokens(frame):
    rows = [(1, "the cat\nsat  the"), (2, None), (3, ""), (None, "x"), (4, "漢字 😀"), (4, "漢字 😀"), (5, "z" * 5000)]
    out = {r.doc_id: r for r in K.count_tokens(frame(rows, DOCS, ("n_tokens", "word"))).collect()}
    counter = K.TrieCounter(K.pieces(K.default_vocabulary()))
    for d, t in rows:
        words = (t or "").split()
        assert tuple(out[d])[1:] == (len(words), *counter.counts(words))
    assert out[1].n_tokens >= 4 and out[2].n_tokens == 0
    assert K.count_tokens(frame([], DOCS)).collect() == []
