"""Statistics of whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """The same number for the same word, from 0 in order of appearance."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)


def repeat_words(ids: np.ndarray, size: int = 3) -> int:
    """Words inside ``size``-word windows that are found twice or more, the first finding included."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    key, base = ids[:n].copy(), int(ids.max()) + 1
    for k in range(1, size):
        if base ** (k + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + ids[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[k:k + n] |= twice
    return int(covered.sum())


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(word_numbers(words)))


#: Names of the columns of ``quality_vector``.
VECTOR = ("log_words", "log_word_length", "symbols", "stops", "marks", "upper", "digits", "distinct", "repeats",
          "dup_lines", "same_as_next", "top_word", "line_length", "entropy")


def quality_vector(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; zeros for a text without words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if n == 0:
        return [0.0] * len(VECTOR)
    ids = word_numbers(words)
    counts = np.bincount(ids)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = len(raw)
    share = size[size > 0] / total
    symbols = sum(int(size[b]) for b in SYMBOLS)
    stops = int(size[46] + size[63] + size[44] + size[59] + size[58])
    marks = int(size[33] + size[34] + size[40] + size[41] + size[61] + size[64] + size[95] + size[126])
    upper, digits = int(size[65:91].sum()), int(size[48:58].sum())
    log_n = np.log1p(n)
    return [log_n, np.log((total - int(size[32] + size[9:14].sum())) / n), np.log1p(symbols / n), np.log1p(stops / n), np.log1p(marks / n),
            upper / total, np.log1p(10 * digits / total), len(counts) / n, repeat_words(ids) / n, (len(lines) - len(set(lines))) / len(lines),
            float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, float(counts.max()) / n, np.log1p(total / len(lines)), float(-(share * np.log(share)).sum())]
