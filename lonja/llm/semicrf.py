"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give e-mail, IP, card and phone spans; these always stay. The field looks at islands
(chunks with a digit or @, and the chunks of that kind beside them), scores every candidate segment
of at most ``MAX_TOKENS`` tokens by features of the whole span, and a dynamic program over segment
ends chooses boundaries and types jointly. Its spans are added where they touch no pattern span:
kinds as above, where a pattern missed one, and ``secret`` (keys, passwords, tokens).

Training is distant supervision: pattern spans, and for secrets ``SEEDS``, are the truth of a
bounded sample of islands (``sample_islands``, from about ``sample_docs`` documents, both chosen by
hash); the conditional likelihood is maximised by exact forward-backward. The fitted weights are a
small table of at most ``sample_islands`` x a few features, sent to every task. Everything else is
one pass over the whole texts without a shuffle.

Defined cases: null and empty texts have no spans; repeated rows are reported as often as they come;
an empty table gives an empty result, and without any island in the sample nothing is added; equal
scores prefer no span, then the longer history; other columns are ignored by ``find_pii`` and kept
by ``mask_pii``. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_TOKENS = 16
#: Sure signs of a secret's value, for training only.
SEEDS = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<=[=:])[0-9a-f]{16,}(?![0-9A-Za-z])|(?<=[=:]\s\")[0-9a-f]{16,}(?=\")|(?<=[=:]\")[0-9a-f]{16,}(?=\")")

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[^\W_]+|_|[^\w\s]")
_INSIDE = set(".@+-_%()/")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans by kind as listed, then start. Linear in the text for every pattern."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:  # [local]+@domain: the local part is all that stands before the @
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _TRIGGER.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = re.sub(r"[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of white-space separated chunks with a digit or @, joined where one space stands between."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        s, e = m.span()
        while s > max(end, 0) and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        if end >= 0 and s == end + 1 and text[end] == " ":
            end = e
            continue
        if end >= 0:
            yield start, end
        start, end = s, e
    if end >= 0:
        yield start, end


def _side(c: str) -> str:
    return "_" if not c or c.isspace() else "9" if c.isdigit() else "a" if c.isalpha() else c


def _tokens(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, int, bool, str]]:
    """Tokens of an island: start, end, kind (word, digit or mixed token, allowed mark, other), digits, trigger, shape mark."""
    for m in _TOKEN.finditer(text, start, end):
        t = m[0]
        kind = "w" if t.isalpha() else "d" if t[0].isalnum() else "m" if t in _INSIDE else "x"
        n = sum(map(str.isdigit, t)) if kind == "d" else int(t.isdigit())
        mark = t if kind == "m" else "a" if not n else "9" if n == len(t) else "x" if len(t) >= 12 else "b"
        yield *m.span(), kind, n, n > 0 or t == "@", mark


def segments(text: str, start: int, end: int) -> Iterator[tuple[int, int, list[tuple[int, int, tuple[str, ...]]]]]:
    """Per token of an island: its start and end, and the candidate segments that begin there (tokens, end, whole-span features).

    Only a window of ``MAX_TOKENS`` tokens is held.
    """
    source, window = _tokens(text, start, end), deque()
    while True:
        while len(window) < MAX_TOKENS and (token := next(source, None)):
            window.append(token)
        if not window:
            return
        s, found = window[0][0], []
        if not (window[0][2] == "x" or window[0][2] == "m" and text[s] not in "+("):
            head = text[max(0, s - 40):s]
            before = head.rstrip(" \"'")
            word = re.search(r"([^\W\d_]+)\W*$", head)
            context = ("ctx:" + word[1].lower()[:16] if word and (before[-1:] in "=:") else "ctx:", f"asg:{before[-1:] in '=:' and bool(before)}")
            left = f"left:{_side(text[s - 1:s])}"
            trigger, shape, digits, last = False, "", 0, None
            for size, token in enumerate(window, 1):
                ts, te, kind, n, hit, mark = token
                gap = ts - last[1] if last else 0
                if kind == "x" or gap and (gap > 1 or text[ts - 1] != " " or kind == "w" or last[2] == "w"):
                    break
                digits, trigger, shape, last = digits + n, trigger or hit, shape + " " * (gap > 0) + mark, token
                if not trigger or kind == "m" and mark != ")":
                    continue
                span = text[s:te]
                number = re.sub(r"[^0-9]", "", span) if 13 <= digits <= 19 else ""
                octets = span.count(".") == 3 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in span.split("."))
                found.append((size, te, (
                    "bias", "shape:" + shape, f"digits:{min(digits, 20)}", f"len:{min(len(span) // 4, 12)}", f"luhn:{bool(number) and luhn(number)}", f"octets:{octets}",
                    f"at:{'@' in span and '.' in span.partition('@')[2]}", left, f"right:{_side(text[te:te + 1])}", *context)))
        yield s, window.popleft()[1], found


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[str, ...]]]]:
    """Tokens of a short island and all its candidate segments (first token, last token + 1, whole-span features)."""
    tokens, out = [], []
    for i, (s, e, found) in enumerate(segments(text, start, end)):
        tokens.append((s, e))
        out += [(i, i + size, features) for size, _, features in found]
    return tokens, out


class SemiMarkov:
    """Weights per feature and kind; a token outside every segment scores 0."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}
        self.cache: dict[tuple[str, ...], list[float]] = {}

    def top(self, features: tuple[str, ...]) -> tuple[float, int]:
        """Score and number of the best kind."""
        found = self.cache.get(features)
        if found is None:
            if len(self.cache) > 20_000:
                self.cache.clear()
            rows = [w for f in features if (w := self.weights.get(f))]
            scores = [sum(c) for c in zip(*rows)] if rows else [-1.0] * len(KINDS)
            k = max(range(len(KINDS)), key=lambda k: scores[k])
            found = self.cache[features] = (scores[k], k)
        return found

    def best(self, found: Iterator[tuple[int, int, list[tuple[int, int, tuple[str, ...]]]]]) -> list[tuple[str, int, int]]:
        """Highest-scoring segmentation of the tokens (bounded-entity Viterbi, one step per token).

        Scores reach ``MAX_TOKENS`` tokens ahead and are dropped behind; per token only its first token back, kind, start and
        end remain, 25 bytes.
        """
        back, kinds, starts, ends = array("q"), array("b"), array("q"), array("q")
        value, ahead = 0.0, {}
        i = 0
        for s, _, segments_ in found:
            if i in ahead and ahead[i][0] > value:
                value, back[i - 1], kinds[i - 1], ends[i - 1] = ahead[i]
            ahead.pop(i, None)
            for size, end, features in segments_:
                score, k = self.top(features)
                if score > 0 and (i + size not in ahead or value + score > ahead[i + size][0]):
                    ahead[i + size] = (value + score, i, k, end)
            back.append(-1)
            kinds.append(0)
            starts.append(s)
            ends.append(0)
            i += 1
        if i in ahead and ahead[i][0] > value:
            value, back[i - 1], kinds[i - 1], ends[i - 1] = ahead[i]
        out = []
        while i > 0:
            if back[i - 1] < 0:
                i -= 1
            else:
                first = back[i - 1]
                out.append((KINDS[kinds[i - 1]], starts[first], ends[i - 1]))
                i = first
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return [span for start, end in islands(text) for span in self.best(segments(text, start, end))]


def log_likelihood(n: int, segments: list[tuple[int, int, list[int]]], gold: dict[tuple[int, int], int], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Conditional log-likelihood of the gold segmentation and, per segment, expected minus gold counts by kind."""
    score = np.array([w[f].sum(0) for _, _, f in segments])
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    total = np.logaddexp.reduce(score, axis=1)
    by_end, by_start = {}, {}
    for x, (i, j, _) in enumerate(segments):
        by_end.setdefault(j, []).append(x)
        by_start.setdefault(i, []).append(x)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[segments[x][0]] + total[x] for x in by_end.get(j, ()))])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[segments[x][1]] + total[x] for x in by_start.get(i, ()))])
    first, last = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
    expected = np.exp(alpha[first][:, None] + score + beta[last][:, None] - alpha[n])
    value = -alpha[n]
    for x, (i, j, _) in enumerate(segments):
        k = gold.get((i, j))
        if k is not None:
            value += score[x, k]
            expected[x, k] -= 1
    return value, expected


def gold_segments(tokens: list[tuple[int, int]], truth: list[tuple[str, int, int]]) -> dict[tuple[int, int], int]:
    first, last = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    out, free = {}, 0
    for kind, s, e in sorted(truth, key=lambda x: (x[1], -x[2])):
        if s in first and e in last and first[s] >= free and last[e] - first[s] <= MAX_TOKENS:
            out[first[s], last[e]] = KINDS.index(kind)
            free = last[e]
    return out


def truth_of(text: str) -> list[tuple[str, int, int]]:
    return base_spans(text) + [("secret", *m.span()) for m in SEEDS.finditer(text)]


def fit(texts: list[str], epochs: int = 6, rate: float = 0.5, decay: float = 1e-3) -> SemiMarkov:
    """Train on short texts, each an island with what stands around it."""
    index: dict[str, int] = {}
    data = []
    for text in texts:
        truth = truth_of(text)
        for start, end in islands(text):
            tokens, segments = candidates(text, start, end)
            if segments:
                data.append((len(tokens), [(i, j, [index.setdefault(f, len(index)) for f in fs]) for i, j, fs in segments], gold_segments(tokens, truth)))
    w, seen = np.zeros((len(index), len(KINDS))), np.full((len(index), len(KINDS)), 1e-6)
    for _ in range(epochs):
        for n, segments, gold in data:
            _, slope = log_likelihood(n, segments, gold, w)
            step: dict[int, np.ndarray] = {}
            for (_, _, fs), g in zip(segments, slope):
                for f in fs:
                    step[f] = step.get(f, 0.0) + g
            for f, g in step.items():
                g = g + decay * w[f]
                seen[f] += g * g
                w[f] -= rate * g / np.sqrt(seen[f])
    return SemiMarkov({f: [round(float(x), 6) for x in w[i]] for f, i in index.items()})


def island_texts(text: str, around: int = 48, longest: int = 400) -> list[str]:
    """Islands with their surroundings, cut at white space, for the training sample only."""
    out = []
    for s, e in islands(text):
        if e - s <= longest:
            a, b = max(0, s - around), min(len(text), e + around)
            while 0 < a < s and not text[a - 1].isspace():
                a += 1
            while e < b < len(text) and not text[b].isspace():
                b -= 1
            out.append(text[a:b])
    return out


def train(docs: DataFrame, sample_docs: int = 8000, sample_islands: int = 1500) -> SemiMarkov:
    """Fit on at most ``sample_islands`` islands of about ``sample_docs`` documents, chosen by hash."""
    rows = docs.count()
    text = F.col("text").cast("string")
    share = min(1.0, sample_docs / max(rows, 1))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.octet_length(text))
    chosen = docs.filter(F.pmod(h, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select(text.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for x in b.column(0).to_pylist() for t in island_texts(x or "")], pa.string())], ["t"])

    found = chosen.mapInArrow(cut, "t string").distinct().orderBy(F.xxhash64("t"), "t").limit(sample_islands).collect()
    return fit([r.t for r in found])


def all_spans(text: str, model: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Pattern spans, and pattern and added spans together; both by kind as listed, then start."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added, k = [], 0
    for kind, s, e in model.spans(text) if _TRIGGER.search(text) else ():
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if not any(a < e and s < b for a, b in taken[k:k + 4]):
            added.append((kind, s, e))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """Per document: counts of the pattern kinds, their digest, and all spans."""
    model = model or train(docs)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = SemiMarkov(weights.value)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base, every = all_spans(text or "", field)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, FOUND)


def mask_pii(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """The documents with every span replaced by [KIND]; all columns stay, n_chars (if there) follows the text."""
    model = model or train(docs)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    names = docs.columns
    inner = ["text" if n == "text" else f"c{i}" for i, n in enumerate(names)]

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = SemiMarkov(weights.value)
        for b in batches:
            new = [t and masked(t, all_spans(t, field)[1]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else b.column(n) for n in b.schema.names], b.schema.names)

    df = docs.toDF(*inner)
    out = df.mapInArrow(mask, df.schema).select(*[F.col(a).alias(b) for a, b in zip(inner, names)])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
