"""Sum-of-squares packing of token sequences.

Every document is tokenized once; its pieces (document, piece, length, checksum; never tokens) are written
with a row number, and that number deals them to groups of about ``group_rows`` pieces, each packed by itself.
Rows that repeat one document, with or without a doc_id, are thus spread like all others, and no task sees
more than a bounded share; the loss against one global packing is the few sequences at each group's end.

Inside a group, pieces come longest first. A piece goes to the open sequence for which the sum over
all residual gaps of (open sequences with that gap) squared becomes smallest; among equals the
fullest one is taken. A new sequence is opened only if the piece fits no open one.

Defined cases: a null or empty text is the end token alone; repeated rows are packed as often as
they come; ties are broken by doc_id, piece and checksum; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lonja.llm.common import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, object] = {}
_LIBRARY: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """tiktoken over the vocabulary of a byte-level BPE file of ``tokenizers``: the same ids, several times faster."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def library_ids(text: str, path: str) -> list[int]:
    """The ids by the ``tokenizers`` library itself."""
    if path not in _LIBRARY:
        from tokenizers import Tokenizer

        _LIBRARY[path] = Tokenizer.from_file(path)
    return list(_LIBRARY[path].encode(text, add_special_tokens=False).ids)


def token_ids(text: str | None, path: str, end_id: int) -> np.ndarray:
    try:
        ids = encoder(path).encode(text or "", allowed_special="all")
    except ValueError:  # its pattern gives up on white-space runs of about a million characters
        ids = library_ids(text, path)
    ids.append(end_id)
    return np.asarray(ids, dtype="<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``lengths`` come in the order of placing."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by filled length
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        level = 0
        if size < capacity:
            before, after = count[1:capacity - size + 1], count[size + 1:capacity + 1]
            change = 2 * (after - before) + 2
            change[-1] -= 1  # a full sequence is closed, so no square grows
            change[before == 0] = np.iinfo(np.int64).max
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            level = best + 1 if before[best] else 0
        if level:
            count[level] -= 1
            where[i] = open_at[level].pop()
        else:
            where[i], opened = opened, opened + 1
        offset[i] = level
        if level + size < capacity:
            count[level + size] += 1
            open_at[level + size].append(int(where[i]))
    return where, offset


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, group_rows: int = 131_072) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and text. ``vocabulary`` is the path of a byte-level BPE file that every
    executor can open (by default the installed public one).
    """
    path = vocabulary or default_vocabulary()

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = token_ids(text, path, end_id)
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * (1 << 36) + number, offset=offset).drop(columns="grp")

    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    pieces = docs.select(doc_id, F.col("text").cast("string").alias("text")).mapInPandas(tokenize, PIECES)
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    grp = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-pieces.count() // group_rows)))).alias("grp")
    return pieces.withColumn("grp", grp).drop("row").groupBy("grp").applyInPandas(place, PIECES + ", sequence_id long, offset long")
