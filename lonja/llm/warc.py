"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing. Records are made with SQL functions and written by Spark's text writer, whose line separator
is the record end. Of pages with equal payloads the one with the largest page_id is a ``response``; the
others are ``revisit`` records without payload. The list of revisits is written first, so Spark
broadcasts it only where its size allows and else joins by page_id, never by payload; no hot payload
meets in one task.

Reading. Spark's text reader cuts the files, any split of them, at record end plus magic; that
separator can't overlap itself, so all splits cut alike. Every piece is a candidate record: its offset
(prefix sums over pieces and splits) and, by its Content-Length, its successor's. Inside a split each
candidate is jumped to the first offset outside; across splits pointer jumping doubles from the
file's start. Only records on that chain are kept, so magic inside a payload is rejected, and the
payloads that hold it are put together again from their pieces. A chain that doesn't end at the
end of its file raises an error.

Defined cases: a null html is an empty payload, a null url an empty URI (control characters in URLs
are percent-encoded); a null page_id counts as the smallest and is read back as null; rows that repeat
a page_id and its payload get the same type; an empty table gives an empty archive; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lonja.llm.common import written
from lonja.session import shared_dir

END = "\r\n\r\n"
MAGIC = "WARC/1."
CUT = END + MAGIC
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 SHA-1: every 5 hexadecimal digits are 4 of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html) under ``path``; payloads under ``min_bytes`` are never revisited."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    ids = rows.filter(F.col("size") >= min_bytes).select("page_id", "digest")
    keeper = ids.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null").drop("n")
    revisits = written(ids.join(keeper, "digest").filter("page_id is null or page_id < keeper").distinct(), "revisits")
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "keeper")
    rows = rows.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("keeper").isNotNull()
    uri = F.coalesce(F.col("url"), F.lit(""))
    for c in "\r\n\t":
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("keeper")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


CANDIDATE = ("path string, split long, k long, start long, size long, file_size long, head long, length long, record_type string, record_id string, "
             "refers_to string, uri string, declared string, payload_bytes long, payload_digest string")
_CANDIDATE_TYPES = [pa.int64() if f.split()[1] == "long" else pa.string() for f in CANDIDATE.split(", ")]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def headers_of(raw: bytes) -> dict[bytes, str]:
    lines = (x.partition(b":") for x in raw.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in lines}


def payload_of(block: bytes, record_type: str) -> tuple[int, str | None]:
    """Payload bytes and digest of a record block; of a revisit only the length that its HTTP header names."""
    at = block.find(b"\r\n\r\n")
    http = block[:at] if block.startswith(b"HTTP/") and at >= 0 else b""
    if record_type == "revisit":
        return int(headers_of(http).get(b"content-length", "0") or 0), None
    payload = block[at + 4:] if http else block
    return len(payload), digest_of(payload)


def candidate(piece: bytes, first: bool) -> tuple:
    """head, length, type, id, refers_to, uri, declared digest, payload bytes and digest of one piece, as far as it tells."""
    skip = len(MAGIC) if first else 0
    at = piece.find(b"\r\n\r\n")
    if at < 0 or first and not piece.startswith(MAGIC.encode()):
        return (None,) * 9
    fields = headers_of(piece[skip:at])
    length = fields.get(b"content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", length):
        return (None,) * 9
    n, kind = int(length), fields.get(b"warc-type")
    block = piece[at + 4:at + 4 + n]
    size, digest = payload_of(block, kind) if len(block) == n else (None, None)
    return (at + 4 + len(MAGIC) - skip, n, kind, fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"), fields.get(b"warc-target-uri"),
            fields.get(b"warc-payload-digest"), size, digest)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of all splits in their order: path, split, file_size, piece."""
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("piece"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, int, int, int, int, bytes]]]]:
    """Per batch (path, split, number in the split, start in the split, file size, piece)."""
    at, k, start = None, 0, 0
    for b in batches:
        rows = []
        for path, split, size, piece in zip(*(b.column(n).to_pylist() for n in ("path", "split", "file_size", "piece"))):
            if (path, split) != at:
                at, k, start = (path, split), 0, 0
            rows.append((path, split, k, start, size, piece))
            k, start = k + 1, start + len(piece) + len(CUT)
        yield b, rows


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in CANDIDATE.split(", ")]
    for _, rows in _numbered(batches):
        out = [(p, s, k, start, len(x), size, *candidate(x, s == 0 and k == 0)) for p, s, k, start, size, x in rows]
        cols = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CANDIDATE_TYPES)], names)


def _local_exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every candidate of a split the first chained offset outside it."""
    pdf = pdf.sort_values("offset", ascending=False)
    exits: dict[int, int] = {}
    for o, n in zip(pdf["offset"].tolist(), pdf["next"].tolist()):
        exits[o] = -1 if pd.isna(n) else exits.get(int(n), int(n))
    return pdf[["path", "offset"]].assign(exit=[exits[o] for o in pdf["offset"]])


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chain from its entry visits."""
    following = {int(o): n for o, n in zip(pdf["offset"], pdf["next"])}
    o, seen = int(pdf["entry"].iloc[0]), []
    while o in following:
        seen.append(o)
        if pd.isna(following[o]):
            break
        o = int(following[o])
    return pd.DataFrame({"path": pdf["path"].iloc[0], "offset": pd.Series(seen, dtype="int64")})


def chained(nodes: DataFrame) -> DataFrame:
    """(path, offset) of the records that are reachable from offset 0 of their file.

    ``nodes``: path, split, offset, next (null: no successor). Rounds double, so there are about
    log2(splits of a file) of them.
    """
    jump = written(nodes.select("path", "split", "offset", "next").groupBy("path", "split").applyInPandas(_local_exits, "path string, offset long, exit long"), "exits")
    known = jump.select("path", "offset")
    reached = written(known.filter("offset = 0"), "reached")
    n = reached.count()
    while True:
        step = reached.join(jump, ["path", "offset"]).select("path", F.col("exit").alias("offset")).join(known, ["path", "offset"], "left_semi")
        reached = written(reached.unionByName(step).distinct(), "reached")
        if (now := reached.count()) == n:
            break
        n = now
        on = jump.select("path", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        jump = written(jump.join(on, ["path", "exit"], "left").select("path", "offset", F.coalesce("further", "exit").alias("exit")), "exits")
    entry = nodes.join(reached, ["path", "offset"], "left_semi").groupBy("path", "split").agg(F.min("offset").alias("entry"))
    return nodes.join(entry, ["path", "split"]).groupBy("path", "split").applyInPandas(_walk, "path string, offset long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: path, offset, record_type, record_id, refers_to, uri, declared
    digest, payload_bytes and payload_digest (recomputed; of revisits the declared one)."""
    found = written(pieces(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    total = found.groupBy("path", "split").agg(F.sum(F.col("size") + len(CUT)).alias("total"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = total.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    first = (F.col("split") == 0) & (F.col("k") == 0)
    offset = F.col("base") + F.col("start") - F.when(first, 0).otherwise(len(MAGIC))
    placed = found.join(base, ["path", "split"]).withColumn("offset", offset).withColumn("next", F.col("offset") + F.col("head") + F.col("length") + len(END))
    placed = written(placed, "placed")
    on_chain = written(chained(placed.select("path", "split", "offset", "next")), "chain")
    records = placed.join(on_chain, ["path", "offset"])
    sizes = placed.groupBy("path").agg(F.max("file_size").alias("file_size"))
    ends = records.groupBy("path").agg(F.max(F.coalesce("next", F.lit(-1))).alias("end"))
    broken = sizes.join(ends, "path", "left").filter(~F.col("file_size").eqNullSafe(F.col("end"))).limit(5).collect()
    if broken:
        raise ValueError(f"chains that miss the end of their file: {[(r.path, r.end, r.file_size) for r in broken]}")
    names = ["path", "offset", "record_type", "record_id", "refers_to", "uri", "declared", "payload_bytes", "payload_digest"]
    open_ = records.filter("payload_bytes is null")
    whole = records.filter("payload_bytes is not null").select(*names)
    if open_.limit(1).count():
        whole = whole.unionByName(_assembled(spark, path, placed, open_, names))
    declared = F.regexp_replace("declared", "^sha1:", "")
    return whole.withColumn("payload_digest", F.coalesce("payload_digest", F.when(F.col("record_type") == "revisit", declared)))


def _assembled(spark: SparkSession, path: str, placed: DataFrame, open_: DataFrame, names: list[str]) -> DataFrame:
    """Records whose block goes on over the following pieces, because it holds the separator."""
    spans = open_.select("path", F.col("offset").alias("owner"), F.col("next").alias("until"))
    order = Window.partitionBy("path").orderBy("offset", "is_piece").rowsBetween(Window.unboundedPreceding, 0)
    marks = spans.select("path", F.col("owner").alias("offset"), F.lit(0).alias("is_piece"), F.lit(None).cast("long").alias("split"), F.lit(None).cast("long").alias("k"),
                         F.struct("owner", "until").alias("span"))
    parts = placed.select("path", "offset", F.lit(1).alias("is_piece"), "split", "k", F.lit(None).cast("struct<owner:bigint,until:bigint>").alias("span"))
    owned = marks.unionByName(parts).withColumn("span", F.last("span", ignorenulls=True).over(order))
    needed = written(owned.filter("is_piece = 1 and offset >= span.owner and offset < span.until").select("path", "split", "k", "offset", F.col("span.owner").alias("owner")), "parts")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _numbered(batches):
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("split"), pa.array([r[2] for r in rows], pa.int64()), b.column("piece")], ["path", "split", "k", "piece"])

    texts = pieces(spark, path).mapInArrow(number, "path string, split long, k long, piece binary").join(needed, ["path", "split", "k"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        first = int(pdf["owner"].iloc[0]) == 0
        raw = CUT.encode().join(bytes(p) for p in pdf["piece"])
        got = candidate(raw, first)
        return pd.DataFrame([{"path": pdf["path"].iloc[0], "offset": int(pdf["owner"].iloc[0]), "payload_bytes": got[7], "payload_digest": got[8]}])

    done = texts.groupBy("path", "owner").applyInPandas(join, "path string, offset long, payload_bytes long, payload_digest string")
    return open_.drop("payload_bytes", "payload_digest").join(done, ["path", "offset"]).select(*names)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back, one row per page."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}/warc"
    write_warc(pages, path, min_bytes)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                         number("refers_to").alias("refers_to"))
