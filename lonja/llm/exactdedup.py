"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside groups, one row of each group stays.

Texts are equal when they agree after white space ``[\\x20\\x09-\\x0D]`` is deleted. One pass over the documents
writes a digest per row (id, length, hash; no text). Groups and their best rows come from the digests. Texts
travel only where a hash repeats: those are reduced to distinct (hash, text) pairs on the map side, so a
group of any number of copies is one row per task, and a hash with two different texts is a collision. Rows
of colliding hashes are grouped again by (hash, text); all others by the hash, which is then as good as
the text. Groups that hold a large share of the rows join by a broadcast of at most 1,000 keys, the others by
a shuffle.

The best row of a group has the most code points, then the smallest doc_id; a null doc_id comes last, and of rows
that agree in both one is chosen. Defined cases: null texts count as empty and are one group with texts of
white space only; texts of any length are hashed whole; repeated rows are members of their group; an
empty table gives an empty result; other columns are ignored by ``exact_groups`` and kept by ``without_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lonja.llm.common import join_groups, written

SPACE = r"[\x20\x09-\x0D]+"
BROADCAST_KEYS = 500_000  # hashes of 16 bytes that are sent to every task at most


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the keep_id and size of its group, and whether it stays."""
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = written(rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "groups")
    out = join_groups(rows, groups, keys, "group_size")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def collisions(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """Hashes under which ``texts`` (h, norm) has different texts; only hashes that repeat are looked at."""
    repeated = written(digests.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
    if repeated.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    distinct = texts.join(repeated, "h", "left_semi").distinct()
    return written(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "collisions")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n_points"),
                        normalised(F.col("text")).alias("norm"))
    texts = texts.withColumn("h", digest(F.col("norm")))
    numbered = lambda df, *more: df.select("doc_id", "n_points", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"), *more)
    digests = written(numbered(texts), "digests")
    clash = collisions(texts.select("h", "norm"), digests)
    if clash.isEmpty():
        return _classes(digests, ["h"])
    mixed = written(numbered(texts.join(clash, "h", "left_semi"), "norm"), "mixed")
    return _classes(digests.join(clash, "h", "left_anti"), ["h"]).unionByName(_classes(mixed, ["h", "norm"]))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    best = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s"))
    held = docs.select(F.struct(*docs.columns).alias("held"), F.col("doc_id").cast("long").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("sha"),
                       F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n_points"))
    found = held.join(best, (F.col("sha") == F.col("s")) & F.col("id").eqNullSafe(F.col("k")))
    return found.groupBy("sha", "id").agg(F.max_by("held", "n_points").alias("held")).select("held.*")
