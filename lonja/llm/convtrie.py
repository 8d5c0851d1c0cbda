"""The prefix trie of conversations, by SQL ROLLUP over positional columns of turn ids.

A turn's id is 128 bits of SHA-256 over its role and text, followed by the text's code points (4 bytes), so node values
need no second look at the texts. Conversations become rows (t1 ... tK); one ``GROUP BY top, ROLLUP (t1, ..., tK)``
counts all their prefixes together, and ``grouping_id`` gives a group's depth. Conversations that still share the
node at the end of a block go on in the next block of columns, keyed by that node (``top``, its smallest member;
unique at its depth); blocks double in width up to ``WIDEST`` columns, so there are as many as the longest *shared*
prefix needs. A conversation that is alone in its node is a plain chain from there on, and is written down without
further grouping. Sums over subtrees come from the deepest block upwards: a second ROLLUP over the shared nodes and the
first lone node below each.

Nothing is gathered by conversation or by node: a turn's place is its number in a global range sort less that of
its conversation's first; parents with many children and nodes with many members are joined by a bounded broadcast; the
members that end at a node are hashed as a stream of sorted pieces of at most 1,000 ids.

Defined cases: rows with a null conv_id belong to no conversation and are ignored; null roles and texts are empty;
a null turn comes first; rows of one conversation with equal turns are ordered by their turn id, repeated rows are
turns of their own; a conversation without turns ends at the root; an empty table has no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from lonja.llm.common import join_groups, written
from lonja.scale import numbered

WIDTH, WIDEST = 8, 32  # columns of the first block, and of any
TID = 20  # bytes of a turn id
PIECE = 1000
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_id(role: Column, text: Column) -> Column:
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.unhex(F.sha2(whole, 256)), 1, 16), F.unhex(F.lpad(F.hex(F.char_length(text)), 8, "0")))


def code_points(tid: Column) -> Column:
    return F.conv(F.hex(F.substring(tid, 17, 4)), 16, 10).cast("long")


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, tid) of every turn in its order, and (conv_id, n_turns)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                              turn_id(text("role"), text("text")).alias("tid"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    rows = numbered(rows, ["conv_id", "turn", "tid", "salt"], "n").select("conv_id", "tid", "n")
    sizes = written(rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min("n").alias("first")), "sizes")
    turns = join_groups(rows, sizes, ["conv_id"], "n_turns").select("conv_id", (F.col("n") - F.col("first") + 1).alias("pos"), "tid")
    return written(turns, "turns"), sizes.select("conv_id", "n_turns")


def with_shared_heads(turns: DataFrame, sizes: DataFrame, most: int = 5, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns come from the conversation ``c - c % every``; h = crc32(c) % (most + 1)."""
    c = sizes.select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    # fewer than 2 * every conversations have one base
    c = c.join(sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("there")), "base", "left")
    head = F.least("h", F.coalesce("there", F.lit(0)))
    c = written(c.select("conv_id", "base", "n_turns", "h", head.alias("head"), (head + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n")), "heads")
    heads = turns.filter((F.col("pos") <= most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "pos", "tid")
    heads = c.filter("head > 0").join(heads, "base").filter("pos <= head").select("conv_id", "pos", "tid")
    own = join_groups(turns, c, ["conv_id"], "n_turns").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "tid")
    return written(heads.unionByName(own), "rebuilt"), c.select("conv_id", "n")


def rolled(wide: DataFrame, width: int, **values: str) -> DataFrame:
    """top, level, path and ``values`` (SQL aggregates) of every prefix of (t1 ... t``width``) under its top."""
    cols = [f"t{i}" for i in range(1, width + 1)]
    aggregates = ", ".join(f"{sql} AS {name}" for name, sql in values.items())
    groups = wide.sparkSession.sql(f"SELECT top, {', '.join(cols)}, {width} - bit_count(grouping_id()) AS level, {aggregates} FROM {{wide}} "
                                   f"GROUP BY top, ROLLUP ({', '.join(cols)})", wide=wide)
    # a shorter conversation also makes groups with absent turns: no prefixes
    groups = groups.filter((F.col("level") == 0) | F.get(F.array(*cols), F.col("level") - 1).isNotNull())
    return groups.select("top", "level", F.concat(*[F.coalesce(c, F.lit(b"")) for c in cols]).alias("path"), *values)


def _columns(path: str, width: int) -> dict[str, Column]:
    part = lambda i: F.substring(path, TID * i + 1, TID)
    return {f"t{i + 1}": F.when(F.length(part(i)) > 0, part(i)) for i in range(width)}


def _hash_runs(batches):
    """SHA-256 over the comma-joined pieces of every (top, path); rows come sorted."""
    import pandas as pd

    key, run = None, None
    for batch in batches:
        done = []
        for top, path, ids in zip(batch["top"], batch["path"], batch["ids"]):
            if (top, path) == key:
                run.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, run.hexdigest()))
            key, run = (top, path), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["top", "path", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, run.hexdigest())], columns=["top", "path", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(top, path, ends_sha256) from (top, path, conv_id)."""
    bucket = F.expr(f"(conv_id - pmod(conv_id, {PIECE})) div {PIECE}")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("top", "path", bucket.alias("bucket")).agg(ids.alias("ids"))
    pieces = pieces.repartition("top", "path").sortWithinPartitions("top", "path", "bucket").select("top", "path", "ids")
    return pieces.mapInPandas(_hash_runs, "top long, path binary, ends_sha256 string")


def block_nodes(wide: DataFrame, width: int, base: int) -> DataFrame:
    """Nodes of one block with their parents: top, path, level, depth, conv_id, n, len, kids, parent_conv_id, parent_n.

    Level 0 stands for the node that the block hangs from.
    """
    mine = "min(conv_id)" if base == 0 else f"IF({width} - bit_count(grouping_id()) = 0, top, min(conv_id))"
    nodes = rolled(wide, width, n="count(*)", conv_id=mine, len="max(len)")
    up = F.when(F.col("level") > 0, F.substring("path", F.lit(1), TID * (F.col("level") - 1)))
    nodes = written(nodes.withColumn("up", up).withColumn("depth", F.col("level").cast("long") + base), "nodes")
    kids = nodes.filter("level > 0").groupBy("top", F.col("up").alias("path")).agg(F.count("*").alias("kids"))
    parents = written(nodes.join(kids, ["top", "path"]).select("top", F.col("path").alias("up"), "kids", F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("parent_n")), "parents")
    below = join_groups(nodes.filter("level > 0"), parents, ["top", "up"], "kids").drop("kids", "up")
    tops = nodes.filter("level = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_n": F.lit(None).cast("long")}).drop("up")
    full = below.unionByName(tops).join(kids, ["top", "path"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    return written(full, "block")


def chains(nodes: DataFrame) -> DataFrame:
    """Rows of the nodes below lone nodes (conv_id, depth, len) where a block ended."""
    s = nodes.select("conv_id", "len", F.explode(F.sequence(F.col("depth") + 1, F.col("len"), F.lit(10_000).cast("long"))).alias("s")).repartition("conv_id", "s")
    s = s.select("conv_id", "len", F.explode(F.sequence("s", F.least(F.col("s") + 9_999, F.col("len")))).alias("depth"))
    last = F.col("depth") == F.col("len")
    return s.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
                    F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, widest: int = WIDEST) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos from 1, tid) of ``convs`` (conv_id, n)."""
    open_ = convs.select("conv_id", F.col("n").cast("long").alias("len"), F.lit(0).cast("long").alias("top"))
    blocks, base = [], 0
    while True:  # down
        cells = turns.filter((F.col("pos") > base) & (F.col("pos") <= base + width))
        cells = cells.groupBy("conv_id").agg(*[F.max(F.when(F.col("pos") == base + i, F.col("tid"))).alias(f"t{i}") for i in range(1, width + 1)])
        wide = written(open_.join(cells, "conv_id", "left"), "wide")
        nodes = block_nodes(wide, width, base)
        paths = wide.select("conv_id", "len", "top", F.concat(*[F.coalesce(f"t{i}", F.lit(b"")) for i in range(1, width + 1)]).alias("path"))
        ends = ends_hashes(paths.filter(F.col("len") <= base + width).select("top", "path", "conv_id"))
        blocks.append((nodes, written(ends, "ends"), width, base))
        shared = nodes.filter((F.col("level") == width) & (F.col("n") > 1)).select("top", "path", "n", F.col("conv_id").alias("next"))
        more = join_groups(paths.filter(F.col("len") > base + width), shared, ["top", "path"], "n").select("conv_id", "len", F.col("next").alias("top"))
        open_ = written(more, "open")
        if open_.isEmpty():
            break
        base, width = base + width, min(2 * width, widest)
    out, below = [], None
    for nodes, ends, width, base in reversed(blocks):  # up
        alone = F.col("n") == 1
        last = (F.col("level") == width) & alone & (F.col("len") > F.col("depth"))
        out.append(chains(nodes.filter(last).select("conv_id", "depth", "len")))
        if below is None:
            nodes = nodes.withColumns({"more": F.lit(0).cast("long"), "more_leaves": F.lit(0).cast("long"), "more_saved": F.lit(0).cast("long")})
        else:
            zero = {c: F.coalesce(c, F.lit(0)) for c in ("more", "more_leaves", "more_saved")}
            nodes = nodes.join(below.withColumn("level", F.lit(width)), ["conv_id", "level"], "left").withColumns(zero)
        nodes = nodes.withColumn("kids", F.col("kids") + F.col("more") + F.when(last, 1).otherwise(0))
        value = F.when(F.col("level") > 0, (F.col("n") - 1) * code_points(F.substring("path", F.lit(-TID), TID))).otherwise(0) + F.col("more_saved")
        leaves = F.when(alone, 1).when(F.col("kids") == 0, 1).otherwise(0) + F.col("more_leaves")
        part = nodes.filter(((F.col("level") > 0) | F.lit(base == 0)) & (~alone | (F.col("parent_n") > 1)))
        sums = rolled(part.select("top", value.alias("v"), leaves.alias("f"), *[c.alias(n) for n, c in _columns("path", width).items()]), width, v="sum(v)", f="sum(f)").drop("level")
        full = nodes.join(sums, ["top", "path"], "left").join(ends, ["top", "path"], "left")
        full = written(full.select("top", "level", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
                                   F.when(alone, 1).otherwise(F.coalesce("f", F.lit(0))).cast("long").alias("n_leaves"), F.when(alone, 0).otherwise(F.coalesce("v", F.lit(0))).cast("long").alias("saved_tokens"),
                                   F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie")
        if base:
            below = full.filter("level = 0").select(F.col("top").alias("conv_id"), F.col("n_children").alias("more"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
            full = full.filter("level > 0")
        out.append(full.select(COLUMNS))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns, sizes = placed(conversations)
    return prefix_trie(turns, sizes.withColumnRenamed("n_turns", "n"))
