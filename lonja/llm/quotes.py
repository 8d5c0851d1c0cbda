"""Quotation linking: nested quotes, their originals, and conversations in reply order without quotes.

DataFrame functions only. A line's quote level is the number of ``>`` marks before its text; a passage is a
run of lines of one level. Passages are normalised (lower case, white space to one space) and hashed.
Hashes of quoted passages are joined to hashes of what messages say themselves: the whole of it, each
of its passages and each of its lines. Originals are reduced to one row per (conversation, hash) and one per
hash before any join, so a text that many messages share adds no pairs.

A quote goes to the first message of its own conversation that says it, if that comes earlier; else to
the first message of all, if its (conv_id, turn) is smaller. The parent of a message is the latest
original of its least nested linked passages. Threads and depths follow from parents by pointer doubling;
(thread, depth, conv_id, turn) is an order in which every message stands after what it answers.

Defined cases: null and empty texts say and quote nothing; blank passages are no quotes; null conv_id
or turn: the message is kept, says nothing to others and has no parent; rows that repeat a
(conv_id, turn) are kept, and share one parent (the latest); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lonja.llm.common import written

MARKS = r"^([ \t>]*>)"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), passages (level, norm) and max_level of every message."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r?\n").alias("lines"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))
    m = m.withColumn("levels", F.transform("lines", level))
    m = m.withColumn("plain", F.transform("lines", lambda x: F.regexp_replace(x, MARKS + " ?", "")))
    starts = F.filter(F.sequence(F.lit(0), F.size("levels") - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    m = m.withColumn("starts", starts)
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("levels"))
    passage = lambda s, i: F.struct(F.get("levels", s).alias("level"), normalised(F.array_join(F.slice("plain", s + 1, end(i) - s), " ")).alias("norm"))
    own = F.array_join(F.filter(F.zip_with("plain", "levels", lambda t, k: F.when(k == 0, t)), lambda t: t.isNotNull()), "\n")
    return m.select("conv_id", "turn", "role", F.regexp_replace(own, r"^\s+|\s+$", "").alias("own"), F.array_max("levels").alias("max_level"),
                    F.filter(F.transform("starts", passage), lambda p: p["norm"] != "").alias("passages"))


def said(messages: DataFrame) -> DataFrame:
    """conv_id, turn and hash of everything that messages say themselves."""
    lines = F.transform(F.split("own", r"\r?\n"), normalised)
    runs = F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["norm"])
    every = F.array_distinct(F.concat(F.array(normalised(F.col("own"))), runs, lines))
    return messages.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode(F.filter(every, lambda t: t != "")).alias("t")).select("conv_id", "turn", F.sha2("t", 256).alias("hash"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash of every quoted passage, with the conv_id and turn of its original (or null)."""
    quotes = messages.select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p")).select(
        "conv_id", "turn", F.col("p.level").alias("level"), F.sha2("p.norm", 256).alias("hash"))
    originals = said(messages)
    near = originals.groupBy("conv_id", "hash").agg(F.min("turn").alias("near"))
    first = near.groupBy("hash").agg(F.min("conv_id").alias("f_conv"))
    first = near.withColumnRenamed("conv_id", "f_conv").join(first, ["hash", "f_conv"]).withColumnRenamed("near", "f_turn")
    both = quotes.join(near, ["conv_id", "hash"], "left").join(first, "hash", "left")
    inside = F.col("near") < F.col("turn")
    before = F.col("f_conv") < F.col("conv_id")
    return both.select("conv_id", "turn", "level", "hash", F.when(inside, F.col("conv_id")).when(before, F.col("f_conv")).alias("o_conv"),
                       F.when(inside, F.col("near")).when(before, F.col("f_turn")).alias("o_turn"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, thread_conv, thread_turn, depth: the start of each message's chain of parents, by pointer doubling.

    ``parents``: conv_id, turn, parent_conv, parent_turn; one row per message that has a parent.
    """
    jump = written(parents.select("conv_id", "turn", F.col("parent_conv").alias("a_conv"), F.col("parent_turn").alias("a_turn"),
                                  F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), "jump")
    while True:
        up = jump.select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("a_conv").alias("n_conv"), F.col("a_turn").alias("n_turn"),
                         F.col("depth").alias("more"), F.col("open").alias("n_open"))
        on = jump.filter("open").join(up, ["a_conv", "a_turn"], "left")  # only messages whose start isn't known yet
        found = F.col("more").isNotNull()
        moved = on.select("conv_id", "turn", F.when(found, F.col("n_conv")).otherwise(F.col("a_conv")).alias("a_conv"),
                          F.when(found, F.col("n_turn")).otherwise(F.col("a_turn")).alias("a_turn"),
                          (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("n_open", F.lit(False)).alias("open"))
        jump = written(jump.filter("not open").unionByName(moved), "jump")
        if not jump.filter("open").limit(1).count():
            return jump.select("conv_id", "turn", F.col("a_conv").alias("thread_conv"), F.col("a_turn").alias("thread_turn"), "depth")


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per message: its own text, counts of quotes, its parent, thread and depth."""
    m = written(parsed(messages), "messages")
    links = written(linked(m), "links")
    rank = F.struct(-F.col("level"), F.col("o_conv"), F.col("o_turn"))
    info = links.groupBy("conv_id", "turn").agg(F.count("*").alias("q"), F.count("o_conv").alias("n_linked"), F.max(F.when(F.col("o_conv").isNotNull(), rank)).alias("r"))
    info = info.select("conv_id", "turn", "n_linked", F.col("r.o_conv").alias("parent_conv"), F.col("r.o_turn").alias("parent_turn"))
    chain = threads(info.filter("parent_conv is not null and conv_id is not null and turn is not null"))
    out = m.join(info, ["conv_id", "turn"], "left").join(chain, ["conv_id", "turn"], "left")
    n_quotes = F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")
    return out.select("conv_id", "turn", "role", n_quotes.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("max_level").cast("long").alias("max_level"),
                      "parent_conv", "parent_turn", F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"),
                      F.coalesce("depth", F.lit(0)).alias("depth"), "own")


def as_mail(conversations: DataFrame) -> DataFrame:
    """Turns as mails: each quotes the turn before it, and that turn's own quote of the one before, above its text."""
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = plain.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    last = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.regexp_replace("text", "(?m)^", "> ").alias("q1"))
    older = one.select("conv_id", (F.col("turn") + 2).alias("turn"), F.regexp_replace("text", "(?m)^", "> > ").alias("q2"))
    body = F.concat_ws("\n", "q2", "q1", "text")
    return plain.join(last, ["conv_id", "turn"], "left").join(older, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", body.alias("text"))
