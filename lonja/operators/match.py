"""Competitor matching."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lonja.functions.stats import col
from lonja.functions.text import norm_code
from lonja.session import cut_lineage
from lonja.staging import frozen

# Attribute patterns of the product descriptions, first match wins.
TYPES = (("domo", r"\bdomo\b"), ("bala", r"\bbala\b|\bbullet\b"), ("turret", r"\bturret\b|\beyeball\b"),
         ("ptz", r"\bptz\b"), ("nvr", r"\bnvr\b"), ("dvr", r"\bdvr\b|\bxvr\b"))
TECH = (("turbohd", r"turbo\s*hd|turbohd"), ("hdcvi", r"hdcvi|cvi\b"), ("ip", r"\bip\b|\bpoe\b"))
SPECIAL = r"anticorrosi|antiexplosi|explosion[- ]?proof|motoriz|lente mot"


def clean_catalog(df: DataFrame, code: str) -> DataFrame:
    """Normalised code; empty, one-letter and scientific-notation codes are noise."""
    return (df.withColumn("m_norm", norm_code(code))
              .where((F.length("m_norm") >= 2) & ~F.upper(F.trim(F.col(code))).rlike(r"^[0-9.]+E[+-]?[0-9]+$")))


def extract_attrs(df: DataFrame, text: str) -> DataFrame:
    t = F.lower(col(text))

    def first(table):
        out = F.lit(None).cast("string")
        for name, pattern in reversed(table):
            out = F.when(t.rlike(pattern), name).otherwise(out)
        return out

    def number(pattern):
        return F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("double")

    return (df.withColumn("tipo", first(TYPES)).withColumn("tec", first(TECH))
              .withColumn("mp", number(r"(\d+(?:\.\d+)?)\s*(?:mp\b|megapix)"))
              .withColumn("mm", number(r"(\d+(?:\.\d+)?)\s*mm\b"))
              .withColumn("gama", t.rlike(SPECIAL)))


def change_log(reg: DataFrame, limit: float = 0.01) -> DataFrame:
    """Moves between consecutive dates of each competitor product: price, new, stock-out, restock."""
    from pyspark.sql import Window as W
    w = W.partitionBy("fuente", "modelo").orderBy("fecha")
    first = reg.groupBy("fuente").agg(F.min("fecha").alias("_f0"))
    d = (reg.withColumn("_p", F.lag("precio_venta").over(w)).withColumn("_e", F.lag("existencia").over(w)).withColumn("_n", F.row_number().over(w))
            .join(first, "fuente"))
    rel = F.col("precio_venta") / F.when(F.col("_p") > 0, F.col("_p")) - 1
    ev = lambda cond, name, pct: F.when(cond, F.struct(F.lit(name).alias("tipo"), pct.alias("delta_pct")))
    none = F.lit(None).cast("double")
    moves = F.array_compact(F.array(
        ev(F.col("_p").isNull() & (F.col("_n") == 1) & (F.col("fecha") > F.col("_f0")), "ALTA", none), ev(rel >= limit, "PRECIO SUBIÓ", 100 * rel), ev(rel <= -limit, "PRECIO BAJÓ", 100 * rel),
        ev((F.col("_e") > 0) & (F.col("existencia") == 0), "STOCKOUT", none), ev((F.col("_e") == 0) & (F.col("existencia") > 0), "REABASTECIDO", none)))
    return d.withColumn("x", F.explode(moves)).select("fuente", "modelo", "fecha", "x.tipo", "x.delta_pct", "precio_venta", "moneda")


def match_exact(comp: DataFrame, cat: DataFrame) -> DataFrame:
    """Competitor model and catalogue code with the same normalised code (smallest code on conflict)."""
    c = cat.groupBy("m_norm").agg(F.min("codigo").alias("codigo"))
    return comp.join(c, "m_norm").select("modelo", "m_norm", "codigo", F.lit("EXACTO").alias("nivel"), F.lit(1.0).alias("score"))


def _cut(lo: int, hi: int):
    """Batches of keys with their texts (_t) to the distinct n-grams of each key and how often each occurs."""
    def cut(batches):
        for d in batches:
            found = [Counter(t[i:i + n] for t in texts for n in range(lo, hi + 1) for i in range(len(t) - n + 1)) for texts in d.pop("_t")]
            yield d.assign(g=[list(f) for f in found], tf=[[float(x) for x in f.values()] for f in found])
    return cut


def grams(df: DataFrame, key: str, text, n_lo: int, n_hi: int) -> DataFrame:
    """(key, gram, tf): character n-grams of the whole text; only the texts are shuffled, and each is cut once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(key, col(text).alias("_t")).repartition(parts, key).groupBy(key).agg(F.collect_list("_t").alias("_t"))
    lists = d.mapInPandas(_cut(n_lo, n_hi), f"{key} {d.schema[key].dataType.simpleString()}, g array<string>, tf array<double>")
    return lists.select(key, F.explode(F.arrays_zip("g", "tf")).alias("x")).select(key, F.col("x.g").alias("gram"), F.col("x.tf").alias("tf"))


def vectors(q: DataFrame, c: DataFrame, qk: str, ck: str, min_df: int = 1) -> tuple[DataFrame, DataFrame]:
    """Unit TF-IDF vectors of both sides; document frequencies come from the catalogue side, whose grams are written once.

    The rows of a text meet once, for its norm; it is as long as the text.
    """
    c = frozen(c, "grams")
    n = c.select(ck).distinct().agg(F.count("*")).scalar()
    df = c.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    df = frozen(df.withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1), "frequencies")

    def unit(d, key):
        d = d.where(F.col(key).isNotNull()).join(df, "gram").groupBy(key).agg(F.collect_list(F.struct("gram", "df", (F.col("tf") * F.col("idf")).alias("w"))).alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        return d.select(key, norm.alias("_n"), F.explode("v").alias("x")).select(key, "x.gram", "x.df", (F.col("x.w") / F.col("_n")).alias("w"))

    return unit(q, qk), unit(c, ck)


# Texts in one block of the catalogue, and queries that share one copy of a block at least.
TEXTS, QUERIES = 100_000, 2_000
POSTINGS = 3_000_000  # (text, gram) rows in one block: some 0.1 GB
LOOKUP = 12  # postings that are read in the time of one look-up
TASKS = 24  # tasks that a search is spread over at least, if there are queries enough


class Postings:
    """One block of catalogue vectors by gram: for every gram its texts, their weights, and the largest weight."""

    def __init__(self, keys: np.ndarray, grams: np.ndarray, texts: np.ndarray, weights: np.ndarray):
        order = np.lexsort((texts, grams))
        self.keys, self.texts, self.weights = keys, texts[order], weights[order]
        self.grams, start = np.unique(grams[order], return_index=True)
        self.ends = np.append(start, len(order))
        self.most = np.maximum.reduceat(self.weights, start) if len(order) else np.empty(0)

    def top(self, grams: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys and cosines of the k best texts that share a gram and reach ``least``, and the postings read.

        A gram adds at most its weight times the largest weight of its list. Long lists that together add less than the
        threshold can't bring a text in on their own: where that pays, they are left out when texts are collected, and
        looked up for the texts that can still reach it.
        """
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[known]
        at, w = at[known], weights[known]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0), 0
        sizes, bound = self.ends[at + 1] - self.ends[at], w * self.most[at]
        order = np.argsort(bound / sizes, kind="stable")
        rest = np.minimum(np.cumsum(bound[order]), np.sqrt(np.cumsum(w[order] ** 2)))
        left = int(np.searchsorted(rest, least - 1e-9)) if least > 0 else 0
        read, all_ = int(sizes[order[left:]].sum()), int(sizes.sum())
        if LOOKUP * left * read > all_ - read:  # looking up what may be found costs more than reading the long lists, too
            left, read = 0, all_
        open_ = rest[left - 1] if left else 0.0
        lists = [slice(self.ends[at[j]], self.ends[at[j] + 1]) for j in order]
        score = np.zeros(len(self.keys))
        if left < len(order):
            docs = np.concatenate([self.texts[x] for x in lists[left:]])
            score = np.bincount(docs, np.concatenate([self.weights[x] for x in lists[left:]]) * np.repeat(w[order[left:]], sizes[order[left:]]), len(self.keys))
        enough = least - open_ - 1e-9
        found = np.flatnonzero(score >= enough if enough > 0 else score > 0)
        if left and len(found) > k:  # k texts reach this much already, so others must be able to
            reached = np.partition(score[found], len(found) - k)[len(found) - k]
            found = found[score[found] + open_ >= reached - 2e-9]
        for x, j in zip(lists[:left], order[:left]):
            docs = self.texts[x]
            if len(docs) <= len(found):  # cheaper to read than to look up
                score[docs] += w[j] * self.weights[x]
                continue
            hit = np.searchsorted(docs, found)
            ok = hit < len(docs)
            ok[ok] = docs[hit[ok]] == found[ok]
            score[found[ok]] += w[j] * self.weights[x][hit[ok]]
        read += left * len(found)
        s = np.round(score[found], 9)
        found, s = found[s >= least - 1e-9], s[s >= least - 1e-9]
        best = np.lexsort((self.keys[found], -s))[:k]
        return self.keys[found[best]], s[best], read


def topk_cosine(q: DataFrame, c: DataFrame, qk: str, ck: str, k: int, least: float = 0.0) -> DataFrame:
    """The k nearest catalogue texts of each query text with cosine >= ``least`` (0: that share a gram), exactly; keys are numbers.

    The catalogue goes into blocks of at most about ``TEXTS`` texts, kept by gram. A query visits one block first; the
    k-th cosine found there is its threshold in all others, so most long lists are never read. A task holds one block, and
    queries stream past it. Few blocks are copied, so that there is work for ``TASKS`` tasks; the
    catalogue is sent once per copy, and a query once to each block.
    """
    from lonja.operators.topk import topk
    n_texts, n_queries = c.select(ck).distinct().count(), q.select(qk).distinct().count()
    blocks = max(1, -(-n_texts // TEXTS), -(-c.count() // POSTINGS))
    copies = max(1, min(-(-TASKS // blocks), -(-n_queries // QUERIES)))
    number = cut_lineage(c.select("gram").distinct().withColumn("g", F.monotonically_increasing_id()))
    lists = F.sort_array(F.collect_list(F.struct("g", "w")))

    def rows(d: DataFrame, key: str) -> DataFrame:
        one = d.join(number, "gram").groupBy(F.col(key).cast("long").alias("key")).agg(lists.alias("v"))
        return one.select("key", F.col("v.g").alias("g"), F.col("v.w").alias("w"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("home"))

    texts, asked = frozen(rows(c, ck), "texts"), frozen(rows(q, qk), "queries").withColumn("least", F.lit(float(least)))

    def search(batches):
        cell, held, index = None, [], None
        for d in batches:
            for now, part in d.groupby("cell"):  # the texts of a cell come before its queries
                if now != cell:
                    cell, held, index = now, [], None
                t, asks = part[part["is_text"]], part[~part["is_text"]]
                if len(t):
                    held.append((t["key"].to_numpy(), t["g"].map(len).to_numpy(), np.concatenate(t["g"].to_list()), np.concatenate(t["w"].to_list())))
                if not len(asks) or (index is None and not held):
                    continue
                if index is None:
                    keys, sizes, grams, weights = (np.concatenate(x) for x in zip(*held))
                    held, index = [], Postings(keys, grams, np.repeat(np.arange(len(keys)), sizes), weights)
                hits = [(r.key, *index.top(np.asarray(r.g), np.asarray(r.w), k, r.least)) for r in asks.itertuples(index=False)]
                yield pd.DataFrame({"q": np.repeat([h[0] for h in hits], [len(h[1]) for h in hits]), "c": np.concatenate([h[1] for h in hits]), "cos": np.concatenate([h[2] for h in hits])})

    def visit(queries: DataFrame, where: Column, name: str) -> DataFrame:
        cell = lambda block, copy: (block * copies + copy).cast("int").alias("cell")
        cols = ["key", "g", "w", "least"]
        each = texts.withColumn("least", F.lit(0.0)).select(*cols, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "home")
        each = each.select(cell(F.col("home"), F.col("copy")), F.lit(True).alias("is_text"), *cols)
        sent = queries.select(*cols, F.explode(where).alias("block")).select(
            cell(F.col("block"), F.pmod(F.xxhash64("key", F.lit(7)), F.lit(copies))), F.lit(False).alias("is_text"), *cols)
        cells = each.unionByName(sent).repartition(blocks * copies, "cell").sortWithinPartitions("cell", F.desc("is_text"), "key")  # like texts have near numbers
        return frozen(cells.mapInPandas(search, "q long, c long, cos double"), name)

    first = visit(asked, F.array("home"), "first")
    kth = first.groupBy(F.col("q").alias("key")).agg(F.min("cos").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    rest = asked.join(kth, "key", "left").withColumn("least", F.greatest("least", F.coalesce("kth", F.lit(0.0)))).drop("kth", "n")
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != F.col("home"))
    found = first if blocks == 1 else first.unionByName(visit(rest, others, "others"))
    return topk(found.select(F.col("q").alias(qk), F.col("c").alias(ck), "cos"), [qk], [F.desc("cos"), ck], k)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full, s = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else (1.0 if not x and not y else 2.0 * _lcs(x, y) / (len(x) + len(y))) for x, y in zip(a, b)])


def indel_ratio(a, b) -> Column:
    """2 LCS / (len a + len b): the indel similarity (edit distance without substitution)."""
    return F.pandas_udf(_indel, "double")(col(a), col(b))


LEVELS = ((0.75, "FUZZY_ALTO"), (0.60, "FUZZY_MEDIO"))


def numbered(d: DataFrame, text: str, key: str) -> DataFrame:
    """Distinct texts with numbers in text order, frozen by the checkpoint."""
    return cut_lineage(d.orderBy(text).withColumn(key, F.monotonically_increasing_id()))


def fuzzy_candidates(comp: DataFrame, cat: DataFrame, n: tuple[int, int] = (2, 4), k: int = 10, min_cos: float = 0.2) -> DataFrame:
    """Top-k catalogue codes by n-gram cosine. A score of .60 needs a cosine of at least .2, so
    nothing under it can be accepted."""
    q = comp.select(F.col("m_norm").alias("q")).distinct().join(cat.select(F.col("m_norm").alias("q")).distinct(), "q", "left_anti")
    q, c = numbered(q, "q", "qid"), numbered(cat.select(F.col("m_norm").alias("c")).distinct(), "c", "cid")
    pad = lambda x: F.concat(F.lit(" "), F.col(x), F.lit(" "))
    qv, cv = vectors(grams(q, "qid", pad("q"), *n), grams(c, "cid", pad("c"), *n), "qid", "cid")
    top = topk_cosine(frozen(qv, "vectors"), frozen(cv, "vectors"), "qid", "cid", k, min_cos)
    return top.join(q, "qid").join(c, "cid").select("q", "c", "cos", "pos")


def match_fuzzy(comp: DataFrame, cat: DataFrame, n: tuple[int, int] = (2, 4), k: int = 10) -> DataFrame:
    """Best candidate by .5 cosine + .3 indel ratio + .2 length ratio, with its level."""
    cand = fuzzy_candidates(comp, cat, n, k)
    la, lb = F.length("q"), F.length("c")
    s = 0.5 * F.col("cos") + 0.3 * indel_ratio("q", "c") + 0.2 * F.least(la, lb) / F.greatest(la, lb)
    best = cand.withColumn("score", s).groupBy("q").agg(F.max_by(F.struct("c", "score"), F.struct("score", "cos", "c")).alias("b"))
    lev = F.when(F.col("b.score") >= LEVELS[0][0], LEVELS[0][1]).when(F.col("b.score") >= LEVELS[1][0], LEVELS[1][1])
    q = comp.select("modelo", "m_norm").join(cat.select("m_norm").distinct(), "m_norm", "left_anti")
    d = q.join(best.withColumn("nivel", lev).where("nivel is not null"), q["m_norm"] == best["q"], "left")
    codes = cat.groupBy(F.col("m_norm").alias("_m")).agg(F.min("codigo").alias("codigo"))
    d = d.join(codes, F.col("b.c") == F.col("_m"), "left")
    return d.select("modelo", "m_norm", F.col("codigo"), F.coalesce("nivel", F.lit("SIN_COINCIDENCIA")).alias("nivel"),
                    F.when(F.col("nivel").isNotNull(), F.col("b.score")).otherwise(0.0).alias("score"))


def plain_text(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def match_text(comp: DataFrame, cat: DataFrame, name: str, desc: str, n: tuple[int, int] = (3, 5), k: int = 5, min_df: int = 2) -> DataFrame:
    """k nearest descriptions of each product name by character n-grams; equal texts are compared once."""
    q = comp.withColumn("q", plain_text(name)).where("q <> ''")
    codes = numbered(cat.withColumn("c", plain_text(desc)).where("c <> ''").groupBy("c").agg(F.min("codigo").alias("codigo")), "c", "cid")
    texts = numbered(q.select("q").distinct(), "q", "qid")
    qv, cv = vectors(grams(texts, "qid", "q", *n), grams(codes, "cid", "c", *n), "qid", "cid", min_df)
    top = topk_cosine(frozen(qv, "vectors"), frozen(cv, "vectors"), "qid", "cid", k)
    return (q.select("modelo", "q").distinct().join(texts, "q").join(top, "qid").join(codes, "cid")
             .select("modelo", F.col("pos").alias("rank"), "codigo", F.col("cos").alias("sim")))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rerank_vectors(top: DataFrame, qvec: DataFrame, cvec: DataFrame, doubt: float = 0.35) -> DataFrame:
    """Queries whose best text similarity is doubtful: the candidate nearest by supplied vectors."""
    d = top.join(top.groupBy("q").agg(F.max("sim").alias("_b")).where(F.col("_b") < doubt).select("q"), "q", "left_semi")
    d = d.join(qvec.select("q", F.col("vec").alias("_v")), "q").join(cvec.select("c", F.col("vec").alias("_u")), "c")
    d = d.withColumn("sim_vec", cosine("_v", "_u"))
    return d.groupBy("q").agg(F.max_by(F.struct("c", "sim_vec", "sim"), F.struct(F.round("sim_vec", 9), -F.col("c"))).alias("b")).select("q", "b.*")


CELL, PAIRS = 32_768, 2_000_000  # rows of either side in one cell, and pairs compared at once


def unit_rows(vectors: pd.Series, size: int) -> np.ndarray:
    """Vectors of length one, as rows; missing ones are NaN."""
    v = np.stack([np.full(size, np.nan) if v is None else np.asarray(v, float) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(1, keepdims=True))


def block_match(comp: DataFrame, ours: DataFrame, rivals: DataFrame, mm_tol: float = 1.2) -> DataFrame:
    """Best substitute inside a block of equal type, megapixels and technology.

    Lane RIVAL when the block holds a rival brand, else VECTOR (any other brand, similarity of
    supplied vectors added). Both sides of a block are dealt into cells of about ``CELL`` x ``CELL`` rows; a cell is compared as
    matrix products, a brand at a time, and returns the best of each product. The job compares
    all pairs of a block, in bounded memory; rows are sent once per cell that they meet.
    """
    blk = ["tipo", "mp", "tec", "gama"]
    c = comp.where("tipo is not null and mp is not null and tec is not null and mm is not null and precio > 0 and marca is not null")
    s = ours.where("tipo is not null and mp is not null and tec is not null and mm is not null and precio > 0 and marca is not null")
    present = s.select("tipo", "mp", "tec", F.col("marca").alias("rival")).distinct()
    has = (c.select("tipo", "mp", "tec", "marca").distinct().join(rivals, "marca").join(present, ["tipo", "mp", "tec", "rival"])
            .select("tipo", "mp", "tec", "marca").distinct().withColumn("_r", F.lit(True)))
    riv = rivals.groupBy("marca").agg(F.collect_set("rival").alias("rivales"))
    c = c.join(has, ["tipo", "mp", "tec", "marca"], "left").join(riv, "marca", "left")
    c = c.select(*blk, "modelo", F.when(F.col("_r"), "RIVAL").otherwise("VECTOR").alias("via"), "marca", F.col("precio").cast("double").alias("precio"), F.ln("precio").alias("l"), "mm", "vec", "rivales")
    s = s.select(*blk, "codigo", "marca", F.col("precio").cast("double").alias("precio"), F.ln("precio").alias("l"), "mm", "vec")

    def dealt(d: DataFrame, key: str, side: str) -> DataFrame:
        """Number of the part of its block that a row is in, and the parts of the block."""
        n = d.groupBy(*blk).agg(F.ceil(F.count("*") / CELL).cast("int").alias(f"_n{side}"))
        return d.join(F.broadcast(n), blk).withColumn(f"_{side}", F.pmod(F.xxhash64(key), F.col(f"_n{side}")).cast("int"))

    c, s = dealt(c, "modelo", "c"), dealt(s, "codigo", "s")
    parts = c.select(*blk, "_nc").distinct().join(s.select(*blk, "_ns").distinct(), blk)  # one row per block
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = c.join(F.broadcast(parts.drop("_nc")), blk).withColumn("_s", all_of("_ns")).drop("_nc", "_ns")
    s = s.join(F.broadcast(parts.drop("_ns")), blk).withColumn("_c", all_of("_nc")).drop("_nc", "_ns")
    cell = [*blk, "_c", "_s"]
    n = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c, s = c.repartition(n, *cell), s.repartition(n, *cell)  # by work, which is more than their bytes tell

    def compare(qs: pd.DataFrame, them: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(them):
            them = them.sort_values("codigo")  # the first of equal ones has the smallest code
            size = max((len(x) for d in (qs, them) for x in d["vec"] if x is not None), default=1)
            v = unit_rows(them["vec"], size)
            code, brand, price, l, mm = (them[x].to_numpy() for x in ("codigo", "marca", "precio", "l", "mm"))
            for (via, marca), q in qs.groupby(["via", "marca"]):
                ok = np.flatnonzero(np.isin(brand, list(q["rivales"].iloc[0])) if via == "RIVAL" else brand != marca)
                rows = max(1, PAIRS // max(1, len(ok)))
                for at in range(0, len(q) if len(ok) else 0, rows):
                    x = q.iloc[at:at + rows]
                    dm = np.abs(mm[ok] - x["mm"].to_numpy()[:, None])
                    u = unit_rows(x["vec"], size)
                    far = np.abs(l[ok] - x["l"].to_numpy()[:, None]) + 0.10 * dm
                    if via == "VECTOR":
                        far += 1 - u @ v[ok].T
                    far = np.where((dm <= mm_tol + 1e-9) & ~np.isnan(far), np.round(far, 9), np.inf)
                    pick = far.argmin(1)
                    near_ = far[np.arange(len(x)), pick]
                    found = ok[pick]
                    for i in np.flatnonzero(np.isfinite(near_)):
                        k = found[i]
                        out.append((x["modelo"].iloc[i], via, marca, x["precio"].iloc[i], code[k], brand[k], price[k], near_[i], float(u[i] @ v[k])))
        return pd.DataFrame(out, columns=["modelo", "via", "marca", "precio", "codigo", "marca_s", "precio_s", "cerc", "sim"])

    kind = {f.name: f.dataType.simpleString() for f in c.schema} | {"codigo": s.schema["codigo"].dataType.simpleString()}
    found = c.groupBy(*cell).cogroup(s.groupBy(*cell)).applyInPandas(
        compare, f"modelo {kind['modelo']}, via string, marca string, precio double, codigo {kind['codigo']}, marca_s string, precio_s double, cerc double, sim double")
    r = found.groupBy("modelo", "via", "marca", "precio").agg(F.min_by(F.struct("codigo", "marca_s", "precio_s", "cerc", "sim"), F.struct("cerc", "codigo")).alias("b"))
    r = r.withColumn("gap_pct", F.bround(100 * (F.col("precio") / F.col("b.precio_s") - 1), 1))
    level = F.when(F.abs("gap_pct") > 60, "DUDOSO").when((F.col("via") == "VECTOR") & (F.col("b.sim") < 0.55), "DUDOSO").otherwise("EQUIVALENTE")
    return r.select("modelo", "via", F.col("b.codigo").alias("codigo"), F.col("b.marca_s").alias("marca_s"), F.col("b.cerc").alias("cercania"), F.col("b.sim").alias("sim"), "gap_pct", level.alias("nivel"))


def signatures(reg: DataFrame) -> DataFrame:
    """Persistence of today's price and stock trajectory per competitor product.

    All windows have the product's key, so the register is sent once and joined with nothing.
    """
    from pyspark.sql import Window as W

    from lonja.operators.windows import with_latest
    k = ["fuente", "modelo"]
    w, seen = W.partitionBy(*k), F.count("existencia")
    upto = lambda order: w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = reg.select(*k, "fecha", "precio_venta", "existencia").withColumn("_a", seen.over(upto("fecha")))
    d = with_latest(d, k, "precio_venta", "fecha", "_p")
    ok = F.coalesce((F.col("precio_venta") > 0) & (F.abs(F.col("precio_venta") / F.col("_p") - 1) <= 0.01), F.lit(False))
    d = d.withColumns({"_r": F.when(~ok, F.row_number().over(w.orderBy(F.desc("fecha")))), "_z": seen.over(upto(F.desc("fecha")))})
    early, late = (F.avg(F.when(F.col(c) <= 3, F.col("existencia"))) for c in ("_a", "_z"))
    g = d.groupBy(*k).agg(F.count("*").alias("_h"), (F.coalesce(F.min("_r"), F.count("*") + 1) - 1).cast("int").alias("persistencia_d"), seen.alias("_n"), early.alias("_i"), late.alias("_f"))
    rel = F.col("_f") / F.col("_i") - 1
    tr = F.when((F.col("_n") >= 6) & (F.col("_i") > 0), F.when(rel < -0.15, "VENDIENDO").when(rel > 0.15, "REPONIENDO").otherwise("ESTANCADO")).otherwise("sin dato")
    return g.select(*k, F.when(F.col("_h") >= 3, F.col("persistencia_d")).alias("persistencia_d"), F.when(F.col("_h") >= 3, tr).otherwise("sin dato").alias("stock_comp"))


def traffic_light(pairs: DataFrame, reg: DataFrame, growth: DataFrame) -> DataFrame:
    """Threat only if cheap, persistent, rotating and our own demand hurts.

    ``pairs``: codigo, match, confiabilidad, fuente, modelo, precio_comp, gap_pct, base.
    """
    from pyspark.sql import Window as W
    w = W.partitionBy("codigo")
    d = pairs.join(signatures(reg), ["fuente", "modelo"], "left").where("codigo is not null").withColumn("_m", F.min("precio_comp").over(w))
    d = d.withColumn("consenso_n", F.count_if(F.col("precio_comp") <= F.col("_m") * 1.05).over(w)).drop("_m")
    d = d.join(growth.select("codigo", "crecimiento"), "codigo", "left")
    t = lambda c: F.coalesce(c, F.lit(False))
    pers, rot = t(F.col("persistencia_d") >= 7), t(F.col("stock_comp").isin("VENDIENDO", "REPONIENDO"))
    hurt = t(F.col("crecimiento") < -0.05) | (F.col("base") == "lista")
    s = (F.when((F.col("gap_pct") < -10) & pers & rot & hurt, "AMENAZA REAL").when(F.col("gap_pct") < -10, "REMATE AJENO").when((F.col("gap_pct") > 10) & pers, "ESPACIO").otherwise("NEUTRO"))
    return d.withColumn("semaforo", s)


LIGHTS = ("AMENAZA REAL", "REMATE AJENO", "ESPACIO", "NEUTRO")


def light_by_model(light: DataFrame) -> DataFrame:
    """One row per product: exact pairs rule, cheapest source, worst light."""
    exact = light.groupBy("codigo").agg(F.max((F.col("match") == "EXACTO").cast("int")).alias("_x"))
    d = light.join(exact, "codigo").where((F.col("_x") == 0) | (F.col("match") == "EXACTO"))
    rank = F.array_position(F.array(*[F.lit(x) for x in LIGHTS]), F.col("semaforo"))
    g = d.groupBy("codigo").agg(F.max("match").alias("match"), F.max("confiabilidad").alias("confiabilidad"), F.min(rank).alias("_r"),
                                F.min_by(F.struct("fuente", "precio_comp", "gap_pct", "consenso_n"), F.struct("precio_comp", "fuente", "modelo")).alias("b"))
    return g.select("codigo", "match", "confiabilidad", "b.*", F.element_at(F.array(*[F.lit(x) for x in LIGHTS]), F.col("_r").cast("int")).alias("semaforo"))


def ranker_duel(a: DataFrame, b: DataFrame, min_gap_share: float = 25.0) -> DataFrame:
    """Two rankings judged by the price gap of their picks, which neither used."""
    from lonja.scale import exact_quantiles
    j = a.select("q", F.col("c").alias("ca"), F.abs("gap_pct").alias("ga")).join(b.select("q", F.col("c").alias("cb"), F.abs("gap_pct").alias("gb")), "q")
    share = lambda c: F.avg((F.col(c) <= min_gap_share).cast("double"))
    g = j.agg(F.count("*").alias("n"), share("ga").alias("j2_campeon"), share("gb").alias("j2_retador"), F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("coinciden"))
    g = g.withColumn("j1_campeon", exact_quantiles(j, [], "ga", {"q": 0.5}).scalar()).withColumn("j1_retador", exact_quantiles(j, [], "gb", {"q": 0.5}).scalar())
    return g.withColumn("entra", (F.col("j1_retador") < F.col("j1_campeon")) & (F.col("j2_retador") > F.col("j2_campeon")))


def final_pairs(model: DataFrame, text: DataFrame, key: str = "modelo") -> DataFrame:
    """Final list: exact code, then high and medium fuzzy, then text; one row per product."""
    pr = F.when(F.col("nivel") == "EXACTO", 1).when(F.col("nivel") == "FUZZY_ALTO", 2).when(F.col("nivel") == "FUZZY_MEDIO", 3)
    m = model.withColumn("prioridad", pr).where("prioridad is not null").select(key, "codigo", "nivel", "score", "prioridad", F.lit("MODELO").alias("via"))
    x = text.select(key, "codigo", F.lit("TEXTO").alias("nivel"), F.col("sim").alias("score"), F.lit(4).alias("prioridad"), F.lit("TEXTO").alias("via"))
    u = m.unionByName(x).where("codigo is not null and codigo <> ''")
    return u.groupBy(key).agg(F.min_by(F.struct("codigo", "nivel", "score", "via"), F.struct("prioridad", -F.col("score"), "codigo")).alias("b")).select(key, "b.*")
