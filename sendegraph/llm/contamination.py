"""Evaluation texts inside training text.

Method: size-partitioned MinHash containment search finds short test items inside
long documents; exact shingle containment verifies what it finds.

* Shingles are five words. A stretch of ``min_words`` words with at most one edit
  holds an unedited run of ``(min_words - 1) // 2`` words or more - seven of 15.
  Items are therefore cut into pieces of that size (three shingles), and the
  documents are compared piece by piece: at equal size, containment is equality
  and one MinHash value of the piece decides it without loss.
* Documents are partitioned by size. Those up to ``segment_words`` are one
  segment; longer ones are cut into overlapping segments, so that one very long
  text is many rows and no task holds more than it can.
* The MinHash value of a piece is the least hash of its shingles. Neighbouring
  pieces mostly share it, so a segment keeps few values, each once.
* Candidates (document segment, item) come from an equi-join on these values and
  are verified on the words themselves: maximal common runs of at least one
  shingle are extended over one changed, dropped or added word.

Defined results: null and empty texts contain nothing; items shorter than
``min_words`` are never found; repeated rows count once (the result is grouped, so
no text is shuffled to find them); a document id that occurs with several texts is
tested with each.

:func:`contained` is the search by sizes and signatures for items that stand in a
document wholly or nearly so: see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.pytext import words
from ..session import materialize

SHINGLE = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(ws: list[str], cache: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; the same on every machine."""
    import xxhash

    out = np.empty(len(ws), dtype=np.uint64)
    for i, w in enumerate(ws):
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def shingle_hashes(wh: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``size`` words."""
    n = len(wh) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ wh[k : k + n]) * _MUL
            h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return h


def piece_minhashes(wh: np.ndarray, piece_words: int, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct MinHash values of all pieces of ``piece_words`` words, as signed longs."""
    sh = shingle_hashes(wh, shingle)
    w = piece_words - shingle + 1
    if len(sh) < w:
        return np.empty(0, dtype=np.int64)
    m = np.lib.stride_tricks.sliding_window_view(sh, w).min(axis=1)
    return np.unique(m).view(np.int64)


def sketch_udf(piece_words: int):
    """Text of a segment (words joined by blanks) to its MinHash values."""

    @pandas_udf("array<long>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, int] = {}
        for texts in it:
            if len(cache) > 2_000_000:
                cache.clear()
            yield pd.Series([piece_minhashes(word_hashes(t.split(), cache), piece_words) for t in texts], dtype=object)

    return run


def segments_udf(segment_words: int, overlap: int):
    """Raw text to segments of words, joined by blanks."""

    @pandas_udf("array<string>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = segment_words - overlap
        for texts in it:
            out = []
            for t in texts:
                ws = words(t)
                out.append([" ".join(ws[i : i + segment_words]) for i in range(0, max(1, len(ws) - overlap), step)] if ws else [])
            yield pd.Series(out, dtype=object)

    return run


def longest_stretch(doc: list[str], item: list[str], shingle: int = SHINGLE) -> int:
    """Words of the item's longest stretch that the document repeats with at most one edit.

    A stretch is a common run, or two common runs with one word changed, dropped
    or added between them; one of the runs has a shingle at least.
    """
    where: dict[tuple, list[int]] = {}
    for i in range(len(item) - shingle + 1):
        where.setdefault(tuple(item[i : i + shingle]), []).append(i)
    best, done = 0, set()

    def ahead(j: int, i: int) -> int:
        n = 0
        while j + n < len(doc) and i + n < len(item) and doc[j + n] == item[i + n]:
            n += 1
        return n

    def back(j: int, i: int) -> int:
        n = 0
        while j - n >= 0 and i - n >= 0 and doc[j - n] == item[i - n]:
            n += 1
        return n

    for j in range(len(doc) - shingle + 1):
        for i in where.get(tuple(doc[j : j + shingle]), ()):
            if (j - 1, i - 1) in done:
                done.add((j, i))
                continue
            done.add((j, i))
            b = back(j - 1, i - 1)
            js, is_, n = j - b, i - b, b + ahead(j, i)
            best = max(best, n)
            je, ie = js + n, is_ + n
            for dj, di, extra in ((1, 1, 1), (0, 1, 1), (1, 0, 0)):
                r = ahead(je + dj, ie + di)
                if r:
                    best = max(best, n + extra + r)
                r = back(js - 1 - dj, is_ - 1 - di)
                if r:
                    best = max(best, n + extra + r)
    return best


def stretch_udf(shingle: int = SHINGLE):
    """The vectorised :func:`longest_stretch` of (segment, item), both words joined by blanks."""

    @pandas_udf("long")
    def run(seg: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([longest_stretch(a.split(), b.split(), shingle) for a, b in zip(seg, item)], dtype="int64")

    return run


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = 15,
    segment_words: int = 1024,
) -> DataFrame:
    """(doc_id, item_id, stretch_words): every item that leaked into a document, with its longest stretch there.

    Segments overlap by twice the longest stretch that one edit can spread
    ``min_words`` over, so each case lies whole in some segment; a longer stretch
    is measured within its segment.
    """
    piece = (min_words - 1) // 2
    overlap = 2 * (min_words + 1)
    segs = materialize(
        documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")
        .select("d", F.posexplode(segments_udf(segment_words, overlap)("t")).alias("seg", "words"))
        .where(F.size(F.split("words", " ")) >= min_words - 1),
        "segments",
    )
    its = materialize(
        items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''").distinct()
        .select("i", F.explode(segments_udf(segment_words, overlap)("t")).alias("iwords")),
        "items",
    )
    sketch = sketch_udf(piece)
    keys = materialize(its.select("i", "iwords", F.explode(sketch("iwords")).alias("h")).select("h", "i", F.xxhash64("iwords").alias("part")), "itemkeys")
    cand = (
        segs.select("d", "seg", F.xxhash64("words").alias("w"), F.explode(sketch("words")).alias("h"))
        .join(keys, "h")
        .select("d", "seg", "w", "i", "part")
        .distinct()
    )
    cand = materialize(cand, "candidates")
    return (
        cand.join(segs.withColumn("w", F.xxhash64("words")), ["d", "seg", "w"])
        .join(its.withColumn("part", F.xxhash64("iwords")), ["i", "part"])
        .select("d", "i", stretch_udf()("words", "iwords").alias("n"))
        .where(F.col("n") >= min_words)
        .groupBy("d", "i")
        .agg(F.max("n").alias("stretch_words"))
        .select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "stretch_words")
    )


def signature_udf(n_hashes: int, shingle: int = SHINGLE):
    """Words joined by blanks to (number of distinct shingles, ``n_hashes`` MinHash values)."""

    @pandas_udf("struct<size:int,sig:array<long>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mul = np.random.default_rng(7).integers(1, 2**63, n_hashes, dtype=np.uint64) | np.uint64(1)
        cache: dict[str, int] = {}
        for texts in it:
            size, sig = [], []
            for t in texts:
                if len(cache) > 2_000_000:
                    cache.clear()
                sh = np.unique(shingle_hashes(word_hashes(t.split(), cache), shingle))
                size.append(len(sh))
                if not len(sh):
                    sig.append(None)
                    continue
                low = np.full(n_hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(0, len(sh), 512):
                        h = sh[i : i + 512, None] * mul[None, :]
                        h ^= h >> np.uint64(31)
                        h *= _MIX
                        low = np.minimum(low, h.min(axis=0))
                sig.append(low.view(np.int64))
            yield pd.DataFrame({"size": size, "sig": sig})

    return run


def bands_for(threshold: float, most: int, query: int, n_hashes: int, recall: float = 0.99) -> int:
    """Rows a band for documents of up to ``most`` shingles and items of ``query``: the most rows at which a pair at the threshold meets with probability ``recall``.

    At containment t of an item of q shingles in a document of u, the Jaccard
    similarity is t q / (q + u - t q); n // r bands of r rows find it with
    probability 1 - (1 - J ** r) ** (n // r).
    """
    j = threshold * query / (query + most - threshold * query)
    return max((r for r in range(1, 9) if 1 - (1 - j**r) ** (n_hashes // r) >= recall), default=1)


def contained(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    threshold: float = 0.8,
    n_hashes: int = 128,
    segment_words: int = 256,
) -> DataFrame:
    """(doc_id, item_id, containment): items of whose word shingles at least ``threshold`` stand in one stretch of a document.

    Size-partitioned MinHash containment search. Long documents are cut into
    segments that overlap by the longest item's words, so that no segment is out of
    proportion to an item; segments and items fall into partitions by the power of
    two of their shingles, and each pair of partitions has its own bands, tuned to
    the Jaccard similarity that the threshold means at these sizes. Candidates are
    verified by exact shingle containment. Recall of the search is that of the
    bands (``bands_for``, 0.99 at the threshold where ``n_hashes`` allow it); every
    row found is exact. Items without a shingle are never found.
    """
    its = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")
    its = materialize(its.select("i", F.explode(segments_udf(1_000_000, 0)("t")).alias("iwords")), "items")
    longest = its.agg(F.max(F.size(F.split("iwords", " ")))).first()[0] or 1
    step = max(segment_words, 2 * longest)
    segs = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")
    segs = segs.select("d", F.posexplode(segments_udf(step, longest)("t")).alias("seg", "words"))
    sig, part = signature_udf(n_hashes), lambda c: F.floor(F.log2(c)).cast("int")
    segs = materialize(segs.withColumn("s", sig("words")).where("s.size > 0").select("d", "seg", "words", part(F.col("s.size")).alias("p"), "s.sig"), "signatures")
    its = materialize(its.withColumn("s", sig("iwords")).where("s.size > 0").select("i", "iwords", part(F.col("s.size")).alias("q"), "s.sig"), "itemsigs")
    sizes = lambda df, c: [r[0] for r in df.select(c).distinct().collect()]  # noqa: E731  (powers of two: some twenty)
    rows_of = {(p, q): bands_for(threshold, 2 ** (p + 1), 2**q, n_hashes) for p in sizes(segs, "p") for q in sizes(its, "q") if p >= q - 1}

    def banded(df: DataFrame, keep: list[str], mine: str) -> DataFrame:
        def bands(r: int):
            cut = F.transform(F.sequence(F.lit(0), F.lit(n_hashes // r - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * r + 1, F.lit(r))))
            return F.transform(cut, lambda h: F.struct(F.lit(r).alias("r"), h.alias("h")))

        out = None
        for r in sorted(set(rows_of.values())):
            parts = sorted({(p if mine == "p" else q) for (p, q), x in rows_of.items() if x == r})
            d = df.where(F.col(mine).isin(parts)).select(*keep, mine, F.explode(bands(r)).alias("b"))
            out = d if out is None else out.unionByName(d)
        return out

    if not rows_of:
        return documents.select(F.col(doc_id)).limit(0).crossJoin(items.select(F.col(item_id)).limit(0)).withColumn("containment", F.lit(0.0))
    pairs = documents.sparkSession.createDataFrame([(p, q, r) for (p, q), r in rows_of.items()], "p int, q int, r int")
    cand = banded(segs, ["d", "seg"], "p").join(banded(its, ["i"], "q"), "b").join(F.broadcast(pairs.withColumnRenamed("r", "need")), ["p", "q"])  # a few hundred rows
    cand = materialize(cand.where("b.r = need").select("d", "seg", "i").distinct(), "candidates")

    @pandas_udf("double")
    def share(seg: pd.Series, item: pd.Series) -> pd.Series:
        def grams(t: str) -> set:
            w = t.split()
            return {tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)}

        return pd.Series([len(grams(b) & grams(a)) / max(1, len(grams(b))) for a, b in zip(seg, item)], dtype="float64")

    full = cand.join(segs.select("d", "seg", "words"), ["d", "seg"]).join(its.select("i", "iwords"), "i").select("d", "i", share("words", "iwords").alias("c"))
    return full.where(F.col("c") >= threshold).groupBy("d", "i").agg(F.round(F.max("c"), 6).alias("containment")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "containment")
