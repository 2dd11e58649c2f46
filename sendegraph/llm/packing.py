"""Filling fixed-capacity containers with documents.

Method: bound-certified repacking. Documents are spread by a hash over partitions
of about ``bins_per_group`` containers; each is packed best-fit decreasing. Dual
feasible functions give a lower bound of each partition's containers: where the
packing meets it, it is certified and final. Partitions with a gap exchange
documents: they are dealt out anew by another hash and packed again, until a
round neither certifies a partition nor saves a container. What then is left open
in the single partitions - at most the last container of each certified one, and
those with a gap - is packed together the same way; the whole is certified where
its containers meet the bound over all documents.

Only a document longer than the capacity is split: into full pieces and a rest.

Defined results: null and empty texts have no tokens and take up no room, but are
placed like the others; repeated rows of an id count once; a document id that
occurs with several texts is packed with each.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import materialize


def default_tokenizer() -> str:
    """The path of an installed public vocabulary for many languages."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def token_counts_udf(path: str):
    """Text to its number of tokens; the vocabulary is read once a Python worker."""

    @pandas_udf("long")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in it:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return run


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: largest first, each into the fullest container that takes it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    out, n = [0] * len(sizes), 0
    for i in order:
        k = bisect.bisect_left(room, (sizes[i], -1))
        if k == len(room):
            left, b = capacity, n
            n += 1
        else:
            left, b = room.pop(k)
        out[i] = b
        bisect.insort(room, (left - sizes[i], b))
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The most containers that any of the dual feasible functions proves necessary."""
    if not sizes:
        return 0
    best = max(math.ceil(sum(sizes) / capacity), 1)
    for k in (1, 2, 3, 4, 5):  # u_k: x to floor((k + 1) x) / k, multiples of 1 / (k + 1) to themselves
        s = sum(x / capacity if (x * (k + 1)) % capacity == 0 else ((x * (k + 1)) // capacity) / k for x in sizes)
        best = max(best, math.ceil(s - 1e-9))
    # U_e for every e: items over capacity - e fill a container, those under e count nothing
    up = sorted(sizes)
    sums = [0, *itertools.accumulate(up)]
    for e in {x for x in up if 0 < 2 * x <= capacity}:
        low, high = bisect.bisect_left(up, e), bisect.bisect_right(up, capacity - e)
        best = max(best, -(-((len(up) - high) * capacity + sums[high] - sums[low]) // capacity))
    return best


def pieces(documents: DataFrame, doc_id: str, text: str, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens): each document whole, or in pieces of the capacity and a rest if it exceeds it."""
    d = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), token_counts_udf(tokenizer or default_tokenizer())(F.col(text)).alias("n"))
    d = d.distinct()  # repeated rows, by a hash: no text is shuffled
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return d.select("doc_id", F.col("piece").cast("long").alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))


def _packer(capacity: int, r: int):
    """Packs one group; ``certified`` tells whether its bound proves the number of its containers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["n_tokens"].tolist()
        bins = best_fit_decreasing(sizes, capacity)
        n, bound = max(bins) + 1, lower_bound(sizes, capacity)
        fill = [0] * n
        for b, s in zip(bins, sizes):
            fill[b] += s
        emptiest = min(range(n), key=lambda b: (fill[b], b))
        return pdf.assign(container=[f"r{r}g{g}b{b}" for g, b in zip(pdf["g"], bins)], certified=n == bound, gap=n - bound, open=[b == emptiest for b in bins])[
            ["doc_id", "piece", "n_tokens", "g", "container", "certified", "gap", "open"]
        ]

    return run


def pack(items: DataFrame, capacity: int, bins_per_group: int = 512) -> DataFrame:
    """(doc_id, piece, n_tokens, container): items are (doc_id, piece, n_tokens) of at most the capacity.

    A group holds at most some thousand items whatever the table's size, so no
    task grows with the data.
    """
    id_type = dict(items.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, piece long, n_tokens long, g long, container string, certified boolean, gap long, open boolean"
    left, done, r = materialize(items.select("doc_id", "piece", "n_tokens"), "pieces"), None, 0
    before = None
    while True:
        total = left.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
        if not total["n"]:
            break
        n_groups = max(1, math.ceil(max(total["s"] / capacity / bins_per_group, total["n"] / (64 * bins_per_group))))
        key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(n_groups)).alias("g")
        packed = materialize(left.select("doc_id", "piece", "n_tokens", key).groupBy("g").applyInPandas(_packer(capacity, r), schema), "packed")
        # groups that meet their bound, the containers of all, and the gap of the others
        won = packed.groupBy("g").agg(F.max("gap").alias("gap"), F.count_distinct("container").alias("k")).agg(F.count_if(F.col("gap") == 0).alias("ok"), F.sum("k").alias("k"), F.sum("gap").alias("gap")).first()
        keep = lambda df: df.select("doc_id", "piece", "n_tokens", "container")
        again = before is not None and before["left"] == total["n"]
        stuck = won["ok"] == n_groups or (again and won["ok"] == 0 and won["k"] >= before["k"])
        if n_groups == 1 or (again and before["stuck"]):
            got, rest = keep(packed), None
        elif stuck:  # exchanging wins nothing more: all but the emptiest container of each group are final
            got, rest = keep(packed.where("NOT open")), packed.where("open")
        else:
            got, rest = keep(packed.where("certified AND NOT open")), packed.where("NOT certified OR open")
        before = {"left": total["n"], "k": won["k"], "stuck": stuck}
        done = got if done is None else done.unionByName(got)
        if rest is None:
            break
        left, r = rest.select("doc_id", "piece", "n_tokens"), r + 1
    if done is None:
        return items.withColumn("container", F.lit(""))
    return done


def proof(items: DataFrame, capacity: int) -> DataFrame:
    """(least_containers): the dual feasible bound over all items, in one pass.

    ``U_e`` is taken at 64 places e; any of them alone is a bound.
    """
    x, cap = F.col("n_tokens"), F.lit(capacity)
    sums = [F.ceil(F.sum(x) / cap)]
    for k in (1, 2, 3, 4, 5):
        m = x * (k + 1)
        sums.append(F.ceil(F.sum(F.when(m % cap == 0, x / cap).otherwise(F.floor(m / cap) / k)) - 1e-9))
    for e in sorted({max(1, capacity * i // 128) for i in range(1, 65)}):
        sums.append(F.ceil(F.sum(F.when(x > cap - e, cap).when(x >= e, x).otherwise(0)) / cap - 1e-9))
    return items.agg(F.greatest(*[F.coalesce(s, F.lit(0)) for s in sums]).cast("long").alias("least_containers"))
