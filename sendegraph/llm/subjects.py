"""Subject areas of documents by class-association rules.

Method: the sentences of hand-labelled documents are transactions of items (words
and stems of compounds) with their subject; parallel frequent-pattern growth
mines the frequent itemsets, itemsets with a subject give rules, redundant rules
go, and the log-odds of the rules that match a sentence are its evidence. The
evidence is calibrated to a probability on labelled documents held out from
mining (a fifth of the sample, by a hash of the id); a sentence is on a subject if
that is the more probable case, and a document has the subjects that make up at
least ``min_share`` of its sentences on any subject.

The rules are fitted on at most ``max_labelled`` labelled documents (taken by a
hash of their id), so their number is bounded and they may travel to every task;
scoring reads every document whole.

Defined results: null and empty texts, and texts without a sentence on a subject,
have no row; labels of unknown documents are ignored; repeated labels count once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.pytext import fold, plain
from ..session import materialize

LABEL = "="
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence; sentences without words are left out."""
    out = [_WORD.findall(fold(s)) for s in _SENTENCE.split(plain(text))]
    return [w for w in out if w]


def sentences_udf():
    @pandas_udf("array<array<string>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([sentences(t) for t in texts], dtype=object)

    return run


def common_tails(words: DataFrame, min_heads: int = 20, min_uses: int = 2) -> frozenset[str]:
    """Ends of words that follow many different beginnings: the second parts of compounds. ``words`` has (w)."""
    w = words.groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") >= min_uses) & (F.length("w") >= 8))
    cut = w.select("w", F.explode(F.sequence(F.lit(4), F.length("w") - 4)).alias("k"))
    tails = cut.groupBy(F.expr("substring(w, k)").alias("tail")).agg(F.count("*").alias("heads")).where(F.col("heads") >= min_heads)
    return frozenset(r["tail"] for r in tails.select("tail").collect())  # words of the labelled sample, which is bounded


def word_items(w: str, tails: frozenset[str]) -> list[str]:
    """The items of a word, the most special first: itself, and its stem before the longest common tail."""
    for k in range(3, len(w) - 4):
        if w[k:] in tails:
            return ["w:" + w, "s:" + w[:k]]
    return ["w:" + w]


def items_udf(tails: frozenset[str], keep: frozenset[str] | None = None):
    """Words of a sentence to its distinct items."""

    @pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for ws in col:
            got = {i for w in ws for i in word_items(w, tails)}
            out.append(sorted(got if keep is None else got & keep))
        return pd.Series(out, dtype=object)

    return run


class Rules:
    """Rules and the support of single items; a plain value that tasks can carry."""

    def __init__(self, tails: frozenset[str], support: dict[str, int], single: dict[str, tuple[str, float]], multi: dict[tuple, tuple[str, float]], special: int = 8):
        self.tails, self.support, self.single, self.multi, self.special = tails, support, single, multi, special
        self.steps: list[tuple[float, float]] = [(0.0, 1.0)]
        self.by_first = defaultdict(list)
        for x in multi:
            self.by_first[x[0]].append(x)
        self.in_multi = {i for x in multi for i in x}
        self.cache: dict[str, tuple[list[str], list[str]]] = {}

    def items_of(self, w: str) -> tuple[list[str], list[str]]:
        """(items that are judged, all items) of a word; items without a rule are left out."""
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            its = word_items(w, self.tails)
            judged = its[:1] if self.support.get(its[0], 0) >= self.special else its
            got = self.cache[w] = ([i for i in judged if i in self.single], [i for i in its if i in self.in_multi])
        return got

    def evidence(self, ws: list[str]) -> tuple[str | None, float]:
        """The subject with the most evidence, and its lead over the next one.

        A word that was seen often enough itself is not judged by its stem, and
        a rule on several items replaces those on its parts.
        """
        used: list[str] = []
        have: set[str] = set()
        for w in set(ws):
            judged, its = self.items_of(w)
            used += judged
            have.update(its)
        score: dict[str, float] = defaultdict(float)
        covered: set[str] = set()
        for first in have:
            for x in self.by_first.get(first, ()):
                if have.issuperset(x):
                    c, v = self.multi[x]
                    score[c] += v
                    covered.update(x)
        for i in set(used) - covered:
            if i in self.single:
                c, v = self.single[i]
                score[c] += v
        if not score:
            return None, 0.0
        top = sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))
        return top[0][0], top[0][1] - (top[1][1] if len(top) > 1 else 0.0)


    def probability(self, lead: float) -> float:
        """How probable the subject of this lead is: a rising step function, 1 where nothing was held out."""
        p = 0.0
        for least, q in self.steps:
            if lead >= least:
                p = q
        return p


def rising(bins: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """(lead, hits, uses) in order of the lead to steps (lead, probability) that never fall: neighbours that do are pooled."""
    out: list[list[float]] = []
    for lead, hit, n in bins:
        out.append([lead, hit, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, h, m = out.pop()
            out[-1][1] += h
            out[-1][2] += m
    return [(x, (h + 0.5) / (m + 1)) for x, h, m in out]


def judge_udf(rules: Rules):
    """Text to the subjects of its sentences on any subject."""

    @pandas_udf("array<string>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            out = []
            for t in texts:
                got = (rules.evidence(ws) for ws in sentences(t))
                out.append([c for c, v in got if c is not None and rules.probability(v) >= 0.5])
            yield pd.Series(out, dtype=object)

    return run


def _mine(trans: DataFrame, n_classes: int, min_count: int, min_conf: float) -> tuple[dict, dict, dict]:
    """Support of single items and rules of single and several items, from (items, labels)."""
    from pyspark.ml.fpm import FPGrowth

    total = trans.count()
    if not total:
        return {}, {}, {}
    flat = trans.select(F.explode("items").alias("i"), "labels")
    per = flat.select("i", F.explode("labels").alias("c"), (1.0 / F.size("labels")).alias("w")).groupBy("i", "c").agg(F.sum("w").alias("w"))
    lean = per.groupBy("i").agg(F.sum("w").alias("n"), F.max("w").alias("m")).where(F.col("n") >= min_count)
    support, telling = {}, set()
    for r in lean.collect():
        support[r["i"]] = round(r["n"])
        if r["m"] / r["n"] > max(2.0 / n_classes, 0.25):
            telling.add(r["i"])
    keep = frozenset(telling)

    @pandas_udf("array<string>")
    def select(col: pd.Series) -> pd.Series:
        return pd.Series([sorted(keep.intersection(x)) for x in col], dtype=object)

    tr = trans.select(select("items").alias("items"), "labels").where(F.size("items") > 0)
    if tr.isEmpty():
        return support, {}, {}
    tr = materialize(tr.select(F.concat("items", F.transform("labels", lambda c: F.concat(F.lit(LABEL), c))).alias("items")), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=min_count / total * 0.999, numPartitions=int(trans.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(tr)
    sets = model.freqItemsets
    is_label = lambda x: x.startswith(LABEL)
    parts = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("x"), F.filter("items", is_label).alias("c"), "freq")
    base = parts.where(F.size("c") == 0).select("x", F.col("freq").alias("n"))
    both = parts.where((F.size("c") == 1) & (F.size("x") > 0)).select("x", F.col("c")[0].alias("c"), F.col("freq").alias("nc"))
    found = both.join(base, "x").groupBy("x", "n").agg(F.max(F.struct("nc", "c")).alias("s"))
    conf: dict[tuple, tuple[str, float, int]] = {}
    for r in found.where(F.col("s.nc") >= min_conf * (F.col("n") + 1)).collect():
        conf[tuple(r["x"])] = (r["s"]["c"][len(LABEL):], r["s"]["nc"] / (r["n"] + 1), r["n"])
    single, multi = {}, {}
    odds = lambda p: math.log(p / (1 - min(p, 0.99)) * (n_classes - 1))
    for x, (c, p, _) in conf.items():
        if len(x) == 1:
            single[x[0]] = (c, odds(p))
            continue
        # redundant: a part of the rule says the same subject as surely, or is a form of the same word
        subsets = [tuple(y for y in x if y != z) for z in x]
        if any(s in conf and conf[s][0] == c and conf[s][1] >= p - 0.05 for s in subsets):
            continue
        multi[x] = (c, odds(p))
    return support, single, multi


def fit_rules(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000, min_count: int = 4, min_conf: float = 0.45) -> Rules:
    """Rules fitted on four fifths of the labelled documents in two passes, and calibrated on the others.

    The first pass gives every sentence all labels of its document; the second
    gives it the one the rules see in it, where that is among them.
    """
    lab = labels.where("doc_id IS NOT NULL AND subject_code IS NOT NULL AND subject_code <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_code")).alias("labels"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0).alias("held")
    docs = documents.select("doc_id", "text").join(lab, "doc_id").select("labels", held, sentences_udf()("text").alias("ss"))
    sents = materialize(docs.select("labels", "held", F.explode("ss").alias("ws")), "labelled")
    n_classes = max(2, lab.select(F.explode("labels").alias("c")).distinct().count())
    tails = common_tails(sents.select(F.explode("ws").alias("w")))
    every = materialize(sents.select("ws", "labels", "held", items_udf(tails)("ws").alias("items")), "items")
    trans = every.where("NOT held")
    rules = Rules(tails, *_mine(trans, n_classes, min_count, min_conf))

    def single_judge(rules: Rules):
        @pandas_udf("struct<subject:string,lead:double>")
        def run(col: pd.Series) -> pd.DataFrame:
            got = [rules.evidence(list(ws)) for ws in col]
            return pd.DataFrame({"subject": [c for c, _ in got], "lead": [float(v) for _, v in got]})

        return run

    seen = trans.withColumn("j", single_judge(rules)("ws"))
    inside = F.array_contains("labels", F.col("j.subject"))
    second = seen.where(F.col("j.subject").isNull() | inside).select(
        "ws", "items", F.when(F.col("j.subject").isNotNull(), F.array("j.subject")).otherwise(F.col("labels")).alias("labels")
    )
    rules = Rules(tails, *_mine(materialize(second, "second"), n_classes, min_count, min_conf))
    hits = (
        every.where("held").withColumn("j", single_judge(rules)("ws")).where(F.col("j.subject").isNotNull())
        .groupBy(F.floor(F.col("j.lead") * 2).alias("bin")).agg(F.sum(inside.cast("int")).alias("hit"), F.count("*").alias("n")).orderBy("bin").collect()
    )  # as many rows as steps of half a unit
    if hits:
        rules.steps = rising([(r["bin"] / 2, r["hit"], r["n"]) for r in hits])
    return rules


def subject_shares(documents: DataFrame, rules: Rules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject_code, n_sentences, share): the subjects of each document's sentences on any subject."""
    judged = documents.select(F.col(doc_id), judge_udf(rules)(F.col(text)).alias("j"))
    long = judged.select(doc_id, F.size("j").alias("all"), F.explode("j").alias("subject_code"))
    return long.groupBy(doc_id, "all", "subject_code").agg(F.count("*").alias("n_sentences")).select(
        doc_id, "subject_code", "n_sentences", (F.col("n_sentences") / F.col("all")).alias("share")
    )


def document_subjects(documents: DataFrame, labels: DataFrame, min_share: float = 0.25, **fit) -> DataFrame:
    """(doc_id, subject_code, share) of the subjects that make up at least ``min_share``."""
    return subject_shares(documents, fit_rules(documents, labels, **fit)).where(F.col("share") >= min_share).select("doc_id", "subject_code", "share")
