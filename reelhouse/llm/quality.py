"""Quality classifier by positive-unlabelled learning.

A small network is fitted to bounded samples: trusted positives (documents labelled 1) and
unlabelled web text. With class prior p, loss l and network g it minimises the non-negative
unbiased risk

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

where a batch whose second term is negative takes a step against that term instead. Labels 0 only
enter the estimate of the class prior. The inputs are shares and rates of characters, words and
lines of the whole text; labels, language, source and id are never among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import word_hashes, words

#: Bounds of the samples that are fitted on the driver: rows of about 20 numbers.
MAX_POSITIVES = 12_000
MAX_UNLABELLED = 24_000
#: A score from which a document counts as good.
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|/\\",
    "mark": b"#$%&*+=<>@^_~",
    "bracket": b"()[]{}",
    "quote": b"'\"`-",
    "line": b"\n",
}
FEATURES = [
    *_CLASSES,
    "wide",
    "control",
    "words",
    "word_length",
    "long_words",
    "short_words",
    "distinct",
    "stuttered",
    "common_word",
    "marked_words",
    "upper_words",
    "words_a_stop",
]


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each whole text; an empty or null text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, data, offsets in common.text_chunks(texts):
        n_texts = len(offsets) - 1
        size = np.maximum(np.diff(offsets), 1)
        named = dict.fromkeys(FEATURES, np.zeros(n_texts))

        def count(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask)])
            return sums[at[1:]] - sums[at[:-1]]

        marks = np.zeros(len(data), bool)
        for name, chars in _CLASSES.items():
            table = np.zeros(256, bool)
            table[list(chars)] = True
            mask = table[data]
            named[name] = count(mask, offsets) / size
            if name in ("shout", "bar", "mark", "bracket"):
                marks |= mask
            if name == "upper":
                upper = mask
        named["wide"] = count(data >= 0xC0, offsets) / size
        named["control"] = count((data < 32) & (data != 10), offsets) / size
        starts, ends, first = words(data, offsets)
        n = np.diff(first)
        some = np.maximum(n, 1)
        length = ends - starts
        named["words"] = np.log1p(n) / 10
        named["word_length"] = count(length, first) / some / 10
        named["long_words"] = count(length > 20, first) / some
        named["short_words"] = count(length <= 2, first) / some
        named["words_a_stop"] = np.minimum(n / np.maximum(count(data == 46, offsets), 1), 100) / 100
        if len(starts):
            each = np.repeat(np.arange(n_texts), n)
            h = word_hashes(data, starts, ends)
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (each[1:] == each[:-1])])
            named["stuttered"] = count(same, first) / some
            order = np.lexsort((h, each))
            h, e = h[order], each[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (e[1:] != e[:-1])])
            named["distinct"] = count(new, first) / np.maximum(n, 1) ** 0.9
            at = np.flatnonzero(new)
            most = np.zeros(n_texts)
            np.maximum.at(most, e[at], np.diff(np.concatenate([at, [len(h)]])))
            named["common_word"] = most / some
            sums = np.concatenate([[0], np.cumsum(marks)])
            named["marked_words"] = count(sums[ends] > sums[starts], first) / some
            sums = np.concatenate([[0], np.cumsum(upper)])
            named["upper_words"] = count(sums[ends] - sums[starts] >= 2, first) / some
        out[row : row + n_texts] = np.stack([named[f] for f in FEATURES], axis=1)
    return out


@dataclass
class Model:
    """Standardisation and the network's weights; without positives to learn from, every score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(x))
        w, b, v, c = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ w + b) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 60, seed: int = 0) -> Model:
    """Minimise the non-negative unbiased risk with logistic loss by Adam."""
    every = np.concatenate([positives, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    k = every.shape[1]
    weights = [rng.normal(0, k**-0.5, (k, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    model = Model(mean, scale, weights)
    pos, unl = (np.clip((x - mean) / scale, -6, 6) for x in (positives, unlabelled))
    slow, fast, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = max(1, min(40, len(unl) // 256))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        po, uo = rng.permutation(len(pos)), rng.permutation(len(unl))
        for a, b in zip(np.array_split(po, steps), np.array_split(uo, steps)):
            if not len(a) or not len(b):
                continue
            z = np.concatenate([pos[a], unl[b]])
            h = np.tanh(z @ weights[0] + weights[1])
            g = h @ weights[2] + weights[3][0]
            up = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # the slope of l(-g); that of l(g) is up - 1
            good = np.arange(len(z)) < len(a)
            loss = np.logaddexp(0, g)
            negative = loss[~good].mean() - prior * loss[good].mean()
            negative_slope = np.where(good, -prior * up / len(a), up / len(b))
            if negative >= 0:
                slope = np.where(good, prior * (up - 1) / len(a), 0) + negative_slope
            else:
                slope = -negative_slope
            back = np.outer(slope, weights[2]) * (1 - h**2)
            grads = [z.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]
            t += 1
            for i, grad in enumerate(grads):
                grad = grad + 1e-4 * weights[i]
                slow[i] = 0.9 * slow[i] + 0.1 * grad
                fast[i] = 0.999 * fast[i] + 0.001 * grad**2
                weights[i] -= rate * (slow[i] / (1 - 0.9**t)) / (np.sqrt(fast[i] / (1 - 0.999**t)) + 1e-8)
    return model


def features_column(spark: SparkSession, text: Column) -> Column:
    common.importable_on_workers(spark)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(list(features(texts)), pa.list_(pa.float64()))

    return of(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Fit on labels outside the held-out fold.

    The samples are the ``max_positives`` positives and ``max_unlabelled`` documents whose ids have the
    smallest hashes: bounded, repeatable and spread over the whole corpus. The class prior is
    the share of 1 among all labels outside the held-out fold, with one of either kind added. Null
    labels and ids are left out; a document with several labels counts as positive if one is 1.
    """
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = docs.select(F.col(id_col)).where(F.col(id_col).isNotNull() & ~held_out(id_col))
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col(id_col).isNotNull() & F.col("label").isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts.get(1):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), [])
    prior = (counts[1] + 1) / (sum(counts.values()) + 2)
    positive = known.where("label = 1").orderBy(order, id_col).limit(max_positives).select(id_col, F.lit(True).alias("pos"))
    unlabelled = ids.orderBy(order, id_col).limit(max_unlabelled).select(id_col, F.lit(False).alias("pos"))
    chosen = positive.unionByName(unlabelled).groupBy(id_col).agg(
        F.max("pos").alias("pos"), F.min("pos").alias("both")
    )
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(chosen.select(id_col), id_col, "left_semi")
    rows = texts.select(id_col, features_column(docs.sparkSession, F.col("text")).alias("x")).join(chosen, id_col)
    rows = rows.select("pos", "both", "x", F.xxhash64(id_col, "x").alias("o")).orderBy("o").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), [])
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    pos, both = (rows[k].to_numpy() for k in ("pos", "both"))
    positives, web = x[pos], x[~both]
    if not len(positives) or not len(web):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), [])
    return fit(positives, web, prior)


def score_column(spark: SparkSession, text: Column, model: Model) -> Column:
    """A score from 0 to 1 for each whole text, empty and null ones included."""
    common.importable_on_workers(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(features(texts)))

    return of(text)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``; columns and other rows unchanged.

    Rows with null or empty text are scored as the empty text. Repeated rows score alike; an
    empty table stays empty. Extra columns of any name pass through.
    """
    model = train(docs, labels, text_col=text_col, **options)
    score = common.spare_name(docs, "score")
    scored = docs.withColumn(score, score_column(docs.sparkSession, F.col(text_col), model))
    return scored.where(F.col(score) >= threshold).drop(score)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(spark, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
