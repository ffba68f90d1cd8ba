"""Quality classifier by positive-unlabelled learning.

Whole texts become a few hundred numbers: word, letter, line and repetition statistics, and the shares of hashed
word 1- and 2-grams and of hashed byte 3-grams, scaled down since each alone says little. Only the sampled rows'
numbers are gathered; every other text is read, turned into numbers and scored in one pass. A small network is trained on the driver with numpy: rows labelled 1 are trusted positives, a sample of all
texts is unlabelled, and the share of positives in it (the class prior) is estimated from these two samples: a
first model tells positives from unlabelled texts, and at the threshold where it keeps few unlabelled texts for many
positives the ratio of both shares bounds the prior from above; the lowest bound, with room for the samples' errors,
is taken, less those errors. The loss is the non-negative unbiased risk: prior * risk of positives as 1, plus the risk of the
unlabelled as 0 less prior * risk of positives as 0, the latter part never below zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.arrow import as_text, by_slice
from wearcast.llm.store import written

#: Rows of each kind that the model is fitted on, at most; a documented bound (everything is scored).
FIT_ROWS = 12_000
FEATURES = ("log_words", "word_length", "word_spread", "upper", "symbols", "bars", "calls", "stops", "digits",
            "distinct", "adjacent", "short", "long", "words_per_line", "lines_repeated", "wide", "other")


#: Buckets of hashed word 1- and 2-grams and of hashed byte 3-grams (powers of two).
WORD_BUCKETS, BYTE_BUCKETS = 128, 128
#: What an n-gram column counts beside one of FEATURES, all of them standardised first.
GRAM_WEIGHT = 0.25
COLUMNS = len(FEATURES) + WORD_BUCKETS + BYTE_BUCKETS
MIX = np.uint64(0x9E3779B97F4A7C15)


def _shares(row: np.ndarray, h: np.ndarray, texts: int, buckets: int) -> np.ndarray:
    """Square roots of the shares of each row's hashes in buckets by their top bits."""
    at = (h >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
    count = np.bincount(row * buckets + at, minlength=texts * buckets).reshape(texts, buckets)
    return np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1))


def grams(texts: pa.Array) -> np.ndarray:
    """One row per text (no nulls): shares of hashed word 1- and 2-grams, lower case, then of hashed byte 3-grams."""
    d = len(texts)
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = words.flatten()
    row = np.repeat(np.arange(d), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    flat, row = flat.filter(pa.array(real)), row[real]
    coded = flat.dictionary_encode()
    distinct = np.array(coded.dictionary.to_pylist(), dtype=object)
    h = pd.util.hash_array(distinct, categorize=False)[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)
    near = row[1:] == row[:-1]
    pairs = ((h[:-1] * MIX) ^ (h[1:] + MIX)) * MIX
    by_word = _shares(np.r_[row, row[1:][near]], np.r_[h * MIX, pairs[near]], d, WORD_BUCKETS)
    start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + d + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[start[0]:start[-1]].astype(np.uint64) if held and d else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(d), np.diff(start))
    within = of[2:] == of[:-2]
    three = (data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) * MIX
    return np.hstack([by_word, _shares(of[2:][within], three[within], d, BYTE_BUCKETS)])


def columns(texts: pa.Array) -> np.ndarray:
    """All COLUMNS of each text, as the model reads them before they are scaled."""
    return np.hstack([features(texts), grams(texts)]).astype(np.float32)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text (no nulls); an empty text has zeros."""
    d = len(texts)
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    row = np.repeat(np.arange(d), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == 0).any():
        real = size > 0
        flat, row, size = flat.filter(pa.array(real)), row[real], size[real]
    coded = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    per = lambda r, w=None: np.bincount(r, w, d).astype(np.float64)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    n = per(row)
    some = np.maximum(n, 1)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    letters = np.maximum(count("[A-Za-z]"), 1)
    mean = per(row, size) / some
    key = np.unique(row * (len(coded) + 1) + coded) // (len(coded) + 1)
    next_same = (coded[1:] == coded[:-1]) & (row[1:] == row[:-1])
    lines = pc.split_pattern(texts, "\n")
    line_row = np.repeat(np.arange(d), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    line = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    line_n = np.maximum(per(line_row), 1)
    line_distinct = per(np.unique(line_row * (len(line) + 1) + line) // (len(line) + 1))
    symbols = count("[#*$%&]")
    marks = count("[.,;:?]")
    bars, calls, digits = count("[|<>]"), count("!"), count("[0-9]")
    out = np.column_stack([
        np.log1p(n), mean, np.sqrt(np.maximum(per(row, size**2) / some - mean**2, 0)), count("[A-Z]") / letters,
        symbols / some, bars / some, calls / some, marks / some, digits / chars,
        np.log1p(per(key)) / np.log1p(some), per(row[1:][next_same]) / some, per(row[size <= 3]) / some,
        per(row[size >= 8]) / some, np.log1p(n / line_n), 1 - line_distinct / line_n, count("[^\\x00-\\x7f]") / chars,
        count("[^\\p{L}\\s.,;:?|<>!0-9#*$%&]") / chars])
    out[n == 0] = 0
    return out.astype(np.float32)


class Network:
    """One hidden layer; weights are plain arrays."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        g = np.random.default_rng(seed)
        self.w = [g.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), g.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3]

    def gradient(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = np.outer(g, self.w[2]) * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 1500,
        batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7, unbiased: bool = True) -> Network:
    """Adam on the non-negative unbiased risk with logistic loss; without ``unbiased`` the unlabelled count as 0."""
    g = np.random.default_rng(seed)
    net = Network(positive.shape[1], hidden, seed)
    first = [np.zeros_like(w) for w in net.w]
    second = [np.zeros_like(w) for w in net.w]
    for step in range(1, steps + 1):
        p = positive[g.integers(0, len(positive), batch)]
        u = unlabelled[g.integers(0, len(unlabelled), batch)]
        hp, zp = net.forward(p)
        hu, zu = net.forward(u)
        # Logistic loss: as 1 log(1 + e^-z), as 0 log(1 + e^z).
        share = prior if unbiased else 0.0
        unlabelled_risk = np.logaddexp(0, zu).mean() - share * np.logaddexp(0, zp).mean()
        as_zero = [a / batch - share * b / batch for a, b in zip(
            net.gradient(u, hu, sigmoid(zu)), net.gradient(p, hp, sigmoid(zp)), strict=True)]
        if unlabelled_risk >= 0:
            as_one = net.gradient(p, hp, sigmoid(zp) - 1)
            grad = [prior * a / batch + b for a, b in zip(as_one, as_zero, strict=True)]
        else:  # the model fits the sample's positives away: step back
            grad = [-b for b in as_zero]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, w in enumerate(net.w):
            d = grad[k] + decay * w
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            w -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7, room: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, from both samples alone (best-bin estimation).

    A model fitted on one half of both samples orders the other half. If positives among the unlabelled look like the
    trusted ones, the share of unlabelled rows over a threshold is at least prior * the share of positives over it.
    The ratio is taken where it is least, with the samples' deviations (probability 0.1) added at every threshold.
    Of the estimate's range the lower end is returned: a prior that is too low by some share lowers positives' scores
    by that share, while one that is too high counts negatives as positives."""
    g = np.random.default_rng(seed)
    p, u = positive[g.permutation(len(positive))], unlabelled[g.permutation(len(unlabelled))]
    if min(len(p), len(u)) < 4:
        return 0.5
    net = fit(p[::2], u[::2], 0.5, steps=600, seed=seed, unbiased=False)
    zp, zu = np.sort(net.forward(p[1::2])[1]), np.sort(net.forward(u[1::2])[1])
    over_p = 1 - np.arange(len(zp)) / len(zp)
    over_u = 1 - np.searchsorted(zu, zp) / len(zu)
    slack = sum(np.sqrt(np.log(4 / 0.1) / (2 * len(z))) for z in (zp, zu))
    best = int(np.argmin((over_u + (1 + room) * slack) / over_p))
    return float(np.clip(over_u[best] / over_p[best] - slack, 0.01, 0.99))


def _hash(key: str, text: str) -> Column:
    """The 63-bit hash of key and text by which rows are drawn."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(10), key, text), 1)


def _below(total: int, most: int) -> Column:
    """A bound on the hash that leaves about twice ``most`` of ``total`` rows."""
    return F.lit(min(2**63 - 1, int(2**63 * min(1.0, 2 * most / max(total, 1)))))


def _sample(rows: DataFrame, total: int, most: int) -> np.ndarray:
    """The columns of at most ``most`` of the ``total`` rows (_key, _text), those of least hashes of key and text.

    A threshold on the hash leaves about twice as many, whose columns, of fixed size, are sorted by it, so the bound holds
    for any keys, any texts and any size. Equal rows are chosen or left together; where that leaves nothing, any rows serve."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = columns(as_text(batch.column(0)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, COLUMNS, dtype=np.int32)), pa.array(f.reshape(-1)))
        return pa.RecordBatch.from_arrays([lists, batch.column(1)], names=["_f", "_h"])

    told = lambda some: some.mapInArrow(by_slice(work, "_text"), "_f array<float>, _h long")
    hashed = rows.select("_text", _hash("_key", "_text").alias("_h"))
    got = (told(hashed.where(F.col("_h") <= _below(total, most))).orderBy("_h", "_f").limit(most).select("_f").collect()
           or told(hashed.limit(most)).select("_f").collect())
    return np.array([r["_f"] for r in got], np.float64).reshape(-1, COLUMNS)


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS, key: str = "doc_id",
    text: str = "text", label: str = "quality", folds: int = 5, held_out_fold: int = 0,
) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Labels are read only of rows whose crc32(key as text) mod ``folds`` is not ``held_out_fold``; the model
    sees numbers taken from the text and nothing else. At most ``fit_rows`` trusted positives (label 1; other
    labels aren't used) and as many unlabelled texts, drawn from all of them, are used to fit and to estimate the prior.

    A null or empty text has zeros and gets a score too; a null key is never held out nor labelled;
    rows sharing a key are scored one by one, and a text of any length is read whole. Without any labelled positive every score is 0. An empty
    table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    fold = F.pmod(F.crc32(F.col("_key").cast("string")), F.lit(folds)) == held_out_fold
    out = F.coalesce(fold, F.lit(False))
    known = labels.select(F.col(key).alias("_key")).where((F.col(label) == 1) & F.col("_key").isNotNull() & ~fold).distinct()
    # Texts don't move: the positives are told by key and hash, and the drawn ones, a bounded number, go back to the texts.
    trusted = written(rows.select("_key", _hash("_key", "_text").alias("_h")).join(known, "_key").distinct(), "trusted")
    count = trusted.count()
    if not count:
        return rows.select(F.col("_key").alias(key), out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    total = rows.count()
    drawn = trusted.where(F.col("_h") <= _below(count, fit_rows)).orderBy("_h", "_key").limit(fit_rows)
    drawn = F.broadcast(written(drawn if not drawn.isEmpty() else trusted.limit(fit_rows), "drawn"))
    hashed = rows.withColumn("_h", _hash("_key", "_text"))
    positive = _sample(hashed.join(drawn, ["_key", "_h"], "left_semi").select("_key", "_text"), 1, fit_rows)
    unlabelled = _sample(rows, total, fit_rows)
    mean, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    weight = np.where(np.arange(COLUMNS) < len(FEATURES), 1.0, GRAM_WEIGHT)
    scale = lambda x: np.clip((x - mean) / spread, -8, 8) * weight
    positive, unlabelled = scale(positive), scale(unlabelled)
    net = fit(positive, unlabelled, estimated_prior(positive, unlabelled))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = sigmoid(net.forward(scale(columns(as_text(batch.column(2))).astype(np.float64)))[1])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
            names=[key, "held_out", "score", "predicted"])

    return rows.select("_key", out.alias("_out"), "_text").mapInArrow(
        by_slice(score, "_text"), f"`{key}` {kind}, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/labels.parquet"))
