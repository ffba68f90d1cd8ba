import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.common import awkward, awkward_rows, empty
from wearcast.llm import language_id, quality_classifier
from wearcast.llm.arrow import as_text
from wearcast.llm.language_id import Network, identify, windows
from wearcast.llm.quality_classifier import quality_scores

SF = "/root/testdata/sf0.01"


def test_windows_cover_every_byte():
    data = np.arange(250, dtype=np.uint8)
    size = np.array([0, 5, 48, 97, 100])
    block, valid, text = windows(data, size, 48)
    assert np.bincount(text, valid, 5).tolist() == size.tolist()
    got = np.concatenate([b[:n] for b, n in zip(block, valid)])
    assert (got == language_id.FOLD[data]).all()


def test_a_long_text_has_the_same_windows_in_parts():
    data = np.random.default_rng(2).integers(0, 256, 4999).astype(np.uint8)
    for n in (0, 1, 48, 960, 961, 4999):
        whole = windows(data[:n], np.array([n]), 48)
        parts = list(language_id.window_parts(data[:n], np.array([n]), 48, most=1000))
        assert all(len(p[0]) <= 20 for p in parts)
        for a, b in zip(whole, zip(*parts), strict=True):
            assert (a == np.concatenate(b)).all()
        for each in (1, 6, 30):
            k = np.arange(len(whole[0]))
            keep = k[k % -(-max(len(k), 1) // each) == 0]
            held = language_id.spread_windows(data[:n], 48, each)
            block, valid, _ = windows(held, np.array([len(held)]), 48)
            assert (block == whole[0][keep]).all() and (valid == whole[1][keep]).all() and len(keep) <= each


def test_gradients_equal_differences():
    g = np.random.default_rng(0)
    net = Network(3, 4, seed=1)
    x, y = g.integers(0, 256, (6, 5)), g.integers(0, 3, 5)

    def loss():
        probs, _, _ = net.positions(x)
        return -sum(np.log(p[y, np.arange(5)]).sum() for p in probs)

    probs, (fore, back), (s_fore, s_back) = net.positions(x, keep=True)
    d = [p.copy() for p in probs]
    for p in d:
        p[y, np.arange(5)] -= 1
    a = net.ahead.back(x, s_fore, [net.out[:, :4].T @ p for p in d])
    b = net.behind.back(x[::-1], s_back, [net.out[:, 4:].T @ p for p in d][::-1])
    for weight, grad in ((net.ahead.table, a[0]), (net.ahead.rec, a[1]), (net.behind.table, b[0]), (net.behind.rec, b[1])):
        for at in zip(*[v[:6] for v in np.nonzero(np.abs(grad) > 0.05)]):
            old, e = weight[at], np.float32(1e-2)
            weight[at] = old + e
            up = loss()
            weight[at] = old - e
            down = loss()
            weight[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 0.03 * abs(grad[at]) + 0.02


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs, fit_docs=600).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_awkward_rows(spark, monkeypatch):
    real = language_id.train
    monkeypatch.setattr(language_id, "train", lambda *a, **k: real(*a, **k, steps=5))
    got = identify(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" for i in (10, 11, 12)) and by_id[13]["lang_pred"] != "und"
    assert identify(empty(spark)).count() == 0
    nothing = awkward(spark).withColumn("lang", language_id.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(nothing).collect()} == {"und"}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got["held_out"]]
    rank, one = held["score"].rank(), held["quality"] == 1
    auc = (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    assert auc > 0.95 and (held["predicted"] == held["quality"]).mean() > 0.93
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality_classifier.F.when(
        quality_classifier.F.expr("crc32(cast(doc_id AS string)) % 5 = 0"), 1 - labels["quality"]).otherwise(labels["quality"]))
    a = quality_scores(docs, labels).toPandas().sort_values("doc_id")
    b = quality_scores(docs.withColumn("lang", docs["source"]), turned).toPandas().sort_values("doc_id")
    assert np.allclose(a["score"], b["score"])


@pytest.mark.parametrize("rows", [[], [(14, 1), (14, 0), (None, 1), (1, 1), (2, None), (13, 0)]])
def test_quality_awkward_rows(spark, monkeypatch, rows):
    real = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda *a, **k: real(*a, **k, steps=5))
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = quality_scores(awkward(spark), labels).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_scores(empty(spark), labels).count() == 0


def test_quality_sample_is_bounded_for_any_key_and_size(spark):
    rows = spark.range(6000, numPartitions=6).select(
        F.lit(7).cast("long").alias("_key"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("_text"))
    nulls = rows.withColumn("_key", F.lit(None).cast("long"))
    same = rows.withColumn("_text", F.lit("one text"))
    for some in (rows, nulls, same):
        for total in (6000, 2 * 10**10):  # the second as if the table were that large
            got = quality_classifier._sample(some, total, 500)
            assert 0 < len(got) <= 500 and got.shape[1] == quality_classifier.COLUMNS
    spread = quality_classifier._sample(rows, 6000, 500)
    assert len(spread) == 500 and len(np.unique(spread, axis=0)) > 300


def test_quality_labels_of_repeated_keys_are_bounded(spark, monkeypatch):
    """A labelled key that all rows share gives no more trusted rows than the bound, each of them such a row."""
    seen = []
    real = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda p, u, *a, **k: seen.append((p, u)) or real(p, u, *a, **k | {"steps": 2}))
    docs = spark.range(3000, numPartitions=5).select(
        F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") + 10).cast("long").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("good "), F.col("id").cast("string"))).otherwise(F.lit("!!! *** !!!")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    assert quality_scores(docs, labels, fit_rows=200).count() == 3000
    p, u = seen[-1]
    assert 0 < len(p) <= 200 and 0 < len(u) <= 200
    assert len(np.unique(p[:, 0])) == 1 < len(np.unique(u[:, 0]))  # log_words: all trusted rows have two words


GRAM_TEXTS = ["One two one  two\nthree", "", " \n", "été 漢字 ab", "a", "ab", "x" * 500, "one two one two three"]


def test_grams_equal_a_plain_count():
    """Shares by walking over words, pairs of neighbours and byte triples one at a time; slices give the same rows."""
    texts = as_text(pa.array([*GRAM_TEXTS, None]))
    got = quality_classifier.grams(texts)
    mask, mix = 2**64 - 1, int(quality_classifier.MIX)
    top = lambda h, n: (h & mask) >> (65 - n.bit_length())
    code = lambda w: int(quality_classifier.pd.util.hash_array(np.array([w], dtype=object), categorize=False)[0])
    for row, t in zip(got, [*GRAM_TEXTS, ""], strict=True):
        words, raw = [code(w) for w in t.lower().split()], t.encode()
        by_word, by_byte = np.zeros(quality_classifier.WORD_BUCKETS), np.zeros(quality_classifier.BYTE_BUCKETS)
        for i, w in enumerate(words):
            by_word[top(w * mix, len(by_word))] += 1
            if i:
                by_word[top(((words[i - 1] * mix & mask) ^ (w + mix & mask)) * mix, len(by_word))] += 1
        for i in range(len(raw) - 2):
            by_byte[top((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * mix, len(by_byte))] += 1
        want = np.sqrt(np.r_[by_word / max(by_word.sum(), 1), by_byte / max(by_byte.sum(), 1)])
        assert np.allclose(row, want)
    for i in range(len(texts)):
        assert np.allclose(quality_classifier.columns(texts)[i], quality_classifier.columns(texts.slice(i, 1))[0])


def test_prior_from_positives_and_unlabelled():
    g = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85):
        one, zero = g.normal(1.5, 1, (12_000, 3)), g.normal(-1.5, 1, (6_000, 3))
        k = int(6000 * share)
        found = quality_classifier.estimated_prior(one[:6000], np.concatenate([one[6000:6000 + k], zero[: 6000 - k]]))
        assert share - 0.12 < found < share + 0.02


def test_quality_risk_and_gradient():
    """The step's gradient is that of the risk, by differences; the risk as its definition reads."""
    g = np.random.default_rng(1)
    net = quality_classifier.Network(4, 5, 1)
    p, u, prior = g.normal(1, 1, (40, 4)), g.normal(0, 1, (40, 4)), 0.4

    def loss(x, y):
        z = net.forward(x)[1]
        return np.mean([np.log(1 + np.exp(-v if y else v)) for v in z])

    (hp, zp), (hu, zu) = net.forward(p), net.forward(u)
    s = quality_classifier.sigmoid
    grad = [prior * a / 40 + b / 40 - prior * c / 40 for a, b, c in zip(
        net.gradient(p, hp, s(zp) - 1), net.gradient(u, hu, s(zu)), net.gradient(p, hp, s(zp)), strict=True)]
    for w, d in zip(net.w, grad, strict=True):
        for at in np.ndindex(w.shape):
            keep, sides = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = keep + step
                sides.append(prior * loss(p, 1) + loss(u, 0) - prior * loss(p, 0))
            w[at] = keep
            assert abs((sides[0] - sides[1]) / 2e-5 - d[at]) < 1e-6


def test_language_sample_is_bounded(spark):
    docs = spark.range(3000, numPartitions=4).selectExpr("1L AS doc_id", "concat('wort und text ', id % 50) AS text", "'de' AS lang")
    names, block, valid, label = language_id._training_windows(docs, "doc_id", "text", "lang", 100, 2)
    assert names == ["de"] and len(block) <= 400
    one = docs.withColumn("text", F.lit("ein text"))
    names, block, valid, label = language_id._training_windows(one, "doc_id", "text", "lang", 100, 2)
    assert block is None or len(block) <= 400


def test_pooled_labels_equal_a_plain_loop(spark):
    """Probabilities of a text are the mean over its positions, window by window."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    held = {}
    real = language_id.train

    def keep(*a, **k):
        held["net"] = real(*a, **k, steps=8)
        return held["net"]

    language_id.train, old = keep, language_id.train
    try:
        got = {r["doc_id"]: r for r in identify(docs, fit_docs=80).collect()}
    finally:
        language_id.train = old
    net = held["net"]
    names = sorted({r["lang"] for r in docs.collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2})
    for r in docs.limit(15).collect():
        raw = (r["text"] or "").encode()
        if got[r["doc_id"]]["lang_pred"] == "und":
            continue
        data, size = language_id.text_bytes(as_text(pa.array([r["text"]])))
        block, n, of = language_id.windows(data, size, language_id.WINDOW)
        total = np.zeros(len(names))
        for i in range(len(block)):
            total += net.label(block[i:i + 1], n[i:i + 1])[0]
        total /= max(len(raw), 1)
        assert got[r["doc_id"]]["lang_pred"] == names[int(np.argmax(total))]
        assert abs(got[r["doc_id"]]["score"] - min(1.0, total.max())) < 1e-4
