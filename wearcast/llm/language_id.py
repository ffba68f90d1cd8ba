"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into windows; two gated recurrent layers read each window from both ends, a linear
layer labels every position with a distribution over languages, and a document's distribution is the mean
over all its positions. Training is backpropagation through time on a bounded sample of windows; labelling
runs inside the tasks over all windows of all texts, many windows side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.arrow import SLICE_BYTES, as_text, by_slice

WINDOW = 48
HIDDEN = 8
#: Windows labelled side by side: their states stay in the processor's cache.
SIDE = 2048
#: The model is fitted on at most about so many documents, this many windows of each; a documented bound.
FIT_DOCS, FIT_WINDOWS = 3_000, 6
#: Bytes as the network sees them: ASCII capitals as small letters.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def windows(data: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (count, width), valid bytes, text number) of the consecutive windows of texts laid end to end."""
    count = -(-size // width)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(np.cumsum(size) - size, count) + k * width
    valid = np.minimum(width, size[text] - k * width)
    at = first[:, None] + np.arange(width)
    block = np.concatenate([data, np.zeros(width, np.uint8)])[at]
    block[np.arange(width) >= valid[:, None]] = 0
    return FOLD[block], valid, text


def window_parts(data: np.ndarray, size: np.ndarray, width: int, most: int = SLICE_BYTES):
    """``windows`` a part at a time: one text of over ``most`` bytes is cut between windows.

    Indexes of windows take several times the bytes they stand for; slices of several texts hold ``most`` at most."""
    step = most // width * width
    if len(size) != 1 or len(data) <= step:
        yield windows(data, size, width)
        return
    for first in range(0, len(data), step):
        part = data[first:first + step]
        yield windows(part, np.array([len(part)]), width)


def spread_windows(data: np.ndarray, width: int, each: int) -> np.ndarray:
    """The bytes of at most ``each`` evenly spread windows of one text."""
    step = -(-len(data) // (width * each)) * width
    return data if step <= width else np.concatenate([data[a:a + width] for a in range(0, len(data), step)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


class Layer:
    """One gated recurrent layer on columns: states are (hidden, batch).

    The table holds each byte's input to the three gates; update and reset gates are computed as tanh of half.
    """

    def __init__(self, hidden: int, g: np.random.Generator):
        self.table = g.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.rec = g.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[list[np.ndarray], list[tuple]]:
        """States after each row of ``x`` (steps, batch), and what training needs of each step."""
        m = self.rec.shape[1]
        h = np.zeros((m, x.shape[1]), np.float32)
        states, saved = [], []
        # Halved inputs of both gates: sigmoid(v) = (1 + tanh(v / 2)) / 2.
        half = np.ones((3 * m, 1), np.float32)
        half[: 2 * m] = 0.5
        table, rec = self.table * half, self.rec * half
        for t in range(len(x)):
            gate = rec @ h
            inputs = table[:, x[t]]
            open_ = gate[: 2 * m]
            open_ += inputs[: 2 * m]
            np.tanh(open_, out=open_)
            open_ += 1
            open_ *= 0.5
            z, r, a = open_[:m], open_[m:], gate[2 * m:]
            n = r * a
            n += inputs[2 * m:]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep:
                saved.append((h, z, r, a, n))
            h = new
            states.append(h)
        return states, saved

    def back(self, x: np.ndarray, saved: list[tuple], d_states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of (table, rec) given those of the states."""
        m = self.rec.shape[1]
        d_table, d_rec = np.zeros((256, 3 * m), np.float32), np.zeros_like(self.rec)
        d_h = np.zeros_like(saved[0][0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, a, n = saved[t]
            d = d_states[t] + d_h
            d_n = d * (1 - z) * (1 - n * n)
            d_in = np.concatenate([d * (h - n) * z * (1 - z), d_n * a * r * (1 - r), d_n])
            d_gate = np.concatenate([d_in[: 2 * m], d_n * r])
            d_h = d * z + self.rec.T @ d_gate
            d_rec += d_gate @ h.T
            order = np.argsort(x[t], kind="stable")
            which, first = np.unique(x[t][order], return_index=True)
            d_table[which] += np.add.reduceat(d_in.T[order], first)
        return d_table.T, d_rec


class Network:
    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 9):
        g = np.random.default_rng(seed)
        self.ahead, self.behind = Layer(hidden, g), Layer(hidden, g)
        self.out = g.normal(0, (2 * hidden) ** -0.5, (labels, 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((labels, 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.rec, self.behind.table, self.behind.rec, self.out, self.bias]

    def positions(self, x: np.ndarray, keep: bool = False):
        """(probabilities by step (labels, batch), states, saved) of windows ``x`` (steps, batch)."""
        fore, s_fore = self.ahead.run(x, keep)
        back, s_back = self.behind.run(x[::-1], keep)
        back.reverse()
        probs = []
        m = self.ahead.rec.shape[1]
        for f, b in zip(fore, back, strict=True):
            v = self.out[:, :m] @ f
            v += self.out[:, m:] @ b
            v += self.bias
            v -= v.max(axis=0)
            np.exp(v, out=v)
            v /= v.sum(axis=0)
            probs.append(v)
        return probs, (fore, back), (s_fore, s_back)

    def label(self, block: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """(windows, labels): sums of the position probabilities over the valid positions."""
        total = np.zeros((len(block), len(self.out)), np.float32)
        for at in range(0, len(block), SIDE):
            x = np.ascontiguousarray(block[at:at + SIDE].T)
            n = valid[at:at + SIDE]
            probs, _, _ = self.positions(x)
            whole = bool((n == len(x)).all())
            for t, p in enumerate(probs):
                total[at:at + SIDE] += (p if whole else p * (t < n)).T
        return total


def train(block: np.ndarray, valid: np.ndarray, label: np.ndarray, labels: int, steps: int = 300, batch: int = 192,
          rate: float = 0.02, seed: int = 9) -> Network:
    """Adam on the cross entropy of every valid position, backwards through both layers.

    Windows are drawn so that every label comes up equally often.
    """
    g = np.random.default_rng(seed)
    net = Network(labels, seed=seed)
    of = [np.flatnonzero(label == k) for k in range(labels)]
    of = [x for x in of if len(x)]
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    m = net.ahead.rec.shape[1]
    for step in range(1, steps + 1):
        kinds = g.integers(0, len(of), batch)
        pick = np.array([of[k][g.integers(0, len(of[k]))] for k in kinds])
        x, n, y = np.ascontiguousarray(block[pick].T), valid[pick], label[pick]
        probs, (fore, back), (s_fore, s_back) = net.positions(x, keep=True)
        scale = np.float32(1 / max(int(n.sum()), 1))
        d_out, d_bias = np.zeros_like(net.out), np.zeros_like(net.bias)
        d_fore, d_back = [], []
        for t, p in enumerate(probs):
            d = p.copy()
            d[y, np.arange(batch)] -= 1
            d *= (t < n) * scale
            d_out[:, :m] += d @ fore[t].T
            d_out[:, m:] += d @ back[t].T
            d_bias += d.sum(axis=1, keepdims=True)
            d_fore.append(net.out[:, :m].T @ d)
            d_back.append(net.out[:, m:].T @ d)
        grads = [*net.ahead.back(x, s_fore, d_fore), *net.behind.back(x[::-1], s_back, d_back[::-1]), d_out, d_bias]
        norm = float(np.sqrt(sum(float((d * d).sum()) for d in grads)))
        pace = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for w, d, a, b in zip(net.weights(), grads, first, second, strict=True):
            d = d * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            w -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _training_windows(docs: DataFrame, key: str, text: str, lang: str, fit_docs: int, each: int):
    """(languages, blocks, valid, labels) from a sample that takes as many documents of each language."""
    count = docs.groupBy(lang).agg(F.count(F.lit(1)).alias("_n"))
    kinds = count.agg(F.count(F.lit(1))).first()[0]
    if not kinds:
        return [], None, None, None
    share = count.select(F.col(lang).alias("_l"), (F.lit(fit_docs / kinds) / F.col("_n")).alias("_rate"))
    # 53 bits of the hash of key and text; rows that are equal in both are chosen together, so the limit guards the
    # bound (without such rows the number chosen stays far below it).
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(9), key, text), 11) / F.lit(2.0**53)
    # One row per language, and the model itself holds one output for each: a bounded table.
    chosen = docs.join(F.broadcast(share), docs[lang] == F.col("_l")).where(chance < F.col("_rate")).select(
        "_l", text, chance.alias("_c")).orderBy("_c").limit(2 * fit_docs).select("_l", text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, size = text_bytes(as_text(batch.column(1)))
        if len(size) == 1:  # as a text above the slice's size always is
            data = spread_windows(data, WINDOW, each)
            size = np.array([len(data)])
        block, valid, of = windows(data, size, WINDOW)
        if not len(of):
            return None
        # Evenly spread windows of each text.
        n = np.bincount(of)[of]
        k = np.arange(len(of)) - np.searchsorted(of, of)
        step = -(-n // each)
        keep = np.flatnonzero(k % step == 0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of[keep])), pa.array([x.tobytes() for x in block[keep]], pa.binary()),
             pa.array(valid[keep].astype(np.int32))], names=["_l", "_w", "_v"])

    got = chosen.mapInArrow(by_slice(work, text), "_l string, _w binary, _v int").collect()
    names = sorted({r["_l"] for r in got})
    got.sort(key=lambda r: (r["_l"], r["_w"]))  # the order of rows doesn't change the model
    block = np.frombuffer(b"".join(r["_w"] for r in got), np.uint8).reshape(-1, WINDOW)
    return names, block, np.array([r["_v"] for r in got]), np.array([names.index(r["_l"]) for r in got])


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4,
    held_out_fold: int = 2, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS,
) -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of ``docs``, from its whole text.

    Learned from texts with a non-null language whose crc32(key as text) mod ``folds`` is not
    ``held_out_fold``: about ``fit_docs`` documents, evenly by language, ``fit_windows`` windows of each.

    ``und`` with score 0: a null text, one without a letter, or no labelled text at all. A null key is never
    held out and not learned from. Rows are labelled one by one; an empty table gives an empty result.
    """
    fold = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)) == held_out_fold, F.lit(False))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~fold)
    names, block, valid, label = _training_windows(known.select(key, text, lang), key, text, lang, fit_docs, fit_windows)
    net = train(block, valid, label, len(names)) if names else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_text(batch.column(2))
        d = len(texts)
        letters = pc.match_substring_regex(texts, "\\p{L}").to_numpy(zero_copy_only=False)
        pred, score = ["und"] * d, np.zeros(d)
        if net is not None and letters.any():
            data, size = text_bytes(texts)
            total = np.zeros((d, len(names)))
            for blocks, n, of in window_parts(data, size, WINDOW):
                np.add.at(total, of, net.label(blocks, n))
            total /= np.maximum(size, 1)[:, None]
            best = total.argmax(axis=1)
            for i in np.flatnonzero(letters).tolist():
                pred[i], score[i] = names[best[i]], min(1.0, float(total[i, best[i]]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)],
            names=[key, "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, fold.alias("held_out"), text).mapInArrow(
        by_slice(work, text), f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
