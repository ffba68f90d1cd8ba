"""Periodic runs of words by the dictionary of basic factors.

The words of a slice of documents get names level by level: two positions share a name of level k if the same
2**k words of the same document start there (the name of level k + 1 is the pair of names at a position and
2**k words on). At each level a position's successor is the next one with its name. Successors whose two
factors lie within twice the factor's length, at distance d <= 2**k, form arithmetic progressions: following
positions with the same d step through one stretch whose words d apart are equal. Every such progression
proposes the period d for the stretch from its first position to the end of its last successor's factor;
it is extended to both sides while the words d apart agree, and runs proposed by several levels are kept once.

Why nothing is missed: a run with smallest period q and at least 3 q words holds, at the level with
q <= 2**k < 2 q, two whole factors q apart from its first word on, and no closer successor exists inside it
(a closer one would give it a smaller period). For the same reason a proposed d is its stretch's smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.arrow import as_text, by_slice

RUNS = "array<struct<start: long, length: long, period: long>>"


def proposals(names: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, last position, distance) of the progressions of successors of one level.

    ``names`` are the names of the positions ``at``, ``size`` the length of their factors.
    """
    order = np.lexsort((at, names))
    one, two = order[:-1], order[1:]
    gap = at[two] - at[one]
    near = (names[one] == names[two]) & (gap <= size)
    start, gap = at[one][near], gap[near]
    order = np.argsort(start)
    start, gap = start[order], gap[order]
    if not len(start):
        return start, start, gap
    fresh = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (gap[1:] != gap[:-1])])
    return start[fresh], start[np.r_[fresh[1:] - 1, len(start) - 1]], gap[fresh]


def extend(word: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
    """Move both ends of the stretches outwards, in place, while the words a period apart agree."""
    live = np.arange(len(start))
    while len(live):
        s, p = start[live], period[live]
        live = live[(s > 0) & (word[s - 1] == word[s - 1 + p])]
        start[live] -= 1
    live = np.arange(len(end))
    while len(live):
        e, p = end[live], period[live]
        live = live[(e < len(word)) & (word[np.minimum(e, len(word) - 1)] == word[e - p])]
        end[live] += 1


def find_runs(ids: np.ndarray, doc: np.ndarray, least: int = 24, power: int = 3) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs, by start and period.

    ``ids``: word ids; ``doc``: ascending document number of each word. Runs have at least ``least`` words and
    ``power`` (3 or more) periods, and never span documents. ``start`` counts over all words given.
    """
    if power < 3:
        raise ValueError("the levels cover runs of at least three periods")
    n = len(ids)
    if n < least:
        return np.zeros((0, 3), np.int64)
    word = doc * (int(ids.max()) + 1) + ids  # the same word of another document is another word
    at = np.arange(n)
    _, name = np.unique(word, return_inverse=True)
    rank = np.full(n, -1, np.int64)
    found, size = [], 1
    while len(at):
        first, last, period = proposals(name, at, size)
        end = last + period + size
        long = (end - first >= least) & (end - first >= power * period)
        found.append(np.stack([first[long], end[long], period[long]], axis=1))
        # Positions whose factor is unique have no part in longer ones.
        count = np.bincount(name)
        shared = count[name] > 1
        at, name = at[shared], name[shared]
        rank[:] = -1
        rank[at] = name
        fits = at + 2 * size <= n
        at, name = at[fits], name[fits]
        other = rank[at + size]
        at, name, other = at[other >= 0], name[other >= 0], other[other >= 0]
        if len(at):
            _, name = np.unique(name * n + other, return_inverse=True)
        size *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    extend(word, runs[:, 0], runs[:, 1], runs[:, 2])
    runs = np.unique(runs, axis=0)
    runs[:, 1] -= runs[:, 0]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24,
                  power: int = 3) -> DataFrame:
    """(key, n_words, runs, collapsed) for every row of ``docs``.

    Words are stretches without ASCII white space, numbered from 0. ``runs`` lists the maximal stretches of at
    least ``least`` words and ``power`` times their smallest period, by start and period; ``collapsed`` is the
    text without the words that repeat an earlier period of some run, its words joined by one space.

    A null or empty text has no words, no runs and ''. Rows are worked on one by one: repeated rows give repeated
    results, a null key is passed through, an empty table gives none, other columns are not looked at. A text of
    any length is read whole, in one task (about 150 bytes a word of it).
    """
    key_type = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_text(batch.column(1))
        d = len(texts)
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten()
        doc = np.repeat(np.arange(d), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not real.all():
            flat, doc = flat.filter(pa.array(real)), doc[real]
        n = np.bincount(doc, minlength=d)
        first = np.concatenate(([0], np.cumsum(n)))
        runs = find_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), doc, least, power)
        start, length, period = runs.T
        # Dropped: every run from its second period on, as the union of [start + period, start + length).
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, start + length, -1)
        keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        kept = np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=d))))
        collapsed = pc.binary_join(
            pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.take(pa.array(keep))),
            pa.scalar(" ", pa.large_string()))
        of = doc[start] if len(start) else start
        each = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=d)))).astype(np.int32)
        rows = pa.StructArray.from_arrays(
            [pa.array(start - first[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(each), rows),
             collapsed.cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        by_slice(work), f"key {key_type}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def sharpest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties by least start, then least period."""

    def better(best, run):
        lead = run["length"] * best["period"] - best["length"] * run["period"]
        return F.when(best.isNull() | (lead > 0), run).otherwise(best)  # runs come by start and period

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


WORD = r"[^\x20\x09-\x0D]+"


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as the contract of op13 asks: where crc32 of the id ends in 0, the words from number ``a`` on
    repeat with period ``p``. A null id or text stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g")).select(
        "doc_id", "text", "w", "g", F.size("w").alias("n")).select(
        "*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a")).select(
        "*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    a, p = F.col("a"), F.col("p")
    repeated = F.transform("w", lambda x, i: F.when(i < a, x).otherwise(F.get("w", a + (i - a) % p)))
    return planted.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(
        F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, some words repeated as the contract asks: their runs' digests and the sharpest run.

    Nulls, empty and long texts, repeated rows and empty tables as in ``periodic_runs``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = F.col("top")
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return periodic_runs(with_repeats(docs)).withColumn("top", sharpest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
