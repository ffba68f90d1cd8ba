"""N-gram Jaccard join by chosen paths, and the groups of near duplicates that its links form.

Texts become sets of word shingles, equal texts one class, each class a fixed number of sampled tokens
(min-hashes: two sets share one with probability equal to their similarity). A run starts with all classes
and splits them on one or two sampled coordinates chosen by the path so far; buckets of up to ``limit``
classes are compared by brute force, larger ones split again. A pair of the sought similarity stays together
in a run with known probability, and the number of runs follows from the target recall.

A pair is compared in one bucket only, the smallest path that both hold, so bucket results can be added up
without listing pairs: a bucket yields per class its number of links and the root of its local component.
Buckets that stay large (thousands of near copies, or fewer long ones) are cut into blocks, and every pair of blocks is a group
of its own. The comparison first drops pairs far apart by their sampled tokens, then counts exactly on the
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.llm.arrow import as_text, by_slice
from wearcast.llm.store import written

COORDINATES = 64
#: Odd multipliers of the min-hashes, from a fixed seed.
FACTORS = np.random.default_rng(20).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Groups of up to so many rows are compared pair by pair, larger ones as matrices.
DENSE = 128
#: The rows of a path that holds more than ``HOT`` rows and one in 1,000 of all shared ones meet their count in so many salts.
SALTS, HOT = 1024, 10_000
#: A block holds about this many shingles at most, 8 bytes each; a pair of blocks twice as many.
BLOCK_SHINGLES = 4_000_000


# Identity -----------------------------------------------------------------------------------------------

def text_hashes(text: str) -> tuple[Column, Column]:
    """The two hashes _h1 and _h2 that tell texts apart, 128 bits together."""
    return F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2")


def _parted(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """``rows`` with a ``_k`` of their own for the texts that share theirs with the text of least ``_h2``."""
    other = F.col("_first").isNotNull() & (F.col("_h2") != F.col("_first"))
    return rows.join(clashes, "_k", "left").withColumn(
        "_k", F.when(other, F.xxhash64("_k", "_h2")).otherwise(F.col("_k"))).drop("_first")


# Shingles -----------------------------------------------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a shorter text is one shingle, one without words none."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        flat, row = flat.filter(pa.array(real)), row[real]
    coded = flat.dictionary_encode()
    distinct = np.array(coded.dictionary.to_pylist(), dtype=object)
    h = pd.util.hash_array(distinct, categorize=False)[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    out_row = np.repeat(np.arange(len(texts)), count)
    end = (first + n)[out_row]
    acc = np.zeros(len(start), np.uint64)
    for k in range(size):
        at = start + k
        inside = at < end
        acc = np.where(inside, acc * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at, max(len(h) - 1, 0))], acc)
    return _mix(acc), out_row


def _sample(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    texts = as_text(batch.column(batch.num_columns - 1))
    h, row = shingles(texts, size)
    d = len(texts)
    has = np.flatnonzero(np.bincount(row, minlength=d))
    sig = np.zeros((d, COORDINATES), np.int32)
    count = np.zeros(d, np.int64)
    if len(h):
        begin = np.searchsorted(row, has)
        for c in range(COORDINATES):
            least = np.minimum.reduceat((h * FACTORS[c]) >> np.uint64(32), begin)
            sig[has, c] = least.astype(np.uint32).view(np.int32)
        # Distinct shingles: the row above, 44 bits of the hash below; only the size filter reads it.
        key = np.sort(row.astype(np.int64) << 44 | (h >> np.uint64(20)).astype(np.int64))
        count = np.bincount(key[np.r_[True, key[1:] != key[:-1]]] >> 44, minlength=d)
    flat = pa.array(sig.reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * COORDINATES + 1, COORDINATES, dtype=np.int32)), flat)
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1], pa.array(count.astype(np.int32)), lists], names=["_id", "_h1", "_h2", "_n", "_sig"])


def _sets(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """(_k, _set): the sorted distinct shingle hashes as bytes."""
    texts = as_text(batch.column(1))
    h, row = shingles(texts, size)
    parts = [np.unique(x).tobytes() for x in np.split(h, np.searchsorted(row, np.arange(1, len(texts))))]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["_k", "_set"])


# Paths --------------------------------------------------------------------------------------------------

def runs_needed(recall: float, similarity: float, depth: int) -> int:
    """Runs until a pair of ``similarity`` has met with probability ``recall`` at ``depth`` splits.

    A node takes one coordinate, and every fourth node two; a pair goes on where it agrees.
    """
    apart = 0.0
    for _ in range(depth):
        leave = 1 - similarity + similarity * apart
        apart = 0.75 * leave + 0.25 * leave**2
    return ceil(log(1 - recall) / log(apart))


def _children(path: Column) -> Column:
    """The paths below ``path`` for the row's sampled tokens."""
    pick = lambda salt: F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(COORDINATES)).cast("int")
    child = lambda salt: F.xxhash64(path, pick(salt), F.get("_sig", pick(salt)))
    two = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0
    return F.explode(F.when(two & (pick(1) != pick(2)), F.array(child(1), child(2))).otherwise(F.array(child(1))))


def leaves(classes: DataFrame, runs: int, depth: int, limit: int, block: int, block_shingles: int) -> DataFrame:
    """(_k, _path, _size, _blocks): the buckets of at least two classes where the splitting ended.

    ``limit`` is what moving a row costs in comparisons. Splitting s classes of mean similarity j moves 1.25 s
    rows and leaves 1.25 j of the comparisons, so a bucket is split while s (1 - 1.25 j) exceeds the limit;
    near copies, which no split would part, are compared at once. ``_blocks``: into how many blocks a bucket is
    cut, by its classes and by the shingles of all of them.
    """
    n = F.count(F.lit(1))
    parts = F.least(n, F.ceil(F.greatest(n / F.lit(block), F.sum("_n") / F.lit(block_shingles)))).cast("int")
    order = np.random.default_rng(runs).permutation(COORDINATES).tolist()
    roots, at = [], 0
    for run in range(runs):
        for _ in range(2 if run % 4 == 3 else 1):  # each run starts on coordinates of its own while they last
            c = order[at % COORDINATES]
            roots.append(F.xxhash64(F.lit(run), F.lit(c), F.get("_sig", F.lit(c))))
            at += 1
    rows = classes.select("_k", "_n", F.explode(F.array(*roots)).alias("_path"))
    found = None
    for level in range(1, depth + 1):
        size = written(rows.groupBy("_path").agg(n.alias("_size"), parts.alias("_blocks")).where("_size > 1"), f"sizes{level}")
        here = written(_with_size(rows, size).select("_k", "_path", "_size", "_blocks"), f"paths{level}")
        large = here.where(F.col("_size") > limit)
        if level == depth or large.isEmpty():
            return here if found is None else found.unionByName(here)
        sampled = written(large.join(classes.select("_k", "_n", "_sig"), "_k"), f"large{level}")
        split = written(sampled.groupBy("_path", "_size").agg(_likeness().alias("_like")).where(
            F.col("_size") * (1 - 1.25 * F.col("_like")) > limit).select("_path"), f"split{level}")
        done = here.join(split, "_path", "left_anti")
        found = done if found is None else found.unionByName(done)
        # Written, since the next level counts the paths and then joins them with their counts.
        rows = written(sampled.join(split, "_path", "left_semi").select(
            "_k", "_n", _children(F.col("_path")).alias("_path")), f"children{level}")
    return found


def _with_size(rows: DataFrame, size: DataFrame) -> DataFrame:
    """``rows`` joined to their path's row of ``size``; the rows of hot paths are spread over salts.

    Fewer than 1,000 paths can hold more than one in 1,000 of the rows in ``size``, which bounds the broadcast table.
    """
    total = size.agg(F.sum("_size")).first()[0] or 0
    hot = F.col("_size") > max(HOT, total // 1000)
    salted = rows.join(F.broadcast(size.where(hot).select("_path", F.lit(SALTS).alias("_salts"))), "_path", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("_k"), F.coalesce("_salts", F.lit(1))).cast("int"))
    counts = size.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, F.lit(SALTS - 1)).otherwise(0))))
    return salted.join(counts, ["_path", "_salt"])


def _likeness() -> Column:
    """The mean similarity of a bucket's classes, from how often their sampled tokens' last bits agree."""
    one = [F.avg(F.get("_sig", F.lit(c)).bitwiseAND(1)) for c in range(0, COORDINATES, 2)]
    agree = sum((m * m + (1 - m) * (1 - m) for m in one[1:]), one[0] * one[0] + (1 - one[0]) * (1 - one[0])) / len(one)
    return F.greatest(2 * agree - 1, F.lit(0.0))


# Buckets ------------------------------------------------------------------------------------------------

GROUP = ["_path", "_p", "_q"]


def _groups(batches: Iterator[pa.RecordBatch], most: int = 2_000, most_bytes: int = 16 * BLOCK_SHINGLES) -> Iterator[pa.Table]:
    """Tables of whole groups (rows sorted by GROUP), each of about ``most`` rows, ``most_bytes`` of sets or one group."""
    def starts(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).to_numpy() for c in GROUP]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])

    def costs(t: pa.Table) -> np.ndarray:
        """Of the first rows together, a row's cost being the larger of its shares in both limits, times ``most``."""
        each = np.ones(t.num_rows)
        if "_set" in t.column_names:
            each = np.maximum(each, pc.binary_length(t.column("_set")).to_numpy() * (most / most_bytes))
        return np.r_[0, np.cumsum(each)]

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        cost = costs(t)
        if cost[-1] < most:
            rest = t
            continue
        s = starts(t)
        cut = int(s[-1])
        begin = 0
        for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True):
            if cost[b] - cost[begin] > most and a > begin:
                yield t.slice(begin, a - begin)
                begin = a
        if cut > begin:
            yield t.slice(begin, cut - begin)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        s, cost = np.r_[starts(rest), rest.num_rows].tolist(), costs(rest)
        begin = 0
        for a, b in zip(s[:-1], s[1:], strict=True):
            if cost[b] - cost[begin] > most and a > begin:
                yield rest.slice(begin, a - begin)
                begin = a
        yield rest.slice(begin)


def _bounds(t: pa.Table) -> list[tuple[int, int]]:
    cols = [t.column(c).to_numpy() for c in GROUP]
    s = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    return list(zip(s.tolist(), [*s[1:].tolist(), t.num_rows], strict=True))


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists share, by products over the values that several hold."""
    b = len(lists)
    owner = np.repeat(np.arange(b), [len(x) for x in lists])
    values, code, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = (count > 1)[code]
    owner, code, total = owner[shared], number[code[shared]], np.zeros((b, b), np.float32)
    width = 4096
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, z = np.searchsorted(code, [low, low + width])
        x = np.zeros((b, width), np.float32)
        x[owner[a:z], code[a:z] - low] = 1
        total += x @ x.T
    return total


def _candidates(t: pa.Table, least_similarity: float) -> pa.RecordBatch | None:
    """Per row the pairs it leads: a bitmap over its group. Only pairs whose smallest common path is this one.

    Pairs go that are more than five standard deviations of the sample below the sought similarity, and pairs
    whose sizes rule it out.
    """
    least = least_similarity - 5 * (least_similarity * (1 - least_similarity) / COORDINATES) ** 0.5
    ratio = least_similarity - 0.01
    n = t.num_rows
    sig = t.column("_sig").combine_chunks().flatten().to_numpy().reshape(n, COORDINATES)
    size = t.column("_n").to_numpy()
    blk = t.column("_b").to_numpy()
    cross = t.column("_p").to_numpy() != t.column("_q").to_numpy()
    path = (t.column("_path").to_numpy() >> 32).astype(np.int32)  # as in _own
    own_list = t.column("_own").combine_chunks()
    own_len = pc.list_value_length(own_list).to_numpy(zero_copy_only=False)
    own = np.split(own_list.flatten().to_numpy(), np.cumsum(own_len)[:-1])
    agree_at = int(least * COORDINATES)
    # Unequal tokens agree in their last bit half the time.
    words = np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.uint64).reshape(-1)
    bit = (1 + least_similarity) / 2
    apart_at = int(COORDINATES * (1 - bit + 5 * (bit * (1 - bit) / COORDINATES) ** 0.5)) + 1
    row, pos, mask = [], [], []
    for a, z in _bounds(t):
        b = z - a
        if b < 2:
            continue
        if b <= DENSE:
            i, j = np.triu_indices(b, 1)
            ok = np.minimum(size[a + i], size[a + j]) >= ratio * np.maximum(size[a + i], size[a + j])
            if cross[a]:
                ok &= blk[a + i] != blk[a + j]
            i, j = i[ok], j[ok]
            close = (sig[a + i] == sig[a + j]).sum(axis=1) >= agree_at
            i, j = i[close], j[close]
            first = [not np.any(np.isin(x := own[a + p], own[a + q]) & (x < path[a]))
                     for p, q in zip(i.tolist(), j.tolist(), strict=True)]
            pairs = np.zeros((b, b), bool)
            pairs[i[first], j[first]] = True
        else:
            # The tokens' last bits in one word: most pairs end at one comparison of words.
            word = words[a:z]
            pairs = np.bitwise_count(word[:, None] ^ word[None, :]) <= apart_at
            s = size[a:z].astype(np.float64)
            pairs &= np.minimum(s[:, None], s) >= ratio * np.maximum(s[:, None], s)
            if cross[a]:
                pairs &= blk[a:z, None] != blk[None, a:z]
            i, j = np.nonzero(np.triu(pairs, 1))
            close = np.concatenate([np.zeros(0, bool), *(
                (sig[a + i[k:k + 100_000]] == sig[a + j[k:k + 100_000]]).sum(axis=1) >= agree_at
                for k in range(0, len(i), 100_000))])
            pairs = np.zeros((b, b), bool)
            pairs[i[close], j[close]] = True
            if close.any():
                pairs &= _common([x[x < path[a]] for x in own[a:z]]) == 0
        used = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
        if len(used):
            row += (a + used).tolist()
            pos += used.tolist()
            mask += [x.tobytes() for x in np.packbits(pairs[used], axis=1)]
    if not row:
        return None
    at = pa.array(row)
    cols = [t.column(c).combine_chunks().take(at) for c in [*GROUP, "_k"]]
    return pa.RecordBatch.from_arrays([*cols, pa.array(pos, pa.int32()), pa.array(mask, pa.binary())],
                                      names=[*GROUP, "_k", "_pos", "_mask"])


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row of its component."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(t: pa.Table, similarity: float) -> pa.RecordBatch | None:
    """(_k, _links, _root) of the rows with links in this bucket, counted on the whole shingle sets."""
    keys = t.column("_k").to_numpy()
    pos = t.column("_pos").to_numpy()
    masks, sets = t.column("_mask").to_pylist(), t.column("_set").to_pylist()
    out: list[tuple[int, int, int]] = []
    for a, z in _bounds(t):
        b = z - a
        bits = np.unpackbits(np.frombuffer(b"".join(masks[a:z]), np.uint8).reshape(b, -1), axis=1)
        pairs = bits[:, pos[a:z]].astype(bool)
        lists = [np.frombuffer(x, np.uint64) for x in sets[a:z]]
        size = np.array([len(x) for x in lists])
        linked = np.zeros((b, b), bool)
        if b <= 16:
            for i, j in zip(*np.nonzero(pairs), strict=True):
                shared = len(np.intersect1d(lists[i], lists[j], assume_unique=True))
                linked[i, j] = shared >= similarity * (size[i] + size[j] - shared) - 1e-9
        else:
            shared = _common(lists)
            linked = pairs & (shared >= similarity * (size[:, None] + size - shared) - 1e-6)
        linked |= linked.T
        links = linked.sum(axis=1)
        root = _roots(linked)
        out += [(int(keys[a + i]), int(links[i]), int(keys[a + root[i]])) for i in np.flatnonzero(links).tolist()]
    if not out:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["_k", "_links", "_root"])


def _by_group(work):
    def run(batches):
        for t in _groups(batches):
            out = work(t)
            if out is not None:
                yield out

    return run


def link_counts(docs: DataFrame, classes: DataFrame, similarity: float, size: int, recall: float, depth: int,
                limit: int, block: int, block_shingles: int, text: str) -> DataFrame:
    """(_k, _links, _root): partial link counts and local component roots of linked classes."""
    runs = runs_needed(recall, similarity, depth)
    leaf = written(leaves(classes, runs, depth, limit, block, block_shingles), "leaves")
    own = leaf.groupBy("_k").agg(F.collect_list(F.shiftright("_path", 32).cast("int")).alias("_own"))
    blocks = F.col("_blocks")
    mine = F.pmod(F.xxhash64("_k"), blocks).cast("int")
    placed = (
        leaf.withColumn("_b", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("_p", F.least("_b", "_other")).withColumn("_q", F.greatest("_b", "_other"))
        .join(classes.select("_k", "_n", "_sig").join(own, "_k"), "_k")
        .select(*GROUP, "_k", "_b", "_n", "_sig", "_own")
    )
    light = written(
        placed.repartition(*GROUP).sortWithinPartitions(*GROUP, "_k").mapInArrow(
            _by_group(lambda t: _candidates(t, similarity)),
            "_path long, _p int, _q int, _k long, _pos int, _mask binary"), "candidates")
    wanted = light.select("_k").distinct().join(classes.select("_k", "_least"), "_k").withColumnRenamed("_k", "_wanted")
    texts = docs.select("_k", "_id", text).join(
        wanted, (F.col("_k") == F.col("_wanted")) & F.col("_id").eqNullSafe(F.col("_least"))).dropDuplicates(["_k"])
    sets = texts.select("_k", text).mapInArrow(
        by_slice(lambda b: _sets(b, size), text), "_k long, _set binary")
    return written(
        light.join(sets, "_k").repartition(*GROUP).sortWithinPartitions(*GROUP, "_pos").mapInArrow(
            _by_group(lambda t: _verified(t, similarity)), "_k long, _links long, _root long"), "links")


# Components ---------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(_k, _label) for every vertex of edges (_k, _root): the least vertex of its component.

    Large-star and small-star steps until nothing changes; each is one aggregate and one join on a table
    written to the shared folder, so no component is ever gathered in one place.
    """
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("a"), F.col("b")).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a") if larger else both
        out = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = written(edges.where("_k <> _root").select(
        F.greatest("_k", "_root").alias("a"), F.least("_k", "_root").alias("b")).distinct(), "edges")
    while True:
        new = written(star(star(now, True), False), "edges")
        same = (new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
                == now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now = new
        if same:
            break
    stars = now.select(F.col("a").alias("_k"), F.col("b").alias("_label"))
    return stars.unionByName(stars.select(F.col("_label").alias("_k"), "_label").distinct())


# The operator -------------------------------------------------------------------------------------------

def jaccard_join(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, recall: float = 0.99999, depth: int = 4,
    limit: int = 200, block: int = 1_000, key: str = "doc_id", text: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(key, _h1, _h2, class_id, n_links, group_id) for every row.

    ``class_id``: the least key among rows of equal text. ``n_links``: how many other texts have a Jaccard
    similarity of at least ``similarity`` on shingles of ``words`` words (white-space separated, as they
    stand; a shorter text is one shingle). ``group_id``: the least key among the texts that links connect,
    the row's own class if there is none.

    Rows of null or empty text form one class each without links. Rows without a key take part; a class with
    none has a null class id. Rows that share key and text are rows of one class. Keys may be of any type that
    has an order and keep it. Texts are told apart by 128 bits, ``_h1`` and ``_h2``, which the result holds too.
    A very long text is one row of one task. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("_id"), *text_hashes(text), F.col(text))
    kind = f"_id {rows.schema['_id'].dataType.simpleString()}, _h1 long, _h2 long, _n int, _sig array<int>"
    sampled = written(rows.mapInArrow(by_slice(lambda b: _sample(b, words), text), kind), "sampled")
    # A class goes by one 64-bit number, its first hash unless texts that differ in the second share it.
    rows, sampled = rows.withColumn("_k", F.col("_h1")), sampled.withColumn("_k", F.col("_h1"))
    while True:
        classes = written(sampled.groupBy("_k").agg(
            F.min("_id").alias("_least"), F.first("_n").alias("_n"), F.first("_sig").alias("_sig"),
            F.min("_h2").alias("_first"), F.max("_h2").alias("_last")), "classes")
        clashes = classes.where("_first <> _last").select("_k", "_first")
        if clashes.isEmpty():
            break
        rows, sampled = _parted(rows, clashes), _parted(sampled, clashes)
    found = link_counts(rows, classes.where("_n > 0"), similarity, words, recall, depth, limit, block, block_shingles, text)
    links = found.groupBy("_k").agg(F.sum("_links").alias("_links"))
    label = components(found)
    grouped = classes.select("_k", "_least").join(label, "_k", "left").join(links, "_k", "left").withColumn(
        "_label", F.coalesce("_label", "_k"))
    least = grouped.where("_links > 0").groupBy("_label").agg(F.min("_least").alias("_group"))
    decided = grouped.join(least, "_label", "left").select(
        "_k", F.col("_least").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_group", "_least").alias("group_id"))
    return sampled.select("_k", F.col("_id").alias(key), "_h1", "_h2").join(decided, "_k").drop("_k")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps its row with the least key.

    All columns are unchanged. A group whose rows all lack a key keeps one row of each text.
    """
    told = jaccard_join(docs, key=key, text=text, **parameters)
    keep = told.where(F.col(key).eqNullSafe(F.col("group_id"))).select(
        F.col(key).alias("_kept"), F.col("_h1").alias("_kept1"), F.col("_h2").alias("_kept2")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("_m"), *text_hashes(text))
    same = (F.col("_m").eqNullSafe(F.col("_kept")) & (F.col("_h1") == F.col("_kept1"))
            & (F.col("_h2") == F.col("_kept2")))
    return rows.join(keep, same, "left_semi").dropDuplicates(["_m", "_h1", "_h2"]).select("row.*")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).drop("_h1", "_h2")
