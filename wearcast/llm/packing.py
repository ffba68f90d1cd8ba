"""Best-fit packing by exact complements, planned on the histogram of piece lengths.

Pieces of equal length are interchangeable, so the whole plan needs only how many there are of each
length: at most ``capacity`` numbers, whatever the size of the corpus. The driver takes the longest length
left, looks up the gap in an index of single, pair and triple sums of available lengths, and consumes as
many such exactly filling combinations at once as the counts allow; what finds no exact complement is placed
best-fit. Each step uses up a length or a group of equal sequences, so the plan is bounded by the capacity
too. Pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearcast.llm.arrow import as_text, by_slice
from wearcast.llm.store import written
from wearcast.llm.tokens import encoder, tokenizer_path


def exact_fill(left: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """One to ``most`` (at most 3) available lengths that sum to ``gap``, longest first; ``left`` counts by length."""
    if left[gap] > 0:
        return (gap,)
    if most < 2:
        return None
    have = left > 0

    def pair(total: int, most: int) -> tuple[int, int] | None:
        a = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        fits = have[a] & have[total - a]
        if total % 2 == 0 and len(a) and a[0] * 2 == total:
            fits[0] &= left[total // 2] > 1
        hit = np.flatnonzero(fits)
        return (int(a[hit[-1]]), total - int(a[hit[-1]])) if len(hit) else None

    if (found := pair(gap, gap)) or most < 3:
        return found
    for a in np.flatnonzero(have[: gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        left[a] -= 1
        have[a] = left[a] > 0
        found = pair(gap - a, a)
        left[a] += 1
        have[a] = True
        if found:
            return (a, *found)
    return None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest sequences among those with complements of up to one, two and three pieces.

    Longer complements win on large histograms; on small ones they use up short pieces that best-fit needs.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), using every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    plan: list[tuple[tuple[int, ...], int]] = []
    rest = np.zeros_like(left)
    for n in range(capacity, 0, -1):
        while left[n] > 0:
            if n == capacity:
                combo: tuple[int, ...] = (n,)
            else:
                left[n] -= 1
                fill = exact_fill(left, capacity - n, most)
                left[n] += 1
                if fill is None:
                    rest[n], left[n] = left[n], 0
                    break
                combo = (n, *fill)
            need = {x: combo.count(x) for x in combo}
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= k * times
            plan.append((combo, times))
    # Best fit, longest first: a length goes to the open sequences with the smallest gap that takes it.
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(capacity, 0, -1):
        while rest[n] > 0:
            gap = min((g for g in open_by_gap if g >= n), default=None)
            if gap is None:
                # New sequences take as many copies each as fit.
                per = min(capacity // n, int(rest[n]))
                combo, times = (n,) * per, int(rest[n]) // per
                after = capacity - n * per
            else:
                prefix, same = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                per = min(gap // n, int(rest[n]))
                times = min(same, int(rest[n]) // per)
                combo, after = prefix + (n,) * per, gap - n * per
                if same > times:
                    open_by_gap.setdefault(gap, []).append((prefix, same - times))
            rest[n] -= per * times
            if after:
                open_by_gap.setdefault(after, []).append((combo, times))
            else:
                plan.append((combo, times))
    return plan + [x for group in open_by_gap.values() for x in group]


def places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks within a length, sorted by (length, first rank)."""
    used = [0] * (capacity + 1)
    rows, base = [], 0
    for combo, times in plan:
        offset = 0
        for n in combo:
            rows.append((n, used[n], base, offset))
            used[n] += times
            offset += n
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), cols, strict=True))


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids and end mark, cut to the capacity.

    Only longer documents are cut; the first piece takes what is over. A null text is empty: one end mark.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = encoder(tokenizer).encode(as_text(batch.column(1)))
        ends = np.cumsum(n)
        whole = np.insert(ids, ends, end_id).astype("<u4")  # the end mark of each document
        n = n + 1
        doc_first = np.cumsum(n) - n
        pieces = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head = n - (pieces - 1) * capacity  # length of the first piece
        start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
        length = np.where(piece == 0, head[doc], capacity)
        at = doc_first[doc] + start
        data = memoryview(whole.tobytes())
        crc = [zlib.crc32(data[4 * a:4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
             pa.array(length), pa.array(crc, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        by_slice(work, text, 4_000_000), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, rows_per_chunk: int = 500_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is between 1 and ``capacity``.

    Every row gets a place, equal rows too; a sequence holds at most ``capacity`` and its offsets have no gap.
    An empty table gives an empty result.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    at = places(plan_sequences(counts, capacity), capacity)
    # Ranks within a length: a length that a third of all pieces share is spread over hash chunks.
    chunks = max(16, sum(counts.values()) // rows_per_chunk)
    spread = pieces.withColumn("_chunk", F.pmod(F.xxhash64(*pieces.columns), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "_chunk").count().select(
        "length", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_chunk").orderBy(*pieces.columns)
    ranked = spread.withColumn("_rank", F.row_number().over(order) - 1).join(
        offsets, ["length", "_chunk"]).select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    shift, names = 40, pieces.columns

    def work(batches):
        keys = (at["length"] << shift) + at["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            i = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            cols = [batch.column(c) for c in names]
            cols += [pa.array(at["sequence"][i] + rank - at["rank"][i]), pa.array(at["offset"][i])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(work, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece (see ``token_pieces`` and ``pack``)."""
    return pack(written(token_pieces(docs, tokenizer, end_id, capacity, key, text), "pieces"), capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)
