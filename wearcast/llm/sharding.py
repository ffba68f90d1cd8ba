"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``RING`` points; a row hashes to a point and belongs to
the arc that ends at the next owned point clockwise. Rows arrive in a fixed order (arrival chunk, arc,
hash); a row whose home shard is full continues clockwise to the next shard with room, so no load exceeds
its capacity and only overflowing rows leave their home.

Order of arrival is chosen so that the whole assignment follows from one count per (chunk, arc) cell: all
rows of a cell prefer the same shards, so the cell fills them front to back. The driver sees the cell
counts only (at most ``chunks * shards * vnodes``, whatever the table's size) and turns them into rank
intervals; rows get their rank inside their cell from one evenly spread window.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 14


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, sorted; two nodes never share a point."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            p = int(md5(f"{shard}/{v}".encode()).hexdigest()[:8], 16) % RING
            while p in taken:
                p = (p + 1) % RING
            taken[p] = shard
    return sorted(taken.items())


def preferences(points: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each arc the shards clockwise from it, each once."""
    out = []
    for i in range(len(points)):
        seen: list[int] = []
        for k in range(len(points)):
            s = points[(i + k) % len(points)][1]
            if s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        out.append(seen)
    return out


def capacities(rows: int, shards: int, load: float) -> list[int]:
    """Most rows of each shard. ``load`` 1 fills every shard exactly: counts are at most one apart."""
    if load <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-rows * load // shards)] * shards


def fill(cells: list[tuple[int, int, int]], prefs: list[list[int]], room: list[int]) -> list[tuple]:
    """(chunk, arc, from_rank, to_rank, shard, home, first_slot) for cells (chunk, arc, rows) in arrival order."""
    room, used, plan = list(room), [0] * len(room), []
    for chunk, arc, rows in sorted(cells):
        rank = 0
        for shard in prefs[arc]:
            take = min(rows - rank, room[shard])
            if take:
                plan.append((chunk, arc, rank, rank + take, shard, prefs[arc][0], used[shard]))
                room[shard] -= take
                used[shard] += take
                rank += take
            if rank == rows:
                break
    return plan


def _lookup(values: list[int], at: Column) -> Column:
    """Element of a constant table; the split is folded to one literal before the query runs."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at + 1)


def shard_documents(
    docs: DataFrame, shards: int = 8, vnodes: int = 16, load: float = 1.0, chunks: int = 256,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Put every row into a shard; returns all columns of ``docs`` but ``text``, plus the columns below.

    A column of ``docs`` that has the name of one of them is left out.

    ``_size`` (bytes of the text plus 1), ``_crc32`` (of the text; 0 if null), ``_shard``, ``_slot`` (gapless
    from 0 within the shard), ``_home`` (the shard on the ring before overflow).

    Nulls: a row without key hashes by its text; a null text has size 1. Rows with the same key take the
    same arc but separate slots. An empty table gives an empty result. ``load`` 1.25 lets a shard hold a
    quarter more than its share, and then far fewer rows overflow.
    """
    points = ring_points(shards, vnodes)
    owned = [p for p, _ in points]
    arc_of = [bisect_left(owned, p) % len(points) for p in range(RING)]
    # Only the key moves a row on the ring; its text joins in the arrival order, so that rows that
    # share a key don't meet in one cell.
    h = F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key)))
    order = F.xxhash64(F.lit(1), F.col(key), F.col(text))
    rest = [c for c in docs.columns if c not in (text, "_size", "_crc32", "_shard", "_slot", "_home")]
    rows = docs.select(
        F.struct(*rest).alias("row"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_len"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("_crc32"),
        order.alias("_order"),
        F.pmod(order, F.lit(chunks)).cast("int").alias("_chunk"),
        _lookup(arc_of, F.pmod(h, F.lit(RING)).cast("int")).alias("_arc"),
    )
    cells = [tuple(r) for r in rows.groupBy("_chunk", "_arc").count().collect()]
    plan = fill(cells, preferences(points, shards), capacities(sum(c[2] for c in cells), shards, load))
    plan_df = docs.sparkSession.createDataFrame(
        plan, "_pc int, _pa int, _lo long, _hi long, _shard int, _home int, _base long")
    w = Window.partitionBy("_chunk", "_arc").orderBy("_order", "_len", "_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(w) - 1)
    # The plan has at most one row per cell and shard that fills up in it: its size is bounded by parameters.
    hit = ((F.col("_chunk") == F.col("_pc")) & (F.col("_arc") == F.col("_pa"))
           & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return ranked.join(F.broadcast(plan_df), hit).select(
        "row.*", (F.col("_len") + 1).alias("_size"), "_crc32", "_shard",
        (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("_slot"), "_home")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7; law ``rows``: shard counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs, shards=8).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("_home").alias("home_shard"))
