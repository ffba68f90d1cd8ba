"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Format: a folder with two Parquet datasets. ``vocab`` lists the ids by rank (most frequent first, ties by
id). ``blocks`` holds runs of whole documents in ascending document order: their ids and lengths, a control
stream with two bits per token (its number of bytes less one, four tokens a byte, lowest bits first) and a
data stream with each token's rank in one to four little-endian bytes. ``shard`` numbers the files in
document order, ``first`` counts the ids of the shard before the block. Parquet carries the streams because
Spark commits its files atomically, to any store, whatever task was run twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearcast.llm.arrow import as_text, slices
from wearcast.llm.store import written
from wearcast.llm.tokens import encoder, tokenizer_path
from wearcast.session import scratch_path

#: A block is closed once it holds so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Bytes of each of the four tokens of a control byte.
SIZES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1


def encode_stream(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    size = 1 + (values >> 8 > 0) + (values >> 16 > 0) + (values >> 24 > 0)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    control = (code.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    end = np.cumsum(size)
    data = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for byte in range(4):
        has = size > byte
        if has.any():
            data[(end - size)[has] + byte] = values[has] >> np.uint32(8 * byte)
    return control.tobytes(), data.tobytes()


def decode_stream(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values of a block: sizes by table lookup, then one gather per byte place."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    first = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[first].astype(np.uint32)
    for byte in range(1, 4):
        has = np.flatnonzero(size > byte)
        if len(has):
            out[has] |= raw[first[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """(shard, first, key, n, ids) in ascending key order; ids as little-endian 32-bit, end mark included."""

    def work(batches):
        context = TaskContext.get()
        shard, first = (context.partitionId() if context else 0), 0
        for batch in batches:
            texts = as_text(batch.column(1))
            for at, k in slices(texts, 4_000_000):
                ids, n = encoder(tokenizer).encode(texts.slice(at, k))
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                edge = np.concatenate(([0], np.cumsum(n)))
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), k, [None, pa.py_buffer(4 * edge), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, shard, np.int32)), pa.array(first + edge[:-1]),
                     batch.column(0).slice(at, k), pa.array(n), raw.cast(pa.binary())],
                    names=["shard", "first", "key", "n", "ids"])
                first += int(edge[-1])

    return (docs.select(F.col(key).cast("long").alias("key"), text)
            .repartitionByRange("key").sortWithinPartitions("key", text)
            .mapInArrow(work, "shard int, first long, key long, n long, ids binary"))


def id_counts(rows: DataFrame, column: str = "ids") -> DataFrame:
    """(id, count): every task adds up its own ids before anything is shuffled."""

    def work(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(total))
            c[: len(total)] += total
            total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "count"])

    return (rows.select(column).mapInArrow(work, "id long, count long")
            .groupBy("id").agg(F.sum("count").alias("count")))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                      key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the files of this format to ``path``.

    A null text is empty (its end mark only); a null key sorts first; rows that share a key follow each
    other in text order. An empty table gives files without blocks.
    """
    rows = written(tokenized(docs, tokenizer, end_id, key, text), "ids", compression="zstd")
    vocab = id_counts(rows).orderBy(F.desc("count"), "id").collect()  # bounded by the vocabulary
    by_rank = np.array([r["id"] for r in vocab], np.int64)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(r["id"]), int(r["count"])) for i, r in enumerate(vocab)],
                          "rank int, id long, count long").coalesce(1).write.parquet(f"{path}/vocab")

    def blocks(batches):
        held: list[tuple] = []

        def close():
            ids = np.frombuffer(b"".join(r[4] for r in held), "<u4")
            control, data = encode_stream(rank_of[ids])
            return pa.RecordBatch.from_pylist([{
                "shard": held[0][0], "first": held[0][1], "n_ids": len(ids), "keys": [r[2] for r in held],
                "lengths": [r[3] for r in held], "control": control, "data": data}], schema=block_type)

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size + row[3] > BLOCK_IDS or row[0] != held[0][0] or row[1] != held[0][1] + size):
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield close()

    block_type = pa.schema([
        ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    rows.select("shard", "first", "key", "n", "ids").mapInArrow(
        blocks, "shard int, first long, n_ids long, keys array<long>, lengths array<long>, control binary, data binary"
    ).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids) of every document in the files; ids as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before it.
    """
    ranked = spark.read.parquet(f"{path}/vocab").orderBy("rank").select("id").collect()
    by_rank = np.array([r["id"] for r in ranked], np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per file: the only step in one task, on as many rows as there were partitions.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[decode_stream(row["control"], row["data"], row["n_ids"])].astype("<u4")
                n = np.array(row["lengths"], np.int64)
                edge = np.concatenate(([0], np.cumsum(n)))
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(4 * edge), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(row["_before"] + row["first"] + edge[:-1]),
                     pa.array(n), raw.cast(pa.binary())], names=["key", "start", "n_tokens", "ids"])

    return blocks.join(F.broadcast(shards), "shard").mapInArrow(
        work, "key long, start long, n_tokens long, ids binary")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
