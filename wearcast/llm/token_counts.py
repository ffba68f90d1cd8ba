"""Token counts by a digest cache.

A text's count depends on its content as the tokenizer's own normaliser leaves it and on the tokenizer alone. The
cache keeps one row (content digest, count) for each such content, in a folder named by the tokenizer-version
digest, so a folder is read only for the tokenizer it belongs to. A run joins the digests of its rows to the cache,
encodes one text of each digest that isn't there, and appends those counts; nothing is read back and rewritten.
Two runs that append the same digest do no harm: equal digests have equal counts.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.llm.arrow import as_text, by_slice
from wearcast.llm.store import written
from wearcast.llm.tokens import tokenizer_path
from wearcast.session import scratch_path

CACHE = "_digest binary, n_tokens long"
#: Digests that a task remembers in order to hand on a text once; it starts anew beyond this.
REMEMBERED = 1_000_000
#: A digest that holds more than one in so many rows is joined apart: there are fewer than that many of them.
HOT_SHARE = 1000


class Counter:
    """Normalised content and token counts of one tokenizer file, as its library gives them by default."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        if path.endswith(".model"):
            import sentencepiece

            self.library = f"sentencepiece {sentencepiece.__version__}"
            self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.normal = self.model.normalize
            self.counts = lambda texts: [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        else:
            import tokenizers

            self.library = f"tokenizers {tokenizers.__version__}"
            tok = tokenizers.Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            added = [t.content for t in tok.get_added_tokens_decoder().values()]
            rule = tok.normalizer

            def normal(texts: list[str]) -> list[str]:
                if rule is None:
                    return texts
                out = [rule.normalize_str(t) for t in texts]
                # Added tokens may be cut out before the normaliser runs: where one could stand, the text stays raw.
                return [t if any(a in t or a in x for a in added) else x for t, x in zip(texts, out, strict=True)]

            self.normal = normal
            self.counts = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.version = hashlib.sha256(self.library.encode() + b"\0" + raw).hexdigest()

    def digests(self, texts: pa.Array) -> list[bytes]:
        """128-bit digests of the normalised texts (no nulls)."""
        return [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in self.normal(texts.to_pylist())]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Counter(path)


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(_digest, n_tokens), one row a digest, of a tokenizer version; none where nothing was counted yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return rows.groupBy("_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _digested(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(key, n_bytes, _digest) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_text(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pc.binary_length(texts).cast(pa.int64()),
             pa.array(counter(tokenizer).digests(texts), pa.binary())], names=["key", "n_bytes", "_digest"])

    key_type = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(by_slice(work), f"key {key_type}, n_bytes long, _digest binary")


def _one_text_each(docs: DataFrame, wanted: DataFrame, tokenizer: str) -> DataFrame:
    """(_digest, text): one text for each of the digests ``wanted``.

    A task hands on a digest's text once, so a text with a third of all rows reaches the shuffle once a task.
    While ``wanted`` is small, adaptive execution broadcasts it and texts that the cache knows don't move.
    """

    def distinct(batches):
        seen: set[bytes] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_text(batch.column(0))
            digests, take = counter(tokenizer).digests(texts), []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    take.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in take], pa.binary()), texts.take(pa.array(take, pa.int64())).cast(pa.string())],
                names=["_digest", "text"])

        yield from by_slice(work)(batches)

    texts = docs.select("text").mapInArrow(distinct, "_digest binary, text string")
    return texts.join(wanted, "_digest", "left_semi").dropDuplicates(["_digest"])


def append_missing(docs: DataFrame, wanted: DataFrame, cache: str, tokenizer: str) -> None:
    """Encode one text for each of the digests ``wanted`` and append the counts to the cache."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_text(batch.column(1)).to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counter(tokenizer).counts(texts), pa.int64())], names=["_digest", "n_tokens"])

    _one_text_each(docs, wanted, tokenizer).select("_digest", "text").mapInArrow(by_slice(work), CACHE).write.mode(
        "append").parquet(f"{cache}/version={counter(tokenizer).version}")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for every row of ``docs``; counts that ``cache`` lacks are appended to it.

    ``tokenizer`` is the path of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file on every machine;
    ``cache`` a folder that all machines share, made by the first run. Counts are the library's for whole texts,
    without added special tokens, truncation or padding.

    A null text is empty. Repeated rows give repeated results and are encoded once; a null key is passed through;
    other columns are not looked at; an empty table gives no rows and appends nothing. A text of any length is
    encoded whole, in one task.

    Texts are shuffled only where they miss the cache, once for each distinct one and task. Rows join their counts
    by digest without their texts; the fewer than ``HOT_SHARE`` digests that hold more than one in ``HOT_SHARE``
    rows each are broadcast, so no task gets a hot digest's rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = written(_digested(docs, tokenizer), "digests")
    known = cached_counts(spark, cache, counter(tokenizer).version)
    seen = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
    seen = written(seen.join(known, "_digest", "left"), "seen-digests")
    missing = seen.where(F.col("n_tokens").isNull()).select("_digest")
    if not missing.isEmpty():
        append_missing(docs, missing, cache, tokenizer)
        known = cached_counts(spark, cache, counter(tokenizer).version)
    total = seen.agg(F.sum("_rows")).first()[0] or 0
    hot = F.col("_rows") * HOT_SHARE > total
    counts = seen.select("_digest", "_rows").join(known, "_digest")
    common = F.broadcast(counts.where(hot).select("_digest", "n_tokens"))
    names = F.broadcast(seen.where(hot).select("_digest"))
    rare = rows.join(names, "_digest", "left_anti").join(counts.where(~hot).select("_digest", "n_tokens"), "_digest")
    return rows.join(common, "_digest").unionByName(rare).select(F.col("key").alias(key), "n_bytes", "n_tokens")


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents`` by ``piece_bpe_32k.model``; the run starts with an empty cache of its own.

    Nulls, empty and long texts, repeated rows and empty tables as in ``count_tokens``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, scratch_path(spark, "token-counts"), tokenizer_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
