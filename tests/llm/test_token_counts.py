import random
from collections import Counter as Bag

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.common import DOCS, awkward, awkward_rows, empty, prose
from wearcast.llm import token_counts as TC
from wearcast.llm.arrow import SLICE_BYTES
from wearcast.llm.token_counts import cached_counts, count_tokens, counter, op11_token_counts
from wearcast.llm.tokens import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
MARKS = "a<s>b</s> <unk> <|endoftext|> <|ENDOFTEXT|> [INST] ▁x \x00 ﻿ ​"


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t or ""))
    tok = Tokenizer.from_file(path)
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


def texts():
    g = random.Random(2)
    odd = ["".join(g.choice("ab \n\té▁漢<>s/| ") for _ in range(g.randint(0, 30))) for _ in range(300)]
    return [r[1] for r in awkward_rows()] + odd + [MARKS, MARKS.upper(), "Ab  c", "ab c", "x" * 3000]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_library_s(spark, tmp_path, name):
    path = tokenizer_path(name)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())] + [(None, "a b", "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("_rows", F.lit(1)).repartition(3)
    n = library(path)
    want = Bag((k, len((t or "").encode()), n(t)) for k, t, *_ in rows)
    for _ in range(2):  # with an empty and a filled cache
        assert Bag(map(tuple, count_tokens(docs, f"{tmp_path}/cache", path).collect())) == want


def test_equal_digests_have_equal_counts():
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"):
        c, n = counter(tokenizer_path(name)), library(tokenizer_path(name))
        some = [t or "" for t in texts()] + ["A b", "a  b", "<|ENDOFTEXT|>", "<|endoftext|>", "a▁b", "a b"]
        by = {}
        for t, d in zip(some, c.digests(pa.array(some)), strict=True):
            assert by.setdefault(d, n(t)) == n(t)


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    cache = f"{tmp_path}/cache"
    version = counter(PIECES).version
    first = spark.createDataFrame([(i, prose(i % 5, 20)) for i in range(4000)], "doc_id long, text string").repartition(7)
    count_tokens(first, cache, PIECES).collect()
    files = lambda: spark.read.parquet(f"{cache}/version={version}")
    assert files().count() == 5 == cached_counts(spark, cache, version).count()
    more = spark.createDataFrame([(i, prose(i % 8, 20)) for i in range(800)] + [(9, "a▁b"), (10, "a b")],
                                 "doc_id long, text string").repartition(3)
    count_tokens(more, cache, PIECES).collect()
    assert files().count() == 5 + 3 + 1  # one content after normalising
    monkeypatch.setattr(TC, "append_missing", None)  # nothing is missing any more
    assert count_tokens(first.unionByName(more), cache, PIECES).count() == 4802
    # A row appended twice, as by two runs at a time, counts once.
    files().limit(4).write.mode("append").parquet(f"{cache}/version={version}")
    assert files().count() == 13 and count_tokens(more, cache, PIECES).count() == 802
    assert cached_counts(spark, cache, "another").count() == 0


def test_very_long_text(spark, tmp_path):
    long = prose(5, SLICE_BYTES // 6)
    assert len(long) > SLICE_BYTES
    docs = spark.createDataFrame([(1, long), (2, "b")], "doc_id long, text string")
    got = dict((r[0], r[2]) for r in count_tokens(docs, f"{tmp_path}/c", PIECES).collect())
    assert got == {1: library(PIECES)(long), 2: 1}


def test_query(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    n = library(PIECES)
    out = op11_token_counts(spark, f"{tmp_path}/a")
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert Bag(map(tuple, out.collect())) == Bag(
        (k, len((t or "").encode()), n(t), n(t) > 4096) for k, t, *_ in awkward_rows())
    empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op11_token_counts(spark, f"{tmp_path}/e").count() == 0
