"""Texts above SLICE_BYTES, each a slice of its own, in the operators that work on slices of texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import prose
from wearcast.llm import language_id, quality_classifier
from wearcast.llm.arrow import SLICE_BYTES
from wearcast.llm.html_text import extract_text
from wearcast.llm.jaccard_join import jaccard_join
from wearcast.llm.line_dedup import dedup_lines
from wearcast.llm.packing import pack_documents
from wearcast.llm.quality_rules import quality_rules
from wearcast.llm.sharding import shard_documents
from wearcast.llm.token_files import read_token_files, write_token_files
from wearcast.llm.tokens import PartEncoder, tokenizer_path

LINES = [" ".join(f"w{i}k{j}" for j in range(20)) for i in range(18_000)]
LONG = "\n".join(LINES)
SHARED = "the last line of the long text is one that others hold too"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > SLICE_BYTES
    rows = [(1, LONG), (2, prose(2, 60)), (3, LONG.replace("w9k9 ", "x ", 1)), (4, prose(4, 90))]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def test_sizes_and_pairs(docs):
    got = {r["doc_id"]: r["_size"] for r in shard_documents(docs, shards=2).collect()}
    assert got[1] == len(LONG) + 1 and len(got) == 4
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["group_id"]) for r in jaccard_join(docs).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 0, 2), 3: (3, 1, 1), 4: (4, 0, 4)}


def test_repeats(spark):
    words = LONG.split()
    rows = [(1, LONG), (2, " ".join(words + words[:80_000])), (3, " ".join(words + words[:40_000])), (4, LONG + "\n" + LINES[7])]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["n_words"] for i in range(1, 5)] == [len(words) + n for n in (0, 80_000, 40_000, 20)]
    assert [got[i]["n_repeat_words"] for i in range(1, 5)] == [0, 160_000, 80_000, 40]
    assert [got[i]["n_dup_lines"] for i in range(1, 5)] == [0, 0, 0, 1]
    assert [got[i]["kept"] for i in range(1, 5)] == [True, False, True, True]


def test_lines(spark):
    rows = [(1, f"{LONG}\n{SHARED}")] + [(i, f"{prose(i, 30)}\n{SHARED.upper()}") for i in range(2, 7)]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).select(
        "row.doc_id", "n_lines", "n_dropped", "kept").collect()}
    assert got[1]["n_lines"] == len(LINES) + 1 and got[1]["n_dropped"] == 1 and got[1]["kept"] == LONG
    assert [got[i]["n_dropped"] for i in range(2, 7)] == [1, 1, 1, 1, 0]


def test_tokens(docs, spark, tmp_path):
    name = tokenizer_path("byte_bpe_50k.json")
    tok = PartEncoder(name).tok
    ids = {r["doc_id"]: [*tok.encode(r["text"], add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces = pack_documents(docs, name, end_id=2, capacity=1024).toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 1024
    for r in pieces.itertuples():
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {i: len(x) for i, x in ids.items()}
    write_token_files(docs, f"file://{tmp_path}/t", name, end_id=2)
    for r in read_token_files(spark, f"file://{tmp_path}/t").collect():
        assert bytes(r["ids"]) == np.array(ids[r["key"]], "<u4").tobytes()


def test_models(spark, monkeypatch):
    """A text of whole windows said 50,000 times has the language and score of the text said once."""
    real = language_id.train
    monkeypatch.setattr(language_id, "train", lambda *a, **k: real(*a, **k, steps=5))
    real_fit = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda *a, **k: real_fit(*a, **k | {"steps": 5}))
    once = "ein kurzer text, der genau ein Fenster lang ist."
    assert len(once) == language_id.WINDOW
    rows = [(1, once, "de"), (2, once * 50_000, None), (3, prose(3, 60), "en"), (4, prose(4, 60), "en"), (5, prose(5, 60), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == 5 and got[1]["lang_pred"] == got[2]["lang_pred"] and abs(got[1]["score"] - got[2]["score"]) < 1e-3
    labels = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    scores = quality_classifier.quality_scores(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10)), labels)
    by_id = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert len(by_id) == 10 and all(by_id[i] == pytest.approx(by_id[i + 10]) and 0 <= by_id[i] <= 1 for i in range(1, 6))


def test_page(spark):
    paragraphs = [f"Paragraph {i} says enough to be a paragraph of the article, and no link is in it." for i in range(30_000)]
    page = "<html><body><nav><a href=/>home</a></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body></html>"
    assert len(page) > SLICE_BYTES
    got = extract_text(spark.createDataFrame([(1, "u", page), (2, "v", None)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {1: "\n".join(paragraphs), 2: ""}
