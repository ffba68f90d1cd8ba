import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import awkward, awkward_rows, empty
from wearcast.llm.arrow import as_text
from wearcast.llm.packing import exact_fill, pack_documents, plan_sequences
from wearcast.llm.token_files import decode_stream, encode_stream, read_token_files, write_token_files
from wearcast.llm.tokens import PartEncoder, tokenizer_path

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_parts_give_the_library_s_ids(name):
    g = random.Random(6)
    texts = ["", " ", "  ", "a  b", "a   b", "a\n b", "a\n \nb", "a\n\nb", "a \n", "x<|endoftext|>y", "it's we'll 's",
             "été ½ 12 345", "漢字 かな", "a b", "éx", "İstanbul", "\x01 a", "\x00a", "- -- —", "a.\n", "\t\tx"]
    texts += ["".join(g.choice("ab'sTÉ \n\té.1—\r,") for _ in range(g.randint(0, 25))) for _ in range(1500)]
    texts += [r[1] or "" for r in awkward_rows()]
    enc = PartEncoder(tokenizer_path(name))
    for _ in range(2):  # with an empty and a filled cache
        ids, n = enc.encode(as_text(pa.array(texts)))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
        enc._forget_rare()


def test_stream_round_trip():
    g = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (g.integers(0, 2**32, n) >> g.integers(0, 32, n)).astype(np.uint32)
        control, data = encode_stream(v)
        assert len(control) == -(-n // 4) and (decode_stream(control, data, n) == v).all()


def test_files_round_trip(spark, tmp_path):
    docs = awkward(spark)
    write_token_files(docs, f"file://{tmp_path}/t", tokenizer_path(WORDS), end_id=1)
    got = read_token_files(spark, f"file://{tmp_path}/t").collect()
    enc = PartEncoder(tokenizer_path(WORDS)).tok
    ids = lambda t: [*enc.encode(t or "", add_special_tokens=False).ids, 1]
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), r[0], r[1]) for r in awkward_rows())
    start, want = 0, []
    for _, key, text in rows:
        x = ids(text)
        want.append((key, start, len(x), np.array(x, "<u4").tobytes()))
        start += len(x)
    assert sorted(((r["key"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got), key=lambda r: r[1]) == want
    ranks = spark.read.parquet(f"file://{tmp_path}/t/vocab").orderBy("rank").collect()
    assert [r["count"] for r in ranks] == sorted((r["count"] for r in ranks), reverse=True)
    write_token_files(empty(spark), f"file://{tmp_path}/e", tokenizer_path(WORDS), end_id=1)
    assert read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_exact_fill():
    left = np.zeros(101, np.int64)
    left[[10, 20, 30]] = [1, 1, 1]
    assert exact_fill(left, 60, 3) == (30, 20, 10) and exact_fill(left, 50, 2) == (30, 20)
    assert exact_fill(left, 20, 1) == (20,) and exact_fill(left, 40, 3) == (30, 10)
    assert exact_fill(left, 61, 3) is None and exact_fill(left, 60, 2) is None and left.sum() == 3


def test_plans_use_every_piece_once():
    g = random.Random(8)
    for capacity in (16, 100):
        for n in (0, 1, 40, 2000):
            lengths = [g.randint(1, capacity) for _ in range(n)]
            plan = plan_sequences(dict(Counter(lengths)), capacity)
            used = Counter()
            for combo, times in plan:
                assert sum(combo) <= capacity and times > 0
                for x in combo:
                    used[x] += times
            assert used == Counter(lengths)
            if n == 2000:
                bound = max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))
                assert sum(t for _, t in plan) <= 1.03 * bound


def test_packed_documents(spark):
    docs = awkward(spark)
    got = pack_documents(docs, tokenizer_path(BYTES), end_id=2, capacity=64).toPandas()
    enc = PartEncoder(tokenizer_path(BYTES)).tok
    want = Counter()
    for key, text, *_ in awkward_rows():
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) - (-(-len(ids) // 64) - 1) * 64
        for k, a in enumerate([0, *range(head, len(ids), 64)]):
            part = ids[a:head if a == 0 else a + 64]
            want[(key, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[cols].itertuples(index=False))
    assert rows == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 64
    assert pack_documents(empty(spark), tokenizer_path(BYTES), 2).count() == 0
