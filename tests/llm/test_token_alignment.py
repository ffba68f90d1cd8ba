import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.common import DOCS, WORDS, awkward_rows, empty, prose
from wearcast.llm import token_alignment as TA
from wearcast.llm.arrow import SLICE_BYTES, as_text
from wearcast.llm.token_alignment import Sides, align_tokens, op12_token_alignment, pair_counts, with_pair_counts
from wearcast.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def texts():
    g = random.Random(3)
    odd = ["".join(g.choice("ab's \n\té▁漢<>/|1 .—😀") for _ in range(g.randint(0, 30))) for _ in range(400)]
    odd += [" ".join(g.choice([*WORDS, "Überraschung", "naïve", "<s>", "<0x0A>", "漢字"]) for _ in range(g.randint(1, 40)))
            for _ in range(100)]
    odd += ["x<|endoftext|>y <s> </s>", "\x00", " ", "  ", "\n", "a\x00b", "▁", "a ▁b", "漢字" * 200, "a" * 3000]
    return [r[1] for r in awkward_rows()] + odd


class Plain:
    """Groups and links of one text at a time, straight from the definition."""

    def __init__(self):
        self.tok = Tokenizer.from_file(A)
        self.tok.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        hidden = [x for x in range(256) if x not in shown]
        self.byte = {chr(x): x for x in shown}
        self.byte.update({chr(256 + i): x for i, x in enumerate(hidden)})

    def ends(self, parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    def groups(self, text):
        if not text:
            return [], [], []
        a = self.tok.encode(" " + text, add_special_tokens=False).ids
        b = self.model.encode(text)
        raw_a = [bytes(self.byte[c] for c in self.tok.id_to_token(i)) for i in a]
        raw_b = []
        for i in b:
            p = self.model.id_to_piece(i)
            raw_b.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())
        if not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
            return [], [], []
        end_a, end_b = self.ends(raw_a), self.ends(raw_b)
        cuts = sorted(set(end_a) & set(end_b))
        out = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, end_a), (b, end_b))):
            for i, end in zip(ids, ends, strict=True):
                out[bisect_left(cuts, end)][side].append(i)
        return a, b, out


def test_documents_equal_brute_force(spark, tmp_path):
    some, plain = texts(), Plain()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(some)] + [(None, "a b", "en", "s", 1)] * 2
    spark.createDataFrame(rows, DOCS).withColumn("links", F.lit("clash")).withColumn("key", F.lit(1)).repartition(
        4).write.parquet(f"{tmp_path}/documents.parquet")
    done = [(k, *plain.groups(t)) for k, t, *_ in rows]
    linked = Counter((x[-1], y[-1]) for *_, groups in done for x, y in groups)
    most = Counter()
    for (_, y), n in linked.items():
        most[y] = max(most[y], n)
    want = Counter()
    for key, a, b, groups in done:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[(key, len(a), len(b), len(groups), len(pairs), sum(linked[p] == most[p[1]] for p in pairs),
              sum(linked[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else "")] += 1
    out = op12_token_alignment(spark, str(tmp_path))
    assert out.dtypes == [*((c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                          ("groups_sha256", "string")]
    assert Counter(map(tuple, out.collect())) == want
    assert sum(not a for _, a, *_ in done) > 20 and len(linked) > 100


def test_windows_are_remembered_and_forgotten(monkeypatch):
    plain, one = Plain(), Sides(A, B)
    some = [t or "" for t in texts()]
    show = lambda t: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain.groups(t)[2])
    want = [show(t) for t in some]
    assert one.align(as_text(pa.array(some)), False)[4].to_pylist() == want
    windows = len(one.index)
    assert one.align(as_text(pa.array(some)), False)[4].to_pylist() == want and len(one.index) == windows
    monkeypatch.setattr(TA, "MEMO_TOKENS", 50)
    for i in range(0, len(some), 40):
        assert one.align(as_text(pa.array(some[i:i + 40])), False)[4].to_pylist() == want[i:i + 40]
    assert len(one.index) < windows


def test_words_give_the_library_s_pieces():
    g, one = random.Random(9), Sides(A, B)
    some = [t for t in texts() if t]
    some += ["".join(g.choice("ab  \n\té漢▁<0xA>'—🎉") for _ in range(g.randint(1, 25))) for _ in range(3000)]
    ids, n = one._pieces(as_text(pa.array(some)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == one.model.encode(some)
    even = [t for t in some if "  " not in t and t.strip(" ") == t and "▁" not in t and "\0" not in t]
    ids, n = one._pieces(as_text(pa.array(even)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == one.model.encode(even)


def test_general_results(spark):
    docs = spark.createDataFrame([("x", "one two one"), ("y", None), ("z", "two")], "id string, body string")
    aligned = align_tokens(docs, A, B, key="id", text="body")
    rows = {r["id"]: r for r in aligned.collect()}
    assert rows["x"]["groups"] == ";".join(
        f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in Plain().groups("one two one")[2])
    assert rows["y"]["n_a"] == 0 and rows["y"]["groups"] == ""
    pairs = pair_counts(aligned, A, B)
    assert sum(r["n_links"] for r in pairs.collect()) == rows["x"]["n_links"] + rows["z"]["n_links"] == 4
    assert all(r["best"] for r in pairs.collect())
    assert {r["id"]: r["count_sum"] for r in with_pair_counts(aligned, pairs, A, B).collect()} == {"x": 6, "y": 0, "z": 2}


def test_empty_table_and_very_long_text(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op12_token_alignment(spark, f"{tmp_path}/e").count() == 0
    long = prose(7, SLICE_BYTES // 6)
    assert len(long) > SLICE_BYTES
    joined = long.replace(" ", "\n")  # no anchor but the last: one window
    rows = align_tokens(spark.createDataFrame([(1, long), (2, "b"), (3, joined)], "doc_id long, text string"), A, B).collect()
    plain = Plain()
    for key, text in ((1, long), (3, joined)):
        a = plain.tok.encode(" " + text, add_special_tokens=False).ids
        row = next(r for r in rows if r["doc_id"] == key)
        assert row["n_a"] == len(a) and row["n_b"] == len(plain.model.encode(text)) and row["n_groups"] > len(a) // 2
