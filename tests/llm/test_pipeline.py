"""The pipeline against a plain version of each stage, each judged on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.common import awkward, awkward_rows
from tests.llm.test_jaccard import brute as near_groups
from tests.llm.test_quality_rules import brute as measured
from wearcast.llm.decontaminate import normalise
from wearcast.llm.store import written
from wearcast.llm.tokens import PartEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def good(text):
    n, _, _, _, repeated, covered, longest = measured(text or "", 10)
    return n >= 50 and 100 * repeated <= 50 * n and covered <= 0.4 * n and not (longest > 50 and longest > 0.15 * n)


def without_lines(rows):
    key = lambda x: re.sub(r"[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    keep = lambda i, x: i is None or gone.get(key(x), i) == i
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t in rows]


def one_of_each(rows):
    groups = near_groups(rows)
    out = {}
    for i, t in rows:
        if groups[(i, t)][2] == i:
            out[(i, t)] = (i, t)
    return list(out.values())


def leaks(text, items):
    """Plain recurrence over whole rows of the distance matrix."""
    t = np.array([ord(c) for c in normalise(text or "")])
    for p in items:
        best = np.zeros(len(t) + 1, np.int64)
        place = np.arange(len(t) + 1)
        for i, c in enumerate(p, 1):
            step = np.minimum(best[1:] + 1, best[:-1] + (t != ord(c)))
            best = np.minimum.accumulate(np.concatenate(([i], step)) - place) + place
        if best.min() <= int(0.1 * len(p)):
            return True
    return False


def stages(spark, docs, sf_dir):
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, sf_dir), f"test-{name}")
        yield docs


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = [lambda x: [r for r in x if good(r[1])], without_lines, one_of_each,
             lambda x: [r for r in x if not leaks(r[1], items)]]
    told = list(stages(spark, docs, SF))
    sizes = [len(rows)]
    for got, f in zip(told[:-1], plain):
        rows = f(rows)
        assert got.columns == docs.columns
        out = got.collect()
        assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[4] > 100
    tok = PartEncoder(tokenizer_path("byte_bpe_50k.json")).tok
    length = Counter()
    for r in told[-1].collect():
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(whole.collect()) == sorted(told[-1].select(*whole.columns).collect())


def test_awkward_rows(spark):
    for clash in (False, True):
        docs = awkward(spark, clash)
        columns = docs.columns
        told = list(stages(spark, docs, SF))
        assert all(x.columns == columns for x in told[:-1])
        assert 0 < told[-1].select("doc_id").distinct().count() <= told[0].count() <= len(awkward_rows())
    *_, last = stages(spark, docs.limit(0), SF)
    assert last.count() == 0
