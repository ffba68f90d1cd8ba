import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.common import awkward, awkward_rows, empty, prose
from wearcast.llm import jaccard_join as module
from wearcast.llm.jaccard_join import COORDINATES, _groups, components, jaccard_join, leaves, one_per_group, runs_needed


def brute(rows, words=5, similarity=0.8):
    """{(id, text): (class, links, group)} by comparing every two texts."""
    least = {}
    for i, t in rows:
        least.setdefault(t, None)
        if i is not None:
            least[t] = i if least[t] is None else min(i, least[t])
    sets = {}
    for t in least:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[t] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    texts = list(least)
    near = {t: [u for u in texts if u != t and sets[t] and
                len(sets[t] & sets[u]) >= similarity * len(sets[t] | sets[u]) - 1e-9] for t in texts}
    out = {}
    for t in texts:
        seen, todo = {t}, [t]
        while todo:
            for u in near[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        group = min((least[u] for u in seen if least[u] is not None), default=None)
        out[t] = (least[t], len(near[t]), group)
    return {(i, t): out[t] for i, t in rows}


def near_copies(g, base, n, most):
    for _ in range(n):
        w = base.split()
        for _ in range(g.randint(0, most)):
            w[g.randrange(len(w))] = f"z{g.randint(0, 10**6)}"
        yield " ".join(w)


def corpus():
    g = random.Random(11)
    texts = [prose(i, g.randint(3, 120)) for i in range(60)]
    texts += list(near_copies(g, prose(900, 200), 160, 5)) + list(near_copies(g, prose(901, 90), 150, 3))
    passage = prose(902, 60)  # one passage in many different texts
    texts += [f"{prose(2000 + i, 70)} {passage} {prose(3000 + i, 70)}" for i in range(80)]
    texts += [g.choice(texts) for _ in range(40)] + ["", "one", "one", "a b", None]
    rows = list(enumerate(texts))
    g.shuffle(rows)
    return rows


def told(df):
    return Counter((r["doc_id"], r["class_id"], r["n_links"], r["group_id"]) for r in df.collect())


def test_equals_brute_force_at_every_path_size(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *x) for (i, _), x in brute(rows).items())
    assert max(x[2] for x in want) > 100
    # Small limits reach the deeper paths, the matrices and the pairs of blocks.
    for limit, block in ((200, 1000), (20, 50)):
        assert told(jaccard_join(docs, limit=limit, block=block)) == want


def test_one_per_group_and_awkward_rows(spark):
    docs = awkward(spark)
    rows = [r[:2] for r in awkward_rows()]
    want = Counter((i, *brute(rows)[(i, t)]) for i, t in rows)
    assert told(jaccard_join(docs)) == want
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    groups = {x[2] if x[2] is not None else t for (_, t), x in brute(rows).items()}
    assert kept.count() == len(groups)
    assert jaccard_join(empty(spark)).count() == 0 and one_per_group(empty(spark)).count() == 0


def test_components(spark):
    g = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (g.randint(200, 260), g.randint(200, 260)) for _ in range(45)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = {r["_k"]: r["_label"] for r in components(spark.createDataFrame(edges, "_k long, _root long")).collect()}
    assert got == {x: top(x) for x in parent}


def test_runs():
    assert runs_needed(0.999, 0.8, 4) < runs_needed(0.99999, 0.8, 4) and runs_needed(0.99, 0.95, 4) <= 4


def test_blocks_are_bounded_by_shingles(spark):
    sig = F.array(*[F.lit(c) for c in range(COORDINATES)])  # near copies: all in one bucket
    classes = spark.range(60).select(F.col("id").alias("_k"), F.lit(5_000).alias("_n"), sig.alias("_sig"))
    for most, blocks in ((4_000_000, 1), (50_000, 6), (10, 60)):
        cut = leaves(classes, 2, 4, 20, 1_000, most).select("_size", "_blocks").distinct().collect()
        assert [tuple(r) for r in cut] == [(60, blocks)]
    rows = [(i, t) for i, t in corpus() if 190 < len((t or "").split()) < 230]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *x) for (i, _), x in brute(rows).items())
    assert max(x[2] for x in want) > 100 and told(jaccard_join(docs, block_shingles=4_000)) == want


def test_groups_are_bounded_by_bytes():
    n = 40  # two rows a group, 1,000 bytes a row
    path = np.repeat(np.arange(n // 2), 2)
    t = pa.record_batch([pa.array(path), pa.array(path * 0), pa.array(path * 0), pa.array([b"x" * 1_000] * n, pa.binary())],
                        names=["_path", "_p", "_q", "_set"])
    for batches in ([t], [t.slice(i, 1) for i in range(n)]):
        sizes = [x.num_rows for x in _groups(iter(batches), most_bytes=10_000)]
        assert sum(sizes) == n and max(sizes) <= 10 and not any(x % 2 for x in sizes)
    assert [x.num_rows for x in _groups(iter([t]), most_bytes=1_000)] == [2] * 20


def test_texts_of_equal_first_hash_stay_apart(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus() if i % 3 == 0 or t is None or len(t) < 40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *x) for (i, _), x in brute(rows).items())
    groups = {x[2] for x in brute(rows).values()}
    monkeypatch.setattr(module, "text_hashes", lambda t: (
        F.pmod(F.xxhash64(t), F.lit(17)).alias("_h1"), F.xxhash64(F.lit(7), t).alias("_h2")))
    assert told(jaccard_join(docs)) == want
    assert {r["doc_id"] for r in one_per_group(docs).collect()} == groups


def test_text_keys(spark):
    rows = [(f"doc-{i:04}" if i % 7 else None, t) for i, t in corpus()[:200]]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    known = brute(rows)
    assert told(jaccard_join(docs)) == Counter((i, *known[(i, t)]) for i, t in rows)
    kept = {r["doc_id"] for r in one_per_group(docs).collect()}
    assert kept - {None} == {x[2] for x in known.values()} - {None}


def test_hot_paths_are_salted(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT", 50)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(jaccard_join(docs, limit=20, block=50)) == Counter((i, *x) for (i, _), x in brute(rows).items())
    paths = spark.range(400).selectExpr("id AS _k", "IF(id % 4 = 0, id, 7) AS _path")
    size = paths.groupBy("_path").count().withColumnRenamed("count", "_size")
    got = module._with_size(paths, size).select("_k", "_path", "_size", "_salt").collect()
    assert Counter((r["_k"], r["_path"], r["_size"]) for r in got) == Counter(
        (i, i if i % 4 == 0 else 7, 1 if i % 4 == 0 else 300) for i in range(400))
    assert len({r["_salt"] for r in got if r["_path"] == 7}) > 100
