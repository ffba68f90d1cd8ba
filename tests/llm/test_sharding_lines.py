import random
import zlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tests.llm.common import awkward, awkward_rows, empty
from wearcast.llm.line_dedup import OP8_SQL, common_lines, dedup_lines, keep_bitmaps, kept_runs, line_places
from wearcast.llm.sharding import capacities, fill, preferences, ring_points, shard_documents


def test_fill_equals_placing_rows_one_by_one():
    points = ring_points(5, 4)
    prefs = preferences(points, 5)
    cells = [(c, a, (c * 7 + a * 3) % 6) for c in range(6) for a in range(len(points))]
    room = capacities(sum(x[2] for x in cells), 5, 1.0)
    plan = fill(cells, prefs, room)
    left, used, want = list(room), [0] * 5, []
    for chunk, arc, rows in sorted(cells):
        for rank in range(rows):
            shard = next(s for s in prefs[arc] if left[s])
            want.append((chunk, arc, rank, shard, used[shard]))
            left[shard] -= 1
            used[shard] += 1
    got = [(c, a, r, s, base + r - lo) for c, a, lo, hi, s, _, base in plan for r in range(lo, hi)]
    assert got == want and max(used) - min(used) <= 1


def test_shards_are_even_and_slots_gapless(spark):
    got = shard_documents(awkward(spark), shards=4, chunks=3).toPandas()
    rows = awkward_rows()
    assert len(got) == len(rows)
    count = got.groupby("_shard").size()
    assert count.max() - count.min() <= 1
    for _, part in got.groupby("_shard"):
        assert sorted(part["_slot"]) == list(range(len(part)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted(zip(got["_size"], got["_crc32"])) == want
    assert shard_documents(empty(spark), 4).count() == 0


def test_loose_bounds_keep_most_rows_home_when_a_shard_is_added(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    eight = shard_documents(docs, 8, vnodes=32, load=1.25).select("doc_id", "_shard", "_home").toPandas().set_index("doc_id")
    nine = shard_documents(docs, 9, vnodes=32, load=1.25).select("doc_id", "_shard").toPandas().set_index("doc_id")
    assert (eight["_shard"] == eight["_home"]).mean() > 0.75
    assert eight.groupby("_shard").size().max() <= 625
    assert (eight["_shard"] != nine["_shard"].reindex(eight.index)).mean() < 0.4


def test_line_dedup_equals_sql(spark):
    rows = [r for r in {r[0]: r for r in awkward_rows()}.values() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dedup_lines(docs).selectExpr(
        "row.doc_id", "n_lines", "n_dropped", "sha2(coalesce(kept, ''), 256) AS kept_sha256").toPandas()
    con = duckdb.connect()
    documents = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"])  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM documents")
    want = con.execute(OP8_SQL).df()
    key = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))
    assert got["n_dropped"].sum() == 7


def test_line_dedup_awkward_rows(spark):
    got = dedup_lines(awkward(spark)).select("row.*", "kept", "n_dropped", "keep").collect()
    # The struct's own columns of those names come first.
    assert len(got) == len(awkward_rows())
    for r in got:
        whole, kept, runs = r[1], r[-3], r[-1]
        lines = (whole or "").split("\n")
        cut = "\n".join(x for run in runs for x in lines[run["start"]:run["start"] + run["length"]])
        assert kept == (cut if r[-2] else whole)
        if r[0] is None:
            assert r[-2] == 0
    assert dedup_lines(empty(spark)).count() == 0
    assert keep_bitmaps(awkward(spark), min_docs=100).count() == 0


def test_common_lines_in_slices_equal_counting_documents(spark):
    g = random.Random(8)
    lines = [f"line number {k} stands in {k} documents or so, and is long" for k in range(40)]
    texts = {i: [x for k, x in enumerate(lines) if g.random() < k / 40] * g.choice([1, 2]) for i in range(400)}
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string").repartition(4)
    places = line_places(docs, 40, "doc_id", "text")
    got = common_lines(places, 100).select("_h1", "_keep").distinct().collect()
    holders = {x: [i for i, t in texts.items() if x in t] for x in lines}
    want = sorted(max(h) for h in holders.values() if len(h) >= 100)
    assert sorted(r["_keep"] for r in got) == want and len(want) > 20
    cut = {r["doc_id"]: r["kept"] for r in dedup_lines(docs, min_docs=100).select("row.doc_id", "kept").collect()}
    for i, t in texts.items():
        assert cut[i] == "\n".join(x for x in t if len(holders[x]) < 100 or max(holders[x]) == i)


def test_a_hot_line_is_spread_and_counted_without_a_second_shuffle(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('the same long line ', 3) AS text")
    common = common_lines(line_places(docs, 40, "doc_id", "text"), 5)
    rows = common.collect()
    assert len(rows) > 1000 and {r["_keep"] for r in rows} == {2999}
    plan = common._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") >= 1 and "hashpartitioning(_h1#" in plan
    # The window and the slices' counts take the range partitioning as it is.
    assert not any("hashpartitioning" in x and "_slice" in x for x in plan.splitlines())


def test_kept_runs_equal_a_walk_over_the_lines(spark):
    g = random.Random(3)
    cases = [(n, sorted(g.sample(range(n), g.randint(1, n)))) for n in (1, 2, 3, 5, 9, 40) for _ in range(15)]
    got = spark.createDataFrame(cases, "n int, drops array<int>").select(
        "n", "drops", kept_runs(F.col("drops")).alias("runs")).collect()
    for n, drops, runs in got:
        kept = [p for r in runs for p in range(r["start"], n if r["stop"] is None else r["stop"])]
        assert kept == [p for p in range(n) if p not in drops]
        assert all(a["stop"] < b["start"] for a, b in zip(runs, runs[1:]))
