import random

from tests.llm.common import awkward, awkward_rows, empty, prose
from wearcast.llm import decontaminate as module
from wearcast.llm.arrow import SLICE_BYTES
from wearcast.llm.decontaminate import LEAST_WORDS, Matcher, Search, decontaminate, find_leaks, myers, normalise


def distances(p, t):
    """Edit distance of p to the part of t that ends at each place, by the plain recurrence."""
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return prev


def edited(g, text, edits):
    x = list(text)
    for _ in range(edits):
        k, kind = g.randrange(len(x)), g.random()
        if kind < 0.33:
            x[k] = g.choice("abcd")
        elif kind < 0.66:
            del x[k]
        else:
            x.insert(k, g.choice("abcd"))
    return "".join(x)


def test_myers_equals_recurrence():
    g = random.Random(2)
    for _ in range(300):
        p = "".join(g.choice("abc") for _ in range(g.randint(1, 70)))
        t = "".join(g.choice("abc") for _ in range(g.randint(0, 90)))
        d = distances(p, t)
        best, end = myers(p, t)
        assert best == min(d) and (best == len(p) or d[end] == best)


def test_matches_equal_brute_force():
    g = random.Random(3)
    items = [(i, normalise("".join(g.choice("abcd e") for _ in range(g.randint(25, 70))))) for i in range(8)]
    matcher, hits = Matcher(items, 0.1), 0
    for _ in range(200):
        noise = lambda: "".join(g.choice("abcd e") for _ in range(20))
        t = normalise(f"{noise()} {edited(g, g.choice(items)[1], g.randint(0, 9))} {noise()}")
        want = {n: min(distances(p, t)) for n, (_, p) in enumerate(items)}
        want = {n: d for n, d in want.items() if d <= int(0.1 * len(items[n][1]))}
        got = matcher.find(t)
        assert got.keys() == want.keys()
        for n, (d, a, z) in got.items():
            assert min(distances(items[n][1], t[a:z])[-1:]) <= d <= int(0.1 * len(items[n][1]))
        hits += len(want)
    assert hits > 80


def test_tables(spark):
    item, other = prose(700, 12), prose(701, 15)
    g = random.Random(1)
    rows = awkward_rows() + [(50, f"{prose(5, 30)}\n{item.upper()}!! {prose(6, 30)}", "en", "s", 1),
                             (51, f"{prose(7, 30)} {edited(g, item, 3)} {prose(8, 30)}", "en", "s", 1),
                             (52, f"{prose(9, 30)} {edited(g, item, 40)} {prose(8, 30)}", "en", "s", 1),
                             (None, f"{item} {other}", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, item), (1, item), (2, other), (3, None), (4, ""), (5, "short")], "item_id long, text string")
    for block in (500_000, 60):  # one block and several
        got = find_leaks(docs, items, block_chars=block)
        assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got.collect()) == [(0, 1), (0, 2), (50, 1), (51, 1)]
        clean = decontaminate(docs, items, block_chars=block)
        assert clean.columns == docs.columns and clean.count() == len(rows) - 3
    assert find_leaks(awkward(spark), items).count() == 0
    assert decontaminate(awkward(spark), items).count() == len(awkward_rows())
    assert find_leaks(empty(spark), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == len(rows)


SHORT = [(1, "Who wrote Hamlet?"), (2, "x^2+y^2=z^2"), (3, "C++"), (4, "∑ ≠ ∫"), (5, "-3.5"), (6, "谁写了哈姆雷特？"), (7, "42"),
         (8, " \n"), (9, None), (10, "who wrote hamlet"), (11, "f(x) = {x_1}")]
TEXTS = {
    "Quiz:\nWHO wrote\tHamlet - an actor?": {1, 10}, "who wrote hamlets": set(), "knowho wrote hamlet": set(),
    "so x^2 + y^2 = z^2 holds": {2}, "x 2 y 2 z 2": set(), "x^2+y^2=z^25": set(), "learn c++": {3}, "learn c": set(),
    "∑≠∫": {4}, "∑ = ∫": set(), "it is -3.5 today": {5}, "it is 3.5 today": set(), "请问谁写了哈姆雷特呢": {6},
    "the answer 42.": {7}, "1422": set(), "": set(), "def f(x)={x_1};": {11},
}


def test_short_items(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string")
    items = spark.createDataFrame(SHORT + [(20, prose(700, 12))], "item_id long, text string")
    want = {(i, k) for i, found in enumerate(TEXTS.values()) for k in found}
    for block in (500_000, 20):
        rows = find_leaks(docs, items, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["distance"] == r["budget"] == 0 for r in rows)
        kept = {r["doc_id"] for r in decontaminate(docs, items, block_chars=block).collect()}
        assert kept == {i for i, found in enumerate(TEXTS.values()) if not found} | {99}
    first = next(r for r in rows if r["item_id"] == 1)
    assert normalise(next(iter(TEXTS)))[first["start"]:first["end"]] == "who wrote hamlet"


def test_short_common_items_are_reported_and_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "the end"), (2, "Who wrote Hamlet? Yes, 42."), (3, None), (4, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "Yes"), (3, "42"), (4, "Who wrote Hamlet?")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()) == [(1, 1), (2, 2), (2, 3), (2, 4)]
    clean = lambda items: sorted(r["doc_id"] for r in decontaminate(docs, items, least_words=LEAST_WORDS).collect())
    assert clean(items) == [1, 3, 4] and clean(items.where("item_id < 4")) == [1, 2, 3, 4]
    assert sorted(r["doc_id"] for r in decontaminate(docs, items).collect()) == [3, 4]
    han = spark.createDataFrame([(1, "谁写了哈姆雷特？"), (2, "中")], "item_id long, text string")
    asked = spark.createDataFrame([(1, "请问谁写了哈姆雷特呢"), (2, "中国")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate(asked, han, least_words=LEAST_WORDS).collect()] == [2]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    the = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert decontaminate(real, the, least_words=LEAST_WORDS).count() == real.count() > find_leaks(real, the).count() > 0


def test_all_blocks_in_one_pass(spark, monkeypatch):
    """A hundred blocks read the corpus once; chunks of every size, few kept automata and several passes find the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    some = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    some += [(10_000 + i, prose(800 + i, 25)) for i in range(150)] + [(20_000, "who wrote hamlet"), (20_001, "x^2+y^2=z^2")]
    items = spark.createDataFrame(some, "item_id long, text string")
    told = lambda **k: sorted(find_leaks(docs, items, **k).collect())
    kept = lambda **k: sorted(r["doc_id"] for r in decontaminate(docs, items, **k).collect())
    one_block, clean = told(), kept()
    small = sum(len(t) for _, t in some) // 120
    [blocks] = module.item_passes(items, "item_id", "text", 20, small, module.PASS_CHARS)
    assert one_block and len(clean) < docs.count() and len(blocks) >= 100
    plan = find_leaks(docs, items, block_chars=small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    plan = decontaminate(docs, items, block_chars=small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    for chunk in (16_000_000, 20_000):
        monkeypatch.setattr(module, "CHUNK_BYTES", chunk)
        assert told(block_chars=small * 8) == one_block and kept(block_chars=small * 8) == clean
    plan = find_leaks(docs, items, block_chars=small * 8, pass_chars=small * 40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 1
    assert told(block_chars=small * 8, pass_chars=small * 40) == one_block
    assert kept(block_chars=small * 8, pass_chars=small * 40) == clean


def test_few_automata_are_kept():
    blocks = [[(i, normalise(prose(i, 12)), module.EDITS)] for i in range(7)]
    search = Search(blocks, 0.1)
    texts = [prose(90, 30), f"{prose(91, 20)} {prose(3, 12)} {prose(5, 12)}", ""]
    for _ in range(3):
        found = search.find(texts)
        assert [sorted(x) for x in found] == [[], [(3, 0), (5, 0)], []] and len(search.held) == module.HELD
    assert [len(x) for x in search.find(texts, one=True)] == [0, 1, 0]


def test_very_long_text(spark):
    long = f"{prose(1, SLICE_BYTES // 6)} {prose(700, 12)}"
    assert len(long) > SLICE_BYTES
    docs = spark.createDataFrame([(1, long), (2, prose(2, 40)), (1, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(700, 12))], "item_id long, text string")
    rows = find_leaks(docs, items).collect()
    plain = normalise(long)
    assert len(rows) == 2 and all(plain[r["start"]:r["end"]] == normalise(prose(700, 12)) for r in rows)
    assert [r["doc_id"] for r in decontaminate(docs, items).collect()] == [2]
