import random
import re

import pyarrow as pa

from tests.llm.common import awkward, awkward_rows, empty
from wearcast.llm.arrow import as_text
from wearcast.llm.quality_rules import keep_good, measure, quality_rules


def brute(text, least):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    cover = lambda at, size: len({x for i in at for x in range(i, i + size(i))})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            cover([i for i in range(n) if longest[i] >= 3], lambda i: 3),
            cover([i for i in range(n) if longest[i] >= least], lambda i: longest[i]), max(longest, default=0))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def test_counts_equal_brute_force():
    g = random.Random(4)
    texts = ["", " ", "a", "a a a a a a", "é|# é|# é|# x", "x\n\nx\n x\nx\v\n", "a b c a b c\x1ca b"]
    texts += ["".join(g.choice("ab c\n\t#") for _ in range(g.randint(0, 90))) for _ in range(150)]
    got = measure(as_text(pa.array(texts)), 4)
    assert list(zip(*(got[n].tolist() for n in NAMES))) == [brute(t, 4) for t in texts]


def test_verdicts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, " ".join(f"v{i}" for i in range(100))), (2, f"{passage} q {passage}"), (3, "The " * 80), (4, "short"),
            (5, None), (None, " ".join(f"u{i}" for i in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules(docs).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (True, False), None: (False, True)}
    assert {r["doc_id"] for r in keep_good(docs).collect()} == {1, None}


def test_awkward_rows(spark):
    docs = awkward(spark)
    told = quality_rules(docs)
    assert told.count() == len(awkward_rows())
    kept = keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == told.where("kept").count()
    assert quality_rules(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0


def test_longest_repeat_rejects_alone(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    twice = lambda n, most: f"{words('p', most)} {words('v', n - 2 * most)} {words('p', most)}"
    docs = spark.createDataFrame([(1, twice(400, 70)), (2, twice(20_000, 3_900)), (3, twice(400, 60)), (4, twice(300, 50))],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert all(not r["base_failed"] and r["covered_words"] <= 0.4 * r["n_words"] for r in got.values())
    assert {r["doc_id"] for r in keep_good(docs).collect()} == {3, 4}
