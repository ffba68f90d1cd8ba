import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import DOCS, awkward, awkward_rows, empty
from wearcast.llm.arrow import SLICE_BYTES
from wearcast.llm.periodic_runs import find_runs, op13_periodic_runs, periodic_runs, with_repeats


def plain_runs(words, least=24, power=3):
    """All maximal runs by trying every period at every place."""
    n, out = len(words), set()
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, power * q) and not any(
                    all(words[x] == words[x + s] for x in range(i, i + length - s)) for s in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(key, text):
    words = plain_words(text)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least", [3, 6, 24])
def test_runs_equal_brute_force(least):
    g = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(g.randint(1, 4)):
            words = [g.randint(0, g.choice((1, 2, 5))) for _ in range(g.randint(0, 60))]
            if words and g.random() < 0.6:  # a planted period, once or twice, sometimes damaged
                for _ in range(g.randint(1, 2)):
                    block = [g.randint(0, 9) for _ in range(g.randint(1, 12))]
                    words += block * g.randint(2, 6) + block[: g.randint(0, len(block))]
            docs.append(words)
        ids = np.array([w for d in docs for w in d], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        want, first = [], 0
        for d in docs:
            want += [(first + s, n, q) for s, n, q in plain_runs(d, least)]
            first += len(d)
        assert [tuple(r) for r in find_runs(ids, doc, least).tolist()] == want


def test_runs_of_extreme_texts():
    same = np.zeros(5000, np.int64)
    assert find_runs(same, same).tolist() == [[0, 5000, 1]]
    fib = [0, 1]
    while len(fib) < 400:
        fib = fib + fib[: len(fib) * 5 // 8 + 1] if len(fib) > 8 else fib + fib
    fib = np.array(fib[:400])
    assert [tuple(r) for r in find_runs(fib, np.zeros(400, np.int64), 6).tolist()] == plain_runs(fib.tolist(), 6)
    distinct = np.arange(3000)
    assert find_runs(np.r_[distinct, distinct], np.zeros(6000, np.int64)).tolist() == []
    assert find_runs(np.r_[distinct, distinct, distinct], np.zeros(9000, np.int64)).tolist() == [[0, 9000, 3000]]
    with pytest.raises(ValueError):
        find_runs(same, same, 24, 2)


def rows_with_runs():
    g = random.Random(13)
    rows = awkward_rows()
    for i in range(20, 60):
        block = [g.choice("ab cd ef g hé".split(" ")) for _ in range(g.randint(1, 9))]
        body = [str(g.random()) for _ in range(g.randint(0, 30))] + block * g.randint(1, 12)
        rows.append((i, "\t\n"[i % 2].join(body + ["end"] * (i % 3)), "en", "s", 1))
    rows.append((60, "\n".join("never again and again" for _ in range(SLICE_BYTES // 20)), "en", "s", 1))
    return rows


def test_rows_of_documents(spark):
    rows = rows_with_runs()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("key", F.lit("clash")).withColumn("runs", F.lit(1))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["collapsed"],
                  [tuple(x) for x in r["runs"]]) for r in periodic_runs(docs).collect())
    want = []
    for key, text, *_ in rows:
        words = plain_words(text)
        runs = plain_runs(words) if len(words) < 10_000 else [(0, len(words), 4)]
        if key == 17:
            runs = []
        want.append((key is not None, key or 0, len(words), collapsed(words, runs), runs))
    assert got == sorted(want)
    assert periodic_runs(awkward(spark)).count() == len(awkward_rows())
    assert periodic_runs(empty(spark)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    g = random.Random(4)
    rows = [r for r in rows_with_runs() if r[0] not in (17, 60)]
    rows += [(1000 + i, " ".join(g.choice("abcdefgh") for _ in range(g.randint(0, 120))), "en", "s", 1) for i in range(200)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for key, text, *_ in rows:
        words = planted(key, text)
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((key, len(runs), *(top or (None,) * 3), None if top is None else 1000 * top[1] // top[2],
                     hexed("".join(f"{s},{n},{q}\n" for s, n, q in runs)), hexed(collapsed(words, runs))))
    out = op13_periodic_runs(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in out.schema][:6] == ["bigint"] * 6
    got = [tuple(r)[:8] for r in out.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[1] > 0 for r in want) > 20
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0
    assert with_repeats(empty(spark)).count() == 0
