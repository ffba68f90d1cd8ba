"""Small awkward tables for the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) + str(g.randint(0, 99)) for _ in range(n))


def awkward_rows():
    """Null and empty texts, repeated rows, ties, null ids, a very long text."""
    shared = "this shared line is long enough to count as a line of its own"
    rows = [(i, f"{prose(i, 60)}\n  {shared} \nend {i}", "en", "s", 1) for i in range(7)]
    rows += [(10, None, None, None, None), (11, "", "en", "s", 0), (12, " \n\t", "de", None, 3), (13, "x", "en", "s", 1)]
    rows += [(14, prose(14, 80), "en", "s", 5)] * 2  # a repeated row
    rows += [(15, prose(14, 80), "en", "s", 5), (None, prose(14, 80), "en", "s", 5), (None, prose(16, 70), None, "s", 5)]
    rows += [(17, "\n".join(prose(100 + k, 40) for k in range(500)), "fr", "s", 9), (18, "été — ½ 漢字 😀", "fr", "s", 9)]
    rows += [(19, f"{prose(19, 60)}\n{shared.upper()}\n{shared}\n", "en", "s", 1)]
    return rows


def awkward(spark, clash=True):
    df = spark.createDataFrame(awkward_rows(), DOCS).repartition(3)
    if clash:
        for c in ("_k", "_h", "_m", "_d", "_t", "_n", "row", "kept", "n_lines", "_size", "_shard", "_order", "score", "piece"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
