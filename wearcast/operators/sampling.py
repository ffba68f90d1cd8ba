"""Exact stratified sampling and splitting (#25-#29).

Allocation (how many rows each stratum gives) follows the largest-remainder
rule: ``floor(n_s / total * draws)`` per stratum, and the rows still missing go
to the largest remainders, ties by stratum name. Which rows: the first ``take``
rows of the stratum in seeded hash order ``md5('<seed>-' || key), key``.

One way for every size, and no stratum is ranked whole (one may hold a third
of all rows):

1. one aggregate counts the rows of each (stratum, cell), a cell being one of
   ``CELLS`` equal parts of the hash space; every task emits one row per cell,
   and the table is written once to the shared folder;
2. running sums over the cells of a stratum say in which cell its cut lies;
   only the rows of that cell (one in ``CELLS``) are shuffled and ranked, and the
   row at the cut is the stratum's threshold;
   Its one row per stratum is written too;
3. every row is labelled by comparing its hash with the threshold of its
   stratum: an equi-join with one row per stratum, whose physical kind (and
   the splitting of skewed strata) is left to adaptive execution.

Nothing but a handful of totals passes through the driver. The result does not
depend on partitioning or input order. Rows that share a key share a hash, so
they fall on the same side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as X
from ..session import written

CELL_DIGITS = 3                  # hex digits of the hash that name its cell
CELLS = 16 ** CELL_DIGITS


@dataclass(frozen=True)
class Draw:
    """How many rows to draw from a population of ``tot`` rows."""
    kind: str     # "count" (min(n, tot)), "fraction" or "complement_of_fraction"
    value: float

    def rows(self, tot: int) -> int:
        from math import ceil, floor

        if self.kind == "count":
            return min(int(self.value), tot)
        if self.kind == "fraction":
            return int(floor(float(self.value) * tot))
        # train part of a split: tot - ceil(fraction * tot)
        return tot - int(ceil(float(self.value) * tot))


def _stratum_col(stratum: str | None) -> Column:
    return F.col(stratum) if stratum else F.lit("all")


def _cell(h: Column) -> Column:
    return F.substring(h, 1, CELL_DIGITS)  # lower-case hex of one length sorts like its number


def _allocate(counts: DataFrame, draw: Draw) -> DataFrame:
    """(stratum, n, take) from (stratum, n).

    Two single-row aggregates give the totals; the largest remainders are a
    top-k over strata (per-task top-k, then merged), not a window over all."""
    tot = int(counts.agg(F.sum("n")).first()[0] or 0)
    draws = draw.rows(tot)
    share = F.col("n").cast("double") / F.lit(float(max(tot, 1))) * F.lit(float(draws))
    d = counts.select("stratum", "n", F.floor(share).cast("long").alias("base"),
                      (share - F.floor(share)).alias("rem"))
    if draws >= tot:
        return d.select("stratum", "n", F.col("n").alias("take"))
    need = draws - int(d.agg(F.sum("base")).first()[0] or 0)
    extra = d.orderBy(F.col("rem").desc(), F.col("stratum").asc_nulls_last()).limit(need).select(
        F.col("stratum").alias("_x"), F.lit(1).alias("_one"))
    return d.join(extra, d["stratum"].eqNullSafe(extra["_x"]), "left").select(
        "stratum", "n", (F.col("base") + F.coalesce("_one", F.lit(0))).cast("long").alias("take"))


def allocation(df: DataFrame, stratum: str | None, draw: Draw) -> DataFrame:
    """(stratum, n, take) per stratum (#25)."""
    counts = written(df.groupBy(_stratum_col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n")), "strata")
    return _allocate(counts, draw)


def _kept_if(cond: Column) -> Column:
    """A filter on the row hash that is not null-intolerant. A plain
    comparison lets the optimizer infer ``isnotnull(md5(...))`` and push it
    to the scan, so every row would be hashed twice; NULL is rejected
    either way."""
    return F.coalesce(cond, F.lit(False))


def thresholds(df: DataFrame, stratum: str | None, draw: Draw, tag: str, key: str = S.KEY) -> DataFrame:
    """(_s, _ch, _ck): hash and key of the last selected row of each stratum that gives any."""
    base = df.select(_stratum_col(stratum).alias("_s"), X.hash_order(F.col(key), tag).alias("_h"),
                     F.col(key).alias("_k"))
    # At most CELLS rows a stratum, stored once: totals, remainders and cuts all read the small table.
    cells = written(base.groupBy("_s", _cell(F.col("_h")).alias("_cell")).agg(F.count(F.lit(1)).alias("_c")), "cells")
    alloc = _allocate(cells.groupBy(F.col("_s").alias("stratum")).agg(F.sum("_c").alias("n")), draw)
    upto = F.sum("_c").over(Window.partitionBy("_s").orderBy("_cell"))  # at most CELLS rows a stratum
    run = cells.withColumn("_upto", upto)
    cut = run.join(alloc, run["_s"].eqNullSafe(alloc["stratum"])).where(
        (F.col("take") > 0) & (F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_c") < F.col("take"))
    ).select(run["_s"].alias("_cs"), F.col("_cell").alias("_cc"), (F.col("take") - F.col("_upto") + F.col("_c")).alias("_need"))
    near = base.join(cut, base["_s"].eqNullSafe(cut["_cs"])).where(_kept_if(_cell(F.col("_h")) == F.col("_cc")))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_h", "_k"))
    return written(near.withColumn("_rn", rank).where(F.col("_rn") == F.col("_need")).select(
        "_s", F.col("_h").alias("_ch"), F.col("_k").alias("_ck")), "cuts")


def select_first(df: DataFrame, stratum: str | None, draw: Draw, tag: str,
                 key: str = S.KEY, out: str = "_selected") -> DataFrame:
    """Add boolean ``out``: row is among the first ``take`` of its stratum in
    hash order ``md5(tag || key), key``."""
    return _labelled(df, thresholds(df, stratum, draw, tag, key), stratum, tag, key, out)


def _labelled(df: DataFrame, cut: DataFrame, stratum: str | None, tag: str, key: str, out: str) -> DataFrame:
    j = df.withColumn("_sv", _stratum_col(stratum)).withColumn("_h", X.hash_order(F.col(key), tag))
    j = j.join(cut, j["_sv"].eqNullSafe(cut["_s"]), "left")
    upto = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (F.col(key) <= F.col("_ck")))
    return j.withColumn(out, F.coalesce(upto, F.lit(False))).drop("_sv", "_s", "_ch", "_ck", "_h")


def with_drawn(df: DataFrame, among: Column, stratum: str | None, n: int, seed: int = S.SEED, key: str = S.KEY,
               out: str = "drawn") -> DataFrame:
    """Add boolean ``out``: the row is in the stratified sample of the rows ``among``. Every row is compared with the
    threshold of its stratum, so no row meets the drawn ones by key."""
    cut = thresholds(df.where(among), stratum, Draw("count", n), f"{seed}-", key)
    return _labelled(df, cut, stratum, f"{seed}-", key, out).withColumn(out, F.col(out) & F.coalesce(among, F.lit(False)))


def stratified_sample(df: DataFrame, stratum: str | None = "stratum", n: int | Draw = S.SAMPLE_SIZE,
                      seed: int = S.SEED, key: str = S.KEY) -> DataFrame:
    """Exactly ``min(n, rows)`` rows (or what ``Draw`` says), proportional per stratum (#28)."""
    draw = n if isinstance(n, Draw) else Draw("count", n)
    return select_first(df, stratum, draw, f"{seed}-", key).where(
        _kept_if(F.col("_selected"))).drop("_selected")


def stratified_split(df: DataFrame, by: str | None = "model", test_frac: float = S.TEST_FRACTION,
                     seed: int = S.SEED, key: str = S.KEY, out: str = "split") -> DataFrame:
    """Label rows ``train``/``test``: ``ceil(test_frac * n)`` test rows, train
    allocated per ``by`` group by largest remainder (#29). NULL is a group.
    Without a ``by`` column the split is plain (one group)."""
    by = by if by and by in df.columns else None
    d = select_first(df, by, Draw("complement_of_fraction", test_frac), f"{seed}-split-", key)
    return d.withColumn(out, F.when(F.col("_selected"), F.lit("train")).otherwise(F.lit("test"))).drop(
        "_selected")


def sample_report(full: DataFrame, sample: DataFrame, split: DataFrame,
                  split_col: str = "split") -> DataFrame:
    """Full and sample sizes, sample % of the full data, train % and test % (#26, #27)."""
    full_rows = full.select(F.count(F.lit(1))).scalar()
    sample_rows = sample.select(F.count(F.lit(1))).scalar()
    p = split.agg(F.count_if(F.col(split_col) == "train").alias("train_rows"),
                  F.count_if(F.col(split_col) == "test").alias("test_rows"))
    r = p.select(full_rows.alias("full_rows"), sample_rows.alias("sample_rows"), "*")
    return r.select(
        "full_rows", "sample_rows",
        F.round(F.col("sample_rows") / F.col("full_rows") * 100, 6).alias("sample_pct"),
        "train_rows", "test_rows",
        F.round(F.col("train_rows") / (F.col("train_rows") + F.col("test_rows")) * 100, 6)
        .alias("train_pct"),
        F.round(F.col("test_rows") / (F.col("train_rows") + F.col("test_rows")) * 100, 6)
        .alias("test_pct"))
