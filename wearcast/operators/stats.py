"""Exact quantiles of many columns with bounded memory per task.

``percentile``/``median`` keep every distinct value of a column in one buffer
and merge the buffers in one task: fine for low-cardinality columns, not for
a continuous sensor column over billions of rows. Here every wanted order
statistic has a bracket of two values of its column that shrinks:

1. the mergeable sketch ``approx_percentile`` gives values a little below and
   above the rank; its rank error is bounded, so the order statistic lies between;
2. one pass of plain conditional counts (no shuffle but of one row a task) says
   how many values lie below, on and between the bracket's ends: a rank on an
   end is settled, however many rows share the value;
3. while more than ``FINAL`` values lie strictly between, the sketch is taken of
   those alone, which shrinks the bracket by a factor of ``ACCURACY`` / 4;
4. the few values left are counted and brought to the driver.

A table of 1e11 rows takes two rounds of 2 and 3. No arithmetic on the values,
so huge ranges and infinities are safe. Equal to the linearly interpolated
quantile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Values strictly inside a bracket that may be brought to the driver.
FINAL = 4_096


def _between(a: float, b: float, frac: float) -> float:
    """Linear interpolation that stays finite between finite neighbours."""
    if a == b or frac == 0:
        return a
    if math.isinf(a) or math.isinf(b):
        # Between a number and an infinity lies the infinity; between both nothing.
        return math.nan if a == -b else (a if math.isinf(a) else b)
    if not math.isfinite(b - a):
        return a * (1 - frac) + b * frac
    return (a + b) / 2.0 if frac == 0.5 and math.isfinite(a + b) else a + (b - a) * frac


@dataclass
class _Bracket:
    """One order statistic: the value at ``rank`` (from 0) of ``column`` lies in [low, high]."""
    column: str
    rank: int
    low: float
    high: float
    value: float | None = None
    below: int = 0       # rows under low
    on_low: int = 0
    between: int = 0     # rows strictly inside
    on_high: int = 0

    def inside(self) -> Column:
        return (F.col(self.column) > F.lit(self.low)) & (F.col(self.column) < F.lit(self.high))

    def settle(self) -> bool:
        """Take the value if the rank lies on an end; False if the bracket misses it."""
        if not self.below <= self.rank < self.below + self.on_low + self.between + self.on_high:
            return False
        if self.rank < self.below + self.on_low:
            self.value = self.low
        elif self.rank >= self.below + self.on_low + self.between:
            self.value = self.high
        return True


def _count(x: DataFrame, brackets: list[_Bracket]) -> None:
    aggs = []
    for b, k in enumerate(brackets):
        c, low, high = F.col(k.column), F.lit(k.low), F.lit(k.high)
        on_high = (c == high) & (high > low)
        aggs += [F.count_if(c < low).alias(f"u{b}"), F.count_if(c == low).alias(f"l{b}"),
                 F.count_if(k.inside()).alias(f"m{b}"), F.count_if(on_high).alias(f"h{b}")]
    row = x.agg(*aggs).first()
    for b, k in enumerate(brackets):
        k.below, k.on_low, k.between, k.on_high = (row[f"{p}{b}"] for p in "ulmh")


def _refine(x: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    """New ends from the sketch of the values strictly inside each bracket."""
    aggs = []
    for b, k in enumerate(brackets):
        p, margin = (k.rank - k.below - k.on_low) / k.between, 2.0 / accuracy
        ends = F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin)))
        aggs.append(F.percentile_approx(F.when(k.inside(), F.col(k.column)), ends, F.lit(accuracy)).alias(f"e{b}"))
    row = x.agg(*aggs).first()
    for b, k in enumerate(brackets):
        k.low, k.high = row[f"e{b}"]


def _read_off(x: DataFrame, brackets: list[_Bracket]) -> None:
    """The values inside of all brackets (at most ``FINAL`` rows each) and the one at each rank."""
    hits = F.array_compact(F.array(*[F.when(k.inside(), F.struct(F.lit(b).alias("b"), F.col(k.column).alias("v")))
                                     for b, k in enumerate(brackets)]))
    found: dict[int, list] = {}
    for r in x.select(F.inline(hits)).groupBy("b", "v").agg(F.count(F.lit(1)).alias("c")).collect():
        found.setdefault(r["b"], []).append((r["v"], r["c"]))
    for b, k in enumerate(brackets):
        upto = k.below + k.on_low
        for v, c in sorted(found[b]):
            upto += c
            if k.rank < upto:
                k.value = v
                break


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.5,),
                    accuracy: int = ACCURACY, final: int | None = None) -> dict[str, list[float | None]]:
    """``{col: [q(p) for p in probs]}``; NULL and NaN ignored; None for a column of them.

    Interpolation between the two neighbouring order statistics is linear
    (numpy's default, scikit-learn's median, Spark ``percentile``)."""
    cols, probs, accuracy = list(cols), [float(p) for p in probs], max(accuracy, 100)
    final = FINAL if final is None else final
    if not cols:
        return {}
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(cols)])
    margin = 2.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    head = x.agg(*[a for i in range(len(cols)) for a in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"a{i}"), F.max(f"c{i}").alias(f"z{i}"),
        F.percentile_approx(f"c{i}", F.array(*map(F.lit, edges)), F.lit(accuracy)).alias(f"e{i}"))]).first()

    brackets: dict[tuple[int, int], _Bracket] = {}  # (column, rank)
    for i in range(len(cols)):
        for j, p in enumerate(probs if head[f"n{i}"] else ()):
            e = head[f"e{i}"]
            for rank in {math.floor((head[f"n{i}"] - 1) * p), math.ceil((head[f"n{i}"] - 1) * p)}:
                brackets.setdefault((i, rank), _Bracket(f"c{i}", rank, e[2 * j], e[2 * j + 1]))
    ends = {k.column: (head["a" + k.column[1:]], head["z" + k.column[1:]]) for k in brackets.values()}
    _solve(x, list(brackets.values()), ends, accuracy, final)

    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for i, c in enumerate(cols):
        for j, p in enumerate(probs if head[f"n{i}"] else ()):
            pos = (head[f"n{i}"] - 1) * p
            low, high = (brackets[i, r].value for r in (math.floor(pos), math.ceil(pos)))
            out[c][j] = _between(low, high, pos - math.floor(pos))
    return out


def _solve(x: DataFrame, brackets: list[_Bracket], ends: dict, accuracy: int, final: int) -> None:
    """Shrink all brackets together until each has its value."""
    open_ = brackets
    while open_:
        _count(x, open_)
        for k in open_:
            if not k.settle():  # the sketch was off by more than its bound: start from the column's ends
                k.low, k.high = ends[k.column]
                k.below = k.on_low = k.on_high = 0
                k.between = -1
        missed = [k for k in open_ if k.between < 0]
        open_ = [k for k in open_ if k.value is None and k.between >= 0]
        few, many = [k for k in open_ if k.between <= final], [k for k in open_ if k.between > final]
        if few:
            _read_off(x, few)
        if many:
            _refine(x, many, accuracy)
        open_ = many + missed


def exact_median(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, (0.5,)).items()}
