"""Observation tables: the reader (#1) and the test fixture views built from the
driver tables (FIXTURES.md F1-F3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import exprs as X
from ..session import jit_sized

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("obs_id", T.StringType()),
        T.StructField("machineID", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("volt", T.DoubleType()),
        T.StructField("rotate", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
        T.StructField("vibration", T.DoubleType()),
        T.StructField("age", T.LongType()),
        T.StructField("error_count", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in S.MAINTENANCE_FEATURES],
        *[T.StructField(c, T.DoubleType()) for c in S.TARGETS],
        T.StructField("failure_within_48h", T.BooleanType()),
    ]
)


UNREADABLE = "array<struct<field: string, text: string, reason: string>>"
INFINITE_TEXTS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def _number(text: Column, num: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(value, why a present text has none) of a numeric field: its trimmed text and the number in it."""
    low, read = F.lower(text), X.finite(num)
    infinite = low.isin(*INFINITE_TEXTS) | (F.abs(num) == F.lit(float("inf")))
    why = F.when(read | text.isNull() | low.isin("nan", "+nan", "-nan"), None).when(
        infinite, F.lit("not finite")).when(num.isNull(), F.lit("not a number"))
    value = F.when(read, num)
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = F.when(value == F.floor(value), value.try_cast(dtype))
        return whole, F.coalesce(why, F.when(value.isNotNull() & whole.isNull(), F.lit("not a whole number")))
    return value, why


def _parsed(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[tuple[str, Column, Column | None, Column | None]]]:
    """A CSV table read as text, with (name, value, text, reason) of every column.

    Staged projections: each text is looked up, trimmed, matched and cast once; values and reasons combine the results."""
    wanted = {f.name: f.dataType for f in schema.fields}
    kinds = [(i, name, wanted.get(name, T.StringType())) for i, name in enumerate(raw.columns)]
    typed = [i for i, _, t in kinds if not isinstance(t, T.StringType)]
    numbers = [i for i, _, t in kinds if i in typed and not isinstance(t, T.BooleanType)]
    d = raw.select(*[X.csv_na_to_null(F.col(f"`{name}`")).alias(f"_x{i}") for i, name, _ in kinds])
    d = d.withColumns({f"_t{i}": X.strip_ws(F.col(f"_x{i}")) for i in typed})
    d = d.withColumns({f"_n{i}": F.when(F.col(f"_t{i}").rlike(S.NUMBER_PATTERN), F.col(f"_t{i}").try_cast("double"))
                       for i in numbers})
    out = []
    for i, name, dtype in kinds:
        text = F.col(f"_x{i}")
        if i in numbers:
            value, why = _number(F.col(f"_t{i}"), F.col(f"_n{i}"), dtype)
            out.append((name, value, text, why))
        elif i in typed:
            value = F.lower(f"_t{i}").try_cast("boolean")
            out.append((name, value, text, F.when(text.isNotNull() & value.isNull(), F.lit("not a boolean"))))
        else:
            out.append((name, text, None, None))
    return d, out


def _typed(raw: DataFrame) -> list[tuple[str, Column, Column | None, Column | None]]:
    """The same of a table that carries types: NaN is missing, an infinity can't be used."""
    out = []
    for f in raw.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = c.cast("double")
            why = F.when(d.isNotNull() & ~F.isnan(d) & ~X.finite(d), F.lit("not finite"))
            out.append((f.name, F.when(X.finite(d), c), c.cast("string"), why))
        else:
            out.append((f.name, c, None, None))
    return out


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: T.StructType = OBSERVATION_SCHEMA, unreadable: str | None = None) -> DataFrame:
    """Load an observation table (#1).

    CSV: every column is read as text, the pandas missing-value tokens become
    NULL, and each value is read as its type in ``schema``. Columns of
    the schema absent from the file are simply not there (tolerant schema).
    Parquet/ORC/JSON: types as they are. NaN is missing: NULL.

    A value that is there but can't be used (a text that is no number, an infinity, a fraction in an integer
    column) becomes NULL too, so that one bad cell doesn't turn a column into text as in a pandas reader. With
    ``unreadable`` a column of that name lists each row's such fields with text and reason; ``unreadable_fields``
    makes a table of them.
    """
    jit_sized(spark)
    if fmt == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        raw, fields = _parsed(raw, schema)
    else:
        raw = spark.read.format(fmt).load(path)
        fields = _typed(raw)
    columns = [value.alias(name) for name, value, _, _ in fields]
    if unreadable:
        found = [F.when(why.isNotNull(), F.struct(F.lit(name).alias("field"), text.alias("text"), why.alias("reason")))
                 for name, _, text, why in fields if why is not None]
        listed = F.array_compact(F.array(*found)) if found else F.array()
        columns.append(listed.cast(UNREADABLE).alias(unreadable))
    return raw.select(*columns)


def unreadable_fields(df: DataFrame, column: str = "unreadable", keep=(S.KEY,)) -> DataFrame:
    """One row per value that couldn't be used: the kept columns, ``field``, ``text``, ``reason``.

    From an inner ``inline`` the optimizer infers filters on the list and pushes them down to the reader, where every
    field would be read again for each; the outer one has none, and its rows without a field are dropped after it."""
    listed = df.select(*[c for c in keep if c in df.columns], F.inline_outer(column))
    return listed.where(F.col("field").isNotNull())


# --------------------------------------------------------------------------- fixture views

def fixture_observations(spark: SparkSession, sf_dir: str,
                         lineitem: DataFrame | None = None) -> DataFrame:
    """observations derived from ``lineitem`` join ``part`` (FIXTURES.md).

    An inner equi-join on the part key; Catalyst/AQE choose broadcast or a
    shuffle join from the runtime size of ``part``. ``lineitem`` may be a
    streaming DataFrame (stream-static join).
    """
    li = lineitem if lineitem is not None else spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    ok, pk, sk, ln = (F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
                      F.col("l_linenumber"))
    o = j.select(
        F.concat_ws("-", *[k.cast("string") for k in (ok, pk, sk, ln)]).alias("obs_id"),
        sk.alias("machineID"),
        F.when(F.col("p_partkey") % 101 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("model"), (1 + F.col("p_partkey") % 4).cast("string")))
        .alias("model"),
        (F.lit(150.0) + F.col("l_quantity")).alias("volt"),
        (F.lit(300.0) + F.col("l_extendedprice") / F.lit(500.0)).alias("rotate"),
        F.when(ok % 37 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(80.0) + F.col("p_size")).alias("pressure"),
        F.when((ok + ln) % 41 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(30.0) + F.lit(400.0) * F.col("l_discount")).alias("vibration"),
        ((sk * 7) % 21).cast("long").alias("age"),
        (ln - 1).cast("long").alias("error_count"),
        ((ok * 3 + pk) % 60).alias("days_since_comp1_maint"),
        ((ok * 7 + pk) % 60).alias("days_since_comp2_maint"),
        ((ok * 11 + pk) % 60).alias("days_since_comp3_maint"),
        ((ok * 13 + pk) % 60).alias("days_since_comp4_maint"),
    )
    t1 = F.greatest(
        F.lit(0.0),
        (60 - F.col("days_since_comp1_maint")) / F.lit(7.0)
        + (200 - F.col("volt")) / F.lit(25.0)
        - F.col("error_count") * F.lit(0.25),
    )
    t2 = (60 - F.col("days_since_comp2_maint")) / F.lit(7.0) + F.col("age") * F.lit(0.125)
    t3 = (60 - F.col("days_since_comp3_maint")) / F.lit(5.0) + (7 - F.col("error_count")) * F.lit(0.5)
    t4 = (60 - F.col("days_since_comp4_maint")) / F.lit(4.0) + (F.col("rotate") - 300) / F.lit(100.0)
    o = o.select("*", t1.alias(S.TARGETS[0]), t2.alias(S.TARGETS[1]),
                 t3.alias(S.TARGETS[2]), t4.alias(S.TARGETS[3]))
    return o.withColumn(
        "failure_within_48h",
        F.least(*[F.col(t) for t in S.TARGETS]) < F.lit(2.0) / F.lit(7.0))


def with_fixed_predictions(df: DataFrame) -> DataFrame:
    """F2: ``pred_compK_weeks = ttf_compK_weeks * 0.9 - 0.6`` (some below 0 on purpose)."""
    return df.select("*", *[(F.col(t) * F.lit(0.9) - F.lit(0.6)).alias(S.pred_col(t))
                            for t in S.TARGETS])


#: Texts planted in F3 by (modulus of the order key, feature, text).
REQUEST_TEXTS = ((53, "volt", "abc"), (59, "rotate", "nan"), (61, "pressure", ""), (67, "vibration", "inf"),
                 (71, "model", "never-seen"), (73, "age", " 7 "), (79, "error_count", "None"))


def fixture_requests(df: DataFrame) -> DataFrame:
    """text ``request_id`` plus the 11 features as text, with planted missing
    tokens, bad numbers, infinities and unseen categories (FIXTURES.md)."""
    order = F.substring_index(F.col(S.KEY), "-", 1).cast("long")
    cols = {c: F.col(c).cast("string") for c in S.FEATURE_ORDER}
    for m, c, text in REQUEST_TEXTS:
        cols[c] = F.when(order % m == 0, F.lit(text)).otherwise(cols[c])
    return df.select(F.col(S.KEY).alias("request_id"), *[v.alias(c) for c, v in cols.items()])


def fixture_request_lines(df: DataFrame) -> DataFrame:
    """F3 as JSON lines (column ``value``): some lines are blank, cut off, without an id or without ``volt``."""
    r = fixture_requests(df)
    order = F.substring_index("request_id", "-", 1).cast("long")
    text = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    whole, no_id = text("*"), text(*S.FEATURE_ORDER)
    no_volt = text("request_id", *[c for c in S.FEATURE_ORDER if c != "volt"])
    return r.select(
        F.when(order % 83 == 0, F.lit(" ")).when(order % 89 == 0, F.concat(F.lit('{"volt": '), F.col("request_id")))
        .when(order % 97 == 0, no_id).when(order % 101 == 0, no_volt).otherwise(whole).alias("value"))
