"""Line dedup: lines that many documents share stay in one document only.

Line keys become 128-bit hashes. Their places are range-partitioned by (hash, slice of the documents) and
sorted by document and position, so each slice of a line's places is a stream with the largest document first:
a place whose document differs from the one before is the first of its document. The slices' counts and first
documents add up to the line's, so a line that a third of all documents holds spreads over many tasks, there
and where the places learn their verdict. What returns to the documents is a run-length-compressed keep bitmap,
not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearcast.llm.store import written

#: White space stripped at both ends of a line before comparing it.
STRIP = " \t\n\x0b\x0c\r"
#: The places of one line are worked on in up to so many slices, by a hash of their document.
SLICES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """Null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_places(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """(_h1, _h2, _slice, _d, _t, _pos): the hashed lines of at least ``min_chars`` code points and where they stand."""
    return (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).alias("_d"), F.xxhash64(text).alias("_t"),
                F.posexplode(split_lines(F.col(text))).alias("_pos", "_line"))
        .where(F.length("_line") >= min_chars)
        .select("_d", "_t", "_pos", line_key(F.col("_line")).alias("_k"))
        .where(F.length("_k") >= min_chars)
        .select(F.xxhash64("_k").alias("_h1"), F.xxhash64(F.lit(7), "_k").alias("_h2"),
                F.pmod(F.xxhash64("_d"), F.lit(SLICES)).cast("int").alias("_slice"), "_d", "_t", "_pos")
    )


def common_lines(places: DataFrame, min_docs: int) -> DataFrame:
    """(_h1, _h2, _slice, _keep): the lines of at least ``min_docs`` documents, a row for each slice that holds one.

    ``_keep``: the document that keeps the line. The range partitioning clusters the window and the slices'
    aggregate, so neither shuffles again; a line has ``SLICES`` rows at most where its slices are added up.
    """
    stream = Window.partitionBy("_h1", "_h2", "_slice").orderBy(F.desc("_d"), "_pos")
    before = F.lag("_d").over(stream)
    firsts = (
        places.select("_h1", "_h2", "_slice", "_d", "_pos").repartitionByRange("_h1", "_h2", "_slice")
        .withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("_d")))
    )
    slices = firsts.groupBy("_h1", "_h2", "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_first"))
    return (
        slices.groupBy("_h1", "_h2").agg(
            F.sum("_n").alias("_n"), F.max("_first").alias("_keep"), F.collect_set("_slice").alias("_slices"))
        .where(F.col("_n") >= min_docs)
        .select("_h1", "_h2", F.explode("_slices").alias("_slice"), "_keep")
    )


def kept_runs(drops: Column) -> Column:
    """The keep bitmap of sorted dropped positions as its runs of kept lines: array of (start, stop).

    Positions count from 0, ``stop`` is exclusive and null for the run that ends with the document.
    """
    first = F.filter(drops, lambda p, i: (i == 0) | (F.get(drops, i - 1) != p - 1))
    last = F.filter(drops, lambda p, i: (i == F.size(drops) - 1) | (F.get(drops, i + 1) != p + 1))
    stops = F.concat(first, F.array(F.lit(None).cast("int")))
    runs = F.transform(F.concat(F.array(F.lit(0)), F.transform(last, lambda p: p + 1)),
                       lambda p, i: F.struct(p.alias("start"), F.get(stops, i).alias("stop")))
    return F.filter(runs, lambda r: r["stop"].isNull() | (r["stop"] > r["start"]))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, _text_hash, _keep_runs): for each document that loses lines its keep bitmap, as ``kept_runs`` gives it.

    A line of at least ``min_chars`` code points (after stripping and ASCII lower-casing) found in at least
    ``min_docs`` documents stays only in the largest document id holding it (all its places there). Rows
    without an id don't take part: they lose nothing and count for nothing. Rows that share an id count as
    one document. An empty table gives an empty result.
    """
    places = written(line_places(docs, min_chars, key, text), "lines")
    drops = places.join(common_lines(places, min_docs), ["_h1", "_h2", "_slice"]).where(F.col("_d") < F.col("_keep"))
    return drops.groupBy(F.col("_d").alias(key), F.col("_t").alias("_text_hash")).agg(
        F.sort_array(F.collect_set("_pos")).alias("_drops")).select(
        key, "_text_hash", kept_runs(F.col("_drops")).alias("_keep_runs"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, kept, n_lines, n_dropped, keep) for every row of ``docs``.

    ``row``: the row as it stands, as a struct, so that no column of it can clash; ``kept``: its text cut to
    the kept lines; ``keep``: the keep bitmap as runs of lines, (start, length). A null text stays null and
    counts as one empty line; a document that loses every line gets ''.
    """
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, key, text).select(
        F.col(key).alias("_bd"), F.col("_text_hash").alias("_bt"), "_keep_runs")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("_d"), F.xxhash64(text).alias("_t"))
    out = rows.join(bitmaps, (F.col("_d") == F.col("_bd")) & (F.col("_t") == F.col("_bt")), "left")
    whole = F.col("row").getField(text)
    lines = split_lines(whole)
    all_lines = F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop")))
    out = out.withColumn("_n", F.size(lines)).withColumn("keep", F.filter(
        F.transform(F.coalesce("_keep_runs", all_lines), lambda r: F.struct(
            r["start"].alias("start"), (F.coalesce(r["stop"], F.col("_n")) - r["start"]).alias("length"))),
        lambda r: r["length"] > 0))
    left = F.aggregate("keep", F.lit(0), lambda n, r: n + r["length"])
    cut = F.array_join(F.flatten(F.transform(
        F.col("keep"), lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    return out.withColumn("n_dropped", (F.col("_n") - left).cast("long")).select(
        "row", F.when(F.col("n_dropped") == 0, whole).otherwise(cut).alias("kept"),
        F.col("_n").cast("long").alias("n_lines"), "n_dropped", "keep")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, list_extract(ls, i) AS line, len(ls) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) s,
       unnest(range(1, len(ls) + 1)) AS u(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT x.doc_id, x.pos, x.line, x.n_lines, coalesce(x.doc_id <> c.keep, false) AS gone
  FROM keyed x LEFT JOIN common c ON x.k = c.k
)
SELECT doc_id, CAST(max(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
