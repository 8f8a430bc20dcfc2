"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solweave.functions.names import label, station
from solweave.llm import mixing, packing, quality
from solweave.llm.nearest import nearest_in_time
from solweave.llm.percentiles import digit_histogram, histogram_percentiles, keyed_values, merge_histograms, radix_percentiles
from solweave.llm.tokens import token_size

PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "cells").select("cell_id", "solset", station("ant").alias("ant"), "pol", "val")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the known values of each antenna and polarisation."""
    x = radix_percentiles(_readings(spark, d), ["ant", "pol"], "val", PROBS, row_id="cell_id")
    return x.select("ant", "pol", "q", "n", "value")


#: Depth of the summaries that are stored per day: sign, exponent and 8 bits of the fraction, so bounds are 2**-8 of the value apart.
SUMMARY_BITS = 20


def _days(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each day: how many values of an antenna and polarisation lie in each interval."""
    x = _read(spark, d, "cells").select("cell_id", F.floor(F.col("time") / 86400).alias("day"), station("ant").alias("ant"), "pol", "val")
    return digit_histogram(keyed_values(x, ["day", "ant", "pol"], "val", "cell_id"), ["day", "ant", "pol"], SUMMARY_BITS)


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same from one summary per day, merged: bounds that are 2**-8 of the value apart."""
    merged = merge_histograms(_days(spark, d), ["ant", "pol"])
    return histogram_percentiles(merged, ["ant", "pol"], PROBS, SUMMARY_BITS).select("ant", "pol", "q", "n", "lo", "hi")


def p1_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The exact percentiles, whether the bounds of the merged days hold them, and whether these are as narrow as stated."""
    same = ["ant", "pol", "q"]
    exact, merged = p1_percentiles(spark, d).alias("e"), p1_merged(spark, d).alias("m")
    on = F.lit(True)
    for c in same:
        on = on & F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}"))
    v, lo, hi = F.col("e.value"), F.col("m.lo"), F.col("m.hi")
    narrow = (hi - lo <= F.abs(v) * 2.0 ** (12 - SUMMARY_BITS)) | (F.abs(v) == float("inf"))
    return exact.join(merged, on).select("e.ant", "e.pol", "e.q", "m.n", "e.value", ((lo <= v) & (v <= hi)).alias("held"), narrow.alias("narrow"))


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Values and intervals of the summary of each day."""
    return _days(spark, d).groupBy("day").agg(F.sum("n").alias("readings"), F.count(F.lit(1)).alias("intervals"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    tec = _read(spark, d, "tec_cells").select("tec_id", station("ant").alias("ant"), "time")
    clock = _read(spark, d, "clock_cells").select("clock_id", station("ant").alias("ant"), "time")
    return nearest_in_time(tec, clock, ["ant"], "time", "time", "tec_id", "clock_id", tolerance=5.0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """TEC solutions and their nearest clock solutions within 5 s."""
    return _pairs(spark, d).filter(F.col("clock_id").isNotNull()).select("tec_id", "clock_id")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many TEC solutions have a clock solution within 5 s."""
    return _pairs(spark, d).agg(F.count(F.lit(1)).alias("solutions"), F.count("clock_id").alias("paired"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", token_size("text").alias("size"))
    return packing.pack(docs, "doc_id", "size", packing.box_kinds(_read(spark, d, "box_spec"), "box", "capacity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut, for each kind of box."""
    return _packed(spark, d).filter((F.col("piece") == 0) & (F.col("pieces") > 1)).select("box", "doc_id")


def p6_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box of every piece of every document."""
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Boxes used and their fill."""
    return packing.fill_report(_packed(spark, d))


def p6_bound(spark: SparkSession, d: str) -> DataFrame:
    """Items, pieces and tokens of each kind of box, and whether bins hold no more than their capacity and are at most 2 % (and one) above the least number."""
    x = packing.fill_report(_packed(spark, d))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return x.select("box", "items", "cut_items", "pieces", "tokens", (F.col("fullest") <= F.col("capacity")).alias("within"), (F.col("bins") <= least * 1.02 + 1).alias("tight"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, d, "documents").select("doc_id", "source", token_size("text").alias("size"))
    return mixing.mix(docs, "doc_id", "source", "size", _read(spark, d, "mix_target"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their target share."""
    return _mixed(spark, d)[1].filter("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents in the order of training."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources."""
    x = _mixed(spark, d)[1]
    return x.select("source", "size", "max_uses", F.round("demand", 3).alias("demand"), "short")


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often every document of a source was drawn, the documents drawn once more, and whether positions follow the order of the stream."""
    drawn, report = _mixed(spark, d)
    docs = _read(spark, d, "documents").groupBy(label("source").alias("k")).agg(F.count(F.lit(1)).alias("docs"))
    by_use = drawn.groupBy("source", "use").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    by_use = by_use.join(docs, label("source") == F.col("k"))
    whole = by_use.groupBy("source").agg(F.count(F.when(F.col("n") == F.col("docs"), 1)).alias("whole_uses"), F.max("docs").alias("docs"))
    x = report.join(whole, "source", "left")
    over = F.greatest(F.col("drawn") - F.col("demand"), F.lit(0.0))
    longest = _read(spark, d, "documents").groupBy(label("source").alias("k")).agg(F.max(token_size("text")).alias("longest"))
    x = x.join(longest, label("source") == F.col("k"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return x.select("source", zero("docs"), zero("whole_uses"), (F.col("short") | (over < F.col("longest"))).alias("within_a_document"))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return quality.line_shares(_read(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at most half of the characters are running sentences."""
    return _shares(spark, d).filter(F.col("prose") <= 0.5).select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of prose, list, table and junk lines of each document."""
    return _shares(spark, d)


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Words, symbols, lines and common words of each document."""
    return quality.text_statistics(_read(spark, d, "documents"), "doc_id", "text", "lang", _read(spark, d, "common_word"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_percentiles": p1_percentiles,
        "p1_merged": p1_merged,
        "p1_bounds": p1_bounds,
        "p1_sizes": p1_sizes,
        "p2_found": p2_found,
        "p2_coverage": p2_coverage,
        "p6_found": p6_found,
        "p6_boxes": p6_boxes,
        "p6_fill": p6_fill,
        "p6_bound": p6_bound,
        "p7_found": p7_found,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p7_uses": p7_uses,
        "p8_found": p8_found,
        "p8_shares": p8_shares,
        "p8_statistics": p8_statistics,
    }


_NEAREST = """
WITH t AS (SELECT DISTINCT tec_id, upper(trim(ant)) AS ant, time FROM tec_cells WHERE ant IS NOT NULL AND time IS NOT NULL),
c AS (SELECT upper(trim(ant)) AS ant, time, min(clock_id) AS clock_id FROM clock_cells WHERE ant IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2),
a AS (SELECT t.tec_id, c.clock_id, t.time - c.time AS d FROM t ASOF LEFT JOIN c ON t.ant = c.ant AND t.time >= c.time),
b AS (SELECT t.tec_id, c.clock_id, c.time - t.time AS d FROM t ASOF LEFT JOIN c ON t.ant = c.ant AND t.time <= c.time),
n AS (SELECT a.tec_id, CASE WHEN b.d IS NULL OR a.d < b.d THEN a.clock_id WHEN a.d IS NULL OR b.d < a.d THEN b.clock_id
  ELSE least(a.clock_id, b.clock_id) END AS clock_id, least(a.d, b.d) AS d FROM a JOIN b USING (tec_id))
"""


def oracle_sql() -> dict[str, str]:
    probs = ", ".join(f"({p}::DOUBLE)" for p in PROBS)
    exact = f"""
WITH r AS (SELECT DISTINCT cell_id, upper(trim(ant)) AS ant, pol, val + 0.0 AS val FROM cells WHERE val IS NOT NULL AND NOT isnan(val)),
k AS (SELECT ant, pol, val, row_number() OVER (PARTITION BY ant, pol ORDER BY val) AS rn, count(*) OVER (PARTITION BY ant, pol) AS n FROM r),
p(q) AS (VALUES {probs}),
e AS (SELECT ant, pol, q, n, val AS value FROM k JOIN p ON rn = greatest(1, CAST(ceil(q * n) AS BIGINT)))
"""
    return {
        "p1_percentiles": exact + "SELECT ant, pol, q, n, value FROM e",
        "p1_bounds": exact + "SELECT ant, pol, q, n, value, TRUE AS held, TRUE AS narrow FROM e",
        "p2_found": _NEAREST + "SELECT tec_id, clock_id FROM n WHERE d <= 5.0",
        "p2_coverage": _NEAREST + "SELECT count(*) AS solutions, count(*) FILTER (WHERE d <= 5.0) AS paired FROM n",
        "p6_found": "SELECT box, doc_id FROM documents, box_spec WHERE strlen(text) > capacity",
        "p6_bound": """
SELECT box, count(*) AS items, count(*) FILTER (strlen(text) > capacity) AS cut_items, CAST(sum(greatest(1, ceil(strlen(text) / capacity))) AS BIGINT) AS pieces,
  CAST(sum(strlen(text)) AS BIGINT) AS tokens, TRUE AS within, TRUE AS tight FROM documents, box_spec GROUP BY box""",
        "p7_found": """
WITH s AS (SELECT lower(trim(source)) AS k, sum(strlen(text)) AS size FROM documents GROUP BY 1),
m AS (SELECT t.*, coalesce(s.size, 0) AS size FROM mix_target t LEFT JOIN s ON s.k = lower(trim(t.source)))
SELECT source FROM m WHERE max_uses * size < target_share * (SELECT sum(size) FROM m)""",
        "p7_shares": """
WITH s AS (SELECT lower(trim(source)) AS k, sum(strlen(text)) AS size FROM documents GROUP BY 1),
m AS (SELECT t.*, coalesce(s.size, 0) AS size FROM mix_target t LEFT JOIN s ON s.k = lower(trim(t.source)))
SELECT source, CAST(size AS BIGINT) AS size, max_uses, round(target_share * (SELECT sum(size) FROM m), 3) AS demand,
  max_uses * size < target_share * (SELECT sum(size) FROM m) AS short FROM m""",
        "p7_uses": """
WITH s AS (SELECT lower(trim(source)) AS k, sum(strlen(text)) AS size, count(*) AS docs FROM documents GROUP BY 1),
m AS (SELECT t.*, coalesce(s.size, 0) AS size, docs FROM mix_target t LEFT JOIN s ON s.k = lower(trim(t.source)))
SELECT source, coalesce(docs, 0) AS docs, CASE WHEN docs IS NULL THEN 0 ELSE CAST(least(max_uses, floor(target_share * (SELECT sum(size) FROM m) / size)) AS BIGINT) END AS whole_uses,
  TRUE AS within_a_document FROM m""",
        "p8_statistics": """
WITH c AS (SELECT lower(trim(lang)) AS k, list(DISTINCT lower(word)) AS c FROM common_word GROUP BY 1),
z AS (SELECT list(DISTINCT lower(word)) AS z FROM common_word),
d AS (SELECT doc_id, text, coalesce(c, z) AS c, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w,
  list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS l FROM documents CROSS JOIN z LEFT JOIN c ON k = lower(trim(lang)))
SELECT doc_id, length(text) AS chars, CAST(len(w) AS BIGINT) AS words,
  round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END, 6) AS word_length,
  round(CASE WHEN text <> '' THEN length(regexp_replace(text, '[\\p{L}\\p{N} \\t\\n\\r]', '', 'g'))::DOUBLE / length(text) END, 6) AS symbol_ratio,
  CAST(len(l) AS BIGINT) AS lines,
  round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda s: regexp_matches(rtrim(s), '[.!?]$')))::DOUBLE / len(l) END, 6) AS full_lines,
  round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(c, lower(x))))::DOUBLE / len(w) END, 6) AS common
FROM d""",
    }
