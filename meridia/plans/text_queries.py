"""Text functions on names and labels of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import codes, text
from meridia.plans import bind
from meridia.registry import query

TERMS = r"""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '<http://example.org/entity/Q' || CAST(c_custkey AS STRING) || '>'
  WHEN 1 THEN '"' || c_name || ' été"@fr' WHEN 2 THEN '"' || c_mktsegment || '"^^<http://example.org/string>' ELSE c_mktsegment END AS term,
  CASE WHEN c_custkey % 5 = 0 THEN 'Point(0 0)' WHEN c_custkey % 5 = 1 THEN 'Point(200.5 10)' WHEN c_custkey % 5 = 2 THEN 'nowhere'
  ELSE 'Point(' || CAST(c_custkey % 360 - 180 AS STRING) || '.25 ' || CAST(c_custkey % 180 - 90 AS STRING) || ')' END AS place,
  CASE WHEN c_custkey % 3 = 0 THEN 'Q' ELSE 'X' END || CAST(c_custkey AS STRING) AS id FROM {customer}"""
# Backslashes are one character in DuckDB's strings and two in Spark's.
_SPARK_TERMS = TERMS.replace("\\", "\\\\")


@query(
    "SC1 SC2 SC3",
    f"""{bind.ctes(t=TERMS)}
SELECT k, CASE WHEN k % 4 = 0 THEN 'Q' || k WHEN k % 4 = 1 THEN replace(regexp_extract(term, '^"(.*)"@fr$', 1), '\\u00e9', 'é') WHEN k % 4 = 2 THEN regexp_extract(term, '^"(.*)"', 1) ELSE term END AS value,
  CASE WHEN k % 5 >= 3 AND (k % 180 - 90) + 0.0 <= 90 AND NOT (k % 360 = 180 AND k % 180 = 90 AND false) THEN CAST(regexp_extract(place, '\\((-?[0-9.]+) ', 1) AS DOUBLE) END AS lon,
  CASE WHEN k % 5 >= 3 THEN CAST(regexp_extract(place, ' (-?[0-9]+)\\)', 1) AS DOUBLE) END AS lat,
  CASE WHEN k % 3 = 0 AND k > 0 THEN k END AS number FROM t""",
)
def sc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RDF terms, points and item ids decoded."""
    rows = bind.frame(spark, sf_dir, _SPARK_TERMS).withColumn("p", text.point("place"))
    return rows.select("k", text.decode_term("term").alias("value"), "p.lon", "p.lat", text.item_number("id").alias("number"))


NAMES = """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'Kingdom of ' || p_name || ' (1816)' WHEN 1 THEN '(' || p_brand || ')' WHEN 2 THEN 'Vassalage of ' || p_brand || ' to ' || p_type
  WHEN 3 THEN p_name || ' Empire, north' WHEN 4 THEN 'the "' || p_name || '" o''' || p_brand ELSE '  ' || p_name || '   ' || p_type || ' ' END AS name,
  p_brand || ' ; ' || p_type || ';;' || p_name AS list, p_retailprice AS price, CAST(p_size AS INT) AS size,
  'On ' || CAST(1 + p_partkey % 28 AS STRING) || ' March and May ' || CAST(1 + p_partkey % 9 AS STRING) || ', not 3 Marchs' AS line FROM {part}"""
_CLEAN = "trim(regexp_replace(name, '\\s+', ' ', 'g'))"


@query(
    "SC11 SC12",
    f"""{bind.ctes(t=NAMES)}
SELECT k, list_filter(list_transform(string_split(list, ';'), lambda x: trim(x)), lambda x: x <> '') AS parts, k % 6 = 1 AS composite,
  CASE WHEN k % 6 = 2 THEN 'Vassalage' END AS kind, CASE WHEN k % 6 = 2 THEN regexp_extract(name, ' of (.+) to (.+)$', 1) END AS of_name, CASE WHEN k % 6 = 2 THEN regexp_extract(name, ' of (.+) to (.+)$', 2) END AS to_name,
  {_CLEAN} AS cleaned, regexp_replace(printf('%.2f', price), '\\.?0+$', '') AS short_price
FROM t""",
)
def sc_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and relations in names, clean names, and short decimals."""
    rows = bind.frame(spark, sf_dir, NAMES).withColumn("r", text.relation("name"))
    rows = rows.select("k", text.split_list("list").alias("parts"), text.composite("name").alias("composite"), F.col("r.kind").alias("kind"), F.col("r.of").alias("of_name"), F.col("r.to").alias("to_name"), text.clean("name").alias("cleaned"), text.decimals("price", 2).alias("short_price"))
    return rows


@query(
    "SC13 SC14 SC15 SC28",
    f"""{bind.ctes(t=NAMES)},
c AS (SELECT *, {_CLEAN} AS c FROM t), b AS (SELECT *, trim(regexp_replace(c, '\\s*\\([^()]*\\)$', '')) AS b, trim(regexp_replace(regexp_replace(c, '\\s*\\([^()]*\\)', '', 'g'), ',.*$', '')) AS s FROM c),
d AS (SELECT *, CASE WHEN b = '' THEN c ELSE b END AS e, CASE WHEN starts_with(s, 'Kingdom of ') THEN substr(s, 12) ELSE s END AS u FROM b)
SELECT k, replace(regexp_replace(upper(substr(e, 1, 1)) || substr(e, 2), '"([^"]*)"', '“\\1”', 'g'), '''', '’') AS display,
  CASE WHEN ends_with(u, ' Empire') THEN substr(u, 1, length(u) - 7) ELSE u END AS short, 'https://example.org/wiki/' || replace(replace(p, ' ', '_'), '#', '%23') AS url,
  list_sort(list_distinct([CAST(1 + k % 28 AS VARCHAR) || ' March', CAST(1 + k % 9 AS VARCHAR) || ' May'])) AS days,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b and c' END AS spoken
FROM (SELECT *, (SELECT p_brand FROM part WHERE p_partkey = k) || ' (x)' AS p FROM d)""",
)
def sc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display and short names, article addresses, days mentioned, spoken lists."""
    rows = bind.frame(spark, sf_dir, NAMES)
    brand = F.concat(F.trim(F.get(F.split("list", ";"), 0)), F.lit(" (x)"))
    letters = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("k") % 4).cast("int"))
    return rows.select("k", text.display_name("name").alias("display"), text.short_name("name").alias("short"), text.article_url(brand).alias("url"), text.day_mentions("line").alias("days"), text.spoken_join(letters).alias("spoken"))


HEIGHTS = "SELECT o_orderkey AS k, CAST(o_orderkey * 7919 % 12000000 - 6000000 AS DOUBLE) / 1000 AS h, o_totalprice AS price, (o_orderkey * 37 % 900 - 450) / 10e0 AS shore FROM {orders}"
_AWAY = "(CASE WHEN abs({0}) - floor(abs({0})) >= 0.5 THEN floor(abs({0})) + 1 ELSE floor(abs({0})) END * sign({0}))"


@query(
    "SC19 SC25 SC26 SC27",
    f"""{bind.ctes(t=HEIGHTS)},
c AS (SELECT *, CAST(CASE WHEN h >= -200 THEN {_AWAY.format("h")} ELSE -200 + {_AWAY.format("((h + 200) / 4)")} END AS BIGINT) AS code FROM t)
SELECT k, CAST({_AWAY.format("h")} AS BIGINT) AS away, code, CASE WHEN code >= -200 THEN CAST(code AS DOUBLE) ELSE -200 + (code + 200) * 4.0 END AS height,
  CAST(least(255, greatest(0, 128 + {_AWAY.format("(shore * 4)")})) AS INT) AS distance_byte,
  round_even(price * 100000, 0)::BIGINT AS fixed, CASE WHEN price > 0 THEN round(round_even(price / pow(10, floor(log10(price)) - 2), 0) * pow(10, floor(log10(price)) - 2), 6) ELSE 0.0 END AS digits3,
  CAST((CASE WHEN h > 0 THEN 1 ELSE 0 END) | (CASE WHEN shore < 0 THEN 2 ELSE 0 END) | (CASE WHEN price > 100000 THEN 4 ELSE 0 END) AS INT) AS flags,
  CASE WHEN shore >= 1 THEN greatest(h, 1.0) WHEN shore <= -1 THEN least(h, -1.0) ELSE h END AS clamped FROM c""",
)
def sc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding away from zero, height codes and back, distance bytes, fixed point, digits, flags, coastal clamp."""
    rows = bind.frame(spark, sf_dir, HEIGHTS).withColumn("code", codes.height_code("h"))
    flags = codes.flags(F.col("h") > 0, F.col("shore") < 0, F.col("price") > 100000)
    return rows.select(
        "k", codes.away("h").alias("away"), "code", codes.code_height("code").alias("height"), codes.distance_byte("shore").alias("distance_byte"), codes.fixed_point("price", 5).alias("fixed"),
        F.round(codes.digits("price", 3), 6).alias("digits3"), flags.alias("flags"), codes.coastal("h", "shore").alias("clamped"),
    )
