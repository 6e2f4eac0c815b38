"""Deterministic adapters from the given tables to the shapes that operators take.

Their text is SQL that Spark and DuckDB both read; {name} stands for a given table and
DIV for whole division and DAYNO(x) for the day number of a timestamp, so queries and their SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of an adapter."""
    names = set(re.findall(r"{(\w+)}", text))
    text = re.sub(r"DAYNO\((\w+)\)", r"CAST(unix_date(to_date(\1)) + 719162 AS BIGINT)", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def duck(text: str) -> str:
    """An adapter as DuckDB reads it."""
    text = re.sub(r"DAYNO\((\w+)\)", r"CAST(date_diff('day', DATE '1970-01-01', CAST(\1 AS DATE)) + 719162 AS BIGINT)", text)
    return re.sub(r"{(\w+)}", r"\1", text).replace(" DIV ", " // ")


def ctes(**adapters: str) -> str:
    """WITH clause of adapters for DuckDB."""
    return "WITH " + ",\n".join(f"{name} AS ({duck(text)})" for name, text in adapters.items())


def geo(k: str) -> str:
    return f"({k} * 7919 % 36000) / 1e2 - 180 AS lon, ({k} * 104729 % 17800) / 1e2 - 89 AS lat"


#: Dated statements: an order's customer is the event, its lines are statements, some of them long ago.
STATEMENT = """SELECT l_orderkey * 10 + l_linenumber AS line_no, o_orderpriority AS cls, o_custkey AS qid,
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'event ' || CAST(o_custkey AS STRING) || ' (' || CAST(o_custkey % 3 AS STRING) || ')' END AS label,
  CASE WHEN l_orderkey % 3 = 0 THEN 'Title_' || CAST(l_orderkey AS STRING) END AS enwiki,
  CASE l_linenumber % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'start' ELSE 'end' END AS prop,
  CAST(year(l_shipdate) - (o_custkey % 50) * 60 AS BIGINT) AS y, CAST(month(l_shipdate) AS INT) AS m, CAST(least(28, day(l_shipdate)) AS INT) AS d,
  CAST(8 + (l_orderkey + l_linenumber) % 4 AS INT) AS prec,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey * 7919 % 36000) / 1e2 - 180 END AS lon,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey * 104729 % 17800) / 1e2 - 89 END AS lat,
  CAST(l_quantity AS INT) - 1 AS editions,
  CASE WHEN o_custkey DIV 7 > 0 AND l_linenumber < 3 THEN o_custkey DIV 7 END AS parent
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

#: Classes with weights; one statement class is not listed.
EVENT_CLASS = """SELECT * FROM (VALUES (0, '1-URGENT', CAST(3.0 AS DOUBLE), CAST(NULL AS STRING)), (1, '2-HIGH', CAST(2.0 AS DOUBLE), '1-URGENT'),
  (2, '3-MEDIUM', CAST(2.0 AS DOUBLE), '2-HIGH'), (3, '4-NOT SPECIFIED', CAST(1.0 AS DOUBLE), '1-URGENT'), (4, '9-ABSENT', CAST(1.5 AS DOUBLE), '3-MEDIUM')) AS t(ord, cls, weight, within)"""

#: Curated boosts, dates, ends and places of some events, one of them unknown.
CURATED = """SELECT c_custkey AS qid, CASE WHEN c_custkey % 40 = 1 THEN CAST(c_custkey % 5 AS DOUBLE) END AS boost,
  CASE WHEN c_custkey % 40 = 2 THEN CAST(1000 + c_custkey AS BIGINT) END AS day,
  CASE WHEN c_custkey % 40 = 1 OR c_custkey % 80 = 2 THEN CAST(500000 + c_custkey AS BIGINT) END AS until,
  CASE WHEN c_custkey % 14 = 0 THEN CAST(c_custkey % 360 - 180 AS DOUBLE) END AS lon,
  CASE WHEN c_custkey % 14 = 0 THEN CAST(c_custkey % 180 - 90 AS DOUBLE) END AS lat
FROM {customer} WHERE c_custkey % 40 IN (1, 2) OR c_custkey % 14 = 0
UNION ALL SELECT CAST(999999999 AS BIGINT), CAST(1.0 AS DOUBLE), NULL, NULL, NULL, NULL"""

#: Scored, located, spanned rows of the parts table, with a forest of parents.
EVENT_ROW = """SELECT p_partkey AS qid, p_name AS label, (p_partkey * 7919 % 36000) / 1e2 - 180 AS lon, (p_partkey * 104729 % 17800) / 1e2 - 89 AS lat,
  700000 + p_partkey * 37 % 36500 AS t0, 700000 + p_partkey * 37 % 36500 + p_partkey * 13 % 400 AS t1,
  CAST(p_partkey * 389 % 1001 AS INT) AS score, CASE WHEN p_partkey > 0 THEN p_partkey DIV 7 END AS parent,
  p_partkey % 5 <> 0 AS located, CAST(p_size AS INT) AS editions, p_brand AS cls
FROM {part}"""

#: Edges child -> parent of the parts forest, and with planted circles of one, two and three.
PARENT = "SELECT p_partkey AS child, p_partkey DIV 7 AS parent FROM {part} WHERE p_partkey > 0"
PARENT_CYCLES = """SELECT p_partkey AS child, CASE WHEN p_partkey % 50 = 49 THEN p_partkey WHEN p_partkey % 50 = 45 THEN p_partkey + 1 WHEN p_partkey % 50 = 46 THEN p_partkey - 1
  WHEN p_partkey % 50 IN (20, 21) THEN p_partkey + 1 WHEN p_partkey % 50 = 22 THEN p_partkey - 2 ELSE p_partkey DIV 7 END AS parent FROM {part} WHERE p_partkey > 0 AND p_partkey < 300"""

#: One frame per day of events: a day, a window around it, a target place.
FRAME = """SELECT day AS frame, day - 3 AS w0, day + 3 AS w1, (day * 7919 % 36000) / 1e2 - 180 AS lon, (day * 104729 % 17800) / 1e2 - 89 AS lat
FROM (SELECT DISTINCT DAYNO(ts) AS day FROM {events}) AS x"""
#: Suppliers as polities: boxes of cells valid from one year to another.
POLITY = """SELECT s_suppkey AS row_id, 'P' || CAST(s_suppkey % 40 AS STRING) AS name, CAST(1800 + s_suppkey * 17 % 60 AS INT) AS first, CAST(1800 + s_suppkey * 17 % 60 + s_suppkey * 7 % 30 AS INT) AS last,
  CAST(s_suppkey * 31 % 40 AS INT) AS j0, CAST(s_suppkey * 47 % 80 AS INT) AS i0, CAST(3 + s_suppkey % 6 AS INT) AS h, CAST(3 + s_suppkey * 3 % 8 AS INT) AS w FROM {supplier}"""
#: Values on a grid of 64 x 128 cells, from orders.
GRID = """SELECT CAST(o_orderkey % 64 AS INT) AS j, CAST(o_orderkey DIV 64 % 128 AS INT) AS i, CAST(floor(min(o_totalprice)) AS BIGINT) % 4000 - 1000 AS value FROM {orders} GROUP BY 1, 2"""
#: Ordered positions of users: each user's events are a route.
ROUTE = """SELECT user_id AS route, event_id, DAYNO(ts) AS day, ts,
  (event_id * 7919 % 36000) / 1e2 - 180 AS lon, (event_id * 104729 % 17000) / 1e2 - 85 AS lat, event_type AS name FROM {events}"""
