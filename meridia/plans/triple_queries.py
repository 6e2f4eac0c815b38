"""Triples of nations, regions, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import triples
from meridia.plans import bind
from meridia.registry import query

TRIPLE = """SELECT 'n' || CAST(n_nationkey AS STRING) AS s, 'subclass' AS p, CASE WHEN n_nationkey % 4 = 3 THEN 'n' || CAST(n_nationkey - 1 AS STRING) ELSE 'r' || CAST(n_regionkey AS STRING) END AS o, CAST(NULL AS STRING) AS lang, CAST(NULL AS STRING) AS rank, CAST(NULL AS INT) AS prec FROM {nation}
UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'subclass', 'top', NULL, NULL, NULL FROM {region}
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'instance', 'n' || CAST(c_nationkey AS STRING), NULL, NULL, NULL FROM {customer}
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'label', c_name, CASE WHEN c_custkey % 3 = 0 THEN 'fr' ELSE 'en' END, NULL, NULL FROM {customer}
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'part_of', 'c' || CAST(c_custkey DIV 5 AS STRING), NULL, NULL, NULL FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'article', o_orderpriority, NULL, NULL, NULL FROM {orders}
UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), CASE o_orderkey % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'start' ELSE 'end' END, 'd' || CAST(o_orderkey % 700 AS STRING), NULL, CASE o_orderkey % 5 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'preferred' ELSE 'normal' END, CAST(9 + o_orderkey % 3 AS INT) FROM {orders}"""
_T = f"""WITH RECURSIVE t AS ({bind.duck(TRIPLE)}), sub(c) AS (SELECT 'r1' UNION SELECT s FROM t JOIN sub ON p = 'subclass' AND o = c), it AS (SELECT DISTINCT s FROM t WHERE p = 'instance' AND o IN (SELECT c FROM sub))"""


@query("TP1 TP2", f"{_T} SELECT it.s, count(DISTINCT o) AS articles FROM it LEFT JOIN t ON t.s = it.s AND p = 'article' GROUP BY it.s")
def triple_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of a class and those below it, with their articles."""
    t = bind.frame(spark, sf_dir, TRIPLE)
    return triples.article_counts(triples.instances(t, "r1"), t)


@query("TP3 TP4 TP5 TP6", f"""{_T}, d AS (SELECT s, p AS prop, o AS date, prec FROM t WHERE p IN ('point', 'start', 'end') AND rank <> 'deprecated')
SELECT DISTINCT 'r1' AS cls, it.s, prop, date, prec, (SELECT min(o) FROM t x WHERE x.s = it.s AND x.p = 'label' AND x.lang = 'en') AS label, (SELECT count(DISTINCT o) FROM t x WHERE x.s = it.s AND x.p = 'article') AS articles, (SELECT string_agg(DISTINCT o, ';' ORDER BY o) FROM t x WHERE x.s = it.s AND x.p = 'part_of') AS parents FROM it JOIN d ON d.s = it.s""")
def triple_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated statements of a class's instances with label, articles and parents."""
    return triples.export(bind.frame(spark, sf_dir, TRIPLE), ["r1"], ["point", "start", "end"], "en")


@query("TP7", f"{bind.ctes(t=TRIPLE)} SELECT o AS cls, count(*) AS instances, count(*) > 60 AS large FROM t WHERE p = 'instance' GROUP BY o UNION ALL SELECT 'r9', 0, false")
def triple_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of each class; a configured class that the export lacks has none."""
    t = bind.frame(spark, sf_dir, TRIPLE).where("p = 'instance'").select(F.col("o").alias("cls"))
    listed = t.distinct().union(spark.createDataFrame([("r9",)], "cls string"))
    gone = triples.absent_classes(listed, t).select("cls", F.lit(0).cast("long").alias("instances"))
    return t.groupBy("cls").agg(F.count(F.lit(1)).alias("instances")).unionByName(gone).withColumn("large", F.col("instances") > 60)
