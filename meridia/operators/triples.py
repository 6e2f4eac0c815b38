"""Events out of a table of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.joins import closure


def instances(triples: DataFrame, cls: str) -> DataFrame:
    """s of triples(s, p, o) that are instances of a class or of any class below it."""
    below = closure(triples.where("p = 'subclass'").select(F.col("s").alias("child"), F.col("o").alias("parent")))
    names = below.where(F.col("ancestor") == cls).select(F.col("node").alias("o")).union(below.sparkSession.createDataFrame([(cls,)], "o string")).distinct()
    return triples.where("p = 'instance'").join(names, "o", "left_semi").select("s").distinct()


def article_counts(items: DataFrame, triples: DataFrame) -> DataFrame:
    """s, articles: distinct articles of each item, 0 for none."""
    got = triples.where("p = 'article'").groupBy("s").agg(F.count_distinct("o").alias("articles"))
    return items.join(got, "s", "left").select("s", F.coalesce("articles", F.lit(0)).alias("articles"))


def dated(triples: DataFrame, properties: list[str], ranks: list[str]) -> DataFrame:
    """s, prop, date, prec of the statements of each property that have a rank of the list; precision stands on the statement."""
    parts = [triples.where((F.col("p") == p) & F.col("rank").isin(ranks)).select("s", F.lit(p).alias("prop"), F.col("o").alias("date"), "prec") for p in properties]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def export(triples: DataFrame, classes: list[str], properties: list[str], lang: str) -> DataFrame:
    """cls, s, prop, date, prec, label, articles, parents of the instances of each class; least label of the language, all parents in order."""
    kept = dated(triples, properties, ["normal", "preferred"])
    label = triples.where((F.col("p") == "label") & (F.col("lang") == lang)).groupBy("s").agg(F.min("o").alias("label"))
    parents = triples.where("p = 'part_of'").groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("o")), ";").alias("parents"))
    out = None
    for c in classes:
        items = instances(triples, c)
        rows = article_counts(items, triples).join(kept, "s").join(label, "s", "left").join(parents, "s", "left").select(F.lit(c).alias("cls"), "s", "prop", "date", "prec", "label", "articles", "parents").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def absent_classes(classes: DataFrame, exported: DataFrame) -> DataFrame:
    """cls that the export has no row of."""
    return classes.select("cls").join(exported.select("cls"), "cls", "left_anti")
