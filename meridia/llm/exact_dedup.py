"""Exact dedup with content-defined chunk recipes.

A text is cut where its content says so (after a sentence mark followed by white
space, within length bounds), so equal passages give equal chunks wherever they
stand. Chunks are deduplicated on their bytes; an identifier is verified when no
two different chunks share it, and identifiers that fail are told apart by an
ordinal. A document then is its ordered list of identifiers, some 8 % of the
length of a long text, and only these lists are grouped and joined. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import documents, kept_rows, stored

MIN_CHUNK, MAX_CHUNK = 512, 4096


def cut(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks; put together they are the text. Empty texts have none."""
    pattern = rf"(?s).{{{least},{most - 2}}}?[.!?;|]\s|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def digest(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def recipes(docs: DataFrame, identify: Callable[[Column], Column] = digest) -> DataFrame:
    """doc_id, text_sha256 and recipe, the ordered list of verified chunk identifiers, of each row of docs(doc_id, text)."""
    pieces = docs.select(F.explode(cut(F.col("text"))).alias("chunk"))
    dictionary = pieces.groupBy("chunk").agg(F.count(F.lit(1)).alias("uses")).select(identify(F.col("chunk")).alias("id"))
    shared = stored(dictionary.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("id"), "chunk-clashes")
    plain = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(cut(F.col("text")), identify).alias("ids"))
    if shared.isEmpty():
        return plain.select("doc_id", "text_sha256", F.concat_ws(" ", "ids").alias("recipe"))
    # Rare: different chunks with one identifier. Each content gets an ordinal below it. A recipe depends on the
    # text alone, so it is made once per distinct text (two digests and the length) and joined to the rows again.
    clashing = pieces.distinct().withColumn("id", identify(F.col("chunk"))).join(shared, "id", "left_semi")
    lesser = clashing.alias("a").join(clashing.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("b.chunk") < F.col("a.chunk")), "left")
    ordinal = lesser.groupBy(F.col("a.chunk").alias("chunk")).agg(F.count("b.chunk").alias("ordinal"))
    whole = [F.sha2("text", 256).alias("text_sha256"), F.md5("text").alias("md5"), F.length("text").alias("length")]
    keys = ["text_sha256", "md5", "length"]
    named = docs.select(*whole, F.posexplode(cut(F.col("text"))).alias("pos", "chunk"))
    named = named.join(ordinal, "chunk", "left").withColumn("id", F.concat_ws("#", identify(F.col("chunk")), F.col("ordinal").cast("string")))
    listed = stored(named.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("pos", "id"))).alias("l")).select(*keys, F.concat_ws(" ", F.col("l.id")).alias("recipe")), "clash-recipes")
    return docs.select("doc_id", *whole).join(listed, keys, "left").select("doc_id", "text_sha256", F.coalesce("recipe", F.lit("")).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column], Column] = digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, and empty texts are equal
    to each other. Of equal texts the largest doc_id stays. A null doc_id stays only
    where no row of its group has one; rows that repeat a doc_id are counted each and
    share its fate. Other columns are not looked at. An empty table gives no rows.
    """
    rows = stored(recipes(documents(docs, id_col, text_col), identify), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A third of all rows may have one recipe: joined with a stored table, Spark can split that key's rows over tasks.
    joined = rows.join(stored(groups, "groups"), "recipe", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, of each text: that with the largest doc_id.

    Null and empty texts are one text. Rows that share that doc_id and the text are one (kept_rows()
    says which stays); rows that repeat a doc_id with other texts are looked at by their own. A null doc_id stays
    only where no row of its text has one. An empty table gives no rows.
    """
    kept = exact_duplicates(docs, id_col, text_col).where("kept").groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.count(F.lit(1)).alias("times"))
    return kept_rows(docs, kept, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256), id_col, text_col)
