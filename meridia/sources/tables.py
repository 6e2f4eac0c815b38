"""Reading and writing the shapes of the library in files that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.shared import stored

STATEMENTS = "cls string, event string, label string, enwiki string, prop string, date string, prec string, coord string, place_coord string, editions string, parents string"


def write_statements(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; null is empty."""
    df.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a tab-separated export with their dates in ISO form, ids and places decoded; another header is refused, as is a row of other length."""
    from meridia.functions import cal, text

    raw = spark.read.schema(STATEMENTS).option("sep", "\t").option("header", True).option("enforceSchema", False).option("quote", "").option("mode", "FAILFAST").csv(path)
    rows = raw.withColumn("d", cal.parse_iso("date")).withColumn("p", text.point("coord")).where("d is not null")
    return rows.select("cls", text.item_number("event").alias("qid"), F.coalesce("label", F.lit("")).alias("label"), "enwiki", "prop", F.col("d.y").alias("y"), F.col("d.m").alias("m"), F.col("d.d").alias("d"), F.col("prec").cast("int").alias("prec"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.col("editions").cast("int").alias("editions"))


EVENTS = "qid long, label string, enwiki string, cls string, lon double, lat double, date long, prec int, t0 long, t1 long, editions int, score double, conflict boolean, parents array<long>"


def write_events(df: DataFrame, path: str) -> None:
    """The event index as Parquet in the columns EVENTS."""
    schema = df.sparkSession.createDataFrame([], EVENTS).schema
    df.select([F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event index; a table of other columns or types is refused."""
    df = spark.read.parquet(path)
    if [(f.name, f.dataType.simpleString()) for f in df.schema] != [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], EVENTS).schema]:
        raise ValueError(f"{path} is no event index: {df.schema.simpleString()}")
    return df


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet with a folder per value: pages of events, years of climate, chunks of names."""
    df.repartition(*by).write.partitionBy(*by).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """fid, name, ring, idx, lon, lat of the vertices of polygons in GeoJSON, one feature collection per line."""
    schema = "features array<struct<properties:struct<fid:bigint,name:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(F.explode("features").alias("f"))
    rings = rows.select("f.properties.fid", "f.properties.name", F.posexplode("f.geometry.coordinates").alias("ring", "r"))
    points = rings.select("fid", "name", "ring", F.posexplode("r").alias("idx", "p"))
    return points.select("fid", "name", "ring", "idx", F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"))


#: What a polity's feature has: properties as the source writes them, and a geometry that is looked at by its type.
_POLITY = """features array<struct<properties:struct<fid:bigint,Name:string,FromYear:bigint,ToYear:bigint,Type:string,Wikidata:string,Components:string,MemberOf:string>,geometry:string>>"""


def read_polities(spark: SparkSession, path: str) -> DataFrame:
    """fid, name, first, last, polity, wikidata, components, member_of, parts of dated polities in GeoJSON, one feature collection per line.

    Years are astronomical, lists are parted at semicolons, texts are trimmed and empty where they lack. parts holds rings of [lon, lat] points for each
    polygon: one for a Polygon, several for a MultiPolygon, none without a geometry; a geometry of another type is an error. A feature
    without `fid` bears its place in its collection, from 0.
    """
    from meridia.functions import cal
    from meridia.functions.text import split_list

    rows = spark.read.schema(_POLITY).option("mode", "FAILFAST").json(path).select(F.posexplode("features").alias("pos", "f")).select("pos", "f.properties.*", F.from_json("f.geometry", "type string, coordinates string", {"mode": "FAILFAST"}).alias("g"))
    rings = "array<array<array<double>>>"
    read = lambda t: F.from_json("g.coordinates", t, {"mode": "FAILFAST"})
    other = F.raise_error(F.concat(F.lit("a polity's geometry is a "), F.col("g.type"))).cast(f"array<{rings}>")
    parts = F.when(F.col("g.type").isNull(), F.array().cast(f"array<{rings}>")).when(F.col("g.type") == "Polygon", F.array(read(rings))).when(F.col("g.type") == "MultiPolygon", read(f"array<{rings}>")).otherwise(other)
    said = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.select(
        F.coalesce("fid", F.col("pos").cast("long")).alias("fid"),
        said("Name").alias("name"),
        cal.astronomical("FromYear").alias("first"),
        cal.astronomical("ToYear").alias("last"),
        (said("Type") == "POLITY").alias("polity"),
        said("Wikidata").alias("wikidata"),
        split_list(said("Components")).alias("components"),
        split_list(said("MemberOf")).alias("member_of"),
        parts.alias("parts"),
    )


def ring_vertices(rows: DataFrame) -> DataFrame:
    """fid, part, ring, idx, lon, lat of the vertices of rows(fid, parts)."""
    rings = rows.select("fid", F.posexplode("parts").alias("part", "p")).select("fid", "part", F.posexplode("p").alias("ring", "r"))
    return rings.select("fid", "part", "ring", F.posexplode("r").alias("idx", "v")).select("fid", "part", "ring", "idx", F.get("v", F.lit(0)).alias("lon"), F.get("v", F.lit(1)).alias("lat"))


_ROUTE = """features array<struct<properties:struct<fid:bigint,kind:string,epoch:string,dates:array<string>,legs:array<struct<`from`:bigint,`to`:bigint,uncertain:boolean,sea:boolean>>,vertices:array<struct<name:string>>>,geometry:struct<type:string,coordinates:array<array<double>>>>>"""


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """fid, kind, type, points, epoch, dates, legs, names of routes in GeoJSON, one feature collection per line, as they stand there."""
    f = spark.read.schema(_ROUTE).option("mode", "FAILFAST").json(path).select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.*")
    return f.select("fid", "kind", "type", F.col("coordinates").alias("points"), "epoch", "dates", "legs", F.transform("vertices", lambda v: v["name"]).alias("names"))


def chunked(rows: DataFrame, per: int) -> DataFrame:
    """rows(name, s0, s1) once per chunk of `per` steps that they meet, cut to it, with the number of the name in its chunk."""
    from pyspark.sql import Window

    out = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s0") / per), F.floor(F.col("s1") / per))))
    out = out.withColumn("s0", F.greatest("s0", F.col("chunk") * per)).withColumn("s1", F.least("s1", F.col("chunk") * per + per - 1))
    return out.withColumn("name_no", F.dense_rank().over(Window.partitionBy("chunk").orderBy("name")) - 1).select("name", "chunk", "s0", "s1", "name_no")


def fingerprint(rows: DataFrame, by: list[str], columns: list[str], digits: tuple[int, ...] = (6, 4, 2)) -> DataFrame:
    """by, rows, sha: a digest of a set of rows, whatever their order.

    Rows' digests are gathered by their first hexadecimal digits, the gathered digests by fewer, and so on: with six
    digits 16 million groups hold some 600 rows each of 10^10, and no later level gathers more than 256.
    """
    level = rows.select(*by, F.sha2(F.to_json(F.struct(*columns)), 256).alias("s"), F.lit(1).cast("long").alias("n")).withColumn("b", F.col("s"))
    for n in (*digits, 0):
        line = F.col("s") if n == digits[0] else F.concat_ws(" ", "b", "s")
        grouped = level.groupBy(*by, F.substring("b", 1, n).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("s"))
        level = grouped.withColumnRenamed("p", "b")
    return level.select(*by, F.col("n").alias("rows"), F.col("s").alias("sha"))


def publish(df: DataFrame, root: str, columns: list[str]) -> str:
    """Write a table to root/ver=<first eight digits of its digest> unless that version is there; the version."""
    sha = fingerprint(df, [], columns).select("sha").first()
    version = (sha["sha"] if sha else "00000000")[:8]
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ver={version}/_SUCCESS")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df.write.mode("errorifexists").parquet(f"{root}/ver={version}")
    return version


def manifest(spark: SparkSession, stage: str, version: str, root: str) -> DataFrame:
    """One row of a release's manifest: stage, version, and the rows that the published version holds."""
    return spark.read.parquet(f"{root}/ver={version}").agg(F.lit(stage).alias("stage"), F.lit(version).alias("version"), F.count(F.lit(1)).alias("rows"))


def release(parts: list[DataFrame]) -> DataFrame:
    """The union of manifests (stage, version, rows) with `release`, the first 16 digits of the digest of them all."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = stored(rows, "manifest")
    sha = fingerprint(rows.withColumn("one", F.lit(0)), ["one"], ["stage", "version", "rows"])
    return rows.crossJoin(F.broadcast(sha.select(F.substring("sha", 1, 16).alias("release"))))  # one row


def present(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), bytes, sha256 of all files under a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring_index("path", f"{full}/", -1)
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def audit_manifest(spark: SparkSession, pins: DataFrame, path: str) -> DataFrame:
    """path, fault of pins(path, bytes, sha256) against the files of a folder: absent, unpinned, other size, other content."""
    files = present(spark, path).select("path", F.col("bytes").alias("has"), F.col("sha256").alias("is"))
    both = pins.join(files, "path", "full")
    fault = F.when(F.col("is").isNull(), "absent").when(F.col("sha256").isNull(), "unpinned").when(F.col("has") != F.col("bytes"), "other size").when(F.col("is") != F.col("sha256"), "other content")
    return both.select("path", fault.alias("fault")).where("fault is not null")


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, action of local(key, bytes) against remote(key, bytes): upload what is missing, conflict where sizes differ."""
    both = local.join(remote.select("key", F.col("bytes").alias("there")), "key", "left")
    return both.select("key", F.when(F.col("there").isNull(), "upload").when(F.col("there") != F.col("bytes"), "conflict").alias("action")).where("action is not null")
