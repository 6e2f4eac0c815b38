"""Files written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.plans import bind
from meridia.plans.event_queries import _INDEX, _PAGES, _REGION
from meridia.registry import SQL, query
from meridia.shared import join_bounded, scratch, stored
from meridia.sources import tables


def _path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/meridia/{name}-{uuid.uuid4().hex}"


@query("IO1", f"{bind.ctes(st=bind.STATEMENT)} SELECT cls, CASE WHEN qid > 0 THEN qid END AS qid, label, enwiki, prop, y, m, d, prec, round(lon, 2) AS lon, round(lat, 2) AS lat, editions FROM st WHERE prec >= 9")
def io_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as a tab-separated export and read again."""
    from meridia.functions import cal

    rows = bind.frame(spark, sf_dir, bind.STATEMENT)
    date = F.when(F.col("prec") >= 9, cal.iso(F.struct("y", "m", "d"))).otherwise("unknown")
    place = F.concat(F.lit("Point("), F.format_string("%.2f", "lon"), F.lit(" "), F.format_string("%.2f", "lat"), F.lit(")"))
    text = rows.select("cls", F.concat(F.lit("Q"), F.col("qid").cast("string")).alias("event"), "label", "enwiki", "prop", date.alias("date"), F.col("prec").cast("string").alias("prec"), F.when(F.col("lon").isNotNull(), place).alias("coord"), F.lit("").alias("place_coord"), F.col("editions").cast("string").alias("editions"), F.lit("").alias("parents"))
    tables.write_statements(text, path := _path(spark, "statements"))
    return tables.read_statements(spark, path)


@query("IO3", "SELECT o_custkey % 24 AS page, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def io_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by page and summed from the pages."""
    rows = bind.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 24).alias("page"), "o_orderkey", "o_totalprice")
    tables.write_partitioned(rows, path := _path(spark, "pages"), "page")
    return spark.read.parquet(path).groupBy(F.col("page").cast("long").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("IO4", "SELECT s_suppkey AS fid, s_name AS name, idx, (s_suppkey % 90) + x AS lon, (s_suppkey % 45) + y AS lat FROM supplier, (VALUES (0, 0.0, 0.0), (1, 3.0, 0.0), (2, 3.0, 2.0), (3, 0.0, 0.0)) AS v(idx, x, y)")
def io_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons written as GeoJSON and read as vertices."""
    lon, lat = (F.col("s_suppkey") % 90).cast("double"), (F.col("s_suppkey") % 45).cast("double")
    ring = F.array(*[F.array(lon + x, lat + y) for x, y in ((0, 0), (3, 0), (3, 2), (0, 0))])
    feature = F.struct(F.struct(F.col("s_suppkey").alias("fid"), F.col("s_name").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    rows = bind.table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))
    rows.write.text(path := _path(spark, "features"))
    return tables.read_features(spark, path).select("fid", "name", "idx", "lon", "lat")


_POLITIES = """SELECT s_suppkey AS fid, CASE WHEN s_suppkey % 9 = 4 THEN ' (Union ' || CAST(s_suppkey % 5 AS STRING) || ')' ELSE s_name END AS name, CAST(s_suppkey * 37 % 5000 - 3400 AS BIGINT) AS y0, CAST(s_suppkey * 37 % 5000 - 3400 + s_suppkey % 90 AS BIGINT) AS y1,
CASE WHEN s_suppkey % 9 = 5 THEN 'RELATION' ELSE 'POLITY' END AS type, CASE WHEN s_suppkey % 3 > 0 THEN 'Q' || CAST(s_suppkey AS STRING) END AS wikidata, CASE WHEN s_suppkey % 9 = 4 THEN ' A' || CAST(s_suppkey % 7 AS STRING) || ';; B ' END AS components, CASE WHEN s_suppkey % 4 = 0 THEN '(Union 1); (Union 2)' ELSE '' END AS member_of, CAST(s_suppkey % 90 AS DOUBLE) AS x, CAST(s_suppkey % 45 AS DOUBLE) AS y FROM {supplier}"""


@query("IO4", f"""{bind.ctes(p=_POLITIES)}, v AS (SELECT * FROM (VALUES (0, 0, 0, 0.0, 0.0), (0, 0, 1, 3.0, 0.0), (0, 0, 2, 3.0, 2.0), (0, 0, 3, 0.0, 0.0), (1, 0, 0, 10.0, 0.0), (1, 0, 1, 14.0, 0.0), (1, 0, 2, 14.0, 4.0), (1, 0, 3, 10.0, 0.0), (1, 1, 0, 12.0, 0.5), (1, 1, 1, 13.0, 0.5), (1, 1, 2, 13.0, 1.0), (1, 1, 3, 12.0, 0.5)) AS v(part, ring, idx, dx, dy))
SELECT fid, trim(name) AS name, CASE WHEN y0 < 0 THEN y0 + 1 ELSE y0 END AS first, CASE WHEN y1 < 0 THEN y1 + 1 ELSE y1 END AS last, type = 'POLITY' AS polity, coalesce(wikidata, '') AS wikidata, CASE WHEN components IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['A' || fid % 7, 'B'] END AS components,
CASE WHEN member_of = '' THEN CAST([] AS VARCHAR[]) ELSE ['(Union 1)', '(Union 2)'] END AS member_of, part, ring, idx, x + dx AS lon, y + dy AS lat FROM p, v WHERE part = 0 OR fid % 2 = 1""")
def io_polities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated polities of one or more polygons, with their links, written as GeoJSON and read as rows and vertices."""
    rows = bind.frame(spark, sf_dir, _POLITIES)
    ring = lambda *at: F.array(*[F.array(F.col("x") + a, F.col("y") + b) for a, b in at])
    one = F.array(ring((0, 0), (3, 0), (3, 2), (0, 0)))
    two = F.array(ring((10, 0), (14, 0), (14, 4), (10, 0)), ring((12, 0.5), (13, 0.5), (13, 1), (12, 0.5)))
    properties = F.struct("fid", F.col("name").alias("Name"), F.col("y0").alias("FromYear"), F.col("y1").alias("ToYear"), F.lit(1.5).alias("Area"), F.col("type").alias("Type"), F.col("wikidata").alias("Wikidata"), F.col("components").alias("Components"), F.col("member_of").alias("MemberOf"))
    text = lambda kind, coordinates: F.to_json(F.struct(F.array(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("features")))
    rows.select(F.when(F.col("fid") % 2 == 1, text("MultiPolygon", F.array(one, two))).otherwise(text("Polygon", one)).alias("value")).write.text(path := _path(spark, "polities"))
    read = stored(tables.read_polities(spark, path), "polities")
    return read.drop("parts").join(tables.ring_vertices(read), "fid")


_TRACKS = f"""{bind.ctes(r=bind.ROUTE)}, v AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY route) AS n, min(day) OVER (PARTITION BY route) AS epoch FROM r),
ft AS (SELECT DISTINCT route, CASE WHEN n < 2 THEN 'too few vertices' WHEN route % 11 = 2 THEN 'place' WHEN route % 11 = 3 THEN 'no date' WHEN route % 11 = 0 THEN 'backward' WHEN route % 11 = 1 THEN 'legs' WHEN route % 11 = 4 THEN 'leg' END AS fault FROM v)"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of the users' routes, written as GeoJSON, some with a fault, and read again."""
    from meridia.functions import cal
    from meridia.operators import routes

    bad = F.col("route") % 11
    point = F.struct("ts", "event_id", "lon", "lat", cal.iso(cal.gregorian_civil("day")).alias("date"), "name")
    rows = bind.frame(spark, sf_dir, bind.ROUTE).groupBy("route").agg(F.array_sort(F.collect_list(point)).alias("v")).withColumn("n", F.size("v"))
    first = lambda good, other, when: F.when((when) & (F.col("n") > 0), F.concat(F.array(other), F.slice(good, 2, F.col("n")))).otherwise(good)
    places = F.transform("v", lambda p: F.array(p["lon"], p["lat"]))
    dates = F.transform("v", lambda p: p["date"])
    leg = lambda k: F.struct(k.alias("from"), (k + F.when(bad == 4, 2).otherwise(1)).alias("to"), (k % 3 == 0).alias("uncertain"), (k % 2 == 1).alias("sea"))
    count = F.col("n") - 1 - F.when(bad == 1, 1).otherwise(0)
    legs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), leg)).otherwise(F.array().cast("array<struct<from:int,to:int,uncertain:boolean,sea:boolean>>"))
    properties = F.struct(
        F.col("route").alias("fid"), F.lit("route").alias("kind"), F.get(dates, F.lit(0)).alias("epoch"),
        first(first(dates, F.lit("9999-01-01"), bad == 0), F.lit("soon"), bad == 3).alias("dates"), legs.alias("legs"), F.transform("v", lambda p: F.struct(p["name"].alias("name"))).alias("vertices"),
    )
    geometry = F.struct(F.lit("LineString").alias("type"), first(places, F.array(F.lit(200.0), F.lit(0.0)), bad == 2).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    rows.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(path := _path(spark, "routes"))
    return routes.route_rows(tables.read_routes(spark, path))


@query("IO8", f"{_TRACKS} SELECT v.route, CAST(idx AS INT) AS idx, lon, lat, day - epoch AS day, name, CASE WHEN least(idx, n - 2) % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN least(idx, n - 2) % 2 = 1 THEN 2 ELSE 0 END AS flags FROM v JOIN ft USING (route) WHERE fault IS NULL")
def io_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the routes without a fault, with days from their epoch and the flags of their legs."""
    from meridia.operators import routes
    from meridia.shared import join_bounded

    tracks = stored(_tracks(spark, sf_dir), "tracks")
    good = join_bounded(tracks, routes.route_faults(tracks).select("fid"), ["fid"], "left_anti")
    return routes.route_vertices(good)


@query("IO8", f"{_TRACKS} SELECT route AS fid, fault FROM ft WHERE fault IS NOT NULL")
def io_route_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each refused route."""
    from meridia.operators import routes

    return routes.route_faults(_tracks(spark, sf_dir))


@query("IO2", f"{_INDEX} SELECT * FROM ix")
def io_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event index written to its table and read again."""
    from meridia.plans.event_queries import _index

    tables.write_events(_index(spark, sf_dir), path := _path(spark, "events"))
    return tables.read_events(spark, path)


@query("IO6", SQL["grid_quantised"].replace("SELECT frame, cell, CAST(CASE", "SELECT 'temperature' AS variable, CAST(frame // 100 AS INT) AS year, frame, cell, CAST(CASE"))
def io_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly frames as codes, written by variable and year and read again."""
    from meridia.plans.grid_queries import grid_quantised

    frames = grid_quantised(spark, sf_dir).withColumn("variable", F.lit("temperature")).withColumn("year", F.floor(F.col("frame") / 100).cast("int"))
    tables.write_partitioned(frames, path := _path(spark, "climate"), "variable", "year")
    return spark.read.schema(frames.schema).parquet(path)


@query("IO3", f"""{_PAGES}, g AS (SELECT *, {_REGION} AS region FROM rw), n AS (SELECT *, row_number() OVER (PARTITION BY era, region ORDER BY "row") AS n FROM g), q AS (SELECT qid, "row" FROM n WHERE n <= 3),
f AS (SELECT qid, "row" FROM n WHERE n > 3 ORDER BY "row" LIMIT greatest(0, 300 - (SELECT count(*) FROM q))), o AS (SELECT * FROM q UNION ALL SELECT * FROM f),
al AS (SELECT page, qid, "row" FROM pg WHERE qid NOT IN (SELECT qid FROM o) UNION ALL SELECT 'overview', qid, "row" FROM o)
SELECT page, count(*) AS row_count, min("row") AS first_row, max("row") AS last_row, CAST(sum(qid) AS BIGINT) AS ids FROM al GROUP BY page""")
def io_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview and the era pages of the rest written by page, and what each page's files hold."""
    from meridia.operators import events
    from meridia.plans.event_queries import _paged

    rows = stored(_paged(spark, sf_dir).select("page", "qid", "row", "era", F.when(F.col("lon") < 0, "west").otherwise("east").alias("region")), "paged")
    chosen = stored(events.overview(rows.drop("page").distinct(), 3, 300), "overview")
    pages = rows.join(chosen.select("qid"), "qid", "left_anti").select("page", "qid", "row").unionByName(chosen.select(F.lit("overview").alias("page"), "qid", "row"))
    tables.write_partitioned(pages, path := _path(spark, "pages"), "page")
    return spark.read.parquet(path).groupBy("page").agg(F.count(F.lit(1)).alias("row_count"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.sum("qid").alias("ids"))


def fingerprint_sql(rows: str, by: str) -> str:
    """DuckDB SQL of sources.tables.fingerprint() of rows(by, s), s the rows' digests: by, rows, sha."""
    level = f"SELECT {by}, s AS b, s, 1 AS n FROM {rows}"
    for digits, line in ((6, "s"), (4, "b || ' ' || s"), (2, "b || ' ' || s"), (0, "b || ' ' || s")):
        level = f"SELECT {by}, substr(b, 1, {digits}) AS b, sha256(string_agg({line}, chr(10) ORDER BY {line})) AS s, sum(n) AS n FROM ({level}) GROUP BY {by}, substr(b, 1, {digits})"
    return f'SELECT {by}, CAST(n AS BIGINT) AS "rows", s AS sha FROM ({level})'


_ORDER_ROWS = "r AS (SELECT o_custkey % 7 AS part, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\"}') AS s FROM orders)"


@query("AG20", f"WITH {_ORDER_ROWS} " + fingerprint_sql("r", "part"))
def io_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of seven parts of the orders."""
    return tables.fingerprint(bind.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("part"), "o_orderkey", "o_orderpriority"), ["part"], ["o_orderkey", "o_orderpriority"])


@query("IO9 IO12", f"WITH {_ORDER_ROWS}, f AS ({fingerprint_sql('r', 'part')}), m AS (SELECT 'orders-' || part AS stage, substr(sha, 1, 8) AS version, \"rows\" FROM f), i AS (SELECT 0 AS one, sha256('{{\"stage\":\"' || stage || '\",\"version\":\"' || version || '\",\"rows\":' || \"rows\" || '}}') AS s FROM m), x AS ({fingerprint_sql('i', 'one')}) SELECT stage, version, m.\"rows\", substr(x.sha, 1, 16) AS release FROM m, x")
def io_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven parts of the orders published by version, twice, and read back: one manifest of all, with the digest that names the release."""
    rows = bind.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("part"), "o_orderkey", "o_orderpriority")
    root, made = _path(spark, "published"), []
    for k in range(7):  # the release's fixed parts
        part = rows.where(F.col("part") == k).select("o_orderkey", "o_orderpriority")
        version = tables.publish(part, f"{root}/orders-{k}", ["o_orderkey", "o_orderpriority"])
        if tables.publish(part, f"{root}/orders-{k}", ["o_orderkey", "o_orderpriority"]) != version:
            raise ValueError("equal rows have two versions")
        made.append(tables.manifest(spark, f"orders-{k}", version, f"{root}/orders-{k}"))
    return tables.release(made)


@query("AG20 IO9 IO12", "WITH r AS (SELECT n_regionkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS s FROM nation) " + fingerprint_sql("r", "n_regionkey"))
def io_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the nations of each region, which name their version."""
    return tables.fingerprint(bind.table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey", "n_name"])


@query("IO10", """WITH k AS (SELECT DISTINCT o_custkey % 5 AS k FROM orders) SELECT 'gone/' || k AS path, 'absent' AS fault FROM k UNION ALL
SELECT 'k=' || k, CASE k WHEN 0 THEN 'other size' WHEN 1 THEN 'other content' ELSE 'unpinned' END FROM k WHERE k < 3""")
def io_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a table against pins: some are pinned as they are, others absent, unpinned, of another size or content."""
    stored_ = bind.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("k"))
    tables.write_partitioned(stored_, path := _path(spark, "files"), "k")
    kept = lambda df: df.where(~F.col("path").rlike("(^|/)[._][^/]*$"))  # Spark's own marks
    k = F.regexp_extract("path", "k=([0-9])", 1)
    have = kept(tables.present(spark, path)).where(k != "2").select("path", (F.col("bytes") + F.when(k == "0", 1).otherwise(0)).alias("bytes"), F.when(k == "1", "").otherwise(F.col("sha256")).alias("sha256"))
    gone = stored_.select(F.concat(F.lit("gone/"), F.col("k").cast("string")).alias("path"), F.lit(1).cast("long").alias("bytes"), F.lit("").alias("sha256")).distinct()
    faults = kept(tables.audit_manifest(spark, stored(have.union(gone), "pins"), path))
    return faults.select(F.when(F.col("path").startswith("k="), F.substring_index("path", "/", 1)).otherwise(F.col("path")).alias("path"), "fault").distinct()


@query("ST5", "SELECT l.c_custkey AS key, CASE WHEN r.b IS NULL THEN 'upload' ELSE 'conflict' END AS action FROM (SELECT c_custkey, c_custkey % 97 AS b FROM customer) l LEFT JOIN (SELECT s_suppkey * 3 AS k, s_suppkey * 3 % 89 AS b FROM supplier) r ON r.k = l.c_custkey WHERE r.b IS NULL OR r.b <> l.b")
def io_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a remote listing lacks or has in another size."""
    local = bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 97).alias("bytes"))
    remote = bind.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("key"), (F.col("s_suppkey") * 3 % 89).alias("bytes"))
    return tables.sync_plan(local, remote)


@query("IN1 VQ2", "SELECT o_custkey AS job, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))) AS key FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) GROUP BY 1")
def io_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose content key is not that of an earlier run: those with an order that the earlier table lacked."""
    orders = bind.table(spark, sf_dir, "orders")
    keys = lambda df: df.groupBy(F.col("o_custkey").alias("job")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), ","), 256).alias("key"))
    return keys(orders).join(keys(orders.where("o_orderkey % 10 <> 0")), ["job", "key"], "left_anti")


@query("IO11 VQ12", f"{bind.ctes(c=bind.EVENT_CLASS)} SELECT cls, weight, within FROM c WHERE cls IN (SELECT o_orderpriority FROM orders)")
def io_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured classes that the data holds; the configuration is checked first."""
    from meridia.operators.audits import config_faults

    classes = bind.frame(spark, sf_dir, bind.EVENT_CLASS)
    if not config_faults(classes).isEmpty():
        raise ValueError("the class list is faulty")
    used = bind.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cls")).distinct()
    return join_bounded(used, classes, ["cls"], "inner").select("cls", "weight", "within")
