"""The engine's operators on the star-schema tables.

Rows become elements or whole documents and go through the engine's own
functions; each query has the same result in SQL beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.functions import geometry as G
from mapweave.functions.rules import is_area
from mapweave.functions.text import merged, without_keys
from mapweave.api import to_collections, to_features
from mapweave.operators import registry as R
from mapweave.operators.features import to_features as features_of
from mapweave.operators.relations import expand, own_parts
from mapweave.operators.stitch import stitched
from mapweave.options import Options
from mapweave.schema import ELEMENT
from mapweave.sources.detect import detect_format
from mapweave.sources.documents import to_elements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def long(c: Column) -> Column:
    return c.cast("long")


@query("""
    SELECT kind, format, count(*) AS n FROM (
        SELECT kind, CASE WHEN contains(t, '<osm') THEN 'xml' WHEN starts_with(regexp_replace(t, '^\\s+', ''), '{') THEN 'json' ELSE 'invalid' END AS format
        FROM (SELECT 'event' AS kind, props AS t FROM events UNION ALL SELECT 'document', text FROM documents UNION ALL SELECT 'page', html FROM pages)
    ) GROUP BY kind, format""")
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [table(spark, sf_dir, t, c).select(F.lit(k).alias("kind"), F.col(c).alias("t")) for k, t, c in (("event", "events", "props"), ("document", "documents", "text"), ("page", "pages", "html"))]
    every = texts[0].unionByName(texts[1]).unionByName(texts[2])
    return every.groupBy("kind", detect_format(F.coalesce("t", F.lit(""))).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT event_id, k, v FROM (
        SELECT event_id, 'user' AS k, CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT event_id, 'type', event_type FROM events UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events
    ) WHERE k NOT IN ('user', 'absent')""")
def purge_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    props = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return rows.select("event_id", F.explode(without_keys(props, F.array(F.lit("user"), F.lit("absent")))).alias("k", "v"))


@query("""
    SELECT event_id, k, v FROM (
        SELECT event_id, 'type' AS k, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE event_type END AS v FROM events
        UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events
        UNION ALL SELECT event_id, 'parity', 'even' FROM events WHERE user_id % 2 = 0)""")
def merge_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    own = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    over = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("type"), F.lit("even"), F.lit("parity"), F.lit("even"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("event_id", own.alias("own"), over.alias("over")).select("event_id", F.explode(merged(F.col("own"), F.col("over"))).alias("k", "v"))


_SKIP = """
    WITH e AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'way' WHEN p_size % 3 = 1 THEN 'node' ELSE 'relation' END AS type, p_partkey % 2 = 0 AS tagged,
                      EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS referenced FROM part)
    SELECT p_partkey AS part_key, type FROM e WHERE """


def _skip_filter(spark: SparkSession, sf_dir: str, options: Options) -> DataFrame:
    refs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.lit(True).alias("hit"))
    kind = F.when(F.col("p_size") % 3 == 0, "way").when(F.col("p_size") % 3 == 1, "node").otherwise("relation")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size").join(refs, "p_partkey", "left")
    rows = parts.select("p_partkey", kind.alias("type"), (F.col("p_partkey") % 2 == 0).alias("tagged"), F.coalesce("hit", F.lit(False)).alias("referenced"))
    return rows.where(R.is_kept(options)).select(F.col("p_partkey").alias("part_key"), "type")


@query(_SKIP + "NOT referenced")
def skip_filter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skip_filter(spark, sf_dir, Options())


@query(_SKIP + "NOT referenced OR (tagged AND type <> 'way')")
def skip_filter_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skip_filter(spark, sf_dir, Options(tagged=True))


@query(_SKIP + "NOT referenced OR tagged")
def skip_filter_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skip_filter(spark, sf_dir, Options(tagged=True, exclude_ways=False))


_KEYS = ("building", "highway", "natural", "name", "man_made", "waterway")
_VALUES = ("services", "cliff", "yes", "dam", "pipeline")


@query("""
    WITH t AS (
        SELECT p_partkey, i, ['building', 'highway', 'natural', 'name', 'man_made', 'waterway'][1 + (p_partkey * (i + 1) + p_size) % 6] AS k,
               ['services', 'cliff', 'yes', 'dam', 'pipeline'][1 + (p_partkey + i * p_size) % 5] AS v
        FROM part, (SELECT unnest([0, 1, 2]) AS i)),
    r AS (
        SELECT p_partkey, i, CASE k WHEN 'building' THEN true WHEN 'highway' THEN v IN ('services', 'rest_area', 'escape', 'elevator')
            WHEN 'waterway' THEN v IN ('riverbank', 'dock', 'boatyard', 'dam') WHEN 'natural' THEN v NOT IN ('coastline', 'cliff', 'ridge', 'arete', 'tree_row')
            WHEN 'man_made' THEN v NOT IN ('cutline', 'embankment', 'pipeline') END AS verdict FROM t)
    SELECT p_partkey AS part_key, coalesce(arg_max(verdict, i) FILTER (WHERE verdict IS NOT NULL), false) AS area FROM r GROUP BY p_partkey""")
def polygon_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    keys, values = F.array(*map(F.lit, _KEYS)), F.array(*map(F.lit, _VALUES))
    tags = F.array(*(F.struct(F.get(keys, ((key * (i + 1) + size) % 6).cast("int")).alias("k"), F.get(values, ((key + i * size) % 5).cast("int")).alias("v")) for i in range(3)))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(key.alias("part_key"), is_area(tags).alias("area"))


_RINGS = """
    WITH p AS (
        SELECT l_orderkey AS k, list([CAST(l_partkey % 50 AS DOUBLE), CAST(l_suppkey % 50 AS DOUBLE)] ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT k, CASE WHEN k % 4 > 0 THEN list_append(a, a[1]) ELSE a END AS a FROM p),
    q AS (SELECT k, a, len(a) AS n, len(a) > 3 AND a[1] = a[len(a)] AS ring FROM r) """
_TURN = """,
    m AS (SELECT k, a, n, list_sort(list_transform(range(1, n + 1), lambda i: {'x': a[i][1], 'i': i}))[-1].i AS m FROM q WHERE ring),
    s AS (SELECT k, a, a[CASE WHEN m = 1 THEN n - 1 ELSE m - 1 END] AS l, a[m] AS c, a[CASE WHEN m = n THEN 2 ELSE m + 1 END] AS r FROM m),
    d AS (SELECT k, a, (c[1] - l[1]) * (r[2] - l[2]) - (r[1] - l[1]) * (c[2] - l[2]) < 0 AS clockwise FROM s) """


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = items.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("p"))
    lines = lines.select("order_key", F.transform("p", lambda p: F.array((p["l_partkey"] % 50).cast("double"), (p["l_suppkey"] % 50).cast("double"))).alias("a"))
    return lines.select("order_key", F.when(F.col("order_key") % 4 > 0, F.concat("a", F.array(F.get("a", 0)))).otherwise(F.col("a")).alias("a"))


@query(_RINGS + "SELECT k AS order_key, ring FROM q")
def ring_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("order_key", G.is_ring(F.col("a")).alias("ring"))


@query(_RINGS + _TURN + "SELECT k AS order_key, clockwise FROM d")
def ring_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).where(G.is_ring(F.col("a"))).select("order_key", G.is_clockwise(F.col("a")).alias("clockwise"))


@query(_RINGS + _TURN + """SELECT k AS order_key, array_to_string(list_transform(CASE WHEN clockwise THEN list_reverse(a) ELSE a END, lambda p: CAST(CAST(p[1] AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(p[2] AS BIGINT) AS VARCHAR)), ',') AS ring FROM d""")
def orient_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = _rings(spark, sf_dir).where(G.is_ring(F.col("a"))).select("order_key", G.oriented(F.col("a"), False).alias("a"))
    text = F.array_join(F.transform("a", lambda p: F.concat_ws(" ", F.get(p, 0).cast("long").cast("string"), F.get(p, 1).cast("long").cast("string"))), ",")
    return rings.select("order_key", text.alias("ring"))


_AREAS = (
    [[-0.1, -0.1], [0.1, -0.1], [0.1, 0.1], [-0.1, 0.1], [-0.1, -0.1]],
    [[0.0, -0.3], [0.3, 0.0], [0.0, 0.3], [-0.3, 0.0], [0.0, -0.3]],
    [[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0], [-1.0, -1.0]],
)
_INSIDE = (
    "WITH a AS (SELECT unnest([1, 2, 3]) AS area, unnest(CAST('" + str([list(r) for r in _AREAS]) + "' AS DOUBLE[][][])) AS r), "
    "e AS (SELECT area, r[i] AS q, r[CASE WHEN i = 1 THEN len(r) ELSE i - 1 END] AS p FROM a, unnest(range(1, len(r) + 1)) AS t(i)), "
    "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), "
    "h AS (SELECT vec_id, area, count(*) FILTER (WHERE ((q[1] <= x AND x < p[1]) OR (p[1] <= x AND x < q[1])) AND y < (p[2] - q[2]) * (x - q[1]) / (p[1] - q[1]) + q[2]) % 2 = 1 AS inside FROM v, e GROUP BY vec_id, area) "
)


def _areas() -> Column:
    return F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in p)) for p in ring)) for ring in _AREAS))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.array(F.get("embedding", 0).cast("double"), F.get("embedding", 1).cast("double")).alias("p"))


@query(_INSIDE + "SELECT vec_id, area, inside FROM h")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _vectors(spark, sf_dir).select("vec_id", "p", F.posexplode(_areas()).alias("i", "ring"))
    return each.select("vec_id", (F.col("i") + 1).alias("area"), G.contains(F.col("ring"), F.col("p")).alias("inside"))


@query(_INSIDE + "SELECT vec_id, coalesce(min(area) FILTER (WHERE inside), 0) AS area FROM h GROUP BY vec_id")
def assign_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _vectors(spark, sf_dir).select("vec_id", F.transform(_areas(), lambda ring: G.contains(ring, F.col("p"))).alias("hits"))
    return hits.select("vec_id", F.array_position("hits", F.lit(True)).cast("int").alias("area"))


@query("SELECT p_partkey AS part_key, TRY_CAST(regexp_extract(p_size || '.' || p_partkey || 'e' || p_brand, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) AS number FROM part")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    text = F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.lit("e"), "p_brand")
    return rows.select(F.col("p_partkey").alias("part_key"), G.parse_float(text).alias("number"))


@query("""
    SELECT 'order/' || l_orderkey AS doc_id, 'way/1' AS id,
           '{"type":"LineString","coordinates":[' || string_agg('[' || l_partkey % 90 || '.0,' || l_suppkey % 90 || '.0]', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']}' AS geometry
    FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def convert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a JSON document of nodes and one way through them, converted by the whole engine."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    row = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    node = F.struct(F.lit("node").alias("type"), F.col("n").alias("id"), (F.col("l_partkey") % 90).alias("lon"), (F.col("l_suppkey") % 90).alias("lat"))
    grouped = items.withColumn("n", F.row_number().over(row)).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", node.alias("node")))).alias("all"))
    way = F.to_json(F.struct(F.lit("way").alias("type"), F.lit(1).alias("id"), F.transform("all", lambda x: x["n"]).alias("nodes")))
    payload = F.concat(F.lit('{"elements":['), way, F.lit(","), F.array_join(F.transform("all", lambda x: F.to_json(x["node"])), ","), F.lit("]}"))
    documents = grouped.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("doc_id"), payload.alias("payload"))
    return to_features(documents, {"completeFeature": True}).select("doc_id", "id", "geometry")


# Rows as elements


def element_rows(rows: DataFrame, **columns: str) -> DataFrame:
    """Elements of one document from SQL expressions over rows; what isn't named is null."""
    fields = T.StructType.fromDDL(ELEMENT).fields
    given = {"tagged": "false", "props": "map()", **columns}
    return rows.select(F.lit("d").alias("doc_id"), *(F.expr(given.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in fields))


POINT_AT = "named_struct('x', cast({x} AS double), 'y', cast({y} AS double), 'key', concat_ws(',', {x}, {y}))"


def late(ref: str) -> str:
    return f"named_struct('ref', cast({ref} AS string), 'at', null)"


def member(kind: str, ref: str, role: str) -> str:
    return f"named_struct('type', '{kind}', 'ref', cast({ref} AS string), 'role', {role}, 'inline', false, 'tagged', false, 'props', map(), 'at', null, 'vertices', null)"


@query("SELECT user_id, min(event_id) AS first_pos, max(event_id) AS last_pos, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def registry_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    nodes = element_rows(rows, pos="event_id", type="'node'", id="user_id", props="map('type', event_type)", at=POINT_AT.format(x="value", y="0"))
    won = R.registry(R.instances(nodes))
    return won.select(long(F.col("id")).alias("user_id"), F.col("ord.pos").alias("first_pos"), F.col("reg.pos").alias("last_pos"), F.col("props")["type"].alias("event_type"), F.col("at.x").alias("value"))


@query("""
    SELECT l_orderkey AS order_key, count(*) AS n_points,
           string_agg(p_size || ' ' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY l_orderkey""")
def late_bind_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a way through the nodes of its parts, in line order; parts that are absent drop out."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("p"))
    ways = element_rows(lines, pos="l_orderkey", type="'way'", id="l_orderkey", vertices=f"transform(p, x -> {late('x.l_partkey')})")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_size") <= 25).select("p_partkey", "p_size")
    nodes = element_rows(parts, pos="-p_partkey", type="'node'", id="p_partkey", at=POINT_AT.format(x="p_size", y="p_partkey"))
    every = R.instances(ways.unionByName(nodes))
    bound = R.bind_ways(every, R.registry(every))
    text = F.expr("array_join(transform(points, p -> concat_ws(' ', cast(p.x AS long), cast(p.y AS long))), ',')")
    return bound.select(F.col("reg.pos").alias("order_key"), long(F.size("points")).alias("n_points"), text.alias("line"))


def _referenced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes and large line items as ways that refer to them, with ``n`` and ``referenced``."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select("l_partkey")
    ways = element_rows(items, pos="monotonically_increasing_id()", type="'way'", id="'w'", vertices=f"array({late('l_partkey')})")
    nodes = element_rows(table(spark, sf_dir, "part", "p_partkey"), pos="-p_partkey", type="'node'", id="p_partkey")
    refs = R.references(R.instances(ways))
    won = R.registry(R.instances(nodes))
    return R.with_references(won, refs).join(refs, R.KEY, "left")


@query("SELECT p_partkey AS part_key, count(l_partkey) AS n FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey GROUP BY p_partkey")
def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _referenced_parts(spark, sf_dir).select(long(F.col("id")).alias("part_key"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT p_partkey AS part_key FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _referenced_parts(spark, sf_dir).where(R.is_kept(Options())).select(long(F.col("id")).alias("part_key"))


@query("""
    WITH RECURSIVE edges AS (
        SELECT 'r' || n_regionkey AS above, 'n' || n_nationkey AS below FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    tree AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region
             UNION ALL SELECT root, below, depth + 1 FROM tree JOIN edges ON above = id)
    SELECT root, id, CAST(depth AS BIGINT) AS depth FROM tree""")
def relation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as relations; the regions with all that lie below them."""
    relations = None
    for name, own, up, letter, above in (("region", "r_regionkey", None, "r", None), ("nation", "n_nationkey", "n_regionkey", "n", "r"), ("customer", "c_custkey", "c_nationkey", "c", "n"), ("supplier", "s_suppkey", "s_nationkey", "s", "n")):
        one = F.concat(F.lit(letter), F.col(own).cast("string")).alias("id")
        rows = table(spark, sf_dir, name, own, *([up] if up else [])).select(one, (F.concat(F.lit(above), F.col(up).cast("string")) if up else F.lit(None).cast("string")).alias("above"))
        relations = rows if relations is None else relations.unionByName(rows)
    under = relations.where("above is not null").groupBy(F.col("above").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("below"))
    rows = relations.select("id").join(under, "id", "left")
    won = R.registry(R.instances(element_rows(rows, pos="xxhash64(id)", type="'relation'", id="id", members=f"transform(coalesce(below, array()), x -> {member('relation', 'x', repr(''))})")))
    found = expand(won.where("id like 'r%'"), won)
    return found.select("root", "id", long(F.size("path")).alias("depth"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as relations of their orders, which are ways if they are large; ways and roles of each."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    grouped = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("all"))
    role = "CASE x.o_orderstatus WHEN 'F' THEN 'outer' ELSE x.o_orderstatus END"
    relations = element_rows(grouped, pos="o_custkey", type="'relation'", id="o_custkey", members=f"transform(all, x -> {member('way', 'x.o_orderkey', role)})")
    here = f"array(named_struct('ref', null, 'at', {POINT_AT.format(x='o_orderkey', y='0')}))"
    ways = element_rows(orders.where("o_totalprice >= 100000"), pos="-o_orderkey", type="'way'", id="o_orderkey", vertices=here)
    every = R.instances(relations.unionByName(ways))
    won = R.registry(every)
    return own_parts(won, R.bind_ways(every, won)).select(long(F.col("id")).alias("cust_key"), "ways", "roles")


@query("SELECT o_custkey AS cust_key, bool_or(o_orderstatus = 'F') AS area, count(*) AS n_roles FROM orders GROUP BY o_custkey")
def role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("cust_key", F.array_contains("roles", "outer").alias("area"), long(F.size("roles")).alias("n_roles"))


@query("""
    WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'outer' ELSE o_orderstatus END AS role, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    w AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice >= 100000)
    SELECT w.o_custkey AS cust_key, o_orderkey AS order_key, role FROM w JOIN r ON w.o_custkey = r.o_custkey AND w.n = r.n""")
def role_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that don't exist leave the ways but not the roles."""
    paired = F.expr("inline(transform(ways, (w, i) -> named_struct('order_key', cast(w[0].x AS long), 'role', roles[i])))")
    return _members(spark, sf_dir).select("cust_key", paired)


@query("""
    SELECT l_orderkey AS order_key, count(*) AS n_segments, string_agg(least(l_partkey % 7, l_suppkey % 7) || '-' || greatest(l_partkey % 7, l_suppkey % 7), ',' ORDER BY least(l_partkey % 7, l_suppkey % 7), greatest(l_partkey % 7, l_suppkey % 7)) AS segments
    FROM lineitem GROUP BY l_orderkey""")
def stitch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items as two-point lines, stitched in line order: no segment is lost, made up or doubled (the order is tested against a plain loop)."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    grouped = items.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("p"))
    ways = f"transform(p, x -> array({POINT_AT.format(x='x.l_partkey % 7', y='0')}, {POINT_AT.format(x='x.l_suppkey % 7', y='0')}))"
    part = F.expr(f"array(named_struct('path', cast(array() AS array<int>), 'ways', {ways}, 'roles', cast(array() AS array<string>)))")
    made = grouped.select("order_key", stitched(part, F.lit(False)).alias("s")).select("order_key", "s.line")
    steps = "flatten(transform(line, l -> transform(sequence(1, size(l) - 1), i -> struct(cast(least(l[i][0], l[i - 1][0]) AS long) AS a, cast(greatest(l[i][0], l[i - 1][0]) AS long) AS b))))"
    made = made.select("order_key", F.expr(f"sort_array({steps})").alias("steps"))
    return made.select("order_key", long(F.size("steps")).alias("n_segments"), F.expr("array_join(transform(steps, x -> concat_ws('-', x.a, x.b)), ',')").alias("segments"))


# Rows as documents

_POINTS = "WITH p AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey % 90 AS x, l_suppkey % 90 AS y FROM lineitem) "
_LINE = "string_agg('[' || x || '.0,' || y || '.0]', ',' ORDER BY n)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order of two items or more its doc_id and the array ``p`` of points (n, x, y)."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    grouped = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("i")).where(F.size("i") > 1)
    return grouped.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("doc_id"), F.expr("transform(i, (v, n) -> struct(n + 1 AS n, v.l_partkey % 90 AS x, v.l_suppkey % 90 AS y))").alias("p"))


def _documents(rows: DataFrame, *elements: str) -> DataFrame:
    """JSON documents from SQL for arrays of JSON texts."""
    return rows.select("doc_id", F.expr("concat('{\"elements\":[', array_join(concat(" + ", ".join(elements) + "), ','), ']}')").alias("payload"))


_NODES = "transform(p, v -> to_json(named_struct('type', 'node', 'id', v.n, 'lon', v.x, 'lat', v.y)))"
_WAYS = "transform(slice(p, 1, size(p) - 1), v -> to_json(named_struct('type', 'way', 'id', v.n, 'nodes', array(v.n, v.n + 1))))"
_OF_WAYS = "array(to_json(named_struct('type', 'relation', 'id', 1, 'members', transform(slice(p, 1, size(p) - 1), v -> named_struct('type', 'way', 'ref', v.n, 'role', '')))))"


@query(_POINTS + f"""SELECT 'order/' || k AS doc_id, 'relation/1' AS id, '{{"type":"MultiLineString","coordinates":[[' || {_LINE} || ']]}}' AS geometry FROM p GROUP BY k HAVING count(*) > 1""")
def convert_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from point to point, bound by nodes that come later and by a relation that comes first."""
    docs = _documents(_orders(spark, sf_dir), _OF_WAYS, _WAYS, _NODES)
    return to_features(docs, {"completeFeature": True}).select("doc_id", "id", "geometry")


@query(_POINTS + f"""SELECT 'order/' || k AS doc_id, '{{"type":"MultiLineString","coordinates":[[' || {_LINE} || ']]}}' AS geojson, CAST(NULL AS VARCHAR) AS error FROM p GROUP BY k HAVING count(*) > 1""")
def bare_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without options the first relation's geometry alone."""
    return to_collections(_documents(_orders(spark, sf_dir), _NODES, _WAYS, _OF_WAYS))


@query(_POINTS + f"""SELECT 'order/' || k AS doc_id, 'relation/2' AS id, '{{"type":"MultiLineString","coordinates":[[' || {_LINE} || ']]}}' AS geometry FROM p GROUP BY k HAVING count(*) > 1""")
def super_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = """array('{"type":"relation","id":2,"members":[{"type":"relation","ref":1,"role":""}]}')"""
    docs = _documents(_orders(spark, sf_dir), above, _OF_WAYS, _WAYS, _NODES)
    return to_features(docs, {"completeFeature": True}).select("doc_id", "id", "geometry")


@query(_POINTS + f""", g AS (SELECT k, '[' || {_LINE} || ']' AS line, min(n) AS least FROM p GROUP BY k HAVING count(*) > 1)
    SELECT 'order/' || k AS doc_id, 'relation/1' AS id, '{{"type":"MultiLineString","coordinates":[' || line || ']}}' AS geometry, '{{"id":"relation/1"}}' AS properties FROM g
    UNION ALL SELECT 'order/' || k, 'node/9', '{{"type":"Point","coordinates":[' || x + 1 || '.0,' || y + 1 || '.0]}}', '{{"id":"node/9","ref":9,"role":"label"}}' FROM p JOIN g USING (k) WHERE n = 1""")
def inline_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation whose members bring their own geometry."""
    way = "transform(slice(p, 1, size(p) - 1), v -> to_json(named_struct('type', 'way', 'ref', v.n, 'role', '', 'geometry', array(named_struct('lon', v.x, 'lat', v.y), named_struct('lon', p[v.n].x, 'lat', p[v.n].y)))))"
    node = "array(to_json(named_struct('type', 'node', 'ref', 9, 'role', 'label', 'lon', p[0].x + 1, 'lat', p[0].y + 1)))"
    relation = f"""array(concat('{{"type":"relation","id":1,"members":[', array_join(concat({way}, {node}), ','), ']}}'))"""
    return to_features(_documents(_orders(spark, sf_dir), relation), {"completeFeature": True}).select("doc_id", "id", "geometry", "properties")


@query(_POINTS + f""", k AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1)
    SELECT 'order/' || k AS doc_id, 'way/1' AS id, '{{"type":"LineString","coordinates":[' || {_LINE} || ']}}' AS geometry, '{{"id":"way/1","highway":"path"}}' AS properties FROM p JOIN k USING (k) GROUP BY k
    UNION ALL SELECT 'order/' || k, 'node/' || n, '{{"type":"Point","coordinates":[' || x || '.0,' || y || '.0]}}', '{{"id":"node/' || n || '","name":"n' || n || '"}}' FROM p JOIN k USING (k) WHERE n % 2 = 0""")
def tagged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referenced nodes show if they are tagged; so do referenced ways where they aren't left out."""
    nodes = "transform(p, v -> CASE WHEN v.n % 2 = 0 THEN to_json(named_struct('type', 'node', 'id', v.n, 'lon', v.x, 'lat', v.y, 'tags', map('name', concat('n', v.n)))) ELSE to_json(named_struct('type', 'node', 'id', v.n, 'lon', v.x, 'lat', v.y)) END)"
    way = "array(to_json(named_struct('type', 'way', 'id', 1, 'nodes', transform(p, v -> v.n), 'tags', map('highway', 'path'))), '{\"type\":\"relation\",\"id\":1,\"members\":[{\"type\":\"way\",\"ref\":1,\"role\":\"outer\"}]}')"
    docs = _documents(_orders(spark, sf_dir), nodes, way)
    made = to_features(docs, {"completeFeature": True, "renderTagged": True, "excludeWay": False})
    return made.where("not of_relation").select("doc_id", "id", "geometry", "properties")


_XML_POINTS = "transform(p, v -> concat('<node id=\"', v.n, '\" lat=\"', v.y, '\" lon=\"', v.x, '\"/>'))"


@query(_POINTS + f"""SELECT 'order/' || k AS doc_id, 'way/1' AS id, '{{"type":"LineString","coordinates":[' || {_LINE} || ']}}' AS geometry, '{{"id":"way/1","version":"' || count(*) || '","name":"A &#38; B"}}' AS properties
    FROM p GROUP BY k HAVING count(*) > 1""")
def convert_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and a tagged way as XML; its entities stay as they are."""
    refs = "array_join(transform(p, v -> concat('<nd ref=\"', v.n, '\"/>')), '')"
    text = f"""concat('<?xml version="1.0"?><osm>', array_join({_XML_POINTS}, ''), '<way id="1" version="', size(p), '">', {refs}, '<tag k="name" v="A &#38; B"/></way></osm>')"""
    docs = _orders(spark, sf_dir).select("doc_id", F.expr(text).alias("payload"))
    return to_features(docs, {"completeFeature": True}).select("doc_id", "id", "geometry", "properties")


@query(_POINTS + f"""SELECT 'order/' || k AS doc_id, 'relation/7' AS id, '{{"type":"MultiLineString","coordinates":[[' || {_LINE} || ']]}}' AS geometry,
    '{{"id":"relation/7","route":"bus"}}' AS properties, '[1.5,2.0,' || count(*) || '.0,4.0]' AS bbox FROM p GROUP BY k HAVING count(*) > 1""")
def xml_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, tags and members with vertices of their own, as XML."""
    vertex = "concat('<nd lon=\"', {0}.x, '\" lat=\"', {0}.y, '\"/>')"
    ways = f"""transform(slice(p, 1, size(p) - 1), v -> concat('<member type="way" ref="', v.n, '" role="">', {vertex.format("v")}, {vertex.format("p[v.n]")}, '</member>'))"""
    text = f"""concat('<osm><relation id="7"><bounds minlat="2" minlon="1.5" maxlat="4" maxlon="', size(p), '"/>', array_join({ways}, ''), '<tag k="route" v="bus"/></relation></osm>')"""
    docs = _orders(spark, sf_dir).select("doc_id", F.expr(text).alias("payload"))
    return to_features(docs, {"completeFeature": True}).select("doc_id", "id", "geometry", "properties", F.to_json("bbox").alias("bbox"))


@query("SELECT 'e' AS doc_id, event_id AS pos, CAST(user_id AS VARCHAR) AS id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS name, event_id % 2 = 0 AS tagged FROM events WHERE value <> 0")
def xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the nodes of XML documents, read back as elements."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props").where("value <> 0")
    # a small file is read by one task
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    tag = "CASE WHEN event_id % 2 = 0 THEN '><tag k=\"a\" v=\"b\"/></node>' ELSE '/>' END"
    text = F.expr(f"""concat('<osm><node id="', user_id, '" name="', event_type, '" lat="', get_json_object(props, '$.k'), '" lon="', value, '"', {tag}, '</osm>')""")
    docs = rows.select(F.col("event_id").cast("string").alias("doc_id"), text.alias("payload"))
    made = to_elements(docs)
    return made.select(F.lit("e").alias("doc_id"), long(F.col("doc_id")).alias("pos"), "id", "at.x", "at.y", F.get_json_object(F.col("props")["name"], "$").alias("name"), "tagged")


@query("SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS kind FROM events")
def json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the nodes of JSON documents, read back as elements."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    node = "array(to_json(named_struct('type', 'node', 'id', user_id, 'lon', value, 'lat', get_json_object(props, '$.k'), 'kind', event_type)))"
    made = to_elements(_documents(rows.withColumn("doc_id", F.col("event_id").cast("string")), node))
    return made.select(long(F.col("doc_id")).alias("pos"), "id", "at.x", "at.y", F.from_json(F.concat(F.lit('{"v":'), F.col("props")["kind"], F.lit("}")), "v string")["v"].alias("kind"))


@query("SELECT 'node/' || event_id AS id, 'Point' AS kind, value AS x, CAST(user_id AS DOUBLE) AS y FROM events")
def point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    nodes = element_rows(rows, pos="event_id", type="'node'", id="event_id", at=POINT_AT.format(x="value", y="user_id"))
    shape = F.from_json("geometry", "type string, coordinates array<double>")
    made = features_of(nodes, {"completeFeature": True, "byDocument": False}).select("id", shape.alias("g"))
    return made.select("id", F.col("g.type").alias("kind"), F.col("g.coordinates")[0].alias("x"), F.col("g.coordinates")[1].alias("y"))


@query("""
    WITH e AS (SELECT user_id, arg_min(event_id, event_id) FILTER (WHERE value > 50) AS first FROM events GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN first IS NULL THEN '{"type":"FeatureCollection","features":[]}' ELSE '{"type":"MultiLineString","coordinates":[[[' || first % 100 || '.0,0.0],[' || first % 100 || '.0,1.0]]]}' END AS geojson FROM e""")
def first_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as relations, some of them without a line."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "value").select("user_id", F.struct("event_id", (F.col("value") > 50).alias("line")).alias("event"))
    # numbers are dealt and not texts, to as many tasks as there may be: their bytes tell little of the work behind them
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    grouped = rows.groupBy("user_id").agg(F.sort_array(F.collect_list("event")).alias("all")).select(F.col("user_id").cast("string").alias("doc_id"), "all")
    line = "CASE WHEN x.line THEN array(named_struct('type', 'way', 'ref', 1, 'role', '', 'geometry', array(named_struct('lon', x.event_id % 100, 'lat', 0), named_struct('lon', x.event_id % 100, 'lat', 1)))) ELSE array() END"
    relations = f"transform(all, x -> to_json(named_struct('type', 'relation', 'id', x.event_id, 'members', {line})))"
    return to_collections(_documents(grouped, relations)).select("doc_id", "geojson")


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '{"type":"FeatureCollection","features":[' || coalesce(string_agg('{"type":"Feature","id":"node/' || o_orderkey || '","properties":{"id":"node/' || o_orderkey || '"},"geometry":{"type":"Point","coordinates":['
               || o_orderkey % 90 || '.0,' || o_custkey % 90 || '.0]}}', ',' ORDER BY o_orderkey), '') || ']}' AS geojson
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey GROUP BY c_custkey""")
def feature_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    node = F.expr("to_json(named_struct('type', 'node', 'id', o_orderkey, 'lon', o_orderkey % 90, 'lat', o_custkey % 90))")
    grouped = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", node.alias("json")))).alias("all"))
    rows = table(spark, sf_dir, "customer", "c_custkey").join(grouped, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("doc_id"), F.expr("coalesce(transform(all, x -> x.json), array())").alias("all"))
    return to_collections(_documents(rows, "all"), {"completeFeature": True}).select("doc_id", "geojson")


def _ring(*corners: tuple[str, str]) -> str:
    return "'[' || " + " || ',' || ".join(f"'[' || ({x}) || '.0,' || ({y}) || '.0]'" for x, y in corners) + " || ']'"


_OUTER = [("x", "0"), ("x + s", "0"), ("x + s", "s"), ("x", "s"), ("x", "0")]
_INNER = [("x + 1", "1"), ("x + 1", "2"), ("x + 2", "2"), ("x + 2", "1"), ("x + 1", "1")]


@query(f"""
    WITH a AS (SELECT p_partkey AS k, p_partkey % 50 AS x, p_size + 4 AS s FROM part),
    r AS (SELECT k, {_ring(*_OUTER)} AS outer_, {_ring(*_INNER)} AS inner_, {_ring(*((x + " + 200", y) for x, y in _OUTER))} AS other FROM a)
    SELECT 'part/' || k AS doc_id, 'relation/1' AS id, CASE WHEN k % 2 = 0 THEN '{{"type":"MultiPolygon","coordinates":[[' || outer_ || CASE WHEN k % 3 = 0 THEN '' ELSE ',' || inner_ END || '],[' || other || ']]}}'
           ELSE '{{"type":"Polygon","coordinates":[' || outer_ || CASE WHEN k % 3 = 0 THEN '' ELSE ',' || inner_ END || ']}}' END AS geometry FROM r""")
def polygons_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings the wrong way round; holes that lie in one of two areas, or in none."""

    def way(role: str, corners: list[tuple[str, str]], shift: str) -> str:
        places = ", ".join(f"named_struct('lon', {x} + {shift}, 'lat', {y})" for x, y in corners[::-1])
        return f"named_struct('type', 'way', 'ref', 1, 'role', '{role}', 'geometry', array({places}))"

    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("doc_id"), F.col("p_partkey").alias("k"), (F.col("p_partkey") % 50).alias("x"), (F.col("p_size") + 4).alias("s"))
    # a small file is read by one task
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = f"concat(array({way('outer', _OUTER, '0')}), CASE WHEN k % 2 = 0 THEN array({way('outer', _OUTER, '200')}) ELSE array() END, array({way('inner', _INNER, 'CASE WHEN k % 3 = 0 THEN 500 ELSE 0 END')}))"
    docs = _documents(rows, f"array(to_json(named_struct('type', 'relation', 'id', 1, 'members', {members})))")
    return to_features(docs, {"completeFeature": True}).select("doc_id", "id", "geometry")
