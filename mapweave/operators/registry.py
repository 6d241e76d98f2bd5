"""Registration and references: which instance of an id stands, and what is referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.options import Options

KEY = ["doc_id", "type", "id"]
_CARRIED = ("tagged", "tags", "props", "at", "vertices", "bounds", "members")


def instances(elements: DataFrame) -> DataFrame:
    """All elements and all members that bring their own geometry, each at its place ``reg``.

    Both come from one array a row, so the rows stay where they were dealt.
    """
    kinds = dict(elements.select(*_CARRIED).dtypes)
    top = "struct(struct(pos, 0 AS member) AS reg, type, id, false AS inline, tagged, tags, props, at, vertices, bounds, members)"
    own = (
        "transform(filter(transform(coalesce(members, array()), (m, i) -> struct(m, i)), x -> x.m.inline), x -> struct(struct(pos, x.i + 1 AS member) AS reg, x.m.type AS type, coalesce(x.m.ref, 'undefined') AS id, true AS inline,"
        f" x.m.tagged AS tagged, cast(null AS {kinds['tags']}) AS tags, x.m.props AS props, x.m.at AS at, x.m.vertices AS vertices, cast(null AS {kinds['bounds']}) AS bounds, cast(null AS {kinds['members']}) AS members))"
    )
    return elements.select("doc_id", F.expr(f"inline(concat(array({top}), {own}))")).select("doc_id", "type", "id", "reg", "inline", *_CARRIED)


def registry(every: DataFrame) -> DataFrame:
    """Per id the last instance, at the place ``ord`` of the first."""
    held = F.struct("reg", "inline", *_CARRIED)
    won = every.groupBy(*KEY).agg(F.min("reg").alias("ord"), F.max_by(held, "reg").alias("x"))
    return won.select(*KEY, "ord", "x.*")


def references(every: DataFrame) -> DataFrame:
    """(doc_id, type, id, n): late references of ways and relations, by all instances, also those that were replaced."""
    nodes = "CASE WHEN type = 'way' THEN transform(filter(vertices, v -> v.ref IS NOT NULL), v -> struct('node' AS type, v.ref AS id)) END"
    members = "CASE WHEN type = 'relation' THEN transform(filter(members, m -> NOT m.inline AND m.type IN ('node', 'way', 'relation')), m -> struct(m.type AS type, m.ref AS id)) END"
    found = every.where("type IN ('way', 'relation')").select("doc_id", F.expr(f"inline(coalesce({nodes}, {members}))"))
    return found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def is_kept(options: Options) -> Column:
    """Unreferenced elements, and referenced ones with tags as far as the options ask for them."""
    shown = F.col("tagged") & F.lit(options.tagged) & ~((F.col("type") == "way") & F.lit(options.exclude_ways))
    return ~F.col("referenced") | shown


def with_references(won: DataFrame, refs: DataFrame) -> DataFrame:
    """The registry with ``referenced``: an inline instance is referred to by its own member."""
    return won.join(refs, KEY, "left").withColumn("referenced", F.col("inline") | F.col("n").isNotNull()).drop("n")


def bind_ways(every: DataFrame, won: DataFrame) -> DataFrame:
    """(doc_id, reg, points): the vertices of each way instance in order; nodes that don't exist drop out."""
    ways = every.where("type = 'way'").select("doc_id", "reg", F.posexplode("vertices").alias("i", "v"))
    # a vertex with a place of its own looks up what no node has, another for each
    own = F.concat(F.lit("\0"), F.col("reg.pos").cast("string"), F.lit("/"), F.col("i").cast("string"))
    ways = ways.select("doc_id", "reg", "i", F.coalesce("v.ref", own).alias("ref"), F.when(F.col("v.ref").isNull(), F.col("v.at")).alias("own"))
    nodes = won.where("type = 'node'").select("doc_id", F.col("id").alias("ref"), "at")
    found = ways.join(nodes, ["doc_id", "ref"], "left").withColumn("at", F.coalesce("own", "at")).where("at is not null")
    grouped = found.groupBy("doc_id", "reg").agg(F.sort_array(F.collect_list(F.struct("i", "at"))).alias("p"))
    return grouped.select("doc_id", "reg", F.transform("p", lambda p: p["at"]).alias("points"))
