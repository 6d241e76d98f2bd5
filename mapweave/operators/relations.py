"""Relations: binding members, flattening what lies below, building geometry."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import geometry as G
from mapweave.operators.stitch import stitched


def members_of(won: DataFrame) -> DataFrame:
    """(doc_id, id, i, m) of the relations that stand."""
    return won.where("type = 'relation'").select("doc_id", "id", "ord", "reg", F.posexplode("members").alias("i", "m"))


def own_parts(won: DataFrame, bound: DataFrame) -> DataFrame:
    """(doc_id, id, ways, roles): a relation's own ways that exist, in order, and the roles of all its way members."""
    ways = members_of(won).where("m.type = 'way'").select("doc_id", "id", "i", "m.ref", "m.role", "m.inline", F.struct(F.col("reg.pos").alias("pos"), (F.col("i") + 1).alias("member")).alias("here"))
    stands = won.where("type = 'way'").select("doc_id", F.col("id").alias("ref"), F.col("reg").alias("there"))
    named = ways.join(stands, ["doc_id", "ref"], "left").withColumn("way", F.when(F.col("inline"), F.col("here")).otherwise(F.col("there")))
    shapes = bound.withColumnsRenamed({"reg": "way"})
    shaped = named.join(shapes, ["doc_id", "way"], "left")
    # a way that exists without vertices keeps its place: it still pairs with a role
    one = F.struct("i", F.col("way").isNotNull().alias("exists"), F.coalesce("points", F.array().cast(bound.schema["points"].dataType)).alias("points"), "role")
    grouped = shaped.groupBy("doc_id", "id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    return grouped.select("doc_id", "id", F.transform(F.filter("all", lambda x: x["exists"]), lambda x: x["points"]).alias("ways"), F.transform("all", lambda x: x["role"]).alias("roles"))


EXPANDED = "root string, path array<int>, id string, error string"


def below(roots: list[str], edges: list[dict]) -> Iterator[tuple[str, list[int], str]]:
    """(root, path, id) of the roots and all relations below them, once for every way to reach them; without recursion, so at any depth."""
    under: dict[str, list[tuple[int, str]]] = {}
    for e in sorted(edges, key=lambda e: -e["i"]):
        under.setdefault(e["from"], []).append((e["i"], e["ref"]))
    for root in roots:
        stack: list[tuple[list[int], str]] = [([], root)]
        while stack:
            path, here = stack.pop()
            yield root, path, here
            stack += [([*path, i], ref) for i, ref in under.get(here, ())]


#: Rows that are held before they are handed on.
_ROWS = 10_000


class _Below:
    """The relations of a document by their places in ``ids``, and what lies right below each, in order."""

    def __init__(self, ids: pa.Array, edges: pa.StructArray) -> None:
        self.ids, (above, i, ref) = ids, edges.flatten()
        above, ref = (pc.index_in(x, value_set=ids) for x in (above, ref))
        # a relation without an id has no place
        found = pc.and_(pc.is_valid(above), pc.is_valid(ref))
        above, i, ref = (x.filter(found).to_numpy() for x in (above, i, ref))
        order = np.lexsort((i, above))
        self.ref, self.i = ref[order], i[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(above, minlength=len(ids)))])

    def is_cyclic(self) -> bool:
        """Whether some relations remain when those that lie below none are taken away, again and again."""
        left = np.bincount(self.ref, minlength=len(self.ids))
        here, taken = np.flatnonzero(left == 0), 0
        while len(here):
            taken += len(here)
            sizes = self.starts[here + 1] - self.starts[here]
            at = np.repeat(self.starts[here] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            under, times = np.unique(self.ref[at], return_counts=True)
            left[under] -= times
            here = under[left[under] == 0]
        return taken < len(self.ids)

    def rows(self, roots: list[int]) -> Iterator[tuple[int, list[int], int]]:
        """As ``below``, by places."""
        starts = self.starts
        for root in roots:
            stack: list[tuple[list[int], int]] = [([], root)]
            while stack:
                path, here = stack.pop()
                yield root, path, here
                a, z = starts[here], starts[here + 1]
                if a < z:
                    stack += [([*path, i], ref) for i, ref in zip(self.i[a:z][::-1].tolist(), self.ref[a:z][::-1].tolist(), strict=True)]


def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of EXPANDED from (doc_id, every, roots, edges), in small batches: ids stay in Arrow, edges are arrays of numbers."""
    names = ["doc_id", *(c.split(" ")[0] for c in EXPANDED.split(", "))]
    kinds = (pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())

    def made(batch: pa.RecordBatch, k: int, n: int, columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([k] * n, pa.int64())), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    for batch in batches:
        for k in range(batch.num_rows):
            ids, roots, edges = (batch.column(c).slice(k, 1).flatten() for c in ("every", "roots", "edges"))
            graph = _Below(ids, edges)
            if len(edges) and graph.is_cyclic():
                try:
                    cyclic(ids.to_pylist(), edges.to_pylist())
                except ValueError as e:
                    yield made(batch, k, 1, [[None], [None], [None], [str(e)]])
                continue
            rows = graph.rows(pc.index_in(roots, value_set=ids).to_pylist())
            while some := list(islice(rows, _ROWS)):
                root, path, id_ = zip(*some, strict=True)
                yield made(batch, k, len(some), [ids.take(pa.array(root)), path, ids.take(pa.array(id_)), [None] * len(some)])


def expand(kept: DataFrame, won: DataFrame) -> DataFrame:
    """(doc_id, root, path, id, error): each kept relation and all relations below it, once for every way to reach them.

    A document in which a relation contains itself has one row, with an error.
    The relations of one document, without their ways, are read by one task.
    """
    roots = kept.where("type = 'relation'").groupBy("doc_id").agg(F.collect_list("id").alias("roots"))
    stands = won.where("type = 'relation'").select("doc_id", F.col("id").alias("ref"))
    edges = members_of(won).where("m.type = 'relation'").select("doc_id", F.col("id").alias("from"), "i", "m.ref").join(stands, ["doc_id", "ref"])
    # a cycle may also lie where no kept relation is above it
    every = won.where("type = 'relation'").groupBy("doc_id").agg(F.collect_list("id").alias("every"))
    grouped = every.join(roots, "doc_id", "left").join(edges.groupBy("doc_id").agg(F.collect_list(F.struct("from", "i", "ref")).alias("edges")), "doc_id", "left")

    kind = grouped.schema["doc_id"].dataType.simpleString()
    return grouped.select("doc_id", "every", "roots", "edges").mapInArrow(expanded, f"doc_id {kind}, {EXPANDED}")


def cyclic(ids: list[str], edges: list[dict]) -> None:
    """Raises ValueError where a relation contains itself; every relation is looked at once."""
    under: dict[str, list[str]] = {}
    for e in edges:
        under.setdefault(e["from"], []).append(e["ref"])
    done: set[str] = set()
    for root in ids:
        stack, above = [(root, iter(under.get(root, ())))], [root]
        on = {root}
        while stack and root not in done:
            here, rest = stack[-1]
            ref = next(rest, None)
            if ref is None:
                stack.pop()
                above.pop()
                on.discard(here)
                done.add(here)
            elif ref in on:
                raise ValueError("a relation contains itself: " + " > ".join([*above[above.index(ref) :], ref]))
            elif ref not in done:
                stack.append((ref, iter(under.get(ref, ()))))
                above.append(ref)
                on.add(ref)


def relation_shapes(tree: DataFrame, won: DataFrame, bound: DataFrame) -> DataFrame:
    """(doc_id, id, geometry) of the expanded relations that form one, geometry as struct<type, coordinates> in JSON text."""
    parts = own_parts(won, bound)
    tree = tree.where("error is null").select("doc_id", "root", "path", "id").join(parts, ["doc_id", "id"], "left")
    part = F.struct("path", F.coalesce("ways", F.array().cast(parts.schema["ways"].dataType)).alias("ways"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))
    grouped = tree.groupBy("doc_id", "root").agg(F.collect_list(part).alias("parts"))
    # a relation's own roles alone choose between area and lines
    own = F.element_at(F.filter("parts", lambda p: F.size(p["path"]) == 0), 1)["roles"]
    rows = grouped.select("doc_id", F.col("root").alias("id"), "parts", F.array_contains(own, "outer").alias("area"))
    rows = rows.select("doc_id", "id", "area", stitched(F.col("parts"), F.col("area")).alias("s"))
    rows = rows.select(
        "doc_id", "id", "area", "s.line",
        F.transform(F.filter("s.outer", G.is_ring), lambda r: G.oriented(r, False)).alias("outers"),
        F.transform(F.filter("s.inner", G.is_ring), lambda r: G.oriented(r, True)).alias("inners"),
    )
    rows = rows.select("doc_id", "id", "area", "line", F.when(F.size("outers") > 0, G.polygons(F.col("outers"), F.col("inners"))).alias("polygons"))
    shape = (
        F.when(~F.col("area") & (F.size("line") > 0), geometry_json("MultiLineString", F.col("line")))
        .when(F.size("polygons") == 1, geometry_json("Polygon", F.get("polygons", 0)))
        .when(F.size("polygons") > 1, geometry_json("MultiPolygon", F.col("polygons")))
    )
    return rows.select("doc_id", "id", shape.alias("geometry")).where("geometry is not null")


def geometry_json(kind: str, coordinates):
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")), {"ignoreNullFields": "false"})


def relation_nodes(kept: DataFrame, won: DataFrame) -> DataFrame:
    """(doc_id, ord, i, id, props, at): the node members that exist, as often as kept relations name them."""
    nodes = members_of(kept).where("m.type = 'node'").select("doc_id", "ord", "i", "m.inline", F.coalesce("m.ref", F.when(F.col("m.inline"), "undefined")).alias("id"), "m.props", "m.at")
    stands = won.where("type = 'node'").select("doc_id", "id", F.struct("props", "at").alias("there"))
    found = nodes.join(stands, ["doc_id", "id"], "left").where("inline or there is not null")
    return found.select("doc_id", "ord", "i", "id", *(F.when(F.col("inline"), F.col(c)).otherwise(F.col(f"there.{c}")).alias(c) for c in ("props", "at")))
