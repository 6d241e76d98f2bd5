"""What the operators of this subpackage share: reading, staging, span arithmetic."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: The six characters that separate words in the word contracts ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"
HOT_BYTES, HOT_ROWS = 64 << 20, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a driver table; other columns never reach the plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, which all executors share; it goes when the driver ends.

    Where that is unset, a local session (as in tests) gets a folder of its own and any other is refused.
    """
    context = spark.sparkContext
    held = context.__dict__.setdefault("_mapweave_shared", {})
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at not in held:
        if not at and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held[at] = f"{at or tempfile.mkdtemp(prefix='mapweave-')}/mapweave-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(held[at])
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return held[at]


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation of what came before.

    narrow: rows of a few numbers, which are written in at most four files a core.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mapweave_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._mapweave_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """Bytes by the planner's estimate: the files' sizes, for staged tables."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def by_hot_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` where ``right`` has one row a key and a key may hold any share of ``left``.

    Keys of over ``HOT_ROWS`` rows are joined by broadcast, so there are at
    most ``left``'s rows / HOT_ROWS of them. A small ``left`` has no such key.
    """
    if size_of(left) < HOT_BYTES:
        return left.join(right, key, how)
    hot = F.broadcast(stage(left.groupBy(key).count().where(F.col("count") > HOT_ROWS).select(key), "hot", narrow=True))
    some = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
    return some.unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def hex_sha256(c: Column) -> Column:
    return F.sha2(c, 256)


# What follows is written as SQL text: the same expressions cost seconds to build call by call.


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with a name for a value that is computed once a row, however often it is used."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def quoted(pattern: str) -> str:
    """A Java pattern without quotes (write them as codes) as an SQL literal."""
    assert "'" not in pattern and '"' not in pattern
    return f"r'{pattern}'"


def computed(rows: DataFrame, held: Sequence[str], **columns: Column) -> DataFrame:
    """``held`` and new columns, computed once: no filter or later column takes the expressions into itself."""
    return rows.select(*held, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def packed(keep: Sequence[str], result: Sequence[str]) -> Column:
    """The kept columns as one struct, so their names meet no inner one; a kept column with the name of a result gives way to it."""
    return F.struct(*(k for k in keep if k not in result))


def running(values: str, op: str = "{a} + {x}") -> str:
    """SQL for the result of ``op`` (a sum or maximum of ints from 0 on) up to each element of an array, itself included.

    Blocks of 32 elements, and blocks of those, go ahead: the work is that of
    some 35 operations an element, in arrays of any length that a text gives.
    """

    def total(v: str, start: str, size: str) -> str:
        return f"aggregate(slice({v}, {start}, {size}), 0, (za, zx) -> {op.format(a='za', x='zx')})"

    def blocks(v: str) -> str:
        return f"transform(sequence(0, shiftright(size({v}) - 1, 5)), zj -> {total(v, 'zj * 32 + 1', '32')})"

    def inside(v: str, before: str, own: int) -> str:
        ahead, here = f"get({before}, shiftright(zi, 5))", total(v, "shiftright(zi, 5) * 32 + 1", f"(zi & 31) + {own}")
        return f"transform({v}, (zu, zi) -> {op.format(a=ahead, x=here)})"

    above = f"transform(zc, (zu, zi) -> {total('zc', '1', 'zi')})"
    far = let("zb", blocks(values), let("zc", blocks("zb"), let("zt", above, let("zp", inside("zb", "zt", 0), inside(values, "zp", 1)))))
    return f"CASE WHEN size({values}) <= 32 THEN transform({values}, (zu, zi) -> {total(values, '1', 'zi + 1')}) ELSE {far} END"


SPANS = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


def regex_spans(text: str, pattern: str, kind: str, rank: int, where: str = "true") -> Column:
    """Leftmost non-overlapping matches of a Java pattern in a column as array<struct<start,end,rank,kind,value>>, in code points.

    Matches come from one pass and, where there are any, the text between
    them from another; their lengths add up to the positions, so no Python is
    needed. where: SQL of a cheap condition without which there can be no match.
    """
    placed = f"transform(yf, (yv, yi) -> named_struct('start', get(ye, yi) - length(yv), 'end', get(ye, yi), 'rank', {rank}, 'kind', '{kind}', 'value', yv))"
    lengths = let("yg", f"split({text}, {quoted(pattern)}, -1)", "transform(yf, (yv, yi) -> length(get(yg, yi)) + length(yv))")
    spans = let("yn", lengths, let("ye", running("yn"), placed))
    none = f"cast(array() AS {SPANS})"
    found = let("yf", f"regexp_extract_all({text}, {quoted(pattern)}, 0)", f"CASE WHEN size(yf) > 0 THEN {spans} ELSE {none} END")
    return F.expr(f"CASE WHEN {where} THEN {found} ELSE {none} END")


def any_of(text: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def meets(spans: str, start: str, end: str) -> str:
    """SQL: whether one of the spans, sorted and apart from each other, ends at ``start`` or later and begins at ``end`` or sooner; a binary search."""
    first = f"aggregate(sequence(length(bin(size({spans}))) - 1, 0, -1), 0, (xa, xk) -> CASE WHEN get({spans}, xa + shiftleft(1, xk) - 1).end < {start} THEN xa + shiftleft(1, xk) ELSE xa END)"
    return f"coalesce(get({spans}, {first}).start <= {end}, false)"


CHUNK = 1 << 10


def chunks_of(text: str) -> str:
    """SQL for the text in pieces of ``CHUNK`` code points."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"


def stretch(chunks: str, start: str, end: str) -> str:
    """SQL for code points start to end of a text in chunks; the work grows with the stretch, not with its place in the text."""
    first = f"shiftright({start}, 10)"
    last = f"shiftright(greatest({end} - 1, {start}), 10)"
    return f"substring(array_join(slice({chunks}, {first} + 1, {last} - {first} + 1), ''), {start} - {first} * {CHUNK} + 1, {end} - {start})"


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
