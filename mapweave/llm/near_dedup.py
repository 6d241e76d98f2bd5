"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. One pass takes each text's distinct five-word shingles (64-bit hashes), a
   digest of its word sequence, a signature and a parity bitmap. Equal
   sequences collapse to one node by a map-side combined aggregate.
2. Every tree orders all nodes by its own sequence of signature values. The
   rows of the trees are dealt out by range, so an order never sits in one
   task; each task sorts its range and splits it into regions of equal prefix.
   A region of at most ``REGION`` rows gives all its pairs; a larger one goes
   a value deeper, and at full depth each row meets its nearest neighbours.
   Neighbours across two ranges meet in a small extra group per border.
3. Candidates that sizes or bitmaps rule out fall away: each shingle flips one
   bit, so two sets differ in at least as many shingles as their bitmaps
   differ in bits. That bound is exact. The others are confirmed on full sets.
   A first round takes each row's nearest neighbours and contracts what they
   link; the second takes all pairs of regions that lie in different
   components, so a large group of copies never emits its pairs.
4. Rows of regions too large to give all pairs are joined exactly: similar
   sets share one of the rarest quarter of their shingles, so all pairs of
   different components that share one meet, in blocks. Sizes and bitmaps
   decide inside the task; what they can't rule out is compared on full sets.
5. Components by minimum labels with pointer jumping, all in shared storage.

A pair of similarity s shares a region with probability
1 - (1 - s**DEPTH)**TREES: at least 1 - 3e-8 at s = 0.75. Step 4 misses no
pair of rows that are in large regions.

Defined results: a text with fewer words than a shingle is one shingle; a
null, empty or wordless text has none and is linked with nothing; texts of any
length are read whole; repeated rows share a node; texts that share a doc_id
are linked, so an id has one component. doc_id may have any type that orders;
a null one is less than none: it names a component only where no row of it
has an id, and is kept there alone. Ties do not arise, as the smallest doc_id
names a component. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm.common import by_hot_key, discard, stage

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
TREES, DEPTH, LEVELS = 32, 3, 8
SIZE = TREES * DEPTH
REGION, NEIGHBOURS = 40, 4
ROWS_PER_RANGE = 100_000
#: More ranges than this in one job are dealt tree by tree.
MOST_RANGES = 100_000
#: Bits of a bitmap: few for sets of at most NARROW_SET shingles.
NARROW_SET, NARROW_BITS, WIDE_BITS = 256, 1024, 4096
#: The filter of ids has 16 bits an id and at most this many 64-bit words (16 MB), beyond which it passes ever more rows to the exact join that follows.
FILTER_WORDS = 1 << 21
CACHED_WORDS = 100_000
#: The sketch of shingle counts travels in so many pieces and is added up by so many tasks' at a time.
PIECES, FAN = 16, 64
GROUP, ROWS_PER_BLOCK = 2_048, 2_000
TEXTS_AT_ONCE = 64

_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(0, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _random.integers(0, 1 << 32, SIZE, dtype=np.uint32)
_AGAIN = _random.integers(0, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_COLUMNS = (np.arange(TREES)[:, None] * DEPTH + np.arange(LEVELS)) % SIZE


class _Words(dict):
    """Hashes of words seen; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = h
        return h


_words = _Words()


def split_words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII blanks, A-Z lower-cased; bytes know no other case or blank."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the five-word shingles, sorted."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    h = each[:n].copy()
    for k in range(1, SHINGLE):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += each[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SIZE minima, 16 bits each."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = x[None, at : at + 2048] * _MULTIPLY[:, None]
        v += _ADD[:, None]
        v ^= v >> np.uint32(15)
        v *= _AGAIN[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def bitmap(hashes: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each bit."""
    size = NARROW_BITS if len(hashes) <= NARROW_SET else WIDE_BITS
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Wide bitmaps as narrow ones: parities add up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, WIDE_BITS // NARROW_BITS, NARROW_BITS // 64), axis=1)


def unpacked(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Narrow bitmaps of all rows, wide ones of the rows that have them, and their place there (or -1)."""
    wide = np.array([len(b) > NARROW_BITS // 8 for b in bits], bool)
    whole = np.frombuffer(b"".join(b for b, w in zip(bits, wide, strict=True) if w), np.uint64).reshape(-1, WIDE_BITS // 64)
    narrow = np.empty((len(bits), NARROW_BITS // 64), np.uint64)
    narrow[wide] = _folded(whole)
    narrow[~wide] = np.frombuffer(b"".join(b for b, w in zip(bits, wide, strict=True) if not w), np.uint64).reshape(-1, NARROW_BITS // 64)
    return narrow, whole, np.where(wide, np.cumsum(wide) - 1, -1)


def may_link(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs (i of x, j of y) their bitmaps leave possible; ``sizes``: of both sets together. Never false for a linked pair."""
    differ = np.bitwise_count(x[0][i] ^ y[0][j]).sum(axis=1, dtype=np.int64)
    a, b = x[2][i], y[2][j]
    both = np.flatnonzero((a >= 0) & (b >= 0))
    differ[both] = np.bitwise_count(x[1][a[both]] ^ y[1][b[both]]).sum(axis=1, dtype=np.int64)
    return (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * sizes


def key_of(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # ids pass through untouched
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            rows = batch.slice(at, TEXTS_AT_ONCE)
            counts, keys, signatures, bits = [], [], [], []
            for text in rows.column("text"):
                words = split_words(text.as_py())
                hashes = shingles(words)
                counts.append(len(hashes))
                keys.append(key_of(words) if words else None)
                signatures.append(signature(hashes).tobytes() if words else None)
                bits.append(bitmap(hashes) if words else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "key", "sig", "bits"]
            )


TREE_ROW = "tree int, k1 long, k2 long, rep long, n long, label long"


def _tree_rows(first: int, stop: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, SIZE)
            for tree in range(first, stop):
                values = sig[:, _COLUMNS[tree]].astype(">u2")
                packed = np.ascontiguousarray(values).view(">i8").astype(np.int64)
                yield pd.DataFrame({"tree": np.int32(tree), "k1": packed[:, 0], "k2": packed[:, 1], "rep": rows["rep"], "n": rows["n_shingles"], "label": rows["label"]})

    return run


def _regions(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> list[np.ndarray]:
    """For sorted rows, the number of the row's region at depth DEPTH, DEPTH + 1, ... LEVELS."""
    one_tree = tree[1:] == tree[:-1]
    first, second = ((k[1:] ^ k[:-1]).view(np.uint64) for k in (k1, k2))
    out = []
    for depth in range(DEPTH, LEVELS + 1):
        # each key holds four values, the earliest in its highest bits
        within = one_tree & (first >> np.uint64(16 * max(0, 4 - depth)) == 0)
        if depth > 4:
            within &= second >> np.uint64(16 * (LEVELS - depth)) == 0
        out.append(np.concatenate([[0], np.cumsum(~within)]))
    return out


def region_pairs(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray, rep: np.ndarray, n: np.ndarray, label: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of candidates among sorted rows; nearest: of the next row alone."""
    size = len(tree)
    levels = _regions(tree, k1, k2) if size > 1 else []
    firsts, seconds = [np.empty(0, int)], [np.empty(0, int)]
    if levels:
        counts = [np.bincount(r)[r] for r in levels]
        region, count = levels[0].copy(), counts[0].copy()
        for level, (r, c) in enumerate(zip(levels[1:], counts[1:], strict=True), 1):
            deeper = count > REGION
            region = np.where(deeper, r + size * level, region)
            count = np.where(deeper, c, count)
        whole = count <= REGION
    for step in range(1, min(2 if nearest else REGION, size)):
        a, b = slice(None, size - step), slice(step, None)
        if nearest:
            hit = levels[0][a] == levels[0][b]
        else:
            hit = region[a] == region[b]
            if step > NEIGHBOURS:
                hit &= whole[a]
        i = np.flatnonzero(hit & (rep[a] != rep[b]) & (label[a] != label[b]))
        i = i[DENOMINATOR * np.minimum(n[i], n[i + step]) >= NUMERATOR * np.maximum(n[i], n[i + step])]
        firsts.append(i)
        seconds.append(i + step)
    return np.concatenate(firsts), np.concatenate(seconds)


def crowded(tree: np.ndarray, k1: np.ndarray, k2: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the sorted rows are in regions too large to give all pairs, and of more than one label as far as these rows tell; a region at either end may go on elsewhere."""
    if len(tree) < 2:
        return np.zeros(len(tree), bool)
    region = _regions(tree, k1, k2)[0]
    mixed = np.zeros(region[-1] + 1, bool)
    mixed[region[1:][(region[1:] == region[:-1]) & (label[1:] != label[:-1])]] = True
    mixed[[0, -1]] = True
    return mixed[region] & (np.bincount(region)[region] > REGION)


ROW = ("tree", "k1", "k2", "rep", "n", "label")
PAIRS = "edge boolean, a long, b long, la long, lb long, border int, side int, tree int, k1 long, k2 long, n long"


def _sorted(rows: pd.DataFrame, *more: str) -> list[np.ndarray]:
    columns = {c: rows[c].to_numpy(np.int64) for c in (*ROW, *more)}
    order = np.lexsort(tuple(columns[c] for c in ("rep", "k2", "k1", "tree")))
    return [c[order] for c in columns.values()]


def _pair_frame(rep: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    turned = rep[i] > rep[j]
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    return pd.DataFrame({"edge": False, "a": rep[i], "b": rep[j], "la": label[i], "lb": label[j], "border": 0, "side": 0, "tree": 0, "k1": 0, "k2": 0, "n": 0})


def _crowd_frame(rep: np.ndarray, label: np.ndarray, which: np.ndarray) -> pd.DataFrame:
    """Rows of large regions, each as a pair with itself."""
    at = np.flatnonzero(which)
    at = at[np.unique(rep[at], return_index=True)[1]]
    return _pair_frame(rep, label, at, at)


def _scan(nearest: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One range of all tree orders: its pairs, and the rows at its two borders."""
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held)
        here = int(rows["here"].iloc[0])
        tree, k1, k2, rep, n, label = _sorted(rows)
        i, j = region_pairs(tree, k1, k2, rep, n, label, nearest)
        for at in range(0, len(i), 100_000):
            yield _pair_frame(rep, label, i[at : at + 100_000], j[at : at + 100_000])
        if not nearest:
            yield _crowd_frame(rep, label, crowded(tree, k1, k2, label))
        for side, border, at in ((0, here, slice(-REGION, None)), (1, here - 1, slice(None, REGION))):
            yield pd.DataFrame({"edge": True, "a": rep[at], "b": 0, "la": label[at], "lb": 0, "border": border, "side": side, "tree": tree[at], "k1": k1[at], "k2": k2[at], "n": n[at]})

    return run


def _cross(nearest: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one border: one row from either side."""
        tree, k1, k2, rep, n, label, side = _sorted(rows.assign(rep=rows["a"], label=rows["la"]), "side")
        i, j = region_pairs(tree, k1, k2, rep, n, label, nearest)
        across = side[i] != side[j]
        pairs = _pair_frame(rep, label, i[across], j[across])
        return pairs if nearest else pd.concat([pairs, _crowd_frame(rep, label, crowded(tree, k1, k2, label))])

    return run


LINK = ["a", "b", "la", "lb"]
LINKS = "a long, b long, la long, lb long"


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            x, y, every = unpacked(list(rows["bits_a"])), unpacked(list(rows["bits_b"])), np.arange(len(rows))
            yield rows.loc[may_link(x, every, y, every, (rows["n_a"] + rows["n_b"]).to_numpy()), LINK]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for rows in batches:
        keep = []
        for a, b, x, y in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("text_a"), rows.column("text_b"), strict=True):
            if len(held) > 500:
                held.clear()
            sets = []
            for key, text in ((a, x), (b, y)):
                if key not in held:
                    held[key] = shingles(split_words(text.as_py()))
                sets.append(held[key])
            keep.append(linked(*sets))
        yield rows.select(LINK).filter(pa.array(keep, pa.bool_()))


def candidate_pairs(reps: DataFrame, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """(rep, n_shingles, sig, bits, label) -> distinct (a, b, la, lb) with a < b and different labels; and the reps of large regions, none for nearest."""
    n = reps.count()
    trees = max(1, min(TREES, MOST_RANGES * ROWS_PER_RANGE // max(1, n)))
    ranges = max(1, n * trees // ROWS_PER_RANGE)
    parts = []
    for first in range(0, TREES, trees):
        rows = reps.select("rep", "n_shingles", "sig", "label").mapInPandas(_tree_rows(first, min(TREES, first + trees)), TREE_ROW)
        # a range's number is a column, as a task may be given several ranges
        dealt = rows.repartitionByRange(ranges, "tree", "k1", "k2", "rep").withColumn("here", F.spark_partition_id())
        forest = stage(dealt.mapInPandas(_scan(nearest), PAIRS), "forest")
        across = forest.where("edge").groupBy("border").applyInPandas(_cross(nearest), PAIRS)
        parts.append(stage(forest.where("not edge").unionByName(across).select(*LINK).distinct(), "pairs", narrow=True))
        discard(forest)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    pairs, crowd = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("rep"))
    if nearest:  # few and mostly linked: bitmaps would spare little
        return pairs, crowd
    own = reps.select("rep", F.col("n_shingles").alias("n"), "bits")
    both = pairs.join(own.withColumnsRenamed({"rep": "a", "n": "n_a", "bits": "bits_a"}), "a").join(own.withColumnsRenamed({"rep": "b", "n": "n_b", "bits": "bits_b"}), "b")
    return stage(both.mapInPandas(_possible, LINKS).distinct(), "pairs", narrow=True), crowd.distinct()


def flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``_hit``: true where doc_id is null or in ``ids``, and for some others.

    A bit filter that is sized by the number of ids is broadcast, so that
    texts in no pair are never shuffled; the joins that follow are exact.
    """
    n = ids.count()
    words = 1 << max(6, min(FILTER_WORDS.bit_length() - 1, (n // 4).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(64 * words))
    held = ids.where("doc_id is not null").select(bit.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_there")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    rows = docs.withColumn("_at", bit).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(held), F.col("_word") == F.col("_there"), "left")
    return rows.select(*docs.columns, F.expr("doc_id is null or coalesce((shiftright(_bits, cast(_at % 64 as int)) & 1L) = 1L, false)").alias("_hit"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        texts = rows.column("text") if "text" in rows.schema.names else rows.column("row").field("text")
        keys = [key_of(w) if (w := split_words(t.as_py())) else b"" for t in texts]
        yield rows.append_column("key", pa.array(keys, pa.binary()))


def with_key(docs: DataFrame) -> DataFrame:
    """``docs``, with a text or a row that has one, and the digest of its word sequence: empty for wordless texts."""
    return docs.mapInArrow(_keyed, T.StructType([*docs.schema.fields, T.StructField("key", T.BinaryType())]))


def texts_of(reps: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of the nodes; one text stands for equal word sequences."""
    need = reps.join(nodes, "rep", "left_semi").select("rep", "key", "name")
    rows = flagged(docs, need.select(F.col("name").alias("doc_id"))).where("_hit").select("text")
    return with_key(rows).groupBy("key").agg(F.first("text").alias("text")).join(need.select("rep", "key"), "key").select("rep", "text")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of linked labels: those of the pairs whose full sets are similar enough."""
    met = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = stage(texts_of(reps, met, docs), "texts")
    both = pairs.join(texts.withColumnsRenamed({"rep": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"rep": "b", "text": "text_b"}), "b")
    links = both.select(*LINK, "text_a", "text_b").mapInArrow(_confirm, LINKS)
    return stage(links.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links", narrow=True)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        held = [shingles(split_words(t.as_py())).tobytes() for t in rows.column("text")]
        yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.array(held, pa.binary())], ["rep", "shingles"])


def _sketched(width: int):
    """How many shingles of all sets of a task fall on each of ``width`` places, as sparse pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, np.int64)
        for rows in batches:
            for x in rows.column("shingles"):
                np.add.at(held, np.frombuffer(x.as_py(), np.uint64) % np.uint64(width), 1)
        yield pa.RecordBatch.from_pandas(_pieces(held.reshape(PIECES, -1), TaskContext.get().partitionId()), preserve_index=False)

    return run


def _pieces(counts: np.ndarray, part: int, first: int = 0) -> pd.DataFrame:
    places = [np.flatnonzero(c) for c in counts]
    return pd.DataFrame({"piece": np.arange(first, first + len(counts), dtype=np.int32), "part": part, "at": [p.astype(np.int32).tobytes() for p in places], "n": [c[p].tobytes() for c, p in zip(counts, places, strict=True)]})


def _added(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((1, width // PIECES), np.int64)
        for at, n in zip(rows["at"], rows["n"], strict=True):
            held[0, np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        return _pieces(held, int(rows["part"].iloc[0]) // FAN, int(rows["piece"].iloc[0]))

    return run


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """Counts of shingles by hash, as a sketch whose width follows their number, up to 4 million places; gathered in levels."""
    total = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    width = 1 << max(16, min(22, (total // 128).bit_length()))
    shape = "piece int, part long, at binary, n binary"
    rows = sets.select("shingles").mapInArrow(_sketched(width), shape)
    add = _added(width)
    for _ in range(2):
        rows = rows.groupBy("piece", F.expr(f"part div {FAN}")).applyInPandas(lambda _, some: add(some), shape)
    out = np.zeros((PIECES, width // PIECES), np.int64)
    for r in rows.groupBy("piece").applyInPandas(add, shape).collect():
        out[r["piece"], np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of a set's shingles, so many that two linked sets share one; the counts only order, and any order will do."""
    size = len(hashes) - -(-NUMERATOR * len(hashes) // DENOMINATOR) + 1
    return hashes[np.lexsort((hashes, counts[hashes.view(np.uint64) % np.uint64(len(counts))]))[:size]]


CROWD = "h long, rep long, label long, n long, bits binary"


def _prefixes(counts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 100):
                some = rows.iloc[at : at + 100]
                sets = [np.frombuffer(x, np.int64) for x in some["shingles"]]
                firsts = [prefix(x, counts) for x in sets]
                each = [len(x) for x in firsts]
                if each:
                    yield pd.DataFrame({"h": np.concatenate(firsts), **{c: np.repeat(some[c].to_numpy(), each) for c in ("rep", "label")}, "n": np.repeat([len(x) for x in sets], each), "bits": np.repeat(some["bits"].to_numpy(), each)})

    return run


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of sorted rows of one group that may be linked; of two blocks, one row from either. Each pair comes once from a task."""
    names = ["h", "low", "high", "block", "rep", "label", "n"]
    left = None
    seen: set[tuple[int, int]] = set()

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        h, low, high, block, rep, label, n = (rows[c].to_numpy(np.int64) for c in names)
        bits = unpacked(list(rows["bits"]))
        for step in range(1, len(h)):
            a, b = slice(None, -step), slice(step, None)
            same = (h[a] == h[b]) & (low[a] == low[b]) & (high[a] == high[b])
            if not same.any():
                break
            i = np.flatnonzero(same & (label[a] != label[b]) & ((low[a] == high[a]) | (block[a] != block[b])))
            i = i[DENOMINATOR * np.minimum(n[i], n[i + step]) >= NUMERATOR * np.maximum(n[i], n[i + step])]
            i = i[may_link(bits, i, bits, i + step, n[i] + n[i + step])] if len(i) else i
            fresh = []
            for k in i:
                pair = (min(rep[k], rep[k + step]), max(rep[k], rep[k + step]))
                if pair not in seen:
                    seen.add(pair)
                    fresh.append(k)
            if len(seen) > 1_000_000:
                seen.clear()
            if fresh:
                fresh = np.array(fresh)
                yield _pair_frame(rep, label, fresh, fresh + step)[LINK]

    for rows in batches:
        rows = rows if left is None else pd.concat([left, rows])
        if not len(rows):
            continue
        last = rows.iloc[-1]
        # the last group may go on in the next batch
        open_ = ((rows["h"] == last["h"]) & (rows["low"] == last["low"]) & (rows["high"] == last["high"])).to_numpy()
        yield from pairs(rows[~open_])
        left = rows[open_]
    if left is not None:
        yield from pairs(left)


def _compare(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    held = {r: np.frombuffer(x, np.uint64) for r, x in zip(sets["rep"], sets["shingles"], strict=True)}
    keep = [linked(held[a], held[b]) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
    return pairs.loc[np.array(keep, bool), LINK]


def crowd_links(sets: DataFrame) -> DataFrame:
    """(rep, label, bits, shingles) -> (a, b) of all labels with linked sets; no pair is left to chance."""
    prefixes = stage(sets.mapInPandas(_prefixes(shingle_counts(sets)), CROWD), "prefixes")
    groups = prefixes.groupBy("h").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    rows = prefixes.join(groups.select("h", F.ceil(F.col("size") / GROUP).alias("blocks")), "h")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "label", "n", "bits")
    rows = rows.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
    pairs = stage(rows.mapInPandas(_met, LINKS).distinct(), "pairs", narrow=True)
    blocks = F.lit(max(1, sets.count() // ROWS_PER_BLOCK))
    dealt = pairs.select(*LINK, *(F.pmod(F.xxhash64(c), blocks).alias(to) for c, to in (("a", "x"), ("b", "y"))))
    need = dealt.select("x", "y", F.col("a").alias("rep")).unionByName(dealt.select("x", "y", F.col("b").alias("rep"))).distinct()
    need = stage(need, "needed", narrow=True)
    both = dealt.groupBy("x", "y").cogroup(need.join(sets.select("rep", "shingles"), "rep").groupBy("x", "y"))
    links = both.applyInPandas(_compare, LINKS)
    links = stage(links.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links", narrow=True)
    discard(prefixes, pairs, need)
    return links


def crowd_sets(crowd: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, label, bits and full shingle set of the nodes in ``crowd``."""
    sets = texts_of(reps, crowd, docs).mapInArrow(_sets, "rep long, shingles binary")
    return stage(sets.join(reps.select("rep", "label", "bits"), "rep"), "sets")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node reachable. Labels spread along links, then along labels, until none changes.

    A node or label that holds very many rows is joined by broadcast (see
    ``by_hot_key``), so a giant component is no one task's.
    """
    links = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links", narrow=True)
    labels = stage(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels", narrow=True)
    held = labels
    while True:
        best = by_hot_key(links, labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("best"))
        spread = stage(labels.join(best, labels.node == best.u).select("node", F.col("label").alias("old"), F.least("label", "best").alias("label")), "labels", narrow=True)
        roots = spread.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stage(by_hot_key(spread, roots, "label").select("node", "old", F.col("root").alias("label")), "labels", narrow=True)
        discard(held, spread)
        held, labels = jumped, jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            discard(links)
            return labels


def _renamed(components_: DataFrame) -> DataFrame:
    return components_.select(F.col("node").alias("label"), F.col("label").alias("last"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, n_shingles, key ...) and (key, label) of every word sequence."""
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("key", "sig", "bits"))]
    signed = stage(docs.mapInArrow(_signed, T.StructType(fields)), "signed")
    wordy = signed.where("key is not null")
    reps = wordy.groupBy("key").agg(F.min("doc_id").alias("name"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bits")))
    # nodes get their numbers as they are written, once for all
    reps = stage(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    first = reps.withColumn("label", F.col("rep"))
    pairs, _ = candidate_pairs(first, True)
    near = components(confirm(pairs, reps, docs))
    second = reps.join(near, reps.rep == near.node, "left").select(*reps.columns, F.coalesce("label", "rep").alias("label"))
    second = stage(second, "reps")
    discard(reps)
    pairs, crowd = candidate_pairs(second, False)
    far = components(confirm(pairs, second, docs))

    def relabelled(named: DataFrame, by: DataFrame) -> DataFrame:
        return stage(by_hot_key(named, _renamed(by), "label", "left").withColumn("label", F.coalesce("last", "label")).drop("last"), "named", narrow=True)

    named = relabelled(second.select("key", "rep", "name", "label"), far)
    if not crowd.isEmpty():
        sets = crowd_sets(crowd, second.drop("label").join(named.select("rep", "label"), "rep"), docs)
        links = crowd_links(sets)
        discard(sets)
        named = relabelled(named, components(links))
    # texts that share a doc_id
    hubs = wordy.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("hub"), F.max("key").alias("other")).where("hub <> other").select("doc_id", "hub")
    if not hubs.isEmpty():
        same = by_hot_key(wordy.select("doc_id", "key"), hubs, "doc_id").where("hub <> key").select("hub", "key").distinct()
        label = named.select("key", "label")
        links = same.join(label.withColumnRenamed("label", "a"), "key").join(label.withColumnsRenamed({"key": "hub", "label": "b"}), "hub").where("a <> b")
        named = relabelled(named, components(links.select("a", "b")))
    discard(second)
    return signed, named


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    signed, named = _classes(docs.select("doc_id", "text"))
    names = named.groupBy("label").agg(F.min("name").alias("component_id"))
    named = stage(by_hot_key(named, names, "label").select("key", "component_id"), "classes", narrow=True)
    wordy = by_hot_key(signed.where("key is not null").select("doc_id", "n_shingles", "key"), named, "key").select("doc_id", "n_shingles", "component_id")
    wordless = signed.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return wordy.unionByName(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those of its smallest doc_id.

    Of rows that share an id or have none, and have the same word sequence,
    one stays. Wordless rows all stay, but for such repeats.
    """
    signed, named = _classes(docs.select("doc_id", "text"))
    names = named.groupBy("label").agg(F.min("name").alias("smallest"), F.min(F.when(F.col("name").isNull(), F.col("key"))).alias("nameless"))
    named = stage(by_hot_key(named, names, "label").select("key", "smallest", "nameless"), "classes", narrow=True)
    rows = by_hot_key(signed.select("doc_id", "key"), named, "key", "left")
    # a component without any id keeps one of its sequences
    stays = F.when(F.col("key").isNull(), F.lit(True)).when(F.col("smallest").isNull(), F.col("key") == F.col("nameless")).otherwise(F.coalesce(F.col("doc_id") == F.col("smallest"), F.lit(False)))
    judged = rows.groupBy("doc_id", F.coalesce("key", F.lit(b"")).alias("key")).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    judged = stage(judged, "judged", narrow=True)
    touched = judged.groupBy("doc_id").agg(F.bool_and("stays").alias("whole"), F.sum("n").alias("n")).where("not whole or n > 1")
    marked = flagged(docs.select("doc_id", F.struct(*docs.columns).alias("row")), touched.select("doc_id"))
    # only what the filter hits has to be shuffled
    hit = with_key(marked.where("_hit").select("doc_id", "row")).groupBy("doc_id", "key").agg(F.first("row").alias("row"))
    stay = judged.where("stays").select(F.col("doc_id").alias("id"), F.col("key").alias("sequence"))
    kept = hit.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("sequence")), "left_semi")
    return marked.where("not _hit").select("row.*").unionByName(kept.select("row.*"))
