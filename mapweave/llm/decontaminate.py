"""Benchmark decontamination with an FM-index for each training shard.

A shard is one Arrow batch of documents, cut where it grows large. Words that
no benchmark item holds can't be in an occurrence, so the index covers the
runs of benchmark words that are long enough; nothing else is left out. Over
the runs' word numbers stand a suffix order, its Burrows-Wheeler transform in
a wavelet matrix with rank counts, and sampled suffix positions. All windows
of the benchmark are searched backward at once; the occurrences are located
by walking to sampled positions, and their spans are merged per document.

The documents are not shuffled. The benchmark's words are sent to the tasks
in blocks of at most ``BLOCK_BYTES``. Of a benchmark that takes several blocks
a bit filter of all windows goes first, 16 bits a window and at most
``FILTER_BYTES``: one pass over the documents parts those that can hold an
occurrence from the others, and only the former are read again for each block.

Defined results: a null, empty or wordless text has no words and no hits;
texts of any length are searched whole; an item without words has no window,
one with fewer words than a window is a window; items that repeat count under
each of their ids, an item_id that repeats counts once, a null item_id is left
out; repeated rows and rows with a null doc_id are judged alike; items that
tie sort by their ids as strings; an empty table on either side gives no hits;
columns outside ``keep`` are ignored, and a kept column with the name of a
result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm.common import discard, stage

WINDOW = 13
BLOCK_BYTES = 8_000_000
FILTER_BYTES = 64 << 20
RESULT = ("n_words", "n_hit", "spans", "items")
SHARD_TOKENS = 1 << 20
SAMPLE = 16
#: A-Z lower-cased, digits, a-z and all bytes of non-ASCII characters kept, the rest blank.
_WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ")


def split_words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class Phrases:
    """The windows of a block of items as rows of word numbers, and which items each belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(number[item])
        rows = list(owners)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.patterns = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.patterns[k, window - len(r) :] = r
        self.starts = np.concatenate([[0], np.cumsum([len(owners[r]) for r in rows])]).astype(np.int64)
        self.owners = np.array([o for r in rows for o in sorted(owners[r])], np.int64)
        self.least = int(self.lengths.min()) if rows else 0


class FmIndex:
    """Over symbols 1..top and separators 0; the last symbol is a separator."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        n = len(symbols)
        order = suffix_order(symbols)
        self.n, self.bwt = n, symbols[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        row = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[~bit], row[bit]])
        # samples: every SAMPLE-th position, and what follows a separator, where a walk must end
        known = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.sampled = np.where(known, order, -1)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        low, at = np.zeros(len(symbol), np.int64), upto.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbol >> level) & 1 == 1
            ones = self.ones[k]
            a, b = ones[low], ones[at]
            low = np.where(bit, self.zeros[k] + a, low - a)
            at = np.where(bit, self.zeros[k] + b, at - b)
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each right-aligned pattern; empty where it doesn't occur."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((patterns[:, column] > 0) & (low < high))
            symbol = patterns[live, column]
            low[live] = self.below[symbol] + self.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(far := np.flatnonzero(self.sampled[at] < 0)):
            symbol = self.bwt[at[far]]
            at[far] = self.below[symbol] + self.rank(symbol, at[far])
            steps[far] += 1
        return self.sampled[at] + steps


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; each separator is smaller than any word and than the separators after it."""
    n = len(symbols)
    stop = symbols == 0
    stops = int(stop.sum())
    rank = np.where(stop, np.cumsum(stop) - 1, symbols + stops)
    length = 1
    _, rank = np.unique(rank, return_inverse=True)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        length *= 2


def find_spans(texts: Iterable[str | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Per document the number of words, the word spans that are hit, and the items that occur.

    Of each text only the runs that may hold an occurrence are kept.
    """
    counts: list[int] = []
    spans: list[list[tuple[int, int]]] = []
    items: list[set[str]] = []
    get = phrases.vocabulary.get
    shard: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal shard, held
        if not shard:
            return
        symbols = np.concatenate([x for _, _, ids in shard for x in (ids, [0])]).astype(np.int64)
        sizes = np.array([len(ids) + 1 for _, _, ids in shard])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        run = np.repeat(np.arange(len(shard)), sizes)
        index = FmIndex(symbols, len(phrases.vocabulary))
        low, high = index.search(phrases.patterns)
        found = np.flatnonzero(low < high)
        if len(found):
            many = high[found] - low[found]
            which = np.repeat(found, many)
            rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            at = index.locate(rows)
            edge = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + phrases.lengths[which], -1)
            covered = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
            change = np.diff(covered)
            for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True):
                doc, first, _ = shard[run[a]]
                spans[doc].append((int(first + a - begin[run[a]]), int(first + b - begin[run[a]])))
            docs = np.array([d for d, _, _ in shard])[run[at]]
            for doc, pattern in np.unique(np.stack([docs, which], 1), axis=0):
                items[doc].update(phrases.items[o] for o in phrases.owners[phrases.starts[pattern] : phrases.starts[pattern + 1]])
        shard, held = [], 0

    for doc, text in enumerate(texts):
        words = split_words(text)
        counts.append(len(words))
        spans.append([])
        items.append(set())
        if not phrases.least:
            continue
        ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        inside = np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8))
        starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        for a, b in zip(starts, ends, strict=True):
            if b - a >= phrases.least:
                shard.append((doc, int(a), ids[a:b].copy()))
                held += b - a
        if held >= SHARD_TOKENS:
            flush()
    flush()
    return counts, spans, [sorted(x) for x in items]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def _flat(spans: list[tuple[int, int]]) -> list[int]:
    return [x for span in spans for x in span]


def _paired(flat) -> list[tuple[int, int]]:
    return [(int(a), int(b)) for a, b in zip(flat[::2], flat[1::2], strict=True)]


def window_hashes(words: list[bytes], lengths: Iterable[int]) -> np.ndarray:
    """64-bit hashes of all runs of so many words, one after the other length."""
    import xxhash

    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = [np.empty(0, np.uint64)]
    for size in lengths:
        if len(each) >= size:
            n = len(each) - size + 1
            h = np.full(n, size, np.uint64)
            for k in range(size):
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += each[k : k + n]
            h ^= h >> np.uint64(32)
            out.append(h)
    return np.concatenate(out)


def window_filter(known: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """A bit for each window of the benchmark, and the lengths of its windows."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for text in rows.column("text"):
                words = split_words(text.as_py())
                if words:
                    size = min(window, len(words))
                    found = np.unique(window_hashes(words, [size]))
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), size, np.int64))], ["h", "size"])

    rows = stage(known.select("text").mapInArrow(hashes, "h long, size long").distinct(), "windows")
    lengths = sorted(r["size"] for r in rows.select("size").distinct().collect())
    words = 1 << max(6, min((FILTER_BYTES // 8).bit_length() - 1, (rows.count() // 4).bit_length()))
    at = F.pmod("h", F.lit(64 * words))
    held = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(words, np.int64)
    bits[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    discard(rows)
    return bits.view(np.uint64), lengths


def may_hold(docs: DataFrame, known: DataFrame, window: int) -> DataFrame:
    """``docs`` with ``_n``, its number of words, and ``_may``: false only where no window of the benchmark occurs."""
    bits, lengths = window_filter(known, window)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        bound = np.uint64(64 * len(held))
        for rows in batches:
            n, may = [], []
            for text in rows.column("text"):
                words = split_words(text.as_py())
                at = window_hashes(words, lengths) % bound
                n.append(len(words))
                may.append(bool(((held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).any()))
            yield rows.append_column("_n", pa.array(n, pa.int64())).append_column("_may", pa.array(may, pa.bool_()))

    return docs.mapInArrow(test, T.StructType([*docs.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_may", T.BooleanType())]))


def _with(rows: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    for name, values in columns.items():
        k = rows.schema.get_field_index(name)
        rows = rows.append_column(name, values) if k < 0 else rows.set_column(k, name, values)
    return rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """``keep`` (cut: its text without the spans), n_words, n_hit, ``spans`` to remove (word positions start, end, start, end ...) and ``items`` that occur, as sorted strings."""
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # twice as many blocks as needed, as a hash doesn't deal evenly
    blocks = -(-total * 2 // block_bytes) if total > block_bytes else 1
    kept = [k for k in keep if k not in (*RESULT, "text")]
    rows = docs.select(F.struct(*kept, F.lit(0).alias("_")).alias("_kept"), "text")
    found = [T.StructField("_n", T.LongType()), T.StructField("_spans", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*rows.schema.fields, *found])
    clean = None
    if blocks > 1:
        judged = stage(may_hold(rows, known, window), "judged")
        none = {"_spans": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")}
        clean = judged.where("not _may").select("_kept", "text", "_n", *(c.alias(k) for k, c in none.items()))
        rows = judged.where("_may").select("_kept", "text")
    for block in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r["item_id"], r["text"]) for r in part.collect()]

        def search(batches: Iterator[pa.RecordBatch], items=items, last=block + 1 == blocks) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(items, window)
            for rows in batches:
                texts = (t.as_py() for t in rows.column("text"))
                n, spans, names = find_spans(texts, phrases)
                if "_spans" in rows.schema.names:
                    spans = [[*new, *_paired(old)] for new, old in zip(spans, rows.column("_spans").to_pylist(), strict=True)]
                    names = [{*new, *old} for new, old in zip(names, rows.column("_items").to_pylist(), strict=True)]
                spans = [merge_spans(x) for x in spans]
                made = {"_n": pa.array(n, pa.int64()), "_spans": pa.array([_flat(x) for x in spans], pa.list_(pa.int32())), "_items": pa.array([sorted(x) for x in names], pa.list_(pa.string()))}
                if last and cut:
                    made["text"] = pa.array([cut_words(t.as_py(), x) if x else t.as_py() for t, x in zip(rows.column("text"), spans, strict=True)], rows.schema.field("text").type)
                yield _with(rows, **made)

        rows = rows.mapInArrow(search, schema)
        if block + 1 < blocks:
            rows = stage(rows, "searched")
    if clean is not None:
        rows = rows.unionByName(clean)
    hit = F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda acc, x: acc + x).cast("long")
    own = [F.col("text") if k == "text" else F.col("_kept").getField(k).alias(k) for k in keep if k not in RESULT]
    return rows.select(*own, F.col("_n").alias("n_words"), hit.alias("n_hit"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    rows = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", contaminated())

