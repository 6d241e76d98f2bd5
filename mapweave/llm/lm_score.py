"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts every token from the ``SPAN`` tokens on either side of
it, never from the token itself; a document's score is the sum of the
log-probabilities. Its output is a softmax in two steps: the class of a word,
then the word among those of its class; the ``WORDS`` most frequent words of
the corpus are dealt into ``CLASSES`` classes of equal frequency. All other
words make one more class, and inside it a word has its share of the corpus's
full counts if it occurs ``LISTED`` times or more (this list grows with the
corpus, up to ``MOST_LISTED`` words, the most frequent); the rarer ones share
what is left by their spelling, a chain over bytes counted on the rare words of
the whole corpus. So every word is predicted as itself. As context, the other
words are known by one of ``BUCKETS`` hashes.

1. Words are counted over all texts.
2. Texts become token numbers, written once.
3. Training takes a gradient step at every position of every text, in numpy.
   Documents are dealt by a hash of key and text into shards of about
   ``SHARD_TOKENS`` tokens, and by that hash into an order; each shard starts
   from the same weights. The shards' changes are averaged in levels by weight
   chunk, so what is gathered grows with the input and no task or driver holds
   more than its share. Shards follow from the corpus alone, so scores don't
   depend on how its files are split.
4. All token numbers are scored.

Defined results: a null, empty or wordless text has no tokens, a score of 0
and no mean; texts of any length are trained on and scored whole; words that
tie in frequency sort by their bytes; repeated rows and rows with a null
doc_id score alike if their texts are; doc_id passes unchanged, whatever its
type; an empty table gives an empty result; other columns are ignored,
whatever their names. Scores are rounded to four digits; the sums depend on
the numpy build beyond that.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm.common import discard, stage

WORDS, CLASSES, BUCKETS = 4096, 64, 512
LISTED, MOST_LISTED = 8, 200_000
SPAN, WIDTH = 2, 16
OFFSETS = tuple(o for o in range(-SPAN, SPAN + 1) if o)
KNOWN = 1 + WORDS + BUCKETS
BATCH, RATE = 8192, 0.1
SHARD_TOKENS = 1_000_000
BLOCK = 16384
#: The sign before and after a word's bytes.
EDGE = 256
CHUNKS, FAN = 32, 64
COUNTED_AT_ONCE = 200_000


@dataclass
class Classes:
    """Words 1 to WORDS in the order of their frequency, cut into classes 1 to CLASSES of consecutive words; class 0 holds all others."""

    #: Where each class begins among the words, with the end of the last.
    starts: np.ndarray
    #: The class of each number; 0 for 0 and for words without a number.
    number: np.ndarray
    #: The log share of each word among all.
    prior: np.ndarray
    #: The log share of each class, that of the other words first.
    class_prior: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, others: float) -> Classes:
        """From the counts of the words, most frequent first: fewer than WORDS leave numbers unused."""
        n = np.full(WORDS, 0.5)
        n[: len(counts)] = counts
        before = np.concatenate([[0], np.cumsum(np.sqrt(n))])
        cuts = np.searchsorted(before, before[-1] * np.arange(1, CLASSES) / CLASSES)
        starts = np.concatenate([[0], cuts, [WORDS]])
        starts = np.maximum.accumulate(np.maximum(starts, np.concatenate([np.arange(CLASSES), [WORDS]])))
        whole = np.concatenate([[others + 1], np.add.reduceat(n, starts[:-1])])
        number = np.zeros(WORDS + 2, np.int16)
        number[1:-1] = np.searchsorted(starts, np.arange(WORDS), side="right")
        return cls(starts.astype(np.int64), number, np.log(n / n.sum()).astype(np.float32), np.log(whole / whole.sum()).astype(np.float32))


class Network:
    """Embeddings by offset, one hidden layer, two softmaxes; weights in one flat vector."""

    SHAPES = ((len(OFFSETS), KNOWN, WIDTH), (WIDTH,), (WIDTH, CLASSES + 1), (CLASSES + 1,), (WORDS, WIDTH), (WORDS,))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray, classes: Classes) -> None:
        self.flat, self.classes = flat, classes
        self.embed, self.shift, self.top, self.top_bias, self.low, self.low_bias = self.views(flat)

    @classmethod
    def views(cls, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in cls.SHAPES:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    @classmethod
    def fresh(cls, classes: Classes) -> Network:
        random = np.random.default_rng(11)
        net = cls(np.zeros(cls.SIZE, np.float32), classes)
        for part in (net.embed, net.top, net.low):
            part[:] = random.normal(0, 0.1, part.shape)
        net.top_bias[:], net.low_bias[:] = classes.class_prior, classes.prior
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.embed[0][context[:, 0]] + self.shift
        for k in range(1, len(OFFSETS)):
            z += self.embed[k][context[:, k]]
        return np.tanh(z, out=z)

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """Rows in the order of their target's class, the classes in that order, and (first and last word, from and to row) of those with more than one word."""
        own = self.classes.number[np.minimum(target, WORDS + 1)]
        order = np.argsort(own, kind="stable")
        own = own[order]
        edges = np.searchsorted(own, np.arange(1, CLASSES + 2)).tolist()
        starts = self.classes.starts.tolist()
        return order, own, [(starts[c], starts[c + 1], edges[c], edges[c + 1]) for c in range(CLASSES) if edges[c] < edges[c + 1] and starts[c + 1] - starts[c] > 1]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target; for a word without a number, of the class of such words."""
        order, own, held = self.by_class(target)
        hidden, target = self.hidden(context[order]), target[order]
        out = _chosen(hidden @ self.top + self.top_bias, own)
        for s, e, a, b in held:
            out[a:b] += _chosen(hidden[a:b] @ self.low[s:e].T + self.low_bias[s:e], target[a:b] - (1 + s))
        back = np.empty_like(out)
        back[order] = out
        return back

    def step(self, context: np.ndarray, target: np.ndarray, held: list[np.ndarray]) -> None:
        """One step of Adagrad on the summed gradients; ``held``: the sums of their squares."""
        seen_embed, seen_shift, seen_top, seen_top_bias, seen_low, seen_low_bias = held
        order, own, classes = self.by_class(target)
        context, target = context[order], target[order]
        hidden = self.hidden(context)
        miss = _miss(hidden @ self.top + self.top_bias, own)
        back = miss @ self.top.T
        for s, e, a, b in classes:
            h, words = hidden[a:b], self.low[s:e]
            inner = _miss(h @ words.T + self.low_bias[s:e], target[a:b] - (1 + s))
            back[a:b] += inner @ words
            _descend(words, seen_low[s:e], inner.T @ h)
            _descend(self.low_bias[s:e], seen_low_bias[s:e], inner.sum(axis=0))
        _descend(self.top, seen_top, hidden.T @ miss)
        _descend(self.top_bias, seen_top_bias, miss.sum(axis=0))
        back *= 1 - hidden * hidden
        _descend(self.shift, seen_shift, back.sum(axis=0))
        # rows of all offsets' embeddings at once; two-byte numbers sort in linear time
        ids = (context + np.arange(len(OFFSETS)) * KNOWN).astype(np.int16).ravel()
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        slope, at = np.add.reduceat(back[by // len(OFFSETS)], first, axis=0), ids[first]
        embed, seen = self.embed.reshape(-1, WIDTH), seen_embed.reshape(-1, WIDTH)
        squares = seen[at] + slope * slope
        seen[at] = squares
        embed[at] -= np.float32(RATE) * slope / np.sqrt(squares)


def _chosen(logits: np.ndarray, which: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    picked = logits[np.arange(len(which)), which].copy()
    return picked - np.log(np.exp(logits, out=logits).sum(axis=1))


def _miss(logits: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Probabilities less the truth: the gradient by the logits."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    logits[np.arange(len(which)), which] -= 1
    return logits


def _descend(weights: np.ndarray, seen: np.ndarray, slope: np.ndarray) -> None:
    seen += slope * slope
    weights -= RATE * slope / np.sqrt(seen)


@dataclass
class Others:
    """Log-probabilities of words among those without a number."""

    share: dict[bytes, float]
    rare: float
    spelling: np.ndarray

    def total(self, words: list[bytes]) -> float:
        out, rare = 0.0, []
        for w in words:
            log = self.share.get(w)
            if log is None:
                rare.append(w)
                log = self.rare
            out += log
        if rare:
            x = _letters(rare)
            for at in range(0, len(x) - 1, BLOCK):
                out += float(self.spelling[x[at : at + BLOCK][: len(x) - 1 - at], x[at + 1 : at + 1 + BLOCK]].sum())
        return out


def _letters(words: list[bytes]) -> np.ndarray:
    """The bytes of words, EDGE around each; no word holds a blank."""
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    x[x == 32] = EDGE
    return x


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for rows in batches:
            for text in rows.column("text"):
                held.update(split_words(text.as_py()))
                if len(held) > COUNTED_AT_ONCE:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def other_words(counts: DataFrame, top: dict[bytes, int]) -> Others:
    """From (word, n) of the corpus and the numbers of the words that have one."""
    names = list(top)
    known = counts.sparkSession.createDataFrame([(w,) for w in names], "word binary")
    rest = stage(counts.join(F.broadcast(known), "word", "left_anti"), "others")
    listed = rest.where(F.col("n") >= LISTED).orderBy(F.desc("n"), "word").limit(MOST_LISTED).collect()
    whole = float((rest.agg(F.sum("n")).first()[0] or 0) + 1)
    least = listed[-1]["n"] if len(listed) == MOST_LISTED else LISTED
    last = bytes(listed[-1]["word"]) if listed else b""
    rare = rest.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(last))) if len(listed) == MOST_LISTED else F.col("n") < LISTED)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((EDGE + 1) ** 2)
        for rows in batches:
            if len(rows):
                words = [bytes(w) for w in rows["word"]]
                x = _letters(words)
                held += np.bincount(x[:-1] * (EDGE + 1) + x[1:], np.append(np.repeat(rows["n"].to_numpy(float), [len(w) + 1 for w in words]), 0)[: len(x) - 1], len(held))
        at = np.flatnonzero(held)
        yield pd.DataFrame({"step": at, "n": held[at].astype(np.int64)})

    chain = np.ones((EDGE + 1) ** 2)
    for r in rare.mapInPandas(steps, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        chain[r["step"]] += r["n"]
    chain = chain.reshape(EDGE + 1, EDGE + 1)
    # the one added is for words that the corpus lacks
    left = whole - sum(r["n"] for r in listed)
    discard(rest)
    return Others({bytes(r["word"]): float(np.log(r["n"] / whole)) for r in listed}, float(np.log(left / whole)), np.log(chain / chain.sum(axis=1, keepdims=True)))


@dataclass
class Vocabulary:
    number: dict[bytes, int]
    classes: Classes
    others: Others
    total: int

    def tokens(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter([get(w) or 1 + WORDS + zlib.crc32(w) % BUCKETS for w in words], np.int16, len(words))


def vocabulary(docs: DataFrame) -> Vocabulary:
    counts = stage(count_words(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    number = {bytes(r["word"]): k for k, r in enumerate(top, 1)}
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = np.array([r["n"] for r in top], float)
    others = other_words(counts, number)
    discard(counts)
    return Vocabulary(number, Classes.of(own, total - own.sum()), others, total)


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, text) -> doc_id, order, n_tokens, others (the log-probability of words without a number among themselves) and ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, others, ids = [], [], []
            for text in rows.column("text"):
                split = split_words(text.as_py())
                x = words.tokens(split)
                n.append(len(x))
                ids.append(x.tobytes())
                others.append(words.others.total([split[k] for k in np.flatnonzero(x > WORDS)]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("order"), pa.array(n, pa.int64()), pa.array(others, pa.float64()), pa.array(ids, pa.binary())], ["doc_id", "order", "n_tokens", "others", "ids"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("order"))
    fields = [docs.schema["doc_id"], *(T.StructField(c, t) for c, t in (("order", T.LongType()), ("n_tokens", T.LongType()), ("others", T.DoubleType()), ("ids", T.BinaryType())))]
    return rows.mapInArrow(encode, T.StructType(fields))


def contexts(ids: np.ndarray) -> np.ndarray:
    """Per token the numbers around it; 0 beyond the ends."""
    wide = np.concatenate([np.zeros(SPAN, np.int64), ids, np.zeros(SPAN, np.int64)])
    return np.stack([wide[SPAN + o : SPAN + o + len(ids)] for o in OFFSETS], axis=1)


def train(texts: Iterator[np.ndarray], flat: np.ndarray, classes: Classes) -> tuple[np.ndarray, int]:
    """The weights after a step at every position of the texts, in their order, and the number of positions."""
    net = Network(flat.copy(), classes)
    held = net.views(np.full(net.SIZE, 0.1, np.float32))
    around, target, waiting, seen = [], [], 0, 0
    for ids in texts:
        for at in range(0, len(ids), 16 * BATCH):
            # a block of a text with what stands beside it
            low, high = max(0, at - SPAN), at + 16 * BATCH + SPAN
            stop = min(len(ids), at + 16 * BATCH)
            around.append(contexts(ids[low:high])[at - low : stop - low])
            target.append(ids[at:stop])
            waiting += stop - at
            if waiting >= 16 * BATCH:
                seen += _steps(net, held, around, target)
                around, target, waiting = [], [], 0
    if waiting:
        seen += _steps(net, held, around, target)
    return net.flat, seen


def _steps(net: Network, held: list[np.ndarray], around: list[np.ndarray], target: list[np.ndarray]) -> int:
    x, y = np.concatenate(around), np.concatenate(target)
    for at in range(0, len(y), BATCH):
        net.step(x[at : at + BATCH], y[at : at + BATCH], held)
    return len(y)


def trained(rows: DataFrame, words: Vocabulary) -> np.ndarray:
    """The mean of the shards' weights, each weighing as many positions as it took."""
    flat = Network.fresh(words.classes).flat
    classes = words.classes
    shards = max(1, words.total // SHARD_TOKENS)
    size = -(-len(flat) // CHUNKS)  # the last chunk may be shorter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole shards, one after the other."""
        rows = ((s, np.frombuffer(x.as_py(), np.int16).astype(np.int64)) for b in batches for s, x in zip(b.column("shard").to_pylist(), b.column("ids"), strict=True))
        ahead = next(rows, None)

        def one(shard: int) -> Iterator[np.ndarray]:
            nonlocal ahead
            while ahead is not None and ahead[0] == shard:
                ids = ahead[1]
                ahead = next(rows, None)
                yield ids

        while ahead is not None:
            shard = ahead[0]
            net, seen = train(one(shard), flat, classes)
            change = (net - flat).astype(np.float16)
            chunks = [change[k * size : (k + 1) * size].tobytes() for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([shard] * CHUNKS, pa.int64()), pa.array([seen] * CHUNKS, pa.int64()), pa.array(chunks, pa.binary())], ["chunk", "part", "n", "change"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part", kind="stable")
        n = rows["n"].to_numpy()
        total = np.zeros(len(rows["change"].iloc[0]) // 2)
        for x, weight in zip(rows["change"], n, strict=True):
            total += np.frombuffer(x, np.float16) * float(weight)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1] // FAN, "n": n.sum(), "change": [(total / max(1, n.sum())).astype(np.float16).tobytes()]})

    shape = "chunk int, part long, n long, change binary"
    dealt = rows.where("n_tokens > 0").select(F.pmod("order", F.lit(shards)).alias("shard"), "order", "ids")
    made = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order", "ids").select("shard", "ids").mapInArrow(run, shape)
    while True:
        made = made.groupBy("chunk", F.expr(f"part div {FAN}")).applyInPandas(lambda _, rows: mean(rows), shape)
        shards = -(-shards // FAN)
        if shards == 1:
            break
    by = {r["chunk"]: np.frombuffer(r["change"], np.float16) for r in made.collect()}
    return flat + np.concatenate([by[k] for k in range(CHUNKS)]).astype(np.float32) if by else flat


Model = tuple[Vocabulary, np.ndarray]


def fit(docs: DataFrame) -> Model:
    """The words of a corpus and the weights trained on it."""
    words = vocabulary(docs)
    rows = stage(encoded(docs, words), "encoded")
    flat = trained(rows, words)
    discard(rows)
    return words, flat


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, pseudo_log_likelihood, mean_log_likelihood."""
    docs = docs.select("doc_id", "text")
    if model:
        words, flat = model
        rows = encoded(docs, words)
    else:
        words = vocabulary(docs)
        rows = stage(encoded(docs, words), "encoded")
        flat = trained(rows, words)
    classes = words.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat, classes)
        for rows in batches:
            ids = [np.frombuffer(x.as_py(), np.int16).astype(np.int64) for x in rows.column("ids")]
            totals = np.array(rows.column("others").to_pylist()) + pseudo_likelihoods(ids, net)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_tokens"), pa.array(totals, pa.float64())], ["doc_id", "n_tokens", "total"])

    made = rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("total", T.DoubleType())]))
    mean_ = F.when(F.col("n_tokens") > 0, F.round(F.col("total") / F.col("n_tokens"), 4))
    return made.select("doc_id", "n_tokens", F.round("total", 4).alias("pseudo_log_likelihood"), mean_.alias("mean_log_likelihood"))


def pseudo_likelihoods(texts: list[np.ndarray], net: Network) -> np.ndarray:
    """The summed conditional log-probabilities of each text's numbers; short texts share a block, long ones have several."""
    totals = np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal held, waiting
        if held:
            logs = net.log_probabilities(np.concatenate([x for _, x, _ in held]), np.concatenate([y for _, _, y in held]))
            np.add.at(totals, np.repeat([k for k, _, _ in held], [len(y) for _, _, y in held]), logs.astype(np.float64))
        held, waiting = [], 0

    for k, ids in enumerate(texts):
        for at in range(0, len(ids), BLOCK):
            low = max(0, at - SPAN)
            stop = min(len(ids), at + BLOCK)
            held.append((k, contexts(ids[low : stop + SPAN])[at - low : stop - low], ids[at:stop]))
            waiting += stop - at
            if waiting >= BLOCK:
                flush()
    flush()
    return totals
