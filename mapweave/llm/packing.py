"""Vector bin packing of token sequences by the dot-product heuristic.

Each task tokenizes its documents and packs them as they come. A document is
ids plus one end id, of which those from ``loss_from`` on bear loss. Whole
sequences' worth is cut off long documents; what is left waits in a pool until
it holds ``POOL`` pieces and a bin's worth of tokens, or a bin's worth of
segments. A bin is filled with the piece that fits and whose
demand (tokens, one segment, loss-bearing tokens) has the largest dot product
with what the bin has left; where none fits, the best is cut to fill the gap.
The task's last, unfilled bin is dealt into sequences of powers of two.

So padding arises only where the segment or loss limit closes a bin early.
Nothing is shuffled; memory is the pool and one text with its ids.

Defined results: a null or empty text is its end id alone; repeated rows and
rows with a null doc_id are packed each; a text of any length is cut into
pieces; doc_id passes unchanged, whatever its type; a null ``loss_from`` is 0;
pieces that tie are taken in the order of their arrival; an empty table gives
an empty result; other columns are ignored, whatever their names. Limits below
1 are refused. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END_ID = 1
POOL = 128
LONG_RUN = 2_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError(f"a sequence needs room for a token, a segment and a loss-bearing token: {self}")


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library; special strings in a text are ordinary text.

    The merges are run by tiktoken, which gives the same ids over three times
    as fast; texts with very long runs without a break go to tokenizers.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.path, self.slow = path, None
        vocabulary = held["model"]["vocab"]
        special = {t["content"] for t in held["added_tokens"]}
        del held
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN:
            words = text.split()
            if max(map(len, words), default=0) >= LONG_RUN or len(text) - sum(map(len, words)) - len(words) >= LONG_RUN:
                return self._slowly(text)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def _slowly(self, text: str) -> np.ndarray:
        if self.slow is None:  # loaded where it is needed alone, for its memory
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE files write bytes: printable ones stand for themselves, the others follow from 256 on."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    total: int
    loss_from: int

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total, self.loss_from), Piece(self.doc, self.start + at, self.ids[at:], self.total, self.loss_from)

    def within_loss(self, limit: int) -> int:
        """The longest head with at most so many loss-bearing tokens."""
        return min(len(self.ids), max(0, self.loss_from - self.start) + limit)


class Packer:
    def __init__(self, limits: Limits, first_id: int) -> None:
        self.limits, self.next_id = limits, first_id
        self.pool: list[Piece] = []
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        cap = self.limits
        while len(piece.ids) >= cap.tokens and piece.within_loss(cap.loss) >= cap.tokens:
            whole, piece = piece.split(cap.tokens)
            self._emit([whole])
        if len(piece.ids):
            self.pool.append(piece)
            self.waiting += len(piece.ids)
        while len(self.pool) >= max(POOL, cap.segments) or (len(self.pool) >= POOL and self.waiting >= cap.tokens):
            self._emit(self._fill(cap.tokens))

    def finish(self) -> None:
        while self.pool:
            left = sum(len(p.ids) for p in self.pool)
            self._emit(self._fill(self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1)))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, self.next_id, offset))
            offset += len(p.ids)
        self.next_id += 1

    def _fill(self, tokens: int) -> list[Piece]:
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        room = np.array([tokens, self.limits.segments, self.limits.loss], float)
        need = np.array([(len(p.ids), 1, p.loss) for p in self.pool], float)
        free = np.ones(len(self.pool), bool)
        out: list[Piece] = []
        cut: list[Piece] = []
        while room[0] >= 1 and room[1] >= 1 and free.any():
            worth = (need / cap) @ (room / cap)
            fits = free & (need <= room).all(axis=1)
            k = int(np.argmax(np.where(fits if fits.any() else free, worth, -1.0)))
            piece = self.pool[k]
            free[k] = False
            if not fits[k]:
                at = int(min(room[0], piece.within_loss(int(room[2]))))
                if at < 1:
                    cut.append(piece)
                    continue
                piece, rest = piece.split(at)
                if len(rest.ids):
                    cut.append(rest)
            out.append(piece)
            self.waiting -= len(piece.ids)
            room -= (len(piece.ids), 1, piece.loss)
        self.pool = [p for p, f in zip(self.pool, free, strict=True) if f] + cut
        return out


PIECES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str | None = None, limits: Limits | None = None) -> DataFrame:
    """(doc_id, text, optional loss_from) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    limits = limits or Limits()
    masked = "loss_from" in docs.columns

    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in PIECES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = Encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        packer, ids_as = None, None

        def made() -> pa.RecordBatch:
            columns = list(zip(*packer.take(), strict=True)) or [()] * (1 + len(PIECES))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids_as), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", *PIECES])

        for rows in batches:
            if not rows.num_rows:
                continue
            ids_as = rows.schema.field("doc_id").type
            packer = packer or Packer(limits, rows.column("_part")[0].as_py() << 40)
            starts = rows.column("loss_from") if masked else None
            for k, (doc, text) in enumerate(zip(rows.column("doc_id"), rows.column("text"), strict=True)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                packer.add(Piece(doc.as_py(), 0, ids, len(ids), int(starts[k].as_py() or 0) if masked else 0))
            yield made()
        if packer:
            packer.finish()
            yield made()

    # sequences are numbered within partitions, whose number is a column: a task may be given several
    return docs.select("doc_id", "text", *(["loss_from"] if masked else []), F.spark_partition_id().alias("_part")).mapInArrow(run, T.StructType(fields))
