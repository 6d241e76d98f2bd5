"""Joining the ways of a relation end to end."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

class _Ends:
    """Waiting lines by the key of one of their ends, oldest first; what has been taken is skipped."""

    def __init__(self) -> None:
        self.by: dict[str, deque[int]] = {}

    def put(self, key: str, line: int) -> None:
        self.by.setdefault(key, deque()).append(line)

    def first(self, key: str, waiting: list[bool]) -> int | None:
        queue = self.by.get(key)
        while queue and not waiting[queue[0]]:
            queue.popleft()
        return queue[0] if queue else None


Piece = tuple[int, bool]


def chains(heads: list[str], tails: list[str]) -> list[list[Piece]]:
    """Greedy joining of lines, known by the keys of their ends: the next waiting line is tried at both ends, then any line at the tail.

    Each result is a run of (line, turned); at a joint the second line's first
    point is dropped. Every line is taken once, so the work grows with their
    number and not with its square.
    """
    at_head, at_tail, waiting = _Ends(), _Ends(), [True] * len(heads)
    for i, (a, z) in enumerate(zip(heads, tails, strict=True)):
        at_head.put(a, i)
        at_tail.put(z, i)
    out, front = [], 0
    while front < len(heads):
        if not waiting[front]:
            front += 1
            continue
        waiting[front] = False
        # the growing line is two runs: `before` backwards, then `after`
        before: list[Piece] = []
        after: list[Piece] = [(front, False)]

        def end(piece: Piece, last: bool) -> str:
            line, turned = piece
            return tails[line] if last != turned else heads[line]

        def head() -> str:
            return end(before[-1], True) if before else end(after[0], False)

        def tail() -> str:
            return end(after[-1], True) if after else end(before[0], False)

        while True:
            while front < len(heads) and not waiting[front]:
                front += 1
            taken, turned, reverse_first = None, False, False
            if front < len(heads):
                a, z = heads[front], tails[front]
                if tail() == a:
                    taken = front
                elif tail() == z:
                    taken, turned = front, True
                elif head() == a:
                    taken, reverse_first = front, True
                elif head() == z:
                    # putting it in front and turning the whole is turning the line, then adding the other turned
                    taken, turned, reverse_first = front, True, True
            if taken is None:
                taken = at_head.first(tail(), waiting)
            if taken is None:
                taken = at_tail.first(tail(), waiting)
                turned = taken is not None
            if taken is None:
                break
            waiting[taken] = False
            if reverse_first:
                before, after = after, before
            after.append((taken, turned))
        out.append([(line, not turned) for line, turned in reversed(before)] + after)
    return out


def flatten(parts: list[dict]) -> tuple[list, list[str]]:
    """The ways and roles of a relation and all below it, from preorder parts {path, ways, roles}.

    Ways that don't exist leave the list of ways, but their roles stay, so
    later roles shift; of a part below, as many roles are taken as it has ways.
    """
    parts = sorted(parts, key=lambda p: p["path"])
    done: list[tuple[list[int], list, list]] = []

    def close(upto: int) -> None:
        while len(done) > 1 and len(done[-1][0]) > upto:
            _, ways, roles = done.pop()
            done[-1][1].extend(ways)
            done[-1][2].extend(roles[: len(ways)])

    for p in parts:
        close(len(p["path"]) - 1)
        done.append((p["path"], list(p["ways"]), list(p["roles"])))
    close(0)
    return (done[0][1], done[0][2]) if done else ([], [])


class _Coordinates:
    """The points of all ways of a batch, and where each way's begin."""

    def __init__(self, ways: pa.ListArray) -> None:
        sizes = ways.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x, y, key = ways.flatten().flatten()
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        # what is no number is null here and NaN in numpy
        self.points = np.stack([p.to_numpy(zero_copy_only=False).astype(float) for p in (x, y)], axis=1)
        whole = np.flatnonzero(sizes > 0)
        self.heads: dict[int, str] = dict(zip(whole.tolist(), key.take(pa.array(self.starts[whole])).to_pylist(), strict=True))
        self.tails: dict[int, str] = dict(zip(whole.tolist(), key.take(pa.array(self.starts[whole + 1] - 1)).to_pylist(), strict=True))

    def stitch(self, ways: list[int]) -> list[np.ndarray]:
        """Places of the points of each joined line."""
        ways = [w for w in ways if w in self.heads]
        out = []
        for run in chains([self.heads[w] for w in ways], [self.tails[w] for w in ways]):
            pieces = []
            for k, (line, turned) in enumerate(run):
                at = np.arange(self.starts[ways[line]], self.starts[ways[line] + 1])
                at = at[::-1] if turned else at
                pieces.append(at[1:] if k else at)
            out.append(np.concatenate(pieces))
        return out

    def lines(self, rows: list[list[np.ndarray]]) -> pa.Array:
        """Per row its lines as lists of [x, y]."""
        every = [line for row in rows for line in row]
        at = np.concatenate(every) if every else np.empty(0, np.int64)
        values = self.points[at].ravel()
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(at) + 1, 2), pa.int32()), pa.array(values, mask=np.isnan(values)))
        each = pa.ListArray.from_arrays(_offsets([len(x) for x in every]), pairs)
        return pa.ListArray.from_arrays(_offsets([len(r) for r in rows]), each)


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


LINES = "array<array<array<double>>>"


def stitched(parts: Column, polygon: Column) -> Column:
    """struct<outer, inner, line> of stitched strings from parts; ``polygon`` chooses outer and inner over line.

    Points stay in Arrow arrays: Python handles one object a way, not one a point.
    """

    @F.arrow_udf(f"struct<outer:{LINES},inner:{LINES},line:{LINES}>")
    def run(rows: pa.Array, areas: pa.Array) -> pa.Array:
        path, ways, roles = rows.flatten().flatten()
        points = _Coordinates(ways.flatten())
        first_way = np.concatenate([[0], np.cumsum(ways.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]).tolist()
        path, roles = path.to_pylist(), roles.to_pylist()
        found: dict[str, list[list[np.ndarray]]] = {"outer": [], "inner": [], "line": []}
        at = 0
        for size, area in zip(rows.value_lengths().to_pylist(), areas.to_pylist(), strict=True):
            every, named = flatten([{"path": path[k], "ways": range(first_way[k], first_way[k + 1]), "roles": roles[k]} for k in range(at, at + size)])
            at += size
            for role in ("outer", "inner"):
                found[role].append(points.stitch([w for w, r in zip(every, named, strict=False) if r == role]) if area else [])
            found["line"].append([] if area else points.stitch(every))
        return pa.StructArray.from_arrays([points.lines(found[k]) for k in found], list(found))

    return run(parts, polygon)
