"""Expansion of relations in Arrow batches."""

import pyarrow as pa
import pytest

from mapweave.operators.relations import below, expanded

EDGES = pa.list_(pa.struct([("from", pa.string()), ("i", pa.int32()), ("ref", pa.string())]))


def batch(*documents):
    ids, every, roots, edges = zip(*documents, strict=True)
    columns = [pa.array(ids), pa.array(every, pa.list_(pa.string())), pa.array(roots, pa.list_(pa.string())), pa.array(edges, EDGES)]
    return iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "every", "roots", "edges"])])


def edge(above, i, ref):
    return {"from": above, "i": i, "ref": ref}


def test_many_relations_are_handed_on_in_small_batches():
    below_ = [f"c{k}" for k in range(25_000)]
    made = list(expanded(batch(("d", ["r", *below_], ["r"], [edge("r", k, c) for k, c in enumerate(below_)]))))
    assert max(b.num_rows for b in made) <= 10_000
    assert [x["id"] for b in made for x in b.to_pylist()] == ["r", *below_]


@pytest.mark.parametrize("deep", [3, 3000])
def test_same_as_below(deep):
    ids = [str(k) for k in range(deep + 1)]
    edges = [e for k in range(deep) for e in ([edge(ids[k], 4, ids[k + 1])] + ([edge(ids[k], 1, ids[deep])] if deep < 9 else []))]
    edges = [*edges, edge(None, 0, "0")]
    got = [(x["root"], x["path"], x["id"]) for b in expanded(batch(("d", ids, ["0", "2"], edges))) for x in b.to_pylist()]
    assert got == list(below(["0", "2"], edges))


def test_a_cycle_stays_with_its_document():
    loop = [edge("a", 0, "b"), edge("b", 0, "c"), edge("c", 0, "b")]
    rows = [x for b in expanded(batch(("x", ["a", "b", "c"], ["a"], loop), ("y", ["a"], None, None), ("z", ["a"], ["a"], None))) for x in b.to_pylist()]
    assert [(x["doc_id"], x["root"], x["error"]) for x in rows] == [("x", None, "a relation contains itself: b > c > b"), ("z", "a", None)]
