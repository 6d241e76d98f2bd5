"""How the XML reader hands on elements."""

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mapweave.schema import ELEMENT
from mapweave.sources.xml_elements import element_batches


def test_small_documents_share_a_batch(spark):
    text = '<osm><node id="{0}" lat="1" lon="2" v="x"/><relation id="3"><member type="way" ref="{0}" role="r"><nd lon="1" lat="2"/></member></relation></osm>'
    rows = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(500)], "payload": [text.format(i) for i in range(500)]})
    (made,) = element_batches(iter([rows]), to_arrow_schema(StructType.fromDDL(ELEMENT)))
    got = made.to_pylist()
    assert len(got) == 1000 and [got[k]["doc_id"] for k in (0, 1, 999)] == ["0", "0", "499"]
    assert got[998]["id"] == "499" and got[998]["props"] == [("v", '"x"')] and got[998]["at"] == {"x": 2.0, "y": 1.0, "key": "2,1"}
    assert got[999]["members"][0]["ref"] == "499" and got[999]["members"][0]["vertices"] == [{"ref": None, "at": {"x": 1.0, "y": 2.0, "key": "1,2"}}]


def test_large_documents_are_split(spark):
    text = "<osm>" + '<node id="1" lat="1" lon="2"/>' * 25_000 + "</osm>"
    rows = pa.RecordBatch.from_pydict({"doc_id": ["a"], "payload": [text]})
    assert [b.num_rows for b in element_batches(iter([rows]), to_arrow_schema(StructType.fromDDL(ELEMENT)))] == [10_000, 10_000, 5_000]
