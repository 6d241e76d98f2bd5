"""Nulls, large, textual and repeated keys, clashing names and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from mapweave.llm import chat_format, decontaminate, lm_score, near_dedup, packing, pii, quality_rules, secrets, sharding, url_filter

#: What binary floats can't hold.
LARGE = 2**53 + 1
CLASH = ("text", "key", "sig", "bits", "n_words", "n_hit", "items", "spans", "base", "found", "_text", "_kept", "_t", "_n", "row", "_at", "_hit", "label", "rep", "order", "ids", "kept", "name")

OPERATORS = {
    "near_dedup": near_dedup.near_duplicates,
    "pii": lambda d: pii.digest(pii.find_pii(d)),
    "sharding": sharding.assign_shards,
    "lm_score": lm_score.score,
    "packing": packing.pack,
    "secrets": lambda d: secrets.digest(secrets.find_secrets(d)),
    "decontaminate": lambda d: decontaminate.digest(decontaminate.find_contamination(d, d.select(F.lit(1).alias("item_id"), F.lit("a b c").alias("text")).limit(1))),
    "quality_rules": lambda d: quality_rules.judge(d, d.select("doc_id", F.lit(1).alias("quality"))),
}


def table(spark, ids, kind):
    texts = [None, "", "a@b.co one two three four five six", "a@b.co one two three four five six", "x " * 3000, "y"]
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    # every name that an operator uses inside
    return docs.select("doc_id", "text", *(F.lit("clash").alias(c) for c in CLASH if c != "text"))


@pytest.mark.parametrize("name", OPERATORS)
def test_keys_pass_unchanged(spark, name):
    for ids, kind in (([LARGE, None, LARGE + 1, 7, None, LARGE], "long"), (["b", None, "x y", "a", None, "b"], "string")):
        got = OPERATORS[name](table(spark, ids, kind)).select("doc_id").collect()
        if name == "packing":
            assert {r[0] for r in got} == set(ids)
        else:
            assert sorted(map(repr, (r[0] for r in got))) == sorted(map(repr, ids))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs = table(spark, [1, 2, 3, 4, 5, 6], "long")
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_kept_columns_with_inner_names(spark):
    docs = table(spark, [1, 2, 3, 4, 5, 6], "long")
    keep = ("doc_id", *CLASH)
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    made = {
        "pii": (pii.find_pii(docs, keep), ("base", "spans")),
        "secrets": (secrets.find_secrets(docs, keep), ("base", "spans")),
        "decontaminate": (decontaminate.find_contamination(docs, benchmark, keep), decontaminate.RESULT),
        "quality_rules": (quality_rules.judge(docs, labels, keep), quality_rules.RESULT),
    }
    for name, (rows, own) in made.items():
        assert len(set(rows.columns)) == len(rows.columns), name
        first = rows.where("doc_id = 3").first()
        assert all(first[c] == "clash" for c in CLASH if c not in own and c != "text"), name
        assert first["text"].startswith("a@b.co"), name


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, a), (5, a + " end"), (5, b), (7, b + " end"), (None, a), (None, "lone words"), (None, "lone words"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, near_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted(
        f"Row(doc_id={i}, component_id={c}, kept={k})"
        for i, c, k in [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (None, 3, False), (None, None, True), (None, None, True), (9, 9, True), (9, 9, True)]
    )
    left = near_dedup.without_duplicates(docs).collect()
    assert sorted(map(repr, left)) == sorted(map(repr, [r for r in left if tuple(r) in {(3, a), (None, "lone words"), (9, None), (9, "")}]))
    assert len(left) == 3 and {r["doc_id"] for r in left} == {3, None, 9}


def test_near_duplicates_name_the_smallest_text_id(spark):
    words = " ".join(f"a{k}" for k in range(40))
    docs = spark.createDataFrame([("z", words), ("b", words + " end"), ("c", words)], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()} == {("z", "b", False), ("b", "b", True), ("c", "b", False)}


def test_chat_keys_and_names(spark):
    rows = [(LARGE, 0, "user", "a"), (None, 0, "user", None), (LARGE, 1, "assistant", "b"), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("segments", "turns", "formatted", "valid", "row")})
    got = {r["conv_id"]: r["n_turns"] for r in chat_format.digest(chat_format.format_conversations(df)).collect()}
    assert got == {LARGE: 2, None: 2}


def test_url_keys_and_names(spark):
    df = spark.createDataFrame([(LARGE, "http://a.net/"), (None, None), (LARGE, "http://a.net/")], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "n", "by_rule")})
    got = sorted((repr(r["page_id"]), r["host"], r["verdict"]) for r in url_filter.filter_urls(df).collect())
    assert got == sorted([(repr(LARGE), "a.net", "block")] * 2 + [("None", "", "allow")])
