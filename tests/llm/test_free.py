"""The operators with numpy inside, and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mapweave.llm import decontaminate as dc
from mapweave.llm import lm_score, near_dedup, packing, url_filter

EDGES = [None, "", " \n", "one", "one two three four", "One two three FOUR", "é É"]


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "klmnprst" for b in ("a", "e", "io", "u")]
    base = [[r.choice(words) + str(r.randrange(9)) for _ in range(r.randrange(5, 80))] for _ in range(30)]
    texts = []
    for b in base:
        for _ in range(r.randrange(1, 8)):
            w = list(b)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    return [*EDGES, *texts, *[texts[0]] * 60, *[texts[1] + f" tail{i % 50}" for i in range(90)]]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs_of):
    texts = corpus()
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(*texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert [rows[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows.values())


def test_near_duplicates_of_nothing(docs_of):
    assert near_dedup.near_duplicates(docs_of("x").limit(0)).count() == 0
    same = near_dedup.near_duplicates(docs_of("a b").unionByName(docs_of("a b"))).collect()
    assert [(r["component_id"], r["kept"]) for r in same] == [(0, True)] * 2


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in ((i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1))] + [(1000, 1001)], "a long, b long")
    labels = {r["node"]: r["label"] for r in near_dedup.components(links).collect()}
    assert labels == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_regions_split_and_keep_all_pairs():
    n = 200
    tree, k1, k2, rep, size = np.zeros(n, int), np.zeros(n, int), np.repeat(np.arange(10) << 16, 20), np.arange(n), np.full(n, 9)
    i, j = near_dedup.region_pairs(tree, k1, k2, rep, size, rep)
    got = {(a, b) for a, b in zip(i, j, strict=True)}
    assert all((20 * g + a, 20 * g + b) in got for g in range(10) for a in range(20) for b in range(a + 1, 20))
    i, j = near_dedup.region_pairs(tree, k1, k2, rep, size, rep, nearest=True)
    assert (i == np.arange(n - 1)).all() and (j == i + 1).all()  # nearest neighbours also across its regions


def test_near_duplicates_in_a_large_region(docs_of):
    base = [f"b{k}" for k in range(204)]
    family = [base + [f"t{i}x{k}" for k in range(4)] for i in range(300)]
    # each linked with one member of the family alone
    lone = [[f"s{i}x{k}" for k in range(29)] + family[i][29:] for i in range(20)]
    rows = near_dedup.near_duplicates(docs_of(*map(" ".join, family + lone))).collect()
    assert {r["component_id"] for r in rows} == {0} and len(rows) == 320


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 300])
def test_decontamination(spark, docs_of, block_bytes):
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "日本"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate((3, 13, 14, 30, 30, 1))] + [(9, None), (10, "..."), (None, "w1"), (11, "only one"), (11, "only one")]
    pieces = [t for _, t in items[1:5]]
    texts = [*EDGES, *(" ".join(r.choice([*vocabulary, "zzz", *pieces[k % 4 : k % 4 + 1]]) for _ in range(60)).upper() for k in range(20)), *pieces, "w3 " * 3000]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {x["doc_id"]: x for x in dc.digest(dc.find_contamination(docs_of(*texts), benchmark, block_bytes=block_bytes)).collect()}
    windows = {}
    for k, t in items:
        w = words(t)
        for at in range(max(1, len(w) - 12) if w and k is not None else 0):
            windows.setdefault(tuple(w[at : at + 13]), set()).add(str(k))
    for d, text in enumerate(texts):
        w, hit, names = words(text), set(), set()
        for at in range(len(w)):
            for n in {len(x) for x in windows}:
                if at + n <= len(w) and (found := windows.get(tuple(w[at : at + n]))):
                    hit |= set(range(at, at + n))
                    names |= found
        want = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w))
        assert tuple(rows[d][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    assert dc.digest(dc.find_contamination(docs_of("w1 w2"), benchmark.limit(0))).first()["n_hit"] == 0
    assert dc.find_contamination(docs_of("x").limit(0), benchmark).count() == 0


def test_cut_words():
    assert dc.cut_words("a, B; c! é d.", [(1, 3)]) == "a, ! é d."
    assert dc.cut_words("a b", []) == "a b"


def test_index_counts_and_locates():
    r = np.random.default_rng(2)
    symbols = np.concatenate([r.integers(0, 5, 500), [0]])
    index = dc.FmIndex(symbols, 4)
    for n in (1, 2, 3):
        for pattern in r.integers(1, 5, (20, n)):
            row = np.zeros((1, 4), np.int64)
            row[0, 4 - n :] = pattern
            low, high = index.search(row)
            at = sorted(index.locate(np.arange(low[0], high[0])))
            assert at == [k for k in range(len(symbols) - n + 1) if (symbols[k : k + n] == pattern).all()]


def test_packing(docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    texts = [*EDGES, "<|endoftext|> it's 12 ééé  \n\n x", "a" * 6_000, " " * 5_000 + "b", *(f"text number {i} " * (i * 7 % 900) for i in range(60))]
    rows = packing.pack(docs_of(*texts)).collect()
    for d, text in enumerate(texts):
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == list(np.cumsum([0, *(r["length"] for r in mine)])[:-1]) and sum(r["length"] for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids) for r in mine)
    for s in {r["sequence_id"] for r in rows}:
        mine = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        total = sum(r["length"] for r in mine)
        assert [r["offset"] for r in mine] == list(np.cumsum([0, *(r["length"] for r in mine)])[:-1])
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(docs_of("x").limit(0)).count() == 0


def test_packing_limits():
    packer = packing.Packer(packing.Limits(tokens=16, segments=3, loss=5), 0)
    r = random.Random(1)
    for d in range(300):
        n = r.randrange(1, 40)
        packer.add(packing.Piece(d, 0, np.arange(n, dtype=np.uint32), n, r.randrange(n + 1)))
    packer.finish()
    rows = packer.take()
    by = Counter()
    for d, start, length, *_, sequence, _ in rows:
        by[sequence] += length
    assert max(by.values()) <= 16 and max(Counter(x[5] for x in rows).values()) <= 3
    assert sum(by.values()) == sum({d: n for d, _, _, _, n, _, _ in rows}.values())


def test_packing_by_loss(spark):
    """Where few tokens bear loss, their limit decides and sequences mix texts of either kind."""
    rows = [(i, "word " * 30, (0 if i % 2 else 28) if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss_from long").coalesce(1)
    packed = packing.pack(docs, limits=packing.Limits(tokens=512, segments=64, loss=128)).collect()
    loss = Counter()
    for r in packed:
        first = rows[r["doc_id"]][2] or 0
        loss[r["sequence_id"]] += max(0, r["start"] + r["length"] - max(first, r["start"]))
    assert max(loss.values()) <= 128 and max(Counter(r["sequence_id"] for r in packed).values()) <= 64
    assert sum(n >= 120 for n in loss.values()) > 0.9 * len(loss)
    with pytest.raises(ValueError, match="room"):
        packing.Limits(loss=0)


def test_encoder_on_random_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    encode, r = packing.Encoder(path), random.Random(8)
    signs = [chr(c) for low, high in ((9, 127), (0xA0, 0x600), (0x2000, 0x2100), (0x3040, 0x3100), (0x1F600, 0x1F650)) for c in range(low, high)]
    for _ in range(300):
        text = "".join(r.choice(signs) * r.choice((1, 1, 1, 2, 3)) for _ in range(r.randrange(200)))
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids, text


def test_packing_of_short_texts_waits_for_a_limit():
    packer = packing.Packer(packing.Limits(), 0)
    for d in range(1024):
        packer.add(packing.Piece(d, 0, np.arange(3, dtype=np.uint32), 3, 0))
    assert set(Counter(r[5] for r in packer.take()).values()) == {256}  # the segment limit
    for d in range(1024):
        packer.add(packing.Piece(d, 0, np.arange(12, dtype=np.uint32), 12, 0))
    by = Counter()
    for r in packer.take():
        by[r[5]] += r[2]
    assert set(by.values()) == {2048}


def lm_corpus():
    r = random.Random(4)
    return [*EDGES, *(" ".join(f"{a} {a}x" for a in r.choices("abcdefgh", k=40)) for _ in range(200)), " ".join(r.choices("abcdefgh", k=400)), "a ax " * 10_000]


def test_lm_score(docs_of):
    texts = lm_corpus()
    docs = docs_of(*texts).repartition(3)
    words, flat = lm_score.fit(docs)
    rows = {x["doc_id"]: x for x in lm_score.score(docs, (words, flat)).collect()}
    assert len(rows) == len(texts)
    assert (rows[0]["n_tokens"], rows[0]["pseudo_log_likelihood"], rows[0]["mean_log_likelihood"]) == (0, 0.0, None)
    regular = np.mean([rows[k]["mean_log_likelihood"] for k in range(7, 207)])
    assert regular > rows[207]["mean_log_likelihood"] + 0.1
    # the network never sees the token it predicts; its classes and words add up to one
    ids, net = words.tokens(lm_score.split_words(texts[10])).astype(np.int64), lm_score.Network(flat, words.classes)
    around = lm_score.contexts(ids)
    changed = ids.copy()
    changed[5] = 1 + ids[5] % 8
    assert np.array_equal(around[5], lm_score.contexts(changed)[5])
    every = net.log_probabilities(np.repeat(around[5:6], lm_score.WORDS + 1, 0), np.arange(1, lm_score.WORDS + 2))
    assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-3
    one_by_one = sum(float(net.log_probabilities(around[k : k + 1], ids[k : k + 1])[0]) for k in range(len(ids)))
    assert abs(one_by_one - rows[10]["pseudo_log_likelihood"]) < 0.01


def test_lm_training_against_a_plain_loop(docs_of):
    texts = lm_corpus()
    words, flat = lm_score.fit(docs_of(*texts))
    docs = docs_of(*texts)
    order = {r["doc_id"]: r["order"] for r in lm_score.encoded(docs, words).collect()}
    net = lm_score.Network.fresh(words.classes)
    start = net.flat.copy()
    held = net.views(np.full(net.SIZE, 0.1, np.float32))
    ids = [words.tokens(lm_score.split_words(texts[d])).astype(np.int64) for d in sorted(order, key=order.get)]
    around, target = [], []
    for x in ids:
        for k in range(len(x)):
            around.append([x[k + o] if 0 <= k + o < len(x) else 0 for o in lm_score.OFFSETS])
            target.append(x[k])
    # blocks of 16 steps end with a text or with 16 batches of one
    done, seen = 0, 0
    for x in ids:
        for at in range(0, len(x), 16 * lm_score.BATCH):
            seen += min(len(x) - at, 16 * lm_score.BATCH)
            if seen - done >= 16 * lm_score.BATCH:
                for k in range(done, seen, lm_score.BATCH):
                    net.step(np.array(around[k : min(seen, k + lm_score.BATCH)]), np.array(target[k : min(seen, k + lm_score.BATCH)]), held)
                done = seen
    for k in range(done, seen, lm_score.BATCH):
        net.step(np.array(around[k : k + lm_score.BATCH]), np.array(target[k : k + lm_score.BATCH]), held)
    assert seen == sum(map(len, ids))
    assert np.allclose(flat - start, net.flat - start, atol=2e-3)


def test_lm_gradient():
    counts = np.array([50.0, 30, 20, 10, 5, 5, 5, 5])
    classes = lm_score.Classes.of(counts, 40)
    net = lm_score.Network.fresh(classes)
    net.flat = net.flat.astype(np.float64)
    net = lm_score.Network(net.flat, classes)
    r = np.random.default_rng(1)
    x, y = r.integers(0, 9, (40, 4)), r.integers(1, 9, 40)
    before, held = net.flat.copy(), net.views(np.zeros(net.SIZE))
    probe = lm_score.Network(before.copy(), classes)
    net.step(x, y, held)
    squares = np.concatenate([h.ravel() for h in held])
    moved = np.flatnonzero(squares > 1e-6)
    for k in r.choice(moved, 25):
        values = []
        for side in (1e-4, -1e-4):
            probe.flat[:] = before
            probe.flat[k] += side
            values.append(-probe.log_probabilities(x, y).sum())
        assert abs((values[0] - values[1]) / 2e-4) == pytest.approx(np.sqrt(squares[k]), rel=1e-2, abs=1e-4)


def test_lm_score_does_not_depend_on_files(docs_of):
    texts = lm_corpus()
    a, b = (np.array(sorted((r["doc_id"], r["n_tokens"], r["pseudo_log_likelihood"]) for r in lm_score.score(docs_of(*texts).repartition(n)).collect())) for n in (1, 5))
    assert np.allclose(a, b, rtol=1e-5, atol=1e-3)  # blocks of other texts may round otherwise
    assert lm_score.score(docs_of("x").limit(0)).count() == 0


def test_lm_score_tells_words_without_a_number_apart(docs_of):
    known = [f"w{k}" for k in range(6000)]
    words, flat = lm_score.fit(docs_of(*[" ".join(known)] * 8))
    listed = next(w for w in known if w.encode() not in words.number)
    a, b = (r["pseudo_log_likelihood"] for r in lm_score.score(docs_of(f"w0 {listed} w1", "w0 qzj w1"), (words, flat)).orderBy("doc_id").collect())
    assert a > b + 1


def test_url_filter(spark):
    urls = {
        "https://a.NET/x": ("a.net", "/x", "net/", "block"), "http://www.example.net/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "ftp://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"), "no scheme": ("", "", None, "allow"), "a://b://c": ("b:", "//c", None, "allow"), "x://net": ("net", "", None, "allow"),
        "https://best.casino.com/": ("best.casino.com", "/", None, "block"), "https://casinos.com/": ("casinos.com", "/", None, "allow"), "https://free-bets.com/": ("free-bets.com", "/", None, "block"), "https://free.com/free": ("free.com", "/free", None, "allow"), "": ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([*enumerate([*urls, None])], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values()) and got[len(urls)] == ("", "", None, "allow")
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def test_url_filter_scans_whole_urls(spark):
    urls = ["https://a.com/go?q=xxx+casino", "https://a.com/#porn", "casino.example/porn", "https://a.com/?free&win", "https://a.com/free?q=freedom"]
    got = url_filter.filter_urls(spark.createDataFrame([*enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block", "block", "block", "block", "allow"]
    assert (got[0]["host"], got[0]["path"], got[2]["host"], got[2]["path"]) == ("a.com", "/go", "", "")


def test_url_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Foo", 0.5), ("bar", 0.75), ("baz", 1.0), ("foo", 0.1), (None, 9.0)], "term string, weight double")
    urls = ["http://a.com/foo", "http://a.com/foo/foo", "http://a.com/foo-bar", "http://a.com/baz", "http://a.com/foobar"]
    got = url_filter.filter_urls(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), vocabulary=terms, limit=1.0).orderBy("page_id").collect()
    assert [(r["verdict"], r["n_strict"], r["n_soft"], r["weight"]) for r in got] == [("allow", 0, 1, 0.5), ("allow", 0, 1, 0.5), ("block", 0, 2, 1.25), ("block", 1, 0, 1.0), ("allow", 0, 0, 0.0)]
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://porn.com")], "page_id long, url string"), vocabulary={}).first()["verdict"] == "allow"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    good = [" ".join(f"word{i}n{k}" for k in range(80)) for i in range(30)]
    passage = " ".join(f"quiz{k}" for k in range(20))
    texts = [*good, good[0], good[1] + " tail", passage + " " + " ".join(f"p{k}" for k in range(60)), good[2].replace("word2n5 ", "word2n5 a@b.co ", 1).replace("word2", "other2"), "short", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, step in cp.STAGES[:-1]:
        now = step(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    rows = {r["doc_id"]: r for r in now.collect()}
    assert sorted(rows) == [*range(30), 33]
    assert rows[33]["text"] == texts[33].replace("a@b.co", "<EMAIL>") and rows[33]["n_chars"] == len(rows[33]["text"])
    assert all(rows[i]["text"] == texts[i] for i in range(30))
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} == set(rows)
