"""The ten operators against brute force, libraries and edge cases."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate as D
from tesserae.llm import forest, license_scan, sharding, simhash, token_store, toxicity, url_filter
from tesserae.llm import queries as Q
from tesserae.llm.components import components
from tesserae.llm.sentencepiece_codec import codec, decode_ids, encode_decode
from tesserae.llm.transducer import count_tokens, transducer
from tesserae.llm.vocab import vocabulary

DATA = "/root/testdata/sf0.001"
PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
LONG = "the quick moron jumps over it. " * 4000
ROWS = [(1, "Hello  World, héllo <|endoftext|> x"), (1, "Hello  World, héllo <|endoftext|> x"), (None, "no id here"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "日本語テキスト😀 ▁▁ \x1c\x85"), (7, "a"), (8, "x" * 9000), (9, "Hello  World, héllo <|endoftext|> y")]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    return df.withColumns({c: F.lit(c) for c in ("lang", "source", "score", "predicted", "n_tokens", "ids", "fingerprint", "component_id", "k", "t", "id", "fp", "key", "slot", "shard", "n_words", "contaminated", "start", "chunks", "host", "path", "license", "rank")})


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 3 and 7: encoding, decoding, counting

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def samples():
    rng = random.Random(5)
    out = [t or "" for _, t in ROWS] + ["    " * 9, " " * 100 + "x", "<s> </s> <0x41>", "ab" * 3000, " " * 5000]
    for letters in ("ab ", "abc\n e", "aeiou tnrs", "日本語の ", "()[]=- \t"):
        out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(0x1F300, 0x1F600), rng.randint(97, 122)])) for _ in range(40)) for _ in range(300)]
    return out


def test_pieces_equal_the_library(library):
    texts = samples()
    for text, (ids, raw) in zip(texts, codec(PIECES).batch(texts)):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)), text[:60]
        assert raw.decode() == library.decode(want)


def test_long_segments_equal_the_library(library, monkeypatch):
    """Segments without a space of all lengths around the bound, and all samples with the bound at 2."""
    from tesserae.llm import sentencepiece_codec as M

    rng = random.Random(8)
    long = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "aB3+/", "x", "=-", "日本語のé", "▁", "thein") for n in (1022, 1023, 1024, 1025, 6000)]
    for bound in (M.LONG, 2):
        monkeypatch.setattr(M, "LONG", bound)
        texts = long + samples() if bound > 2 else samples()
        for text, (ids, raw) in zip(texts, M.Codec(PIECES).batch(texts)):
            assert ids == ",".join(map(str, library.encode(text))), (bound, text[:60])
            assert raw.decode() == library.decode(library.encode(text))


def test_decoding_of_any_ids(library):
    rng, m = random.Random(2), codec(PIECES).model
    for _ in range(200):
        ids = [rng.randint(3, 31999) for _ in range(rng.randint(1, 8))]
        assert decode_ids(m, ids).decode() == library.decode(ids), ids


def test_counts_equal_the_library(library):
    texts = samples()
    assert transducer(PIECES).counts(texts).tolist() == [len(library.encode(t)) for t in texts]
    from tesserae.llm import transducer as M

    t, old = M.Transducer(PIECES), M.STATES
    try:
        M.STATES = 50  # emptied over and over
        for i in range(0, len(texts), 40):
            assert t.counts(texts[i:i + 40]).tolist() == [len(library.encode(x)) for x in texts[i:i + 40]]
    finally:
        M.STATES = old


def test_composed_maps_equal_running(library):
    """Chunks of few characters, composed, against the automaton run over each whole segment."""
    from tesserae.llm import transducer as M

    rng = random.Random(9)
    han = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 900))
    texts = samples()[-700:] + ["".join(rng.choice(han) for _ in range(500)) for _ in range(20)] + ["aeiou" * 300, "ab" * 700, " " * 900, "=" * 1000]
    want = [len(library.encode(t)) for t in texts]
    old = M.CHUNK
    try:
        for size in (1, 3, 16, 10**6):
            M.CHUNK = size
            t = M.Transducer(PIECES)
            assert t.counts(texts).tolist() == want, size
    finally:
        M.CHUNK = old
    nth = np.array([0, 1, 2, 3, 0, 1])
    chunk, entry = np.array([0, 1, 1, 2, 3, 4, 5]), np.array([0, 0, 5, 7, 0, 0, 9])
    got = M.Transducer.compose(chunk, entry, np.array([5, 7, 7, 0, 1, 9, 3]), np.array([1, 2, 30, 4, 5, 6, 7]), nth)
    assert got.tolist() == [40, 11, 39, 9, 5, 13, 7]


def test_encode_rows(docs, library):
    got = rows(encode_decode(docs, PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=repr)
    assert encode_decode(docs.limit(0), PIECES, with_ids=True).count() == 0
    kept = {r.doc_id: r.ids for r in encode_decode(docs.where("doc_id = 7 or doc_id = 3"), PIECES, with_ids=True).collect()}
    assert kept == {7: library.encode("a"), 3: []}


def test_count_rows(docs, library):
    got = rows(count_tokens(docs, PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in ROWS]
    assert got == sorted(want, key=repr)
    assert count_tokens(docs.limit(0), PIECES).count() == 0


# 4: decontamination

def brute_windows(texts, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows: dict = {}
    for name, text in items:
        w = pattern.findall(low(text))
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(name))
    out = []
    for t in texts:
        w, hit, met = pattern.findall(low(t)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i:i + size]))
                if got:
                    hit.update(range(i, i + size))
                    met |= got
        out.append((len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


COLS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontaminate(spark, block):
    rng = random.Random(block)
    said = lambda n: " ".join(rng.choice(["a", "B", "é9", "日本", "x_y", "d-"][:rng.choice([3, 4, 6])]) for _ in range(n))
    items = [(i, said(rng.choice([1, 3, 7, 9, 10, 11, 25]))) for i in range(12)] + [(98, None), (None, "a b"), (99, ""), (3, "B B")]
    texts = [said(rng.randint(0, 60)) for _ in range(60)] + [None, "", items[4][1], "x " * 30000 + (items[5][1] or "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in D.decontaminate(docs, bench, block_bytes=block).collect()}
    want = brute_windows(texts, [(n, t) for n, t in items if n is not None and t is not None])
    assert got == dict(enumerate(want))


def test_decontaminate_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not r.contaminated and r.n_items == 0 for r in D.decontaminate(docs, none).collect())
    assert D.decontaminate(docs.limit(0), none).count() == 0


# 6: near duplicates

def brute_groups(fps):
    """Least index reachable from each over links of 4 bits."""
    u = np.array(fps, np.uint64)
    root = np.arange(len(u))
    links = [np.flatnonzero(np.bitwise_count(u ^ x) <= 4) for x in u]
    while True:
        new = np.array([root[x].min() for x in links])
        if (new == root).all():
            return root
        root = new


def brute_print(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_near_duplicates(spark, docs):
    out = simhash.near_duplicates(docs)
    got = rows(out, "doc_id", "fingerprint", "component_id")
    prints = [brute_print(t) for _, t in ROWS]
    root = brute_groups(prints)
    least = {r: min((i for (i, _), q in zip(ROWS, root) if q == r and i is not None), default=None) for r in set(root)}
    assert got == sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(ROWS, prints, root)), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [256, 5])
def test_links_of_dense_groups(spark, chunk):
    rng = np.random.default_rng(chunk)

    def noisy(center, n, most):
        for _ in range(n):
            x = int(center)
            for b in rng.integers(0, 64, rng.integers(0, most + 1)):
                x ^= 1 << int(b)
            yield x

    base = rng.integers(0, 2**64, 150, dtype=np.uint64).tolist()
    fps = sorted({*base, *(y for c in base[:30] for y in noisy(c, 5, 5)), *noisy(base[0], 400, 3), 0, 1, 2**64 - 1})
    df = spark.createDataFrame([(int(x),) for x in np.array(fps, np.uint64).view(np.int64)], "fp bigint").repartition(6)
    got: dict = {}
    for r in components(simhash.links(df, chunk=chunk)).collect():
        got.setdefault(r.root, set()).add(r.node)
    want: dict = {}
    for x, r in zip(np.array(fps, np.uint64).view(np.int64).tolist(), brute_groups(fps)):
        want.setdefault(r, set()).add(x)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


# 8: the store

def test_store(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(BYTES), str(tmp_path / "s")
    token_store.write_store(docs, path, BYTES)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS]
    assert [r.doc_id for r in got] == sorted((i for i, _ in ids), key=lambda x: (x is not None, x))
    start = 0
    left = list(ids)
    for r in got:
        one = next(x for x in left if x[0] == r.doc_id and (r.n_tokens, r.ids_crc32) == (len(x[1]), zlib.crc32(np.array(x[1], "<u4").tobytes())))
        left.remove(one)
        assert r.start == start
        start += r.n_tokens
    assert token_store.verify_store(spark, path)
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("key").distinct().count()
    spark.read.parquet(f"{path}/recipes").withColumn("start", F.col("start") + F.when(F.col("doc_id") == 9, 1).otherwise(0)).write.parquet(f"{path}/changed")
    import shutil

    shutil.rmtree(f"{path}/recipes")
    shutil.move(f"{path}/changed", f"{path}/recipes")
    assert not token_store.verify_store(spark, path)


def test_store_without_documents(spark, docs, tmp_path):
    path = str(tmp_path / "s")
    token_store.write_store(docs.limit(0), path, BYTES)
    assert token_store.read_documents(spark, path).count() == 0 and token_store.verify_store(spark, path)


def test_store_without_end_id_and_with_wide_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(BYTES), str(tmp_path / "s")
    token_store.write_store(docs.where("doc_id <> 1"), path, BYTES, end_id=None, width=4)
    assert token_store.width_of(spark, path) == 4
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_verified(spark, path).collect()}
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS if i not in (None, 1)]
    assert got == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want}


def test_damaged_and_absent_chunks(spark, docs, tmp_path):
    import glob
    import os
    import shutil

    path = str(tmp_path / "s")
    token_store.write_store(docs, path, BYTES)
    chunks = spark.read.parquet(f"{path}/chunks/kind=1")
    for n, changed in enumerate((chunks.withColumn("data", F.first("data").over(token_store_window())), chunks.limit(1))):
        other = str(tmp_path / f"c{n}")
        shutil.copytree(path, other)
        shutil.rmtree(f"{other}/chunks/kind=1")
        changed.write.parquet(f"{other}/chunks/kind=1")
        for junk in glob.glob(f"{other}/chunks/kind=1/_*"):
            os.remove(junk)
        with pytest.raises(Exception, match="damaged|absent"):
            token_store.read_documents(spark, other).collect()


def token_store_window():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def test_kept_columns_with_clashing_names(spark, docs):
    """Each operator that carries columns along, with columns called as its own."""
    clash = docs.select("doc_id", "text", "slot", "shard", "score", "predicted", "n_words", "contaminated", F.lit("a/b").alias("path"), "license", F.lit(7).alias("hit"))
    all_ = ["doc_id", "slot", "shard"]
    got = sharding.assign(clash, ["doc_id"], keep=all_)
    assert got.columns == ["doc_id", "slot_", "shard_", "slot", "shard"] and {r.slot_ for r in got.collect()} == {"slot"}
    assert sharding.assign(clash, ["doc_id"]).columns[2:4] == ["slot_", "shard_"]
    model = toxicity.Model(None, np.array([0.25]), np.zeros(0), np.ones(0))
    got = toxicity.score(clash, model, keep=["score", "doc_id", "text", "predicted"])
    assert got.columns == ["score_", "doc_id", "text", "predicted_", "score", "predicted"] and {(r.score_, r.score) for r in got.collect()} == {("score", 0.25)}
    items = spark.createDataFrame([(1, "Hello World")], "item_id bigint, text string")
    got = D.decontaminate(clash, items, keep=["n_words", "doc_id", "contaminated", "hit"])
    assert got.columns[:4] == ["n_words_", "doc_id", "contaminated_", "hit"] and {r.hit for r in got.collect()} == {7} and any(r.contaminated for r in got.collect())
    got = license_scan.scan(clash, keep=["doc_id", "path", "score"])
    assert got.columns == ["doc_id", "path_", "score_", *license_scan.OWN] and got.count() == len(ROWS)


def test_fast_split_equals_the_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(BYTES), token_store.Encoder(BYTES)
    texts = samples() + ["don't we'll ²³ ½x é…", "x\x1cy\x85z", "\t\ta", " 's", "’s l’été"]
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.kind).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:50])


def test_crc_of_joined_runs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(1, 4000))
        assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cuts_follow_content():
    ids = np.random.default_rng(3).integers(0, 50000, 30000).astype("<u2")
    one = token_store.cuts(ids, [len(ids)])[0]
    moved = token_store.cuts(np.r_[ids[:7], ids], [len(ids) + 7])[0]
    assert len({x + 7 for x in one} & set(moved)) > len(one) // 2
    sizes = np.diff([0, *one])
    assert sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()


# 9: neighbours

def exact(v, ids, q, k):
    score = {i: float((np.array(x, float) * np.array(q[1], float)).sum()) for i, x in zip(ids, v) if i != q[0]}
    return sorted(score, key=lambda i: (-score[i], i))[:k]


def test_neighbours_small(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [nan, 1.0, 1.0]), (160, [inf, 1.0, 1.0]), (180, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (200, []), (220, [1.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumns({"rank": F.lit(1), "id": F.lit(2), "v": F.lit(3)})
    got: dict = {}
    for r in forest.nearest(df, "id % 20 = 0", k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    own = data[:60]
    assert set(got) == {0, 20, 40}
    for q in got:
        assert got[q] == exact([x for _, x in own], [i for i, _ in own], (q, own[q][1]), 20)
    assert forest.nearest(df.limit(0), "id % 20 = 0").count() == 0
    few = forest.nearest(df.where("vec_id < 4"), "id % 20 = 0").collect()
    assert len(few) == 3


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:2000] = x[0]  # a very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in forest.nearest(df, "id % 400 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = [len(got[q] & set(exact(x, range(6000), (q, x[q]), 20))) for q in got]
    assert len(got) == 15 and sum(hit) / len(hit) / 20 >= 0.9
    assert got[0] == set(range(1, 21))


def test_neighbours_of_vectors_with_structure(spark):
    """Clusters need a small share of the leaves; great norms have ties within their rounding."""
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, plain = unit(np.repeat(rng.standard_normal((40, 32)), 100, axis=0) + 0.1 * rng.standard_normal((4000, 32))), unit(rng.standard_normal((4000, 32)))
    few, many = (forest.Forest.fit(forest._placed(v, 1.0), depth=7).share(forest._placed(v, 1.0), np.zeros(4000, bool), 20) for v in (x, plain))
    assert few < 0.15 < many
    big = x * 1e12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(big)] + [(4000, big[7].tolist())], "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in forest.nearest(df, "id % 100 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    v = np.r_[big, big[7:8]]
    hit = [len(got[q] & set(exact(v, range(4001), (q, v[q]), 20))) for q in got]
    assert len(got) == 41 and sum(hit) / len(hit) / 20 >= 0.9


# 1: urls

URLS = ["http://A.example.org/es/x?y", "https://example.org/en/12", "https://example.org/en/2", "http://org/", "http://x.com/fr/", "http://x.com/de/1#a/b", "http://www.spam-farm.example.com/x", "casino-win.example.net", "ftp://casino-win.example.net", None, "", "://", "http://notexample.org/es/", "http://a://b/c", "http://h?x/y", "HTTP://ÀB.com/FR/", "http://spam-farm.example.com.evil.net/"]


def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host, tail = (rest[:cut.start()], rest[cut.start():]) if cut else (rest, "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", tail)[0]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.listed_table(spark)).collect()}
    for i, u in enumerate([*URLS, URLS[0]]):
        host, path = brute_url(u)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if any(host == h or host.endswith("." + h) for h in url_filter.LISTED) else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert url_filter.judge(df.limit(0), url_filter.listed_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, url_filter.listed_table(spark).limit(0), rules=()).collect()} == {"allow"}


@pytest.mark.parametrize("most", [1 << 20, 1024])
def test_cascade_is_exact(spark, most):
    urls = spark.range(6000).select(F.concat(F.lit("h"), F.col("id") % 5000, F.lit(".net")).alias("h"))
    listed = spark.range(0, 5000, 3).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("k"))
    got = url_filter.listed_hosts(urls, listed, "h", max_bytes=most, rate=0.25).collect()
    assert all(r["__listed"] == (int(r.h[1:-4]) % 3 == 0) for r in got) and len(got) == 6000


# 5: shards

def test_sharding(spark, docs):
    table = sharding.lookup()
    n = np.bincount(table)
    assert len(table) == sharding.SLOTS and n.max() - n.min() <= 1 + len(n) // 32
    less = sharding.lookup(sharding.SHARDS[:-1])
    moved = sum(sharding.SHARDS[a] != sharding.SHARDS[b] for a, b in zip(table, less))
    assert moved / len(table) < 0.1
    got = sharding.assign(docs, ["doc_id"], keep=["doc_id"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        key = "\x1e" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.slot == slot and r.shard == sharding.SHARDS[table[slot]]
    assert sharding.assign(docs.limit(0), ["doc_id"], keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup(slots=100)


# 10: licences

FILES = [("a/LICENSE", "Released under the MIT License.\nfoo bar"), ("a/b/c.py", "x = 1"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/b/d/e.py", ""), ("z.py", "hello"), ("a/q.py", "x = 1\n# Licensed under CC BY-NC 4.0.\n" + "y = 2\n" * 50), (None, "Released under the MIT License."), ("a/t.py", None), ("a/t.py", None), ("ab/x.py", "q " * 50000), ("LICENSE.txt", "This work is licensed under the GNU General Public License, version 3.")]


def test_licenses(spark):
    df = spark.createDataFrame([(p, t, "x") for p, t in FILES], "path string, text string, license string").repartition(3)
    got = {}
    for r in license_scan.scan(df).collect():
        got.setdefault(r.path, []).append((r.license, r.how, r.from_dir))
    assert got["a/LICENSE"] == [("MIT", "file", None)] and got["a/b/c.py"] == [("Apache-2.0", "inherited", "a/b")] and got["a/b/d/e.py"] == [("Apache-2.0", "inherited", "a/b")]
    assert got["a/q.py"] == [("CC-BY-NC-4.0", "header", None)] and got["a/t.py"] == [("MIT", "inherited", "a")] * 2 and got[None] == [("MIT", "file", None)]
    assert got["z.py"] == got["ab/x.py"] == [("GPL-3.0-only", "inherited", "")]
    assert license_scan.scan(df.limit(0)).count() == 0


def brute_licenses(texts):
    """(name, score, whole) of each text, or None: the text as a whole, else its best line or paragraph."""
    find = lambda t: re.findall(license_scan.TERM, (t or "").lower())
    df = Counter(w for t in texts for w in set(find(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    vec = lambda t: {w: n * idf(w) for w, n in Counter(find(t)).items()}
    norm = lambda a: math.sqrt(sum(x * x for x in a.values()))
    templates = [(n, v, norm(v)) for n, t in license_scan.TEMPLATES for v in (vec(t),)]

    def best(units):
        got = [(round(sum(x * v.get(w, 0) for w, x in u.items()) / (norm(u) * m), 6), -k, n) for u in map(vec, units) if u for k, (n, v, m) in enumerate(templates)]
        return max(got, default=(0, 0, None))

    out = []
    for t in texts:
        head, whole = best((t or "").split("\n") + re.split(license_scan.PARAGRAPH, t or "")), best([t or ""])
        own = next((x for x in (whole, head) if x[0] >= license_scan.THRESHOLD), None)
        out.append(own and (own[2], own[0], whole[0] >= license_scan.THRESHOLD))
    return out


def test_license_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.concat_ws("/", "source", "doc_id").alias("path"))
    rows_ = [(r.doc_id, r.text, r.path) for r in docs.collect()]
    texts = dict(license_scan.TEMPLATES[13:])
    copyright = "Copyright (c) 2020 Someone\n\n"
    rows_ += [(-1, copyright + texts["ISC"], "x/a"), (-2, copyright + texts["BSD-2-Clause"].replace(". ", ".\n\n"), "y/a"), (-3, None, "z/a"), (-4, "", "z/b"), (-5, rows_[0][1], "z/c")]
    got = {r.doc_id: (r.license, r.score, r.how) for r in license_scan.scan(spark.createDataFrame(rows_, "doc_id bigint, text string, path string"), keep=["doc_id"]).collect()}
    want = brute_licenses([t for _, t, _ in rows_])
    assert got[-1][0] == "ISC" and got[-1][2] == "file" and got[-2][0] == "BSD-2-Clause"
    assert sum(w is not None for w in want) >= 5
    for (i, _, _), w in zip(rows_, want):
        assert (got[i][0], got[i][2]) == (w[0], "file" if w[2] else "header") and got[i][1] == pytest.approx(w[1], abs=2e-6) if w else got[i][2] in ("none", "inherited"), i


def test_license_files_of_a_directory(spark):
    """A heading in a file called LICENSE; two files of one directory; equal scores; a kept column with a clashing name."""
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies of this document, but changing it is not allowed.\n\n" + "The following terms apply to everything else here. " * 40
    mit = "Released under the MIT License."
    rows_ = [("a/LICENSE", gpl, 1), ("a/b/x.py", "x", 2), ("c/LICENSE", mit + "\nfoo bar baz qux", 3), ("c/COPYING", mit, 4), ("c/y.py", "y", 5), ("d/LICENSE", mit, 6), ("d/NOTICE", "Licensed under CC BY 4.0.", 7), ("d/z.py", "z", 8), *((f"e/{i}", f"the other words {i}", 9) for i in range(30))]
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame(rows_, "path string, text string, license int"), keep=["license"]).collect()}
    assert got["a/LICENSE"].license == "GPL-3.0-only" and (got["a/b/x.py"].license, got["a/b/x.py"].how, got["a/b/x.py"].from_dir) == ("GPL-3.0-only", "inherited", "a")
    assert got["c/y.py"].license == "MIT" and got["c/y.py"].license_ == 5
    assert got["d/z.py"].license == "MIT"  # equal scores: the template that comes first
    assert got["e/3"].how == "none" and got["e/3"].license is None


# 2: toxicity

def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    got = Q.QUERIES["op2_toxicity"](spark, data)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    both = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in both)
    right = sum((r.score >= 0.5) == (r.toxic == 1) and r.predicted == int(r.score >= 0.5) for r in both) / len(both)
    clean, toxic = ([r for r in both if r.toxic == y] for y in (0, 1))
    alarms, recall = (sum(r.predicted for r in x) / len(x) for x in (clean, toxic))
    print("held out: right", right, "recall", recall, "alarms", alarms)
    assert right >= 0.93 and alarms < 0.02 and recall >= 0.5


def test_toxicity_scores_equal_brute_force(spark, docs):
    """Every window compressed by itself with both dictionaries, the features and the score from plain sums."""
    import zstandard as z

    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")
    texts = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    model = toxicity.train(texts, labels)
    assert len(model.dictionaries.pairs) == 2 and all(len(a) == len(b) and a != b for a, b in model.dictionaries.pairs)

    def compressed(content, part):
        p = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=18, hash_log=17, chain_log=19, search_log=4, min_match=5, strategy=z.STRATEGY_BTLAZY2)
        d = z.ZstdCompressionDict(content + toxicity.BALLAST, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        c = z.ZstdCompressor(dict_data=d, compression_params=p)
        return [len(c.compress(toxicity.BALLAST + x)) for x in part]

    some = docs.union(texts.limit(15).select("doc_id", "text", *(F.lit("x").alias(c) for c in docs.columns[2:])))
    got = {(r.doc_id, r.text): r.score for r in toxicity.score(some, model, keep=["doc_id", "text"]).collect()}
    assert len(got) > 20
    for (_, text), score in got.items():
        t = (" " + " ".join((text or "").lower().split()) + " ").encode()
        cut = [t[i:i + 76] for i in range(0, len(t), 64)]
        x = []
        for plain, toxic in model.dictionaries.pairs:
            gain = [a - b for a, b in zip(compressed(plain, cut), compressed(toxic, cut))]
            top, n = sorted(gain, reverse=True)[:8] + [0] * 8, len(gain)
            x += [sum(top[:j]) for j in (1, 2, 4, 8)] + [math.sqrt(sum(g >= j for g in gain) / n) for j in (1, 2, 3, 4)]
            x += [math.sqrt(min(50, sum(g >= j for g in gain))) for j in (2, 3, 4)] + [max(-2, min(5, sum(gain) / n)), math.log1p(n)]
        logit = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale))
        assert score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, logit)))), abs=1e-9)


def test_texts_longer_than_any_batch(spark, library):
    """One row of some megabytes among short ones, through each operator that cuts its batches by size."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "Beta", "gamma,", "délta", "日本", "eps" + str(rng.randrange(500))]) for _ in range(600_000)) + " released under the MIT License."
    texts = ["short one", long, "", None, "short one"]
    df = spark.createDataFrame([(i, t, f"a/{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, path string").coalesce(1)
    want = library.encode(long)
    one = encode_decode(df, PIECES).where("doc_id = 1").first()
    assert one.n_tokens == len(want) and one.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert count_tokens(df, PIECES).where("doc_id = 1").first().n_tokens == len(want)
    assert simhash.fingerprints(df).where("id = 1").first().fp & (2**64 - 1) == brute_print(long)
    ids = Tokenizer.from_file(BYTES).encode(long, add_special_tokens=False).ids
    enc = token_store.Encoder(BYTES)
    assert np.frombuffer(enc.encode([long])[0], enc.kind).tolist() == ids
    items = spark.createDataFrame([(1, " ".join(long.split()[300_000:300_012]))], "item_id bigint, text string")
    hit = D.decontaminate(df, items).where("doc_id = 1").first()
    assert hit.contaminated and hit.n_hit >= 12
    model = toxicity.Model(toxicity.Dictionaries([(b"alpha beta gamma", b"released under")]), np.ones(14), np.zeros(13), np.ones(13))
    assert 0 <= toxicity.score(df, model).where("doc_id = 1").first().score <= 1
    assert len(license_scan.scan(df).collect()) == 5


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("you are a grotty zorbling, "), "id")).otherwise(F.concat(F.lit("a pleasant walk in the park, "), "id")).alias("text"))
    model = toxicity.train(texts, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    bad = toxicity.score(spark.createDataFrame([(1, "what a grotty zorbling that is"), (2, "a pleasant walk again")], "doc_id bigint, text string"), model).collect()
    assert {r.doc_id: r.predicted for r in bad} == {1: 1, 2: 0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.train(texts, few)).collect()} == {0.0}


# Registered queries

@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_registered(spark, name):
    import glob
    import os

    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got
    if name in Q.ORACLES:
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        cur = con.execute(Q.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in cols)) for r in cur.fetchall())
