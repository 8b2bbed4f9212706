"""A content-addressed store of token ids.

Layout below the store's folder (all Parquet, so any store that Spark writes to will do):

- chunks/kind=1: one row for each distinct chunk: key (BLAKE2b-160 of its ids as little-endian
  unsigned 32-bit integers), n, data (the ids as little-endian integers of WIDTH bytes, low bytes
  first and high bytes after them, zstandard).
- recipes: one row for each document in ascending order of doc_id: doc_id, start (ids before it),
  n_tokens, chunks (keys in order), leaf (SHA-256 of these), part.
- manifest: one row for each part of the recipes: part, n_docs, start, n_tokens, root (Merkle root
  of its leaves), width (WIDTH), and one with part -1 whose root is over the parts' roots.

A document's ids, with the end id, are cut where a rolling hash of the last WINDOW ids has its low
bits zero, at least LEAST and at most MOST ids after the last cut. Equal passages so give equal
chunks wherever they are, and a chunk is stored once.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, ship, slices

WINDOW, LEAST, MOST, MASK = 16, 256, 4096, 1023
MEMO, MEMO_CHARS = 1_200_000, 32
#: Texts of these characters alone are split by Python's patterns; the library splits all others.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


class Encoder:
    """Byte-level BPE of the tokenizers library, with a memo of the encodings of pre-tokens."""

    def __init__(self, path: str, width: int | None = None):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.alphabet = np.arange(256, dtype="<u4")
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.alphabet[0] = 0  # the separator
        self.width = width or (2 if self.tok.get_vocab_size() <= 1 << 16 else 4)
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")

    def _fill(self, words: list[str]) -> dict[str, bytes]:
        """Encodings of pre-tokens (without NUL) by the library's model, from their bytes in its alphabet."""
        spelt = self.alphabet[np.frombuffer("\0".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\0")
        tokenize = self.tok.model.tokenize
        got = [[t.id for t in tokenize(w)] for w in spelt]
        ends = np.cumsum([0, *map(len, got)]).tolist()
        flat = memoryview(np.fromiter(chain.from_iterable(got), np.int64, ends[-1]).astype(self.kind).tobytes())
        n = self.width
        return {w: bytes(flat[n * a:n * b]) for w, a, b in zip(words, ends, ends[1:])}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of self.width bytes."""
        out: list = [None] * len(texts)
        open_: list[tuple[int, list, list[int], list[str]]] = []
        whole, get = [], self.memo.get
        for i, t in enumerate(texts):
            if not self.plain or not _PLAIN.fullmatch(t) or (self.special and self.special.search(t)):
                whole.append(i)
                continue
            words = _SPLIT.findall(t)
            ids = list(map(get, words))
            if None in ids:
                at = [k for k, v in enumerate(ids) if v is None]
                open_.append((i, ids, at, [words[k] for k in at]))
            else:
                out[i] = b"".join(ids)
        if open_:
            new = self._fill(list({w for *_, words in open_ for w in words}))
            for i, ids, at, words in open_:
                for k, w in zip(at, words):
                    ids[k] = new[w]
                out[i] = b"".join(ids)
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
            self.memo.update((w, v) for w, v in new.items() if len(w) <= MEMO_CHARS)
        if whole:
            for i, got in zip(whole, self.tok.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = np.array(got.ids, np.int64).astype(self.kind).tobytes()
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, width: int | None = None) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def _marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last WINDOW ids of a flat array has its low bits zero."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    power, step = 0xBF58476D1CE4E5B9, 1
    while step < WINDOW:
        nxt = h.copy()
        nxt[step:] += h[:-step] * np.uint64(power)
        h, power, step = nxt, power * power % (1 << 64), step * 2
    return np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK)) == 0) + 1


def cuts(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """Ends of the chunks of each document in a flat array of ids; bounds are the documents' ends.

    A mark counts only LEAST or more ids after a document's start, and LEAST > WINDOW, so what
    stands before a document does not matter.
    """
    marks = _marks(ids)
    first = np.searchsorted(marks, [0, *bounds]).tolist()
    marks, out, last = marks.tolist(), [], 0
    for i, n in enumerate(bounds):
        own = []
        for m in [*(marks[first[i]:first[i + 1]] if n - last > LEAST else ()), n]:
            while m - last > MOST:
                last += MOST
                own.append(last)
            if m - last >= LEAST or (m == n and m > last):
                own.append(m)
                last = m
        out.append(own)
    return out


_PACKER = None


def pack(planes: bytes) -> bytes:
    """Planes of bytes (all low ones, then all next ones) compressed."""
    import zstandard

    global _PACKER
    if _PACKER is None:
        _PACKER = zstandard.ZstdCompressor(level=1, write_content_size=True)
    return _PACKER.compress(planes)


def unpack(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def key_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node goes up as it is; no leaves: hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def leaf_of(doc_id, start: int, n: int, chunks: list[bytes]) -> bytes:
    return hashlib.sha256(b"\0" + f"{doc_id},{start},{n};".encode() + b"".join(chunks)).digest()


_STAGED = "kind int, key binary, n bigint, data binary, chunks array<binary>"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, width: int | None = None) -> None:
    """Encode every whole text, append end_id (if not None) and write the store at path, with ids of
    `width` bytes (None: 2 where the vocabulary allows it, else 4).

    Null and empty texts hold the end id alone. Rows with equal or null ids are documents of their
    own (nulls first, equals in the order of their chunks' keys). An empty table gives a store
    without documents. Whole texts are encoded, however long: those of plain letters by their
    pre-tokens, which the library's own model encodes and a memo keeps, all others by the library;
    special strings are handled as the library does by default. Distinct chunks meet in one shuffle,
    after each task has dropped its own repeats; texts are not shuffled. The folder is the caller's.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        import gc

        gc.set_threshold(200_000, 20, 100)  # the memo is millions of objects without cycles
        enc, seen, serial, task = encoder(tokenizer_path, width), set(), 0, TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id]).astype(enc.kind).tobytes()
        for whole in batches:
            for b in slices(whole, "t", 2 << 20):
                rows: list[tuple] = []
                raw = [x + end for x in enc.encode([t or "" for t in b.column("t").to_pylist()])]
                ids = np.frombuffer(b"".join(raw), enc.kind)
                wide = memoryview(ids.astype("<u4").tobytes())
                planes = [p.tobytes() for p in ids.view(np.uint8).reshape(-1, enc.width).T]
                bounds = np.cumsum([len(x) // enc.width for x in raw]).tolist()
                last = 0
                for doc, n, ends in zip(b.column("doc_id").to_pylist(), bounds, cuts(ids, bounds)):
                    own, first = [], last
                    for c in ends:
                        k = hashlib.blake2b(wide[4 * last:4 * c], digest_size=20).digest()
                        own.append(k)
                        if k not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(k)
                            rows.append((1, k, c - last, pack(b"".join([p[last:c] for p in planes])), None, None))
                        last = c
                    rows.append((0, b"doc" + task.to_bytes(6, "big") + serial.to_bytes(7, "big"), n - first, None, own, doc))
                    serial += 1
                cols = list(zip(*rows))
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary()), b.schema.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "key", "n", "data", "chunks", "doc_id"])

    staged = base.mapInArrow(run, f"{_STAGED}, doc_id {kind}")
    staged.repartition("key").dropDuplicates(["key"]).write.mode("overwrite").partitionBy("kind").option("compression", "none").parquet(f"{path}/chunks")
    _write_recipes(spark, path, kind, encoder(tokenizer_path, width).width)


def _write_recipes(spark: SparkSession, path: str, kind: str, width: int) -> None:
    raw = spark.read.schema(f"{_STAGED}, doc_id {kind}").parquet(f"{path}/chunks").where("kind = 0").select("doc_id", F.col("n").alias("n_tokens"), "chunks")
    order = ["doc_id", F.xxhash64("chunks"), "n_tokens"]
    dealt = raw.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpoint(dealt.withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for r in dealt.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each partition
        before[r.part], total = total, total + r.n

    def run(batches):
        at = {}
        for b in batches:
            out = b.to_pydict()
            starts, leaves = [], []
            for doc, n, chunks, part in zip(out["doc_id"], out["n_tokens"], out["chunks"], out["part"]):
                start = at.setdefault(part, before[part])
                at[part] = start + n
                starts.append(start)
                leaves.append(leaf_of(doc, start, n, chunks))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(starts, pa.int64()), b.column("n_tokens"), b.column("chunks"), pa.array(leaves, pa.binary()), b.column("part")], names=["doc_id", "start", "n_tokens", "chunks", "leaf", "part"])

    dealt.select("doc_id", "n_tokens", "chunks", "part").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, chunks array<binary>, leaf binary, part int").write.mode("overwrite").parquet(f"{path}/recipes")
    parts = _roots(spark.read.parquet(f"{path}/recipes")).orderBy("part").collect()  # a row for each partition
    rows = [(r.part, r.n_docs, r.start, r.n_tokens, bytes(r.root), width) for r in parts]
    rows.append((-1, sum(r[1] for r in rows), 0, total, merkle([r[4] for r in rows]), width))
    spark.createDataFrame(rows, "part int, n_docs bigint, start bigint, n_tokens bigint, root binary, width int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _roots(recipes: DataFrame) -> DataFrame:
    """Merkle root of each part, folded level by level so that a part's leaves are never all held."""
    base = recipes.select("part", "start", "n_tokens", "leaf", F.xxhash64("leaf").alias("x"))

    def run(batches):
        state: dict = {}
        for b in batches:
            for part, start, n, leaf in zip(*(b.column(c).to_pylist() for c in ("part", "start", "n_tokens", "leaf"))):
                s = state.setdefault(part, [0, start, 0, []])
                s[0], s[2] = s[0] + 1, s[2] + n
                node, height = leaf, 0
                while s[3] and s[3][-1][1] == height:
                    node, height = hashlib.sha256(b"\1" + s[3].pop()[0] + node).digest(), height + 1
                s[3].append((node, height))
        out = []
        for part, (n, start, tokens, stack) in state.items():
            node = stack.pop()[0]
            while stack:
                node = hashlib.sha256(b"\1" + stack.pop()[0] + node).digest()
            out.append((part, n, start, tokens, node))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "n_docs", "start", "n_tokens", "root"])

    return base.repartition("part").sortWithinPartitions("part", "start").drop("x").mapInArrow(run, "part int, n_docs bigint, start bigint, n_tokens bigint, root binary")


def width_of(spark: SparkSession, path: str) -> int:
    """Bytes of an id, from the manifest."""
    return spark.read.parquet(f"{path}/manifest").where("part = -1").first().width


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(key, ids) of the distinct chunks; a chunk that does not match its key raises an error."""
    return _scan(spark, path, "key binary, ids array<bigint>", lambda key, ids: (key, ids.tolist()), (pa.binary(), pa.list_(pa.int64())), ("key", "ids"))


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(key, n, crc) of the distinct chunks, read and checked; crc over little-endian 32-bit ids."""
    return _scan(spark, path, "key binary, n bigint, crc bigint", lambda key, ids: (key, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), (pa.binary(), pa.int64(), pa.int64()), ("key", "n", "crc"))


def _scan(spark, path, schema, row, kinds, names):
    ship(spark)
    width = width_of(spark, path)

    def run(batches):
        for b in batches:
            rows = []
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist()):
                ids = unpack(data, width)
                if key_of(ids) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                rows.append(row(key, ids))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    return spark.read.schema("kind int, key binary, data binary").parquet(f"{path}/chunks").where("kind = 1").select("key", "data").mapInArrow(run, schema)


def verify_store(spark: SparkSession, path: str) -> bool:
    """Whether leaves, parts and the top of the manifest agree with the recipes."""
    ship(spark)
    recipes = spark.read.parquet(f"{path}/recipes")

    def run(batches):
        for b in batches:
            bad = sum(leaf_of(*x) != leaf for *x, leaf in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "chunks", "leaf"))))
            yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int64())], names=["bad"])

    if recipes.select("doc_id", "start", "n_tokens", "chunks", "leaf").mapInArrow(run, "bad bigint").agg(F.sum("bad")).first()[0]:
        return False
    roots = {r.part: bytes(r.root) for r in _roots(recipes).collect()}
    kept = {r.part: bytes(r.root) for r in spark.read.parquet(f"{path}/manifest").collect()}
    top = kept.pop(-1)
    return kept == roots and top == merkle([roots[p] for p in sorted(roots)])


# CRC-32 of joined runs: multiplication of polynomials over GF(2), reflected, as in zlib's crc32_combine.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    m, p = 1 << 31, 0
    while True:
        if a & m:
            p ^= b
            if not a & (m - 1):
                return p
        m >>= 1
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1


_SHIFTS: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    if n_bytes not in _SHIFTS:
        p, q, n = 1 << 31, 1 << 30, n_bytes * 8
        while n:
            if n & 1:
                p = _times(q, p)
            q, n = _times(q, q), n >> 1
        _SHIFTS[n_bytes] = p
    return _SHIFTS[n_bytes]


def crc_join(one: int, two: int, n_bytes: int) -> int:
    """CRC-32 of two runs, given those of each and the length of the second."""
    return (_times(_shift(n_bytes), one) if one else 0) ^ two


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """read_documents of a store whose recipes agree with its manifest; an error if they do not."""
    if not verify_store(spark, path):
        raise ValueError(f"the recipes of {path} do not agree with its manifest")
    return read_documents(spark, path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the chunks that its recipe names.

    Only sums of chunks travel, never their ids. A document without ids has the sum 0. A recipe that
    names an absent chunk, or whose chunks do not add up to its length, raises an error.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    entries = recipes.select("doc_id", "start", F.col("n_tokens").alias("want"), F.posexplode_outer("chunks").alias("at", "key"))
    met = entries.join(chunk_sums(spark, path), "key", "left")
    docs = met.groupBy("doc_id", "start", "want").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n_out, crc_out = [], []
            for doc, want, runs in zip(b.column("doc_id").to_pylist(), b.column("want").to_pylist(), b.column("runs").to_pylist()):
                n, crc = 0, 0
                for r in runs:
                    if r["at"] is None:  # a document without ids
                        continue
                    if r["n"] is None:
                        raise ValueError(f"a chunk of document {doc} is absent")
                    n, crc = n + r["n"], crc_join(crc, r["crc"], 4 * r["n"]) if n else r["crc"]
                if n != want:
                    raise ValueError(f"document {doc} has {n} ids, not {want}")
                n_out.append(n)
                crc_out.append(crc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n_out, pa.int64()), pa.array(crc_out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
