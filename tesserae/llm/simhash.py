"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into 3 segments. If two fingerprints differ in at most 4 bits (5 even),
one of the segments differs in at most one bit, so the two share a variant of that segment with one
position struck out. Every distinct fingerprint is indexed under its 64 variants (segment, position,
remaining bits); those under an equal variant are compared on all 64 bits.

Variants are dealt by ranges of (variant, fingerprint), so that even a variant of very many
fingerprints is spread. Within a task, runs of an equal variant are compared by shifted arrays. A
run longer than CHUNK, or one that may go on in a neighbouring task, is put out as chunks, which are
joined chunk with chunk afterwards. A pair is put out under one variant only, and where a run has
far more links than members, only a spanning forest of them is.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship, slices
from .components import components

SEED, SHINGLE, BITS = 42, 4, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CHUNK = 256


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    k = max(1, n - SHINGLE + 1)
    starts = np.r_[0, ends[:k - 1]].tolist()
    stops = (ends[n - k:] - 1).tolist()
    total = np.zeros(64, np.int64)
    for a in range(0, k, 65536):
        part = [flat[i:j] for i, j in zip(starts[a:a + 65536], stops[a:a + 65536])]
        h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), part), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each document; fp is the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, "t", 2 << 20):
                got = np.array([fingerprint(t) for t in b.column("t").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got)], names=["id", "fp"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, fp bigint")


def _canonical(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether variant number v is the one under which the pair is put out."""
    diff = a ^ b
    out, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
    for at, size in SEGMENTS:
        part = (diff >> np.uint64(at)) & np.uint64((1 << size) - 1)
        one = open_ & (np.bitwise_count(part) <= 1)
        pos = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1))).astype(np.int64) + at
        pos[part == 0] = at
        out |= one & (v == pos)
        open_ &= ~one
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node with the least node that it reaches."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    on = root != np.arange(len(nodes))
    return nodes[root[on]], nodes[on]


def _within(v: np.ndarray, fp: np.ndarray, run: np.ndarray, bits: int):
    """Links among fingerprints of an equal run number (ascending)."""
    outs, d, at = [], 1, np.arange(len(fp))
    while True:
        at = at[at + d < len(fp)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        near = np.bitwise_count(fp[at] ^ fp[at + d]) <= bits
        a = at[near]
        if len(a):
            good = a[_canonical(fp[a], fp[a + d], v[a])]
            outs.append((fp[good], fp[good + d]))
        d += 1
    if not outs:
        return fp[:0], fp[:0]
    a, b = np.concatenate([x for x, _ in outs]), np.concatenate([x for _, x in outs])
    return _forest(a, b) if len(a) > 4 * len(fp) else (a, b)


_OUT = "kind int, u bigint, v bigint, key bigint, fps array<bigint>"


def _batch(u, v, chunks):
    n, m = len(u), len(chunks)
    none = [None] * m
    return pa.RecordBatch.from_arrays([
        pa.array([0] * n + [1] * m, pa.int32()), pa.array(np.asarray(u, np.uint64).view(np.int64).tolist() + none, pa.int64()), pa.array(np.asarray(v, np.uint64).view(np.int64).tolist() + none, pa.int64()),
        pa.array([None] * n + [k for k, _ in chunks], pa.int64()), pa.array([None] * n + [f.view(np.int64).tolist() for _, f in chunks], pa.list_(pa.int64())),
    ], names=["kind", "u", "v", "key", "fps"])


def _runs(batches, bits: int, chunk: int = CHUNK):
    """Links of whole short runs; runs at a task's edge and long ones as chunks."""
    edge, keys, fps = True, np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def cut(keys, fps, first, last):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[starts, len(keys)])
        out = size > chunk
        if first:
            out[0] = True
        if last:
            out[-1] = True
        chunks = [(int(keys[s]), fps[i:min(i + chunk, s + n)]) for s, n in zip(starts[out], size[out]) for i in range(s, s + n, chunk)]
        keep = np.repeat(~out & (size > 1), size)
        k = keys[keep]
        u, v = _within(k >> 22, fps[keep], np.cumsum(np.r_[0, k[1:] != k[:-1]]) if len(k) else k, bits)
        return _batch(u, v, chunks)

    for b in batches:
        keys = np.r_[keys, b.column("key").to_numpy()]
        fps = np.r_[fps, b.column("fp").to_numpy().view(np.uint64)]
        if not len(keys):
            continue
        tail = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        while len(keys) - tail > 16 * chunk:  # a very long run leaves in chunks as it comes
            if tail:
                yield cut(keys[:tail], fps[:tail], edge, False)
                keys, fps, edge, tail = keys[tail:], fps[tail:], False, 0
            yield _batch([], [], [(int(keys[0]), fps[i:i + chunk]) for i in range(0, 16 * chunk, chunk)])
            keys, fps, edge = keys[16 * chunk:], fps[16 * chunk:], True
        if tail > 65536:
            yield cut(keys[:tail], fps[:tail], edge, False)
            keys, fps, edge = keys[tail:], fps[tail:], False
    if len(keys):
        yield cut(keys, fps, edge, True)


def _across(batches, bits: int):
    """Links between two chunks of a variant, or inside one (the second is null)."""
    for b in batches:
        us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for key, one, two in zip(b.column("key").to_pylist(), b.column("one").to_pylist(), b.column("two").to_pylist()):
            x = np.array(one, np.int64).view(np.uint64)
            y = x if two is None else np.array(two, np.int64).view(np.uint64)
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= bits)
            on = x[i] < y[j] if two is None else x[i] != y[j]
            u, v = x[i[on]], y[j[on]]
            good = _canonical(u, v, np.full(len(u), key >> 22))
            u, v = u[good], v[good]
            if len(u) > 4 * (len(x) + len(y)):
                u, v = _forest(u, v)
            us.append(u)
            vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], names=["u", "v"])


def links(fps: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that differ in at most `bits` (5 or fewer)
    bits: all of them, or a spanning forest of those under one variant."""
    if bits > 5:
        raise ValueError("three segments with one wildcard cover at most 5 bits")
    keys = []
    for at, size in SEGMENTS:
        part = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1))
        for i in range(size):
            keys.append(F.lit((at + i) << 22).bitwiseOR(part.bitwiseAND(F.lit(((1 << size) - 1) & ~(1 << i)))))
    variants = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    dealt = variants.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    found = settle(dealt.mapInArrow(partial(_runs, bits=bits, chunk=chunk), _OUT))
    chunks = found.where("kind = 1").select("key", "fps", F.xxhash64("fps").alias("c"))
    met = chunks.alias("x").join(chunks.alias("y"), F.expr("x.key = y.key and x.c < y.c")).select("x.key", F.col("x.fps").alias("one"), F.col("y.fps").alias("two"))
    alone = chunks.where(F.size("fps") > 1).select("key", F.col("fps").alias("one"), F.lit(None).cast("array<bigint>").alias("two"))
    return found.where("kind = 0").select("u", "v").union(met.union(alone).mapInArrow(partial(_across, bits=bits), "u bigint, v bigint"))


def linked(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root) of each of the distinct fingerprints (column fp): root is the least one that it reaches."""
    distinct = settle(distinct.select("fp"))
    roots = components(links(distinct, bits))
    return settle(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")))


def groups(own: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of own (id, fp)."""
    least = settle(own.groupBy("fp").agg(F.min("id").alias("least")))
    named = settle(least.join(linked(least, bits), "fp"))
    ids = settle(named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")))  # alone, so that a root of many prints can be split
    return named.join(ids, named.root == ids.r).select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fingerprint, component_id): documents whose fingerprints are linked, directly or through others.

    component_id is the least id that a document reaches, itself included; null where a component
    has only null ids. Texts without words (null, empty, white space) have fingerprint zero and are
    linked like any other. Copies share a fingerprint, which is compared once; repeated rows give
    repeated rows. Other columns of docs are not read. An empty table gives an empty result.
    """
    own = settle(fingerprints(docs, id_col, text_col))
    return own.join(groups(own, bits), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
