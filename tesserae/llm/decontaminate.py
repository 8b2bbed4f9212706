"""Benchmark decontamination by winnowing.

Both sides are cut into words (runs of digits, letters and non-ASCII characters, A-Z lower-cased).
For windows of L words the hashes of k-grams are taken and, in every run of L-k+1 of them, the
smallest is kept, ties included. A span of L words that both sides share holds the same k-grams,
so at least one fingerprint of it is kept on both sides: no shared window is missed. Kept
fingerprints of the documents are looked up among those of the items; each hit is extended to the
windows of L words around it, which are compared word by word.

The item side is broadcast in blocks of bounded size. A larger benchmark takes more blocks, one
after another, each adding to what the former found; documents are never shuffled.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, kept_names, ship, slices

U = np.uint64
TOP = U(2**64 - 1)
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20
_LUT = np.arange(256, dtype=np.uint8)
_LUT[0x41:0x5B] += 32
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _LUT[_a:_b + 1] = 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of a run of texts: hash, byte length and text number of each."""

    STEP = 1 << 20

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]]
        offs = offs - offs[0]
        low = _LUT[raw]
        on = np.zeros(len(low) + 1, bool)
        on[1:] = low != 0
        first = on[1:] & ~on[:-1]
        heads = offs[:-1][offs[:-1] < len(low)]
        first[heads] = on[1:][heads]
        last = np.zeros(len(low), bool)
        if len(low):
            last[:-1] = on[1:-1] & (~on[2:] | first[1:])
            last[-1] = on[-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.length = (ends - starts).astype(np.int64)
        self.hash = np.empty(len(starts), U)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + self.STEP)))
            s, n = starts[a:b] - starts[a], int(ends[b - 1] - starts[a])
            part, inside = low[starts[a]:ends[b - 1]], np.arange(n)
            inside -= np.repeat(s, np.diff(np.r_[s, n]))
            power = _powers(int(inside.max()) + 1)
            self.hash[a:b] = np.add.reduceat(part.astype(U) * power[inside], s)  # separators weigh 0
            a = b
        self.hash = _mix(self.hash + self.length.astype(U) * U(0x9E3779B97F4A7C15))
        self.text = np.searchsorted(offs[1:], starts, side="right")
        self.counts = np.bincount(self.text, minlength=len(texts))


_POW = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 256), U(0x100000001B3 * 31 + 2), U)
        p[0] = 1
        _POW = np.cumprod(p, dtype=U)
    return _POW


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, U)
    for j in range(k):
        g = g * U(0xD6E8FEB86659FD93) + h[j:j + n]
    return _mix(g)


def winnow(words: Words, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """k, the k-gram hashes, and which of them are the smallest of a run inside one text."""
    k = min(5, size)
    w = size - k + 1
    g = _grams(words.hash, k)
    keep = np.zeros(len(g), bool)
    n = len(words.hash) - size + 1
    if n <= 0:
        return k, g, keep
    inside = words.text[:n] == words.text[size - 1:]
    low = g[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j:j + n], out=low)
    for j in range(w):
        keep[j:j + n] |= inside & (g[j:j + n] == low)
    return k, g, keep


class ItemIndex:
    """Fingerprints and windows of a block of items, for each window length that occurs."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.names = [r[0] for r in rows]
        words = Words(pa.array([r[1] for r in rows], pa.string()))
        self.parts = []
        sizes = np.minimum(words.counts, 10)
        for size in sorted(set(sizes[sizes > 0].tolist())):
            n = len(words.hash) - size + 1
            k, g, keep = winnow(words, size)
            mine = sizes[words.text] == size
            prints = np.unique(g[keep & mine[:len(g)]])
            at = np.flatnonzero((words.text[:n] == words.text[size - 1:]) & mine[:n])
            window = _grams(words.hash, size)[at]
            order = np.argsort(window, kind="stable")
            at, window = at[order], window[order]
            head = np.r_[True, window[1:] != window[:-1]] if len(window) else np.zeros(0, bool)
            reps = at[head]
            spell = words.hash[reps[:, None] + np.arange(size)] if len(reps) else np.zeros((0, size), U)
            bound = np.r_[np.flatnonzero(head), len(window)]
            seen = np.zeros(1 << 20, bool)
            seen[(prints & U((1 << 20) - 1)).astype(np.int64)] = True
            self.parts.append((size, k, prints, seen, window[head], spell, bound, words.text[at]))


def find(words: Words, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """Hit words as a mask, and the distinct (text, item) pairs with an occurring window."""
    hit, pairs = np.zeros(len(words.hash), bool), [np.zeros((0, 2), np.int64)]
    for size, k, prints, seen, windows, spell, bound, items in index.parts:
        _, g, keep = winnow(words, size)
        at = np.flatnonzero(keep)
        at = at[seen[(g[at] & U((1 << 20) - 1)).astype(np.int64)]]
        at = at[prints[np.minimum(np.searchsorted(prints, g[at]), len(prints) - 1)] == g[at]] if len(prints) else at[:0]
        if not len(at):
            continue
        s = np.unique(at[:, None] - np.arange(size - k + 1))
        s = s[(s >= 0) & (s + size <= len(words.hash))]
        s = s[words.text[s] == words.text[s + size - 1]]
        run = words.hash[s[:, None] + np.arange(size)]
        key = np.zeros(len(s), U)
        for j in range(size):
            key = key * U(0xD6E8FEB86659FD93) + run[:, j]
        slot = np.minimum(np.searchsorted(windows, _mix(key)), len(windows) - 1)
        good = (spell[slot] == run).all(axis=1)
        s, slot = s[good], slot[good]
        if not len(s):
            continue
        edge = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + size, -1)
        hit |= np.cumsum(edge[:-1]) > 0
        met = np.unique(np.stack([words.text[s], slot], 1), axis=0)
        count = bound[met[:, 1] + 1] - bound[met[:, 1]]
        where = np.repeat(bound[met[:, 1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs.append(np.stack([np.repeat(met[:, 0], count), items[where]], 1))
    return hit, np.unique(np.concatenate(pairs), axis=0)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The distinct items in blocks of about block_bytes; each block alone comes to the driver."""
    items = checkpoint(items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct())
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.toLocalIterator()]


OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Words of each document inside a window of 10 words of an item (of all its words, if fewer).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and item_ids (the items,
    sorted as strings); with keep, the named columns of docs are carried along and lead the result.
    A null or empty text has no words and is clean; a long one is searched whole. Items with a null id
    or text take no part; repeated items count once, repeated documents give repeated rows. Either
    table may be empty. A kept column called as one of the result's gets an underscore at its end.
    """
    ship(docs.sparkSession)
    lead = list(keep or [doc_id])
    inner = [f"c{i}" for i in range(len(lead))]
    state = docs.select(*(F.col(c).alias(n) for c, n in zip(lead, inner)), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"), *([] if text in lead else [F.col(text).cast("string").alias("t")]))
    name = inner[lead.index(text)] if text in lead else "t"
    if state.schema[name].dataType.simpleString() != "string":
        state, name = state.withColumn("t", F.col(name).cast("string")), "t"
    shown = ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in inner)
    blocks, first = _blocks(items, item_id, item_text, block_bytes), True
    block = next(blocks, None)
    while True:
        after = next(blocks, None)
        last = after is None
        sent = docs.sparkSession.sparkContext.broadcast(ItemIndex(block or []))
        if not first:
            state = checkpoint(state)
        schema = f"{shown}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>" if last else state.schema
        state = state.mapInArrow(_scanner(sent, name, inner, last), schema)
        first, block = False, after
        if last:
            return state.toDF(*kept_names(lead, OWN), *OWN)


def _scanner(sent, name: str, keep: list[str], last: bool):
    def run(batches):
        index = sent.value
        for whole in batches:
            for b in slices(whole, name, 2 << 20):
                words = Words(b.column(name))
                hit, pairs = find(words, index)
                ends = np.r_[0, np.cumsum(words.counts)]
                before = b.column("hit").to_pylist()
                met = b.column("items").to_pylist()
                for i, old in enumerate(before):
                    if old is not None and words.counts[i]:
                        hit[ends[i]:ends[i + 1]] |= np.unpackbits(np.frombuffer(old, np.uint8), count=int(words.counts[i])).astype(bool)
                found: dict[int, set] = {i: set(x) for i, x in enumerate(met) if x}
                for d, i in pairs.tolist():
                    found.setdefault(d, set()).add(index.names[i])
                if not last:
                    bits = [np.packbits(hit[ends[i]:ends[i + 1]]).tobytes() if i in found else None for i in range(b.num_rows)]
                    cols = [pa.array(bits, pa.binary()) if n == "hit" else pa.array([sorted(found[i]) if i in found else None for i in range(b.num_rows)], pa.list_(pa.string())) if n == "items" else b.column(n) for n in b.schema.names]
                    yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
                    continue
                n_hit = np.bincount(words.text[hit], minlength=b.num_rows)
                names = [sorted(found.get(i, ())) for i in range(b.num_rows)]
                cols = [b.column(c) for c in keep]
                cols += [pa.array(words.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()),
                         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array(n_hit > 0), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *OWN])

    return run


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select distinct cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
iw as (select distinct item, n, array_to_string(w[k:k + n - 1], ' ') as win from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select rid, n, k, array_to_string(w[k:k + n - 1], ' ') as win from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
met as (select rid, k, n, item from dw join iw using (n, win)),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + n)) as p from (select distinct rid, k, n from met)) group by 1),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from met) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join its using (rid)"""
