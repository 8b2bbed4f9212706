"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into segments: a run of word marks and what follows it up to the next mark.
No piece of a supported model has a mark after another character (checked on loading), so
segments never influence each other. The distinct segments of a batch lie in one flat numpy
symbol array. Each round takes the smallest pair rank of every segment, merges the leftmost
non-overlapping pairs of that rank at once, and compacts; segments without a pair leave.
Where one of several equal merges would make a pair that ranks no later than itself, only the
leftmost is merged in that round, so the order is always that of the one-at-a-time algorithm.

Segments of LONG and more characters are first cut where two characters meet that stand side by side
in no piece, as no merge crosses such a place. What still is LONG goes through the same rounds, but
its pairs are kept by rank and its symbols as a linked list of arrays, so that a round touches the
pairs it merges and their neighbours instead of the whole segment. Where equal merges keep waiting for
one another (a run of thousands of spaces), the rest of the segment is merged one pair at a time.
"""
from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

MARK = "▁"
INF = np.int32(2**31 - 1)
LONG = 1024
#: Rounds of a long segment in which equal merges wait for one another, before it goes on one pair at a time.
WAITS = 64
#: Entries of a worker's memo of segments, and the longest segment kept in it.
MEMO, MEMO_CHARS = 150_000, 64


class PieceModel:
    """Pair ranks and piece tables of a BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n, t = proto.normalizer_spec, proto.trainer_spec
        if (t.model_type != 2 or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces
                or not n.escape_whitespaces or t.treat_whitespace_as_suffix or not t.byte_fallback):
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and byte fallback")
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(p.type in (4, 5) for p in proto.pieces) or any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("user-defined or unused pieces, or marks inside pieces, are not supported")
        self.size = len(proto.pieces)
        self.ids = {p: i for i, p, _ in normal}
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.rank_of = np.full(self.size, INF, np.int32)
        for i, _, s in normal:
            self.rank_of[i] = order[s]
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = [byte[b] for b in range(256)]
        self.byte_of = {i: b for b, i in byte.items()}
        # symbols: a piece, a character that only occurs inside pieces, or FREE + code point
        self.symbols = dict(self.ids)
        for _, p, _ in normal:
            for c in p:
                self.symbols.setdefault(c, self.size + len(self.symbols))
        self.free = max(self.symbols.values()) + 1
        self.text_of = {i: p for p, i in self.symbols.items()}
        pairs = {}
        for i, p, _ in normal:
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.pairs = pairs
        self.bits = max(12, int(len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.zeros(1 << self.bits, np.int32)
        todo_k, todo_v = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(todo_k)
        while len(todo_k):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.vals[slot[won]] = todo_k[won], todo_v[won]
            rest = np.ones(len(todo_k), bool)
            rest[won] = False
            todo_k, todo_v, slot = todo_k[rest], todo_v[rest], (slot[rest] + 1) & (len(self.keys) - 1)
        chars = {c: s for c, s in self.symbols.items() if len(c) == 1}
        self.char = np.arange(0x110000, dtype=np.int32) + self.free
        for c, s in chars.items():
            self.char[ord(c)] = s
        codes = np.frombuffer("\n".join(p for _, p, _ in normal).encode("utf-32-le"), np.uint32)
        inside = (codes[:-1] != 10) & (codes[1:] != 10) if "\n" not in self.symbols else np.ones(len(codes) - 1, bool)
        self.beside = np.unique((self.char[codes[:-1]].astype(np.int64) << 32 | self.char[codes[1:]])[inside])
        self.piece_bytes = [b"" if p.type in (2, 3) else bytes([self.byte_of[i]]) if i in self.byte_of else p.piece.replace(MARK, " ").encode() for i, p in enumerate(proto.pieces)]
        self.names = np.array([str(i) for i in range(self.size)], dtype=object)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = (left.astype(np.int64) << 32) | right
        out = np.full(len(key), -1, np.int32)
        at, slot = np.arange(len(key)), self._slot(key)
        while len(at):
            there = self.keys[slot]
            hit = there == key
            out[at[hit]] = self.vals[slot[hit]]
            on = ~hit & (there != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def ranks(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank_of[piece], INF)


def merge_rounds(m: PieceModel, sym: np.ndarray, seg: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges with their segments (0..n-1, ascending); both arrays are flat."""
    done_sym, done_seg = [], []
    makes = np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        same = seg[1:] == seg[:-1]
        at = np.flatnonzero(same)
        makes[at] = m.merged(sym[at], sym[at + 1])
    rank = m.ranks(makes)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        sizes = np.diff(np.r_[starts, len(sym)])
        low = np.minimum.reduceat(rank, starts)
        live = low < INF
        if not live.all():
            keep = np.repeat(live, sizes)
            done_sym.append(sym[~keep])
            done_seg.append(seg[~keep])
            sym, seg, makes, rank = sym[keep], seg[keep], makes[keep], rank[keep]
            low, sizes = low[live], sizes[live]
            if not len(sym):
                break
        least = np.repeat(low, sizes)
        cand = np.flatnonzero(rank == least)
        # neighbouring candidates overlap: every second one of a run goes
        run = np.flatnonzero(np.r_[True, np.diff(cand) != 1])
        offset = np.arange(len(cand)) - np.repeat(run, np.diff(np.r_[run, len(cand)]))
        pick = cand[(offset & 1) == 0]
        owner = seg[pick]
        many = np.zeros(len(pick), bool)
        twin = owner[1:] == owner[:-1]
        many[1:] |= twin
        many[:-1] |= twin
        if many.any():
            p = pick[many]
            new, nxt = makes[p], p + 2
            bad = np.zeros(len(p), bool)
            has_next = (nxt < len(sym)) & (seg[np.minimum(nxt, len(sym) - 1)] == seg[p])
            chosen = np.full(len(sym) + 1, -1, np.int32)
            chosen[p] = new
            over = np.minimum(nxt, len(sym) - 1)
            for right in (sym[over], np.where(chosen[over] >= 0, chosen[over], sym[over])):
                got = m.ranks(m.merged(new, right))
                bad |= has_next & (got <= least[p])
            has_prev = (p > 0) & (seg[np.maximum(p - 1, 0)] == seg[p])
            back = np.maximum(p - 2, 0)
            joined = (p > 1) & (chosen[back] >= 0) & (seg[back] == seg[p])
            for left in (sym[np.maximum(p - 1, 0)], np.where(joined, chosen[back], sym[np.maximum(p - 1, 0)])):
                got = m.ranks(m.merged(left, new))
                bad |= has_prev & (got <= least[p])
            if bad.any():
                drop = np.isin(owner, seg[p[bad]])
                drop &= np.r_[False, twin]
                pick = pick[~drop]
        sym[pick] = makes[pick]
        keep = np.ones(len(sym), bool)
        keep[pick + 1] = False
        place = np.cumsum(keep) - 1
        pick = place[pick]
        sym, seg, makes, rank = sym[keep], seg[keep], makes[keep], rank[keep]
        makes[pick], rank[pick] = -1, INF
        left = pick[pick > 0] - 1
        left = left[seg[left] == seg[left + 1]]
        right = pick[pick + 1 < len(sym)]
        right = right[seg[right] == seg[right + 1]]
        at = np.r_[left, right]
        if len(at):
            makes[at] = m.merged(sym[at], sym[at + 1])
            rank[at] = m.ranks(makes[at])
    if not done_sym:
        return sym, seg
    sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
    order = np.argsort(seg, kind="stable")
    return sym[order], seg[order]


def loose(m: PieceModel, sym: np.ndarray) -> np.ndarray:
    """Where a segment of characters may be cut: places (from 1) between two that no piece has side by side."""
    key = sym[:-1].astype(np.int64) << 32 | sym[1:]
    at = np.minimum(np.searchsorted(m.beside, key), len(m.beside) - 1)
    return np.flatnonzero(m.beside[at] != key) + 1


def merge_ranked(m: PieceModel, sym: np.ndarray) -> np.ndarray:
    """merge_rounds of one long segment, by rank."""
    n = len(sym)
    sym = np.r_[sym, np.int32(0)]  # the place after the end: no pair, and never alive
    after, before = np.r_[np.arange(1, n + 1), n], np.r_[-1, np.arange(n)]
    alive = np.r_[np.ones(n, bool), False]
    makes = np.full(n + 1, -1, np.int32)
    rank = np.full(n + 1, INF, np.int32)
    buckets: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def offer(at: np.ndarray) -> None:
        """The pairs that start at these places, anew."""
        right = after[at]
        made = np.where(right < n, m.merged(sym[at], sym[right]), -1).astype(np.int32)
        makes[at], rank[at] = made, m.ranks(made)
        at = at[made >= 0]
        order = np.argsort(rank[at], kind="stable")
        at = at[order]
        heads = np.flatnonzero(np.r_[True, rank[at][1:] != rank[at][:-1]]) if len(at) else []
        for part in np.split(at, heads[1:]) if len(at) else ():
            put(int(rank[part[0]]), part)

    def put(r: int, at: np.ndarray) -> None:
        if r not in buckets:
            buckets[r] = []
            heapq.heappush(queue, r)
        buckets[r].append(at)

    offer(np.arange(n))
    waits = 0
    while queue:
        if waits > WAITS:
            return np.array(merge_one_by_one(m, sym[:n][alive[:n]].tolist()), np.int32)
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(buckets.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])  # neighbours overlap: every second one of a run goes
        offset = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        pick = at[(offset & 1) == 0]
        if len(pick) > 1:
            new, right, left = makes[pick], after[after[pick]], before[pick]
            chosen = np.full(n + 1, -1, np.int32)
            chosen[pick] = new
            bad = np.zeros(len(pick), bool)
            for side in (sym[right], np.where(chosen[right] >= 0, chosen[right], sym[right])):
                bad |= (right < n) & (m.ranks(m.merged(new, side)) <= r)
            far = np.where(left > 0, before[left], 0)
            joined = (left > 0) & (chosen[far] >= 0) & (after[far] == left)
            for side in (sym[left], np.where(joined, chosen[far], sym[left])):
                bad |= (left >= 0) & (m.ranks(m.merged(side, new)) <= r)
            if bad.any():  # what follows the first of these waits for the pairs that it makes
                stop = int(np.argmax(bad)) + 1
                waits += 1
                if stop < len(pick):
                    put(r, at[at > pick[stop - 1]])
                pick = pick[:stop]
        gone = after[pick]
        sym[pick], alive[gone] = makes[pick], False
        right = after[gone]
        after[pick] = right
        before[right] = pick
        left = before[pick]
        offer(np.unique(np.r_[pick, left[left >= 0]]))
    return sym[:n][alive[:n]]


def merge_one_by_one(m: PieceModel, sym: list[int]) -> list[int]:
    """What is left of a segment, one pair at a time."""
    n = len(sym)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank_of = m.rank_of.tolist()
    pair = lambda i, j: (rank_of[got], i, j, sym[i], sym[j], got) if (got := m.pairs.get(sym[i] << 32 | sym[j])) is not None else None
    queue = [p for i in range(n - 1) if (p := pair(i, i + 1))]
    heapq.heapify(queue)
    while queue:
        _, i, j, a, b, got = heapq.heappop(queue)
        if not (alive[i] and alive[j]) or sym[i] != a or sym[j] != b or after[i] != j:
            continue
        sym[i], alive[j], after[i] = got, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (p := pair(x, y)):
                heapq.heappush(queue, p)
    return [s for s, on in zip(sym, alive) if on]


def encode_segments(m: PieceModel, segments: list[str]) -> list[list[int]]:
    """Piece ids of each segment (a mark, then its key with spaces as marks)."""
    out: list = [[] for _ in segments]
    words = [MARK + s.replace(" ", MARK) for s in segments]
    codes = m.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    cut = [np.zeros(0, np.int64)]
    for i in np.flatnonzero(sizes >= LONG).tolist():
        cut.append(loose(m, codes[ends[i] - sizes[i]:ends[i]]) + ends[i] - sizes[i])
    starts = np.union1d(np.concatenate(cut), ends - sizes)
    size = np.diff(np.r_[starts, len(codes)])
    part = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    short = np.repeat(size < LONG, size)
    sym, seg = merge_rounds(m, codes[short], part[short], len(starts))
    for k in np.flatnonzero(size >= LONG).tolist():
        got = merge_ranked(m, codes[starts[k]:starts[k] + size[k]])
        at = np.searchsorted(seg, k)
        sym, seg = np.concatenate([sym[:at], got, sym[at:]]), np.concatenate([seg[:at], np.full(len(got), k, np.int32), seg[at:]])
    bounds = np.searchsorted(seg, np.searchsorted(starts, np.r_[ends - sizes, len(codes)])).tolist()
    odd = set(np.searchsorted(ends, starts[seg[sym >= m.size]], side="right").tolist())
    flat = sym.tolist()
    for i in range(len(segments)):
        ids = flat[bounds[i]:bounds[i + 1]]
        out[i] = _ids(m, ids) if i in odd else ids
    return out


def _ids(m: PieceModel, sym: list[int]) -> list[int]:
    """Characters outside the vocabulary become the pieces of their bytes."""
    out: list[int] = []
    for s in sym:
        if s < m.size:
            out.append(s)
        else:
            text = chr(s - m.free) if s >= m.free else m.text_of[s]
            out.extend(m.byte_ids[b] for b in text.encode())
    return out


def decode_ids(m: PieceModel, ids: list[int], first: bool = True) -> bytes:
    """UTF-8 of the decoded ids; first drops the dummy prefix. Broken byte runs give U+FFFD a byte."""
    raw = b"".join([m.piece_bytes[i] for i in ids])
    try:
        raw.decode()
    except UnicodeDecodeError:
        raw = _repair(m, ids)
    return raw[1:] if first and raw[:1] == b" " and ids[0] not in m.byte_of else raw


def _repair(m: PieceModel, ids: list[int]) -> bytes:
    out, run = [], bytearray()

    def flush() -> None:
        k = 0
        while k < len(run):
            for size in (1, 2, 3, 4):
                try:
                    bytes(run[k:k + size]).decode()
                except UnicodeDecodeError:
                    continue
                out.append(bytes(run[k:k + size]))
                k += size
                break
            else:
                out.append("�".encode())
                k += 1
        run.clear()

    for i in ids:
        if i in m.byte_of:
            run.append(m.byte_of[i])
        else:
            flush()
            out.append(m.piece_bytes[i])
    flush()
    return b"".join(out)


def segments_of(text: str) -> list[str]:
    """Keys of a text's segments: what follows the first mark of each; further marks are spaces."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    import re

    return [s[1:] for s in re.findall(" +[^ ]*", " " + text)]


class Codec:
    """A worker's memo of segments over one model: key -> (ids as text, number of ids, decoded bytes)."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.memo: dict[str, str] = {}
        self.text: dict[str, bytes] = {}

    def fill(self, keys: set[str]) -> dict[str, str]:
        """Encodings of keys that the memo lacks; the short ones stay in it."""
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.text.clear()
        keys = list(keys)
        once: dict[str, str] = {}
        names = self.model.names
        for k, ids in zip(keys, encode_segments(self.model, keys)):
            got = ",".join(names[ids])
            if len(k) <= MEMO_CHARS:
                self.memo[k] = got
            else:
                once[k] = got
            if got not in self.text:
                self.text[got] = decode_ids(self.model, ids, first=False)
        return once

    def batch(self, texts: list[str | None]) -> list[tuple[str, bytes]]:
        """(ids as text, decoded UTF-8) of each text; the decoding reads the ids alone."""
        split = [segments_of(t or "") for t in texts]
        missing = set()
        for words in split:
            missing.update(words)
        missing.difference_update(self.memo)
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            self.text.clear()
            missing = set().union(*split) if split else set()
        once = self.fill(missing) if missing else {}
        get = self.memo.__getitem__ if not once else lambda k: self.memo[k] if k in self.memo else once[k]
        out = []
        for words in split:
            ids = list(map(get, words))
            raw = b"".join(map(self.text.__getitem__, ids))
            out.append((",".join(ids), raw[1:] if raw[:1] == b" " else raw))
        if once:
            for got in once.values():
                self.text.pop(got, None)
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. A null or empty
    text has no ids. Very long texts are encoded whole, one at a time; so are long segments without a
    space. Repeated rows give repeated rows; null ids stay null; other columns of df, whatever their
    names, are not read. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    base = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = base.schema["k"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        c = codec(model_path)
        for whole in batches:
            for b in slices(whole, "t", 2 << 20):
                got = c.batch(b.column("t").to_pylist())
                cols = [
                    b.column("k"),
                    pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in got], pa.string()),
                    pa.array([hashlib.sha256(raw).hexdigest() for _, raw in got], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = ",".join(ids for ids, _ in got if ids)
                    values = np.fromstring(flat, dtype=np.int32, sep=",") if flat else np.zeros(0, np.int32)
                    ends = np.r_[0, np.cumsum(cols[1].to_numpy())].astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return base.mapInArrow(run, schema)
