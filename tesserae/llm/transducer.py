"""Token counts by a deterministic transducer compiled from a BPE piece model.

The encoding of a prefix of a segment is that of a shorter prefix and one last piece: the one whose
pair with the last piece there is left alone by the merges. So a left-to-right automaton suffices.
Its state holds, for each suffix of what was read that pieces may still start with, the place in
the trie of pieces, the last piece before that suffix, and how many tokens fewer there were; the
transition for a character moves to the next state and is annotated with the change of the count.
States and transitions are made as texts need them and kept in one table for a worker.

A text is cut into segments (no piece crosses their bounds) and those into chunks of CHUNK
characters. A chunk has a state map: for each entry state that can occur there the state at its end
and the count of its tokens. All chunks run in step through the table as lanes of numpy arrays: first
from the start state, then from each end state of the chunk before that its map lacks, until no map
lacks one. States that different entries lead to are kept once, and as runs of the automaton soon
meet, maps have one or two entries. The maps of a segment are then composed by a parallel prefix scan:
in each round every map is composed with the one at twice the distance of the round before.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .sentencepiece_codec import INF, MARK, PieceModel

CHUNK = 128
#: Columns of the dense table: four for characters outside the vocabulary (by UTF-8 length), the others for the
#: characters of it that come first; transitions of the further ones are kept in a hash table of arrays.
COLUMNS, FOREIGN = 224, 4
#: States after which the table is emptied and compiled anew.
STATES, SPARSE = 120_000, 2_000_000
_BIAS, _STEP = 32, 64


class Sparse:
    """Whole numbers by whole-number key, in arrays with open addressing."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        out, at, slot = np.full(len(key), -1, np.int32), np.arange(len(key)), self._slot(key)
        while len(at):
            there = self.keys[slot]
            hit = there == key
            out[at[hit]] = self.vals[slot[hit]]
            on = ~hit & (there != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, key: np.ndarray, val: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.n + len(key)) > len(self.keys):
            old = self.keys >= 0
            big = Sparse(max(self.bits + 1, int(4 * (self.n + len(key))).bit_length()))
            big.put(self.keys[old], self.vals[old])
            self.__dict__.update(big.__dict__)
        self.n += len(key)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.vals[slot[won]] = key[won], val[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, val, slot = key[rest], val[rest], (slot[rest] + 1) & (len(self.keys) - 1)


class Transducer:
    def __init__(self, path: str):
        m = self.model = PieceModel(path)
        if m.free != m.size:
            raise ValueError("every character of a piece must be a piece")
        self.trie: list[dict[str, int]] = [{}]
        self.piece = [-1]
        for text, i in m.ids.items():
            node = 0
            for c in text:
                nxt = self.trie[node].get(c)
                if nxt is None:
                    nxt = self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece.append(-1)
                node = nxt
            self.piece[node] = i
        self.column = np.full(0x110000, -1, np.int16)
        code = np.arange(0x110000)
        known = np.zeros(0x110000, bool)
        known[[ord(c) for c in m.symbols if len(c) == 1]] = True
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        self.column[~known] = (size - 1)[~known]
        self.column[0x20] = -1  # a space stands for the mark
        self.chars: list[str] = [""] * FOREIGN
        self.history: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((1024, COLUMNS), -1, np.int32)
        self.sparse = Sparse()
        self.start = self.state(((0, -1, 0),))

    def state(self, entries: tuple) -> int:
        s = self.names.get(entries)
        if s is None:
            s = self.names[entries] = len(self.states)
            self.states.append(entries)
            if s == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[s, :FOREIGN] = (self.start if s else 0) * _STEP + _BIAS + np.arange(1, FOREIGN + 1)
        return s

    def merges(self, piece: int) -> tuple:
        """Of the merges that make a piece: ranks in order, its first and its last symbol before each and at the end; None if they make others."""
        got = self.history.get(piece)
        if got is None:
            m = self.model
            sym = [m.symbols[c] for c in m.text_of[piece]]
            ranks, first, last = [], [sym[0]], [sym[-1]]
            while True:
                best = min(((int(m.rank_of[p]), i, p) for i in range(len(sym) - 1) if (p := m.pairs.get((sym[i] << 32) | sym[i + 1])) is not None), default=None)
                if best is None:
                    break
                sym[best[1]:best[1] + 2] = [best[2]]
                ranks.append(best[0])
                first.append(sym[0])
                last.append(sym[-1])
            got = self.history[piece] = (ranks, first, last) if sym == [piece] else (None, None, None)
        return got

    def apart(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay two when one follows the other (a < 0: nothing before b)."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is not None:
            return got
        two, first, _ = self.merges(b)
        if two is None or a < 0:
            got = two is not None
        else:
            one, _, last = self.merges(a)
            m, i, j = self.model, 0, 0
            while True:
                p = m.pairs.get((last[i] << 32) | first[j])
                ra, rb = one[i] if i < len(one) else INF, two[j] if j < len(two) else INF
                if p is not None and m.rank_of[p] < ra and m.rank_of[p] <= rb:
                    got = False
                    break
                if ra == INF and rb == INF:
                    got = True
                    break
                if ra <= rb:
                    i += 1
                else:
                    j += 1
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = got
        return got

    def step(self, s: int, c: str) -> int:
        """State and change of the count for a character of the vocabulary, as one number."""
        live, found = [], None
        for node, last, fewer in self.states[s]:
            nxt = self.trie[node].get(c)
            if nxt is None:
                continue
            p = self.piece[nxt]
            if p >= 0 and found is None and self.apart(last, p):
                found = (p, fewer + 1)
            if self.trie[nxt]:
                live.append((nxt, last, fewer))
        piece, change = found
        to = self.state((*((n, q, f - change) for n, q, f in live), (0, piece, 0)))
        return to * _STEP + _BIAS + change

    def run(self, code: np.ndarray, col: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End state and count of each lane; lanes are runs of the flat arrays, by falling size."""
        state, count = state.copy(), np.zeros(len(start), np.int64)
        ends = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for k, n in enumerate(ends.tolist()):
            at = start[:n] + k
            c, s = col[at], state[:n]
            got = self.table[s, c]
            if c.min() < 0:
                far = np.flatnonzero(c < 0)
                got[far] = self.sparse.get(s[far] * np.int64(0x200000) + code[at[far]])
            odd = np.flatnonzero(got < 0)
            if len(odd):
                key = s[odd] * np.int64(0x200000) + code[at[odd]]
                pairs, back = np.unique(key, return_inverse=True)
                made = np.empty(len(pairs), np.int32)
                far = np.zeros(len(pairs), bool)
                for i, q in enumerate(pairs.tolist()):
                    made[i], far[i] = self.transition(q >> 21, q & 0x1FFFFF)
                self.sparse.put(pairs[far], made[far])
                got[odd] = made[back]
            state[:n] = got >> 6
            count[:n] += (got & (_STEP - 1)) - _BIAS
        return state, count

    def transition(self, s: int, code: int) -> tuple[int, bool]:
        """The transition, made if need be, and whether the character has no column."""
        ch = MARK if code == 0x20 else chr(code)
        col = int(self.column[code])
        if col < 0 and len(self.chars) < COLUMNS:  # the character gets a column
            col = len(self.chars)
            self.chars.append(ch)
            self.column[ord(ch)] = col
            if ch == MARK:
                self.column[0x20] = col
        if col < 0:
            got = self.sparse.get(np.array([s << 21 | code], np.int64))[0]
            return (int(got), False) if got >= 0 else (self.step(s, ch), True)
        if self.table[s, col] < 0:
            got = self.step(s, ch)
            self.table[s, col] = got
        return int(self.table[s, col]), False

    def maps(self, code: np.ndarray, col: np.ndarray, start: np.ndarray, size: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, ...]:
        """State maps of chunks as entries (chunk, entry state, end state, count), by chunk and entry state.

        nth numbers the chunks of a segment from 0. The maps are closed: the end state of every
        entry of a chunk is an entry of the next one of its segment.
        """
        n = len(start)
        new = np.arange(n, dtype=np.int64) << 32 | self.start
        keys, ends, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        goes_on = np.r_[nth[1:] > 0, False]
        while len(new):
            chunk = new >> 32
            by = np.argsort(-size[chunk], kind="stable")
            end, count = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
            end[by], count[by] = self.run(code, col, start[chunk[by]], size[chunk[by]], (new & 0xFFFFFFFF)[by])
            order = np.argsort(np.r_[keys, new], kind="stable")
            keys, ends, counts = np.r_[keys, new][order], np.r_[ends, end][order], np.r_[counts, count][order]
            on = goes_on[chunk]
            new = np.unique((chunk[on] + 1) << 32 | end[on])
            there = keys[np.minimum(np.searchsorted(keys, new), len(keys) - 1)] == new
            new = new[~there]
        return keys >> 32, keys & 0xFFFFFFFF, ends, counts

    @staticmethod
    def compose(chunk: np.ndarray, entry: np.ndarray, end: np.ndarray, count: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """For each entry the count from its chunk to the end of the segment, by doubling distances."""
        keys = chunk << 32 | entry
        goes_on = np.r_[nth[1:] > 0, False][chunk]
        last = len(keys)  # one entry more, which leads to itself and counts nothing
        to = np.where(goes_on, np.searchsorted(keys, (chunk + 1) << 32 | end), last)
        to, total = np.r_[to, last], np.r_[count, 0]
        while (to[:-1] != last).any():
            total, to = total + total[to], to[to]
        return total[:-1]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES or self.sparse.n > SPARSE:
            self.reset()
        full = [t for t in texts if t]
        out = np.zeros(len(texts), np.int64)
        if not full:
            return out
        code = np.frombuffer((" " + " ".join(full)).encode("utf-32-le"), np.uint32)
        heads = np.cumsum([0] + [len(t) + 1 for t in full])
        mark = (code == 0x20) | (code == ord(MARK))
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[heads[:-1]] = True
        seg = np.flatnonzero(first)
        length = np.diff(np.r_[seg, len(code)])
        parts = -(-length // CHUNK)
        owner = np.repeat(np.arange(len(seg)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = seg[owner] + nth * CHUNK, np.minimum(length[owner] - nth * CHUNK, CHUNK)
        col = self.column[code]
        chunk, entry, end, count = self.maps(code, col, start, size, nth)
        total = self.compose(chunk, entry, end, count, nth)
        head = np.flatnonzero(nth == 0)
        whole = total[np.searchsorted(chunk << 32 | entry, head << 32 | self.start)]  # of each segment
        sums = np.r_[0, np.cumsum(whole)]
        bound = np.searchsorted(seg, heads)
        total = sums[bound]
        out[[i for i, t in enumerate(texts) if t]] = np.diff(total)
        return out


_MADE: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _MADE:
        _MADE[path] = Transducer(path)
    return _MADE[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as an empty one: 0 bytes, 0 tokens. Repeated rows give repeated rows, null
    ids stay null, other columns are not read, an empty table gives an empty result. Memory is
    bounded by a batch of texts and the table of STATES states.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        t = transducer(model_path)
        for whole in batches:
            for b in slices(whole, "t", 1 << 20):
                texts = [x or "" for x in b.column("t").to_pylist()]
                n = t.counts(texts)
                yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return base.mapInArrow(run, f"`{id_col}` {base.schema['k'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
