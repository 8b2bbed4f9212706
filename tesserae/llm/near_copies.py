"""Groups of near copies: SimHash links and links of texts with a Jaccard similarity of at least 0.8.

The similarity is that of the sets of five-word shingles. Candidates share one of BANDS keys, each
made of ROWS minima of hashed shingles: of pairs at 0.8 all but 3 in a million do. Texts that SimHash
has linked are one group from the start; a key whose texts are all of one group is dropped.

Of the texts of a key that is left one leads: that which stands in the largest keys altogether, so the
text that most others are copies of. The others meet it alone, and what is linked falls together.
Where a key's texts still are of different groups, all meet in chunks, as arrays. Sketches come first:
each pair in the first key that it shares; a text without a partner whose sketch agrees as it does, but
for 5 in a million, at a similarity of 0.8 is done. The others meet again with their whole sets, the
most alike first, and not if they have fallen together meanwhile; only links are put out, so no pair
of a group is a row unless it is one of the links that span it.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import settle, ship, slices
from .components import components

SEED, SHINGLE = 42, 5
BANDS, ROWS = 24, 4
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Least number of equal bytes in two sketches of BANDS * ROWS bytes: 4.4 standard deviations under the mean at 0.8.
AGREE = 60
#: Texts of a chunk that bears sketches, and of one that bears sets.
CHUNK, FULL = 256, 64
#: Tasks that a key is dealt to where its size is not known yet, and members of a task where it is.
SALTS, HOT = 8, 1000
#: Rows, and bytes, of what is broadcast.
SMALL, SMALL_BYTES = 200_000, 16 << 20
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the different five-word shingles (of all words, where there are fewer); none without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    n = len(words)
    parts = (b" ".join(words[i:i + SHINGLE]) for i in range(max(1, n - SHINGLE + 1))) if n else ()
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of BANDS * ROWS permutations."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[a:a + 4096, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
    return low


def sketch_of(low: np.ndarray) -> bytes:
    """A byte of each minimum; the high bits of minima are alike, so they are mixed first."""
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def keys_of(low: np.ndarray) -> np.ndarray:
    """A key for each band."""
    low = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ low[:, j]) * _FACTORS[0, 0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("t"))


def _read(base: DataFrame) -> DataFrame:
    """(id, node, fp, keys, sketch) of each document; no keys and no sketch without words."""
    def run(batches):
        for whole in batches:
            for b in slices(whole, "t", 2 << 20):
                texts = b.column("t").to_pylist()
                fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
                low = [minima(s) if len(s := shingles(t)) else None for t in texts]
                keys = pa.array([None if x is None else keys_of(x) for x in low], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("node"), pa.array(fps), keys, pa.array([None if x is None else sketch_of(x) for x in low], pa.binary())], names=["id", "node", "fp", "keys", "sketch"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, node bigint, fp bigint, keys array<bigint>, sketch binary")


def _sets(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the texts in nodes."""
    wanted = F.broadcast(nodes) if nodes.count() <= SMALL else nodes

    def run(batches):
        for whole in batches:
            for b in slices(whole, "t", 2 << 20):
                sets = [shingles(t).view(np.int64) for t in b.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    few = base.select("node", "t").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    return few.mapInArrow(run, "node bigint, hashes array<bigint>")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=-1) >= AGREE


def _bytes(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _alike(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, u, v, x, y) those whose sketches x and y agree enough."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_agree(_bytes(b.column("x")), _bytes(b.column("y"))))).select(["a", "b", "u", "v"])

    return pairs.select("a", "b", "u", "v", "x", "y").mapInArrow(run, "a bigint, b bigint, u bigint, v bigint")


def _similar(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """Of the distinct pairs (a, b, u, v) the (u, v) whose texts a and b are similar enough. The sets of
    the b, which are few where they lead, are broadcast if their counted bytes are bounded."""
    sets = settle(_sets(base, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    two = settle(two.join(pairs.select("b").distinct(), "b", "left_semi"))
    size = two.agg(F.sum(8 * F.size("y") + 64)).first()[0] or 0
    both = F.size(F.array_intersect("x", "y"))
    least, of = LEAST
    met = pairs.join(one, "a").join(F.broadcast(two) if size <= SMALL_BYTES else two, "b")
    return met.where(of * both >= least * (F.size("x") + F.size("y") - both)).select("u", "v").distinct()


def _counted(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with the size n of their key, from stats (key, n), a written table of narrow rows: broadcast if it is
    counted to be small, else with each key dealt to SALTS tasks."""
    if stats.count() <= SMALL:
        return rows.join(F.broadcast(stats), "key")
    stats = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(stats.hint("merge"), ["key", "salt"]).drop("salt")


def _apart(members: DataFrame) -> DataFrame:
    """Of members (key, node, root, sketch) those whose key holds more than one root, with the key's size n."""
    stats = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key", "n")
    return _counted(members, settle(stats))


def _led(members: DataFrame) -> DataFrame:
    """Pairs (a, b, u, v, x, y): each member with the leader of its keys. A key of many members is dealt to as many tasks as it needs."""
    weight = settle(members.groupBy("node").agg(F.sum("n").alias("c")))
    ranked = members.join(weight, "node")
    lead = ranked.groupBy("key").agg(F.max_by(F.struct("node", "root", "sketch"), F.struct("c", "node")).alias("m"), F.max("n").alias("n"))
    parts = F.ceil(F.col("n") / HOT).cast("int")
    lead = settle(lead).select("key", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    met = members.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int")).join(lead, ["key", "salt"]).where("root <> m.root")
    return met.select(F.col("node").alias("a"), F.col("m.node").alias("b"), F.col("root").alias("u"), F.col("m.root").alias("v"), F.col("sketch").alias("x"), F.col("m.sketch").alias("y"))


def _chunks(members: DataFrame, size: int) -> DataFrame:
    """Pairs (key, one, two) of the chunks of each key's members (with n, the key's size); two is null for a chunk by
    itself. Keys of one chunk, which are most, take no part in the join."""
    cols = [c for c in members.columns if c not in ("key", "n")]
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / size)).alias("c")
    chunks = settle(members.groupBy("key", part, (F.col("n") > size).alias("more")).agg(F.collect_list(F.struct(*cols)).alias("rows")))
    many = chunks.where("more")
    two = many.alias("x").join(many.alias("y"), F.expr("x.key = y.key and x.c < y.c")).select("x.key", F.col("x.rows").alias("one"), F.col("y.rows").alias("two"))
    return two.union(chunks.select("key", F.col("rows").alias("one"), F.lit(None).cast(chunks.schema["rows"].dataType).alias("two")))


def _candidates(key: int, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Places in two chunks of texts of different roots whose sketches agree, and of whose common keys this is the first."""
    xs, ys = _bytes(x.field("sketch")), _bytes(y.field("sketch"))
    xr, yr = x.field("root").to_numpy(zero_copy_only=False), y.field("root").to_numpy(zero_copy_only=False)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(xs), 16):
        p, q = np.nonzero(_agree(xs[i:i + 16, None], ys[None]) & (xr[i:i + 16, None] != yr[None]))
        found.append((p + i, q))
    p, q = (np.concatenate(z) for z in zip(*found))
    if y is x:
        p, q = p[p < q], q[p < q]
    if not len(p):
        return p, q
    one, two = (z.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS) for z in (x, y))
    here = one[p, np.argmax(one[p] == two[q], axis=1)] == key
    return p[here], q[here]


def _met(batches):
    """Members (key, node, root) that have a candidate."""
    for b in batches:
        rows = [(0, 0, 0)][:0]
        for key, one, two in zip(b.column("key").to_pylist(), b.column("one"), b.column("two")):
            x = one.values
            y = x if two.values is None else two.values
            for z, at in zip((x, y), _candidates(key, x, y)):
                at = np.unique(at)
                rows += zip([key] * len(at), *(z.field(c).to_numpy(zero_copy_only=False)[at].tolist() for c in ("node", "root")))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["key", "node", "root"])


def _similar_sets(x: np.ndarray, y: np.ndarray) -> bool:
    least, of = LEAST
    if of * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return of * both >= least * (len(x) + len(y) - both)


def _linked(batches):
    """Links (u, v) of roots whose texts are similar enough, without those that follow from others of the same two chunks."""
    for b in batches:
        links = [(0, 0)][:0]
        for key, one, two in zip(b.column("key").to_pylist(), b.column("one"), b.column("two")):
            x = one.values
            y = x if two.values is None else two.values
            p, q = _candidates(key, x, y)
            order = np.argsort(-(_bytes(x.field("sketch"))[p] == _bytes(y.field("sketch"))[q]).sum(axis=1), kind="stable") if len(p) else []
            xr, yr = x.field("root").to_pylist(), y.field("root").to_pylist()
            up: dict = {}

            def top(r):
                while r in up:
                    r = up[r]
                return r

            for i, j in zip(p[order].tolist(), q[order].tolist()):
                u, v = top(xr[i]), top(yr[j])
                if u != v and _similar_sets(x.field("hashes")[i].values.to_numpy(), y.field("hashes")[j].values.to_numpy()):
                    up[max(u, v)] = min(u, v)
                    links.append((xr[i], yr[j]))
        yield pa.RecordBatch.from_arrays([pa.array([z[k] for z in links], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _rest(members: DataFrame, texts: DataFrame, base: DataFrame) -> DataFrame:
    """Links (u, v) among a key's members that are still apart."""
    keyed = members.join(texts.select("node", "keys"), "node")
    some = settle(_chunks(keyed, CHUNK).mapInArrow(_met, "key bigint, node bigint, root bigint").distinct())
    stats = settle(some.groupBy("key").agg(F.count("*").alias("n")))
    sets = _sets(base, settle(some.select("node").distinct()))
    whole = settle(texts.select("node", "sketch", "keys").join(sets, "node"))
    return _chunks(_counted(some, stats).join(whole, "node"), FULL).mapInArrow(_linked, "u bigint, v bigint").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = simhash.BITS) -> DataFrame:
    """(id, component_id): groups of documents that SimHash or the similarity links, directly or through others.

    Ids are of any type that can be ordered, and not null; component_id is the least id of a group.
    Null and empty texts and those without words have the fingerprint zero, which SimHash links. Very
    long texts are read whole, a few at a time. Repeated rows give repeated rows; other columns are
    not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    base = _base(docs, id_col, text_col)
    read = settle(_read(base))
    fps = simhash.linked(read.select("fp").distinct(), bits)  # (fp, root)
    rows = settle(read.select("id", "node", "fp").join(fps, "fp").select("id", "node", "root"))
    texts = settle(read.where("keys is not null").select("node", "fp", "keys", "sketch").dropDuplicates(["node"]).join(fps, "fp").select("node", "root", "sketch", "keys"))
    members = settle(_apart(texts.select("node", "root", "sketch", F.explode("keys").alias("key"))))
    for star in (True, False):
        if members.isEmpty():
            break
        roots = settle(components(_similar(settle(_alike(_led(members).distinct())), base) if star else _rest(members, texts, base)))
        rows = settle(rows.join(roots.select(F.col("node").alias("was"), F.col("root").alias("least")), F.col("root") == F.col("was"), "left").select("id", "node", F.coalesce("least", "root").alias("root")))
        if star:
            new = members.drop("n").join(roots.withColumnRenamed("root", "least"), members.root == roots.node, "left").select("key", members.node, F.coalesce("least", "root").alias("root"), "sketch")
            members = settle(_apart(new))
    ids = settle(rows.groupBy(F.col("root").alias("r")).agg(F.min("id").alias("component_id")))
    return rows.join(ids, rows.root == ids.r).select(F.col("id").alias(id_col), "component_id")
