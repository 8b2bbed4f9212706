"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut into
overlapping windows, each is compressed with both, and what the toxic dictionary saves is the
window's gain. A logistic calibration, cross-fitted on gains of texts whose dictionaries had not seen
them, turns a document's gains into a score.

A toxic text is mostly ordinary words, so the toxic dictionary is trained in rounds: first on all
windows of the toxic texts, then on the windows of each toxic text that gained most under a
dictionary trained on the other half of the toxic texts. Windows and dictionary shrink from round to
round (PLAN) and only the best windows of a text are looked at again, so that what recurs in toxic
texts alone is left. Both dictionaries then get the
ordinary content at their near end; the toxic one has the toxic content before it, and the ordinary
one as many bytes that match nothing, so that distances, which cost bits, are alike.

There are two such pairs (SIZES), with more and with less ordinary content: much of it explains
away toxic words that are made of common syllables, little shows them better.

Every window starts with a fixed ballast that both dictionaries end with, so that none is stored
uncompressed, which would hide the lengths.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_names, ship, slices

WINDOW, OVERLAP = 64, 12
BALLAST = bytes(range(128, 176))
#: Bounds of the labelled sample: texts of each class, and bytes of the longest text in it.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 600, 1800, 32_768
#: Bytes of ordinary content in each pair of dictionaries.
SIZES = (131_072, 32_768)
#: Rounds of the toxic dictionary: its bytes, and the step and overlap of the windows.
PLAN = ((8192, 16, 8), (4096, 12, 8), (3072, 8, 6), (2048, 6, 6), (1536, 6, 6))
#: Windows that a toxic text gives to the next round, and folds of the calibration.
TOP, FOLDS = 8, 3
#: Times as many windows stay in sight for the rounds that follow.
LOOK = 4


def normal(text: str | None) -> bytes:
    return (" " + " ".join((text or "").lower().split()) + " ").encode()


def windows(text: bytes, step: int = WINDOW, overlap: int = OVERLAP) -> list[bytes]:
    return [text[i:i + step + overlap] for i in range(0, len(text), step)]


def compressor(content: bytes):
    import zstandard as z

    p = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
                                    window_log=18, hash_log=17, chain_log=19, search_log=4, min_match=5, strategy=z.STRATEGY_BTLAZY2)
    d = z.ZstdCompressionDict(content + BALLAST, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p)


def lengths(c, parts: list[bytes]) -> np.ndarray:
    """Compressed bytes of each part after the ballast."""
    if not parts:
        return np.zeros(0, np.int64)
    return np.fromiter((len(x) for x in c.multi_compress_to_buffer([BALLAST + p for p in parts], threads=1)), np.int64, len(parts))


def gains_of(ordinary, toxic, texts: list[bytes], step: int = WINDOW, overlap: int = OVERLAP) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """For each text the bytes that the toxic dictionary saves on each window, and the windows."""
    cut = [windows(t, step, overlap) for t in texts]
    flat = [w for own in cut for w in own]
    gain = lengths(ordinary, flat) - lengths(toxic, flat)
    return np.split(gain, np.cumsum([len(x) for x in cut])[:-1]) if cut else [], cut


def dictionary(parts: list[bytes], size: int, k: int) -> bytes:
    """A dictionary trained by zstandard on the parts, of at most half their bytes. Its segments are k bytes
    long, or longer where so short ones do not fill it; too little text to train on is taken as it is."""
    import zstandard as z

    size, best = min(size, max(512, sum(map(len, parts)) // 2)), b""
    for long in (k, k * 3 // 2, k * 2, k * 3):
        try:
            got = z.train_dictionary(size, parts, k=long, d=6, level=3, split_point=1.0).as_bytes()
        except (z.ZstdError, ValueError):
            continue
        best = max(best, got, key=len)
        if len(best) >= 0.95 * size:
            break
    return (best or b"".join(parts))[-size:]


def filler(n: int) -> bytes:
    """Bytes that match nothing: control characters, which normal() leaves out."""
    return np.random.default_rng(0).integers(1, 8, n).astype(np.uint8).tobytes()


def train_pair(toxic: list[bytes], ordinary: list[bytes], size: int, plan=PLAN, top: int = TOP) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary, without the ballast."""
    base = dictionary([t[i:i + 256] for t in ordinary for i in range(0, len(t), 256)], size, 48)
    halves = [[[t] for t in toxic[a::2]] for a in (0, 1)]  # of each text the parts that are still looked at
    kept = [[w for parts in half for t in parts for w in windows(t, *plan[0][1:])] for half in halves]
    for room, step, overlap in plan:
        plain, new = compressor(filler(room) + base), []
        for a in (1, 0):
            found = compressor(dictionary(kept[1 - a], room, 10) + base)
            cut = [[w for t in parts for w in windows(t, step, overlap)] for parts in halves[a]]
            flat = [w for own in cut for w in own]
            gain, at = lengths(plain, flat) - lengths(found, flat), 0
            own, halves[a] = [], []
            for mine in cut:
                best = [(mine[i], gain[at + i]) for i in np.argsort(-gain[at:at + len(mine)], kind="stable")[:LOOK * top]]
                own += [w for w, g in best[:top] if g > 1]
                halves[a].append([w for w, g in best if g > 0])
                at += len(mine)
            new.append(own)
        kept = new[::-1]
    last = dictionary(kept[0] + kept[1], plan[-1][0], 10)
    return filler(len(last)) + base, last + base


@dataclass
class Dictionaries:
    """Contents of the pairs (ordinary, toxic), without the ballast."""

    pairs: list[tuple[bytes, bytes]]

    @staticmethod
    def train(toxic: list[bytes], ordinary: list[bytes], sizes: tuple[int, ...] = SIZES) -> Dictionaries:
        return Dictionaries([train_pair(toxic, ordinary, s) for s in sizes])

    def gains(self, texts: list[bytes]) -> list[list[np.ndarray]]:
        """For each text and pair the gains of its windows."""
        if not hasattr(self, "_made"):
            self._made = [tuple(compressor(x) for x in pair) for pair in self.pairs]
        return [list(g) for g in zip(*(gains_of(*pair, texts)[0] for pair in self._made))]

    def __getstate__(self):
        return {"pairs": self.pairs}

    def __setstate__(self, state):
        self.__dict__.update(state)


def features(gains: list[np.ndarray]) -> list[float]:
    """What the calibration sees of a text: its greatest gains, and how many are great, for each pair."""
    return [x for g in gains for x in _features(g)]


def _features(gain: np.ndarray) -> list[float]:
    n = max(1, len(gain))
    best = np.r_[np.sort(gain)[::-1][:8], np.zeros(8)]
    share = [float(np.sqrt((gain >= j).sum() / n)) for j in (1, 2, 3, 4)]
    many = [float(np.sqrt(min(50, (gain >= j).sum()))) for j in (2, 3, 4)]
    return [*(float(best[:j].sum()) for j in (1, 2, 4, 8)), *share, *many, float(np.clip(gain.mean() if len(gain) else 0, -2, 5)), float(np.log1p(n))]


@dataclass
class Model:
    """Dictionaries with the calibration; without dictionaries, a constant score."""

    dictionaries: Dictionaries | None
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), float(self.weights[0]))
        x = np.array([features(g) for g in self.dictionaries.gains(texts)]).reshape(len(texts), -1)
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: float = 1.0, l2: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], l2 * len(x) / 100)
    pen[0] = 1e-9
    own = np.where(y > 0, 1.0, weight)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (own * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen), x.T @ (own * (y - p)) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[bytes], toxic: list[int], weight: float = 1.0) -> Model:
    """Each fold is calibrated on dictionaries of the others; the last ones see all. An ordinary text counts weight times."""
    y = np.array(toxic, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(None, np.array([y.mean() if len(y) else 0.0]), np.zeros(0), np.ones(0))
    rank = np.empty(len(y), int)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        rank[own] = np.arange(len(own))
    pick = lambda on, c: [t for t, k, good in zip(texts, toxic, on) if k == c and good]
    x = None
    for part in range(FOLDS):
        learn = rank % FOLDS != part
        if not pick(learn, 0) or not pick(learn, 1):
            learn = np.ones(len(y), bool)
        d = Dictionaries.train(pick(learn, 1), pick(learn, 0))
        own = np.flatnonzero(rank % FOLDS == part)
        if len(own):
            got = np.array([features(g) for g in d.gains([texts[i] for i in own])])
            x = np.zeros((len(y), got.shape[1])) if x is None else x
            x[own] = got
    mean, scale = x.mean(0), x.std(0) + 1e-6
    every = np.ones(len(y), bool)
    return Model(Dictionaries.train(pick(every, 1), pick(every, 0)), _logistic((x - mean) / scale, y, weight), mean, scale)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Of each class the rows with the least hash of their id are taken, up to toxic_rows and
    ordinary_rows; texts of over sample_bytes stay out of the sample. In the calibration the classes
    weigh as in all labelled rows. Several labels of one id count as toxic if one does; null ids and
    labels are left out. With no labels, or one class only, the score is the constant share of toxic
    labels.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    order = [F.xxhash64("k"), F.col("k")]
    sample = known.where("y = 1").orderBy(*order).limit(toxic_rows).union(known.where("y = 0").orderBy(*order).limit(ordinary_rows))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") <= sample_bytes)
    rows = texts.join(F.broadcast(sample), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).collect()  # at most toxic_rows + ordinary_rows
    rows.sort(key=lambda r: (str(r.k), r.t))
    all_, own = {r.y: r["count"] for r in known.groupBy("y").count().collect()}, [r.y for r in rows]
    share = lambda y: all_.get(y, 0) / max(1, own.count(y))
    return fit([normal(r.t) for r in rows], own, share(0) / share(1) if share(1) else 1.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns in keep, which lead), score and predicted of every whole text.

    A null or empty text is scored as a text of one blank. Repeated rows give repeated rows. A kept
    column called score or predicted gets an underscore at its end. Long texts are scored window by
    window; nothing is cut off. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    lead = list(keep or [id_col])
    inner = [f"c{i}" for i in range(len(lead))]
    base = docs.select(*(F.col(c).alias(n) for c, n in zip(lead, inner)), *([] if text_col in lead else [F.col(text_col).cast("string").alias("t")]))
    text = inner[lead.index(text_col)] if text_col in lead else "t"
    if base.schema[text].dataType.simpleString() != "string":
        base, text = base.withColumn("t", F.col(text).cast("string")), "t"
    shown = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in inner)

    def run(batches):
        m = sent.value
        for whole in batches:
            for b in slices(whole, text, 2 << 20):
                got = m.scores([normal(t) for t in b.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in inner), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*inner, "score", "predicted"])

    got = base.mapInArrow(run, f"{shown}, score double, predicted int")
    return got.toDF(*kept_names(lead, ("score", "predicted")), "score", "predicted")
