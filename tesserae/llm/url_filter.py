"""URL filters: longest-prefix rules over hosts and paths, and a Bloom filter cascade for a list of hosts.

Level 0 of the cascade is a Bloom filter of the listed keys. Level 1 holds those keys of the corpus
that are not listed but pass level 0, level 2 the listed ones that pass level 1, and so on until a
level lets no wrong key through. The levels are built over the complete key universe of the corpus
(every host and parent domain that occurs), so asking them in turn gives exact membership, with no
join when urls are judged. Keys are dealt to segments by hash, each with its own cascade of bounded
size; all segments are broadcast as long as their size is under a bound, and beyond it urls are
judged segment by segment in passes, each with its own bounded broadcast.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, settle, ship

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Listed hosts of the registered query; a listed host stands for its subdomains too.
LISTED = tuple(f"{name}.example.{tld}" for name in ("spam-farm", "casino-win") for tld in ("com", "net", "org"))
RATE = 1 / 64
#: Bytes of filters in one broadcast.
BROADCAST_BYTES = 64 << 20
#: Words of a filter that one task hands to the driver at most, about.
WORDS_A_TASK = 1 << 20


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path) that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domains_of(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def _probes(key: Column, level: int, bits: int, hashes: int) -> Column:
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(bits)) for i in (0, 1))
    return F.array(*(F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(hashes)))


class Cascade:
    """Bit arrays of the levels. Probes are computed in the JVM, bits are looked up in numpy."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]]):
        self.levels = levels

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for _, _, w in self.levels)

    def passes(self, probes: np.ndarray, level: int) -> np.ndarray:
        words = self.levels[level][2]
        return ((words[probes >> 6] >> (probes & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def _filter(keys: DataFrame, level: int, count: int, rate: float) -> tuple[int, int, np.ndarray]:
    """A Bloom filter of the column k: set bits are gathered as words, by partial aggregation."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, -(-int(count * hashes / math.log(2)) // 64) * 64)
    at = keys.select(F.explode(_probes(F.col("k"), level, bits, hashes)).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    def pack(batches):
        for b in batches:  # words as bytes: a row for each batch, not for each word
            w, v = b.column("w").to_numpy().astype("<i8"), b.column("v").to_numpy().astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["w", "v"])

    out = np.zeros(bits // 64, np.uint64)
    words = words.coalesce(-(-bits // 64 // WORDS_A_TASK))  # each partition is a job of its own below
    for r in words.mapInArrow(pack, "w binary, v binary").toLocalIterator():  # 16 bytes for each of at most bits / 64 words, whose number was checked
        out[np.frombuffer(r.w, "<i8")] = np.frombuffer(r.v, "<i8").view(np.uint64)
    return bits, hashes, out


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """Keys that a level lets through."""
    spark = keys.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(cascade.levels[level])
    bits, hashes, _ = cascade.levels[level]

    def run(batches):
        one = Cascade([sent.value])
        for b in batches:
            p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, hashes)
            yield b.filter(pa.array(one.passes(p, 0))).select(["k"])

    return keys.select("k", _probes(F.col("k"), level, bits, hashes).alias("p")).mapInArrow(run, "k string")


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = RATE, max_bytes: int = BROADCAST_BYTES) -> Cascade:
    """A cascade for the distinct keys of `listed` (column k) that is exact on every key of `universe`.

    A key that is repeated in `universe` only makes filters larger.
    Raises ValueError where level 0 would be over max_bytes: deal the keys to more segments then.
    """
    inside = settle(listed.where("k is not null").distinct())
    outside = universe.where("k is not null").join(inside, "k", "left_anti")
    n = inside.count()
    if n * -math.log2(rate) / math.log(2) / 8 > max_bytes:
        raise ValueError("too many listed keys for one filter")
    cascade = Cascade([])
    now, other, level = inside, outside, 0
    while n:
        cascade.levels.append(_filter(now, level, n, rate))
        wrong = settle(_passing(other, cascade, level))
        n = wrong.count()
        now, other, level = wrong, now, level + 1
        if level > 40:
            raise RuntimeError("cascade did not end")
    return cascade


def segments_for(n_keys: int, rate: float = RATE, max_bytes: int = BROADCAST_BYTES) -> int:
    """Segments for so many listed keys, each of which fits a broadcast with room for later levels."""
    return max(1, -(-int(n_keys * -math.log2(rate) / math.log(2) / 4) // max_bytes))


def listed_hosts(urls: DataFrame, listed: DataFrame, host: str, max_bytes: int = BROADCAST_BYTES, rate: float = RATE) -> DataFrame:
    """urls with a boolean column __listed: whether the host or a parent domain is a key of listed (column k)."""
    spark = urls.sparkSession
    ship(spark)
    universe = settle(urls.select(F.col(host).alias("h")).distinct().select(F.explode(domains_of(F.col("h"))).alias("k")).distinct())
    keys = settle(listed.select(lower_ascii(F.col("k")).alias("k")).distinct())
    n = segments_for(keys.count(), rate, max_bytes)
    out = urls.withColumn("__listed", F.lit(False))
    names = out.columns
    for s in range(n):
        here = F.pmod(F.xxhash64("k", F.lit(77)), F.lit(n)) == s
        cascade = build_cascade(keys.where(here), universe.where(here), rate, max_bytes) if n > 1 else build_cascade(keys, universe, rate, max_bytes)
        if not cascade.levels:
            continue
        sent = spark.sparkContext.broadcast(cascade)
        shape = [(b, h) for b, h, _ in cascade.levels]
        mine = F.filter(domains_of(F.col(host)), lambda k: F.pmod(F.xxhash64(k, F.lit(77)), F.lit(n)) == s) if n > 1 else domains_of(F.col(host))
        probes = [F.flatten(F.transform(mine, _ask(i, b, h))) for i, (b, h) in enumerate(shape)]
        asked = out.select("*", F.size(mine).alias("__n"), *(p.alias(f"__p{i}") for i, p in enumerate(probes)))
        schema = out.schema
        out = asked.mapInArrow(_asker(sent, [h for _, h in shape], names), schema)
        if n > 1:
            out = settle(out)
    return out


def _ask(level: int, bits: int, hashes: int):
    return lambda k: _probes(k, level, bits, hashes)


def _asker(sent, hashes: list[int], names: list[str]):
    def run(batches):
        cascade = sent.value
        for b in batches:
            count = b.column("__n").to_numpy()
            total = int(count.sum())
            depth = np.zeros(total, np.int64)
            live = np.arange(total)
            for i, h in enumerate(hashes):
                p = b.column(f"__p{i}").flatten().to_numpy(zero_copy_only=False).reshape(total, h)
                live = live[cascade.passes(p[live], i)] if len(live) else live
                depth[live] = i + 1
            hit = depth % 2 == 1  # stopped by a level of wrong keys, or past the last, which holds listed ones
            ends = np.cumsum(count)
            any_hit = np.diff(np.r_[0, np.r_[0, np.cumsum(hit)][ends]]) > 0
            was = b.column("__listed").to_numpy(zero_copy_only=False).astype(bool)
            cols = [pa.array(was | any_hit) if c == "__listed" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule and verdict of every row of pages.

    A rule (host, path prefix) fits its host and all subdomains; the longest one wins. Without a
    rule the verdict is block if the host or a parent domain is among the keys of listed (column
    k), else allow. Null urls and those without :// have an empty host and path and are allowed. Long
    urls count whole. Repeated rows give repeated rows; null ids stay null; other columns are not
    read. An empty table gives an empty result; without listed keys rules alone decide.
    """
    base = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("__u")).select(F.col(id_col), host_of(F.col("__u")).alias("__host"), path_of(F.col("__u")).alias("__path"))
    found = listed_hosts(base, listed, "__host")
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    return found.select(F.col(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))


def listed_table(spark: SparkSession, hosts=LISTED) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, hosts))).alias("k"))


def oracle_sql(hosts=LISTED, rules=RULES) -> str:
    fits = "\n".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for h, p, _ in sorted(rules, key=lambda r: -len(r[0] + r[1])))
    verdicts = " ".join(f"when '{h}{p}' then '{v}'" for h, p, v in rules)
    listed = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in hosts)
    az = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, {az.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from cut),
ruled as (select *, case {fits} else null end as rule from parts)
select page_id, host, path, rule, coalesce(case rule {verdicts} end, case when {listed} then 'block' else 'allow' end) as verdict from ruled"""
