"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest directory.

Terms are [a-z0-9]+(.[0-9]+)* of the lower-cased text. The weight of a term is its count times
ln((1 + N) / (1 + df)) + 1, where N and df, the number of texts that hold it, are counted over all
texts and for all terms. Compared with each template are every line and every paragraph of a text
(its headers) and the text as a whole. A text whose whole reaches the threshold is a licence file of
that licence; so is one with a licence header and a name like LICENSE or COPYING. A file without a
licence of its own takes that of the nearest directory, its own or an ancestor, that holds a licence
file.

Everything is DataFrame functions. Of the counts only those of the templates' own terms come to the
driver. A text, then a line or paragraph, is compared only if it holds one of the anchor terms: they
are chosen so that the rest of no template's weight could reach the threshold, hence nothing that
reaches it is passed over. Terms of what is left meet their counts in an equality join; those that
stand in many texts, of which there can be few, are broadcast.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_names, settle
from .licences import TEMPLATES

THRESHOLD = 0.75
SALTS = 32
#: Rows of the table of common terms that is broadcast.
COMMON = 200_000
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)[^/]*$"
PARAGRAPH = r"\n[ \t\r]*\n"
OWN = ("path", "license", "score", "how", "from_dir")


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def counted(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in re.findall(TERM, text.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def frequencies(texts: DataFrame) -> tuple[int, DataFrame]:
    """Number of the texts (column t), and the table (term, df) of all their terms."""
    each = texts.select(F.explode(F.concat(F.array_distinct(terms_of(F.coalesce("t", F.lit("")))), F.array(F.lit(" ")))).alias("term"))
    table = settle(each.groupBy("term").agg(F.count("*").alias("df")))
    n = table.where("term = ' '").first()
    return n.df if n else 0, table.where("term <> ' '")


class Weights:
    """Template vectors and anchors for given frequencies of the templates' terms."""

    def __init__(self, n: int, df: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0))) + 1
        self.vectors, anchors = [], set()
        for name, text in templates:
            w = {t: c * idf(t) for t, c in counted(text).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.vectors.append((name, {t: x / norm for t, x in w.items()}))
            left = 1.0
            for t in sorted(w, key=lambda t: (t not in anchors, df.get(t, 0), t)):
                if left < (threshold * 0.999) ** 2:
                    break
                anchors.add(t)
                left -= (w[t] / norm) ** 2
        self.anchors = sorted(anchors)
        self.pattern = "(?i)[^A-Za-z0-9](?:" + "|".join(map(re.escape, sorted(anchors, key=lambda t: (-len(t), t)))) + ")(?![A-Za-z0-9])"

    def held(self, text: Column) -> Column:
        """Whether a text holds an anchor; a blank in front makes a bound of its start."""
        return F.concat(F.lit(" "), text).rlike(self.pattern)

    def table(self, spark) -> DataFrame:
        """(term, shares): a row for each term of the templates, with its share of each."""
        terms = sorted({t for _, v in self.vectors for t in v})
        return spark.createDataFrame([(t, [v.get(t, 0.0) for _, v in self.vectors]) for t in terms], "term string, shares array<double>")


def scores(texts: DataFrame, n: int, dfs: DataFrame, w: Weights) -> DataFrame:
    """(key, head, whole) of texts (key, t) that hold an anchor; head and whole are structs (score, order), order being
    minus the template's number."""
    spark = texts.sparkSession
    unit = lambda u, whole: F.struct(terms_of(u).alias("terms"), F.lit(whole).alias("whole"))
    some = F.filter(F.array_union(F.split("t", "\n"), F.split("t", PARAGRAPH)), w.held)
    units = texts.select("key", F.posexplode(F.concat(F.transform(some, lambda u: unit(u, False)), F.array(unit(F.col("t"), True)))).alias("u", "x"))
    each = units.select("key", "u", F.col("x.whole").alias("whole"), F.explode("x.terms").alias("term")).groupBy("key", "u", "whole", "term").agg(F.count("*").alias("n"))
    each = settle(each)
    least = max(1.0, n / 1000)
    while dfs.where(F.col("df") > least).count() > COMMON:
        least *= 2
    common, rare = dfs.where(F.col("df") > least), dfs.where(F.col("df") <= least)
    met = each.join(F.broadcast(common), "term", "left")
    met = met.where("df is not null").union(met.where("df is null").drop("df").join(rare, "term").select(met.columns))
    x = F.col("n") * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)
    met = met.join(F.broadcast(w.table(spark)), "term", "left").select("key", "u", "whole", x.alias("x"), "shares")
    parts = [F.sum(F.col("x") * F.get("shares", F.lit(i))).alias(f"d{i}") for i in range(len(w.vectors))]
    sums = met.groupBy("key", "u", "whole").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *parts)
    best = F.greatest(*(F.struct(F.round(F.coalesce(f"d{i}", F.lit(0.0)) / F.col("norm"), 6).alias("score"), F.lit(-i).alias("order")) for i in range(len(w.vectors)))) if len(w.vectors) > 1 else F.struct(F.round(F.coalesce("d0", F.lit(0.0)) / F.col("norm"), 6).alias("score"), F.lit(0).alias("order"))
    return sums.select("key", "whole", best.alias("b")).groupBy("key").agg(F.max(F.when(~F.col("whole"), F.col("b"))).alias("head"), F.max(F.when(F.col("whole"), F.col("b"))).alias("whole"))


def scan(df: DataFrame, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of df, and: path, license, score, how (header, file, inherited or none), from_dir.

    from_dir is the directory whose licence file a row inherits from. A null or empty text has no
    header; a null path lies in no directory, so neither inherits nor bequeaths. Long texts are
    compared whole. Equal scores go to the template that comes first; among licence files of one
    directory the highest score counts, then the template that comes first. Repeated rows give
    repeated rows. A kept column called as one of the result's gets an underscore at its end. An
    empty table gives an empty result.
    """
    names = F.array(*(F.lit(name) for name, _ in templates))
    kept = [f"__k{i}" for i in range(len(keep or []))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(keep or [], kept)), F.col(path_col).cast("string").alias("__p"), F.col(text_col).cast("string").alias("t"))
    n, dfs = frequencies(rows)
    vocabulary = sorted({t for _, x in templates for t in counted(x)})
    w = Weights(n, {r.term: r.df for r in dfs.where(F.col("term").isin(*vocabulary)).collect()}, templates, threshold)  # a row for each term of the templates
    salt = F.pmod(F.xxhash64("__p"), F.lit(SALTS))
    cut = F.when(w.held(F.col("t")), F.struct(F.md5(F.col("t").cast("binary")).alias("key"), "t"))  # texts are looked through once; only those with an anchor are kept
    rows = rows.select(*kept, "__p", F.regexp_replace("__p", "/?[^/]*$", "").alias("__d"), salt.alias("__s"), cut.alias("x"))
    rows = settle(rows.select(*kept, "__p", "__d", "__s", F.col("x.key").alias("key"), F.col("x.t").alias("t")))
    found = settle(scores(rows.where("key is not null").select("key", "t").dropDuplicates(["key"]), n, dfs, w))
    rows = rows.drop("t")
    with_key = rows.where("key is not null").join(found, "key", "left")
    head, whole = (F.coalesce(F.col(c)["score"] >= threshold, F.lit(False)) for c in ("head", "whole"))
    named = F.coalesce(F.col("__p").rlike(FILE_NAME), F.lit(False))
    cols = [*kept, "__p", "__d", "__s"]
    with_key = with_key.select(*cols, F.when(whole, F.col("whole")).when(head, F.col("head")).alias("__own"), (whole | (head & named)).alias("__file"))
    rows = with_key.unionByName(rows.where("key is null").select(*cols, F.lit(None).cast(with_key.schema["__own"].dataType).alias("__own"), F.lit(False).alias("__file")))
    files = settle(with_key.where("__file and __d is not null").groupBy(F.col("__d").alias("a")).agg(F.max("__own").alias("lic")))
    parts = F.split("__d", "/")
    bare = rows.where("__d is not null and __own is null").select("__d").distinct()
    up = bare.select("__d", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("depth", "a"))
    up = up.withColumn("s", F.pmod(F.xxhash64("__d"), F.lit(SALTS)))  # the root is an ancestor of all
    files = files.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = up.join(files, ["a", "s"]).groupBy(F.col("__d").alias("d")).agg(F.max_by(F.struct("a", "lic"), "depth").alias("got"))
    near = near.select("d", "got", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))  # files of one directory are dealt to so many tasks
    met = rows.join(near, (rows["__d"] == near["d"]) & (rows["__s"] == near["s"]) & rows["__own"].isNull(), "left")
    lic = F.coalesce("__own", F.col("got.lic"))
    how = F.when(F.col("__own").isNotNull(), F.when(F.col("__file"), "file").otherwise("header")).when(F.col("got").isNotNull(), "inherited").otherwise("none")
    out = met.select(*kept, F.col("__p").alias("path"), F.get(names, F.abs(lic["order"])).alias("license"), lic["score"].alias("score"), how.alias("how"), F.when(F.col("__own").isNull(), F.col("got.a")).alias("from_dir"))
    return out.toDF(*kept_names(keep or [], OWN), *OWN)


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The registered query in DuckDB's SQL: documents at source/lang/doc_id, whose names are never a licence file's."""
    quoted = lambda s: s.replace("'", "''")
    values = ", ".join(f"({k}, '{n}', '{quoted(t)}')" for k, (n, t) in enumerate(templates))
    terms = lambda c: f"regexp_extract_all(lower({c}), '{TERM}')"
    return f"""
with t as (select * from (values {values}) as v(k, name, text)),
tf as (select k, term, count(*) as n from (select k, unnest({terms("text")}) as term from t) group by 1, 2),
docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '_') as a, coalesce(source, '_') || '/' || coalesce(lang, '_') as dir, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(cast(doc_id as varchar), '_') as path from documents),
n as (select count(*) as n from docs),
idf as (select term, ln((1 + (select n from n)) / (1.0 + df)) + 1 as w from (select term, count(*) as df from (select unnest(list_distinct({terms("text")})) as term from docs) group by 1)),
tv as (select k, term, tf.n * w as x, sqrt(sum((tf.n * w) * (tf.n * w)) over (partition by k)) as norm from tf join (select term, coalesce(w, ln(1.0 + (select n from n)) + 1) as w from (select distinct term from tf) left join idf using (term)) using (term)),
units as (select rid, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'))) as u, false as whole from docs union all select rid, text, true from docs),
few as (select row_number() over () as uid, rid, whole, {terms("u")} as words from units),
held as (select * from few where list_has_any(words, (select list(distinct term) from tf))),
uf as (select uid, term, count(*) as n from (select uid, unnest(words) as term from held) group by 1, 2),
uv as (select uid, term, uf.n * w as x from uf join idf using (term)),
un as (select uid, sqrt(sum(x * x)) as norm from uv group by 1),
sc as (select uid, k, round(sum(uv.x * tv.x / tv.norm) / any_value(un.norm), 6) as score from uv join tv using (term) join un using (uid) group by 1, 2),
best as (select rid, whole, max(score) as score, max_by(k, (score, -k)) as k from sc join held using (uid) group by 1, 2 having max(score) >= {threshold}),
own as (select rid, coalesce(max(case when whole then score end), max(case when not whole then score end)) as score, coalesce(max(case when whole then k end), max(case when not whole then k end)) as k, bool_or(whole) as file from best group by 1),
files as (select dir, max_by(k, (score, -k)) as k, max(score) as score from own join docs using (rid) where file group by 1),
near as (select d.dir, max_by(f.dir, length(f.dir)) as from_dir, max_by(f.k, length(f.dir)) as k, max_by(f.score, length(f.dir)) as score from (select distinct dir, a from docs) d join files f on f.dir in (d.dir, d.a, '') group by 1)
select doc_id, path, t.name as license, coalesce(own.score, near.score) as score, case when own.file then 'file' when own.rid is not null then 'header' when near.k is not null then 'inherited' else 'none' end as how, case when own.rid is null then from_dir end as from_dir
from docs left join own using (rid) left join near using (dir) left join t on t.k = coalesce(own.k, near.k)"""
