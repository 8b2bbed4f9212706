"""Further registered queries: writes folded as tables, classifications, validation and whole recalls, with their DuckDB forms."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae import validate
from tesserae.constants import ACRONYM_STOPWORDS, INTENT_WEIGHTS, MAX_CONTENT, NEGATION_PHRASES, TECH_DICTIONARY, TRAVERSAL
from tesserae.functions import diff, entities, gates, scoring, text
from tesserae.functions import similarity as S
from tesserae.operators import edges as E
from tesserae.operators import graph, overlap, retrieval
from tesserae.streaming import ingest

from . import views as V
from .catalog import _PAIRS, _RRF, _pairs, query, r6
from .session import read, settle

quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# Text and sets

@query(f"with d as (select doc_id as id, {V.tok_sql('text || chr(32) || lang || chr(32) || source')} as t from documents) select id, md5(array_to_string(list_sort(t), ' ')) as md5 from d")
def search_tokens(spark, sf):
    """Sorted tokens of content, tags (the language) and entities (the source)."""
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5(F.array_join(text.search_tokens(F.col("text"), F.array("lang"), F.array("source")), " ").cast("binary")).alias("md5"))


_TURNS = f"""k as (select conv_id, turn, text as new, lag(text) over (partition by conv_id order by turn) as old from conversations),
p as (select *, {V.tok_sql('new')} as nt, {V.tok_sql('old')} as ot, array_to_string(list_sort(list_filter(regexp_extract_all(lower(new), '\\p{{L}}+'), lambda w: w in ('not', 'no', 'never'))), ',') as nm, array_to_string(list_sort(list_filter(regexp_extract_all(lower(old), '\\p{{L}}+'), lambda w: w in ('not', 'no', 'never'))), ',') as om from k where old is not null),
s as (select *, len(list_intersect(nt, ot)) as shared from p)"""


@query(f"""with {_TURNS} select conv_id, turn, round(case when len(nt) > 0 and len(ot) > 0 then shared / least(len(nt), len(ot)) else 0 end, 6) as symmetric, round(case when len(nt) > 0 and len(ot) > 0 then shared / greatest(len(nt), len(ot)) else 0 end, 6) as overlap, nm as marks,
(len(nt) = len(ot) and shared = len(nt)) as equal, (len(nt) > 0 and len(nt) = len(ot) and shared = len(nt) and length(new) <= length(old) * 1.25 and nm = om) as safe from s""")
def turn_overlaps(spark, sf):
    """Each turn against the one before it: overlaps, negation marks, equal sets and safe duplicates."""
    k = read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("new"), F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("old")).where("old is not null")
    k = k.withColumns({"nt": text.tokenize(F.col("new")), "ot": text.tokenize(F.col("old"))})
    new, old, nt, ot = (F.col(c) for c in ("new", "old", "nt", "ot"))
    return k.select("conv_id", "turn", r6(S.symmetric(nt, ot)).alias("symmetric"), r6(S.causal_overlap(nt, ot)).alias("overlap"), text.negation_marks(new).alias("marks"), S.sets_equal(nt, ot).alias("equal"), diff.safe_duplicate(new, old, nt, ot).alias("safe"))


@query(f"""with {V.V}, {V.D}, p as (select a.id, a.content as new, b.content as old, a.tokens as nt, b.tokens as ot, {V.COS.format(a='x.x', b='y.x')} as cosine from d a join d b on b.id = a.id + 1 join v x on x.id = a.id join v y on y.id = case when a.id % 3 = 0 then a.id else b.id end),
s as (select *, case when len(nt) > 0 and len(ot) > 0 then len(list_intersect(nt, ot)) / len(list_distinct(list_concat(nt, ot))) else 0 end as token from p),
c as (select *, case when cosine >= 0.85 and cosine > token then cosine else token end as sim from s)
select id, round(sim, 6) as similarity, case when sim < 0.5 then 'ADD' when sim >= 0.7 and ({" or ".join(f"contains(lower(new), {quoted([p])}) or contains(lower(old), {quoted([p])})" for p in NEGATION_PHRASES)}) then 'CONFLICT' when (token > 0.9 or sim > 0.9) and length(new) <= length(old) + length(old) // 4 then 'DUPLICATE' else 'UPDATE' end as suggestion from c""")
def combined_pairs(spark, sf):
    """Neighbouring documents by tokens and vectors; every third stands against its own vector, so that the cosine decides."""
    d, v = V.documents(spark, sf).select("id", "content", "tokens"), V.vectors(spark, sf)
    p = d.alias("a").join(d.alias("b"), F.expr("b.id = a.id + 1")).select(F.col("a.id").alias("id"), F.col("a.content").alias("new"), F.col("b.content").alias("old"), F.col("a.tokens").alias("new_tokens"), F.col("b.tokens").alias("old_tokens"))
    p = p.join(v.withColumnRenamed("embedding", "x"), "id").withColumn("other", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 1))
    p = p.join(v.select(F.col("id").alias("other"), F.col("embedding").alias("y")), "other").withColumn("cosine", S.cosine(F.col("x"), F.col("y")))
    return diff.classify_pairs(p).select("id", r6("similarity").alias("similarity"), "suggestion")


@query(f"""with {_PAIRS}, j2 as (select query_id, id, case id % 5 when 0 then 'duplicate' when 1 then 'refines' when 2 then 'contradicts' when 3 then 'unrelated' end as relation from s)
select s.query_id, s.id, case relation when 'duplicate' then 'DUPLICATE' when 'refines' then 'UPDATE' when 'contradicts' then 'CONFLICT' when 'unrelated' then 'ADD' else suggestion end as suggestion from s join j2 using (query_id, id)""")
def judged_pairs(spark, sf):
    """Suggestions of jaccard_pairs overruled by a judge's relations; a pair it leaves out keeps the rules' answer."""
    pairs = _pairs(spark, sf).withColumnsRenamed({"query_id": "new_id", "id": "old_id"})
    names = F.array(*map(F.lit, ("duplicate", "refines", "contradicts", "unrelated")))
    relations = pairs.where(F.col("old_id") % 5 < 4).select("new_id", "old_id", F.get(names, (F.col("old_id") % 5).cast("int")).alias("relation"))
    return diff.judged(pairs, relations).select(F.col("new_id").alias("query_id"), F.col("old_id").alias("id"), "suggestion")


# Entities

_WORDCHAR = "A-Za-z0-9_"
_EXTRACT = f"""t as (select doc_id, text, regexp_replace(text, '([\\s"''(),.])', '\\1\\1', 'g') as wide from documents),
paths as (select doc_id, text, list_filter(regexp_extract_all(regexp_replace(text, '([\\s"''(),])', '\\1\\1', 'g'), '(?:^|[\\s"''(])([.A-Za-z0-9_/-]+\\.[A-Za-z0-9_]{{1,10}})(?:[\\s"''),.]|$)', 1), lambda p: regexp_matches(p, '[A-Za-z]') and len(list_filter(string_split(p, '.'), lambda x: length(x) > 1)) > 0) as p from t),
raw as (select doc_id, list_concat(list_filter(list_concat(list_concat(list_concat(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1), regexp_extract_all(text, '\\b([A-Z]{{2,6}})\\b', 1)), list_concat(p, regexp_extract_all(text, '(https?://[^\\s"''<>)]+)', 1))), regexp_extract_all(text, '@([a-zA-Z_][A-Za-z0-9_]+)', 1)), lambda x: not list_contains([{quoted(ACRONYM_STOPWORDS)}], x)),
list_filter(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: list_contains([{quoted(TECH_DICTIONARY)}], x))) as es from paths),
each as (select doc_id, unnest(es) as entity, generate_subscripts(es, 1) as i from raw),
firsts as (select doc_id, entity, min(i) as i from each group by 1, 2),
placed as (select doc_id, entity, row_number() over (partition by doc_id order by i) - 1 as place from firsts)"""


@query(f"with {_EXTRACT} select doc_id, place::integer as place, entity from placed where place < 50")
def entity_extract(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.posexplode(entities.extract(F.col("text"))).alias("place", "entity"))


@query(f"""with {_EXTRACT}, m as (select doc_id, source as entity, -1 as place from documents union all select doc_id, 'SQL', -2 from documents union all select doc_id, entity, place from placed),
f as (select doc_id, entity, min(place) as place from m group by 1, 2) select doc_id, entity, (row_number() over (partition by doc_id order by place) - 1)::integer as place from f qualify row_number() over (partition by doc_id order by place) <= 50""")
def entity_merge(spark, sf):
    """Provided entities first, then those of the text, each once, 50 at most."""
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(entities.merge(F.array(F.lit("SQL"), "source"), entities.extract(F.col("text"), None))).alias("place", "entity"))


# Writes as tables

@query("""with o as (select o_custkey as s, o_orderkey % 50 as t, o_orderkey as seq, o_totalprice as w, o_orderkey % 3 <> 0 as derived, o_orderkey % 4 = 0 as new from orders where o_custkey in (select c_custkey from customer where c_acctbal >= 0) and o_orderkey % 50 in (select c_custkey from customer where c_acctbal >= 0)),
b as (select * from o where new qualify row_number() over (partition by s, t order by seq desc) = 1), a as (select * from o where not new qualify row_number() over (partition by s, t order by seq desc) = 1),
u as (select *, 0 as b from a union all select *, 1 from b)
select s as source_id, t as target_id, round(max_by(w, (case when not derived then 2 else 0 end) + b), 6) as weight, bool_and(derived) as derived from u where s <> t group by 1, 2""")
def edge_upsert_active(spark, sf):
    """Upsert of edges between active rows (customers not in debt): those with another end, and self links, fall out."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 50).alias("target_id"), F.lit("causal").alias("edge_type"), F.col("o_totalprice").alias("weight"), (F.col("o_orderkey") % 3 != 0).alias("derived"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 4 == 0).alias("new"))
    active = read(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    old = o.where("not new").drop("new").withColumn("r", F.row_number().over(W.partitionBy("source_id", "target_id").orderBy(F.desc("seq")))).where("r = 1").drop("r")
    return E.merge_edges(old, o.where("new").drop("new"), active).select("source_id", "target_id", r6("weight").alias("weight"), "derived")


@query(f"""with {V.E} select namespace as id, count(*) as access_count, max(created_at) as last_accessed_at, greatest(max(created_at), timestamp '2024-01-20 00:00:00') as updated_at from e where source = 'view' or source = 'click' group by 1""")
def access_fold(spark, sf):
    """Accesses (views and clicks) folded into counts and times; updated_at never goes back."""
    e = V.events(spark, sf).where("source in ('view', 'click')")
    out = e.groupBy(F.col("namespace").alias("id")).agg(F.count("*").alias("access_count"), F.max("created_at").alias("last_accessed_at"))
    return out.withColumn("updated_at", F.greatest("last_accessed_at", F.lit("2024-01-20 00:00:00").cast("timestamp")))


@query(f"with {V.E}, dead as (select id from e where created_at < timestamp '2024-01-10' qualify row_number() over (partition by source order by created_at, id) <= 50) select source as operation, count(*) as kept, min(id) as first_id from e where id not in (select id from dead) group by 1")
def prune_bounded(spark, sf):
    """What is left of the log if at most 50 rows of each kind, the oldest first, go that are older than a date."""
    e = V.events(spark, sf)
    dead = retrieval.ranked(e.where("created_at < timestamp '2024-01-10'"), ["created_at", "id"], 50, by=("source",))
    return e.join(dead.select("id"), "id", "left_anti").groupBy(F.col("source").alias("operation")).agg(F.count("*").alias("kept"), F.min("id").alias("first_id"))


@query(f"with {V.D0}, b as (select d.id, created_at, count(*) over () as total from d left join embeddings e on e.vec_id = d.id where e.vec_id is null) select id, total from b order by created_at, id limit 25")
def unembedded(spark, sf):
    """The oldest rows without a vector, with how many there are."""
    bare = V.documents(spark, sf, False).select("id", "created_at").join(V.vectors(spark, sf).select("id"), "id", "left_anti")
    total = bare.agg(F.count("*").alias("total"))
    return bare.orderBy("created_at", "id").limit(25).crossJoin(total).select("id", "total")  # 25 rows and one row


@query(f"with {_RRF}, hits as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from anchors) select query_id, rank, id, d.source, d.importance, d.created_at from hits join d using (id) where rank <= 10")
def hit_rows(spark, sf):
    """Hits with the public columns of their rows, in the order of the hits."""
    d = V.documents(spark, sf)
    hits = retrieval.anchors(d, V.queries(spark)).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).where("rank <= 10")
    return hits.select("query_id", "id", F.col("rank").cast("bigint").alias("rank")).join(d.select("id", "source", "importance", "created_at"), "id").select("query_id", "rank", "id", "source", "importance", "created_at")


@query("""with e as (select event_id, event_type, json_extract_string(props, '$.k') as k from events) select event_id, event_type as sub_type, coalesce(k, '') as k, (2 + case when k is null then 0 else 1 end)::integer as entries from e""")
def edge_metadata(spark, sf):
    """Metadata maps of strings from JSON: the event's own entries with its type and a fixed one."""
    e = read(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("m"))
    full = e.withColumn("m", F.map_concat(F.coalesce("m", F.create_map().cast("map<string,string>")), F.create_map(F.lit("sub_type"), F.col("event_type"), F.lit("created_by"), F.lit("import"))))
    return full.select("event_id", F.col("m")["sub_type"].alias("sub_type"), F.coalesce(F.col("m")["k"], F.lit("")).alias("k"), F.size("m").alias("entries"))


@query(f"""with {V.D0}, {V.G}, n as (select id, count(*) as n from (select source_id as id from g union all select target_id from g) group by 1),
t as (select d.id, importance, (d.id % 4) as access, coalesce(n, 0) as edges, greatest(0, (epoch_us(timestamp '2024-06-01') - epoch_us(created_at)) / 86400000000.0) as days from d left join n using (id)),
s as (select *, least(1.0, (case when importance >= 5 then 1.0 when importance = 4 then 0.8 when importance = 3 then 0.5 when importance = 2 then 0.3 else 0.15 end) * greatest(1.0, ln(1 + access)) * power(0.5, days / 30.0) * (1 + 0.1 * least(edges, 5))) as ei from t)
select id, round(ei, 6) as effective, edges, count(*) over () as total from s where ei < 0.25 and not (importance >= 4 or access >= 3) order by round(ei, 9), id limit 20""")
def retention_candidates(spark, sf):
    """Rows that may go: scored with their edges, not immune, the least first, and how many there are before the limit."""
    d = V.documents(spark, sf, False).withColumn("access", F.col("id") % 4)
    rows = d.join(E.degrees(V.edges(spark, sf)), "id", "left").withColumn("edges", F.coalesce("n", F.lit(0)).cast("bigint"))
    days = scoring.days_since(F.lit("2024-06-01 00:00:00").cast("timestamp"), F.lit(None).cast("timestamp"), F.col("created_at"))
    low = rows.withColumn("ei", scoring.effective_importance(F.col("importance"), F.col("access"), days, F.col("edges"))).where((F.col("ei") < 0.25) & ~scoring.immune(F.col("importance"), F.col("access")))
    total = low.agg(F.count("*").alias("total"))
    return low.orderBy(F.round("ei", 9), "id").limit(20).crossJoin(total).select("id", r6("ei").alias("effective"), "edges", "total")  # 20 rows and one row


@query(f"""with f as (select doc_id, 'content' as field, 'blank' as code from documents where trim(text) = '' union all select doc_id, 'content', 'too_long' from documents where length(text) > {MAX_CONTENT}
union all select doc_id, 'importance', 'out_of_range' from documents where doc_id % 7 not between 1 and 5 union all select doc_id, 'category', 'not_allowed' from documents where lang not in ('en', 'de') union all select doc_id, 'tags', 'too_many' from documents where n_chars % 30 > 20) select * from f""")
def load_faults(spark, sf):
    """(field, code) of each fault of rows to be loaded, column by column."""
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), (F.col("doc_id") % 7).cast("int").alias("importance"), F.when(F.col("lang").isin("en", "de"), "fact").otherwise(F.col("lang")).alias("category"),
                                            F.transform(F.filter(F.sequence(F.lit(0), (F.col("n_chars") % 30).cast("int")), lambda i: i > 0), lambda i: i.cast("string")).alias("tags"), F.array().cast("array<string>").alias("entities"), "source")
    return d.select("doc_id", F.explode(validate.faults(d)).alias("f")).select("doc_id", "f.field", "f.code")


@query(f"with {V.E} select date_trunc('hour', created_at) as start, source as operation, count(*) as n from e group by 1, 2")
def operations_hourly(spark, sf):
    return ingest.operations_per_window(V.events(spark, sf).withColumnRenamed("source", "operation")).select("start", "operation", "n")


@query(f"""with {V.E}, s as (select *, case when created_at < lag(created_at) over (partition by namespace order by created_at, id) + interval 30 minute then 0 else 1 end as opens from e),
g as (select *, sum(opens) over (partition by namespace order by created_at, id) as nth from s) select namespace as user_id, min(created_at) as start, max(created_at) + interval 30 minute as "end", count(*) as n from g group by namespace, nth""")
def user_sessions(spark, sf):
    return ingest.sessions(V.events(spark, sf).withColumnRenamed("namespace", "user_id"))


# Neighbours

_NEAREST = f"{V.V}, n as (select q.id as query_id, v.id, {V.COS.format(a='q.x', b='v.x')} as cosine from v, (select * from v where id % 100 = 0) q where v.id <> q.id)"


@query(f"with {_NEAREST} select query_id, id, round(cosine, 6) as cosine from n where cosine >= 0.4 qualify row_number() over (partition by query_id order by cosine desc, id) <= 5")
def semantic_candidates(spark, sf):
    """The 5 nearest of each row asked for, if their cosine is at least 0.4."""
    near = retrieval.knn(V.vectors(spark, sf), V.vector_queries(spark, sf), 5, exclude_self=True)
    return near.where("cosine >= 0.4").select("query_id", "id", r6("cosine").alias("cosine"))


@query(f"""with {_NEAREST}, {V.D}, k as (select q.id as query_id, d.id, len(list_intersect(d.tokens, q.tokens)) as c, d.importance, d.created_at from d join (select d.id, d.tokens from d join embeddings e on e.vec_id = d.id where d.id % 100 = 0) q on d.id <> q.id and list_has_any(d.tokens, q.tokens)),
u as (select query_id, id from k qualify row_number() over (partition by query_id order by c desc, importance desc, created_at desc, id) <= 5 union select query_id, id from n where query_id in (select id from d) qualify row_number() over (partition by query_id order by cosine desc, id) <= 5)
select query_id, id from u where id % 10 <> 0""")
def duplicate_candidates(spark, sf):
    """The 5 nearest by tokens and the 5 nearest by vector; managed rows (every tenth) fall out after the cut."""
    d, v = V.documents(spark, sf), V.vectors(spark, sf)
    d = settle(d.select("id", "importance", "created_at", overlap.prints(F.col("tokens")).alias("own")))
    q = d.where("id % 100 = 0").join(v, "id").select(F.col("id").alias("query_id"), "own", F.col("embedding").alias("vector"))
    one = overlap.most_shared(d, q.select("query_id", "own"), 5).select("query_id", "id")
    two = retrieval.knn(v, q.select("query_id", "vector"), 5, exclude_self=True).select("query_id", "id")
    return one.union(two).distinct().where("id % 10 <> 0")


# Gates

_low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_rx = lambda p: p.replace("'", "''").replace("\\z", "$")
_any = lambda ps: "(" + " or ".join(f"regexp_matches(f, '{_rx(p)}')" for p in ps) + ")"
_PAIR = r"\b(?i:password|passwd|api[_-]?key|secret|token)\s*[:=]\s*(\S{6,})"
_SECRET = f"({_any(gates.SECRETS[:6])} or len(list_filter(regexp_extract_all(f, '{_PAIR}', 1), lambda x: regexp_matches(x, '[\\d_]') or regexp_matches(x, '[^\\s\\w]') or regexp_matches(x, '^\\S+[A-Z]'))) > 0)"
_VALUE = r"(regexp_matches(f, '\d(?:[\s-]?\d){3,}') or len(list_filter(regexp_extract_all(f, '\b[A-Za-z0-9]{12,}\b'), lambda x: regexp_matches(x, '\d') and regexp_matches(x, '[A-Za-z]'))) > 0)"
_WORDS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda x: not list_contains([{quoted(gates.WORDS_OUT)}], x)))"


@query(f"""with m as (select conv_id, max_by(text, turn) as f, max(turn) as last from conversations where role = 'user' group by 1),
r as (select m.conv_id, f, coalesce(list(c.text) filter (c.text is not null), []) as related from m left join conversations c on c.conv_id = m.conv_id and c.turn <> m.last group by 1, 2),
k as (select *, unnest(['personal', 'organization']) as audience from r),
w as (select *, {_WORDS('f')} as a from k),
g as (select *, {_any(gates.TRANSIENT)} as transient, {_any(gates.PERSONAL)} as mine, {_any(gates.ORGANIZATION)} as ours,
({_SECRET} or {_any([gates.CARD_NUMBER])} or {_any([gates.SECRET_STATEMENT])} or ({_any([gates.SECRET_WORD])} and {_VALUE})) as sensitive,
len(a) > 0 and len(list_filter(related, lambda t: len(list_intersect(a, {_WORDS('t')})) = len(a) or len(list_intersect(a, {_WORDS('t')})) / greatest(1, len(a) + len({_WORDS('t')}) - len(list_intersect(a, {_WORDS('t')}))) >= 0.9)) > 0 as duplicate from w),
x as (select *, not transient and not regexp_matches(f, '\\?\\s*$') and not {_any([gates.SMALL_TALK])} and len(a) >= 3 as durable, case when audience = 'organization' then not mine or ours else mine or not ours end as fits from g),
y as (select *, list_filter([case when not durable then 'durable' end, case when transient then 'transient' end, case when duplicate then 'duplicate' end, case when not fits then 'appropriateAudience' end, case when sensitive then 'sensitive' end], lambda z: z is not null) as reasons from x)
select conv_id, audience, len(reasons) = 0 as accept, array_to_string(reasons, ',') as reasons, case when len(reasons) = 0 then case {" ".join(f"when regexp_matches(f, '{_rx(p)}') then '{c}'" for p, c in gates.CATEGORY_RULES)} else 'fact' end end as category,
case when len(reasons) = 0 then case when {_any([gates.IMPORTANCE_5])} then 5 when {_any([gates.IMPORTANCE_4])} then 4 else 3 end end as importance from y""")
def gate_decide(spark, sf):
    """The whole gate over the last user message of each conversation, for both audiences, with the other turns as what is known."""
    c = read(spark, sf, "conversations")
    k = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("f"), F.max("turn").alias("last"))
    others = k.join(c.select("conv_id", "turn", "text"), "conv_id", "left").groupBy("conv_id", "f").agg(F.collect_list(F.when(F.col("turn") != F.col("last"), F.col("text"))).alias("related"))
    rows = others.withColumn("audience", F.explode(F.array(F.lit("personal"), F.lit("organization"))))
    got = rows.select("conv_id", "audience", gates.heuristic_gate(F.col("f"), F.col("audience"), F.col("related")).alias("g"))
    return got.select("conv_id", "audience", "g.accept", F.array_join("g.reasons", ",").alias("reasons"), "g.category", "g.importance")


_PROBS = {"durable": "(doc_id * 7 % 100) / 100.0", "transient": "(doc_id * 11 % 70) / 100.0", "duplicate": "(doc_id * 13 % 60) / 100.0", "appropriateAudience": "(doc_id * 17 % 200) / 100.0", "sensitive": "(doc_id * 19 % 55) / 100.0"}


@query(f"""with p as (select doc_id, {", ".join(f"{v}::double as {k}" for k, v in _PROBS.items())}, (doc_id * 23 % 100 / 100.0)::double as s from documents),
r as (select *, list_filter([case when not durable >= 0.5 then 'durable' end, case when transient >= 0.5 then 'transient' end, case when duplicate >= 0.5 then 'duplicate' end, case when not appropriateAudience >= 0.5 then 'appropriateAudience' end, case when sensitive >= 0.5 then 'sensitive' end], lambda z: z is not null) as reasons from p)
select doc_id, len(reasons) = 0 and doc_id % 10 <> 0 as accept, case when doc_id % 10 = 0 then 'invalid-evaluation' else array_to_string(reasons, ',') end as reasons, len(reasons) = 0 and doc_id % 10 <> 0 and s >= 0.8 as supersedes from r""")
def gate_judged(spark, sf):
    """A judge's probabilities against the thresholds; an answer with a value missing (every tenth) rejects."""
    d = read(spark, sf, "documents")
    probs = F.map_from_arrays(F.array(*map(F.lit, _PROBS)), F.array(*(F.when((F.col("doc_id") % 10 != 0) | (F.lit(k) != "sensitive"), F.expr(v).cast("double")) for k, v in _PROBS.items())))
    g = d.select("doc_id", gates.judged_gate(probs, supersede=(F.col("doc_id") * 23 % 100 / 100.0)).alias("g"))
    return g.select("doc_id", "g.accept", F.array_join("g.reasons", ",").alias("reasons"), "g.supersedes")


@query("""select doc_id, case when lang in ('en', 'de') then case when lang = 'en' then 'fact' else 'decision' end end as category, case when n_chars % 9 = 0 then null else greatest(1, least(5, floor(n_chars % 1000 / 100.0 - 1 + 0.5)::integer)) end as importance from documents""")
def gate_sanitize(spark, sf):
    """A judge's categories and importances, what is unknown or no number dropped, the others bounded."""
    d = read(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "fact").when(F.col("lang") == "de", "decision").otherwise(F.col("lang"))
    weight = F.when(F.col("n_chars") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") % 1000 / 100.0 - 1)
    return d.select("doc_id", gates.sanitize(kind, weight, ("fact", "decision")).alias("s")).select("doc_id", "s.category", "s.importance")


@query("""select conv_id, turn, case when length(text) > 60 then substr(text, 1, 59) || '…' else text end as excerpt, replace(replace(rtrim(to_base64(unhex(sha256(cast(conv_id as varchar) || chr(0) || cast(turn as varchar) || chr(0) || role))), '='), '+', '-'), '/', '_') as key from conversations""")
def excerpt_keys(spark, sf):
    """Clipped texts and the digests that name a turn."""
    from tesserae.adapters import digest_column

    return read(spark, sf, "conversations").select("conv_id", "turn", text.clip(F.col("text"), 60).alias("excerpt"), digest_column(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")).alias("key"))


# Whole recall

#: query_id, query, intent, entities, the vector's id and the category asked for.
_ASKED = ((1, "thly ering thatnd", "GENERAL", ("src1", "Src2"), 3, None), (2, "idiot and the clown", "WHY", ("src0",), 5, None), (3, "de la que por el", "ENTITY", (), 8, "fact"), (4, "einung und mit der", "WHEN", ("src3", "src4", "none"), None, "note"))


def _asked_sql() -> str:
    rows = ", ".join(f"({i}, '{q}', '{n}', [{quoted(e)}]::varchar[], {v if v is not None else 'null'}, {quoted([c]) if c else 'null'})" for i, q, n, e, v, c in _ASKED)
    return f"q as (select t.query_id, query, intent, es, cat, {V.tok_sql('query')} as tokens, v.x as qv from (values {rows}) as t(query_id, query, intent, es, vid, cat) left join v on v.id = t.vid)"


def _walk_sql() -> str:
    """The walk of all intents at once: beam, depth and weights by the query's intent."""
    pick = lambda f: "case q.intent " + " ".join(f"when '{n}' then {f(n)}" for n in TRAVERSAL) + " end"
    weigh = pick(lambda n: "(case u.edge_type " + " ".join(f"when '{k}' then {v}" for k, v in INTENT_WEIGHTS[n].items()) + " end)")
    beam, depth, visited = (pick(lambda n, i=i: TRAVERSAL[n][i]) for i in range(3))
    near = "0.4 * greatest(0, coalesce((select " + V.COS.format(a="v.x", b="q.qv") + " from v where v.id = u.b), 0))"
    parts = ["b0 as (select query_id, id, score, via from anchors)", "f0 as (select query_id, id as anchor, id, score from b0)", "s0 as (select query_id, anchor, id from f0)"]
    last = max(t[1] for t in TRAVERSAL.values())
    for h in range(1, last + 1):
        p = h - 1
        parts += [f"r{h} as materialized (select f.query_id, f.anchor, u.b as id, u.edge_type, f.score + {weigh} * u.weight + {near} as score from f{p} f join q using (query_id) join u on u.a = f.id where {depth} >= {h})",
                  f"t{h} as (select query_id, id, max(score) as score, min_by(edge_type, (-score, anchor, edge_type)) as via from r{h} group by 1, 2)",
                  f"b{h} as (select coalesce(b.query_id, t.query_id) as query_id, coalesce(b.id, t.id) as id, case when t.score > coalesce(b.score, -1e300) then t.score else b.score end as score, case when t.score > coalesce(b.score, -1e300) then t.via else b.via end as via from b{p} b full join t{h} t on b.query_id = t.query_id and b.id = t.id)",
                  f"n{h} as (select query_id, anchor, id, score, row_number() over (partition by query_id, anchor order by score desc, id) as k from (select query_id, anchor, id, max(score) as score from r{h} r where not exists (select 1 from s{p} s where s.query_id = r.query_id and s.anchor = r.anchor and s.id = r.id) group by 1, 2, 3))",
                  f"k{h} as (select n.* from n{h} n join q using (query_id) join (select query_id, anchor, count(*) as c from s{p} group by 1, 2) c using (query_id, anchor) where n.k <= {visited} - c.c)",
                  f"s{h} as (select query_id, anchor, id from s{p} union all select query_id, anchor, id from k{h})",
                  f"f{h} as (select k.query_id, k.anchor, k.id, k.score from k{h} k join q using (query_id) join (select query_id, anchor, count(*) as m from s{h} group by 1, 2) c using (query_id, anchor) where k.k <= {beam} and m < {visited})"]
    parts.append(f"walked as (select * from b{last} qualify row_number() over (partition by query_id order by score desc, id) <= 500)")
    return ",\n".join(parts)


_CAT = "case when d.id % 3 = 0 then 'fact' else 'note' end"
_WHOLE = f"""with {V.D}, {V.V}, {_asked_sql()}, {V.KW}, lists as (
select query_id, id, 'keyword' as signal, row_number() over (partition by query_id order by keyword desc, id) as rank from kw qualify rank <= 20
union all select query_id, r.id, 'recency', r.rank from q, (select id, row_number() over (order by created_at desc, id) as rank from d qualify rank <= 20) r
union all select query_id, id, 'vector', row_number() over (partition by query_id order by cosine desc, id) as rank from (select query_id, v.id, {V.COS.format(a='q.qv', b='v.x')} as cosine from q, v join d on d.id = v.id where q.qv is not null) where cosine > 0.1 qualify rank <= 20),
raw as (select query_id, id, sum(1.0::double / (60 + rank)) as raw, list_sort(list(distinct signal)) as signals from lists group by 1, 2),
anchors as (select query_id, id, raw / max(raw) over (partition by query_id) as score, case when len(signals) > 1 then 'hybrid' else signals[1] end as via from raw),
{V.G}, {_walk_sql()},
c as (select w.query_id, w.id, w.score as graph_raw, w.via, q.cat, coalesce(kw.keyword, 0) as keyword, d.importance, {_CAT} as category, (case when list_contains(list_transform(q.es, lambda e: lower(e)), lower(d.source)) then 1 else 0 end) / greatest(1, len(q.es)) as entity, greatest(0, coalesce({V.COS.format(a='v.x', b='q.qv')}, 0)) as similarity
from walked w join q using (query_id) join d using (id) left join v on v.id = d.id left join kw on kw.query_id = w.query_id and kw.id = w.id),
m as (select *, min(case when keyword > 0 or similarity >= 0.85 then graph_raw end) over (partition by query_id) as lo, max(case when keyword > 0 or similarity >= 0.85 then graph_raw end) over (partition by query_id) as hi from c),
n as (select *, case when (keyword > 0 or similarity >= 0.85) and hi > lo then (graph_raw - lo) / (hi - lo) else 0 end as graph from m),
s as (select *, 0.30 * keyword + 0.15 * entity + 0.35 * similarity + 0.20 * graph as score from n where cat is null or category = cat)
select query_id, id, round(score, 6) as score, via, round(keyword, 6) as keyword, round(entity, 6) as entity, round(similarity, 6) as similarity, round(graph, 6) as graph from s qualify row_number() over (partition by query_id order by score desc, importance desc, graph_raw desc, id) <= 10"""


@query(_WHOLE)
def recall_signals(spark, sf):
    """Whole recall of queries of all intents with vectors, entities and categories: the hits with all their signals."""
    from .recall import recall

    d = V.documents(spark, sf).withColumns({"entities": F.array("source"), "category": F.when(F.col("id") % 3 == 0, "fact").otherwise("note")})
    rows = ", ".join(f"({i}, '{q}', '{n}', array({quoted(e)}), {v if v is not None else 'cast(null as bigint)'}, {quoted([c]) if c else 'cast(null as string)'})" for i, q, n, e, v, c in _ASKED)
    q = spark.sql(f"select query_id, query, intent, cast(es as array<string>) as entities, cast(vid as bigint) as vid, category from values {rows} as t(query_id, query, intent, es, vid, category)")
    v = V.vectors(spark, sf)
    q = q.withColumn("tokens", text.tokenize(F.col("query"))).join(v.select(F.col("id").alias("vid"), F.col("embedding").alias("vector")), "vid", "left").drop("vid")
    got = recall(d, V.edges(spark, sf), q, v.join(d.select("id"), "id", "left_semi"), limit=10)
    return got.select("query_id", "id", r6("score").alias("score"), "via", *(r6(c).alias(c) for c in ("keyword", "entity", "similarity", "graph")))


@query(f"""with recursive {_RRF}, {V.G}, h as (select query_id, id, round(score, 9) as score from anchors), e as (select distinct a.query_id, g.source_id as s, g.target_id as t from g join h a on a.id = g.source_id join h b on b.id = g.target_id and b.query_id = a.query_id where edge_type = 'causal' and g.source_id <> g.target_id),
steps as (select query_id, []::bigint[] as placed, 0 as n from (select distinct query_id from h)
union all select query_id, list_append(placed, (select min_by(h.id, (-h.score, h.id)) from h where h.query_id = steps.query_id and not list_contains(steps.placed, h.id) and not exists (select 1 from e where e.query_id = h.query_id and e.t = h.id and not list_contains(steps.placed, e.s)))), n + 1 from steps where n < (select count(*) from h where h.query_id = steps.query_id)),
done as (select query_id, max_by(placed, n) as placed from steps group by 1)
select query_id, unnest(placed) as id, generate_subscripts(placed, 1)::integer as place from done""")
def causal_topo(spark, sf):
    """Anchors in causal order: causes before effects, of the ready ones the best first."""
    a = retrieval.anchors(V.documents(spark, sf), V.queries(spark)).withColumn("score", F.round("score", 9))
    return graph.topological(a, V.edges(spark, sf))
