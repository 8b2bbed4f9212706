"""The sixteen operations over a store, in a scope.

Single writes work on bounded results (candidates, neighbours) of distributed scans; analytics
(recall, search, retention, status) are plans over the whole scope. For loads use remember_many,
which builds edges of all rows by windows.
"""
from __future__ import annotations

import datetime as dt
import hashlib
import json
import unicodedata
import uuid
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae import validate
from tesserae.errors import ConfigurationError, EmbeddingError, NotFoundError, ValidationError
from tesserae.functions import diff, entities, scoring
from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.operators import edges as E
from tesserae.operators import graph, retrieval
from tesserae.operators.scoped import Scope
from tesserae.plans.recall import recall as plan_recall
from tesserae.sources.store import Store


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


@dataclass
class Config:
    path: str
    provider: object | None = None  # .dimensions, .model, .embed(text, purpose)
    clock: Callable[[], dt.datetime] = utc_now
    diff_judge: Callable | None = None
    causal_judge: Callable | None = None
    max_candidates: int = C.MAX_CANDIDATES
    default_source: str = "user"
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.path:
            raise ConfigurationError("a path is needed")
        if not C.MIN_CANDIDATES <= self.max_candidates <= C.TOP_CANDIDATES:
            raise ConfigurationError(f"max_candidates must be from {C.MIN_CANDIDATES} to {C.TOP_CANDIDATES}")


class Engine:
    def __init__(self, spark: SparkSession, config: Config):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            raise ConfigurationError("the session's time zone must be UTC")
        self.spark, self.config, self.store = spark, config, Store(spark, config.path)
        self.store.migrate()

    def scope(self, tenant_id: str, namespace: str, user_id: str | None = None) -> "Memory":
        return Memory(self, Scope(tenant_id, namespace, user_id))


def normal(content: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", content).lower().split())


class Memory:
    def __init__(self, engine: Engine, scope: Scope):
        self.engine, self.scope_, self.store, self.config, self.spark = engine, scope, engine.store, engine.config, engine.spark

    # Reads

    def _rows(self, active: bool = True, vectors: bool = False) -> DataFrame:
        """Rows of the scope; embeddings are read only if they are asked for."""
        return self.scope_.read(self.store.latest("insights", without=() if vectors else ("embedding",)), active)

    def _edges(self) -> DataFrame:
        return self.scope_.read(self.store.latest("edges"))

    def _ids(self, rows: DataFrame, ids) -> DataFrame:
        return rows.where(F.col("id").isin(*ids)) if ids else rows.limit(0)

    def get(self, id: str) -> dict | None:
        row = self._rows().where(F.col("id") == validate.uuid(id, "id")).first()
        return public(row) if row else None

    def list(self, limit: int = C.LIST_LIMIT, source=None, category=None, since=None, until=None) -> list[dict]:
        validate.limit(limit, C.LIST_MAX)
        rows = self._rows()
        if source is not None:
            rows = rows.where(F.col("source") == source)
        if category is not None:
            rows = rows.where(F.col("category") == validate.one_of(category, "category", C.CATEGORIES))
        if since is not None:
            rows = rows.where(F.col("created_at") >= F.lit(validate.timestamp(since, "since")))
        if until is not None:
            rows = rows.where(F.col("created_at") <= F.lit(validate.timestamp(until, "until")))
        return [public(r) for r in rows.orderBy(F.desc("created_at"), "id").limit(limit).collect()]

    def log(self, limit: int = C.LOG_LIMIT, operation: str | None = None) -> list[dict]:
        validate.limit(limit, C.LOG_MAX)
        rows = self.scope_.read(self.store.latest("oplog"))
        if operation is not None:
            rows = rows.where(F.col("operation") == operation)
        return [{"id": r.id, "operation": r.operation, "insight_id": r.insight_id, "detail": json.loads(r.detail or "{}"), "created_at": r.created_at} for r in rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).collect()]

    def status(self) -> dict:
        n = self._rows(vectors=True).agg(F.count("*").alias("insights"), F.count("embedding").alias("embeddings")).first()
        e = self._edges().agg(F.count("*").alias("edges"), *(F.count_if(F.col("edge_type") == t).alias(t) for t in C.EDGE_TYPES)).first()
        return {"insights": n.insights, "embeddings": n.embeddings, "edges": e.edges, "by_type": {t: e[t] for t in C.EDGE_TYPES}}

    def search(self, query: str, limit: int = C.SEARCH_LIMIT, source: str | None = None) -> list[dict]:
        validate.text(query, "query", C.MAX_CONTENT)
        validate.limit(limit, C.SEARCH_MAX)
        rows = self._rows() if source is None else self._rows().where(F.col("source") == source)
        rows = rows.withColumn("tokens", F.col("search_tokens"))
        want = [T.stem(w) for w in sorted(self._tokens(query)) if w not in C.STOPWORDS]
        fts = rows.select("id", F.explode(T.cover_ranks(F.col("content"), [(1, want)])).alias("r")).select("r.query_id", "id", "r.rank_cd")
        got = retrieval.search(rows, self._query(query), limit, fts).orderBy("rank").collect()
        found = {r.id: public(r) for r in self._ids(rows, [g.id for g in got]).collect()}
        return [{"insight": found[g.id], "score": g.score, "via": g.via} for g in got]

    def _tokens(self, text: str) -> list[str]:
        return self.spark.range(1).select(T.tokenize(F.lit(text)).alias("t")).first().t

    def _query(self, text: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("query_id"), F.lit(text).alias("query"), T.tokenize(F.lit(text)).alias("tokens"))

    def _known(self, text: str, rows: DataFrame) -> list[str]:
        one = self.spark.range(1).select(F.lit("x").alias("id"), F.lit(text).alias("content"))
        return [r.word for r in entities.admitted(rows, one).select("word").distinct().collect()]  # at most the words of one text

    def _entities(self, text: str, rows: DataFrame, provided=()) -> list[str]:
        words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        got = entities.merge(words(provided), entities.extract_indexed(F.lit(text), words(self._known(text, rows))))
        return self.spark.range(1).select(got.alias("e")).first().e

    def recall(self, query: str, limit: int = C.RECALL_LIMIT, intent: str | None = None, source: str | None = None, category: str | None = None, brief: bool = False, excerpt_chars: int = C.BRIEF_CHARS) -> dict:
        validate.text(query, "query", C.MAX_CONTENT)
        validate.limit(limit, C.RECALL_MAX)
        if intent is not None:
            validate.one_of(intent, "intent", C.INTENTS)
        if category is not None:
            validate.one_of(category, "category", C.CATEGORIES)
        rows = self._rows(vectors=self.config.provider is not None).withColumn("tokens", F.col("search_tokens"))
        vector = self._embed(query, "query") if self.config.provider else None
        words = self._entities(query, rows)
        q = self._query(query).withColumns({"entities": F.array(*map(F.lit, words)).cast("array<string>"), "intent": F.lit(intent) if intent else scoring.detect_intent(F.col("query"))})
        if source is not None:
            q = q.withColumn("source", F.lit(source))
        if category is not None:
            q = q.withColumn("category", F.lit(category))
        vectors = None
        if vector is not None:
            q = q.withColumn("vector", F.array(*map(F.lit, vector)))
            vectors = rows.where("embedding is not null").select("id", "embedding")
        hits = plan_recall(rows.drop("embedding") if vectors is not None else rows, self._edges(), q, vectors, limit, self.config.max_candidates).orderBy("place").collect()
        found = {r.id: public(r) for r in self._ids(rows, [h.id for h in hits]).collect()}
        used = q.select("intent").first().intent
        out = []
        for h in hits:
            one = {"insight": found[h.id], "score": h.score, "via": h.via, "signals": {k: h[k] for k in ("keyword", "entity", "similarity", "graph")}}
            if brief:
                one["insight"] = one["insight"] | {"content": self.spark.range(1).select(T.brief(F.lit(found[h.id]["content"]), excerpt_chars).alias("b")).first().b}
            out.append(one)
        now = self.config.clock()
        self._access([h.id for h in hits], now, 1, self._op("recall", None, {"query_hash": hashlib.sha256(query.encode()).hexdigest(), "hit_count": len(out), "intent": used}, now))
        meta = {"intent": used, "intent_source": "override" if intent else "auto"}
        if not out or len(out) < limit / 2:
            meta["hint"] = "sparse_results"
        return {"results": out, "meta": meta}

    def related(self, id: str, depth: int = C.RELATED_DEPTH, limit: int = C.RELATED_LIMIT, edge_type: str | None = None) -> list[dict]:
        validate.limit(depth, C.RELATED_MAX_DEPTH, "depth")
        validate.limit(limit, C.RELATED_MAX)
        id = validate.uuid(id, "id")
        rows = self._rows()
        if self.get(id) is None:
            raise NotFoundError([id])
        start = self.spark.range(1).select(F.lit(1).alias("query_id"), F.lit(id).alias("id"))
        edges = self._edges().select("source_id", "target_id", "edge_type", "weight", "created_at", "edge_seq")
        got = graph.related(start, edges, depth, limit, edge_type).join(rows.select("id", "content"), "id")
        return [{"id": r.id, "depth": r.depth, "weight": r.weight, "edge_type": r.edge_type, "content": r.content} for r in got.orderBy("depth", F.desc("weight"), "id").collect()]

    # Writes

    def _op(self, operation: str, insight_id: str | None, detail: dict, at: dt.datetime) -> dict:
        return self._stamp({"id": (self.store.version() + 1) * 1000 + 1, "operation": operation, "insight_id": insight_id, "detail": json.dumps(detail, sort_keys=True), "created_at": at, "gone": False})

    def _stamp(self, row: dict) -> dict:
        return row | {"tenant_id": self.scope_.tenant_id, "user_id": self.scope_.user_id, "namespace": self.scope_.namespace}

    def _embed(self, text: str, purpose: str) -> list[float]:
        try:
            v = self.config.provider.embed(text, purpose)
        except Exception as e:
            raise EmbeddingError("the embedding provider failed") from e
        return validate.embedding(v, self.config.provider.dimensions)

    def _settings(self, now: dt.datetime) -> list[dict]:
        if not self.config.provider:
            return []
        p = self.config.provider
        mine = json.dumps({"dimensions": p.dimensions, "model": p.model}, sort_keys=True)
        kept = self.store.latest("settings").where("key = 'embedding'").first()
        if kept and kept.value != mine:
            raise ConfigurationError("the store's embeddings have another model or dimension")
        return [] if kept else [{"key": "embedding", "value": mine, "updated_at": now}]

    def _near(self, rows: DataFrame, content: str, vector) -> list:
        """The 5 nearest by keyword and the 5 nearest by vector, classified; managed rows fall out after the cut."""
        tokens = self._tokens(content)
        lit = F.array(*map(F.lit, tokens)).cast("array<string>")
        ids: list[str] = []
        if tokens:
            score = F.size(F.array_intersect("search_tokens", lit))
            ids += [r.id for r in rows.where(F.arrays_overlap("search_tokens", lit)).orderBy(F.desc(score), F.desc("importance"), F.desc("created_at"), "id").limit(C.DEDUP_CANDIDATES).select("id").collect()]
        v = F.array(*map(F.lit, vector)) if vector is not None else None
        cos = F.when(F.col("embedding").isNotNull(), S.cosine(F.col("embedding"), v)).otherwise(0.0) if v is not None else F.lit(0.0)
        if v is not None:
            ids += [r.id for r in rows.where("embedding is not null").orderBy(F.desc(cos), "id").limit(C.DEDUP_CANDIDATES).select("id").collect()]
        pairs = self._ids(rows, list(dict.fromkeys(ids))).where("not managed").select(F.col("id").alias("old_id"), F.lit(content).alias("new"), F.col("content").alias("old"), lit.alias("new_tokens"), T.tokenize(F.col("content")).alias("old_tokens"), cos.alias("cosine"))
        return diff.classify_pairs(pairs).orderBy(F.desc("similarity"), "old_id").collect()

    def remember(self, content: str, **more) -> dict:
        i = validate.remember({"content": content, "source": self.config.default_source} | more)
        now = self.config.clock()
        rows = self._rows(vectors=self.config.provider is not None)
        h = hashlib.sha256(normal(content).encode()).hexdigest()
        exact = rows.where((F.col("content_hash") == h) & ~F.col("managed")).orderBy("id").first()
        if exact:
            return self._skip(exact.id, now)
        vector = self._embed(content, "document") if self.config.provider else None
        near = self._near(rows, content, vector)
        if i["deduplicate"]:
            same = sorted(r.old_id for r in near if r.safe)
            if same:
                return self._skip(same[0], now)
        kinds = {r.old_id: r.suggestion for r in near}
        if self.config.diff_judge and near:
            names = {"duplicate": "DUPLICATE", "refines": "UPDATE", "contradicts": "CONFLICT", "unrelated": "ADD"}
            try:
                kinds |= {k: names[v] for k, v in self.config.diff_judge(content, [{"id": r.old_id, "content": r.old} for r in near]).items() if k in kinds and v in names}
            except Exception:  # a judge that fails leaves the rules' answer
                pass
        overall = "CONFLICT" if "CONFLICT" in kinds.values() else "DUPLICATE" if "DUPLICATE" in kinds.values() else kinds[near[0].old_id] if near else "ADD"
        record, edges = self._build(i, {"id": str(uuid.uuid4()), "metadata": "{}", "managed": False}, vector, rows, now)
        kept, gone = self._persist(rows, record, edges, now)
        counts = {t: sum(e["edge_type"] == t for e in kept) for t in C.EDGE_TYPES}
        made = {t: sum(e["edge_type"] == t for e in edges) for t in C.EDGE_TYPES}
        op = self._op("remember", record["id"], {"edge_counts": made}, now)
        self.store.commit({"insights": [record], "edges": kept + gone, "oplog": [op], "settings": self._settings(now)})
        candidates = []
        if vector is not None:
            c = S.cosine(F.col("embedding"), F.array(*map(F.lit, vector)))
            candidates = [{"id": r.id, "content": r.content, "cosine": r.c} for r in rows.where("embedding is not null").withColumn("c", c).where(F.col("c") >= C.SEMANTIC_CANDIDATE).orderBy(F.desc("c"), "id").limit(5).select("id", "content", "c").collect()]
        return {"action": "added", "insight": public(record), "suggestion": overall, "diff": [{"id": r.old_id, "similarity": r.similarity, "suggestion": kinds[r.old_id]} for r in near], "semantic_candidates": candidates, "edge_counts": counts}

    def _skip(self, id: str, now: dt.datetime) -> dict:
        self.store.commit({"oplog": [self._op("remember_skipped", id, {}, now)]})
        return {"action": "skipped", "insight": self.get(id), "suggestion": "DUPLICATE", "diff": [], "semantic_candidates": [], "edge_counts": dict.fromkeys(C.EDGE_TYPES, 0)}

    def upsert(self, id: str, content: str, metadata: dict | None = None, **more) -> dict:
        i = validate.remember({"content": content, "source": self.config.default_source} | more)
        id, now = validate.uuid(id, "id"), self.config.clock()
        old = self._rows(active=False).where(F.col("id") == id).first()
        if old and not old.managed:
            raise ValidationError("id", "the row is not a managed one")
        vector = self._embed(content, "document") if self.config.provider else None
        rows = self._rows(vectors=self.config.provider is not None).where(F.col("id") != id)
        record, edges = self._build(i, {"id": id, "metadata": validate.metadata(metadata), "managed": True}, vector, rows, now)
        if old:
            record |= {k: old[k] for k in ("created_at", "stored_at", "access_count", "last_accessed_at")}
        kept, gone = self._persist(rows, record, edges, now)
        stale = self._edges().where(F.col("derived") & ((F.col("source_id") == id) | (F.col("target_id") == id))).collect()  # at most the edges of one row
        new = {(e["source_id"], e["target_id"], e["edge_type"]) for e in kept}
        gone += [r.asDict() | {"gone": True} for r in stale if (r.source_id, r.target_id, r.edge_type) not in new]
        self.store.commit({"insights": [record], "edges": kept + gone, "oplog": [self._op("upsert", id, {"edge_counts": len(kept)}, now)], "settings": self._settings(now)})
        return public(record)

    def _build(self, i: dict, own: dict, vector, rows: DataFrame, now: dt.datetime) -> tuple[dict, list[dict]]:
        names = self._entities(i["content"], rows, i["entities"])
        tokens = self.spark.range(1).select(T.search_tokens(F.lit(i["content"]), F.array(*map(F.lit, i["tags"])).cast("array<string>"), F.array(*map(F.lit, names)).cast("array<string>")).alias("t")).first().t
        record = self._stamp(own | {"content": i["content"], "normalized_content": normal(i["content"]), "content_hash": hashlib.sha256(normal(i["content"]).encode()).hexdigest(), "search_tokens": tokens, "category": i["category"], "importance": i["importance"],
                                    "tags": i["tags"], "entities": names, "source": i["source"], "access_count": 0, "stored_at": now, "created_at": i["created_at"] or now, "updated_at": now, "deleted_at": None, "last_accessed_at": None, "embedding": vector, "effective_importance": 0.5})
        return record, self._generate(record, rows, vector)

    def _generate(self, r: dict, rows: DataFrame, vector) -> list[dict]:
        """Edges of one new row; each of the five lookups brings a bounded number of rows."""
        at, me, out = F.lit(r["created_at"]), r["id"], []
        same = rows.where(F.col("source") == r["source"])

        def edge(s, t, kind, weight, **meta):
            out.append({"source_id": s, "target_id": t, "edge_type": kind, "weight": weight, "metadata": {k: str(v) for k, v in meta.items()}})

        prev = same.where(F.col("created_at") <= at).orderBy(F.desc("created_at"), "id").select("id").first()
        nxt = same.where(F.col("created_at") > at).orderBy("created_at", "id").select("id").first()
        for a, b in ((prev and prev.id, me), (me, nxt and nxt.id)):
            if a and b:
                edge(a, b, "temporal", 1.0, sub_type="backbone", direction="precedes")
                edge(b, a, "temporal", 1.0, sub_type="backbone", direction="succeeds")
        skip = {x.id for x in (prev, nxt) if x}
        day = F.expr(f"interval {C.TEMPORAL_HOURS} hours")
        hours = F.abs(F.unix_micros("created_at") - F.unix_micros(at)) / F.lit(3_600_000_000.0)
        for o in rows.where(F.col("created_at").between(at - day, at + day)).orderBy(F.desc("created_at"), "id").limit(C.PROXIMITY_LINKS).select("id", hours.alias("h")).collect():
            if o.id not in skip:
                for a, b in ((o.id, me), (me, o.id)):
                    edge(a, b, "temporal", 1 / (1 + o.h), sub_type="proximity", hours_diff=fixed(o.h, 2))
        low = [e.lower() for e in r["entities"]]
        if low:
            met = rows.where(F.arrays_overlap(F.transform("entities", F.lower), F.array(*map(F.lit, low)))).select("id", "created_at", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("e")).where(F.col("e").isin(*low))
            top = retrieval.ranked(met, [F.desc("created_at"), "id"], C.ENTITY_LINKS, by=("e",)).collect()
            for p in sorted(top, key=lambda x: (low.index(x.e), x["rank"]))[:C.ENTITY_EDGES // 2]:
                for a, b in ((p.id, me), (me, p.id)):
                    edge(a, b, "entity", 1.0, entity=r["entities"][low.index(p.e)])
        before = same.orderBy(F.desc("created_at"), "id").limit(C.CAUSAL_LOOKBACK)
        judged = None
        if self.config.causal_judge:
            try:
                judged = self.config.causal_judge(r["content"], [{"id": x.id, "content": x.content} for x in before.select("id", "content").collect()])
            except Exception:  # a judge that fails leaves the rules' answer
                judged = None
        if judged is not None:
            for other, j in judged.items():
                way, _, kind = j.get("relation", "").partition("_")
                kind, w = kind.split("_")[0], j.get("weight", 1)
                if way in ("existing", "new") and kind in ("causes", "enables", "prevents") and 0 < w <= 1 and other != me:
                    edge(other if way == "existing" else me, me if way == "existing" else other, "causal", float(w), sub_type=kind, created_by="judge")
        else:
            new = F.lit(r["content"])
            has, their = T.contains_any(new, C.CAUSAL_PHRASES), T.contains_any(F.col("content"), C.CAUSAL_PHRASES)
            got = before.select("id", has.alias("mine"), their.alias("theirs"), S.causal_overlap(T.tokenize(new), T.tokenize(F.col("content"))).alias("w"), E.sub_type(F.concat_ws(" ", new, "content")).alias("kind")).where((F.col("mine") | F.col("theirs")) & (F.col("w") >= C.CAUSAL_OVERLAP))
            for x in got.collect():
                a, b = (x.id, me) if x.mine else (me, x.id)
                edge(a, b, "causal", x.w, overlap=fixed(x.w, 4), sub_type=x.kind)
        if vector is not None:
            c = S.cosine(F.col("embedding"), F.array(*map(F.lit, vector)))
            for x in rows.where("embedding is not null").select("id", c.alias("c")).orderBy(F.desc("c"), "id").limit(C.SEMANTIC_EDGES).collect():
                if x.c >= C.SEMANTIC_EDGE:
                    for a, b in ((x.id, me), (me, x.id)):
                        edge(a, b, "semantic", x.c, cosine=fixed(x.c, 4))
        return out

    def _persist(self, rows: DataFrame, record: dict, edges: list[dict], now: dt.datetime) -> tuple[list[dict], list[dict]]:
        """Edge rows to write, and those that go; sets the record's score. Of equal keys the last counts; explicit edges stay."""
        keyed = {(e["source_id"], e["target_id"], e["edge_type"]): e for e in edges}
        me = record["id"]
        old = {(r.source_id, r.target_id, r.edge_type): r for r in self._edges().where((F.col("source_id") == me) | (F.col("target_id") == me)).collect()} if record["managed"] else {}
        seq = (self.store.version() + 1) * 1000
        kept = [self._stamp(e | {"created_at": now, "derived": True, "edge_seq": seq + n, "gone": False}) for n, (k, e) in enumerate(keyed.items()) if not (k in old and not old[k].derived)]
        gone = []
        line = {d: next((e for e in edges if e["metadata"].get("sub_type") == "backbone" and e["metadata"]["direction"] == "precedes" and e[d] == me), None) for d in ("target_id", "source_id")}
        if line["target_id"] and line["source_id"]:
            a, b = line["target_id"]["source_id"], line["source_id"]["target_id"]
            link = self._edges().where((F.col("edge_type") == "temporal") & (F.col("metadata")["sub_type"] == "backbone") & (((F.col("source_id") == a) & (F.col("target_id") == b)) | ((F.col("source_id") == b) & (F.col("target_id") == a))))
            gone = [r.asDict() | {"gone": True} for r in link.collect()]
        record["effective_importance"] = self.spark.range(1).select(scoring.effective_importance(F.lit(record["importance"]), F.lit(record["access_count"]), F.lit(0.0), F.lit(len(keyed))).alias("x")).first().x
        return kept, gone

    def link(self, source_id: str, target_id: str, edge_type: str, weight: float = 1.0, metadata: dict | None = None) -> dict:
        s, t = validate.uuid(source_id, "sourceId"), validate.uuid(target_id, "targetId")
        if s == t:
            raise ValidationError("targetId", "a row is not linked to itself")
        validate.one_of(edge_type, "edgeType", C.EDGE_TYPES)
        validate.number(weight, "weight", 0, 1)
        there = {r.id for r in self._ids(self._rows(), [s, t]).select("id").collect()}
        if there != {s, t}:
            raise NotFoundError(sorted({s, t} - there))
        now = self.config.clock()
        row = self._stamp({"source_id": s, "target_id": t, "edge_type": edge_type, "weight": float(weight), "metadata": {k: str(v) for k, v in (metadata or {}).items()}, "created_at": now, "derived": False, "edge_seq": (self.store.version() + 1) * 1000, "gone": False})
        self.store.commit({"edges": [row], "oplog": [self._op("link", s, {"target": t, "edge_type": edge_type}, now)]})
        self._refresh([s, t], now)
        return {"source_id": s, "target_id": t, "edge_type": edge_type, "weight": float(weight)}

    def _refresh(self, ids: list[str], now: dt.datetime) -> None:
        scored = self._scored(now, vectors=True).where(F.col("id").isin(*ids)).withColumn("effective_importance", F.col("ei"))
        self.store.commit({"insights": [r.asDict() for r in scored.drop("n", "edges", "ei").collect()]})

    def forget(self, id: str) -> bool:
        id, now = validate.uuid(id, "id"), self.config.clock()
        row = self._rows(vectors=True).where(F.col("id") == id).first()
        if not row:
            return False
        gone = [r.asDict() | {"gone": True} for r in self._edges().where((F.col("source_id") == id) | (F.col("target_id") == id)).collect()]
        self.store.commit({"insights": [row.asDict() | {"deleted_at": now, "updated_at": now}], "edges": gone, "oplog": [self._op("forget", id, {}, now)]})
        return True

    def _access(self, ids: list[str], now: dt.datetime, by: int, op: dict) -> None:
        rows = [r.asDict() | {"access_count": r.access_count + by, "last_accessed_at": now, "updated_at": max(now, r.updated_at.astimezone(dt.timezone.utc))} for r in self._ids(self._rows(vectors=True), ids).collect()]
        self.store.commit({"insights": rows, "oplog": [op]})

    def keep(self, id: str) -> dict:
        id, now = validate.uuid(id, "id"), self.config.clock()
        if self.get(id) is None:
            raise NotFoundError([id])
        self._access([id], now, C.KEEP_BOOST, self._op("gc_keep", id, {"boost": C.KEEP_BOOST}, now))
        self._refresh([id], now)
        return self.get(id)

    def _scored(self, now: dt.datetime, vectors: bool = False) -> DataFrame:
        n = E.degrees(self._edges())
        rows = self._rows(vectors=vectors).join(n, "id", "left").withColumn("edges", F.coalesce("n", F.lit(0)))
        days = scoring.days_since(F.lit(now), F.col("last_accessed_at"), F.col("created_at"))
        return rows.withColumn("ei", scoring.effective_importance(F.col("importance"), F.col("access_count"), days, F.col("edges")))

    def retention_candidates(self, threshold: float = C.RETENTION_THRESHOLD, limit: int = C.RETENTION_LIMIT, write_back: bool = True) -> dict:
        validate.number(threshold, "threshold", 0, 1)
        validate.limit(limit, C.LIST_MAX)
        scored = self._scored(self.config.clock())
        low = scored.where((F.col("ei") < threshold) & ~scoring.immune(F.col("importance"), F.col("access_count")))
        out = [{"insight": public(r), "effective_importance": r.ei, "edge_count": r.edges} for r in low.orderBy("ei", "id").limit(limit).collect()]
        total = low.count()
        if write_back:  # only what moved by a hundredth or more
            moved = self._scored(self.config.clock(), vectors=True).where(F.abs(F.col("ei") - F.coalesce("effective_importance", F.lit(-1.0))) >= 0.01).withColumn("effective_importance", F.col("ei"))
            self.store.commit({"insights": moved.drop("n", "edges", "ei")})
        return {"candidates": out, "total": total}

    def embed_missing(self, limit: int = C.PRUNE_LIMIT) -> dict:
        if not self.config.provider:
            raise ConfigurationError("an embedding provider is needed")
        validate.limit(limit, C.LIST_MAX)
        bare, now = self._rows(vectors=True).where("embedding is null"), self.config.clock()
        total = bare.count()
        n = min(total, limit)
        if n:
            from tesserae.sources.embedding import embed_column

            rows = bare.orderBy("created_at", "id").limit(limit).withColumn("embedding", embed_column(self.config.provider, F.col("content")))
            self.store.commit({"insights": rows, "oplog": [self._op("embed:backfill", None, {"embedded": n}, now)], "settings": self._settings(now)})
        return {"embedded": n, "remaining": total - n}

    def prune(self, oplog_before=None, operations_before=None, forgotten_before=None, limit: int = C.PRUNE_LIMIT) -> dict:
        """At most `limit` rows of each kind, the oldest first; versions stay in the log until it is compacted."""
        validate.limit(limit, C.LIST_MAX)
        out = {"oplog": 0, "operations": 0, "forgotten": 0}
        changes: dict = {}
        for name, table, before, order in (("oplog", "oplog", oplog_before, "id"), ("operations", "operations", operations_before, "key")):
            if before is not None:
                rows = self.scope_.read(self.store.latest(table)).where(F.col("created_at") < F.lit(validate.timestamp(before, name))).orderBy("created_at", order).limit(limit).collect()
                out[name], changes[table] = len(rows), [r.asDict() | {"gone": True} for r in rows]
        if forgotten_before is not None:
            dead = self._rows(active=False, vectors=True).where(F.col("deleted_at").isNotNull() & (F.col("content") != "") & (F.col("deleted_at") < F.lit(validate.timestamp(forgotten_before, "forgotten")))).orderBy("deleted_at", "id").limit(limit).collect()
            out["forgotten"], changes["insights"] = len(dead), [r.asDict() | {"content": "", "normalized_content": "", "embedding": None, "search_tokens": [], "entities": [], "tags": []} for r in dead]
        self.store.commit(changes)
        return out

    def peek(self, key: str):
        """What `once` has stored for a key, or None."""
        kept = self.scope_.read(self.store.latest("operations"), by_user=False).where(F.col("key") == key).first()
        return json.loads(kept.result) if kept else None

    def receipt(self, limit: int = C.LOG_LIMIT) -> list[dict]:
        """The op log with hashes in place of ids and details."""
        from tesserae.sources.importer import receipt_rows

        validate.limit(limit, C.LOG_MAX)
        rows = self.scope_.read(self.store.latest("oplog")).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
        return [r.asDict() for r in receipt_rows(rows).collect()]

    def import_draft(self, draft: dict, deduplicate: bool = True) -> dict:
        """Remember a parsed draft's rows one by one, then link them; links of rows that fell together are left out."""
        from tesserae.sources.importer import check_draft

        check_draft(draft)
        out = []
        for i in draft["insights"]:
            more = {k: i[k] for k in ("category", "importance", "tags", "entities", "created_at") if i.get(k) is not None}
            saved = self.remember(i["content"], source=i.get("source") or draft.get("source") or "import", deduplicate=deduplicate, **more)
            out.append({"id": saved["insight"]["id"], "action": saved["action"]})
        n = 0
        for e in draft.get("edges") or []:
            a, b = out[e["source_index"]]["id"], out[e["target_index"]]["id"]
            if a != b:
                self.link(a, b, e["edge_type"], e.get("weight", 0.5), {"reason": e["reason"]} if e.get("reason") else None)
                n += 1
        return {"insights": out, "edges": n}

    def once(self, key: str, fn: Callable[[], object]) -> dict:
        """fn's JSON result, run at most once for a key; a failure stores nothing. Keys are shared by a namespace's users.

        What fn commits to the store is published together with the key, so neither is there without
        the other. The key bears the wall clock, whatever clock the engine has been given.
        """
        if not isinstance(key, str) or not 1 <= len(key) <= 512:
            raise ValidationError("key", "key must be 1 to 512 characters")
        kept = self.scope_.read(self.store.latest("operations"), by_user=False).where(F.col("key") == key).first()
        if kept:
            return {"value": json.loads(kept.result), "replayed": True}
        with self.store.transaction():
            value = fn()
            self.store.commit({"operations": [self._stamp({"key": key, "result": json.dumps(value), "created_at": utc_now(), "gone": False})]})
        return {"value": value, "replayed": False}

    def remember_many(self, new: DataFrame) -> int:
        """Bulk load: content, source, category, importance, tags, entities, created_at in ascending order.

        Exact copies (of stored rows or earlier in the batch) are left out; with a provider rows are
        embedded in batches; edges of the five kinds come from windows and joins over the rows that can
        have a part in them: the batch's sources, days and entities. A row that comes between two
        neighbours of its source takes the place of their backbone link. Equals the one-by-one form if
        times are different, near duplicates are not to be skipped, and entities known are those of
        before the batch. Ids derive from the scope and the content's hash.
        """
        from tesserae.plans.session import settle

        now, provider = F.lit(self.config.clock()), self.config.provider
        h = T.content_hash(T.normalize_content(F.col("content")))
        rows = new.withColumn("content_hash", h)
        rows = rows.join(self._rows().select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min_by(F.struct(*new.columns), F.struct("created_at", "content")).alias("r")).select("content_hash", "r.*")
        key = F.md5(F.concat_ws("\x1f", F.lit(self.scope_.tenant_id), F.lit(self.scope_.namespace), F.coalesce(F.lit(self.scope_.user_id).cast("string"), F.lit("")), "content_hash"))
        names = entities.merge(F.col("entities"), entities.extract(F.col("content"), None))
        rows = self.scope_.stamp(rows).withColumns({"id": F.concat(F.substring(key, 1, 8), F.lit("-"), F.substring(key, 9, 4), F.lit("-5"), F.substring(key, 14, 3), F.lit("-a"), F.substring(key, 18, 3), F.lit("-"), F.substring(key, 21, 12)), "normalized_content": T.normalize_content(F.col("content")), "entities": names})
        if provider:
            from tesserae.sources.embedding import embed_column

            vector = embed_column(provider, F.col("content"))
        else:
            vector = F.lit(None).cast("array<float>")
        rows = rows.withColumns({"search_tokens": T.search_tokens(F.col("content"), F.col("tags"), F.col("entities")), "metadata": F.lit("{}"), "managed": F.lit(False), "access_count": F.lit(0), "stored_at": now, "updated_at": now, "deleted_at": F.lit(None).cast("timestamp"), "last_accessed_at": F.lit(None).cast("timestamp"), "embedding": vector, "effective_importance": F.lit(0.5)})
        rows = settle(rows)
        count = rows.count()
        if not count:
            self.store.commit({"oplog": [self._op("remember_many", None, {"rows": 0}, self.config.clock())]})
            return 0
        fresh = rows.select("id")
        old = self._rows()
        slim = ["id", "namespace", "source", "created_at", "content", "entities"]
        sources = retrieval.sized(rows.select("source").distinct())
        lines = settle(old.join(sources, "source", "left_semi").select(*slim).unionByName(rows.select(*slim)))
        first, last = rows.agg(F.min("created_at"), F.max("created_at")).first()
        day = F.expr(f"interval {C.TEMPORAL_HOURS} hours")
        days = old.where(F.col("created_at").between(F.lit(first) - day, F.lit(last) + day)).select(*slim).unionByName(rows.select(*slim))
        low = F.transform("entities", F.lower)
        named = old.select("id", "created_at", "entities", F.explode(low).alias("e")).join(rows.select(F.explode(low).alias("e")).distinct(), "e", "left_semi").select("id", "created_at", "entities").dropDuplicates(["id"]).unionByName(rows.select("id", "created_at", "entities"))
        meta = lambda *kv: F.create_map(*(F.lit(x) if not hasattr(x, "alias") else x for x in kv))
        link = settle(E.backbone(lines).select("source_id", "target_id", "edge_type", "weight", meta("sub_type", "backbone", "direction", F.col("direction")).alias("metadata")))
        p = E.proximity(days).select("source_id", "target_id", "edge_type", "weight", meta("sub_type", "proximity", "hours_diff", F.format_string("%.2f", "hours")).alias("metadata"))
        n = E.entity_links(named).select("source_id", "target_id", "edge_type", "weight", meta("entity", F.col("entity")).alias("metadata"))
        c = E.causal(lines.withColumn("tokens", T.tokenize(F.col("content")))).select("source_id", "target_id", "edge_type", "weight", meta("sub_type", F.col("sub_type"), "overlap", F.format_string("%.4f", "weight")).alias("metadata"))
        edges = link.union(p).union(n).union(c)
        if provider:
            stored = self._rows(vectors=True).where("embedding is not null").select("id", "embedding", F.lit(0).cast("bigint").alias("seq"))
            place = rows.where("embedding is not null").select("id", "embedding", F.unix_micros("created_at").alias("seq"))
            asked = place.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), "seq")
            near = retrieval.knn(stored.withColumn("seq", F.lit(-(1 << 62))).unionByName(place), asked, C.SEMANTIC_EDGES)
            sem = E.semantic(near, C.SEMANTIC_EDGE)
            edges = edges.union(sem.select("source_id", "target_id", "edge_type", "weight", meta("cosine", F.format_string("%.4f", "weight")).alias("metadata")))
        edges = edges.join(fresh.select(F.col("id").alias("source_id")), "source_id", "left_semi").union(edges.join(fresh.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(edges.columns))
        one = edges.groupBy("source_id", "target_id", "edge_type").agg(F.max_by(F.struct("weight", "metadata"), "weight").alias("e")).select("source_id", "target_id", "edge_type", "e.*")
        out = self.scope_.stamp(one).withColumns({"created_at": now, "derived": F.lit(True), "edge_seq": F.xxhash64("source_id", "target_id"), "gone": F.lit(False)})
        ends = lines.select("id")
        spliced = self._edges().where((F.col("edge_type") == "temporal") & F.col("derived") & (F.col("metadata")["sub_type"] == "backbone"))
        spliced = spliced.join(ends.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(link.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti").withColumn("gone", F.lit(True))
        self.store.commit({"insights": rows, "edges": out.unionByName(spliced.select(out.columns)), "oplog": [self._op("remember_many", None, {"rows": count}, self.config.clock())], "settings": self._settings(self.config.clock())})
        return count


def fixed(x: float, places: int) -> str:
    """x to so many places, its exact binary value rounded half up."""
    from decimal import ROUND_HALF_UP, Decimal

    return str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def public(r) -> dict:
    get = r.asDict() if hasattr(r, "asDict") else r
    out = {k: get[k] for k in ("id", "content", "category", "importance", "tags", "entities", "source", "access_count", "created_at", "updated_at", "last_accessed_at")}
    return out | {"metadata": json.loads(get["metadata"] or "{}")}
