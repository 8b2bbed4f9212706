"""The operations end to end on a small store."""
import datetime as dt

import pytest

from tesserae.errors import ConfigurationError, NotFoundError, ValidationError
from tesserae.memory import Config, Engine
from tesserae.operators.scoped import Scope


class Clock:
    def __init__(self):
        self.now = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)

    def __call__(self):
        return self.now


def provider(vectors, model="table"):
    from tesserae.sources.embedding import TableProvider

    return TableProvider(vectors, 4, model, default=[0.0, 0.0, 0.0, 1.0])


ROWS = [
    ("User prefers dark mode in the editor.", "preference", "agent", "2024-01-01T10:00:00Z"),
    ("User does not prefer dark mode in the editor.", "preference", "agent", "2024-01-01T10:03:00Z"),
    ("Production deploy started for checkout service.", "fact", "ops", "2024-02-01T12:00:00Z"),
    ("Production deploy finished for checkout service.", "fact", "ops", "2024-02-01T12:20:00Z"),
    ("We chose PostgreSQL because concurrent writers share one memory store.", "decision", "agent", "2024-03-01T09:00:00Z"),
    ("Therefore we store embeddings with vectors in PostgreSQL so one memory store stays.", "decision", "agent", "2024-03-01T09:05:00Z"),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    vectors = {ROWS[0][0]: [1.0, 0, 0, 0], "dark mode editor": [1.0, 0, 0, 0], "dark mode": [1.0, 0, 0, 0], ROWS[1][0]: [0.9, 0.1, 0, 0]}
    return Engine(spark, Config(str(tmp_path_factory.mktemp("store")), provider=provider(vectors), clock=Clock()))


@pytest.fixture(scope="module")
def memory(engine):
    m = engine.scope("t1", "main", "u1")
    m.made = [m.remember(c, category=k, source=s, created_at=at) for c, k, s, at in ROWS]
    return m


def test_remember(memory):
    assert [r["action"] for r in memory.made] == ["added"] * 6
    assert memory.made[1]["suggestion"] == "DUPLICATE" and memory.made[1]["edge_counts"]["semantic"] == 2
    assert memory.made[3]["edge_counts"]["temporal"] == 2
    assert memory.made[5]["edge_counts"]["causal"] >= 1 and memory.made[5]["edge_counts"]["entity"] == 2
    again = memory.remember("  user PREFERS dark mode in the editor. ", deduplicate=False)
    assert again["action"] == "skipped" and again["insight"]["id"] == memory.made[0]["insight"]["id"]
    assert memory.remember("dark mode user prefers in editor", source="agent")["action"] == "skipped"


def test_recall(memory):
    got = memory.recall("dark mode editor", limit=5)
    assert {h["insight"]["content"] for h in got["results"][:2]} == {ROWS[0][0], ROWS[1][0]}
    ids = [h["insight"]["id"] for h in got["results"]]
    assert [h["insight"]["id"] for h in memory.recall("dark mode editor", limit=5)["results"]] == ids
    why = memory.recall("why did we chose PostgreSQL", limit=3)
    assert why["meta"]["intent"] == "WHY"
    assert all(h["insight"]["category"] == "fact" for h in memory.recall("deploy", category="fact", limit=4)["results"])
    assert memory.get(ids[0])["access_count"] >= 2
    assert len(memory.recall("dark mode", limit=1, brief=True, excerpt_chars=10)["results"][0]["insight"]["content"]) <= 10


def test_reads(memory):
    assert [r["content"] for r in memory.list(source="ops")] == [ROWS[3][0], ROWS[2][0]]
    assert len(memory.list(since="2024-02-01T12:20:00Z")) == 3
    found = memory.search("deploys started")
    assert found[0]["insight"]["content"] == ROWS[2][0] and found[0]["via"] == "hybrid"
    assert memory.status()["insights"] == 6 and memory.status()["embeddings"] == 6
    assert {"remember", "remember_skipped", "recall"} <= {r["operation"] for r in memory.log(limit=100)}
    rel = memory.related(memory.made[0]["insight"]["id"], depth=1)
    assert memory.made[1]["insight"]["id"] in [r["id"] for r in rel]


def test_isolation(engine, memory):
    other = engine.scope("t1", "main", "u2")
    assert other.list() == [] and other.get(memory.made[0]["insight"]["id"]) is None
    assert other.remember(ROWS[0][0])["action"] == "added"  # the same fact of another user
    assert engine.scope("t2", "main", "u1").list() == []
    assert memory.once("k", lambda: {"a": 1}) == {"value": {"a": 1}, "replayed": False}
    assert other.once("k", lambda: {"a": 2}) == {"value": {"a": 1}, "replayed": True}


def test_writes(memory):
    a, b = (memory.made[i]["insight"]["id"] for i in (0, 2))
    memory.link(a, b, "causal", 0.5)
    assert b in [r["id"] for r in memory.related(a, depth=1, edge_type="causal")]
    with pytest.raises(ValidationError):
        memory.link(a, a, "causal")
    with pytest.raises(NotFoundError):
        memory.link(a, "00000000-0000-4000-8000-000000000000", "causal")
    assert memory.keep(a)["access_count"] >= 3
    memory.config.clock.now += dt.timedelta(days=150)
    got = memory.retention_candidates(threshold=0.25)
    assert got["total"] >= 1 and a not in [c["insight"]["id"] for c in got["candidates"]]
    up = memory.upsert("00000000-0000-4000-8000-000000000001", "Managed note on billing", metadata={"x": 1})
    assert memory.upsert(up["id"], "Managed note on invoices")["content"].endswith("invoices")
    assert memory.forget(b) and not memory.forget(b) and memory.get(b) is None
    assert b not in [r["id"] for r in memory.related(a, depth=1)]
    pruned = memory.prune(forgotten_before="2030-01-01T00:00:00Z", oplog_before="2030-01-01T00:00:00Z", limit=2)
    assert pruned["oplog"] == 2 and pruned["forgotten"] == 1


SCHEMA = "content string, source string, category string, importance int, tags array<string>, entities array<string>, created_at timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(c, s, k, 3, [], [], dt.datetime.fromisoformat(at)) for c, k, s, at in rows], SCHEMA)


def test_bulk_load(engine, spark):
    m = Engine(spark, Config(engine.config.path, clock=engine.config.clock)).scope("t1", "bulk")
    df = frame(spark, ROWS + [ROWS[0][:3] + ("2024-05-01T00:00:00Z",)])
    assert m.remember_many(df) == 6
    assert m.remember_many(df) == 0
    s = m.status()
    assert s["insights"] == 6 and s["by_type"]["temporal"] > 0 and s["by_type"]["causal"] >= 1
    own = engine.scope("t1", "bulk")
    assert own.embed_missing()["embedded"] == 6 and own.embed_missing() == {"embedded": 0, "remaining": 0}


def test_bulk_load_equals_one_by_one(spark, tmp_path):
    """Two batches, the second with a row between two of the first: the same links, the spliced one gone."""
    vectors = {ROWS[0][0]: [1.0, 0, 0, 0], ROWS[1][0]: [0.9, 0.1, 0, 0], ROWS[2][0]: [0.0, 1, 0, 0], ROWS[3][0]: [0.1, 0.9, 0, 0], ROWS[4][0]: [0.0, 0, 1, 0], ROWS[5][0]: [0.0, 0.1, 0.9, 0]}
    late = ("A quiet remark in between.", "fact", "ops", "2024-02-01T12:10:00Z")
    first, second = [r for r in ROWS if r != ROWS[5]], [late, ROWS[5]]
    links = []
    for way in ("one", "many"):
        m = Engine(spark, Config(str(tmp_path / way), provider=provider(vectors), clock=Clock())).scope("t", "n")
        for batch in (first, second):
            if way == "many":
                m.remember_many(frame(spark, batch))
            else:
                for c, k, s, at in batch:
                    m.remember(c, category=k, source=s, created_at=at, deduplicate=False)
        text = {r.id: r.content for r in m._rows().collect()}
        links.append({(text[e.source_id], text[e.target_id], e.edge_type, round(e.weight, 6), e.metadata.get("sub_type")) for e in m._edges().collect()})
    assert links[0] == links[1]
    assert (ROWS[2][0], ROWS[3][0], "temporal", 1.0, "backbone") not in links[1] and (late[0], ROWS[3][0], "temporal", 1.0, "backbone") in links[1]
    assert {k for _, _, k, _, _ in links[1]} == {"temporal", "causal", "entity", "semantic"}


def test_commits(spark, tmp_path):
    """What a failed commit has written is never seen, nor what a failed transaction has."""
    from tesserae.errors import StoreError
    from tesserae.schema import VERSION
    from tesserae.sources.store import Store

    st = Store(spark, str(tmp_path / "s"))
    row = lambda k: {"tenant_id": "t", "namespace": "007", "user_id": "u", "key": k, "result": "1", "created_at": None, "gone": False}
    keys = lambda: sorted(r.key for r in st.latest("operations").collect())
    st.commit({"operations": [row("a")]})
    with pytest.raises(StoreError):
        st.commit({"operations": [row("ghost")], "edges": spark.range(1)})
    publish, st._publish = st._publish, lambda rows: 1 / 0
    with pytest.raises(ZeroDivisionError):
        st.commit({"operations": [row("ghost")]})
    st._publish = publish
    st.commit({"operations": [row("b")]})
    assert keys() == ["a", "b"] and st.latest("operations").first().namespace == "007"
    with pytest.raises(KeyError), st.transaction():
        st.commit({"operations": [row("c")]})
        assert keys() == ["a", "b", "c"]
        raise KeyError
    assert keys() == ["a", "b"]
    with st.transaction():
        st.commit({"operations": [row("c")]})
        st.commit({"operations": [row("a") | {"gone": True}]})
    assert keys() == ["b", "c"] and st.schema_version() == VERSION
    assert [r.key for r in st.compact(str(tmp_path / "c")).latest("operations").orderBy("key").collect()] == ["b", "c"]
    st.commit({"settings": [{"key": "schema", "value": str(VERSION + 1), "updated_at": None}]})
    with pytest.raises(ConfigurationError):
        st.migrate()


def test_once_is_atomic(engine, spark, monkeypatch):
    m = engine.scope("t9", "once")
    real = m.store._publish
    monkeypatch.setattr(m.store, "_publish", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        m.once("k", lambda: m.remember("An effect of its own", source="x")["action"])
    monkeypatch.setattr(m.store, "_publish", real)
    assert m.list() == [] and m.peek("k") is None
    assert m.once("k", lambda: m.remember("An effect of its own", source="x")["action"])["value"] == "added"
    assert m.once("k", lambda: 1 / 0) == {"value": "added", "replayed": True} and len(m.list()) == 1


def test_settings_and_scope(engine, spark):
    other = Engine(spark, Config(engine.config.path, provider=provider({}, "other")))
    with pytest.raises(ConfigurationError):
        other.scope("t1", "main").remember("A fact about something else entirely")
    with pytest.raises(ValidationError):
        Scope(" t", "main")


def test_streaming_ingest(engine, spark, tmp_path):
    from tesserae.streaming.ingest import SCHEMA, stream_remember

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"content":"Alpha note","source":"s","created_at":"2024-01-01T00:00:00Z"}\n{"content":"Beta note","source":"s","created_at":"2024-01-01T01:00:00Z"}\n')
    m = engine.scope("t1", "stream")
    rows = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    for _ in range(2):
        q = stream_remember(m, rows, str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()
    assert sorted(r["content"] for r in m.list()) == ["Alpha note", "Beta note"]


def test_draft(spark, tmp_path):
    from tesserae.sources import importer

    (tmp_path / "d.json").write_text('{"schema_version":"1","insights":[{"content":"a"},{"content":"b","source":"x"}],"edges":[{"source_index":0,"target_index":1,"edge_type":"causal"}]}')
    d = importer.read_draft(spark, str(tmp_path / "d.json"))
    assert [(r.content, r.source) for r in importer.draft_insights(d).orderBy("seq").collect()] == [("a", "import"), ("b", "x")]
    assert importer.draft_edges(d).first().weight == 0.5
    with pytest.raises(ValidationError):
        importer.check_draft({"schema_version": "1", "insights": [{}], "edges": [{"source_index": 0, "target_index": 3, "edge_type": "causal"}]})


def test_draft_import_and_receipt(engine):
    m = engine.scope("t3", "draft")
    draft = {"schema_version": "1", "source": "file", "insights": [{"content": "Alpha ships on Monday"}, {"content": "Beta ships on Friday", "importance": 5}, {"content": "alpha ships on monday"}],
             "edges": [{"source_index": 0, "target_index": 1, "edge_type": "causal", "reason": "r"}, {"source_index": 0, "target_index": 2, "edge_type": "entity"}]}
    got = m.import_draft(draft)
    assert [i["action"] for i in got["insights"]] == ["added", "added", "skipped"] and got["edges"] == 1
    rows = m.receipt()
    assert {r["operation"] for r in rows} == {"remember", "remember_skipped", "link"} and all(r["id_hash"] for r in rows)


def test_agent_workflow(engine):
    from tesserae.adapters import AgentMemory, identity

    m = engine.scope("t4", "agent")
    a = AgentMemory(m, "s", "personal", budget=200)
    assert a.propose("c0", "password: hunter2hunter2")["reasons"] == ["sensitive"]
    first = a.propose("c1", "Dana is allergic to peanuts.")
    assert first["status"] == "stored" and a.propose("c1", "Dana is allergic to  peanuts.") == first
    assert a.propose("c2", "Today I'm working on the invoice bug.")["reasons"][-1] == "transient"
    b = AgentMemory(m, "s", "personal", gate=lambda p: {"accept": True, "reasons": [], "supersedes": [x["id"] for x in p["related"]] + ["other"]})
    assert b.propose("c3", "Dana is allergic to shellfish and peanuts now.")["superseded"] == [first["id"]]
    got = a.turn_recall("op", [{"role": "user", "content": "allergic Dana"}])
    assert len(got) == 1 and "shellfish" in got[0]["content"] and a.turn_recall("op", [{"role": "user", "content": "other"}]) == got
    assert AgentMemory(m, "s", "personal", recall_filter=lambda q, ms: 1 / 0).turn_recall("op2", [{"role": "user", "content": "allergic Dana"}])
    assert AgentMemory(m, "s", "personal", recall_filter=lambda q, ms: []).turn_recall("op3", [{"role": "user", "content": "allergic Dana"}]) == []
    id = got[0]["id"].split(":")[-1]
    assert a.forget("f", id) and a.forget("f", id) and m.get(id) is None
    assert identity({"type": "user", "id": "u", "attributes": {"tenantId": "t"}})[0] == "t"
    assert identity({"type": "user", "id": "u", "attributes": {"tenantId": ["t", "s"]}}) is None and identity(None) is None


def test_embedding_connectors(spark):
    import json

    from pyspark.sql import functions as F

    from tesserae.errors import EmbeddingError
    from tesserae.sources.embedding import HttpProvider, TableProvider, embed_column

    sent = []

    def answer(payload, status=200):
        def send(url, body, headers, timeout):
            sent.append((url, body, headers))
            return status, json.dumps(payload).encode()
        return send

    p = HttpProvider("llamacpp", dimensions=2, send=answer({"data": [{"embedding": [1, 2, 3]}]}))
    assert p.embed("x", "query") == [1, 2] and sent[-1][1]["input"] == "search_query: x"
    p = HttpProvider("openai", endpoint="http://h/v1/", dimensions=2, api_key="k", send=answer({"data": [{"embedding": [1, 2]}]}))
    assert p.embed("x", "document") == [1, 2] and sent[-1][0] == "http://h/v1/embeddings" and sent[-1][2]["authorization"] == "Bearer k"
    p = HttpProvider("ollama", dimensions=2, send=answer({"embeddings": [[1, 2]]}))
    assert p.embed("x", "document") == [1, 2] and "dimensions" not in sent[-1][1]
    for bad in (answer({"embeddings": [[1]]}), answer({}, 500), answer({"embeddings": []}), answer({"embeddings": [["a"]]})):
        with pytest.raises(EmbeddingError):
            HttpProvider("ollama", dimensions=2, send=bad).embed("x", "query")
    t = TableProvider({"a": [1.0, 0.0], "query:a": [0.0, 1.0]}, 2)
    assert t.embed("a", "query") == [0.0, 1.0]
    got = spark.createDataFrame([("a",), (None,)], "t string").select(embed_column(t, F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [[1.0, 0.0], None]
