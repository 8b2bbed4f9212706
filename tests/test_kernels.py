"""Column kernels on hand-written examples."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tesserae import adapters, validate
from tesserae.functions import diff, entities, gates, scoring
from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.memory import fixed


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def words(*ws):
    return F.array(*map(F.lit, ws)).cast("array<string>")


@pytest.mark.parametrize("text,want", [
    ("The quick brown fox is fast", {"quick", "brown", "fox", "fast"}), ("hello, world!", {"hello", "world"}), ("hello😀world", {"hello", "world"}), ("中", {"中"}),
    ("中文测试", {"中文", "文测", "测试"}), ("Use 中文 in TypeScript", {"use", "中文", "typescript"}), ("the and or but", set()), ("", set())])
def test_tokenize(spark, text, want):
    assert set(one(spark, T.tokenize(F.lit(text)))) == want


def test_normal_and_hash(spark):
    assert one(spark, T.normalize_content(F.lit("  ＡＢＣ   d\n"))) == "abc d"
    assert one(spark, T.content_hash(F.lit("hello"))) == hashlib.sha256(b"hello").hexdigest()


@pytest.mark.parametrize("text,n,want", [("abcdefghij", 5, "abcd…"), ("abc de", 5, "abc…"), ("a  b", 5, "a b"), ("ab", 1, "…")])
def test_brief(spark, text, n, want):
    assert one(spark, T.brief(F.lit(text), n)) == want


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("running", "run"), ("generalization", "gener"), ("sky", "sky")])
def test_stem(word, want):
    assert T.stem(word) == want


def test_cover_density(spark):
    doc = T.stems(F.lit("The deploy of the checkout service failed, deploys fail"))
    assert one(spark, T.cover_density(doc, ["deploi", "fail"])) > 0
    assert one(spark, T.cover_density(doc, ["absent"])) is None


def test_similarity(spark):
    a, b = words("a", "b", "c"), words("b", "c", "d", "e")
    assert one(spark, S.jaccard(a, b)) == pytest.approx(2 / 5)
    assert one(spark, S.symmetric(a, b)) == pytest.approx(2 / 3)
    assert one(spark, S.causal_overlap(a, b)) == pytest.approx(2 / 4)
    assert one(spark, S.jaccard(words(), b)) == 0
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, S.cosine(v(1, 0), v(1, 1))) == pytest.approx(2**-0.5)
    assert one(spark, S.cosine(v(0, 0), v(1, 1))) == 0
    assert one(spark, S.cosine(v(1), v(1, 1))) == 0


def test_entities(spark):
    got = one(spark, entities.extract(F.lit("OpenTypeScript uses HTTP in src/main.ts see https://example.com/a and @alice reads 《史记》")))
    assert {"OpenTypeScript", "HTTP", "src/main.ts", "https://example.com/a", "alice", "史记"} <= set(got)
    got = one(spark, entities.extract(F.lit("Scores 0.52 and 127.0.0.1, e.g. the J.Y. case on p.4, live in cmd/root.go, llama.cpp and example.org")))
    assert {"cmd/root.go", "llama.cpp", "example.org"} <= set(got) and not {"0.52", "127.0.0.1", "e.g", "J.Y", "p.4"} & set(got)
    got = one(spark, entities.extract(F.lit("NEVER skip the API check; ONLY use HTTP. Status: OK, FIXED")))
    assert {"API", "HTTP"} <= set(got) and not {"NEVER", "ONLY", "OK", "FIXED"} & set(got)
    assert one(spark, entities.extract(F.lit("foo.txt bar.txt"))) == ["foo.txt", "bar.txt"]
    assert "FooBar" in one(spark, entities.extract(F.lit("éFooBar")))
    assert one(spark, entities.merge(words("Provided"), words("TypeScript", "Provided"))) == ["Provided", "TypeScript"]
    assert one(spark, entities.extract_indexed(F.lit("we met zeta and beta"), words("beta"))) == ["beta"]
    assert one(spark, entities.hot_limit(F.lit(3000))) == 30 and one(spark, entities.hot_limit(F.lit(2050))) == 20.5 and one(spark, entities.hot_limit(F.lit(10))) == 20


@pytest.mark.parametrize("query,want", [
    ("why did we decide this", "WHY"), ("when did this happen in the timeline", "WHEN"), ("tell me about PostgreSQL", "ENTITY"), ("why when", "GENERAL"), ("remember the meeting notes", "GENERAL"), ("为什么选择这个", "WHY"), ("why, tell me about the reason", "WHY")])
def test_intent(spark, query, want):
    assert one(spark, scoring.detect_intent(F.lit(query))) == want


def test_retention(spark):
    f = lambda i, a, d, e: one(spark, scoring.effective_importance(F.lit(i), F.lit(a), F.lit(float(d)), F.lit(e)))
    assert f(3, 0, 60, 0) == pytest.approx(0.125) and f(3, 0, 0, 50) == pytest.approx(0.75) and f(5, 100, 0, 5) == 1


def test_final_score(spark):
    assert one(spark, scoring.final_score(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)), True)) == pytest.approx(0.3)
    assert one(spark, scoring.final_score(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)), False)) == pytest.approx(0.45)


def test_elite_normalisation(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.0, 2.0), (1, "b", 0.5, 0.0, 4.0), (1, "c", 0.0, 0.0, 9.0), (2, "d", 1.0, 0.0, 3.0)], "q int, id string, keyword double, similarity double, graph_raw double")
    got = {r.id: r.graph for r in scoring.normalize_elite(df, False, ["q"]).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0, "d": 0.0}


def test_diff(spark):
    s = lambda t, sim, new, old: one(spark, diff.suggestion(F.lit(t), F.lit(sim), F.lit(new), F.lit(old)))
    assert s(0.4, 0.4, "a", "b") == "ADD"
    assert s(0.75, 0.75, "we no longer use x", "we use x") == "CONFLICT"
    assert s(0.95, 0.95, "same text", "same text") == "DUPLICATE"
    assert s(0.95, 0.95, "same text with much more in it", "same text") == "UPDATE"
    assert s(0.6, 0.6, "a", "b") == "UPDATE"
    safe = lambda a, b: one(spark, diff.safe_duplicate(F.lit(a), F.lit(b), T.tokenize(F.lit(a)), T.tokenize(F.lit(b))))
    assert safe("User prefers dark mode.", "user prefers dark mode")
    assert not safe("User does not prefer dark mode", "User does prefer dark mode")
    assert not safe("", "")


def test_judged_gate_and_sanitiser(spark):
    p = F.create_map(*(F.lit(x) for kv in {"durable": 0.9, "transient": 0.1, "duplicate": 0.2, "appropriateAudience": 0.8, "sensitive": 0.7}.items() for x in kv))
    g = one(spark, gates.judged_gate(p))
    assert not g.accept and g.reasons == ["sensitive"]
    g = one(spark, gates.judged_gate(F.create_map(F.lit("durable"), F.lit(float("nan")))))
    assert not g.accept and g.reasons == ["invalid-evaluation"]
    s = one(spark, gates.sanitize(F.lit("odd"), F.lit(7.6), ("fact",)))
    assert s.category is None and s.importance == 5


#: audience, fact, what is known, the reason that rejects it
FACTS = [
    ("organization", "Travel costs above 900 euros need a signature from the finance lead.", None, None), ("organization", "Our warehouse ships parcels every Monday and Friday.", None, None),
    ("personal", "I like meeting notes as one short paragraph.", None, None), ("personal", "My team lead is Noor Haddad.", None, None), ("personal", "Milo hates cilantro in soups.", None, None),
    ("organization", "The nightly backup is in progress and 70% copied.", None, "transient"), ("organization", "Ticket 90211 waits for a reviewer.", None, "transient"), ("personal", "I'm working on the slides this afternoon.", None, "transient"),
    ("personal", "Great, that helped a lot!", None, "durable"), ("personal", "Could you restart the printer?", None, "durable"), ("organization", "sounds good", None, "durable"),
    ("organization", "The search index is owned by the platform group.", ["The search index is owned by the platform group."], "duplicate"),
    ("personal", "Milo also hates raw onions.", ["Milo hates cilantro in soups."], None),
    ("organization", "My daughter's recital is on May 9.", None, "appropriateAudience"), ("personal", "The platform group runs the search index release.", None, "appropriateAudience"),
    ("personal", "My locker combination is 7730 1.", None, "sensitive"), ("personal", "I pay with 5500 0000 0000 0004 as my card.", None, "sensitive"), ("organization", "Test secret: Zq81_kkp02mmW", None, "sensitive"),
    ("organization", "Secret: santa is drawn by the office crew in December", None, None),
]


def test_gate(spark):
    df = spark.createDataFrame([(i, a, f, r or []) for i, (a, f, r, _) in enumerate(FACTS)], "i int, audience string, fact string, related array<string>")
    got = {r.i: r.g for r in df.select("i", gates.heuristic_gate(F.col("fact"), F.col("audience"), F.col("related")).alias("g")).collect()}
    for i, (_, fact, _, reject) in enumerate(FACTS):
        assert got[i].accept == (reject is None), (fact, got[i])
        assert reject is None or reject in got[i].reasons, (fact, got[i])


def test_gate_patterns_know_all_white_space(spark):
    """Blanks beyond ASCII count in the patterns, inside classes and outside; joined patterns find what each finds."""
    blanks = [" ", "\u00a0", "\u3000", "\u2028", "\ufeff", "\t"]
    rows = [(f"the password{b}is{b}hunter2x",) for b in blanks] + [(f"1234{b}5678{b}1234{b}5678",) for b in blanks] + [(f"secret:{b}ab_c1234",) for b in blanks]
    got = spark.createDataFrame(rows, "t string").select(gates.sensitive(F.col("t")).alias("s")).collect()
    assert all(r.s for r in got)
    texts = ["step 3 of 9", "Ships TODAY", "re-today", "xtoday", "50%a", "50% a", "build #4821", "the user's", "I", "Iris prefers tea", "éI", "we", "wet", "ok then", "so ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for ps in (gates.TRANSIENT, gates.PERSONAL, gates.ORGANIZATION, (gates.SMALL_TALK, gates.QUESTION), gates.SECRETS):
        both = df.select("t", gates.any_of(F.col("t"), ps).alias("a"), F.greatest(*(gates.has(F.col("t"), p) for p in ps), F.lit(False)).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both] == [any(re.search(p.replace(r"\z", r"\Z"), r.t, re.ASCII) for p in ps) for r in both]


def test_faults(spark):
    rows = [("ok", 3, "fact", ["a"], None), (" \u00a0", 9, "x", ["b" * 101, " "], None), (None, None, None, [str(i) for i in range(21)], None), ("y" * 8001, 5, "general", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, content string, importance int, category string, tags array<string>, created_at timestamp")
    got = {r.i: [tuple(x) for x in r.f] for r in df.select("i", validate.faults(df).alias("f")).collect()}
    late = ("created_at", "missing")
    assert got[0] == [late] and got[3] == [("content", "too_long"), late]
    assert got[1] == [("content", "blank"), ("importance", "out_of_range"), ("category", "not_allowed"), ("tags", "too_long"), ("tags", "blank"), late]
    assert got[2] == [("content", "blank"), ("importance", "out_of_range"), ("category", "not_allowed"), ("tags", "too_many"), late]


def test_causal_order_of_cycles():
    from tesserae.operators.graph import causal_order

    scores = {"a": 0.1, "b": 0.9, "c": 0.5, "x": 0.2, "y": 0.8}
    assert causal_order(["x", "y", "b", "c", "a"], scores, [("a", "b"), ("x", "y"), ("y", "x"), ("c", "c")]) == ["c", "a", "b", "x", "y"]


def test_fixed_rounds_the_binary_value():
    assert fixed(2.005, 2) == "2.00" and fixed(0.125, 2) == "0.13"


def test_adapters():
    assert adapters.recall_block([{"id": "1", "content": "a  b"}, {"id": "2", "content": "x" * 50}], "Known:", 20) == "Known:\n- a b"
    assert adapters.recall_block([{"id": "1", "content": "x" * 50}], "Known:", 20) == ""
    assert adapters.latest_user_text([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]) == "a"
    assert "=" not in adapters.digest("a", "b") and adapters.digest("a", "b") != adapters.digest("ab")
