"""The pipeline's stages, each against what it must keep."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tesserae.llm.simhash import fingerprint

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Inputs and results of all stages over documents with clashing extra columns, odd and repeated rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({c: F.lit(c) for c in ("score", "predicted", "k", "r", "c0", "contaminated")})
    odd = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("bigint"))
    docs = docs.union(docs.where("doc_id < 5")).union(odd).union(odd.withColumn("text", F.lit("a text of its own without an id")))
    out, tmp = [docs], tmp_path_factory.mktemp("p")
    for name, f in P.STAGES:
        f(spark, out[-1], DATA).write.parquet(str(tmp / name))
        out.append(spark.read.parquet(str(tmp / name)))
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    before, after = (set(r.doc_id for r in s.select("doc_id").collect()) for s in stages[:2])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = before - after
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in gone for d in clean) / len(clean) < 0.02
    assert sum(labels.get(d) == 1 for d in gone) >= 0.6 * sum(labels.values())


def brute_groups(texts):
    """Least index that each text reaches by 4 bits of SimHash or by a similarity of five-word shingles of 0.8."""
    fps = [fingerprint(t) for t in texts]
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    holds: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    near = [{j for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 4} for i in range(len(texts))]
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holds[x]}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                near[i].add(j)
    root = list(range(len(texts)))
    while True:
        new = [min(root[j] for j in n) for n in near]
        if new == root:
            return root
        root = new


def test_one_of_each_group_stays(stages):
    before, after = ([(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in stages[1:3])
    keys = list(dict.fromkeys(before))
    groups: dict = {}
    for k, r in zip(keys, brute_groups([t for _, t in keys])):
        groups.setdefault(r, []).append(k)
    assert len(after) == len(set(after)) == len(groups) < len(keys)
    for members in groups.values():
        stays = [k for k in members if k in set(after)]
        ids = [i for i, _ in members if i is not None]
        assert len(stays) == 1 and (not ids or stays[0][0] == min(ids))


def test_one_doc_id_with_two_texts(spark):
    a, b = "one text " * 30, "quite another text about something else altogether " * 9
    rows = [(1, a), (5, a), (5, b), (5, b)]
    got = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (5, b)]
    named = spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, named, "").collect()) == ["d1", "d5"]


def test_contaminated_documents_go(spark, stages):
    from test_llm_operators import brute_windows

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i for (i, _), w in zip(rows, brute_windows([t for _, t in rows], items)) if not w[4]}
    assert {r.doc_id for r in stages[3].collect()} == want and len(want) < len(rows)


def test_tokens(stages):
    import sentencepiece

    from tesserae.llm.vocab import vocabulary

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = sorted(((r.doc_id, sp.encode(r.text or "")) for r in stages[3].collect()), key=repr)
    got = stages[4].collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_empty_table(spark, stages):
    docs = stages[0].limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, DATA)
    assert docs.count() == 0
