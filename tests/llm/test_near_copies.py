"""Near copies of the pipeline against brute force."""
import random

import pytest

import corpus_pipeline as P
from tesserae.llm.near_copies import near_copies


def texts():
    rng, out = random.Random(5), []
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for n in (100, 100, 300, 1000):
        base = words(n)
        out.append(base)
        for share in (0.01, 0.02, 0.03, 0.06):
            copy = list(base)
            for i in rng.sample(range(n), max(1, int(n * share))):
                copy[i] = words(1)[0]
            out.append(copy)
    one = words(200)
    out += [one[:100] + words(1) + one[100:] for _ in range(40)] + [one, words(3), words(3), [], []]
    for k in range(1, 40):  # a chain whose ends are unlike
        out.append(one[4 * k:] + words(4 * k))
    return [" ".join(t) for t in out]


def brute(rows):
    sets = [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    root = [i for i, _ in rows]
    while True:
        new = [min([root[b] for b in range(len(rows)) if root[b] < root[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], default=root[a]) for a in range(len(rows))]
        new = [min(r for r, s in zip(new, root) if s == t) for t in root]
        if new == root:
            return dict(zip((i for i, _ in rows), root))
        root = new


@pytest.mark.parametrize("chunks", [(256, 64), (9, 5)])
def test_groups_equal_brute_force(spark, monkeypatch, chunks):
    """In whole keys and in keys that are cut into chunks; without leaders, so that all links come from chunks."""
    from tesserae.llm import near_copies as N

    monkeypatch.setattr(N, "CHUNK", chunks[0])
    monkeypatch.setattr(N, "FULL", chunks[1])
    monkeypatch.setattr(N, "HOT", 3)
    if chunks[0] < 256:
        monkeypatch.setattr(N, "SMALL", 0)
        monkeypatch.setattr(N, "_led", lambda members, led=N._led: led(members).limit(0))
    rows = list(enumerate(texts()))
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), bits=0).collect()}
    assert got == want and 1 < len(set(want.values())) < len(want)
    assert near_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_copy_with_a_changed_word_goes(spark):
    rng = random.Random(6)
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:50], "changed", *words[51:]]))]
    kept = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert {r.doc_id for r in kept} == set(range(0, 40, 2))
