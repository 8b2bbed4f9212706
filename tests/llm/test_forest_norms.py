"""Recall of neighbours by inner product where norms vary, on tables that are not read whole."""
import numpy as np
import pytest

from tesserae.llm import forest


@pytest.mark.parametrize("norms", ["unit", "lognormal", "few long", "very uneven"])
def test_recall(spark, norms):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= {"unit": 1.0, "lognormal": np.exp(0.5 * rng.standard_normal((8000, 1))), "very uneven": np.exp(rng.standard_normal((8000, 1))), "few long": np.where(rng.random((8000, 1)) < 0.05, 5.0, 1.0)}[norms]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in forest.nearest(df, "id % 80 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x @ x[::80].T
    hit = 0
    for j, q in enumerate(range(0, 8000, 80)):
        score[q, j] = -np.inf
        hit += len(got[q] & set(np.argsort(-score[:, j])[:20].tolist()))
    print(norms, hit / 2000)
    assert len(got) == 100 and hit / 2000 >= 0.9
