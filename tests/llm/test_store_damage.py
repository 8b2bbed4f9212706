"""A store whose recipes were lost or changed is not read without an error."""
import shutil

import pytest
from pyspark.sql import functions as F

from tesserae.llm import queries as Q
from tesserae.llm import token_store
from tesserae.llm.vocab import vocabulary


@pytest.mark.parametrize("how", ["lost", "order"])
def test_damage(spark, how, monkeypatch):
    def damaged(docs, path, tokenizer):
        token_store.write_store(docs, path, tokenizer)
        plain = path.removeprefix("file:")
        recipes = spark.read.parquet(f"{path}/recipes")
        changed = recipes.where("doc_id <> 3") if how == "lost" else recipes.withColumn("chunks", F.reverse("chunks"))
        changed.write.parquet(f"{path}/changed")
        shutil.rmtree(f"{plain}/recipes")
        shutil.move(f"{plain}/changed", f"{plain}/recipes")

    monkeypatch.setattr(Q, "write_store", damaged)
    with pytest.raises(ValueError, match="manifest"):
        Q.QUERIES["op8_token_store"](spark, "/root/testdata/sf0.001")
