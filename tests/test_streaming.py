"""The stateful stream over files that come one after another."""
from tesserae.streaming.ingest import backbone_stream


def test_backbone_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[("s", "b", 2), ("s", "a", 1), ("t", "x", 5)], [("s", "c", 3), ("s", "late", 0), ("t", "y", 5)], [("s", "d", 9), ("u", "only", 1)]]
    rows = spark.readStream.schema("namespace string, source string, id string, created_at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    links = backbone_stream(rows)
    for n, batch in enumerate(batches):
        lines = [f'{{"namespace":"n","source":"{s}","id":"{i}","created_at":"2024-01-0{1 + h // 10}T0{h}:00:00Z"}}' for s, i, h in batch]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        q = links.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.source, r.source_id or "", r.target_id, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s", "", "late", True), ("s", "a", "b", False), ("s", "b", "c", False), ("s", "c", "d", False), ("t", "x", "y", False)]
