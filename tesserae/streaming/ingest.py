"""Continuous ingest and reports over the op log."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "content string, source string, category string, importance int, tags array<string>, entities array<string>, created_at timestamp"


def stream_remember(memory, rows: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Remember a stream of rows, a micro-batch at a time. A batch that is replayed changes nothing:
    its number is the key of `once`, and copies are left out by their hash. Late rows are not dropped."""

    def one(batch: DataFrame, number: int) -> None:
        filled = batch.where("content is not null").withColumns({"source": F.coalesce("source", F.lit("stream")), "category": F.coalesce("category", F.lit("general")), "importance": F.coalesce("importance", F.lit(3)),
                                   "tags": F.coalesce("tags", F.array().cast("array<string>")), "entities": F.coalesce("entities", F.array().cast("array<string>")), "created_at": F.coalesce("created_at", F.lit(memory.config.clock()))})
        memory.once(f"stream:{checkpoint}:{number}"[-512:], lambda: memory.remember_many(filled))

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def operations_per_window(log: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of operations in tumbling windows; batch or stream."""
    rows = log.withWatermark("created_at", late) if log.isStreaming else log
    return rows.groupBy(F.window("created_at", length), "operation").agg(F.count("*").alias("n")).select("window.start", "window.end", "operation", "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's operations grouped into sessions that end after a gap."""
    rows = log.withWatermark("created_at", late) if log.isStreaming else log
    return rows.groupBy(F.session_window("created_at", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")


def backbone_stream(rows: DataFrame, by: tuple = ("namespace", "source")) -> DataFrame:
    """(by, source_id, target_id, late) of a stream of rows (by, id, created_at): each row linked to the newest of its group so far.

    The state of a group is its newest row alone. A row that is older than that is late: it is put out with
    a null source_id, for whoever splices it between its neighbours (remember_many does), and does not
    change the state. Within a micro-batch rows count in the order of (created_at, id).
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*by, "id")}
    out = ", ".join(f"{c} {kinds[c]}" for c in by) + f", source_id {kinds['id']}, target_id {kinds['id']}, late boolean"

    def run(key, parts, state):
        import pandas as pd

        newest = state.get if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(["created_at", "id"])
        made = []
        for i, at in zip(pdf.id.tolist(), pdf.created_at):
            now = (at.value, i)
            if newest is not None and now <= (newest[0], newest[1]):
                made.append((*key, None, i, True))
                continue
            if newest is not None:
                made.append((*key, newest[1], i, False))
            newest = now
        state.update(newest)
        yield pd.DataFrame(made, columns=[*by, "source_id", "target_id", "late"])

    return rows.select(*by, "id", "created_at").groupBy(*by).applyInPandasWithState(run, out, f"at bigint, id {kinds['id']}", "append", "NoTimeout")
