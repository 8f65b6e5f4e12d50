"""Re-mining of a growing edge table, one search for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphmine.plans.mine import mine
from graphmine.sources.graph import EDGE, adjacency


def mine_stream(edges: DataFrame, state_path: str, out_path: str, checkpoint: str, min_support: int, max_edges: int, directed: bool = False) -> StreamingQuery:
    """Append each micro-batch of edges to ``state_path`` and write the frequent patterns of all edges so far to ``out_path``.

    A batch's edges go to a folder of its number, which a repeated batch overwrites, so retries add nothing twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.select(*EDGE).write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        so_far = batch.sparkSession.read.parquet(state_path).select(*EDGE)
        mine(adjacency(so_far, directed), min_support, max_edges).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
