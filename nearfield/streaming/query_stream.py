"""A stream of query vectors against a static matrix, and running bests over a stream of scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.spmv import multi_spmv
from ..operators.topk import per_row_topk


def answer_stream(coo: DataFrame, queries: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of vectors (query_id, col, val) is joined with the matrix and its top-k handed to ``sink``.

    A query's entries must arrive in one batch; with the checkpoint folder a restarted stream goes on where it was.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        sink(per_row_topk(multi_spmv(coo, df), k, "query_id"), epoch)

    w = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
