"""Correct reads as they arrive.

With a saved set of trusted k-mers every read is corrected on its own, so a stream
needs no state: each micro-batch goes through the batch corrector, which joins
when the set is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from mendseq.model import MAX_BROADCAST_BYTES, CorrectionParams
from mendseq.operators.correct import correct
from mendseq.operators.membership import KmerSet


def correct_stream(reads: DataFrame, trusted: KmerSet, params: CorrectionParams,
                   sink: Callable[[DataFrame, int], None],
                   max_broadcast: int = MAX_BROADCAST_BYTES) -> DataStreamWriter:
    """A writer that hands each corrected micro-batch to ``sink(batch, batch_id)``.

    A batch is handed over again after a failure: the sink should overwrite what it
    wrote for the same ``batch_id``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(correct(batch, trusted, params, max_broadcast), batch_id)

    return reads.writeStream.foreachBatch(handle)
