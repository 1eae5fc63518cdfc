"""Coding of notes that arrive as a stream: stateless, so the batch operators serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.codebook import Code
from ..operators.coding import code_notes


def code_stream(corpus: DataFrame, codes: list[Code], path: str, checkpoint: str) -> StreamingQuery:
    """Code a stream of notes into Parquet; a restart goes on where the checkpoint says, each note coded once."""
    coded = code_notes(corpus, codes)
    return coded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
