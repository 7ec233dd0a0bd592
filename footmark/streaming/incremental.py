"""Classification of arriving evidence.

Extraction and enrichment look at one row at a time, so they run on a stream as
they are; links, sessions and reports are batch jobs over the stored artifacts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from footmark.operators.enrich import enrich


def store_artifacts(arriving: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str,
                    checkpoint: str) -> StreamingQuery:
    """Extracts and enriches what has arrived and appends it to the artifact table, exactly once per input."""
    rows = enrich(extract(arriving))
    return (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("case_id").outputMode("append").trigger(availableNow=True).start())
