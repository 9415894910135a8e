"""Bundles as they arrive: the batch scan over every micro-batch.

No layer keeps state across bundles, so a stream gives the results of a batch as long as a
bundle arrives whole, which a landing folder with one row or file a bundle does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from artifact_scan.plans.scan import Scan, analyze


def scan_stream(files: DataFrame, sink: Callable[[Scan, int], None], checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Starts a query that scans each micro-batch of a streaming ``files`` (bundle_id, path, text) and hands it to ``sink``.

    ``sink`` gets the scan and the batch's number and should write idempotently by that number;
    ``options`` go to ``analyze``.
    """

    def each(batch: DataFrame, number: int) -> None:
        scan = analyze(batch, **options)
        try:
            sink(scan, number)
        finally:
            scan.close()

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
