"""An extension: a stream of catalog rows kept as the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeweave.operators.catalog import upsert
from citeweave.sources.readers import remove


def latest(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch is merged with the table before it and written as a new version `v=<batch>`; readers.latest_version reads the last one.

    A batch that is run again writes its version again. The version before stays, for those who read it; older ones go. The table is
    rewritten with each batch, so a trigger should gather as much as may be late.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch if epoch == 0 else batch.unionByName(spark.read.parquet(f"{path}/v={epoch - 1}"))
        upsert(rows, key, [order, F.xxhash64(*[c for c in rows.columns if c != key])], True).write.mode("overwrite").parquet(f"{path}/v={epoch}")
        if epoch > 1:
            remove(spark, f"{path}/v={epoch - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
