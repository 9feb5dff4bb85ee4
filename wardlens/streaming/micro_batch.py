"""Re-run a batch report each time new billing lines arrive."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wardlens.session import ensure_checkpoint_dir


def refresh_report_per_batch(lines_stream: DataFrame, line_table_path: str, report_path: str,
                             report: Callable[[DataFrame], DataFrame], name: str = "wardlens-report",
                             trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch of lines to its own folder of ``line_table_path``
    (parquet, ``batch_id=N``), then rebuild ``report`` over the whole table
    and overwrite ``report_path``.  A batch that is replayed overwrites its
    folder, so its lines count once.

    The stream's progress is checkpointed under the session's
    ``spark.checkpoint.dir`` so a restarted job resumes where it stopped.
    """
    spark = lines_stream.sparkSession
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{line_table_path.rstrip('/')}/batch_id={batch_id}")
        full = spark.read.parquet(line_table_path).drop("batch_id")
        report(full).write.mode("overwrite").parquet(report_path)

    w = lines_stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", ckpt)
    w = w.trigger(**trigger) if trigger else w.trigger(availableNow=True)
    return w.start()
