"""Decisions over a live feed of requests: a stream joined with a versioned catalog.

The job is stateless, so it needs no watermark. Each micro-batch asks for the catalog's version; the
catalog is read only when that has changed, and a broken or empty new version stops the batch, so a
stale or empty catalog can never answer. A batch is written under its id, so a replayed batch replaces
its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probanza.functions import columns as C
from probanza.operators import decide as D
from probanza.streaming.catalog import VersionedCatalog

SESSION_MODES = ("authenticated", "unauthenticated", "wrong-owner")


def requests_from_feed(feed: DataFrame, other_customer: str) -> DataFrame:
    """Requests (request_id, customer_id, query, session_mode) in the shape the decision reads.

    A blank query or an unknown session mode is not a request and is left out.
    """
    mode = F.coalesce(F.col("session_mode"), F.lit("authenticated"))
    session = F.when(mode == "authenticated", F.col("customer_id")).when(mode == "wrong-owner", F.lit(other_customer))
    valid = (C.strip("query") != "") & mode.isin(*SESSION_MODES)
    return feed.filter(valid).select(
        F.col("request_id").cast("string").alias("case_id"),
        "customer_id",
        F.col("query").alias("customer_text"),
        F.coalesce(session, F.lit("")).alias("authenticated_customer_id"),
    )


def rejected_from_feed(feed: DataFrame) -> DataFrame:
    """Feed rows that are no request, with the reason; a missing query is an empty one."""
    mode = F.coalesce(F.col("session_mode"), F.lit("authenticated"))
    empty = F.coalesce(C.strip("query"), F.lit("")) == ""
    return feed.filter(empty | ~mode.isin(*SESSION_MODES)).select(
        "request_id", F.when(empty, "query is required").otherwise("invalid session_mode").alias("error")
    )


def decision_stream(
    feed: DataFrame,
    load: Callable[[], DataFrame],
    version: Callable[[], str],
    target: str,
    checkpoint: str,
    other_customer: str = "CLI-OTHER-OWNER",
    rejects: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the job: decide every request and write the answers as Parquet, and rejected rows to ``rejects``.

    ``version`` tells cheaply which catalog ``load`` would read (``catalog.path_version`` for files); snapshots
    of it lie beside the checkpoint. Answers carry the version that they rest on.
    ``trigger`` holds the arguments of Spark's trigger, such as ``{"processingTime": "10 seconds"}``
    for a live feed; without it the job decides what is available and ends.
    """

    catalog = VersionedCatalog(feed.sparkSession, load, version, f"{checkpoint.rstrip('/')}-catalog")

    def decide_batch(batch: DataFrame, batch_id: int) -> None:
        used = catalog.refresh()
        batch = batch.persist()
        requests = requests_from_feed(batch, other_customer)
        answers = D.decide_with(requests, catalog.of(requests)).withColumn("catalog_version", F.lit(used))
        answers.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if rejects:
            rejected_from_feed(batch).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        batch.unpersist()

    return (
        feed.writeStream.foreachBatch(decide_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
