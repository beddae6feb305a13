"""The replay as a stream of events that carry their sequence number."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from armlight.operators import metrics as M
from armlight.operators.numbering import in_batches
from armlight.operators.policies import explore
from armlight.plans.replay import SEED, Policy, ReplayTables, decide, prediction
from armlight.plans.rounds import linear_round
from armlight.session import fresh_path
from armlight.sources.files import stage
from armlight.sources.stores import has_model, load_model, save_model

EVENT_SCHEMA = "seq bigint, user_key bigint"


def write_event_files(tables: ReplayTables, chunks: int, files_per_chunk: int = 2) -> str:
    """The replay as chunks of files that follow each other in sequence.

    The file source takes older files first, so a chunk is written after the one
    before it; a trigger of ``files_per_chunk`` files is one chunk.
    """
    path = fresh_path(tables.replay.sparkSession, "events")
    size = max(1, -(-tables.replay.count() // chunks))
    for chunk in range(chunks):
        rows = tables.replay.where((F.col("seq") > chunk * size) & (F.col("seq") <= (chunk + 1) * size))
        rows.select("seq", "user_key").repartition(files_per_chunk).write.mode("append").parquet(path)
    return path


def read_events(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


SUMS = ("n_events", "n_unscored", "reward", "loss", "regret")
_STATE = "n_events bigint, n_unscored bigint, reward double, loss double, regret double"


def _close_batches(size: int):
    """Adds the events of a batch to its kept sums; a batch that is full goes out and leaves the state."""

    def run(key, parts, state):
        sums = np.zeros(len(SUMS))
        if state.exists:
            sums += state.get
        for rows in parts:
            scored = rows["r"].notna()
            sums += [len(rows), (~scored).sum(), *(rows.loc[scored, c].sum() for c in ("r", "loss", "regret"))]
        n_events, n_unscored, *rest = sums.tolist()
        if n_events < size:
            state.update((int(n_events), int(n_unscored), *rest))
            return
        if state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], int(n_events), int(n_unscored), *rest)], columns=["batch", *SUMS])

    return run


def stream_batch_metrics(
    events: DataFrame, tables: ReplayTables, policy: Policy, size: int = M.BATCH_ROWS, seed=SEED, location: str | None = None
) -> DataFrame:
    """Metrics per complete batch from a stream; equal to the batch query, whatever the order of the events.

    The sums of open batches are the state; full batches are appended to a folder in ``location``, which also holds the
    progress. Called again with the same location, it goes on where it stopped: open batches are still open, and no event
    counts twice. Without events the frame is empty.
    """
    spark = events.sparkSession
    location = location or fresh_path(spark, "stream-metrics")
    users, offers = stage(decide(tables, policy), "stream-users"), tables.offers
    pulled = events.select("seq", "user_key", in_batches("seq", size).alias("batch"), F.lit(0).alias("epoch"))
    if policy.epsilon > 0:
        pulled = explore(pulled, offers.count(), policy.epsilon, seed, ("epoch", "seq"))
    else:
        pulled = pulled.withColumn("explored", F.lit(None).cast("bigint"))
    rows = pulled.join(users, "user_key").withColumn("offer_key", F.coalesce("explored", "best_offer")).join(offers, "offer_key")
    rows = M.with_outcomes(rows, tables.spec.reward, prediction(tables, policy)).select("batch", "r", "loss", "regret")
    schema = f"batch bigint, {_STATE}"
    out = f"{location}/batches"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(out)
    done = rows.groupBy("batch").applyInPandasWithState(_close_batches(size), schema, _STATE, "append", GroupStateTimeout.NoTimeout)
    query = (
        done.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{location}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def stream_policy_update(events: DataFrame, tables: ReplayTables, model, compat: bool = False, location: str | None = None) -> str:
    """One policy step per micro-batch; returns the folder of the model versions, ``location``/model.

    Version k is the model that micro-batch k starts from, so a repeated
    micro-batch reads the same model and writes the same next version. Called
    again with the same location, it goes on with the last model.
    """
    spark = events.sparkSession
    location = location or fresh_path(spark, "stream-model")
    path = f"{location}/model"
    if not has_model(spark, path):
        save_model(spark, model, path, 0)

    def handle(batch: DataFrame, batch_id: int) -> None:
        current = load_model(spark, path, model, batch_id)
        pulled = batch.select(
            "user_key", F.lit(batch_id).alias("batch"), F.lit(None).cast("bigint").alias("explored")
        )
        result = linear_round(M.exposures(pulled), tables, current, compat)
        save_model(spark, result.model, path, batch_id + 1)

    query = events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{location}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    return path
