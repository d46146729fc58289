"""Incremental runs with Structured Streaming.

The reference re-reads everything on each run and merges into its stores.
Here a file-source stream with ``trigger(availableNow=True)`` processes
only files not yet seen (tracked in the checkpoint), and ``foreachBatch``
applies the batch as keyed upserts (U1), which write the batch's own size
(``KeyedTable``). An upsert is idempotent, so a micro-batch replayed after a failure gives the same table.
There is no event time in this domain: no watermark or state store is
needed, each micro-batch is a stateless batch job over keyed tables.
Exports must land under new file names: a rewritten file under a name the
stream has already seen is not picked up again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import label as L
from parlance.operators.select import index_rows, state_rows
from parlance.plans.ingest import ingest_raw
from parlance.plans.materialize import materialize
from parlance.sources.export import RAW_SCHEMA
from parlance.sources.tables import TableStore


def ingest_stream(spark: SparkSession, source_dir: str, store: TableStore, checkpoint: str,
                  glob: str = "*.json", min_messages: int = 4, files_per_batch: int | None = None) -> None:
    """New export files -> headers, messages and parsed-index upserts.
    Within a batch W2 picks the winner; across batches the later arrival
    wins (as a later run does in the reference). A file that is not valid
    fails the run, and is read again by the next one."""
    reader = spark.readStream.schema(RAW_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.json(source_dir).select("*", F.col("_metadata.file_name").alias("file"))

    def apply(batch: DataFrame, epoch_id: int) -> None:
        raw = batch.withColumn("file_pos", F.monotonically_increasing_id())
        headers, msgs = ingest_raw(raw)
        # The tables that batch runs read and write, too (Workspace).
        store.keyed("messages").upsert(msgs)
        store.keyed("headers").upsert(headers.drop("file"))
        rows = index_rows(headers.where(F.col("message_count") >= min_messages))
        store.upsert("parsed_index", rows, "id")

    q = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
         .foreachBatch(apply).start())
    q.awaitTermination()


def label_stream(spark: SparkSession, source_dir: str, schema: str, msgs: DataFrame, cats: DataFrame,
                 store: TableStore, checkpoint: str,
                 model: Callable | None = None, responses_for: Callable | None = None) -> None:
    """New header rows -> skip done (P14 without a model, P13 with one)
    -> keyword labels (J7) or the model step (M1, X1, M2) -> state upsert.
    Failed model rows are not stored, so the next run retries them."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def apply(batch: DataFrame, epoch_id: int) -> None:
        state = store.read("state")
        done = (L.model_done(state) if model is not None or responses_for is not None else state) if state is not None else None
        # Which of this batch are done: its few ids are the small side, the state is not shuffled.
        work = batch if done is None else L.worklist(batch, done.select("conv_id").join(batch.select("conv_id"), "conv_id", "left_semi"))
        if model is None and responses_for is None:
            labels = L.keyword_label(work, msgs, cats)
            labelled = work.join(labels, "conv_id")
            rows = state_rows(labelled.select(*work.columns, "categories",
                                              F.array().cast("array<string>").alias("tags"), F.lit("").alias("summary"),
                                              F.array().cast("array<string>").alias("key_facts"), "relevance_score"))
        else:
            from parlance.operators.generate import generate
            prompts = L.label_prompts(work, msgs, cats)
            # Stored before they are used: the model is asked once per prompt.
            responses = materialize(responses_for(prompts) if responses_for is not None else generate(prompts, model), "stream-responses")
            parsed = L.apply_label_responses(prompts, responses, cats).where("status = 'ok'").drop("status")
            rows = state_rows(work.join(parsed, "conv_id"))
        store.upsert("state", rows, "conv_id")

    q = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
         .foreachBatch(apply).start())
    q.awaitTermination()

