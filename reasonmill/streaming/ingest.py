"""Incremental ingestion of generated answers into the corpus, exactly once.

Which keys are known is keyed state: it lives in the state store of the checkpoint, one file name per key, so a
micro-batch touches the keys it brings and never rereads what earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reasonmill.operators import corpus
from reasonmill.sources.documents import path_exists

ANSWER_DDL = "activity string, confidence double, mantis_embedding string, answer string"


def read_answers(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """Stream of answer files, one JSON document each, named like the attribution files."""
    raw = (
        spark.readStream.schema(ANSWER_DDL)
        .options(multiLine=True, pathGlobFilter="*.json", maxFilesPerTrigger=max_files)
        .json(folder)
    )
    return corpus.with_identity(raw.select("*", F.col("_metadata.file_name").alias("file_name")))


def to_corpus_rows(answers: DataFrame, model: str) -> DataFrame:
    """Flags and parsed record of each answer; rows without an id in their name are left out."""
    flagged = corpus.quality_flags(answers.where("has_id"))
    flags = ("n_tokens", "leak", "is_empty", "is_short", "refusal", "truncated", "anomaly")
    return flagged.select(
        *corpus.KEY,
        "file_name",
        F.col("activity").alias("predicted_activity"),
        "confidence",
        corpus.clean_answer("answer").alias("overall_reasoning"),
        corpus.corpus_graph("answer").alias("reasoning_graph"),
        F.lit(model).alias("model_used"),
        *flags,
    )


class _FirstOfKey(StatefulProcessor):
    """Lets the first row of a key pass, by file name within a batch, and remembers that it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", "file_name string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self._known.exists():
            return
        first = min(rows, key=lambda r: r.file_name)
        self._known.update((first.file_name,))
        yield first

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        self._known.update((initialState.file_name,))

    def close(self) -> None:
        pass


def first_of_keys(answers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The rows of a stream whose key comes for the first time; ``known`` holds keys to start from, read once."""
    spark = answers.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    start = None if known is None else known.groupBy(*corpus.KEY).agg(F.min("file_name").alias("file_name")).groupBy(*corpus.KEY)
    return answers.groupBy(*corpus.KEY).transformWithState(
        statefulProcessor=_FirstOfKey(), outputStructType=answers.schema, outputMode="Append", timeMode="None",
        initialState=start,
    )


# Keyed state of this kind needs a store that keeps it outside of the executors' heap.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WRITTEN = "split string, sample_id string, file_name string, run string, batch bigint"


def ingest_rows(answers: DataFrame, target: str, checkpoint: str, model: str = "teacher") -> StreamingQuery:
    """Takes in all rows of a stream of answers ``(split, sample_id, has_id, file_name, …)`` that are there, and stops. Run
    it again for what has come since.

    Each micro-batch writes its own ``run`` and ``batch`` folder and replaces it when it is repeated, so a batch that
    failed half-way leaves nothing twice. ``run`` is a number of the checkpoint: another checkpoint is another run and
    never replaces what this one wrote. A key keeps the row that came first; within a batch the first file name of a key
    counts. Keys that other runs wrote before this checkpoint began are its initial state; runs that go on side by side
    do not see each other's keys.
    """
    spark = answers.sparkSession
    begun = path_exists(spark, f"{checkpoint.rstrip('/')}/metadata")
    known = None
    if path_exists(spark, target):
        known = spark.read.schema(_WRITTEN).parquet(target).select(*corpus.KEY, "file_name")
        if begun:  # the state holds them; the plan has to keep its form
            known = known.where(F.lit(False))
    usable = answers.where(F.col("has_id"))
    return (
        first_of_keys(usable, known if known is not None else _nothing(spark))
        .writeStream.foreachBatch(lambda rows, batch: _write_batch(rows, batch, target, checkpoint, model))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "split string, sample_id string, file_name string")


def _write_batch(rows: DataFrame, batch: int, target: str, checkpoint: str, model: str) -> None:
    session = rows.sparkSession
    run = session.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first().id
    folder = f"{target.rstrip('/')}/run={run}/batch={batch}"
    to_corpus_rows(rows, model).write.mode("overwrite").parquet(folder)


def ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, model: str = "teacher", max_files: int = 10_000
) -> StreamingQuery:
    """``ingest_rows`` of a folder of answer files. Files go into batches by their time; a key that several batches bring
    keeps the file of the earliest."""
    return ingest_rows(read_answers(spark, source, max_files), target, checkpoint, model)
