"""Readers of the JSON documents. All take explicit schemas; a broken file costs that file and no other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonmill import schema
from reasonmill.operators.corpus import with_identity
from reasonmill.schema import as_column

CORRUPT = "_corrupt_record"


def _with_file(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def read_json(spark: SparkSession, path: str | Sequence[str], ddl: str) -> DataFrame:
    """One document per file (or an array of rows); unreadable ones keep their text in ``_corrupt_record``."""
    reader = spark.read.schema(f"{ddl}, {CORRUPT} string").options(
        multiLine=True, pathGlobFilter="*.json", columnNameOfCorruptRecord=CORRUPT
    )
    return _with_file(reader.json(path if isinstance(path, str) else list(path)))


def _touch_data(documents: DataFrame) -> Column:
    """Always true, but reads a data column: Spark refuses to scan for the corrupt record column alone."""
    first = F.col(f"`{documents.columns[0]}`")
    return first.isNull() | (F.length(F.to_json(F.struct(first))) >= 0)


def readable(documents: DataFrame) -> DataFrame:
    return documents.where(F.col(CORRUPT).isNull() & _touch_data(documents)).drop(CORRUPT)


def broken_files(documents: DataFrame) -> DataFrame:
    broken = documents.where(F.col(CORRUPT).isNotNull() & _touch_data(documents))
    return broken.select("file_name", "file_path")


def attribution_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Attribution documents with the split and sample id of their file names; ``has_id`` tells usable names."""
    return with_identity(read_json(spark, path, schema.ATTRIBUTION_DOC))


def latest_per_sample(documents: DataFrame) -> DataFrame:
    """Attribution index: one document per sample number, whatever its split; the last file name wins."""
    digits = F.regexp_extract("file_name", r"(?i)_s(\p{Nd}+)\.json\z", 1)
    indexed = documents.where(digits != "").select(
        F.regexp_replace(digits, r"\A0+(?=\p{Nd})", "").alias("sample_id"),
        "file_name",
        "high_attribution_regions",
    )
    return (
        indexed.groupBy("sample_id")
        .agg(F.max_by("high_attribution_regions", "file_name").alias("high_attribution_regions"))
    )


def _last_number(name: Column | str) -> Column:
    stem = F.regexp_replace(as_column(name), r"(?<=.)\.[^.]*\z", "")
    numbers = F.regexp_extract_all(stem, F.lit(r"\p{Nd}+"), F.lit(0))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit("0"))


def numeric_key(name: Column | str) -> Column:
    """Last number in the stem of a file name, 0 without one; NULL beyond 38 digits."""
    return _last_number(name).try_cast("decimal(38,0)")


def numeric_order(name: Column | str) -> Column:
    """Sorts file names by their last number, which may have any length."""
    digits = F.regexp_replace(_last_number(name), "^0+", "")
    return F.struct(F.length(digits).alias("length"), digits.alias("digits"))


def reference_texts(
    spark: SparkSession, path: str | Sequence[str], text_key: str = "overall_reasoning"
) -> DataFrame:
    """``(sample_id, reference)``: documents in numeric file order, the last non-empty text of an id wins."""
    ddl = f"sample_idx string, sample_id string, `{text_key}` string"
    documents = readable(read_json(spark, path, ddl))
    return latest_reference(
        documents.select(
            F.coalesce("sample_idx", "sample_id", F.lit("")).alias("sample_id"),
            F.col(f"`{text_key}`").alias("reference"),
            "file_name",
        )
    )


def latest_reference(texts: DataFrame) -> DataFrame:
    usable = texts.where("sample_id <> '' and reference <> ''")
    return usable.groupBy("sample_id").agg(
        F.max_by("reference", F.struct(numeric_order("file_name"), F.col("file_name"))).alias("reference")
    )


def with_references(samples: DataFrame, references: DataFrame) -> DataFrame:
    """Every sample, with its reference text or an empty one."""
    return samples.join(references, "sample_id", "left").withColumn(
        "ground_truth_reasoning", F.coalesce("reference", F.lit(""))
    ).drop("reference")


def sensor_embeddings(
    spark: SparkSession, path: str, label_key: str = "activity", text_key: str = "overall_reasoning",
    limit: int | None = None,
) -> DataFrame:
    """Embedding, label, text and id of every document, in numeric file order when limited."""
    ddl = f"sample_idx string, sample_id string, embedding array<float>, `{label_key}` string, `{text_key}` string"
    rows = readable(read_json(spark, path, ddl)).select(
        F.coalesce("sample_idx", "sample_id").alias("sample_id"),
        "embedding",
        F.col(f"`{label_key}`").alias("gt_activity"),
        F.coalesce(F.col(f"`{text_key}`"), F.lit("")).alias("ground_truth_reasoning"),
        "file_name",
    )
    return first_rows(rows, limit, numeric_order("file_name"), "file_name")


def embedding_widths(rows: DataFrame) -> DataFrame:
    """Rows per embedding width: a sound table has one width."""
    return rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))


def samples_from(
    spark: SparkSession, embedding_dir: str | None, reasoning_dir: str, limit: int | None = None
) -> DataFrame:
    """Samples of the embedding folder joined to the references if that folder exists, else the reasoning folder."""
    if embedding_dir and path_exists(spark, embedding_dir):
        samples = sensor_embeddings(spark, embedding_dir, limit=limit).drop("ground_truth_reasoning")
        return with_references(samples, reference_texts(spark, reasoning_dir))
    return sensor_embeddings(spark, reasoning_dir, label_key="predicted_activity", limit=limit)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_rows(rows: DataFrame, limit: int | None, *order: str | Column) -> DataFrame:
    """The first ``limit`` rows in order; all of them for no limit or one below 1."""
    return rows if limit is None or limit <= 0 else rows.orderBy(*order).limit(limit)


def inference_results(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of inference results, without the files' names; files of any other shape than an array give none."""
    files = evaluation_files(spark, path).where("shape = 'array'")
    large = _large_rows(spark, path).where("per_sample is null")
    return _file_rows(files).select(*_FIELDS).unionByName(large.select(*_FIELDS))


#: Files up to this size are read as variants; a variant has an upper limit of its own.
VARIANT_BYTES = 64 << 20
NOT_JSON, NO_ROWS = "not JSON", "neither an array of rows nor an object with them"
_FIELDS = [f.split(" ")[0] for f in schema.EVAL_ROWS.split(", ")]


def evaluation_files(
    spark: SparkSession, path: str | Sequence[str], glob: str = "*.json", limit: int = VARIANT_BYTES
) -> DataFrame:
    """One row per file of at most ``limit`` bytes: ``(source_file, shape, reason, run, n_runs, config, samples)``.

    Every file is read once, as a variant, whatever it holds. ``shape`` is ``array`` or ``object`` (rows under
    ``per_sample``); other files have no shape but a reason; Spark skips
    files without a byte. ``samples`` are the rows, still as variants.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = files.load(path if isinstance(path, str) else list(path)).where(F.col("length") <= limit)
    read = files.select("path", F.try_parse_json(F.col("content").cast("string")).alias("v"))
    rows = lambda at: F.try_variant_get("v", at, "array<variant>")
    told = read.select("path", "v", rows("$").alias("whole"), rows("$.per_sample").alias("inner"))
    shape = F.when(F.col("whole").isNotNull(), "array").when(F.col("inner").isNotNull(), "object")
    return told.select(
        F.col("path").alias("source_file"),
        shape.alias("shape"),
        F.when(F.col("v").isNull(), NOT_JSON).when(shape.isNull(), NO_ROWS).alias("reason"),
        F.try_variant_get("v", "$.run", "int").alias("run"),
        F.try_variant_get("v", "$.n_runs", "int").alias("n_runs"),
        F.try_variant_get("v", "$.config", "map<string,string>").alias("config"),
        F.coalesce("whole", "inner").alias("samples"),
    )


def _is_row(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def file_report(files: DataFrame) -> DataFrame:
    """What each file is, how many rows it has, and how many of its entries are no rows."""
    bad = F.size(F.filter("samples", lambda v: ~_is_row(v)))
    return files.select(
        "source_file", "shape", "reason", "run", "n_runs", "config",
        (F.coalesce(F.size("samples"), F.lit(0)) - F.coalesce(bad, F.lit(0))).alias("n_rows"),
        F.coalesce(bad, F.lit(0)).alias("n_bad"),
    )


def _file_rows(files: DataFrame) -> DataFrame:
    """``(source_file, pos, fields…)``: the position is the place in the file, counted over all its entries."""
    rows = files.select("source_file", F.posexplode("samples").alias("pos", "v")).where(_is_row(F.col("v")))
    typed = [f.split(" ") for f in schema.EVAL_ROWS.split(", ")]
    fields = [F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in typed]
    return rows.select("source_file", F.col("pos").cast("bigint").alias("pos"), *fields)


def evaluation_rows(
    spark: SparkSession, files: Mapping[str, str] | Sequence[tuple[str, str]], glob: str = "*.json",
    limit: int = VARIANT_BYTES,
) -> DataFrame:
    """Evaluation files of one or several datasets, tagged with dataset and file.

    A file holds an array of rows, or an object with them under ``per_sample``; files of another shape give no rows, and
    ``file_report`` says why. A row without sample id is known by its position. Files beyond ``limit`` bytes are streamed.
    """
    by_dataset: dict[str, list[str]] = {}
    for dataset, path in files.items() if isinstance(files, Mapping) else files:
        by_dataset.setdefault(dataset, []).append(path)
    tagged = []
    for dataset, paths in by_dataset.items():
        small = _file_rows(evaluation_files(spark, paths, glob, limit))
        rows = small.unionByName(_streamed_rows(spark, paths, glob, limit))
        tagged.append(rows.select(F.lit(dataset).alias("dataset"), "*"))
    return reduce(DataFrame.unionByName, tagged).withColumn(
        "sample_id", F.coalesce("sample_id", F.col("pos").cast("string"))
    )


def _large_rows(
    spark: SparkSession, path: str | Sequence[str], glob: str = "*.json", limit: int = VARIANT_BYTES
) -> DataFrame:
    """Rows of the files beyond the limit by the streaming reader; Spark skips the other files by their size."""
    ddl = f"{schema.EVAL_ROWS}, config map<string,string>, per_sample array<{schema.EVAL_ROW}>, {CORRUPT} string"
    reader = spark.read.schema(ddl).options(multiLine=True, pathGlobFilter=glob, columnNameOfCorruptRecord=CORRUPT)
    raw = reader.json(path if isinstance(path, str) else list(path)).where(F.col("_metadata.file_size") > limit)
    return readable(_with_file(raw))


def _streamed_rows(spark: SparkSession, paths: list[str], glob: str, limit: int) -> DataFrame:
    # A multi-line file is read by one task in order, so the running id counts its rows.
    rows = _large_rows(spark, paths, glob, limit).withColumn("_n", F.monotonically_increasing_id())
    firsts = rows.groupBy("file_path").agg(F.min("_n").alias("_first"))
    exploded = rows.join(firsts, "file_path").select(
        F.col("file_path").alias("source_file"),
        (F.col("_n") - F.col("_first")).alias("_row_pos"),
        F.posexplode(F.coalesce("per_sample", F.array(F.struct(*_FIELDS)))).alias("_pos", "_row"),
    )
    return exploded.select("source_file", (F.col("_row_pos") + F.col("_pos")).alias("pos"), "_row.*")


def pair_datasets(datasets: Sequence[str], paths: Sequence[str]) -> list[tuple[str, str]]:
    """One dataset for all files, or one per file."""
    if len(datasets) not in (1, len(paths)):
        raise ValueError("give one dataset, or as many as files")
    names = list(datasets) * len(paths) if len(datasets) == 1 else list(datasets)
    return list(zip(names, paths, strict=True))


def training_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON lines of a corpus; broken lines are dropped."""
    return spark.read.schema(schema.TRAINING_EXAMPLE).option("mode", "DROPMALFORMED").json(path)


def newest_run(files: DataFrame, prefix: str) -> DataFrame:
    """The complete run file with the greatest name, as at most one row of ``file_name``."""
    named = files.where(
        F.col("file_name").startswith(prefix)
        & F.col("file_name").endswith(".json")
        & ~F.col("file_name").contains("_partial")
    )
    return named.agg(F.max("file_name").alias("file_name")).where("file_name is not null")


def list_files(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Names and sizes of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.col("length").alias("file_size")
    )



def merged_shards(shards: Sequence[DataFrame], index: str = "index") -> DataFrame:
    """Results of several shards in the order of their original index; missing ones simply do not appear."""
    return reduce(DataFrame.unionByName, shards).orderBy(index)
