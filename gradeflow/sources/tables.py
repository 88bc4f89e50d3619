"""Sources: a registry of problem sets, JSON in several shapes, run directories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import union_all
from .scratch import store

PROBLEM = T.StructType([T.StructField(c, T.StringType()) for c in ("example_id", "problem", "solution", "type")])
RESULT = T.StructType([T.StructField("source", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("beta_s", T.DoubleType()), T.StructField("accuracy", T.DoubleType())])
TRAIN_INFO = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source", "mode", "student")] + [T.StructField(c, T.DoubleType()) for c in ("beta_s", "train_time_s", "accuracy", "lr")]
    + [T.StructField(c, T.LongType()) for c in ("n_train", "n_holdout", "seed", "num_epochs", "per_device_train_batch_size", "gradient_accumulation_steps", "lora_r")]
    + [T.StructField("stats", T.StructType([T.StructField(c, T.DoubleType()) for c in ("mean_a", "std_a", "frac_mass_top20")]))]
)
TRACE = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "subject", "trace", "reference_answer", "gold_answer", "predicted_answer")] + [T.StructField("correct", T.BooleanType())])
SCORE = T.StructType([T.StructField("example_id", T.StringType()), T.StructField("method", T.StringType()), T.StructField("trace", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("feedback", T.StringType())])

_LOADERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, loader: Callable[..., DataFrame]) -> None:
    """Makes a problem set known: loader(spark, paths) -> (problem, solution, ...)."""
    _LOADERS[name] = loader


def load_problems(spark: SparkSession, name: str, **splits: str | list[str]) -> DataFrame:
    """(split, problem, solution, type, subset_ord) of a known problem set; unknown names are a ValueError.

    splits: name=path, each split from a place of its own; or name=[paths], subsets one after the other.
    """
    if name not in _LOADERS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(_LOADERS))}")
    out = None
    for split, paths in splits.items():
        rows = subsets([_LOADERS[name](spark, p) for p in ([paths] if isinstance(paths, str) else paths)]).withColumn("split", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    return out.select("split", "problem", "solution", "type", "subset_ord")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Names a rewritten folder's current version.
POINTER = "_current"


def current(spark: SparkSession, path: str) -> str:
    """Where the rows of a folder are: in the version that its pointer names, or in the folder itself."""
    pointer = f"{path.rstrip('/')}/{POINTER}"
    if not exists(spark, pointer):
        return path
    fs, at = store(spark, pointer)
    file = fs.open(at)
    try:
        return f"{path.rstrip('/')}/{bytes(file.readAllBytes()).decode()}"
    finally:
        file.close()


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(current(spark, path))


def quarantined(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): every line that isn't blank is in one of the two. Bad lines, (file, line), aren't objects of the schema."""
    bad = "_not_an_object"
    lines = spark.read.text(current(spark, path)).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    fields = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = lines.withColumn("row", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    wrong = F.col("row").isNull() | F.col(f"row.{bad}").isNotNull()
    return parsed.filter(~wrong).select("row.*").drop(bad), parsed.filter(wrong).select("file", F.col("value").alias("line"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark can reach."""
    fs, at = store(spark, path)
    return fs.exists(at)


def done_keys(spark: SparkSession, path: str, key: str = "question") -> DataFrame:
    """Keys in a JSON-lines file; none if it is missing. Bad lines and lines without the key are passed over."""
    schema = T.StructType([T.StructField(key, T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(current(spark, path)).filter(F.col(key).isNotNull()).distinct()


def read_traces(spark: SparkSession, stem: str, schema: T.StructType = TRACE) -> DataFrame:
    """``stem``.jsonl, or else ``stem``.json."""
    if exists(spark, f"{stem}.jsonl"):
        return read_json_lines(spark, f"{stem}.jsonl", schema)
    if exists(spark, f"{stem}.json"):
        return read_json_array(spark, f"{stem}.json", schema)
    raise FileNotFoundError(f"neither {stem}.jsonl nor {stem}.json")


def with_alias(df: DataFrame, name: str, alias: str) -> DataFrame:
    """``name``, from ``alias`` where the column is absent."""
    return df if name in df.columns else df.withColumnRenamed(alias, name)


def read_run_results(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all ``root``/*/results.json with the name of their run directory."""
    rows = spark.read.schema(RESULT).option("multiLine", True).json(f"{root.rstrip('/')}/*/results.json")
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_train_info(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all train_info.json under ``root``, at any depth, with the name of the folder each is in; fields that a file lacks are null."""
    rows = spark.read.schema(TRAIN_INFO).option("multiLine", True).option("pathGlobFilter", "train_info.json").option("recursiveFileLookup", True).json(root)
    return rows.withColumn("tag", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, has_results) of every directory under ``root``.

    The driver lists ``root`` once. Results are found by Spark's file index, which lists many directories as a job of its own; no file is opened.
    """
    fs, at = store(spark, root)
    names = [(s.getPath().getName(),) for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
    runs = spark.createDataFrame(names, "run string")
    if not names:
        return runs.withColumn("has_results", F.lit(False))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "results.json").option("recursiveFileLookup", True).load(root)
    place = F.split(F.regexp_replace(F.col("_metadata.file_path"), "/+$", ""), "/")
    # directly in a run's folder: the part before the name is the run, the one before that the root
    done = found.select(F.url_decode(F.replace(F.element_at(place, -2), F.lit("+"), F.lit("%2B"))).alias("run"), F.element_at(place, -3).alias("above")).filter(F.col("above") == at.getName()).select("run").distinct()
    return runs.join(done.withColumn("has_results", F.lit(True)), "run", "left").select("run", F.coalesce("has_results", F.lit(False)).alias("has_results"))


def subsets(frames: list[DataFrame]) -> DataFrame:
    """Problem subsets one after the other, with their order."""
    return union_all(*frames)


def _renamed(*names: tuple[str, str]) -> T.StructType:
    """The fields of a problem as a file names them."""
    return T.StructType([T.StructField(dict(names).get(f.name, f.name), f.dataType) for f in PROBLEM if f.name != "example_id"])


# schemas are declared, so that no file is read to find them
register("question_answer", lambda spark, path: read_json_lines(spark, path, _renamed(("problem", "question"), ("solution", "answer"))).withColumnsRenamed({"question": "problem", "answer": "solution"}))
register("problem_solution", lambda spark, path: read_json_lines(spark, path, _renamed()))
