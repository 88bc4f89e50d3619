"""Run folders as a Spark data source, read and written by tasks.

A folder is named after its run; ``results.json`` in it is an array of result rows and there once the run has ended. The root is listed
once; what is in the folders is read by tasks of ``runs_a_task`` folders each, so no call for a folder is made by the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "gradeflow_runs"
# The name of a run's folder and of its results.
RUN_NAME = re.compile(r"^real_([^_]+)_(gsm8k|math)_traces_seed(\d+)_(\d{8}_\d{6})$")
RESULTS = "results.json"
SCHEMA = "run string, provider string, dataset string, seed int, timestamp string, has_results boolean, results array<struct<source: string, mode: string, beta_s: double, accuracy: double>>"
FIELDS = ("source", "mode", "beta_s", "accuracy")


def _store(path: str):
    """File system and path, of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path.rstrip("/")))


class _Runs(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        listed = lambda key: [x.strip() for x in options.get(key, "").split(",") if x.strip()]
        self._root, self._at_once = options["path"], int(options.get("runs_a_task", "500"))
        self._wanted = (listed("providers"), listed("datasets"), [str(int(s)) for s in listed("seeds")])

    def _asked_for(self, name: str) -> bool:
        found = RUN_NAME.match(name)
        return bool(found) and all(not wanted or part in wanted for wanted, part in zip(self._wanted, (found[1], found[2], str(int(found[3])))))

    def partitions(self) -> list[InputPartition]:
        """Names of one listing of the root; none if it is missing."""
        from pyarrow import fs

        store, root = _store(self._root)
        entries = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(e.base_name for e in entries if e.type == fs.FileType.Directory and self._asked_for(e.base_name))
        return [_Runs(names[k : k + self._at_once]) for k in range(0, len(names), self._at_once)] or [_Runs([])]

    def read(self, partition: _Runs) -> Iterator[tuple]:
        """Rows of some folders; a file that isn't an array of objects is a ValueError that names it."""
        store, root = _store(self._root)
        number = lambda x: None if x is None else float(x)
        for name in partition.names:
            _, provider, dataset, seed, stamp = RUN_NAME.match(name).group(0, 1, 2, 3, 4)
            try:
                with store.open_input_stream(f"{root}/{name}/{RESULTS}") as file:
                    text = file.read()
            except FileNotFoundError:
                yield name, provider, dataset, int(seed), stamp, False, None
                continue
            try:
                rows = [(r.get("source"), r.get("mode"), number(r.get("beta_s")), number(r.get("accuracy"))) for r in json.loads(text)]
            except (ValueError, TypeError, AttributeError) as wrong:
                raise ValueError(f"{root}/{name}/{RESULTS}: {wrong}") from wrong
            yield name, provider, dataset, int(seed), stamp, True, rows


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str]) -> None:
        self._root, self._run, self._results = path, names.index("run"), names.index("results")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """A folder for each row, with results unless they are null; a task that runs again writes the same files anew."""
        store, root = _store(self._root)
        for row in iterator:
            store.create_dir(f"{root}/{row[self._run]}", recursive=True)
            if row[self._results] is not None:
                with store.open_output_stream(f"{root}/{row[self._run]}/{RESULTS}") as file:
                    file.write(json.dumps([dict(zip(FIELDS, r)) for r in row[self._results]]).encode())
        return WriterCommitMessage()


class RunFolders(DataSource):
    """Options: path; providers, datasets, seeds: comma lists of what to read, all if empty; runs_a_task."""

    @classmethod
    def name(cls) -> str:
        """Name for ``spark.read.format``."""
        return NAME

    def schema(self) -> str:
        """Of a read."""
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        """Partitioned by folders."""
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        """Adds runs; to replace a root isn't supported."""
        if overwrite:
            raise ValueError("runs are only added")
        return _Writer(self.options["path"], schema.names)


def read_runs(spark: SparkSession, root: str, providers: list[str] = (), datasets: list[str] = (), seeds: list[int] = (), runs_a_task: int = 500) -> DataFrame:
    """A row for each run folder under ``root`` (see ``SCHEMA``); other folders are passed over."""
    spark.dataSource.register(RunFolders)
    options = {"providers": ",".join(providers), "datasets": ",".join(datasets), "seeds": ",".join(map(str, seeds)), "runs_a_task": str(runs_a_task)}
    return spark.read.format(NAME).options(**options).load(root)


def write_runs(df: DataFrame, root: str) -> None:
    """Folders of (run, results), one row a run; null results make a run that hasn't ended."""
    df.sparkSession.dataSource.register(RunFolders)
    df.select("run", "results").write.format(NAME).mode("append").save(root)
