"""A store of runs whose writes are whole or not there: ``df.write.format("runstore").option("path", ...).option("run", ...)``.

Tasks write files of their own; only when all have ended does the driver's
commit write the run's manifest, which names them. Readers go by manifests, so
files of failed tasks, of second attempts and of runs that were given up are
never seen. A run that has a manifest is not written again: what a rerun has
written is deleted, and the first one stays. The folder may be on any file
system that Arrow knows; it must be shared by all executors.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFESTS, DATA = "_runs", "data"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class RunWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str, schema: StructType):
        self.path, self.run, self.try_ = path, run, uuid.uuid4().hex
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        context = TaskContext.get()
        file = posixpath.join(DATA, f"{self.try_}-{context.partitionId():06d}-{context.taskAttemptId()}.parquet")
        system.create_dir(posixpath.join(root, DATA))
        rows = 0
        with pq.ParquetWriter(posixpath.join(root, file), self.schema, filesystem=system) as out:
            for batch in iterator:
                out.write_batch(batch.cast(self.schema))
                rows += batch.num_rows
        return Written(file, rows)

    def _delete(self, messages) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(posixpath.join(root, m.file))

    def commit(self, messages) -> None:
        system, root = opened(self.path)
        at = posixpath.join(root, MANIFESTS, f"{uuid.uuid5(uuid.NAMESPACE_URL, self.run).hex}.json")
        if system.get_file_info(at).type != fs.FileType.NotFound:
            return self._delete(messages)
        system.create_dir(posixpath.join(root, MANIFESTS))
        new = posixpath.join(root, f".{self.try_}.json")
        with system.open_output_stream(new) as out:
            out.write(json.dumps({"run": self.run, "files": [m.file for m in messages], "rows": sum(m.rows for m in messages)}).encode())
        system.move(new, at)  # the one step that makes the run visible

    def abort(self, messages) -> None:
        self._delete(messages)


class RunStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runstore"

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        if overwrite:
            raise ValueError("runs are only added")
        return RunWriter(self.options["path"], self.options["run"], schema)


def append(df: DataFrame, path: str, run: str) -> None:
    """Write ``df`` as the run ``run``, whole or not at all; a run that is there stays as it is."""
    df.sparkSession.dataSource.register(RunStore)
    df.write.format("runstore").mode("append").option("path", path).option("run", run).save()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, files, rows) of the runs that were committed."""
    system, root = opened(path)
    if system.get_file_info(posixpath.join(root, MANIFESTS)).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "run string, files array<string>, rows long")
    return spark.read.schema("run string, files array<string>, rows long").json(posixpath.join(path, MANIFESTS))


def read(spark: SparkSession, path: str, run: str | None = None) -> DataFrame | None:
    """The rows of all committed runs, or of one; None where there is none. The files' names, as many as tasks wrote, are listed on the driver, as Spark lists any folder."""
    found = runs(spark, path)
    files = [f for r in (found if run is None else found.where(found["run"] == run)).collect() for f in r.files]
    return spark.read.parquet(*[posixpath.join(path, f) for f in files]) if files else None
