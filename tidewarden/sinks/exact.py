"""Files in their exact form, through a Python data source that writes.

    df.write.format("exact_files").mode("overwrite").option("path", p).option("form", "jsonl").save()

Each task streams its rows into a file of its own under ``_staging-<job>``. When all are done,
the driver moves the files into place by renaming, in the order of partitions, and writes
``_summary.json`` with their names and counts; a job that fails takes its staged files away. So a
reader sees all of a job or none of it, tasks that ran twice leave nothing, and no row passes
through the driver.

Forms: ``jsonl``, one object a line with its fields in alphabetical order, nulls kept, any
character as itself and dates in ISO form; ``csv``, a header in each file and cells as ``cell``
gives them, quoted where they need it, lines ending in CR LF; ``lines``, the one text column
under the option ``head``, which each file begins with.

One file (``single``) is allowed for what is small: the driver joins files up to SINGLE_BYTES by
appending them in order, the header once, and refuses more. ``mode`` is append or overwrite.
"""

from __future__ import annotations

import csv
import datetime as dt
import decimal
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are joined into one file, at most.
SINGLE_BYTES = 256 << 20
ENDINGS = {"jsonl": "jsonl", "csv": "csv", "lines": "txt"}


def plain(value: object) -> object:
    """A value as JSON has it."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value


def json_of(value: object) -> str:
    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True)


def cell(value: object) -> str:
    """A CSV cell: null is blank, booleans in lower case, lists and objects as JSON."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple, dict)):
        return json_of(value)
    value = plain(value)
    return value if isinstance(value, str) else str(value)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class ExactFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exact_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ExactWriter(dict(self.options), schema.names, overwrite)


class ExactWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.form = options["path"].rstrip("/"), options.get("form", "jsonl")
        if self.form not in ENDINGS:
            raise ValueError(f"no form {self.form!r}: {sorted(ENDINGS)}")
        self.head, self.single = options.get("head", ""), options.get("single", "false").lower() == "true"
        wanted = options.get("columns")
        self.columns = json.loads(wanted) if wanted else names
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _files(self) -> tuple[pafs.FileSystem, str]:
        path = self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}"
        return pafs.FileSystem.from_uri(path)

    def _header(self) -> bytes:
        if self.form == "csv":
            return self._csv([self.columns])
        return f"{self.head}\n".encode() if self.head else b""

    @staticmethod
    def _csv(rows: list[list[str]]) -> bytes:
        out = io.StringIO()
        csv.writer(out).writerows(rows)
        return out.getvalue().encode()

    def _body(self, batch: pa.RecordBatch) -> bytes:
        if self.form == "jsonl":
            return "".join(json_of(row) + "\n" for row in batch.to_pylist(maps_as_pydicts="strict")).encode()
        if self.form == "csv":
            return self._csv([[cell(row.get(c)) for c in self.columns] for row in batch.to_pylist(maps_as_pydicts="strict")])
        return "".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, inner = self._files()
        part = TaskContext.get().partitionId()
        name = f"{part:08d}-{uuid.uuid4().hex}"
        staging = f"{inner}/_staging-{self.job}"
        files.create_dir(staging, recursive=True)
        rows = 0
        with files.open_output_stream(f"{staging}/{name}") as out:
            out.write(self._header())
            for batch in batches:
                out.write(self._body(batch))
                rows += batch.num_rows
        return Written(part, name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, inner = self._files()
        made = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        full = [m for m in made if m.rows] or made[:1]
        before = self._summary(files, inner)
        names: list[str] = [] if self.overwrite else list(before["files"])
        staging = f"{inner}/_staging-{self.job}"
        files.create_dir(staging, recursive=True)
        placed = []
        if self.single:
            name = f"all-{self.job}.{ENDINGS[self.form]}"
            self._join(files, [f"{inner}/{x}" for x in names] + [f"{staging}/{m.name}" for m in full], f"{staging}/single")
            files.move(f"{staging}/single", f"{inner}/{name}")
            gone, placed = names, [name]
            names = []
        else:
            gone = [] if not self.overwrite else list(before["files"])
            for i, m in enumerate(full):
                name = f"part-{self.job}-{i:08d}.{ENDINGS[self.form]}"
                files.move(f"{staging}/{m.name}", f"{inner}/{name}")
                placed.append(name)
        if self.overwrite:
            gone = list(before["files"])
        rows = sum(m.rows for m in made) + (0 if self.overwrite else before["rows"])
        summary = {"files": names + placed, "rows": rows, "rows_of_job": sum(m.rows for m in made)}
        with files.open_output_stream(f"{staging}/summary") as out:
            out.write(json.dumps(summary).encode())
        files.move(f"{staging}/summary", f"{inner}/_summary.json")  # from here on it counts
        files.delete_dir(staging)
        for name in set(gone) - set(summary["files"]):
            files.delete_file(f"{inner}/{name}")

    @staticmethod
    def _summary(files: pafs.FileSystem, inner: str) -> dict:
        if files.get_file_info(f"{inner}/_summary.json").type == pafs.FileType.NotFound:
            return {"files": [], "rows": 0}
        with files.open_input_stream(f"{inner}/_summary.json") as f:
            return json.loads(f.read())

    def _join(self, files: pafs.FileSystem, paths: list[str], target: str) -> None:
        if sum(files.get_file_info(p).size for p in paths) > SINGLE_BYTES:
            raise ValueError(f"more than {SINGLE_BYTES} bytes for one file")
        header = self._header()
        with files.open_output_stream(target) as out:
            for i, path in enumerate(paths):
                with files.open_input_stream(path) as f:
                    first = f.read(len(header))
                    out.write(first if i == 0 else b"")
                    while data := f.read(1 << 20):
                        out.write(data)

    def abort(self, messages: list[Written | None]) -> None:
        files, inner = self._files()
        staging = f"{inner}/_staging-{self.job}"
        if files.get_file_info(staging).type == pafs.FileType.Directory:
            files.delete_dir(staging)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExactFiles)


def summary(path: str) -> dict:
    """Files and counts of the last whole job: {files, rows, rows_of_job}."""
    path = path if "://" in path or path.startswith("/") else f"file://{path}"
    return ExactWriter._summary(*pafs.FileSystem.from_uri(path.rstrip("/")))
