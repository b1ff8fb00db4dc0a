"""Guards on paths, and fetching where there is a network."""

from __future__ import annotations

import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FETCH_SCHEMA = "source_link string, status_code int, body binary, error_type string, error_message string"


def inside(folder: str, path: str) -> str:
    """The real path of a file in a folder; an error if it lies outside."""
    root, real = os.path.realpath(folder), os.path.realpath(os.path.join(folder, path))
    if os.path.commonpath([root, real]) != root:
        raise ValueError(f"{path} is not inside {folder}")
    return real


def _open(url: str, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, headers={"User-Agent": "tidewarden"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.status, answer.read()


def fetch(
    manifest: DataFrame,
    parallel: int = 4,
    timeout: float = 20.0,
    delay: float = 0.2,
    opener: Callable[[str, float], tuple[int, bytes]] = _open,
) -> DataFrame:
    """Bodies of a manifest's links, ``parallel`` at a time with a pause after each; a link
    that fails is a row with its error."""
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    schema = pa.schema(list(zip((f.split()[0] for f in FETCH_SCHEMA.split(", ")), kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("source_link").to_pylist():
                try:
                    status, body = opener(url, timeout)
                    row = {"source_link": url, "status_code": status, "body": body}
                except Exception as problem:  # a link's failure is its own
                    row = {"source_link": url, "error_type": type(problem).__name__, "error_message": str(problem)}
                yield pa.RecordBatch.from_pylist([row], schema)
                time.sleep(delay)

    return manifest.select("source_link").repartition(parallel).mapInArrow(run, FETCH_SCHEMA)
