"""Enrichment of reports by an injected extractor, errors kept as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import keys, text
from tidewarden.operators import incremental

Extractor = Callable[[dict], dict]


def prompt(record: DataFrame, instructions: str, columns: Sequence[str]) -> Column:
    """Prompt text: instructions, then the record as JSON."""
    return F.concat(F.lit(instructions.strip() + "\n\n"), text.json_text(F.struct(*sorted(columns))))


def parse_answer(answer: Column) -> Column:
    """JSON text of an answer that may be fenced; null if it is not an object."""
    plain = text.unfence(answer)
    return F.when(F.try_parse_json(plain).isNotNull() & F.startswith(plain, F.lit("{")), plain)


def enrich(
    reports: DataFrame,
    extractor: Extractor,
    fields: Sequence[T.StructField],
    parallel: int = 20,
    key: str = "report_id",
) -> DataFrame:
    """Reports with the extractor's whitelisted fields and ``_error``.

    An extractor is any callable; one that raises, or answers with anything but an object,
    leaves the record as it was and its message in ``_error``. ``parallel`` bounds how many run
    at once. Of records with one key the first in order of their JSON is asked about, once, and
    its answer goes to all of them; null is a key, too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for record in batch["__record"]:
                try:
                    answer = extractor(json.loads(record))
                    if not isinstance(answer, dict):
                        raise TypeError("extractor must return a JSON object")
                    answers.append(json.dumps(answer, default=str))
                    errors.append(None)
                except Exception as problem:  # a record's failure is its own
                    answers.append("{}")
                    errors.append(f"extraction: {type(problem).__name__}: {problem}")
            yield pd.DataFrame({"__key": batch["__key"], "__answer": answers, "_error": errors})

    record = text.json_text(F.struct(*reports.columns))
    sent = reports.groupBy(F.col(key).alias("__key")).agg(F.min(record).alias("__record"))
    kind = reports.schema[key].dataType.simpleString()
    answered = sent.repartition(parallel).mapInPandas(run, f"__key {kind}, __answer string, _error string")
    joined = reports.drop("_error").join(answered, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    return incremental.overlay(joined, "__answer", fields)


def fingerprints(reports: DataFrame, model: str, prompt_hash: str) -> DataFrame:
    """Reports with the fingerprint of all that their enrichment depends on."""
    record = text.json_text(F.struct(*sorted(reports.columns)))
    return reports.withColumn(
        "fingerprint",
        keys.fingerprint(record=record, model=F.lit(model), prompt=F.lit(prompt_hash)),
    )


def pending(reports: DataFrame, state: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, pending); records whose output has an error are pending again."""
    good = outputs.where("_error is null")
    return incremental.split_current(reports, state, good, "enrich", "report_id")


def error_count(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count("_error").alias("n_errors"), F.count("*").alias("n_rows"))
