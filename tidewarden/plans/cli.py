"""Command line: the stages of the pipeline over a data folder.

    python -m tidewarden.plans.cli run-all --source news --data-dir data --raw raw.parquet

The folder holds a table for each stage. A stage redoes only records whose fingerprint has
changed, unless ``--force`` is given. Pages come from a table (``--raw``), or ``discover`` reads
links from a sitemap file and ``fetch`` gets those that are new, changed or failed before; a
link that fails is a row of ``fetch_errors``. ``enrich`` asks an extractor (``--extractor
module:name``, a callable from record to answer) for the fields of the prompt's schema; without
one, ``run-all`` leaves it out and exports reports as the rules made them. Exit code 0 is
success, 1 a failed stage or nothing to export; ``run-all`` stops at the first stage that fails.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions import keys
from tidewarden.operators import enrichment, exports, incremental
from tidewarden.plans import config, pipeline
from tidewarden.sinks import files
from tidewarden.sources import documents, guards
from tidewarden.triples import emit
from tidewarden.triples.model import as_set

STAGES = ("discover", "fetch", "parse", "filter-disease", "extract-reports", "enrich", "export-final")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidewarden")
    p.add_argument("command", choices=[*STAGES, "run-all"])
    p.add_argument("--data-dir", default="data")
    p.add_argument("--source", default="news")
    p.add_argument("--raw", help="Parquet table of (source_link, html)")
    p.add_argument("--sitemap", help="sitemap file to discover links in, instead of --raw")
    p.add_argument("--host", default="", help="host of a sitemap's links")
    p.add_argument("--path-prefix", default="/", help="path that a sitemap's links begin with")
    p.add_argument("--timeout-seconds", type=float, default=20.0)
    p.add_argument("--delay-seconds", type=float, default=0.2)
    p.add_argument("--extractor", help="module:name of a callable from record to answer")
    p.add_argument("--prompt", help="file of the prompt, whose schema names the fields")
    p.add_argument("--progress-every", type=int, default=0, help="records of a task between messages")
    p.add_argument("--rdf-output", help="folder of the triples; export/triples by default")
    p.add_argument("--csv-output", help="folder of the reports; export/reports_csv by default")
    p.add_argument("--limit", type=int, default=300, help="0 for no limit")
    p.add_argument("--force", action="store_true")
    return p.parse_args(argv)


class Folder:
    """Tables of a data folder, each version in a path of its own and the latest named."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame | None:
        if not documents.exists(self.spark, f"{self.path}/{name}/LATEST"):
            return None
        latest = self.spark.read.text(f"{self.path}/{name}/LATEST").first()[0]
        return self.spark.read.parquet(f"{self.path}/{name}/{latest}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}/{version}")
        latest = self.spark.createDataFrame([(version,)], "value string")
        latest.coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/LATEST")
        return self.read(name)


def raw_pages(args: argparse.Namespace, folder: Folder) -> DataFrame | None:
    """(source_link, html) of the given table or of what was fetched."""
    if args.raw:
        return folder.spark.read.parquet(args.raw)
    fetched = folder.read("raw")
    return fetched and fetched.select("source_link", "html")


def discover(args: argparse.Namespace, folder: Folder) -> bool:
    if args.raw:
        raw = folder.spark.read.parquet(args.raw)
        found = raw.select("source_link", F.sha2("html", 256).alias("last_modified"))
    elif args.sitemap:
        found = documents.sitemap(folder.spark, args.sitemap, args.host, args.path_prefix)
        found = found.select("source_link", F.col("last_modified").cast("string").alias("last_modified"))
    else:
        return False
    found = found.orderBy("source_link")
    if args.limit:
        found = found.limit(args.limit)
    old = folder.read("manifest")
    folder.write("manifest", found if old is None else incremental.merge_manifest(found, old, []))
    return True


def fetch(args: argparse.Namespace, folder: Folder, opener: Callable | None = None) -> bool:
    """Bodies of the manifest's links that are new, changed or failed before."""
    if args.raw:  # the pages are there
        return True
    manifest, old = folder.read("manifest"), folder.read("raw")
    if manifest is None:
        return False
    todo = manifest.select("source_link", "last_modified")
    if old is not None and not args.force:
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in todo.columns]
        todo = todo.join(old.select(*(F.col(c).alias(f"__{c}") for c in todo.columns)), same[0] & same[1], "left_anti")
    options = {"opener": opener} if opener else {}
    # Written before it is read twice: a second reading would fetch again.
    answers = folder.write("fetched", guards.fetch(todo, timeout=args.timeout_seconds, delay=args.delay_seconds, **options))
    good = answers.where("error_type is null").join(todo, "source_link")
    fresh = good.select(
        "source_link",
        "last_modified",
        "status_code",
        F.decode("body", "utf-8").alias("html"),
        F.sha2("body", 256).alias("content_hash"),
        F.current_timestamp().alias("fetched_at"),
    )
    if old is not None:
        fresh = fresh.unionByName(old.join(good.select("source_link"), "source_link", "left_anti"))
    folder.write("raw", fresh)
    folder.write("fetch_errors", answers.where("error_type is not null").drop("body"))
    return True


def parse(args: argparse.Namespace, folder: Folder) -> bool:
    manifest = folder.read("manifest")
    pages = raw_pages(args, folder) if manifest is not None else None
    if pages is None:
        return False
    raw = pages.join(manifest.select("source_link"), "source_link", "left_semi")
    records = raw.select(
        F.lit(args.source).alias("source"),
        F.col("source_link").alias("record_key"),
        keys.fingerprint(link=F.col("source_link"), hash=F.sha2("html", 256)).alias("fingerprint"),
    )
    state, articles, errors = folder.read("state"), folder.read("articles"), folder.read("parse_errors")
    pending, reused = records, None
    if state is not None and articles is not None and not args.force:
        outputs = articles.select(F.col("source_link").alias("record_key"))
        reused, pending = incremental.split_current(records, state, outputs, "parse")
    todo = raw.join(pending.select(F.col("record_key").alias("source_link")), "source_link", "left_semi")
    fresh, bad = pipeline.parse(todo, args.source)
    if reused is not None:
        keep = articles.join(reused.select(F.col("record_key").alias("source_link")), "source_link", "left_semi")
        fresh = fresh.unionByName(keep)
        bad = bad.unionByName(errors.join(todo.select("source_link"), "source_link", "left_anti"))
    folder.write("articles", fresh)
    folder.write("parse_errors", bad)
    new = pending.select(
        "source", F.lit("parse").alias("stage"), "record_key", "fingerprint", F.current_timestamp().alias("processed_at")
    )
    folder.write("state", new if state is None else incremental.upsert_state(state, new))
    return True


def filter_disease(args: argparse.Namespace, folder: Folder) -> bool:
    articles = folder.read("articles")
    if articles is None:
        return False
    folder.write("disease_articles", pipeline.filter_disease(articles))
    return True


def extract_reports(args: argparse.Namespace, folder: Folder) -> bool:
    articles = folder.read("articles")
    if articles is None:
        return False
    folder.write("disease_reports", pipeline.extract(articles))
    return True


class Progress:
    """An extractor that says on its task's error stream how many records it was asked about."""

    def __init__(self, extractor: enrichment.Extractor, every: int):
        self.extractor, self.every, self.n = extractor, every, 0

    def __call__(self, record: dict) -> dict:
        self.n += 1
        if self.n % self.every == 0:
            print(f"enriched {self.n} records", file=sys.stderr)
        return self.extractor(record)


def named_extractor(name: str) -> enrichment.Extractor:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def enrich(args: argparse.Namespace, folder: Folder, extractor: enrichment.Extractor | None = None) -> bool:
    """Reports with the extractor's fields; those are kept whose fingerprint and answer are good."""
    if extractor is None and args.extractor:
        extractor = named_extractor(args.extractor)
    reports = folder.read("disease_reports")
    if extractor is None or reports is None or not args.prompt:
        return False
    prompt = folder.spark.read.text(args.prompt, wholetext=True).first()[0]
    fields = list(config.prompt_schema(prompt))
    for f in fields:
        if f.name not in reports.columns:
            reports = reports.withColumn(f.name, F.lit(None).cast(f.dataType))
    name = args.extractor or type(extractor).__name__
    marked = enrichment.fingerprints(reports, name, hashlib.sha256(prompt.encode()).hexdigest())
    marked = marked.withColumn("source", F.lit(args.source))
    state, old = folder.read("state"), folder.read("enriched")
    todo, reused = marked, None
    if state is not None and old is not None and not args.force:
        reused, todo = enrichment.pending(marked, state, old)
    if args.progress_every > 0:
        extractor = Progress(extractor, args.progress_every)
    fresh = enrichment.enrich(todo.select(*reports.columns), extractor, fields)
    if reused is not None:
        fresh = fresh.unionByName(old.join(reused.select("report_id"), "report_id", "left_semi"), allowMissingColumns=True)
    folder.write("enriched", fresh)
    new = todo.select(
        "source", F.lit("enrich").alias("stage"), F.col("report_id").alias("record_key"), "fingerprint", F.current_timestamp().alias("processed_at")
    )
    folder.write("state", new if state is None else incremental.upsert_state(state, new))
    errors = enrichment.error_count(folder.read("enriched")).first()
    print(f"enriched {errors.n_rows} reports, {errors.n_errors} with errors", file=sys.stderr)
    return True


def export_final(args: argparse.Namespace, folder: Folder) -> bool:
    reports = folder.read("enriched")
    reports = folder.read("disease_reports") if reports is None else reports
    if reports is None or not reports.limit(1).count():
        return False
    files.n_triples(as_set(emit.report_triples(reports)), args.rdf_output or f"{folder.path}/export/triples")
    path = args.csv_output or f"{folder.path}/export/reports_csv"
    files.csv(reports, path, list(exports.REPORT_COLUMNS))
    path = files.frontend_path(path)
    files.csv(files.frontend_rows(reports, ["source_id", "report_id"]), path, list(files.FRONTEND_COLUMNS))
    return True


def main(
    argv: list[str] | None = None,
    spark: SparkSession | None = None,
    opener: Callable | None = None,
    extractor: enrichment.Extractor | None = None,
) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    folder = Folder(spark, args.data_dir)
    run = {
        "discover": discover,
        "fetch": lambda a, f: fetch(a, f, opener),
        "parse": parse,
        "filter-disease": filter_disease,
        "extract-reports": extract_reports,
        "enrich": lambda a, f: enrich(a, f, extractor),
        "export-final": export_final,
    }
    stages = [s for s in STAGES if s != "enrich" or extractor or args.extractor]
    for name in stages if args.command == "run-all" else (args.command,):
        if not run[name](args, folder):
            print(f"{name} failed", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
