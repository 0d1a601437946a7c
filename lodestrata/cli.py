"""Command line: convert dumps to files, load them into a database."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import uuid

from . import __version__
from .console import Progress, file_size, short_time, status
from .plans.entities import get


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("paths", nargs="+", help="dump files (.xml.gz, .xml) or folders of them")
    p.add_argument("--parse-workers", type=int, default=None, help="most tasks that parse a dump (default: as many as it has splits)")
    p.add_argument("--chunk-mb", type=int, default=256, help="size of an input split")
    p.add_argument("--write-queue", type=int, default=2, help="tables written at a time")
    p.add_argument("--keep-xml", action="store_true", help="write decompressed dumps beside the compressed ones and keep them")
    p.add_argument("--keep-stage", action="store_true", help="keep the staged table")
    p.add_argument("--stage-dir", default=None, help="folder for decompressed dumps and the staged table, shared by all tasks (default: spark.checkpoint.dir, else beside the output)")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--profile", action="store_true", help="seconds that each table took and waited")
    p.add_argument("--progress", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--strict", action="store_true", help="report elements that are not known")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    top.add_argument("--version", action="version", version=f"lodestrata {__version__}")
    sub = top.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="dumps to Parquet or JSON Lines")
    _common(convert)
    convert.add_argument("-f", "--format", type=str.lower, default="parquet", choices=["parquet", "jsonl"])
    convert.add_argument("--output", "-o", default=".")
    convert.add_argument("--compression", type=str.lower, default=None, help="zstd, snappy, gzip, none (parquet); gzip, bzip2, none (jsonl)")
    load = sub.add_parser("load", help="dumps into PostgreSQL or SQLite")
    _common(load)
    load.add_argument("--dsn", default=os.environ.get("DATABASE_URL"))
    load.add_argument("--write-workers", type=int, default=1)
    load.add_argument("--index-workers", type=int, default=2)
    load.add_argument("--pg-unlogged", action="store_true")
    load.add_argument("--pg-tune", action="store_true")
    load.add_argument("--pg-fk", "--fk", action="store_true")
    return top


def make_sink(args: argparse.Namespace):
    from .sinks import JsonLinesSink, ParquetSink, get_sink

    if args.command == "convert":
        if args.format == "parquet":
            return ParquetSink(args.output, args.compression or "zstd", args.overwrite)
        return JsonLinesSink(args.output, args.compression or "none", args.overwrite)
    if not args.dsn:
        raise ValueError("no database given: use --dsn or set DATABASE_URL")
    return get_sink(args.dsn, overwrite=args.overwrite, unlogged=args.pg_unlogged, tune=args.pg_tune, fk=args.pg_fk, writers=args.write_workers if args.write_workers > 1 else None, index_workers=args.index_workers)


def report(result, spec, verb: str, profile: bool, size: int | None = None) -> str:
    rate = f"  {result.records / result.t_stage:,.0f} rec/s" if result.t_stage > 0 else ""
    lines = [f"{result.records:,} {spec.name} {verb} [{short_time(result.t_total) if result.t_total >= 60 else f'{result.t_total:.2f}s'}]", status("Stage", f"{result.t_stage:.2f}s{rate}"), status("Write", f"{result.t_write:.2f}s"), status("Finalize", f"{result.t_finalize:.2f}s")]
    if size is not None:
        lines.insert(1, status("Input", file_size(size)))
    if result.skipped:
        lines.append(status("Warning", f"{result.skipped} records without id were skipped"))
    lines += [status("Unknown", p) for p in result.unknown]
    if profile:
        total = sum(result.tables.values())
        lines += [status(t.name, f"{result.tables.get(t.name, 0):.2f}s after {result.waits.get(t.name, 0):.2f}s", f"{100 * result.tables.get(t.name, 0) / total if total else 0:.1f}%") for t in spec.tables]
    return "\n".join(lines)


def session(args: argparse.Namespace):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lodestrata").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def scratch_dir(spark, args: argparse.Namespace) -> str:
    """A new folder for this call, where all tasks can reach it."""
    shared = args.stage_dir or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and args.command == "convert":
        shared = f"{args.output.rstrip('/')}/_lodestrata"
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("no shared folder: give --stage-dir or set spark.checkpoint.dir")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/lodestrata-{uuid.uuid4().hex}"


def drop_folder(spark, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(where, True)
    if where.getParent().getName() == "_lodestrata" and not fs.listStatus(where.getParent()):
        fs.delete(where.getParent(), False)


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 on success, 1 on any error (one line, no traceback), 130 on interrupt."""
    args = parser().parse_args(argv)
    sink, own = None, None
    try:
        from .run import Config, run
        from .sources.dumps import inflate, length, resolve_jobs

        sink = make_sink(args)
        spark = spark or session(args)
        jobs = resolve_jobs(spark, args.paths)
        own = scratch_dir(spark, args)
        for job in inflate(spark, jobs, None if args.keep_xml else f"{own}/xml"):
            with Progress(spark, job.entity, args.progress and sys.stderr.isatty()):
                result = run(spark, Config(job, sink, f"{own}/stage", chunk_mb=args.chunk_mb, parse_partitions=args.parse_workers, write_threads=max(1, args.write_queue), strict=args.strict, profile=args.profile, keep_stage=args.keep_stage))
            print(report(result, get(job.entity), "converted" if args.command == "convert" else "loaded", args.profile, length(spark, job.path)))
        return 0
    except KeyboardInterrupt:
        print("Interrupted", file=sys.stderr)
        return 130
    except Exception as e:
        print(f"Error: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}", file=sys.stderr)
        return 1
    finally:
        if sink is not None:
            sink.close()
        if own and not args.keep_stage:
            drop_folder(spark, own)


if __name__ == "__main__":
    sys.exit(main())
