"""Reading XML dumps as one string per record, by many tasks.

The text source splits a plain file at a separator made of a record's end tag, the white space after
it and the next record's opening, so no record is parsed to find the next. The white space is read
from the file itself; records that are separated otherwise are split afterwards inside their fragment.
Gzip files cannot be split: `inflate` writes them out plain first, all files of a run at once, each by a
task of its own, and keeps what is already there. A gzip file read as it is goes through one task, and
its raw strings are dealt out before anything is parsed.
"""

from __future__ import annotations

import gzip
import re
import shutil
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.entities import EntitySpec, detect_entity, get


class DumpError(Exception):
    """A dump that cannot be read; names the file."""


class DecompressError(DumpError):
    """A gzip file that is damaged or cut off."""


#: What the readers say of a damaged gzip file.
GZIP_FAULTS = ("ZipException", "incorrect header check", "incorrect data check", "invalid stored block", "invalid block type", "invalid code lengths", "invalid distance", "Unexpected end of input stream", "not a gzip file", "EOFException")


def named_error(path: str, error: Exception) -> Exception:
    """A typed error with the file's name where the file's compression is to blame, else the error itself."""
    if str(path).endswith(".gz") and any(x in str(error) for x in GZIP_FAULTS):
        return DecompressError(f"{path}: cannot be decompressed")
    return error


class EmptyDump(DumpError, ValueError):
    """No record was found."""


class MalformedDump(DumpError, ValueError):
    """The file does not end with a whole record."""


BLANKS = " \t\r\n"


@dataclass(frozen=True)
class Job:
    path: str
    entity: str


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file."""
    where, fs = _hadoop(spark, path)
    return fs.getFileStatus(where).getLen()


def resolve_jobs(spark: SparkSession, paths: list[str]) -> list[Job]:
    """Files to read with their entities. A folder stands for its *.xml.gz and *.xml in order of name; other names are ignored; what is missing or has an unknown name is an error."""
    found: list[str] = []
    for p in map(str, paths):
        where, fs = _hadoop(spark, p)
        if not fs.exists(where):
            raise FileNotFoundError(f"No such file or folder: {p}")
        if fs.getFileStatus(where).isDirectory():
            names = sorted(s.getPath().getName() for s in fs.listStatus(where) if not s.isDirectory())
            own = [n for n in names if n.endswith((".xml.gz", ".xml"))]
            # A file and its compressed form are one dump; the plain one can be read by many tasks.
            own = [n for n in own if not (n.endswith(".gz") and n.removesuffix(".gz") in own)]
            if not own:
                raise FileNotFoundError(f"No .xml.gz or .xml files in {p}")
            found += [f"{p.rstrip('/')}/{n}" for n in own]
        elif p.endswith((".xml.gz", ".xml")):
            found.append(p)
    return [Job(p, detect_entity(p)) for p in found]


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def inflate(spark: SparkSession, jobs: list[Job], folder: str | None = None) -> list[Job]:
    """The jobs with their gzip files written out plain, into a folder that all tasks share or else beside the dump. A plain file that is there is used as it is."""
    out = [Job(f"{(folder or j.path.rpartition('/')[0] or '.').rstrip('/')}/{j.path.rpartition('/')[2].removesuffix('.gz')}", j.entity) if j.path.endswith(".gz") else j for j in jobs]
    todo = [(a.path, b.path) for a, b in zip(jobs, out, strict=True) if a != b]

    def run(batches):
        for b in batches:
            done = []
            for i in b.column(0).to_pylist():
                (fs, source), (to, target) = _open_fs(todo[i][0]), _open_fs(todo[i][1])
                if to.get_file_info(target).type == pafs.FileType.NotFound:
                    to.create_dir(target.rpartition("/")[0], recursive=True)
                    part = f"{target}.{uuid.uuid4().hex[:8]}.part"
                    try:
                        with fs.open_input_stream(source, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain, to.open_output_stream(part, compression=None) as sink:
                            shutil.copyfileobj(plain, sink, 8 << 20)
                    except (gzip.BadGzipFile, EOFError, zlib.error) as e:
                        to.delete_file(part)
                        raise ValueError(f"[{i}] incorrect data check: {e}") from e
                    to.move(part, target)
                done.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["id"])

    if todo:
        try:
            spark.range(0, len(todo), 1, len(todo)).mapInArrow(run, "id long").collect()
        except Exception as e:
            bad = re.search(r"\[(\d+)\] incorrect data check", str(e))
            raise (named_error(todo[int(bad[1])][0], e) if bad else e) from e
    return out


def _literal(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def separator(spark: SparkSession, path: str, spec: EntitySpec) -> str:
    """End tag, white space and opening as they stand between the file's first records; with a newline if there is but one."""
    end = f"</{spec.row_tag}>"
    heads = spark.read.option("lineSep", end).text(path).limit(64).select(F.regexp_extract("value", rf"^(\s*){_literal(spec.opening)}", 1).alias("s"), F.col("value").rlike(rf"^\s*{_literal(spec.opening)}").alias("m")).collect()
    between = next((r["s"] for r in heads[1:] if r["m"]), "\n")
    return f"{end}{between}{spec.opening}"


def _repaired(value: Column, spec: EntitySpec) -> Column:
    """A fragment as a whole element: what the separator took away and the file's frame are put right."""
    t, e, o = spec.row_tag, spec.name, _literal(spec.opening)
    body = F.regexp_replace(value, rf"\A\s*(?:<\?xml[^>]*\?>\s*)?(?:<{e}(?:\s[^>]*)?>\s*)?{o}", "")
    body = F.regexp_replace(body, rf"</{t}>\s*(?:</{e}>\s*)?\z", "")
    return F.concat(F.lit(spec.opening), body, F.lit(f"</{t}>"))


def read_records(spark: SparkSession, path: str, spec: EntitySpec, *, line_sep: str | None = None, partitions: int | None = None) -> DataFrame:
    """(xml, closed): a record's element, and whether it is the one that ends the file. partitions bounds the tasks that parse."""
    raw = spark.read.option("lineSep", line_sep or separator(spark, path, spec)).text(path)
    if str(path).endswith(".gz"):
        raw = raw.repartition(partitions or max(2, spark.sparkContext.defaultParallelism * 2))
    elif partitions:
        raw = raw.coalesce(partitions)
    t, e, o = spec.row_tag, spec.name, _literal(spec.opening)
    value, end = F.col("value"), f"</{t}>"
    left, right = F.ltrim(value, F.lit(BLANKS)), F.rtrim(value, F.lit(BLANKS))
    # Nearly all fragments lie between two separators. Only those that may hold the file's frame, or more than one
    # record, are looked at with patterns.
    head = F.startswith(left, F.lit("<?xml")) | F.startswith(left, F.lit(f"<{e}")) | F.startswith(left, F.lit(spec.opening))
    tail = F.endswith(right, F.lit(end)) | F.endswith(right, F.lit(f"</{e}>"))
    odd = head | tail | F.contains(value, F.lit(spec.opening))
    closed = F.when(tail, value.rlike(rf"</{t}>\s*(?:</{e}>\s*)?\z")).otherwise(F.lit(False))
    # Records that another white space separates: split between an end tag and an opening.
    parts = F.when(odd, F.split(_repaired(value, spec), rf"(?<=</{t}>)\s*(?={o})")).otherwise(F.array(F.concat(F.lit(spec.opening), value, F.lit(end))))
    # A frame without records is not a record.
    frame = rf"\A\s*(?:<\?xml[^>]*\?>\s*)?(?:<{e}(?:\s[^>]*)?>\s*</{e}>|<{e}(?:\s[^>]*)?/>)\s*\z"
    framed = F.when(head, value.rlike(frame)).otherwise(F.lit(False))
    return raw.where((right != F.lit("")) & ~framed).select(closed.alias("closed"), F.explode(parts).alias("xml"))


def read_dump(spark: SparkSession, path: str, **how) -> tuple[EntitySpec, DataFrame]:
    spec = get(detect_entity(path))
    return spec, read_records(spark, path, spec, **how)
