"""Folders of image files as DataFrames: a walk without reading data, and header scans with bounded reads."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from skycatalog.functions import rules, scalar
from skycatalog.sources import fits, raw, xisf

WALK_SCHEMA = "relative_path string, filename string, extension string, size_bytes bigint, file_mtime timestamp"
SCAN_SCHEMA = "format string, status string, error_code string, error_message string, headers_json string, card_count int, header_bytes bigint"


def _extension(name: str) -> str | None:
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem and ext else None


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class WalkReader(DataSourceReader):
    """One partition for each folder right under the root and one for the root's own files; symbolic links to folders are not followed."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.skip = {"node_modules", *[s.lower() for s in json.loads(options.get("skip", "[]"))]}

    def _enters(self, name: str) -> bool:
        return not name.startswith(".") and name.lower() not in self.skip

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = [_Folder(self.root, False)]
        try:
            with os.scandir(self.root) as entries:
                out += [_Folder(e.path, True) for e in entries if e.is_dir(follow_symlinks=False) and self._enters(e.name)]
        except OSError:
            pass
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        import datetime

        todo = [partition.path]
        while todo:
            try:
                with os.scandir(todo.pop()) as entries:
                    found = list(entries)
            except OSError:
                continue
            for e in found:
                if not self._enters(e.name):
                    continue
                if e.is_dir(follow_symlinks=False):
                    if partition.deep:
                        todo.append(e.path)
                    continue
                ext = _extension(e.name)
                if ext not in rules.EXTENSIONS:  # before any stat
                    continue
                try:
                    st = e.stat()
                except OSError:
                    continue
                at = datetime.datetime.fromtimestamp(st.st_mtime_ns // 1_000_000 / 1000, datetime.UTC)
                yield os.path.relpath(e.path, self.root).replace(os.sep, "/"), e.name, ext, st.st_size, at


class WalkSource(DataSource):
    """spark.read.format('skywalk').option('path', root).option('skip', json list).load()"""

    @classmethod
    def name(cls) -> str:
        return "skywalk"

    def schema(self) -> str:
        return WALK_SCHEMA

    def reader(self, schema: StructType) -> WalkReader:
        return WalkReader(dict(self.options))


def walk(spark: SparkSession, root: str, skip: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(WalkSource)
    return spark.read.format("skywalk").option("path", root).option("skip", json.dumps(skip or [])).load()


def watch(spark: SparkSession, root: str, skip: list[str] | None = None, *, quiet_seconds: int = 2, existing: bool = False) -> DataFrame:
    """A stream of the image files that come or change below `root`, with the columns of `walk`.

    Spark's file source finds them without reading them; hidden and skipped folders are left out.  Files that were there when the
    stream was first planned count only if `existing`.  A file that is still being written (`quiet_seconds` not over) comes out
    marked unstable: it shows again when its time changes.  What is gone is found by the next scan.
    """
    started = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(os.path.abspath(root)) + "/", "")
    name = F.element_at(F.split(path, "/"), -1)
    f = s.select(path.alias("relative_path"), name.alias("filename"), scalar.extension_of(name).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("file_mtime"))
    f = f.where(F.col("extension").isin(rules.EXTENSIONS) & scalar.walks_into(F.concat(F.lit("/"), F.col("relative_path")), skip or []))
    if not existing:
        f = f.where(F.col("file_mtime") >= started)
    return f.withColumn("is_stable", F.unix_seconds(F.current_timestamp()) - F.unix_seconds("file_mtime") >= quiet_seconds)


def scan_one(extension: str | None, read: fits.Read) -> tuple:
    """(format, status, error code, error message, headers as JSON, cards, header bytes) of one file."""
    e = (extension or "").lower()
    try:
        if e in rules.FITS_EXTENSIONS:
            h = fits.parse_header(read)
            return "fits", h.status, h.error_code, h.error_message, json.dumps(h.keywords), h.card_count, h.header_bytes
        if e in rules.XISF_EXTENSIONS:
            x = xisf.parse_header(read)
            return "xisf", x.status, x.error_code, x.error_message, json.dumps({**x.keywords, **{f"prop:{k}": v for k, v in x.properties.items()}}), len(x.keywords), x.header_bytes
        if e in rules.RAW_EXTENSIONS:
            r = raw.parse_bytes(read(0, raw.PREFIX))
            return "raw", r.status, r.error_code, r.error_message, json.dumps(r.tags), len(r.tags), None
    except OSError as err:
        return None, "error", "READ_ERROR", str(err), "{}", 0, None
    return None, "error", "UNSUPPORTED_EXTENSION", f"extension {extension}", "{}", 0, None


def scan_content(rows: DataFrame, extension: str, content: str) -> DataFrame:
    """Header columns for files held in a binary column."""
    kept = [c for c in rows.columns if c != content]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != content)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [scan_one(e, lambda o, n, d=d: (d or b"")[o : o + n]) for e, d in zip(pdf[extension], pdf[content], strict=True)]
            got = pd.DataFrame(out, columns=[c.split()[0] for c in SCAN_SCHEMA.split(", ")])
            yield pd.concat([pdf[kept].reset_index(drop=True), got], axis=1)

    return rows.mapInPandas(scan, f"{types}, {SCAN_SCHEMA}")


def scan_files(files: DataFrame, root: str) -> DataFrame:
    """Header columns for files below `root`, by seek and bounded reads; columns relative_path and extension are needed."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, e in zip(pdf["relative_path"], pdf["extension"], strict=True):
                try:
                    with open(os.path.join(root, path), "rb", buffering=0) as fh:

                        def read(offset: int, length: int, fh=fh) -> bytes:
                            fh.seek(offset)
                            return fh.read(length)

                        out.append(scan_one(e, read))
                except OSError as err:
                    out.append((None, "error", "READ_ERROR", str(err), "{}", 0, None))
            got = pd.DataFrame(out, columns=[c.split()[0] for c in SCAN_SCHEMA.split(", ")])
            yield pd.concat([pdf.reset_index(drop=True), got], axis=1)

    return files.mapInPandas(scan, f"{types}, {SCAN_SCHEMA}")


def hash_files(files: DataFrame, root: str, chunk: int = 1 << 20) -> DataFrame:
    """SHA-256 of each file, streamed; unreadable files have a NULL hash and an error."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "sha256")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["relative_path"]:
                h = hashlib.sha256()
                try:
                    with open(os.path.join(root, path), "rb") as fh:
                        while block := fh.read(chunk):
                            h.update(block)
                    out.append((h.hexdigest(), None))
                except OSError as err:
                    out.append((None, str(err)))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["sha256", "hash_error"])], axis=1)

    return files.drop("sha256").mapInPandas(digest, f"{types}, sha256 string, hash_error string")


def header_bytes(rows: DataFrame, headers_json: str, extension: str, keep: list[str]) -> DataFrame:
    """A synthetic file head from each row's keywords: `keep` columns, extension and content."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    src = rows.select(*keep, F.col(extension).alias("extension"), F.col(headers_json).alias("_json"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = []
            for e, text in zip(pdf["extension"], pdf["_json"], strict=True):
                try:
                    keys = json.loads(text) if isinstance(text, str) else {}
                except ValueError:
                    keys = {}
                if e in rules.XISF_EXTENSIONS:
                    content.append(xisf.write_header({k: str(v) for k, v in keys.items() if v is not None}))
                else:
                    content.append(fits.write_header([(k[:8], v) for k, v in keys.items() if not isinstance(v, (dict, list))]))
            yield pdf.drop(columns="_json").assign(content=content)

    return src.mapInPandas(build, f"{types}, extension string, content binary")
