"""Small files in the index's folder, through Hadoop's file systems, and the base table's files."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def index_root(spark: SparkSession) -> str:
    """lodegram.index_root, else a folder in spark.checkpoint.dir, else, on one machine (tests), one made here."""
    found = spark.conf.get("lodegram.index_root", None)
    if found:
        return found.rstrip("/")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("lodegram.index_root or spark.checkpoint.dir must name a folder that the whole cluster sees")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodegram-"))
            java = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = java.get()
    return shared.rstrip("/") + "/lodegram-index"


class Store:
    """Text files of a folder that all of a cluster sees."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def full(self, path: str) -> str:
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that isn't there yet; False if it is. The whole file appears at once: a writer
        that dies before leaves only a draft, which nobody reads."""
        draft = f"{path}.{uuid.uuid4().hex}.part"
        fs, p = self._at(draft)
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        to = fs.makeQualified(hadoop.Path(path))
        options = self.gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(to.toUri(), self.conf).rename(fs.makeQualified(p), to, options)
        except Py4JJavaError as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete_file(self, uri: str) -> None:
        """A file by its name in _metadata, which is encoded as a URI."""
        p = self.jvm.org.apache.hadoop.fs.Path(self.jvm.java.net.URI(uri))
        p.getFileSystem(self.conf).delete(p, False)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


@dataclass(frozen=True)
class Listing:
    """A table's files (file, size, mtime) as a scan lists them, and the DataFrame that scans just these."""

    files: pd.DataFrame
    base: DataFrame


_STATUS = re.compile(r"\{path=(.*); isDirectory=false; length=(\d+);.*?modification_time=(\d+);")
#: What Java's URIs keep of a path as it is; of letters beyond ASCII all but controls and spaces.
_KEPT = re.compile(r"[A-Za-z0-9_\-!.~'()*,;:$&+=@/]")
_listings: dict[tuple[str, str], tuple[str, Listing]] = {}


def encoded(path: str) -> str:
    """A path as rows have it in _metadata."""
    return "".join(c if _KEPT.match(c) or (ord(c) > 159 and not c.isspace()) else "".join(f"%{b:02X}" for b in c.encode()) for c in path)


def listing(spark: SparkSession, path: str) -> Listing:
    """The table as it is now. Files are those of the scan itself, whatever their names end with and wherever they
    are: none can be read that isn't listed. If none has changed since the last call, nothing but names is read."""

    def statuses(df: DataFrame) -> tuple[str, int]:
        plan = df._jdf.queryExecution().analyzed()
        while not plan.getClass().getSimpleName() == "LogicalRelation":
            plan = plan.children().head()
        found = plan.relation().location().allFiles()
        return found.mkString("\n"), found.size()  # one call for all files

    key = (spark.sparkContext.applicationId, path)
    # with a schema given, Spark lists the files but opens none
    text, _ = statuses(spark.read.schema("`__lg_none` int").parquet(path))
    if key in _listings and _listings[key][0] == text:
        return _listings[key][1]
    base = spark.read.parquet(path)
    text, n = statuses(base)
    rows = [(encoded(m[1]), int(m[2]), int(m[3])) for line in text.split("\n") if (m := _STATUS.search(line))]
    if len(rows) != n:
        raise ValueError(f"the list of the files of {path} can't be read")
    files = pd.DataFrame(rows, columns=["file", "size", "mtime"]).astype({"file": "object", "size": "int64", "mtime": "int64"})
    _listings[key] = (text, Listing(files, base))
    return _listings[key][1]


def quoted(name: str) -> str:
    """The column of that very name: dots and backticks in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def read_base(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The table as it is now, or only some of its files, which are picked by the scan, not listed again."""
    base = listing(spark, path).base
    return base if files is None else base.where(file_of(base).isin(files))


def file_of(base: DataFrame) -> Column:
    """The path of a row's file. Not by name: a table may have a column of its own called _metadata."""
    return base.metadataColumn("_metadata")["file_path"]


def row_of(base: DataFrame) -> Column:
    """The number of a row in its file."""
    return base.metadataColumn("_metadata")["row_index"]


def count_rows(base: DataFrame) -> DataFrame:
    """file, rows: from the files' footers and row numbers; no column is read."""
    return base.select(file_of(base).alias("file"), row_of(base).alias("i")).groupBy("file").agg((F.max("i") + 1).alias("rows"))
