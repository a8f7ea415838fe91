"""What the training-data operators share: row identity, shared storage, side tables, components.

Column names that start with ``__lg_`` are reserved for intermediate columns.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, ROW = "__lg_f", "__lg_r"
#: Rows of a file whose side rows are together (as a power of two), and bytes of the table that a side table's folder
#: stands for: however large files are, a task holds the rows of one such block.
BLOCK, FOLDER = 13, 64 << 20
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, else, on one machine (tests), one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isEmpty():
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodegram-"))
            java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get()
    return found.rstrip("/") + "/lodegram"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(spark: SparkSession) -> set[str]:
    """The intermediate tables that this session has written so far."""
    return {*_made.get(spark.sparkContext.applicationId, [])}


def discard(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete the intermediate tables that this session has written, but for some. DataFrames that are made of them,
    and haven't been written, can't be read any more."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in [x for x in made if x not in keep]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        made.remove(path)


def saved(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df itself if its rows are those of files, else a copy in the shared folder: its rows then have the same
    keys however often they are read."""

    def plain(node) -> bool:
        kids = node.children()
        name = node.getClass().getSimpleName()
        if name == "LogicalRelation":
            return True
        return name in ("Project", "Filter", "SubqueryAlias", "View") and all(plain(kids.apply(i)) for i in range(kids.size()))

    return df if plain(df._jdf.queryExecution().analyzed()) else saved(df, "rows")


def quoted(name: str) -> str:
    """The column of that very name: dots and backticks in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def with_row_key(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The given columns and a key for each row that stays the same in every scan: (FILE, ROW).

    It is the hash of the file's path and the row's number in it. A DataFrame that isn't read
    from files is written to the shared folder first; to key it more than once, take stored() of it.
    """
    names = [quoted(c) for c in cols]

    def keyed(d: DataFrame) -> DataFrame:
        # not by name: a table may have a column of its own called _metadata
        meta = d.metadataColumn("_metadata")
        return d.select(*names, F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].alias(ROW))

    try:
        return keyed(df)
    except AnalysisException:
        return keyed(saved(df.select(*names), "rows"))


def write_side(df: DataFrame, tag: str, table: DataFrame) -> str:
    """Write rows with FILE and ROW of a table, for ``Side`` to read next to a scan of the table. They are foldered by
    file and block of rows, in folders by the table's size."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    folders = max(64, min(1 << 20, size // FOLDER))
    path = new_path(df.sparkSession, f"{tag}-{folders}")
    place = F.pmod(F.xxhash64(FILE, F.shiftright(ROW, BLOCK)), F.lit(folders)).cast("int")
    block = F.xxhash64(FILE, F.shiftright(ROW, BLOCK))
    (
        df.withColumns({"__lg_b": place, "__lg_k": block})
        .repartition("__lg_b")
        .sortWithinPartitions("__lg_b", FILE, ROW)
        .write.partitionBy("__lg_b")
        .parquet(path)
    )
    return path


class Side:
    """The rows of a side table by file and block of rows. It joins a scan with what is known of its rows, without
    a shuffle of texts: a task reads only the folders of the blocks that it scans, one block at a time."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.folders = int(path.rsplit("/", 1)[1].split("-")[-2])
        self.block: tuple[int, int] | None = None
        self.table: pa.Table | None = None

    def of(self, file: int, block: int) -> pa.Table | None:
        """Rows of that block of the file, sorted by ROW; None if there are none."""
        if self.block != (file, block):
            key = spark_hash(file, block)
            folder = f"{self.path}/__lg_b={key % self.folders}"
            self.block, self.table = (file, block), None
            if self.fs.get_file_info(folder).type == pafs.FileType.Directory:
                own = (pads.field("__lg_k") == key) & (pads.field(FILE) == file)
                own &= (pads.field(ROW) >= block << BLOCK) & (pads.field(ROW) < (block + 1) << BLOCK)
                found = pads.dataset(folder, filesystem=self.fs, format="parquet").to_table(filter=own)
                if found.num_rows:
                    self.table = found.sort_by(ROW).combine_chunks()
        return self.table

    def rows(self, files: np.ndarray, rows: np.ndarray):
        """For a batch's keys: (position in the batch, table, first and last+1 row of it there)."""
        for file in dict.fromkeys(files.tolist()):
            own = np.flatnonzero(files == file)
            blocks = rows[own] >> BLOCK
            for block in dict.fromkeys(blocks.tolist()):
                table = self.of(file, block)
                if table is None:
                    continue
                known = table.column(ROW).to_numpy()
                at = own[blocks == block]
                lo, hi = np.searchsorted(known, rows[at], "left"), np.searchsorted(known, rows[at], "right")
                for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    yield p, table, a, b


def spark_hash(*longs: int) -> int:
    """xxhash64() of longs as Spark computes it: each with the last one's as its seed, from 42 on."""
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest((x & _ALL).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


_ALL = (1 << 64) - 1


def components(edges: DataFrame, a: str, b: str, tag: str) -> DataFrame:
    """Connected components of the edges (a, b): node, root (the least node), for every node.

    Large-star and small-star rounds in turn (Kiveris et al., 2014), each written to the shared
    folder, until all edges go to a root: a number of rounds that grows with the log of the diameter. A node's
    neighbours are never brought together: their least is an aggregate, which is joined to the edges, so that a
    node with very many of them is a skewed join's key, which adaptive execution splits.
    """

    def starred(d: DataFrame) -> DataFrame:
        return d.where("x <> y").distinct()

    def open_(d: DataFrame) -> bool:
        """Whether a node has several lesser ones, or one that has a lesser one itself."""
        ends = d.select(F.col("x").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(d.select(F.col("y").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return bool(ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").limit(1).count())

    e = saved(starred(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))), tag)
    while open_(e):
        # large star: each larger neighbour goes to the least of the neighbours and the node itself
        both = e.select(F.col("x").alias("n"), F.col("y").alias("m")).unionByName(e.select(F.col("y").alias("n"), F.col("x").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("k")).select("n", F.least("n", "k").alias("k"))
        large = saved(starred(both.join(least, "n").where("m > n").select(F.col("m").alias("x"), F.col("k").alias("y"))), tag)
        # small star: the node and its lesser neighbours go to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("k"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("k").alias("y")).unionByName(least.select("x", F.col("k").alias("y")))
        e = saved(starred(small), tag)
    roots = e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(roots)


#: Bytes of a batch that goes to Python, so that two tasks' batches, and what is made of them, stay small
#: next to an executor's memory. It is set in the session.
BATCH_BYTES = 4 << 20


def release() -> None:
    """Give memory that a task doesn't need any more back to the system: workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow() in batches of BATCH_BYTES; each task gives its memory back."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    names = df.columns

    def task(batches):
        try:
            yield from run(batch if batch.schema.names == names else batch.rename_columns(names) for batch in batches)
        finally:
            release()

    # mapInArrow() looks columns up by name, which fails for names with dots or backticks
    plain = df if not any(set(c) & {".", "`"} for c in names) else df.toDF(*[f"__lg_c{i}" for i in range(len(names))])
    return plain.mapInArrow(task, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finisher, in place of h."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
INV = np.uint64(pow(int(MULT), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to 0, 1, ... n-1, modulo 2^64."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 20), np.uint64)
        have[0] = 1
        have[1:] = base
        np.cumprod(have, out=have)
        _powers[key] = have
    return have[:n]


#: lower case, digits alike, ASCII punctuation out (as spaces inside words it would split them)
TABLE = bytes.maketrans(b"0123456789\t\r\x0b\x0c", b"0000000000    ")
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Words:
    """Words of many lines at once: lower case, digits as 0, without ASCII punctuation, split at white space.

    data: normalised bytes; start, end: of the words; hash: of each; first: of each line the number
    of its first word, with one more at the end; line i has the words first[i] to first[i+1].
    """

    def __init__(self, text: str) -> None:
        raw = text.lower().encode("utf-8", "surrogatepass").translate(TABLE, PUNCT)
        self.data = d = np.frombuffer(raw, np.uint8)
        gap = (d == 32) | (d == 10)
        inside = ~gap
        starts = inside.copy()
        starts[1:] &= gap[:-1]
        ends = inside
        ends[:-1] &= gap[1:]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        sums = np.empty(len(d) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((d.astype(np.uint64) + np.uint64(1)) * powers(MULT, len(d)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(INV, len(d) + 1)[self.start])
        breaks = np.flatnonzero(d == 10)
        self.first = np.concatenate(([0], np.searchsorted(self.start, breaks), [len(self.start)]))


def doc_groups(texts: list[str], limit: int = 1 << 20):
    """Slices of the texts of about limit characters, at least one text each."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def repeat_rows(docs: DataFrame, side_path: str, count: str, default: int) -> DataFrame:
    """docs with each row as many times as the side table's column says, default where it has no row.

    Rows stay in their scan: no shuffle.
    """
    cols = docs.columns
    keyed = with_row_key(docs, cols)

    def run(batches):
        side = Side(side_path)
        for batch in batches:
            times = np.full(batch.num_rows, default)
            for p, table, a, _ in side.rows(batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy()):
                times[p] = table.column(count)[a].as_py()
            out = batch.select(cols)
            yield out if (times == 1).all() else out.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

    return mapped(keyed, run, docs.schema)
