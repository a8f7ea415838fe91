"""The gram index of a text column of a Parquet table: building, refreshing, compacting, dropping, watching.

A row's id is its number in its file plus the file's base, which the index gives to each file once and
never again. An index is a folder with commits; commit N is one JSON file, created only if it isn't
there, so of two writers one fails and readers always see a whole state. It names the posting
generations, the gram statistics and the list of files (with sizes and times) that the state is made of.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import OrderedDict
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegram.functions.grams import fold
from lodegram.operators.postings import SHIFT, merge_lists, packed_chunks
from lodegram.settings import settings
from lodegram.sources.store import Store, count_rows, file_of, index_root, listing, quoted, read_base, row_of

FORMAT = 1
SEGMENTS = "gram string, segment_no long, postings array<bigint>, rowid_count long, min_rowid long, max_rowid long, generation int"
STATS = "gram string, row_count long, segment_count long"
FILES = "file string, size long, mtime long, rows long, base long"
#: The list of files is on the driver, as Spark's own is for any scan of the table. One of up to so many bytes is sent to
#: all executors to give row ids; a larger one is joined by shuffle.
SMALL_LIST = 64 << 20
RID = "__lg_rid"
#: Look-ups in so few files are made by the driver, which needs no job for them.
LOCAL_FILES = 16
#: Whole files of a state that are kept in memory: lists of files, and the first and last gram of posting files.
KEPT = 64
_kept: OrderedDict[str, object] = OrderedDict()


def kept(key: str, make):
    """What belongs to a file that never changes, made once."""
    if key in _kept:
        _kept.move_to_end(key)
    else:
        _kept[key] = make()
        while len(_kept) > KEPT:
            _kept.popitem(last=False)
    return _kept[key]


class IndexError_(ValueError):
    """What an index can't do in its state."""


@dataclass(frozen=True)
class Meta:
    index_id: str
    path: str
    column: str
    gram: int
    case_insensitive: bool
    columns: list[list[str]]
    hwm: int
    shift: int = SHIFT
    generations: list[list] = field(default_factory=list)
    stats: str = ""
    files: str = ""
    n_rows: int = 0
    commit: int = 0
    format_version: int = FORMAT


def ascii_lower(s: str) -> str:
    """Names fold in ASCII only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


class Index:
    """One index at one commit."""

    def __init__(self, spark: SparkSession, folder: str, meta: Meta) -> None:
        self.spark, self.folder, self.meta = spark, folder, meta

    def segments(self) -> DataFrame:
        """All generations, with the columns that a query asks for."""
        if not self.meta.generations:
            return self.spark.createDataFrame([], SEGMENTS)
        return self.spark.read.schema(SEGMENTS).parquet(*[f"{self.folder}/{d}" for d, _ in self.meta.generations])

    def stats(self) -> DataFrame:
        return self.spark.read.schema(STATS).parquet(f"{self.folder}/{self.meta.stats}")

    def files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/{self.meta.files}")

    def lookup(self, folder: str, grams: list[str], columns: list[str]) -> pd.DataFrame | None:
        """Rows of the grams in a folder of files sorted by gram, read by the driver; None if that is
        more than LOCAL_FILES files, or they can't be read without Spark."""

        def ranges():
            path = f"{self.folder}/{folder}-ranges.json"
            store = Store(self.spark)
            return json.loads(store.read(path)) if store.exists(path) else None

        spans = kept(f"{self.folder}/{folder}", ranges)
        if spans is None:
            return None
        names = [f for f, lo, hi in spans if any(lo <= g <= hi for g in grams)]
        if len(names) > LOCAL_FILES:
            return None
        if not names:
            return pd.DataFrame({c: [] for c in columns})
        try:
            fs, base = pafs.FileSystem.from_uri(f"{self.folder}/{folder}")
        except (pa.ArrowException, OSError, ImportError):
            return None
        found = pads.dataset([f"{base}/{x}" for x in names], filesystem=fs, format="parquet").to_table(columns=columns, filter=pads.field("gram").isin(grams))
        return found.to_pandas()

    def state(self) -> tuple[str | None, pd.DataFrame]:
        """Why the postings can't be trusted at all (None if they can), and the current files: file, size,
        mtime, rows, base, known, changed. rows and base are null for files that the index hasn't met."""
        reason = self.stale_reason()
        if reason:
            return reason, None
        then = kept(f"{self.folder}/{self.meta.files}", lambda: self.files().select("file", F.col("size").alias("size0"), F.col("mtime").alias("mtime0"), "rows", "base").toPandas())
        files = listing(self.spark, self.meta.path).files.merge(then, on="file", how="left")
        files["known"] = files["base"].notna()
        files["changed"] = files["known"] & ((files["size"] != files["size0"]) | (files["mtime"] != files["mtime0"]))
        return None, files.sort_values(["base", "mtime", "file"])

    def stale_reason(self) -> str | None:
        """What is certain from the table's columns."""
        store = Store(self.spark)
        if not store.exists(self.meta.path):
            return "base table is gone"
        now = [[ascii_lower(f.name), f.dataType.simpleString()] for f in read_base(self.spark, self.meta.path).schema.fields]
        names = dict(map(tuple, now))
        own = ascii_lower(self.meta.column)
        if own not in names:
            return "indexed column is gone"
        if names[own] != "string":
            return "indexed column has another type"
        if [x for x in now if x in self.meta.columns] != self.meta.columns:
            return "column list changed"
        return None


class Indexes:
    """All indexes under a folder (``lodegram.index_root``)."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.store = spark, Store(spark)
        self.root = (root or index_root(spark)).rstrip("/")

    # looking up

    def ids(self) -> list[str]:
        return [x for x in self.store.names(self.root) if self.store.exists(f"{self.root}/{x}/commits")]

    def load(self, index_id: str) -> Index:
        folder = f"{self.root}/{index_id}"
        commits = [int(x[:-5]) for x in self.store.names(f"{folder}/commits") if x.endswith(".json")]
        if not commits:
            raise IndexError_(f"index {index_id} has no commit")
        try:
            meta = Meta(**json.loads(self.store.read(f"{folder}/commits/{max(commits)}.json")))
        except (TypeError, json.JSONDecodeError) as e:
            raise IndexError_(f"index {index_id} is malformed") from e
        if meta.format_version != FORMAT or meta.index_id != index_id:
            raise IndexError_(f"index {index_id} is malformed")
        return Index(self.spark, folder, meta)

    def of(self, path: str) -> list[Index]:
        full = self.store.full(path)
        found = []
        for i in self.ids():
            try:
                index = self.load(i)
            except IndexError_:
                continue
            if index.meta.path == full:
                found.append(index)
        return sorted(found, key=lambda x: x.meta.column)

    def find(self, path: str, column: str | None) -> Index:
        found = self.of(path)
        if column is not None:
            found = [x for x in found if ascii_lower(x.meta.column) == ascii_lower(column)]
        if not found:
            raise IndexError_(f"no index on {path}" + (f" ({column})" if column else ""))
        if len(found) > 1:
            raise IndexError_(f"{path} has several indexes: name the column")
        return found[0]

    def _publish(self, folder: str, meta: Meta) -> None:
        """Make the state the index's, if the table is still what the work began with: its indexed files unchanged, and
        no other index on the column, which another creator may have made meanwhile."""
        index = Index(self.spark, folder, meta)
        reason, files = index.state()
        if reason is None and files["changed"].any():
            reason = "an indexed file was changed"
        if reason:
            raise IndexError_(f"{reason} while the index was being written")
        if meta.commit == 1:
            name = f"{self.root}/names/{self._name(meta)}"
            if self.store.exists(name) and self.store.read(name) not in {*self.ids(), meta.index_id}:
                self.store.delete(name)  # its creator never came to an end
            if not self.store.create(name, meta.index_id) and self.store.read(name) != meta.index_id:
                raise IndexError_(f"an index on {meta.path} ({meta.column}) already exists")
        if not self.store.create(f"{folder}/commits/{meta.commit}.json", json.dumps(asdict(meta))):
            raise IndexError_("another writer changed the index; try again")

    @staticmethod
    def _name(meta: Meta) -> str:
        """The file that stands for the one index that a column may have: its creator makes it, dropping removes it."""
        return hashlib.sha256(json.dumps([meta.path, ascii_lower(meta.column)]).encode()).hexdigest()

    # building

    def create(self, path: str, column: str, gram: int = 3, case_insensitive: bool = True, shift: int = SHIFT) -> Index:
        if path is None or column is None or gram is None or case_insensitive is None:
            raise IndexError_("arguments must not be null")
        if gram < 1:
            raise IndexError_("gram size must be at least 1")
        full = self.store.full(path)
        if not self.store.exists(full):
            raise IndexError_(f"no table at {path}")
        base = read_base(self.spark, full)
        named = [f for f in base.schema.fields if ascii_lower(f.name) == ascii_lower(column)]
        if not named:
            raise IndexError_(f"{path} has no column {column}")
        if not isinstance(named[0].dataType, StringType):
            raise IndexError_("only string columns can be indexed")
        if any(ascii_lower(f.name) == RID for f in base.schema.fields):
            raise IndexError_(f"a column called {RID} is in the way")
        if any(ascii_lower(x.meta.column) == ascii_lower(column) for x in self.of(path)):
            raise IndexError_(f"an index on {path} ({column}) already exists")
        columns = [[ascii_lower(f.name), f.dataType.simpleString()] for f in base.schema.fields]
        index_id = str(uuid.uuid4())
        meta = Meta(index_id, full, named[0].name, gram, case_insensitive, columns, -1, shift)
        index = Index(self.spark, f"{self.root}/{index_id}", meta)
        files = self._with_bases(listing(self.spark, full).files, base, 0)
        index.meta = replace(meta, files=self._write_files(index, files), n_rows=int(files["rows"].sum()))
        try:
            return self._add_generation(index, -1, index.meta.n_rows - 1, 0, files)
        except IndexError_:
            self.store.delete(index.folder)
            raise

    def _with_bases(self, files: pd.DataFrame, base: DataFrame, first: int) -> pd.DataFrame:
        """The files, each with the id of its first row, by time and name. A file that is read but isn't listed is an error:
        its rows would be lost."""
        counts = count_rows(base).toPandas()
        if lost := set(counts["file"]) - set(files["file"]):
            raise IndexError_(f"{sorted(lost)[0]} is read but not listed")
        files = files.merge(counts, on="file", how="left").fillna({"rows": 0}).sort_values(["mtime", "file"])
        files["base"] = files["rows"].cumsum() - files["rows"] + first
        return files[["file", "size", "mtime", "rows", "base"]].astype({c: "int64" for c in ("size", "mtime", "rows", "base")})

    def _write_files(self, index: Index, files: pd.DataFrame) -> str:
        name = f"files-{uuid.uuid4().hex}"
        self.spark.createDataFrame(files[["file", "size", "mtime", "rows", "base"]], FILES).coalesce(1).write.parquet(f"{index.folder}/{name}")
        return name

    def rows(self, index: Index, files: pd.DataFrame, lo: int, hi: int) -> DataFrame:
        """The table's columns and RID of the rows with lo < RID <= hi; only files that have some are read."""
        wanted = files[(files["base"] <= hi) & (files["base"] + files["rows"] - 1 > lo)]
        names = wanted["file"].tolist()
        if not names:
            return read_base(self.spark, index.meta.path).where("false").withColumn(RID, F.lit(0).cast("long"))
        base = read_base(self.spark, index.meta.path, names)
        keyed = base.select("*", file_of(base).alias("__lg_file"), row_of(base).alias("__lg_row"))
        if len(names) == 1:
            keyed = keyed.withColumn("base", F.lit(int(wanted["base"].iloc[0])))
            return self._between(keyed, lo, hi)
        wanted = self.spark.createDataFrame(wanted[["file", "base"]], "__lg_file string, base long")
        if sum(len(x) + 100 for x in names) <= SMALL_LIST:
            wanted = F.broadcast(wanted)
        return self._between(keyed.join(wanted, "__lg_file"), lo, hi)

    @staticmethod
    def _between(keyed: DataFrame, lo: int, hi: int) -> DataFrame:
        keyed = keyed.withColumn(RID, F.col("base") + F.col("__lg_row"))
        return keyed.where((F.col(RID) > lo) & (F.col(RID) <= hi)).drop("__lg_file", "__lg_row", "base")

    def _add_generation(self, index: Index, lo: int, hi: int, generation: int, files: pd.DataFrame) -> Index:
        """Index the rows after lo up to hi and publish the new state."""
        meta = index.meta
        name = f"gen-{generation}-{uuid.uuid4().hex}"
        parts = f"{index.folder}/parts-{uuid.uuid4().hex}"
        text = F.col(quoted(meta.column))
        texts = self.rows(index, files, lo, hi).where(text.isNotNull()).select(F.col(RID).alias("rid"), (fold(text) if meta.case_insensitive else text).alias("t"))
        packed_chunks(texts, meta.gram, meta.shift).write.parquet(parts)
        partials = self.spark.read.schema("gram string, segment_no long, postings array<bigint>").parquet(parts)
        n = settings(self.spark).build_partitions
        ranged = partials.repartitionByRange(n, "gram", "segment_no") if n else partials.repartitionByRange("gram", "segment_no")
        merged = merge_lists(ranged).withColumn("generation", F.lit(generation))
        merged.sortWithinPartitions("gram", "segment_no").write.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{index.folder}/{name}")
        self.store.delete(parts)
        self._write_ranges(index, name)
        new = self.spark.read.schema(SEGMENTS).parquet(f"{index.folder}/{name}")
        counts = new.groupBy("gram").agg(F.sum("rowid_count").alias("row_count"), F.count("*").alias("segment_count"))
        if meta.stats:
            old = index.stats()
            sound = F.col("gram").isNotNull() & (F.col("row_count") > 0) & (F.col("segment_count") > 0)
            checked = old.select("gram", F.when(sound, F.col("row_count")).otherwise(F.raise_error(F.lit("the gram statistics are malformed")).cast("long")).alias("row_count"), "segment_count")
            counts = checked.unionByName(counts).groupBy("gram").agg(F.sum("row_count").alias("row_count"), F.sum("segment_count").alias("segment_count"))
        stats = self._write_stats(index, counts)
        meta = replace(meta, hwm=hi, generations=[*meta.generations, [name, generation]], stats=stats, commit=meta.commit + 1)
        self._publish(index.folder, meta)
        self._sweep(index)
        return Index(self.spark, index.folder, meta)

    def _write_stats(self, index: Index, counts: DataFrame) -> str:
        name = f"stats-{uuid.uuid4().hex}"
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{index.folder}/{name}")
        self._write_ranges(index, name)
        return name

    def _write_ranges(self, index: Index, name: str) -> None:
        """First and last gram of each file of a folder, in one small file next to it."""
        rows = self.spark.read.schema("gram string").parquet(f"{index.folder}/{name}")
        spans = rows.groupBy(file_of(rows).alias("file")).agg(F.min("gram").alias("lo"), F.max("gram").alias("hi")).collect()
        self.store.create(f"{index.folder}/{name}-ranges.json", json.dumps([(r.file.rsplit("/", 1)[1], r.lo, r.hi) for r in spans]))

    def _sweep(self, index: Index) -> None:
        """Delete what neither this state nor the one before it names: a search that began on the one before
        can end. Of two writers only the one that published sweeps."""
        commits = sorted((int(x[:-5]) for x in self.store.names(f"{index.folder}/commits") if x.endswith(".json")), reverse=True)
        named: set[str] = set()
        for n in commits[:2]:
            m = json.loads(self.store.read(f"{index.folder}/commits/{n}.json"))
            named |= {m["stats"], m["files"], *(g for g, _ in m["generations"])}
        for x in self.store.names(index.folder):
            if x != "commits" and x.removesuffix("-ranges.json") not in named:
                self.store.delete(f"{index.folder}/{x}")

    # maintenance

    def _current(self, index: Index) -> tuple[Index, pd.DataFrame]:
        """The index with all files that there are now in its list (not published yet), and the files that still
        are there; fails if the postings aren't safe."""
        reason, files = index.state()
        if reason is None and files["changed"].any():
            reason = "an indexed file was changed"
        if reason:
            raise IndexError_(f"{reason}: drop the index and create it again")
        live = files[files["known"]][["file", "size", "mtime", "rows", "base"]].astype({"rows": "int64", "base": "int64"})
        new = files[~files["known"]][["file", "size", "mtime"]]
        if not len(new):
            return index, live
        added = self._with_bases(new, read_base(self.spark, index.meta.path, new["file"].tolist()), index.meta.n_rows)
        every = pd.concat([index.files().toPandas(), added])
        meta = replace(index.meta, files=self._write_files(index, every), n_rows=index.meta.n_rows + int(added["rows"].sum()))
        return Index(self.spark, index.folder, meta), pd.concat([live, added])

    def refresh(self, path: str, max_rows: int | None = None, col: str | None = None) -> DataFrame | None:
        """Index what came since; with max_rows at most so many row ids, of which it tells the progress."""
        if max_rows is not None and max_rows < 1:
            raise IndexError_("max_rows must be at least 1")
        done = []
        for index in [self.find(path, col)] if col is not None else self.of(path) or [self.find(path, col)]:
            index, live = self._current(index)
            old, end = index.meta.hwm, index.meta.n_rows - 1
            if max_rows is not None:
                end = bounded_end(old, end, max_rows, index.meta.shift)
            if end > old:
                index = self._add_generation(index, old, end, max([g for _, g in index.meta.generations], default=-1) + 1, live)
            done.append((index.meta.column, rows_between(live, old, end), max(old, end), rows_between(live, max(old, end), 1 << 62)))
        return None if max_rows is None else self.spark.createDataFrame(done, "column_name string, rows_indexed long, hwm_rowid long, remaining_tail long")

    def compact(self, path: str, col: str | None = None, purge: bool = False) -> None:
        """One row for each gram and segment. With purge, row ids that are gone or hold no text leave the lists."""
        for index in [self.find(path, col)] if col is not None else self.of(path) or [self.find(path, col)]:
            meta = index.meta
            lists = index.segments().select("gram", "segment_no", "postings")
            if purge:
                index, files = self._current(index)
                meta = index.meta
                # files never change and null texts were never indexed: what lives are the row ids of the files that are there
                alive = [(int(r.base), int(r.base + r.rows)) for r in files.sort_values("base").itertuples() if r.rows]
                lists = lists.mapInArrow(living(alive), "gram string, segment_no long, postings array<bigint>")
            elif not index.segments().groupBy("gram", "segment_no").count().where("count > 1").limit(1).count():
                if len(meta.generations) <= 1:
                    continue
            name = f"gen-0-{uuid.uuid4().hex}"
            merged = merge_lists(lists.repartitionByRange("gram", "segment_no")).withColumn("generation", F.lit(0))
            merged.sortWithinPartitions("gram", "segment_no").write.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{index.folder}/{name}")
            self._write_ranges(index, name)
            counts = self.spark.read.schema(SEGMENTS).parquet(f"{index.folder}/{name}").groupBy("gram").agg(F.sum("rowid_count").alias("row_count"), F.count("*").alias("segment_count"))
            self._publish(index.folder, replace(meta, generations=[[name, 0]], stats=self._write_stats(index, counts), commit=meta.commit + 1))
            self._sweep(index)

    def drop(self, path: str, column: str) -> None:
        self.drop_by_id(self.find(path, column).meta.index_id)

    def drop_by_id(self, index_id: str) -> None:
        """Never touches a table. An index that can't be read isn't dropped."""
        status = [r for r in self._status() if r[0] == index_id]
        if not status:
            raise IndexError_(f"no index {index_id}")
        if status[0][4] in ("MALFORMED", "MISSING_STORAGE"):
            raise IndexError_(f"index {index_id} is {status[0][4]}: {status[0][5]}")
        name = f"{self.root}/names/{self._name(self.load(index_id).meta)}"
        self.store.delete(f"{self.root}/{index_id}")
        if self.store.exists(name) and self.store.read(name) == index_id:
            self.store.delete(name)

    # watching

    def _status(self) -> list[tuple]:
        rows = []
        for i in self.ids():
            try:
                index = self.load(i)
            except IndexError_ as e:
                rows.append((i, None, None, None, "MALFORMED", str(e)))
                continue
            m = index.meta
            row = (i, m.path, m.column, m.format_version)
            lost = [d for d in (m.stats, m.files, *(g for g, _ in m.generations)) if not self.store.exists(f"{index.folder}/{d}")]
            reason = index.stale_reason()
            if lost:
                rows.append((*row, "MISSING_STORAGE", f"{lost[0]} is gone"))
            elif reason in ("base table is gone", "indexed column is gone"):
                rows.append((*row, "ORPHAN", reason))
            elif reason == "column list changed" or reason == "indexed column has another type":
                rows.append((*row, "REPLACED", reason))
            elif index.state()[1]["changed"].any():
                rows.append((*row, "SCAN_ONLY", "an indexed file was changed"))
            else:
                rows.append((*row, "READY", None))
        return rows

    _STATUS = "index_ref string, path string, column_name string, format_version int, status string, reason string"

    def indexes(self) -> DataFrame:
        return self.spark.createDataFrame(self._status(), self._STATUS)

    def status(self, index_id: str) -> DataFrame:
        return self.indexes().where(F.col("index_ref") == index_id)

    def stats(self, path: str) -> DataFrame:
        """One row for each index of the table, by column."""
        rows = []
        for index in self.of(path):
            m = index.meta
            keys = index.segments().groupBy("gram", "segment_no").agg(F.count("*").alias("n"), F.sum("rowid_count").alias("p"))
            s = keys.agg(F.sum("n"), F.sum((F.col("n") > 1).cast("int")), F.sum("p")).first()
            reason, files = index.state()
            top = tail = None
            if files is not None:
                if files["changed"].any():
                    reason = "an indexed file was changed"
                known, fresh = files[files["known"]], files[~files["known"]]["file"].tolist()
                more = read_base(self.spark, m.path, fresh).count() if fresh else 0
                last = int((known["base"] + known["rows"]).max()) - 1 if len(known) else -1
                top = m.n_rows - 1 + more if more else last
                tail = rows_between(known, m.hwm, 1 << 62) + more
            size = sum(self._bytes(f"{index.folder}/{d}") for d, _ in m.generations)
            rows.append((m.column, m.gram, m.case_insensitive, m.hwm, top, tail, index.stats().count(), s[0] or 0, s[1] or 0, len(m.generations), s[2] or 0, size, reason))
        return self.spark.createDataFrame(rows, "column_name string, gram_size int, case_insensitive boolean, hwm_rowid long, table_max_rowid long, remaining_tail long, distinct_grams long, segments long, fragmented_keys long, generations int, posting_entries long, postings_bytes long, stale_reason string")

    def _bytes(self, path: str) -> int:
        fs, p = self.store._at(path)
        return fs.getContentSummary(p).getLength()


def living(alive: list[tuple[int, int]]):
    """Lists without the row ids outside the ranges [first, end); empty ones go."""
    firsts, ends = (np.array([r[k] for r in alive], np.int64) for k in (0, 1))

    def run(batches):
        for batch in batches:
            lists = batch.column("postings")
            rid = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            of = np.searchsorted(firsts, rid, "right") - 1
            keep = (of >= 0) & (rid < ends[of]) if len(firsts) else np.zeros(len(rid), bool)
            left = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
            new = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))).astype(np.int32)), pa.array(rid[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("segment_no"), new], ["gram", "segment_no", "postings"]).filter(pa.array(left > 0))

    return run


def rows_between(files: pd.DataFrame, lo: int, hi: int) -> int:
    """Rows of the files whose ids are after lo and up to hi."""
    base, rows = files["base"].to_numpy(np.float64).astype(np.int64), files["rows"].to_numpy(np.float64).astype(np.int64)
    return int(np.maximum(0, np.minimum(base + rows - 1, hi) - np.maximum(base - 1, lo)).sum())


def bounded_end(hwm: int, end: int, max_rows: int, shift: int = SHIFT) -> int:
    """The last row id of a bounded refresh: at most max_rows after hwm, back to a segment's end if it crosses one."""
    stop = hwm + max_rows
    if stop >= end:
        return end
    cut = ((stop + 1) >> shift << shift) - 1
    return cut if cut > hwm else stop


__all__ = ["Index", "IndexError_", "Indexes", "Meta", "bounded_end", "rows_between"]
