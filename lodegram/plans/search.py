"""Exact substring search: probe the rarest grams, read the rows that may match, and test each again.

What can't be proven safe or cheap ends in one full scan of the table, never in a lost row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegram.functions.grams import fold, needle_grams
from lodegram.operators.postings import intersect
from lodegram.plans.index import RID, Index, IndexError_, Indexes
from lodegram.settings import settings
from lodegram.sources.store import file_of, quoted, read_base, row_of

#: Candidates up to so many are fetched by row number, wherever they are; of more only the files that hold them are
#: known, which are then searched whole.
FETCH = 20_000
#: Row ids up to so many are read and intersected by the driver, which needs no job for them.
LOCAL_IDS = 1 << 21


@dataclass(frozen=True)
class Plan:
    """How a search runs. reason: why it scans all (None if it probes)."""

    reason: str | None
    grams: tuple[str, ...] = ()
    segments: int = 0
    bound: int = 0
    decoded: int = 0
    files: pd.DataFrame | None = None
    kept: tuple[int, ...] = ()

    def mode(self) -> str:
        return f"full scan fallback: {self.reason}" if self.reason else f"index (<= {self.bound} candidates, {self.decoded} decoded rowids)"


def probe(index: Index, grams: list[str], dense: bool = True) -> Plan:
    """Statistics of the grams, the rarest of them, segments that have them all, and whether that is cheap enough.

    Only counts are read. dense: apply the limit on the share of candidates.
    """
    s = settings(index.spark)
    reason, files = index.state()
    if reason:
        return Plan(f"index stale: {reason}")
    if files["changed"].any():
        return Plan("file guard: an indexed file was changed")
    if not grams:
        return Plan("needle shorter than gram size", files=files)
    if sum(256 + 4 * len(g) for g in grams) > s.max_probe_memory:
        return Plan("the needle's grams exceed the probe's memory", files=files)
    known = index.lookup(index.meta.stats, grams, ["gram", "row_count", "segment_count"])
    known = known if known is not None else index.stats().where(F.col("gram").isin(grams)).toPandas()
    if known["row_count"].isna().any() or (known["row_count"] < 1).any():
        raise IndexError_("the gram statistics are malformed")
    counts = {r.gram: r for r in known.itertuples()}
    if len(counts) < len(grams):
        return Plan(None, tuple(g for g in grams if g not in counts)[:1], files=files)
    rare = sorted(grams, key=lambda g: counts[g].row_count)[: s.max_grams_per_query]
    lists = _manifest(index, rare)
    if lists["rowid_count"].sum() != sum(counts[g].row_count for g in rare) or len(lists) != sum(counts[g].segment_count for g in rare):
        raise IndexError_("the postings don't agree with the gram statistics")
    own = lists.groupby(["segment_no", "gram"])["rowid_count"].sum().unstack()
    own = own[own.notna().all(axis=1)] if own.shape[1] == len(rare) else own.iloc[:0]
    plan = Plan(None, tuple(rare), len(own), int(own.min(axis=1).sum()), int(own.sum().sum()), files, tuple(own.index.tolist()))
    if plan.decoded > s.max_probe_rowids:
        return Plan("decoded-rowid work budget exceeded", files=files)
    if dense and plan.bound > s.max_candidate_fraction * index.meta.n_rows:
        return Plan("candidate fraction exceeded", files=files)
    # a task holds a segment's lists and what they have in common
    if len(own) and 8 * int((own.sum(axis=1) + own.min(axis=1)).max()) > s.max_probe_memory:
        return Plan("a posting segment exceeds the probe's memory", files=files)
    return plan


def _manifest(index: Index, grams: list[str]) -> pd.DataFrame:
    """gram, segment_no, rowid_count of the grams' lists; no list is read."""
    columns, parts = ["gram", "segment_no", "rowid_count"], []
    for name, _ in index.meta.generations:
        own = index.lookup(name, grams, columns)
        if own is None:
            return index.segments().where(F.col("gram").isin(grams)).select(columns).toPandas()
        parts.append(own)
    return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in columns})


def _found(index: Index, plan: Plan) -> DataFrame | None:
    """rid of the candidates; None if there is none. Only segments that have all grams are read."""
    if not plan.segments:
        return None
    lists = index.segments()
    kept = index.spark.createDataFrame(pd.DataFrame({"segment_no": np.array(plan.kept, np.int64)}))
    return intersect(lists.join(F.broadcast(kept), "segment_no", "left_semi"), list(plan.grams)).where(F.col("rid") <= index.meta.hwm)


def _ids(index: Index, plan: Plan) -> np.ndarray | None:
    """The candidates' row ids in order, where the driver can hold them; None if there are too many."""
    if not plan.segments:
        return np.empty(0, np.int64)
    if plan.decoded <= LOCAL_IDS:
        parts = [index.lookup(name, list(plan.grams), ["gram", "segment_no", "postings"]) for name, _ in index.meta.generations]
        if all(p is not None for p in parts):
            lists = pd.concat(parts)
            lists = lists[lists["segment_no"].isin(plan.kept)]
            common = None
            for g in plan.grams:
                own = np.concatenate([np.empty(0, np.int64), *lists[lists["gram"] == g]["postings"]])
                unique = np.unique(own)
                if len(unique) != len(own):
                    raise IndexError_("a posting list repeats a row id")
                common = unique if common is None else np.intersect1d(common, unique, assume_unique=True)
            return common[common <= index.meta.hwm]
    if plan.bound > FETCH:
        return None
    return np.array(sorted(r.rid for r in _found(index, plan).collect()), np.int64)


def pruned(index: Index, plan: Plan) -> DataFrame:
    """The table without the rows that can't match: candidates, and all that isn't indexed yet.

    It is the table's own scan under a filter by file, and by row where that is known. The filter stands below any
    predicate that is put on top, so that the predicate is only computed for candidates.
    """
    meta, files = index.meta, plan.files
    base = read_base(index.spark, meta.path)
    file, row = file_of(base), row_of(base)
    fresh = files[~files["known"]]["file"].tolist()
    known = files[files["known"]].astype({"base": "int64", "rows": "int64"})
    partly = known[known["base"] + known["rows"] - 1 > meta.hwm]
    whole, tests = [*fresh, *partly[partly["base"] > meta.hwm]["file"]], []
    for r in partly[partly["base"] <= meta.hwm].itertuples():
        tests.append((file == r.file) & (row > meta.hwm - r.base))
    wanted = {*whole, *partly["file"]}
    if len(known):
        firsts, ends = known["base"].to_numpy(), (known["base"] + known["rows"]).to_numpy()
        names = known["file"].to_numpy(object)
        ids = _ids(index, plan)
        if ids is None:
            of = np.array([r.f for r in _found(index, plan).mapInArrow(_files_of(firsts, ends), "f int").distinct().collect()], np.int64)
        else:
            of = np.searchsorted(firsts, ids, "right") - 1
            alive = (of >= 0) & (ids < ends[of])
            ids, of = ids[alive], of[alive]
        own = names[np.unique(of)].tolist()
        wanted |= {*own}
        if ids is not None and len(ids) <= FETCH:
            rows = (ids - firsts[of]).tolist()
            if len(own) == 1:
                tests.append((file == own[0]) & row.isin(rows))
            elif own:
                # a hash of both; another row that has it by chance is tested like any candidate
                keys = spark_hashes(names[of].tolist(), rows)
                tests.append(F.xxhash64(file, row).isin(keys))
        else:
            # in the files that aren't indexed to their ends, rows after the mark are wanted anyway
            whole += own
    if not wanted:
        return base.where("false")
    out = base.where(file.isin(sorted(wanted)))
    if whole and tests:
        tests.append(file.isin(whole))
    return out.where(_any(tests)) if tests else out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def spark_hashes(files: list[str], rows: list[int]) -> list[int]:
    """xxhash64(file, row) as Spark computes it: of the file's bytes, and of the row with that as its seed."""
    seeds = {f: xxhash.xxh64_intdigest(f.encode(), 42) for f in set(files)}
    found = [xxhash.xxh64_intdigest(r.to_bytes(8, "little"), seeds[f]) for f, r in zip(files, rows)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _files_of(firsts: np.ndarray, ends: np.ndarray):
    """Numbers of the files that hold row ids."""

    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            of = np.searchsorted(firsts, rid, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(of[(of >= 0) & (rid < ends[of])]).astype(np.int32))], ["f"])

    return run


def matches(index: Index, needle: str) -> Column:
    """The predicate that every result is tested with: the index's case rule; null text never matches."""
    c = F.col(quoted(index.meta.column))
    return F.contains(fold(c), fold(F.lit(needle))) if index.meta.case_insensitive else F.contains(c, F.lit(needle))


class Search:
    """Explicit search over the indexes under a folder."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.indexes = spark, Indexes(spark, root)

    def plan(self, path: str, needle: str, col: str | None = None) -> tuple[Index, Plan]:
        if path is None or needle is None:
            raise IndexError_("table and needle must not be null")
        if col == "":
            raise IndexError_("the column must not be empty")
        index = self.indexes.find(path, col)
        _, grams = needle_grams(self.spark, needle, index.meta.gram, index.meta.case_insensitive)
        return index, probe(index, grams)

    def search(self, path: str, needle: str, col: str | None = None) -> DataFrame:
        """All rows of the table whose text has the needle, with all columns.

        An empty needle is in every text; one shorter than a gram, and whatever the settings or the state
        of the files forbid to probe, is a full scan. col is needed if the table has several indexes.
        """
        index, plan = self.plan(path, needle, col)
        base = read_base(self.spark, index.meta.path) if plan.reason else pruned(index, plan)
        return base.where(matches(index, needle))

    def candidates(self, path: str, column: str, needle: str) -> DataFrame:
        """rid of the indexed rows that may match, in order; nothing is tested.

        A short needle or an unsafe file list gives every row id up to the mark; a stale table or an exceeded limit is
        an error; the limit on the share of candidates doesn't hold.
        """
        index = self.indexes.find(path, column)
        _, grams = needle_grams(self.spark, needle, index.meta.gram, index.meta.case_insensitive)
        plan = probe(index, grams, dense=False)
        if plan.reason == "needle shorter than gram size" or (plan.reason or "").startswith("file guard"):
            live = plan.files if plan.files is not None else index.state()[1]
            live = live[live["known"] & (live["base"] <= index.meta.hwm)]
            files = self.spark.createDataFrame(live[["base", "rows"]].astype("int64"), "base long, rows long") if len(live) else self.spark.createDataFrame([], "base long, rows long")
            span = F.sequence(F.col("base"), F.least(F.col("base") + F.col("rows") - 1, F.lit(index.meta.hwm)))
            return files.select(F.explode(span).alias("rid")).orderBy("rid")
        if plan.reason:
            raise IndexError_(plan.reason)
        found = _found(index, plan)
        return (found if found is not None else self.spark.createDataFrame([], "rid long")).orderBy("rid")

    def explain(self, path: str, needle: str, col: str | None = None) -> dict:
        """mode, grams probed, segments, bound of the candidates, decoded row ids."""
        _, plan = self.plan(path, needle, col)
        return {"mode": plan.mode(), "grams": list(plan.grams), "segments": plan.segments, "candidates_bound": plan.bound, "decoded_rowids": plan.decoded}


__all__ = ["RID", "Plan", "Search", "matches", "probe", "pruned"]
