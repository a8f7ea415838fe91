"""Packing row ids into posting lists by gram and segment, unpacking, uniting and intersecting them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT = 20
#: Bytes of text that a task turns into grams at once, and of a batch that goes to Python.
CHUNK, BATCH_BYTES = 1 << 21, 4 << 20
#: Keys of several texts that are sent to all executors; of more, all counts are shuffled.
MANY_KEYS = 1 << 20


def segment_of(rid: Column | str, shift: int = SHIFT) -> Column:
    return F.shiftright(rid, shift)


def pack_segment(rid: Column | str = "rid", distinct: bool = False) -> Column:
    """Aggregate: struct of postings (sorted, no repeats), rowid_count, min_rowid, max_rowid.

    Null over no rows; a null or negative row id is an error. distinct: the row ids have no repeats.
    """
    rid = F.col(rid) if isinstance(rid, str) else rid
    checked = F.when(rid >= 0, rid).otherwise(F.raise_error(F.lit("row ids must be non-negative and not null")).cast("long"))
    rows = F.sort_array(F.collect_list(checked) if distinct else F.collect_set(checked))
    return F.when(F.count(F.lit(1)) > 0, F.struct(rows.alias("postings"), F.size(rows).cast("long").alias("rowid_count"), F.array_min(rows).alias("min_rowid"), F.array_max(rows).alias("max_rowid")))


def pack(rows: DataFrame) -> DataFrame:
    """(gram, segment_no, rid) to one row for each gram and segment."""
    return rows.groupBy("gram", "segment_no").agg(pack_segment("rid").alias("p")).select("gram", "segment_no", "p.*")


def unpack(segments: DataFrame, shift: int = SHIFT, hwm: int | None = None) -> DataFrame:
    """gram, segment_no, rid: the inverse of pack(). With hwm, counts, bounds, generations, and the segment of each row id are checked."""
    bad = F.col("gram").isNull() | F.col("segment_no").isNull() | F.col("postings").isNull()
    if hwm is not None:
        p = F.col("postings")
        bad = bad | (F.size(p) != F.col("rowid_count")) | (F.element_at(p, 1) != F.col("min_rowid")) | (F.element_at(p, -1) != F.col("max_rowid"))
        bad = bad | (F.size(p) == 0) | (F.col("generation") < 0) | (F.col("max_rowid") > hwm) | (F.shiftright("min_rowid", shift) != F.col("segment_no")) | (F.shiftright("max_rowid", shift) != F.col("segment_no"))
    checked = F.when(bad, F.raise_error(F.lit("a segment row is malformed")).cast("array<bigint>")).otherwise(F.col("postings"))
    return segments.select("gram", "segment_no", F.explode(checked).alias("rid"))


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and how many each has."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    raw = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])) if at[-1] > at[0] else b""
    flat = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    if len(flat) == at[-1] - at[0]:
        return flat, np.diff(at).astype(np.int64)
    begins = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int64)))
    return flat, np.diff(begins[at - at[0]])


def _names(points: np.ndarray) -> pa.Array:
    """Rows of code points as texts."""
    ends = np.cumsum(np.add.reduce(1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000), axis=1), dtype=np.int32)
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(points), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def grams_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """For each gram and text that has it, sorted by both: number of the gram, number of the text, how many windows; and
    the grams. Gram and text are one number, so that one sort of numbers brings the same ones together."""
    flat, lengths = _points(texts)
    n, none = len(flat) - size + 1, np.empty(0, np.int32)
    if n < 1:
        return none, none, none, pa.array([], pa.string())
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    inside = owner[:n] == owner[size - 1 :]
    known = np.zeros(int(flat.max()) + 1, bool)
    known[flat] = True
    letters = np.flatnonzero(known).astype(np.uint32)
    symbol = (np.cumsum(known, dtype=np.uint32) - np.uint32(1))[flat]
    width, row_bits = (int(x).bit_length() for x in (len(letters) - 1, len(lengths) - 1))
    key, bits, prefixes = symbol[:n].astype(np.uint64), width, {}
    for k in range(1, size):
        if bits + width + row_bits > 64:  # what there is of the prefixes is numbered
            prefixes[k] = np.sort(key)
            prefixes[k] = prefixes[k][_firsts(prefixes[k])]
            key, bits = np.searchsorted(prefixes[k], key).astype(np.uint64), (len(prefixes[k]) - 1).bit_length()
        key <<= np.uint64(width)
        key |= symbol[k : k + n]
        bits += width
    if bits + row_bits > 64:
        raise OverflowError("too many texts at once")
    key <<= np.uint64(row_bits)
    key |= owner[:n].view(np.uint32)
    key = key[inside]
    del owner, inside, symbol, flat
    key.sort()
    first = np.flatnonzero(_firsts(key)).astype(np.int32)
    count, key = np.diff(np.append(first, np.int32(len(key)))), key[first]
    row = (key & np.uint64((1 << row_bits) - 1)).astype(np.int32)
    key >>= np.uint64(row_bits)
    new = _firsts(key)
    left, points = key[new], np.empty((int(new.sum()), size), np.uint32)
    del key, first
    for k in range(size - 1, 0, -1):
        points[:, k] = letters[(left & np.uint64((1 << width) - 1)).astype(np.int64)]
        left = left >> np.uint64(width)
        left = prefixes[k][left.astype(np.int64)] if k in prefixes else left
    points[:, 0] = letters[left.astype(np.int64)]
    return np.cumsum(new, dtype=np.int32) - np.int32(1), row, count, _names(points)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Which differ from the one before."""
    return np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]))


def _windows(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all windows of the texts: number of its gram, number of its text; and the grams."""
    number, row, count, names = grams_of(pa.array(texts, pa.string()), size)
    return np.repeat(number, count), np.repeat(row, count), names.to_pylist()


def _portions(batches, column: str):
    """Batches again, of about CHUNK bytes of the column, which has no nulls; a longer text is alone with what came before."""
    wait: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64)
        at = done = 0
        while at < batch.num_rows:
            to = min(batch.num_rows, int(np.searchsorted(ends, done + CHUNK - waiting)) + 1)
            wait.append(batch.slice(at, to - at))
            waiting, done, at = waiting + int(ends[to - 1]) - done, int(ends[to - 1]), to
            if waiting >= CHUNK:
                yield wait
                wait, waiting = [], 0
    if wait:
        yield wait


def _joined(wait: list[pa.RecordBatch], column: str) -> pa.Array:
    parts = [b.column(column) for b in wait]
    return pa.concat_arrays([x if x.type != pa.large_string() else x.cast(pa.string()) for x in parts])


def _packed_chunks(size: int, shift: int):
    def run(batches):
        for wait in _portions(batches, "t"):
            texts, rids = _joined(wait, "t"), _joined(wait, "rid").to_numpy()
            if (rids[1:] < rids[:-1]).any():
                order = np.argsort(rids, kind="stable")
                texts, rids = texts.take(pa.array(order)), rids[order]
            begin = np.flatnonzero(_firsts(rids >> shift))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(rids)]):
                number, row, _, grams = grams_of(texts[lo:hi], size)
                first, rid = np.flatnonzero(_firsts(number)), rids[lo:hi][row]
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rid)).astype(np.int32)), pa.array(rid))
                for a in range(0, len(first), 50_000):
                    part = slice(a, min(a + 50_000, len(first)))
                    yield pa.RecordBatch.from_arrays([grams[part], pa.array(np.full(part.stop - a, rids[lo] >> shift, np.int64)), lists[part]], ["gram", "segment_no", "postings"])

    return run


def _bounded(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow() in batches of BATCH_BYTES, which is set in the session."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def packed_chunks(rows: DataFrame, size: int, shift: int = SHIFT) -> DataFrame:
    """(rid, t), t folded, not null: gram, segment_no, postings, packed within each task, so that what is shuffled
    is lists and not single row ids."""
    return _bounded(rows, _packed_chunks(size, shift), "gram string, segment_no long, postings array<bigint>")


def _counted(size: int):
    def run(batches):
        for wait in _portions(batches, "t"):
            number, row, count, grams = grams_of(_joined(wait, "t"), size)
            key = _joined(wait, "key")
            for a in range(0, len(number), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([key.take(pa.array(row[part])), grams.take(pa.array(number[part])), pa.array(count[part].astype(np.int64))], ["key", "gram", "n"])

    return run


def gram_counts(rows: DataFrame, size: int) -> DataFrame:
    """(key, t), t folded: key, gram, n, the number of windows of all texts of the key. Null texts have none.

    A text's grams are counted where it is read. Only those of keys that several texts have are shuffled.
    """
    rows = rows.where("t is not null")
    schema = f"key {dict(rows.dtypes)['key']}, gram string, n long"
    several = rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("__lg_key"))
    many = several.limit(MANY_KEYS + 1).count()
    if not many:
        return _bounded(rows, _counted(size), schema)
    if many > MANY_KEYS:
        alone, together = None, rows
    else:
        known = F.broadcast(several)
        alone, together = (rows.join(known, F.col("key").eqNullSafe(F.col("__lg_key")), how) for how in ("left_anti", "left_semi"))
    summed = _bounded(together, _counted(size), schema).groupBy("key", "gram").agg(F.sum("n").alias("n"))
    return summed if alone is None else _bounded(alone, _counted(size), schema).unionByName(summed)


def merge_lists(parts: DataFrame) -> DataFrame:
    """One sorted list for each gram and segment of the parts' lists; a row id may be in one of them only."""
    merged = parts.groupBy("gram", "segment_no").agg(F.sort_array(F.flatten(F.collect_list("postings"))).alias("postings"))
    return merged.select("gram", "segment_no", "postings", F.size("postings").cast("long").alias("rowid_count"), F.element_at("postings", 1).alias("min_rowid"), F.element_at("postings", -1).alias("max_rowid"))


def intersect(segments: DataFrame, grams: list[str]) -> DataFrame:
    """rid of the rows that have all the grams: lists of a gram's generations are united, those of
    different grams intersected, segment by segment, so no row id is shuffled on its own."""
    lists = [F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("postings")))).alias(f"g{i}") for i, g in enumerate(grams)]
    by = segments.where(F.col("gram").isin(grams)).groupBy("segment_no").agg(*lists)
    common = F.col("g0")
    repeated = F.size(F.array_distinct("g0")) != F.size("g0")
    for i in range(1, len(grams)):
        common = F.array_intersect(common, F.col(f"g{i}"))
        repeated = repeated | (F.size(F.array_distinct(f"g{i}")) != F.size(f"g{i}"))
    safe = F.when(repeated, F.raise_error(F.lit("a posting list repeats a row id")).cast("array<bigint>")).otherwise(common)
    return by.select(F.explode(safe).alias("rid"))
