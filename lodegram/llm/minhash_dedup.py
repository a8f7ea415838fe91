"""MinHash near-dedup by min-max hashing: the minimum and the maximum under each permutation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegram.llm.common import FILE, ROW, Words, components, doc_groups, mapped, mix, repeat_rows, saved, stored, with_row_key, write_side

SHINGLE = 3
PERMUTATIONS = 64  # 128 values, 2 of each
ROWS = 4  # values in a band
VALUES = 2 * PERMUTATIONS
BANDS = VALUES // ROWS
MIN_AGREE = 0.5

_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64))


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of documents that have the words first[i] to first[i+1], and where each
    document's begin. A document with fewer words than SHINGLE has one shingle, if it has a word."""
    n = np.diff(first)
    per = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begins = np.concatenate(([0], np.cumsum(per)))
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], per) + np.repeat(first[:-1], per)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    left = np.repeat(n, per)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        own = padded[at + k]
        if k:
            own = np.where(left > k, own, np.uint64(0))
        h = h * np.uint64(0x100000001B3) + own
    return mix(h), begins


def signatures(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, VALUES) of 16 bits; rows of documents without a word are 0."""
    h, begins = shingles(words, first)
    out = np.zeros((len(first) - 1, VALUES), np.uint16)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        at = begins[full]
        # parts of documents that stay in the CPU's cache
        for p in range(PERMUTATIONS):
            v = h * _FACTORS[p] + _TERMS[p]
            out[full, 2 * p] = (mix(np.minimum.reduceat(v, at)) >> np.uint64(48)).astype(np.uint16)
            out[full, 2 * p + 1] = (mix(np.maximum.reduceat(v, at)) >> np.uint64(48)).astype(np.uint16)
    return out


def text_signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and which documents have a word."""
    words = Words("\n".join(texts))
    lines = np.concatenate(([0], np.cumsum([t.count("\n") + 1 for t in texts])))
    first = words.first[lines]
    return signatures(words.hash, first), np.diff(first) > 0


def _signed(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in doc_groups(texts, 1 << 19):
            sig, full = text_signatures(texts[lo:hi])
            at = np.flatnonzero(full)
            raw = sig[at].astype("<u2")
            take = pa.array(at + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("doc_id", FILE, ROW)] + [pa.array([x.tobytes() for x in raw], pa.binary())],
                ["doc_id", FILE, ROW, "sig"],
            )


def _shared(batches):
    """Rows whose key another row has too."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    _, back, n = np.unique(t.column("k").to_numpy(), return_inverse=True, return_counts=True)
    yield from t.filter(pa.array(n[back] > 1)).to_batches(max_chunksize=100_000)


def linked(sigs: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect those of the signatures whose agreement makes them near copies.

    Not all pairs are given, but the components are those of all pairs: members that agree with a
    leader are linked to it; what is then apart is compared in full across the parts.
    """
    need = MIN_AGREE * sigs.shape[1]
    edges, parts, left = [], [], np.arange(len(sigs))
    while len(left):
        hit = (sigs[left] == sigs[left[0]]).sum(1) >= need
        parts.append(left[hit])
        edges += [(int(left[0]), int(x)) for x in left[hit][1:]]
        left = left[~hit]
    for i, part in enumerate(parts[:-1]):
        rest = parts[i + 1 :]
        other, of = np.concatenate(rest), np.repeat(np.arange(len(rest)), [len(x) for x in rest])
        seen: set[int] = set()
        for x in part:
            for y in np.flatnonzero((sigs[other] == sigs[x]).sum(1) >= need):
                if of[y] not in seen:
                    seen.add(of[y])
                    edges.append((int(x), int(other[y])))
    return edges


def _edges(batches):
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    k = t.column("k").to_numpy()
    f, r = t.column(FILE).to_numpy(), t.column(ROW).to_numpy()
    raw = b"".join(t.column("sig").to_pylist())
    every = np.frombuffer(raw, "<u2").reshape(-1, VALUES)
    order = np.lexsort((r, f, k))
    cuts = np.flatnonzero(np.diff(k[order])) + 1
    found = set()
    for group in np.split(order, cuts):
        if len(group) > 1:
            for a, b in linked(every[group]):
                a, b = group[a], group[b]
                found.add((int(f[a]), int(r[a]), int(f[b]), int(r[b])))
    rows = list(found)
    for at in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 100_000])], ["f1", "r1", "f2", "r2"])


def near_groups(spark: SparkSession, docs: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """For each row with a word: FILE, ROW, doc_id, keep_doc_id, keep. See near_duplicates() and dedup_near()."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = with_row_key(docs, ["doc_id", "text"]).where("text is not null")
    signed = keyed.transform(mapped, _signed, f"doc_id {kind}, {FILE} long, {ROW} long, sig binary")
    if origin is not None:
        made = origin.where("doc_id is not null and text is not null").select("doc_id", "text", F.lit(0).cast("long").alias(FILE), F.lit(0).cast("long").alias(ROW))
        before = made.transform(mapped, _signed, f"doc_id {kind}, {FILE} long, {ROW} long, sig binary").groupBy("doc_id").agg(F.min("sig").alias("sig"), F.max("sig").alias("other")).where("sig = other")
        signed = signed.unionByName(with_row_key(docs, ["doc_id"]).join(before.select("doc_id", "sig"), "doc_id")).distinct()
    signed = saved(signed.select("*", F.xxhash64("sig").alias("h1"), F.xxhash64(F.lit(1), "sig").alias("h2")), "sigs")
    owner = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", FILE, ROW)
    kinds = saved(signed.groupBy("h1", "h2").agg(F.min(owner).alias("own"), F.max("sig").alias("sig")), "kinds")
    sig_of = kinds.select(F.col("own")[FILE].alias(FILE), F.col("own")[ROW].alias(ROW), "sig")

    width = 2 * ROWS
    bands = sig_of.select(F.explode(F.array([F.xxhash64(F.lit(i), F.substring("sig", width * i + 1, width)) for i in range(BANDS)])).alias("k"), FILE, ROW)
    shared = bands.repartition("k").transform(mapped, _shared, f"k long, {FILE} long, {ROW} long")
    edges = shared.join(sig_of, [FILE, ROW]).repartition("k").transform(mapped, _edges, "f1 long, r1 long, f2 long, r2 long").distinct()
    node = lambda a, b: F.struct(F.col(a).alias("f"), F.col(b).alias("r"))
    edges = edges.select(node("f1", "r1").alias("a"), node("f2", "r2").alias("b"))
    if origin is not None:  # a row's two signatures belong together
        edges = edges.unionByName(signed.join(kinds, ["h1", "h2"]).select(node(FILE, ROW).alias("a"), node(f"own.{FILE}", f"own.{ROW}").alias("b")).where("a <> b"))
    groups = components(edges, "a", "b", "docs-cc")

    own = kinds.select("h1", "h2", "own", node(f"own.{FILE}", f"own.{ROW}").alias("node"))
    rooted = own.join(groups, "node", "left").select("h1", "h2", "own", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("own").alias("keep"))
    decided = rooted.join(best, "root").select("h1", "h2", F.col("keep").alias("best"))
    found = signed.join(decided, ["h1", "h2"]).select(FILE, ROW, "doc_id", F.col("best.doc_id").alias("keep_doc_id"), owner.eqNullSafe(F.col("best")).alias("keep"))
    return found if origin is None else found.distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_doc_id (the document of its group that stays), keep: one row for each row of docs.

    A document's shingles are the SHINGLE words in a row of its normalised text (lower case, digits
    as 0, no ASCII punctuation); its signature has the minimum and the maximum of their hashes under
    each of PERMUTATIONS permutations. Two are near copies if they agree in one of BANDS bands of
    ROWS values and in MIN_AGREE of all values; groups are connected components. The row with the
    least (doc_id, file, row) stays, a null doc_id last; repeated rows are copies of each other.
    A document with fewer words has one shingle of all; one without a word (null or empty text) is
    in no group and stays. Other columns aren't read.
    """
    docs = stored(docs.select("doc_id", "text"))
    groups = near_groups(spark, docs)
    rest = with_row_key(docs, ["doc_id"])
    known = groups.select(FILE, ROW, "keep_doc_id", "keep")
    return rest.join(known, [FILE, ROW], "left").select("doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep_doc_id")).alias("keep_doc_id"), F.coalesce("keep", F.lit(True)).alias("keep"))


def dedup_near(spark: SparkSession, docs: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; columns, of whatever names, and texts as they were.

    origin: doc_id and text as they were before other stages cut the texts. Rows are then near copies also if those texts
    are, so that a copy of which line dedup has left a few lines is still found. A doc_id that has several
    texts there, or none, counts by its text in docs alone. Null and empty texts, ties, repeated rows and
    empty tables are as in near_duplicates().
    """
    docs = stored(docs)
    gone = near_groups(spark, docs, origin).where("not keep").select(FILE, ROW, F.lit(0).alias("n"))
    return repeat_rows(docs, write_side(gone, "near", docs), "n", 1)
