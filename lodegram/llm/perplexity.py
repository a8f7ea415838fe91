"""Quality rule by n-gram perplexity: modified Kneser-Ney over characters, counted by Spark.

A gram of up to ORDER characters is one long: BITS of each, the last character lowest. Its suffix and
its context are then a mask and a shift, so that all orders follow from the counts of the highest by
Spark aggregations and joins. The model is kept as arrays sorted by the grams' hashes, by language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegram.llm.common import doc_groups, mapped, mix, new_path, saved

ORDER, BITS = 5, 12
#: Width of the bands in median deviations of log perplexity, each side's own, and characters of a text
#: at which chance widens them by a factor of sqrt(2).
ABOVE, BELOW, SHORT = 5.0, 5.0, 400.0

_ID = np.arange(0x110000, dtype=np.uint32)
_ID = np.where(_ID < 3072, _ID, 3072 + _ID % 1024).astype(np.uint16)
_ID[[9, 10, 11, 12, 13, 0xA0]] = 32
_ID[0x30:0x3A] = 0x30
_ID[0] = 1  # 0 is the padding before a text


#: What pads texts, and what stands for it in texts that hold it.
PAD, NO_PAD = "\U0010ffff", "\U0010fffe"
#: From here on _ID shares its ids; a language that has more characters than that beyond gets ids of its own, of which the
#: last are shared by its rarest characters and by unknown ones.
SHARED, RARE = 3072, 3840


def characters(texts: list[str], table: np.ndarray = _ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts' characters (digits alike, runs of white space as one space), each
    text after ORDER - 1 paddings; and the place of each text's first padding. table: ids by code point."""
    pad = PAD * (ORDER - 1)
    cp = np.frombuffer((pad + pad.join([t.replace(PAD, NO_PAD) for t in texts])).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = table[cp]
    ids[cp == 0x10FFFF] = 0
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 32) | (ids[:-1] != 32)
    ids = ids[keep]
    start = (ids == 0) & np.concatenate(([True], ids[:-1] != 0))
    return ids, np.flatnonzero(start)


def _points(batches):
    """How often a language's texts have each code point."""
    for batch in batches:
        rows: dict[str | None, list[str]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            rows.setdefault(lang, []).append(text)
        for lang, texts in rows.items():
            n = np.bincount(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "cp", "n"])


def number_characters(texts: DataFrame, path: str) -> None:
    """Write ids for the characters of languages that have some from SHARED on, by how often they occur: up to 4096 - SHARED of
    those get one each; a language with more has its RARE - 1 most frequent characters, of all, numbered."""
    wide = texts.where(F.col("text").rlike(rf"[\x{{{SHARED:x}}}-\x{{10ffff}}]"))
    counts = saved(wide.transform(mapped, _points, "lang string, cp int, n long").groupBy("lang", "cp").agg(F.sum("n").alias("n")), "points")
    kinds = counts.where(F.col("cp") >= SHARED).groupBy("lang").agg(F.count("*").alias("kinds"))
    many = F.col("kinds") > 4096 - SHARED
    own = counts.join(kinds, "lang").where(many | (F.col("cp") >= SHARED))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "cp")
    rank = F.row_number().over(order)
    # 0 is the padding and 32 the space
    number = F.when(~many, rank + SHARED - 1).when(rank < 32, rank).when(rank < RARE - 1, rank + 1)
    named = F.concat(F.lit("l-"), F.hex("lang")).alias("l")
    own.select(named, "cp", number.alias("id"), many.alias("many")).where("id is not null").write.partitionBy("l").parquet(f"{path}/ids")


def table_of(path: str, lang: str) -> np.ndarray:
    """A language's ids by code point."""
    fs, base = pafs.FileSystem.from_uri(path)
    where = f"{base}/ids/l=l-{lang.encode().hex().upper()}"
    if fs.get_file_info(where).type != pafs.FileType.Directory:
        return _ID
    t = pads.dataset(where, filesystem=fs, format="parquet").to_table()
    table = _ID.copy()
    if t.column("many")[0].as_py():
        table = (RARE + np.arange(0x110000) % (4096 - RARE)).astype(np.uint16)
    table[t.column("cp").to_numpy()] = t.column("id").to_numpy()
    table[_ID == 32], table[0x30:0x3A] = 32, table[0x30]
    return table


def top_grams(ids: np.ndarray) -> np.ndarray:
    """Grams of ORDER characters that end at each place, from the place ORDER - 1 on."""
    wide = ids.astype(np.uint64)
    n = len(ids) - ORDER + 1
    code = wide[:n].copy()
    for k in range(1, ORDER):
        code <<= np.uint64(BITS)
        code |= wide[k : k + n]
    return code


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(n, first)


def _counted(path: str):
    return lambda batches: _counts(batches, path)


def _counts(batches, path: str):
    """Counts of the top grams by language, added up within the task."""
    tables: dict[str, np.ndarray] = {}
    kept: dict[str | None, tuple[list, list]] = {}
    for batch in batches:
        texts, langs = np.array(batch.column("text").to_pylist(), object), np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for lo, hi in doc_groups(own):
                if lang not in tables:
                    tables[lang] = table_of(path, lang)
                ids, _ = characters(own[lo:hi], tables[lang])
                code = top_grams(ids)
                code = np.sort(code[ids[ORDER - 1 :] != 0])
                if len(code):
                    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                    into = kept.setdefault(lang, ([], []))
                    into[0].append(code[first])
                    into[1].append(np.diff(np.append(first, len(code))))
                    if sum(map(len, into[0])) > 4_000_000:
                        code, n = merged(*into)
                        kept[lang] = ([code], [n])
    for lang, into in kept.items():
        code, n = merged(*into)
        for at in range(0, len(code), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[part]), pa.string()), pa.array(code[part].view(np.int64)), pa.array(n[part])], ["lang", "code", "n"])


def train(spark: SparkSession, docs: DataFrame) -> str:
    """Count all texts and write the model; the path of it.

    Grams of each order have adjusted counts: occurrences at the highest, kinds of characters before them
    below it (the padding is a character too). Each order has three discounts by language.
    """
    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    path = new_path(spark, "model")
    number_characters(texts, path)
    top = saved(texts.transform(mapped, _counted(path), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("code")
        orders[k] = saved(orders[k + 1].groupBy("lang", suffix).agg(F.count("*").alias("n")), "grams")
    below = None
    for k in range(1, ORDER + 1):
        n = orders[k]
        of = [F.sum((F.col("n") == i).cast("long")).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        d = n.groupBy("lang").agg(*of, F.count("*").alias("kinds"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        discount = [F.greatest(F.lit(0.1), F.least(F.coalesce(i - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)), F.lit(i - 0.05))).alias(f"d{i}") for i in (1, 2, 3)]
        d = d.select("lang", *discount, "kinds")
        context = F.shiftright("code", BITS).alias("context")
        with_d = n.select("lang", "code", context, "n").join(d, "lang")
        take = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        with_d = with_d.withColumn("d", take)
        mass = with_d.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("d").alias("left"))
        with_d = with_d.join(mass, ["lang", "context"])
        if below is None:
            lower = 1 / (F.col("kinds") + 1.0)
        else:
            suffix = F.col("code").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))
            with_d = with_d.withColumn("suffix", suffix).join(below.select("lang", F.col("code").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
            lower = F.col("lower")
        below = saved(with_d.select("lang", "code", ((F.col("n") - F.col("d") + F.col("left") * lower) / F.col("all")).alias("p")), f"p{k}")
        # lang is "" where unknown, which a folder's name can't be
        named = F.concat(F.lit("l-"), F.hex("lang")).alias("l")
        below.select(named, "code", F.log("p").cast("float").alias("p")).write.partitionBy("l").parquet(f"{path}/p{k}")
        mass.select(named, F.col("context").alias("code"), F.log(F.col("left") / F.col("all")).cast("float").alias("p")).write.partitionBy("l").parquet(f"{path}/b{k}")
    return path


class Hashed:
    """Grams and their values, sorted by hash. A table of where each hash prefix begins makes a look-up
    a few steps."""

    def __init__(self, code: np.ndarray, value: np.ndarray) -> None:
        key = mix(code.view(np.uint64))
        order = np.argsort(key)
        self.key = np.append(key[order], np.uint64(0))
        self.value = np.append(value[order], np.float32(np.nan))
        bits = max(1, int(len(code)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.key[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        key = mix(code)
        prefix = (key >> self.shift).astype(np.int64)
        at, end = self.start[prefix], self.start[prefix + 1]
        out = np.full(len(code), np.nan, np.float32)
        open_ = np.arange(len(code))
        while len(open_):
            open_ = open_[at[open_] < end[open_]]
            hit = self.key[at[open_]] == key[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit]
            at[open_] += 1
        return out


class Model:
    """One language's arrays; other languages' are not read."""

    def __init__(self, path: str, lang: str) -> None:
        fs, base = pafs.FileSystem.from_uri(path)
        folder = f"l=l-{lang.encode().hex().upper()}"

        def load(name: str) -> Hashed:
            where = f"{base}/{name}/{folder}"
            if fs.get_file_info(where).type != pafs.FileType.Directory:
                return Hashed(np.empty(0, np.int64), np.empty(0, np.float32))
            t = pads.dataset(where, filesystem=fs, format="parquet").to_table(columns=["code", "p"])
            return Hashed(t.column("code").to_numpy(), t.column("p").to_numpy())

        self.table = table_of(path, lang)
        self.p = {k: load(f"p{k}") for k in range(1, ORDER + 1)}
        self.b = {k: load(f"b{k}") for k in range(1, ORDER + 1)}

    def log_p(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character after the others, backing off where a gram is unknown."""
        out, left, lost = np.zeros(len(code), np.float32), np.arange(len(code)), np.zeros(len(code), np.float32)
        for k in range(ORDER, 0, -1):
            own = code[left] & np.uint64((1 << (BITS * k)) - 1)
            p = self.p[k].find(own)
            known = ~np.isnan(p)
            out[left[known]] = lost[left[known]] + p[known]
            left = left[~known]
            if not len(left):
                return out
            b = self.b[k].find(own[~known] >> np.uint64(BITS))
            lost[left] += np.where(np.isnan(b), np.float32(0), b)
        out[left] = lost[left] - np.float32(np.log(1 << BITS))
        return out


def text_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters, and mean negative log probability of one (NaN for none)."""
    ids, start = characters(texts, model.table)
    code = top_grams(ids)
    real = ids[ORDER - 1 :] != 0
    lp = np.zeros(len(ids), np.float64)
    lp[ORDER - 1 :][real] = -model.log_p(code[real])
    n = np.add.reduceat((ids != 0).astype(np.int64), start)
    with np.errstate(invalid="ignore"):
        return n, np.add.reduceat(lp, start) / n


def _scored(path: str):
    def run(batches):
        models: dict[str, Model] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            n, h = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
            for lang in dict.fromkeys(langs):
                at = np.array([i for i, x in enumerate(langs) if x == lang and texts[i]], int)
                if len(at) and (lang or "") not in models:
                    models[lang or ""] = Model(path, lang or "")
                for lo, hi in doc_groups([texts[i] for i in at], 1 << 20):
                    n[at[lo:hi]], h[at[lo:hi]] = text_scores(models[lang or ""], [texts[i] for i in at[lo:hi]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(n), pa.array(h, mask=n == 0)], ["doc_id", "lang", "n", "h"])

    return run


def perplexity(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, verdict ('keep', 'low', 'high') for each row of docs.

    The model is counted on all texts of docs, each language on its own (a null lang is one too); repeated
    rows count as often as they occur. A language's band is around the median of log perplexity of all
    its documents: up to ABOVE times the median deviation of those above it, down to BELOW times that of those below it, wider
    for short texts, whose means vary more: times sqrt(1 + SHORT / characters). A language with more than 1,024 different
    characters from U+0C00 on has its most frequent ones numbered, the rarest share numbers; U+10FFFF counts as U+10FFFE. Texts outside are rejected: 'low' for repetitive ones, 'high'
    for ones unlike their language. A null or empty text has a null perplexity and is kept. Columns other
    than doc_id, lang and text aren't read.
    """
    path = train(spark, docs)
    kinds = dict(docs.dtypes)
    scores = saved(docs.select("doc_id", "lang", "text").transform(mapped, _scored(path), f"doc_id {kinds['doc_id']}, lang string, n long, h double"), "scores")
    middle = scores.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("h", 0.5, 100_000).alias("m"))
    off = scores.join(middle, F.col("lang").eqNullSafe(F.col("l"))).select("l", "m", (F.col("h") - F.col("m")).alias("off"))
    half = lambda c: F.percentile_approx(F.when(c > 0, c), 0.5, 100_000)
    bands = off.groupBy("l").agg(F.max("m").alias("m"), half(F.col("off")).alias("up"), half(-F.col("off")).alias("down"))
    wider = F.sqrt(1 + F.lit(SHORT) / F.greatest("n", F.lit(1)))
    verdict = F.when(F.col("h") > F.col("m") + ABOVE * F.col("up") * wider, "high").when(F.col("h") < F.col("m") - BELOW * F.col("down") * wider, "low").otherwise("keep")
    return scores.join(bands, F.col("lang").eqNullSafe(F.col("l"))).select("doc_id", "lang", F.col("n").alias("n_chars"), F.round(F.exp("h"), 4).alias("perplexity"), verdict.alias("verdict"))
