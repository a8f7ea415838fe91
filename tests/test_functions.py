import random

import pytest
from pyspark.sql import functions as F

from lodegram.functions.codec import decode_list, decode_postings, encode_list, encode_postings, posting_count
from lodegram.functions.grams import fold, grams, needle_grams
from lodegram.operators.postings import _windows, gram_counts, merge_lists, pack, pack_segment, packed_chunks, unpack


def one(spark, value, *args):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(grams("t", *args).alias("g")).first().g


@pytest.mark.parametrize(
    ("text", "size", "ci", "want"),
    [
        ("Hello", 3, True, ["hel", "ell", "llo"]),
        ("Hello", 3, False, ["Hel", "ell", "llo"]),
        ("aaaa", 3, True, ["aaa", "aaa"]),
        ("ab", 3, True, []),
        ("", 3, True, []),
        (None, 3, True, None),
        ("a🦆b", 2, True, ["a🦆", "🦆b"]),
        ("ΟΔΥΣ", 2, True, ["οδ", "δυ", "υσ"]),
        ("İx", 2, True, ["ix"]),
        ("abcdefghij", 9, True, ["abcdefghi", "bcdefghij"]),
        ("éa", 2, True, ["é", "́a"]),
    ],
)
def test_grams(spark, text, size, ci, want):
    assert one(spark, text, size, ci) == want


def test_grams_by_row(spark):
    df = spark.createDataFrame([("Hello", 3), (None, 3), ("Hello", 2), ("Hi", 3), ("Hi", None)], "s string, g int")
    got = [r.g for r in df.select(grams("s", F.col("g")).alias("g")).collect()]
    assert got == [["hel", "ell", "llo"], None, ["he", "el", "ll", "lo"], [], None]
    with pytest.raises(ValueError):
        grams("s", 0)
    with pytest.raises(Exception, match="at least 1"):
        df.select(grams("s", F.lit(0)).alias("g")).collect()


def test_needle(spark):
    assert needle_grams(spark, "TeNtTent") == ("tenttent", ["ten", "ent", "ntt", "tte"])
    assert needle_grams(spark, "ab")[1] == []


@pytest.mark.parametrize("rows", [[1, 5, 9], [5, 1, 5, 9, 1], [], [0], [0, 127, 128, 16383, 16384, 4611686018427387904], [9223372036854775807]])
def test_codec(rows):
    assert decode_list(encode_list(rows)) == sorted(set(rows))
    assert posting_count(encode_list(rows)) == len(set(rows))


@pytest.mark.parametrize("raw", [b"garbage", b"\x01\x01" + b"\xff" * 9 + b"\x7f", b"\x01\x01" + b"\x80" * 9 + b"\x01", b"\x01\x02\x05\x00", b"\x01\x02" + b"\xff" * 8 + b"\x7f\x01", b"\x01\x02\x05", b"", b"\x01\x00\x00", b"\x01\x01\x80\x00"])
def test_bad_blobs(raw):
    with pytest.raises(ValueError):
        decode_list(raw)


@pytest.mark.parametrize("rows", [[-1], [1, None]])
def test_bad_lists(rows):
    with pytest.raises(ValueError):
        encode_list(rows)


def test_codec_columns(spark):
    df = spark.createDataFrame([([5, 1, 5],), ([],), (None,)], "r array<bigint>")
    got = df.select(decode_postings(encode_postings("r").alias("b")).alias("d")).collect()
    assert [r.d for r in got] == [[1, 5], [], None]


def test_pack_and_unpack(spark):
    rows = [("abc", 0, 3), ("abc", 0, 1), ("abc", 0, 3), ("abc", 1, 260), ("xyz", 0, 2)]
    df = spark.createDataFrame(rows, "gram string, segment_no long, rid long")
    packed = pack(df)
    assert sorted((r.gram, r.segment_no, list(r.postings), r.rowid_count, r.min_rowid, r.max_rowid) for r in packed.collect()) == [("abc", 0, [1, 3], 2, 1, 3), ("abc", 1, [260], 1, 260, 260), ("xyz", 0, [2], 1, 2, 2)]
    assert sorted(map(tuple, unpack(packed.withColumn("generation", F.lit(0)), 8, 1000).collect())) == sorted(set(rows))
    with pytest.raises(Exception, match="malformed"):
        unpack(packed.withColumn("generation", F.lit(0)), 8, 100).collect()
    with pytest.raises(Exception, match="non-negative"):
        spark.createDataFrame([(-1,)], "rid long").agg(pack_segment()).collect()
    with pytest.raises(Exception, match="not null"):
        spark.createDataFrame([(None,)], "rid long").agg(pack_segment()).collect()
    assert spark.createDataFrame([], "rid long").agg(pack_segment().alias("p")).first().p is None


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7])
def test_windows(size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab🦆é") for _ in range(rng.randrange(12))) for _ in range(60)]
    number, row, names = _windows(texts, size)
    want = sorted((t[i : i + size], n) for n, t in enumerate(texts) for i in range(len(t) - size + 1))
    assert sorted((names[a], b) for a, b in zip(number.tolist(), row.tolist())) == want


def test_chunks_equal_pack(spark):
    texts = [(i, f"row {i % 7} tent {i}") for i in range(300)]
    df = spark.createDataFrame(texts, "rid long, t string").repartition(3)
    got = merge_lists(packed_chunks(df, 3, 6)).collect()
    slow = df.select("rid", F.explode(F.array_distinct(grams(fold("t"), 3))).alias("gram")).withColumn("segment_no", F.shiftright("rid", 6))
    assert sorted((r.gram, r.segment_no, list(r.postings)) for r in got) == sorted((r.gram, r.segment_no, list(r.postings)) for r in pack(slow).collect())


@pytest.mark.parametrize("keys", ["alone", "few", "many"])
def test_gram_counts(spark, monkeypatch, keys):
    """The counts of an explode, which shuffles each gram of each text; here only those of keys with several texts are."""
    from lodegram.operators import postings

    monkeypatch.setattr(postings, "MANY_KEYS", 0 if keys == "many" else 100)
    texts = [(i, f"row {i % 7} tént 🦆 {i}") for i in range(300)] + [(1000, None), (1001, ""), (1002, "ab"), (1003, "aaaa")]
    if keys != "alone":
        texts += [(None, "tent row"), (None, "tent row"), (7, "row tent"), (8, None), (9, "a"), (1003, "aaaaa")]
    df = spark.createDataFrame(texts, "key long, t string").repartition(3)
    got = gram_counts(df, 3)
    want = df.select("key", F.explode(grams("t", 3)).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("n"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want.collect()) and got.dtypes == want.dtypes
    if keys == "alone":
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_packing_memory():
    """What a task holds depends on CHUNK, not on its rows or their sizes."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodegram.operators.postings import _packed_chunks

    rng = np.random.RandomState(5)
    words = np.array(["".join(map(chr, x)) for x in rng.randint(97, 115, (3000, 6))])
    texts = [" ".join(rng.choice(words, 300)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(texts)], ["rid", "t"])
    tracemalloc.start()
    rows = sum(len(b.column("postings").flatten()) for b in _packed_chunks(3, 20)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == sum(len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts) and peak < 120 << 20


def test_many_lists_at_once():
    """The same bytes, lists and errors as one by one."""
    import random

    import numpy as np
    import pytest

    from lodegram.functions.codec import decode_list, decode_lists, encode_list, encode_lists

    rng = random.Random(1)
    lists = [None, [], [0], [5, 1, 5, 9, 1], [0, 127, 128, 16383, 16384, 1 << 62], [(1 << 63) - 1]]
    lists += [[rng.randrange(1 << rng.randrange(1, 63)) for _ in range(rng.randrange(40))] for _ in range(200)]
    blobs = [encode_list(x) for x in lists]
    assert encode_lists([None if x is None else np.array(x, np.int64) for x in lists]) == blobs
    assert [None if x is None else x.tolist() for x in decode_lists(blobs)] == [decode_list(b) for b in blobs]
    small = [b for b in blobs if b is not None and len(b) < 12 and max(decode_list(b), default=0) < 1 << 40]
    assert [x.tolist() for x in decode_lists(small)] == [decode_list(b) for b in small] and decode_lists([]) == encode_lists([]) == []
    for bad in (b"", b"\x02\x00", b"\x01", b"\x01\x01", b"\x01\x02\x05\x00", b"\x01\x01\x80\x00", b"\x01\x01\x05\x05", b"\x01\x01" + b"\xff" * 9 + b"\x7f"):
        with pytest.raises(ValueError):
            decode_lists([encode_list([1, 2]), bad])
    for bad in ([-1], [1, None]):
        with pytest.raises(ValueError):
            encode_lists([np.array([1]), np.array(bad)])
