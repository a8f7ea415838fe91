import os
import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodegram.plans.accelerate import Accelerator, like_parts
from lodegram.plans.index import IndexError_, Indexes, bounded_end
from lodegram.plans.search import Search, matches, spark_hashes
from lodegram.settings import settings
from lodegram.streaming.refresh import append_and_refresh, refresh_in_steps

DOCS = ["Hello world", "often entered", None, "", "ten cents", "a tent pitched", "TENT SHOUTING", "öft ÖFT often", "contentment", "ab", "connection reset by peer"]
TAIL = ["tail tent row", "tail noise", None]


def add(path, texts, first=0, name="a"):
    os.makedirs(path, exist_ok=True)
    pq.write_table(pa.table({"id": pa.array(range(first, first + len(texts)), pa.int32()), "s": pa.array(texts, pa.string())}), f"{path}/{name}.parquet")


@pytest.fixture
def setup(spark, tmp_path):
    spark.conf.set("lodegram.max_candidate_fraction", "1.0")
    spark.conf.set("lodegram.auto_accelerate", "true")
    path = str(tmp_path / "docs")
    add(path, DOCS)
    yield path, str(tmp_path / "index")
    for k in ("max_candidate_fraction", "auto_accelerate", "max_grams_per_query", "max_probe_rowids"):
        spark.conf.unset(f"lodegram.{k}")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search(spark, setup):
    path, root = setup
    Indexes(spark, root).create(path, "s")
    add(path, TAIL, 11, "b")
    s = Search(spark, root)
    assert ids(s.search(path, "tent")) == [5, 6, 8, 11]
    assert ids(s.search(path, "TENT")) == [5, 6, 8, 11]
    assert ids(s.search(path, "öFT")) == [7]
    assert ids(s.search(path, "ab")) == [9]
    assert ids(s.search(path, "")) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert ids(s.search(path, "zzz")) == []
    assert [r.rid for r in s.candidates(path, "s", "tent").collect()] == [1, 4, 5, 6, 8]
    assert s.candidates(path, "s", "ab").count() == s.candidates(path, "s", "").count() == 11
    assert s.candidates(path, "s", "zzz").count() == 0
    assert s.search(path, "tent").count() == 4
    assert s.search(path, "tent").columns == ["id", "s"]
    assert s.explain(path, "tent")["mode"].startswith("index (<= 5")
    assert "shorter" in s.explain(path, "ab")["mode"]


def test_gates_and_errors(spark, setup):
    path, root = setup
    indexes, s = Indexes(spark, root), Search(spark, root)
    with pytest.raises(IndexError_):
        s.search(path, "tent")
    indexes.create(path, "s")
    with pytest.raises(IndexError_, match="already exists"):
        indexes.create(path, "S")
    for bad in ({"column": "id"}, {"column": "nope"}, {"column": "s", "gram": 0}, {"column": None}):
        with pytest.raises(IndexError_):
            indexes.create(path, **bad)
    with pytest.raises(IndexError_):
        s.search(path, None)
    spark.conf.set("lodegram.max_candidate_fraction", "0.01")
    assert s.explain(path, "tent")["mode"].endswith("candidate fraction exceeded")
    assert ids(s.search(path, "tent")) == [5, 6, 8]
    assert s.candidates(path, "s", "tent").count() == 5
    spark.conf.set("lodegram.max_probe_rowids", "1")
    with pytest.raises(IndexError_, match="work budget"):
        s.candidates(path, "s", "tent")
    assert ids(s.search(path, "tent")) == [5, 6, 8]
    for key, value in (("max_candidate_fraction", "nan"), ("max_grams_per_query", "0"), ("build_partitions", "-1")):
        spark.conf.set(f"lodegram.{key}", value)
        with pytest.raises(ValueError):
            settings(spark)
        spark.conf.unset(f"lodegram.{key}")


def test_rarest(spark, tmp_path, setup):
    _, root = setup
    path = str(tmp_path / "rarest")
    add(path, ["abc bcd cde"] * 100 + ["abcdef"])
    Indexes(spark, root).create(path, "s")
    spark.conf.set("lodegram.max_grams_per_query", "1")
    assert [r.rid for r in Search(spark, root).candidates(path, "s", "abcdef").collect()] == [100]


def test_bounded_refresh(spark, setup, tmp_path):
    _, root = setup
    path = str(tmp_path / "steps")
    indexes = Indexes(spark, root)
    add(path, [f"row {i}" for i in range(10)])
    indexes.create(path, "s")
    add(path, [f"row {i}" for i in range(10, 30)], 10, "b")
    step = lambda n: tuple(indexes.refresh(path, n).first())[1:]
    assert [step(n) for n in (4, 4, 5, 5, 5, 5)] == [(4, 13, 16), (4, 17, 12), (5, 22, 7), (5, 27, 2), (2, 29, 0), (0, 29, 0)]
    add(path, [f"row {i}" for i in range(30, 40)], 30, "c")
    assert step(10**9) == (10, 39, 0)
    with pytest.raises(IndexError_):
        indexes.refresh(path, 0)
    assert ids(Search(spark, root).search(path, "row 1")) == [1, *range(10, 20)]
    assert bounded_end(-1, 3_000_000, 1 << 20) == (1 << 20) - 1
    assert bounded_end((1 << 20) - 1, 3_000_000, (1 << 20) + 5) == (2 << 20) - 1


def test_maintenance(spark, setup):
    path, root = setup
    indexes, s = Indexes(spark, root), Search(spark, root)
    index = indexes.create(path, "s")
    assert index.meta.hwm == 10
    add(path, ["tent number two", None, "ab", "yet another tent"], 20, "b")
    want = [5, 6, 8, 20, 23]
    assert ids(s.search(path, "tent")) == want
    assert indexes.stats(path).first().remaining_tail == 4
    assert indexes.refresh(path) is None
    assert ids(s.search(path, "tent")) == want
    row = indexes.stats(path).first()
    assert (row.generations, row.remaining_tail, row.hwm_rowid, row.table_max_rowid) == (2, 0, 14, 14) and row.fragmented_keys > 0
    entries = row.posting_entries
    indexes.compact(path)
    row = indexes.stats(path).first()
    assert (row.generations, row.fragmented_keys, row.posting_entries) == (1, 0, entries)
    assert ids(s.search(path, "tent")) == want
    os.remove(f"{path}/b.parquet")  # its rows are deleted
    assert ids(s.search(path, "tent")) == [5, 6, 8]
    indexes.compact(path, purge=True)
    assert indexes.stats(path).first().posting_entries < entries
    assert ids(s.search(path, "tent")) == [5, 6, 8]
    add(path, DOCS[:3], 50, "a")  # rewritten in place
    assert ids(s.search(path, "often")) == [51]
    assert "changed" in s.explain(path, "often")["mode"]
    with pytest.raises(IndexError_, match="changed"):
        indexes.refresh(path)
    assert indexes.indexes().first().status == "SCAN_ONLY"
    assert indexes.stats(path).first().stale_reason
    shutil.rmtree(path)
    row = indexes.indexes().first()
    assert row.status == "ORPHAN"
    indexes.drop_by_id(row.index_ref)
    assert indexes.indexes().count() == 0


def test_lifecycle(spark, setup):
    path, root = setup
    indexes = Indexes(spark, root)
    index = indexes.create(path, "s", 2, False)
    assert indexes.status(index.meta.index_id).first().status == "READY"
    assert ids(Search(spark, root).search(path, "TE")) == [6]
    with pytest.raises(IndexError_, match="another writer"):
        indexes._publish(index.folder, index.meta)
    shutil.rmtree(f"{index.folder}/{index.meta.stats}".removeprefix("file://"))
    assert indexes.indexes().first().status == "MISSING_STORAGE"
    with pytest.raises(IndexError_):
        indexes.drop(path, "s")


def test_empty_then_rows(spark, setup, tmp_path):
    _, root = setup
    path = str(tmp_path / "empty")
    add(path, [])
    assert Indexes(spark, root).create(path, "s").meta.hwm == -1
    assert ids(Search(spark, root).search(path, "tent")) == []
    add(path, ["a tent", "b"], 0, "b")
    assert ids(Search(spark, root).search(path, "tent")) == [0]
    assert refresh_in_steps(spark, path, 1, root) == 2
    assert ids(Search(spark, root).search(path, "tent")) == [0]


@pytest.mark.parametrize(
    ("query", "fires"),
    [
        ("SELECT * FROM docs WHERE s LIKE '%tent%'", True),
        ("SELECT * FROM docs WHERE contains(s, 'tent')", True),
        ("SELECT * FROM docs WHERE s ILIKE '%TENT%'", True),
        ("SELECT * FROM docs WHERE s LIKE '%ten%ent%'", True),
        ("SELECT * FROM docs WHERE s RLIKE 'tent'", True),
        ("SELECT id FROM docs WHERE s LIKE '%tent%' AND id > 5", True),
        ("SELECT id FROM docs WHERE s LIKE '%tent%' ORDER BY id LIMIT 2", True),
        ("SELECT count(*) AS id FROM docs WHERE s LIKE '%tent%'", True),
        ("SELECT * FROM docs WHERE s LIKE 'tent%'", False),
        ("SELECT * FROM docs WHERE s LIKE '%tent'", False),
        ("SELECT * FROM docs WHERE s LIKE '%t_nt%'", False),
        ("SELECT * FROM docs WHERE s NOT LIKE '%tent%'", False),
        ("SELECT * FROM docs WHERE s LIKE '%tent%' OR id = 0", False),
        ("SELECT * FROM docs WHERE upper(s) LIKE '%TENT%'", False),
        ("SELECT * FROM docs WHERE s LIKE '%te%'", False),
        ("SELECT * FROM docs WHERE s LIKE '%%'", False),
        ("SELECT * FROM docs WHERE s RLIKE 'te.t'", False),
        ("SELECT a.id FROM docs a JOIN docs b ON a.id = b.id WHERE a.s LIKE '%tent%'", False),
    ],
)
def test_accelerate(spark, setup, query, fires):
    path, root = setup
    Indexes(spark, root).create(path, "s")
    add(path, TAIL, 11, "b")
    engine = Accelerator(spark, root)
    engine.register("docs", path)
    plain = spark.sql(query)
    assert (engine.decide(plain, path)[0] is not None) == fires
    assert ids(engine.sql(query)) == ids(plain)
    spark.conf.set("lodegram.auto_accelerate", "false")
    assert engine.decide(plain, path)[0] is None


def test_dataframe_and_function(spark, setup):
    path, root = setup
    Indexes(spark, root).create(path, "s")
    engine = Accelerator(spark, root)
    assert ids(engine.run(path, lambda t: t.where(F.col("s").contains("tent")))) == [5, 8]
    engine.table_function("find_docs", path, "s")
    assert ids(spark.sql("SELECT id FROM find_docs('TENT')")) == [5, 6, 8]
    assert like_parts("%a%b%") == ["a", "b"] and like_parts("a%") == [] and like_parts(r"%a\%b%") == []


def test_stream(spark, setup, tmp_path):
    path, root = setup
    Indexes(spark, root).create(path, "s")
    add(str(tmp_path / "in"), TAIL, 11)
    stream = spark.readStream.schema("id int, s string").parquet(str(tmp_path / "in"))
    append_and_refresh(spark, stream, path, str(tmp_path / "cp"), root).awaitTermination(120)
    assert Indexes(spark, root).find(path, "s").meta.hwm == 13
    assert ids(Search(spark, root).search(path, "tent")) == [5, 6, 8, 11]


@pytest.mark.parametrize(("size", "ci", "shift"), [(3, True, 20), (2, False, 4), (4, True, 5)])
def test_differential(spark, setup, tmp_path, size, ci, shift):
    _, root = setup
    rng = random.Random(size)
    alphabet = ["ab ", "abcĲĳÖöẞßΣσς füt ", "0123456789abcdef"][size % 3]
    text = lambda: None if rng.random() < 0.04 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(41)))
    texts = [text() for _ in range(400)]
    path = str(tmp_path / "random")
    add(path, texts[:200])
    add(path, texts[200:300], 200, "b")
    Indexes(spark, root).create(path, "s", size, ci, shift)
    add(path, texts[300:], 300, "c")
    s, table = Search(spark, root), spark.read.parquet(path)
    for _ in range(4):
        t = rng.choice([x for x in texts if x and len(x) > size + 2])
        at = rng.randrange(len(t) - size - 1)
        needle = t[at : at + size + rng.randrange(3)]
        assert ids(s.search(path, needle)) == ids(table.where(matches(s.indexes.find(path, "s"), needle)))


@pytest.mark.parametrize("query", ["SELECT count(*), (SELECT count(*) FROM docs) FROM docs WHERE s LIKE '%tent%'", "SELECT id FROM docs WHERE s LIKE '%tent%' AND id > (SELECT avg(id) FROM docs)", "SELECT id FROM docs WHERE s LIKE '%tent%' AND id IN (SELECT max(id) FROM docs WHERE s LIKE '%row%')", "SELECT id, r FROM (SELECT id, rand() < 2 AS r, CAST(id AS STRING) || ' 1 2 3' AS s FROM docs) WHERE s LIKE '%1 2%'", "SELECT id FROM (SELECT id, concat(s, ' xyz') AS s FROM docs) WHERE s LIKE '%xyz%'", "SELECT count(*) FROM docs WHERE s LIKE '%tent%' AND rand(7) < 2", "WITH t AS (SELECT * FROM docs WHERE s LIKE '%tent%') SELECT a.id FROM t a JOIN t b ON a.id = b.id"])
def test_accelerate_same_rows(spark, setup, query):
    path, root = setup
    Indexes(spark, root).create(path, "s")
    add(path, TAIL, 11, "b")
    engine = Accelerator(spark, root)
    engine.register("docs", path)
    assert sorted(map(tuple, engine.sql(query).collect())) == sorted(map(tuple, spark.sql(query).collect()))


def test_any_file_names(spark, setup):
    """Files of any name are searched; those that a scan doesn't read aren't."""
    path, root = setup
    add(path, TAIL, 11, "b")
    add(f"{path}/nested", ["tent in a nested folder"], 90)
    os.rename(f"{path}/a.parquet", f"{path}/part 0 of 100%")
    os.rename(f"{path}/b.parquet", f"{path}/part-00001")
    add(path, ["hidden tent"], 99, "_c")
    Indexes(spark, root).create(path, "s")
    s = Search(spark, root)
    assert ids(s.search(path, "tent")) == ids(spark.read.parquet(path).where("s ILIKE '%tent%'")) == [5, 6, 8, 11]
    add(path, ["one more tent"], 30, "d")
    os.rename(f"{path}/d.parquet", f"{path}/d+e#f")
    assert ids(s.search(path, "tent")) == [5, 6, 8, 11, 30]
    assert Indexes(spark, root).refresh(path, 100).first().rows_indexed == 1
    assert ids(s.search(path, "tent")) == [5, 6, 8, 11, 30]


def test_odd_column_names(spark, setup, tmp_path):
    _, root = setup
    path = str(tmp_path / "names")
    pq.write_table(pa.table({"_metadata": pa.array([1, 2, 3]), "a.b": pa.array(["x", "y", "z"]), "se`lect": pa.array(["a tent", None, "TENT"])}), path + ".parquet")
    Indexes(spark, root).create(path + ".parquet", "se`lect")
    assert sorted(r["_metadata"] for r in Search(spark, root).search(path + ".parquet", "tent").collect()) == [1, 3]
    engine = Accelerator(spark, root)
    engine.register("names", path + ".parquet")
    engine.table_function("find_names", path + ".parquet", "se`lect")
    assert spark.sql("SELECT `a.b` FROM find_names('Tent')").count() == 2


def test_fetch_by_row(spark, setup, tmp_path):
    """Candidates in many files, and in one that is only partly indexed."""
    _, root = setup
    path = str(tmp_path / "many")
    for k in range(100):
        add(path, [f"tent {k}" if i % 7 == k % 7 else f"row {i}" for i in range(20)], 20 * k, f"f{k:03}")
    indexes, s = Indexes(spark, root), Search(spark, root)
    indexes.create(path, "s")
    add(path, [f"tent {i}" if i % 5 == 0 else "row" for i in range(100)], 5000, "g")
    indexes.refresh(path, 50)
    table = spark.read.parquet(path)
    for needle in ("tent", "tent 7", "row 3", "tent 55", "tent 90"):
        assert ids(s.search(path, needle)) == ids(table.where(F.contains("s", F.lit(needle)))), needle
    files = ["file:///a b", "file:///é"]
    rows = [(f, i) for f in files for i in (0, 5, 1 << 40)]
    want = [r[0] for r in spark.createDataFrame(rows, "f string, i long").select(F.xxhash64("f", "i")).collect()]
    assert spark_hashes([f for f, _ in rows], [i for _, i in rows]) == want


def test_memory_gate(spark, setup):
    path, root = setup
    Indexes(spark, root).create(path, "s")
    s = Search(spark, root)
    for budget, reason in ((1, "grams exceed"), (600, "segment exceeds")):
        spark.conf.set("lodegram.max_probe_memory", str(budget))
        try:
            assert (reason in s.explain(path, "tent")["mode"]) == (budget == 1) and ids(s.search(path, "tent")) == [5, 6, 8]
            if budget == 1:
                with pytest.raises(IndexError_, match=reason):
                    s.candidates(path, "s", "tent")
        finally:
            spark.conf.unset("lodegram.max_probe_memory")
    add(path + "2", ["dense tent"] * 200)
    Indexes(spark, root).create(path + "2", "s")
    spark.conf.set("lodegram.max_probe_memory", "2000")
    try:
        assert "segment exceeds" in s.explain(path + "2", "tent")["mode"] and s.search(path + "2", "tent").count() == 200
    finally:
        spark.conf.unset("lodegram.max_probe_memory")


def test_creators_and_sweep(spark, setup):
    """Of two creators of an index one fails; superseded files go, those of the last state but one stay."""
    path, root = setup
    indexes = Indexes(spark, root)
    index = indexes.create(path, "s")
    other = Indexes(spark, root)
    other.of = lambda path: []  # it looked before the first one was there
    with pytest.raises(IndexError_, match="already exists"):
        other.create(path, "S")
    assert len(indexes.ids()) == 1
    for k in range(3):
        add(path, TAIL, 20 + 3 * k, f"t{k}")
        indexes.refresh(path)
    indexes.compact(path)
    names = indexes.store.names(index.folder)
    assert sum(x.startswith("stats-") and not x.endswith("json") for x in names) <= 2 and ids(Search(spark, root).search(path, "tent")) == [5, 6, 8, 20, 23, 26]
    indexes.drop(path, "s")
    indexes.create(path, "s")
    # a table that changes while its index is written gives none
    stale = indexes.find(path, "s")
    add(path, DOCS[:2], 0, "a")
    with pytest.raises(IndexError_, match="while the index was being written"):
        indexes._publish(stale.folder, stale.meta)


def test_sql_surface(spark, setup):
    path, root = setup
    Indexes(spark, root).create(path, "s")
    engine = Accelerator(spark, root)
    engine.register("docs", path)
    assert ids(engine.sql_search("SELECT id FROM search_rows('docs', 'TENT') WHERE id > 5")) == [6, 8]
    assert engine.sql_search("SELECT rid FROM search_candidates('docs', 's', 'tent')").count() == 5
    assert engine.sql_search("SELECT * FROM search_rows('docs', 'it''s')").count() == 0
    [(name, mode, grams)] = engine.explain("SELECT * FROM docs WHERE s LIKE '%tent%'")
    assert name == "docs" and mode.startswith("index") and grams
    assert engine.explain("SELECT * FROM docs WHERE s LIKE 'tent%'")[0][1].endswith("no probeable needle")


def test_rewrite(spark, setup):
    path, root = setup
    indexes = Indexes(spark, root)
    indexes.create(path, "s")
    add(path, TAIL, 11, "b")
    engine = Accelerator(spark, root)
    assert engine.rewrite(path, "s LIKE '%tent row%'", lambda rows: rows.withColumn("s", F.lit("no more"))) == 1
    assert ids(Search(spark, root).search(path, "tent")) == [5, 6, 8] and spark.read.parquet(path).count() == 14
    assert engine.rewrite(path, "s LIKE '%pitched%'", lambda rows: rows.limit(0)) == 1
    indexes.refresh(path)
    assert ids(Search(spark, root).search(path, "tent")) == [6, 8] and spark.read.parquet(path).count() == 13
    assert ids(spark.read.parquet(path).where("s IS NULL")) == [2, 13]
    assert engine.rewrite(path, "s LIKE '%nowhere%'", lambda rows: rows) == 0


def test_copied_in_many_files(spark, tmp_path):
    """A copy of a large table isn't made by four tasks."""
    from lodegram.queries import _copied

    for parts, want in ((1, 4), (7, 7)):
        at = f"{tmp_path}/{parts}"
        spark.range(700).selectExpr("id AS doc_id", "repeat('tent ', 2000) AS text").repartition(parts).write.parquet(f"{at}/documents.parquet")
        before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", "64m")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        try:
            path, _ = _copied(spark, at, f"copied-{parts}")
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", before[0])
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])
        copy = spark.read.parquet(path)
        assert copy.count() == 700 and len(copy.inputFiles()) == want
