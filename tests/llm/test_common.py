import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegram.llm import common


def roots_of(edges):
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: find(k) for k in root}


@pytest.mark.parametrize("shape", ["star", "chain", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    if shape == "star":  # a node with very many neighbours
        edges = [(50_000, i) for i in range(100_000) if i != 50_000]
        table = spark.range(100_000).select(F.lit(50_000).cast("long").alias("a"), F.col("id").alias("b"))
    else:
        edges = {"chain": [(i, i + 1) for i in range(60)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], "none": [(3, 3)]}[shape]
        table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in common.components(table, "a", "b", "t").collect()}
    assert got == roots_of(edges)


def test_side(spark, tmp_path, monkeypatch):
    """A file of many blocks and row groups: each row finds its own, whatever the batches."""
    monkeypatch.setattr(common, "BLOCK", 6)
    spark.range(5000).coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/t")
    table = common.with_row_key(spark.read.parquet(f"{tmp_path}/t"), ["id"])
    rows = table.where("id % 3 = 0").select(common.FILE, common.ROW, (F.col("id") * 2).alias("v"))
    side = common.Side(common.write_side(rows.unionByName(rows), "side", table))
    keys = table.toPandas().sample(frac=1, random_state=1)
    for part in np.array_split(keys, 7):
        found = {p: t.column("v").slice(a, b - a).to_pylist() for p, t, a, b in side.rows(part[common.FILE].to_numpy(), part[common.ROW].to_numpy())}
        assert found == {p: [2 * i] * 2 for p, i in enumerate(part["id"].tolist()) if i % 3 == 0}


def test_spark_hash(spark):
    rows = [(0, 0), (-5, 7), (1 << 62, -(1 << 63))]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert got == [common.spark_hash(*r) for r in rows]


def test_discard(spark):
    before = common.written(spark)
    kept, gone = common.new_path(spark, "kept"), common.saved(spark.range(3), "gone")
    common.saved(spark.range(3), "x", kept)
    path = gone.inputFiles()[0]
    common.discard(spark, {*before, kept})
    assert common.written(spark) == {*before, kept}
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()
    common.discard(spark, before)


def test_mapped_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` long, `x``y` long")
    out = common.mapped(df, lambda batches: (pa.RecordBatch.from_arrays([b.column("x`y"), b.column("a.b")], ["a.b", "x`y"]) for b in batches), df.schema)
    assert out.collect()[0].asDict() == {"a.b": 2, "x`y": 1}
