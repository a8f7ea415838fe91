"""The engine's registered queries, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegram.functions.codec import decode_postings, encode_postings
from lodegram.functions.grams import fold
from lodegram.operators.postings import gram_counts, pack, unpack
from lodegram.plans.accelerate import Accelerator
from lodegram.plans.index import Indexes
from lodegram.plans.search import Search
from lodegram.settings import PREFIX
from lodegram.sources.store import Store, index_root
from lodegram.streaming.refresh import append_and_refresh

_built: dict[tuple, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession, tag: str) -> str:
    return f"{index_root(spark)}/{spark.sparkContext.applicationId}/{tag}"


@contextlib.contextmanager
def _settings(spark: SparkSession, **values):
    """Settings for what is planned inside; then they are as before."""
    before = {k: spark.conf.get(PREFIX + k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(PREFIX + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(PREFIX + k) if v is None else spark.conf.set(PREFIX + k, v)


def _forced(spark: SparkSession):
    """The limit on the share of candidates is lifted, so that the queries go through the index at any size."""
    return _settings(spark, max_candidate_fraction="1.0", auto_accelerate="true")


def _indexed(spark: SparkSession, path: str, column: str, gram: int = 3, case_insensitive: bool = True) -> str:
    """A folder with an index on the column, built once in a session."""
    key = (spark.sparkContext.applicationId, path, column, gram, case_insensitive)
    if key not in _built or not Store(spark).exists(_built[key]):
        root = _root(spark, f"q{len(_built)}")
        Indexes(spark, root).create(path, column, gram, case_insensitive)
        _built[key] = root
    return _built[key]


def _search(needle: str, table: str = "documents", column: str = "text", key: str | None = "doc_id", case_insensitive: bool = True, gram: int = 3, **limits: str):
    """limits: settings of the gates; without any, the index is used."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/{table}.parquet"
        root = _indexed(spark, path, column, gram, case_insensitive)
        with _settings(spark, **limits) if limits else _forced(spark):
            found = Search(spark, root).search(path, needle)
        return found.select(key) if key else found

    return run


def _engine(spark: SparkSession, sf_dir: str) -> Accelerator:
    path = f"{sf_dir}/documents.parquet"
    engine = Accelerator(spark, _indexed(spark, path, "text"))
    engine.register("documents", path)
    _table(spark, sf_dir, "labels").createOrReplaceTempView("labels")
    return engine


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir)
        with _forced(spark):
            return engine.sql_search(text)

    return run


def _grams(size: int, case_insensitive: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        return gram_counts(docs.select(F.col("doc_id").alias("key"), (fold("text") if case_insensitive else F.col("text")).alias("t")), size).withColumnRenamed("key", "doc_id")

    return run


def _grams_sql(size: int, case_insensitive: bool) -> str:
    text = "lower(text)" if case_insensitive else "text"
    return f"SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(t) - {size - 2}), lambda i: substring(t, i, {size}))) AS gram FROM (SELECT doc_id, {text} AS t FROM documents) WHERE length(t) >= {size}) GROUP BY doc_id, gram"


def gram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return Indexes(spark, _indexed(spark, path, "text")).find(path, "text").stats().select("gram", "row_count")


def segments_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    segments = Indexes(spark, _indexed(spark, path, "text")).find(path, "text").segments()
    return segments.groupBy("gram").agg(F.sum("rowid_count").alias("row_count"), (F.max("max_rowid") >= F.min("min_rowid")).alias("ordered"))


def candidates_all_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    root = _indexed(spark, path, "text")
    with _settings(spark, max_grams_per_query="1000"):
        found = Search(spark, root).candidates(path, "text", "license")
    rows = spark.read.parquet(path).select("doc_id", F.col("_metadata.row_index").alias("rid"))
    return rows.join(found, "rid").select("doc_id")


def _copied(spark: SparkSession, sf_dir: str, tag: str) -> tuple[str, str]:
    """Folders for a copy of documents, which is written in several files, as many as the scan has tasks, and for its index."""
    n = len(Store(spark).names(_root(spark, tag)))
    path = f"{_root(spark, tag)}/{n}/table"
    docs = _table(spark, sf_dir, "documents")
    (docs if docs.rdd.getNumPartitions() >= 4 else docs.repartition(4, "doc_id")).write.mode("overwrite").parquet(path)
    return path, f"{_root(spark, tag)}/{n}/index"


def _grown(spark: SparkSession, sf_dir: str, tag: str) -> tuple[str, str]:
    """A copy of documents of which the odd half came after the index was built."""
    n = len(Store(spark).names(_root(spark, tag)))
    path, index = f"{_root(spark, tag)}/{n}/table", f"{_root(spark, tag)}/{n}/index"
    docs = _table(spark, sf_dir, "documents")
    docs.where("doc_id % 2 = 0").write.mode("overwrite").parquet(path)
    Indexes(spark, index).create(path, "text")
    docs.where("doc_id % 2 <> 0").write.mode("append").parquet(path)
    return path, index


def _found(spark: SparkSession, root: str, path: str) -> DataFrame:
    with _forced(spark):
        return Search(spark, root).search(path, "license").select("doc_id")


def tail_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _grown(spark, sf_dir, "tail")
    return _found(spark, root, path)


def refresh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _grown(spark, sf_dir, "refresh")
    Indexes(spark, root).refresh(path)
    return _found(spark, root, path)


def compact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _grown(spark, sf_dir, "compact")
    Indexes(spark, root).refresh(path, 1 << 40)
    Indexes(spark, root).compact(path)
    return _found(spark, root, path)


def purge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _grown(spark, sf_dir, "purge")
    Indexes(spark, root).refresh(path)
    Indexes(spark, root).compact(path, purge=True)
    return _found(spark, root, path)


def refresh_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _grown(spark, sf_dir, "progress")
    return Indexes(spark, root).refresh(path, 1 << 40).select("rows_indexed", "remaining_tail")


def refresh_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a tenth of the table until no tail is left."""
    path, root = _grown(spark, sf_dir, "bounded")
    step = max(1, _table(spark, sf_dir, "documents").count() // 10)
    rows = []
    while not rows or rows[-1][2]:
        got = Indexes(spark, root).refresh(path, step).first()
        rows.append((len(rows) + 1, got.rows_indexed, got.remaining_tail))
    return spark.createDataFrame(rows, "step long, rows_indexed long, remaining_tail long")


def search_no_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with names that don't tell what they are, and a folder that a scan doesn't enter."""
    path, root = _copied(spark, sf_dir, "names")
    _table(spark, sf_dir, "documents").write.mode("overwrite").parquet(f"{path}/nested")
    fs, folder = Store(spark)._at(path)
    for k, name in enumerate(x for x in Store(spark).names(path) if x.endswith(".parquet")):
        fs.rename(Store(spark)._at(f"{path}/{name}")[1], Store(spark)._at(f"{path}/part {k} of 100%")[1])
    Indexes(spark, root).create(path, "text")
    return _found(spark, root, path)


def drop_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = _copied(spark, sf_dir, "again")
    Indexes(spark, root).create(path, "text")
    Indexes(spark, root).drop(path, "text")
    Indexes(spark, root).create(path, "text", 4)
    return _found(spark, root, path)


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are streamed into an indexed table."""
    path, root = _copied(spark, sf_dir, "streamed")
    Indexes(spark, root).create(path, "text")
    source = f"{path}-source"
    _table(spark, sf_dir, "documents").write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    append_and_refresh(spark, stream, path, f"{path}-checkpoint", root).awaitTermination()
    return _found(spark, root, path)


def _rewritten(change):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, root = _copied(spark, sf_dir, "rewritten")
        Indexes(spark, root).create(path, "text")
        with _forced(spark):
            Accelerator(spark, root).rewrite(path, "text LIKE '%License%' AND lang = 'en'", change)
        Indexes(spark, root).refresh(path)
        with _forced(spark):
            return Search(spark, root).search(path, "license").select("doc_id", "lang")

    return run


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("long")).alias("rows"))
    coded = lists.select("o_custkey", encode_postings("rows").alias("blob"))
    return coded.select("o_custkey", F.explode(decode_postings("blob")).alias("rid"))


def pack_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gram"), F.shiftright(F.col("l_orderkey").cast("long"), 8).alias("segment_no"), F.col("l_orderkey").cast("long").alias("rid"))
    return pack(rows).select("gram", "segment_no", "rowid_count", "min_rowid", "max_rowid")


def pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gram"), F.shiftright(F.col("l_orderkey").cast("long"), 8).alias("segment_no"), F.col("l_orderkey").cast("long").alias("rid"))
    return unpack(pack(rows).withColumn("generation", F.lit(0)), 8, 1 << 40)


def search_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search("license", key=None)(spark, sf_dir).select("doc_id", "lang")
    return found.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


def search_agg_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search("the", key=None)(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search("license", key=None)(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return Indexes(spark, _indexed(spark, path, "text")).stats(path)


def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Indexes(spark, _indexed(spark, f"{sf_dir}/documents.parquet", "text")).indexes()


def index_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What index_stats() tells of the contents."""
    return index_stats(spark, sf_dir).select("column_name", "gram_size", "hwm_rowid", "table_max_rowid", "remaining_tail", "distinct_grams", "fragmented_keys", "posting_entries", "generations")


def explain_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    search = Search(spark, _indexed(spark, path, "text"))
    with _forced(spark):
        return spark.createDataFrame([(n, search.explain(path, n)["mode"]) for n in ("license", "the", "er", "zzzz")], "needle string, mode string")


_NEEDLES = ("license", "apache", "the", "er", "zzzz", "worthless")


def explain_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which needles are probed under the default settings."""
    path = f"{sf_dir}/documents.parquet"
    search = Search(spark, _indexed(spark, path, "text"))
    return spark.createDataFrame([(n, search.explain(path, n)["mode"].startswith("index")) for n in _NEEDLES], "needle string, probed boolean")


def explain_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How accelerated queries read the table."""
    engine, rows = _engine(spark, sf_dir), []
    with _forced(spark):
        for k in ("like", "like_subquery", "like_prefix", "like_in"):
            rows += [(k, mode.startswith("index")) for _, mode, _ in engine.explain(_SQL[k])]
    return spark.createDataFrame(rows, "query string, probed boolean")


_CI = "SELECT doc_id FROM documents WHERE contains(lower(text), '{}')"
_SQL = {
    "like": "SELECT doc_id FROM documents WHERE text LIKE '%license%'",
    "like_multi": "SELECT doc_id FROM documents WHERE text LIKE '%lic%ense%'",
    "like_prefix": "SELECT doc_id FROM documents WHERE text LIKE 'The%'",
    "like_one": "SELECT doc_id FROM documents WHERE text LIKE '%icense_ under%'",
    "like_all": "SELECT * FROM documents WHERE text LIKE '%License%'",
    "like_subquery": "SELECT count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents WHERE text LIKE '%License%'",
    "like_subquery_where": "SELECT doc_id FROM documents WHERE text LIKE '%License%' AND n_chars > (SELECT avg(n_chars) FROM documents)",
    "like_in": "SELECT doc_id FROM documents WHERE text LIKE '%License%' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "like_exists": "SELECT doc_id FROM documents d WHERE text LIKE '%License%' AND EXISTS (SELECT 1 FROM documents o WHERE o.source = d.source AND o.n_chars > d.n_chars)",
    "like_not_in": "SELECT doc_id FROM documents WHERE text LIKE '%License%' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 2000 AND doc_id IS NOT NULL)",
    "like_union": "SELECT doc_id FROM documents WHERE text LIKE '%License%' UNION ALL SELECT doc_id FROM documents WHERE lang = 'fr'",
    "ilike": "SELECT doc_id FROM documents WHERE text ILIKE '%LICENSE%'",
    "like_and": "SELECT doc_id FROM documents WHERE text LIKE '%License%' AND lang = 'en'",
    "like_or": "SELECT doc_id FROM documents WHERE text LIKE '%License%' OR lang = 'fr'",
    "not_like": "SELECT doc_id FROM documents WHERE text NOT LIKE '%License%'",
    "like_two": "SELECT doc_id FROM documents WHERE text LIKE '%License%' AND text LIKE '%Apache%'",
    "like_count": "SELECT count(*) AS n FROM documents WHERE text LIKE '%License%'",
    "like_join": "SELECT d.lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text LIKE '%License%' GROUP BY d.lang",
    "like_topk": "SELECT doc_id, n_chars FROM documents WHERE text LIKE '%License%' ORDER BY n_chars DESC, doc_id LIMIT 5",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "grams_ci": _grams(3, True),
    "grams_cs": _grams(3, False),
    "grams_n2": _grams(2, True),
    "grams_n4": _grams(4, True),
    "gram_stats": gram_stats,
    "segments_summary": segments_summary,
    "search_ci": _search("license"),
    "search_ci_folds": _search("LICENSE"),
    "search_cs": _search("License", case_insensitive=False),
    "search_gram4": _search("license", gram=4),
    "search_dense": _search("the"),
    "search_short": _search("er"),
    "search_empty": _search(""),
    "search_absent": _search("zzzz"),
    "search_unicode": _search("ÉTION"),
    "search_pages": _search("license", "pages", "html", "page_id"),
    "search_conversations": _search("the", "conversations", "text", "conv_id"),
    "search_part": _search("ing", "part", "p_name", "p_partkey"),
    "search_events": _search('k": 7', "events", "props", "event_id"),
    "search_all_columns": _search("license", key=None),
    "search_work_gate": _search("license", max_probe_rowids="1"),
    "search_memory_gate": _search("the", max_probe_memory="2000", max_candidate_fraction="1.0"),
    "search_density_gate": _search("the", max_candidate_fraction="0.01"),
    "search_no_suffix": search_no_suffix,
    "drop_create": drop_create,
    "stream_search": stream_search,
    "refresh_bounded": refresh_bounded,
    "delete_rows": _rewritten(lambda rows: rows.limit(0)),
    "update_rows": _rewritten(lambda rows: rows.withColumn("lang", F.lit("xx"))),
    "sql_search_rows": _sql("SELECT lang, count(*) AS n FROM search_rows('documents', 'license') GROUP BY lang"),
    "sql_search_candidates": _sql("SELECT count(*) AS n FROM search_candidates('documents', 'text', '')"),
    "like_alias": _sql("SELECT doc_id FROM (SELECT doc_id, rand() AS r, source AS text FROM documents) WHERE text LIKE '%src2%'"),
    "index_figures": index_figures,
    "explain_gates": explain_gates,
    "explain_sql": explain_sql,
    "candidates_all_grams": candidates_all_grams,
    "search_join_labels": search_join_labels,
    "search_agg_lang": search_agg_lang,
    "search_topk": search_topk,
    "tail_search": tail_search,
    "refresh_search": refresh_search,
    "compact_search": compact_search,
    "purge_search": purge_search,
    "refresh_progress": refresh_progress,
    "codec_roundtrip": codec_roundtrip,
    "pack_segments": pack_segments,
    "pack_unpack": pack_unpack,
    **{k: _sql(v) for k, v in _SQL.items()},
    "regexp_literal": _sql("SELECT doc_id FROM documents WHERE text RLIKE 'License'"),
    "index_stats": index_stats,
    "index_list": index_list,
    "explain_mode": explain_mode,
}

_SEGMENTS = "(SELECT DISTINCT l_returnflag AS gram, l_orderkey::BIGINT >> 8 AS segment_no, l_orderkey::BIGINT AS rid FROM lineitem)"
_EACH = "(SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE length(t) >= 3)"

ORACLES: dict[str, str] = {
    "grams_ci": _grams_sql(3, True),
    "grams_cs": _grams_sql(3, False),
    "grams_n2": _grams_sql(2, True),
    "grams_n4": _grams_sql(4, True),
    "gram_stats": f"SELECT gram, count(*) AS row_count FROM {_EACH} GROUP BY gram",
    "segments_summary": f"SELECT gram, count(*) AS row_count, true AS ordered FROM {_EACH} GROUP BY gram",
    **{k: _CI.format("license") for k in ("search_ci", "search_ci_folds", "search_gram4", "search_work_gate", "search_no_suffix", "drop_create", "tail_search", "refresh_search", "compact_search", "purge_search")},
    "search_cs": "SELECT doc_id FROM documents WHERE contains(text, 'License')",
    **{k: _CI.format("the") for k in ("search_dense", "search_memory_gate", "search_density_gate")},
    "search_short": _CI.format("er"),
    "search_empty": "SELECT doc_id FROM documents WHERE text IS NOT NULL",
    "search_absent": _CI.format("zzzz"),
    "search_unicode": _CI.format("étion"),
    "search_pages": "SELECT page_id FROM pages WHERE contains(lower(html), 'license')",
    "search_conversations": "SELECT conv_id FROM conversations WHERE contains(lower(text), 'the')",
    "search_part": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ing')",
    "search_events": "SELECT event_id FROM events WHERE contains(lower(props), 'k\": 7')",
    "search_all_columns": "SELECT * FROM documents WHERE contains(lower(text), 'license')",
    "stream_search": "SELECT doc_id FROM documents, range(2) WHERE contains(lower(text), 'license')",
    "refresh_bounded": """
WITH t AS (SELECT greatest(1, count(*) // 10) AS step, count(*) FILTER (doc_id % 2 <> 0) AS n FROM documents)
SELECT i AS step, least(t.step, n - t.step * (i - 1)) AS rows_indexed, greatest(0, n - t.step * i) AS remaining_tail
FROM t, LATERAL (SELECT unnest(range(1, greatest(1, CAST(ceil(n / t.step) AS BIGINT)) + 1)) AS i)""",
    "delete_rows": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') AND NOT (contains(text, 'License') AND lang = 'en')",
    "update_rows": "SELECT doc_id, CASE WHEN contains(text, 'License') AND lang = 'en' THEN 'xx' ELSE lang END AS lang FROM documents WHERE contains(lower(text), 'license')",
    "sql_search_rows": "SELECT lang, count(*) AS n FROM documents WHERE contains(lower(text), 'license') GROUP BY lang",
    "sql_search_candidates": "SELECT count(*) AS n FROM documents",
    "like_alias": "SELECT doc_id FROM documents WHERE source LIKE '%src2%'",
    "index_figures": f"""
SELECT 'text' AS column_name, 3::INT AS gram_size, n - 1 AS hwm_rowid, n - 1 AS table_max_rowid, 0::BIGINT AS remaining_tail,
       (SELECT count(DISTINCT gram) FROM {_EACH}) AS distinct_grams, 0::BIGINT AS fragmented_keys, (SELECT count(*) FROM {_EACH}) AS posting_entries, 1::INT AS generations
FROM (SELECT count(*) AS n FROM documents)""",
    "explain_gates": f"""
WITH g AS (SELECT gram, count(*) AS n FROM {_EACH} GROUP BY gram),
needles AS (SELECT unnest({list(_NEEDLES)}) AS needle),
grams AS (SELECT DISTINCT needle, unnest(list_transform(range(1, length(needle) - 1), lambda i: substring(needle, i, 3))) AS gram FROM needles)
SELECT needle, coalesce((SELECT min(coalesce(g.n, 0)) FROM grams LEFT JOIN g USING (gram) WHERE grams.needle = needles.needle) <= 0.01 * (SELECT count(*) FROM documents), false) AS probed FROM needles""",
    "explain_sql": "SELECT * FROM (VALUES ('like', true), ('like_subquery', false), ('like_prefix', false), ('like_in', true)) t(query, probed)",
    "candidates_all_grams": f"SELECT doc_id FROM {_EACH} WHERE gram IN ('lic', 'ice', 'cen', 'ens', 'nse') GROUP BY doc_id HAVING count(*) = 5",
    "search_join_labels": "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) WHERE contains(lower(text), 'license') GROUP BY lang",
    "search_agg_lang": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE contains(lower(text), 'the') GROUP BY lang",
    "search_topk": "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'license') ORDER BY n_chars DESC, doc_id LIMIT 10",
    "refresh_progress": "SELECT count(*) FILTER (doc_id % 2 <> 0) AS rows_indexed, 0::BIGINT AS remaining_tail FROM documents",
    "codec_roundtrip": "SELECT DISTINCT o_custkey, o_orderkey::BIGINT AS rid FROM orders",
    "pack_segments": f"SELECT gram, segment_no, count(*) AS rowid_count, min(rid) AS min_rowid, max(rid) AS max_rowid FROM {_SEGMENTS} GROUP BY gram, segment_no",
    "pack_unpack": f"SELECT gram, segment_no, rid FROM {_SEGMENTS}",
    **_SQL,
    "regexp_literal": "SELECT doc_id FROM documents WHERE regexp_matches(text, 'License')",
}
