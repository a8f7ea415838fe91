"""URL filters: host-suffix and path-prefix expressions, joined on short hashes, then full digests."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: (host, path, action): host stands for itself and all below it. A path that ends with / stands for
#: all below it; "/" is the whole host; another path is that page, with its query if it names one.
RULES = [
    ("casino-win.example.com", "/", "block"),
    ("cheap-pills.example.com", "/", "block"),
    ("free-bets.example.com", "/", "block"),
    ("free-bets.example.com", "/fr/", "allow"),
    ("spam-farm.example.com", "/", "block"),
    ("www.spam-farm.example.com", "/de/", "allow"),
    ("example.net", "/es/", "block"),
    ("tiontion.example.net", "/es/", "allow"),
    ("ththth.example.net", "/en/", "block"),
    ("m.ththth.example.net", "/", "allow"),
    ("therhe.example.org", "/en/8423", "block"),
    ("therhe.example.org", "/en/8423?utm_source=feed", "allow"),
]
#: Hex digits of the digest that the join is on.
PREFIX = 8

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)(?::[0-9]*)?([^#]*)"
#: Hosts that are addresses, which nothing is below.
_ADDRESS = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^\["
#: Escapes of characters that need none: the URL is the same without them (RFC 3986).
_PLAIN = "%(2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])"
_DOTS = r"/\.\.?(?:/|\?|$)"


def parsed(url):
    """Host and path with query as columns: lower-case host without its last dot, path from / on, no fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", "")
    rest = F.regexp_extract(url, _URL, 2)
    return host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def plain_path(rest: str) -> str:
    """Path and query without escapes that aren't needed and without dot segments in the path (RFC 3986)."""
    rest = re.sub(_PLAIN, lambda m: chr(int(m[1], 16)), rest)
    path, mark, query = rest.partition("?")
    if not re.search(_DOTS, path):
        return rest
    out: list[str] = []
    parts = path.split("/")[1:]
    for x in parts:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    if parts[-1] in (".", ".."):
        out.append("")
    return "/" + "/".join(out) + mark + query


def normalised(urls: DataFrame) -> DataFrame:
    """The column rest by plain_path(). Only rows that have an escape or a dot segment go through Python."""

    @pandas_udf("string")
    def plain(rest: pd.Series) -> pd.Series:
        return rest.map(plain_path)

    odd = F.col("rest").rlike(_PLAIN) | F.col("rest").rlike(_DOTS)
    return urls.where(~odd).unionByName(urls.where(odd).withColumn("rest", plain("rest")))


def expressions(host, rest, most_labels: int, most_folders: int):
    """Host suffixes (of an address only itself) of up to so many labels, with the whole path with and
    without query, and each folder above it up to such a depth: array of structs (e, labels, length). No rule
    has more labels or a deeper folder, so the others can't match: a URL gives no more than it can find."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    first = F.greatest(n - most_labels + 1, F.lit(1))
    starts = F.when(host.rlike(_ADDRESS), F.array(F.lit(1))).when(first <= n, F.sequence(first, n))
    hosts = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("h"), (n - i + 1).alias("k")))
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    parts = F.split(path, "/", most_folders + 1)
    depth = F.least(F.size(parts) - 1, F.lit(most_folders))
    folders = F.when(depth < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    paths = F.array_distinct(F.concat(F.array(rest, path), folders))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(F.concat(h["h"], p).alias("e"), h["k"].alias("labels"), F.length(p).alias("length")))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rule, action, digest, prefix."""
    found = spark.createDataFrame([(h.lower() + p, a) for h, p, a in rules], "rule string, action string")
    return found.withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, action ('block', 'allow', 'none'), rule for each row of pages.

    Of the rules that match, the one with the most host labels holds, then the one with the longest
    path, then 'allow' before 'block'. A host that is an IPv4 or bracketed IPv6 address has no suffixes: only rules for itself
    match. Escapes of characters that need none, and dot segments of paths, are resolved before; rules are taken
    as they are. URLs of any length are read whole. A null URL, or one without scheme or host, matches none; an empty rule
    table gives 'none' for all; repeated rows are judged alike; repeated rules count once. rules has rule
    (host and path), action, digest, prefix. Other columns of pages aren't read.
    """
    head, tail = F.regexp_extract("rule", r"^[^/]*", 0), F.regexp_extract("rule", r"/.*$", 0)
    most = rules.agg(F.max(F.size(F.split(head, r"\."))).alias("labels"), F.max(F.size(F.split(tail, "/")) - 1).alias("folders")).first()
    urls = pages.where("url is not null").select("url").distinct()
    host, rest = parsed(F.col("url"))
    urls = normalised(urls.select("url", host.alias("host"), rest.alias("rest")).where("host <> ''"))
    wide = urls.select("url", F.explode(expressions(F.col("host"), F.col("rest"), most.labels or 1, most.folders or 1)).alias("x")).select("url", "x.*")
    wide = wide.withColumn("own", F.sha2("e", 256)).withColumn("prefix", F.substring("own", 1, PREFIX))
    hits = wide.join(rules.select("rule", "action", "digest", "prefix").distinct(), "prefix").where("own = digest")
    rank = F.struct("labels", "length", (F.col("action") == "allow").alias("allow"))
    best = hits.groupBy("url").agg(F.max_by(F.struct("action", "rule"), rank).alias("best"))
    return pages.select("page_id", "url").join(best, "url", "left").select("page_id", "url", F.coalesce("best.action", F.lit("none")).alias("action"), F.col("best.rule").alias("rule"))


_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
ORACLE = rf"""
WITH rules(h, p, a) AS (VALUES {_VALUES}),
u AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '{_URL}', 1)), '.') AS host, regexp_extract(url, '{_URL}', 2) AS r0 FROM pages),
v0 AS (SELECT page_id, url, host, CASE WHEN r0 LIKE '/%' THEN r0 ELSE '/' || r0 END AS r1 FROM u),
v1 AS (SELECT page_id, url, host, array_to_string(list_transform(regexp_extract_all(r1, '%[0-9A-Fa-f][0-9A-Fa-f]|[^%]+|%'),
         lambda t: CASE WHEN regexp_full_match(t, '{_PLAIN}') THEN url_decode(t) ELSE t END), '') AS r2 FROM v0),
v2 AS (SELECT page_id, url, host, r2, regexp_extract(r2, '^[^?]*', 0) AS p2 FROM v1),
v AS (SELECT page_id, url, host, CASE WHEN NOT regexp_matches(p2, '{_DOTS}') THEN r2 ELSE
        list_reduce(list_prepend('', string_split(substr(p2, 2), '/')), lambda x, y: CASE y WHEN '.' THEN x WHEN '..' THEN regexp_replace(x, '/[^/]*$', '') ELSE x || '/' || y END)
        || CASE WHEN regexp_matches(p2, '/\.\.?$') THEN '/' ELSE '' END || substr(r2, length(p2) + 1) END AS rest FROM v2),
w AS (SELECT *, regexp_extract(rest, '^[^?]*', 0) AS path FROM v),
hit AS (SELECT page_id, a AS action, h || p AS rule,
          row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC, length(p) DESC, a) AS k
        FROM w JOIN rules ON (host = h OR (host LIKE '%.' || h AND NOT regexp_matches(host, '{_ADDRESS}')))
          AND (p = rest OR p = path OR (p LIKE '%/' AND starts_with(path, p))))
SELECT v.page_id, v.url, coalesce(hit.action, 'none') AS action, hit.rule AS rule FROM v LEFT JOIN hit ON hit.page_id = v.page_id AND k = 1
"""
