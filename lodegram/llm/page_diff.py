"""HTML extraction by nearest-URL page differencing: what a page shares with its neighbour goes."""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegram.llm.common import FILE, ROW, Side, mapped, saved, stored, with_row_key, write_side
from lodegram.llm.url_filter import parsed

#: Elements whose content isn't text, and those that don't break a line.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_INLINE = "a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
_TAG = re.compile(r"""</?([A-Za-z][^\s<>"'/]*)(?:[^<>"']|"[^"]*"|'[^']*')*+>|<[!?][^<>]*>""")
_INLINE_NAMES = frozenset(_INLINE)
#: All rows of the LCS table are kept up to so many bits; of a larger one some, from which the others are made again.
TABLE_BITS = 1 << 28


def text_lines(page: str) -> list[str]:
    """The page's lines of text: white space runs as one space, no empty lines."""
    page = page.replace("\n", " ").replace("\r", " ")
    page = _HIDDEN.sub("\n", page)
    page = _TAG.sub(lambda m: "" if m[1] and m[1].lower() in _INLINE_NAMES else "\n", page)
    lines = (" ".join(html.unescape(x).split()) for x in page.split("\n"))
    return [x for x in lines if x]


def _rows(a: list[int], masks: dict[int, int], full: int, v: int):
    """Rows of bits of the LCS table of a against the masked sequence, after the row v: a 0 where the length grows."""
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list[int]) -> dict[int, int]:
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out = {}
    for x, js in places.items():
        bits = np.zeros(len(b), np.uint8)
        bits[js] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence: from the ends on, equal items belong to it; else b's last item is left
    out where that costs nothing, else a's."""
    if not a or not b:
        return []
    masks, full = _masks(b), (1 << len(b)) - 1
    step = len(a) if len(a) * len(b) <= TABLE_BITS else math.isqrt(len(a)) + 1
    marks, rows = [full], []
    for lo in range(0, len(a) - step, step):
        for v in _rows(a[lo : lo + step], masks, full, marks[-1]):
            pass
        marks.append(v)
    i, j, base, found = len(a), len(b), len(a), []
    while i and j:
        if i - 1 < base:
            base = (i - 1) // step * step
            rows = list(_rows(a[base : base + step], masks, full, marks[base // step]))
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append(i)
        elif rows[i - 1 - base] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return found[::-1]


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of a's lines that are in a longest common subsequence of a and b.

    Equal ends belong to it; of the other lines only those that both have are aligned.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    own = np.flatnonzero(np.isin(left, right))
    found = _common(left[own].tolist(), right[np.isin(right, left)].tolist())
    return np.concatenate((np.arange(head), head + own[found], np.arange(len(a) - tail, len(a)))).astype(np.int32)


def _hashed(batches):
    for batch in batches:
        rows, at = [], []
        for i, page in enumerate(batch.column("html").to_pylist()):
            if lines := text_lines(page):
                hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], "<u8").tobytes()
                at.append(i)
                rows.append((hashes, xxhash.xxh3_64_intdigest(hashes) - (1 << 63)))
        take = pa.array(at, pa.int64())
        cols = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (FILE, ROW, "host", "path")), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64())], [FILE, ROW, "host", "path", "lines", "h"])


_NEAR = "pid int, host string, path string, rep long, prior string, prior_rep long, next string, next_rep long"


def _neighbours(batches):
    """Each path with the ones before and after it in its host; null at the ends of the partition."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["pid", "host", "path", "rep", "prior", "prior_rep", "next", "next_rep"])

    out, prior, own = [], None, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rep"))):
            if own is not None:
                out.append((pid, *own, *_beside(own, prior), *_beside(own, row)))
                prior = own
            own = row
        if len(out) >= 50_000:
            yield packed(out)
            out = []
    if own is not None:
        out.append((pid, *own, *_beside(own, prior), None, None))
    if out:
        yield packed(out)


def _beside(own, other):
    return other[1:] if other is not None and other[0] == own[0] else (None, None)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _nearest(ends: dict[int, tuple]):
    """Of the two neighbours the one with the longer common start of the path. ends: by partition the last
    path before it and the first after it, with their hosts."""

    def run(batches):
        for batch in batches:
            out = []
            for pid, host, path, rep, prior, prior_rep, after, after_rep in zip(*(c.to_pylist() for c in batch.columns)):
                before, behind = ends[pid]
                if prior is None and before is not None and before[0] == host and before[1] < path:
                    prior, prior_rep = before[1:]
                if after is None and behind is not None and behind[0] == host and behind[1] > path:
                    after, after_rep = behind[1:]
                if prior is None and after is None:
                    continue
                first = after is None or (prior is not None and common_prefix(prior, path) >= common_prefix(after, path))
                out.append((host, path, prior_rep if first else after_rep))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["host", "path", "partner"])

    return run


def _differenced(batches):
    for batch in batches:
        drops = [shared_lines(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")).tobytes() for a, b in zip(batch.column("lines").to_pylist(), batch.column("other").to_pylist())]
        out = pa.RecordBatch.from_arrays([batch.column("host"), batch.column("h"), pa.array(drops, pa.binary())], ["host", "h", "gone"])
        yield out.filter(pa.array([bool(x) for x in drops], pa.bool_()))


def _rendered(side_path: str):
    def run(batches):
        side = Side(side_path)
        for batch in batches:
            drops = {p: np.frombuffer(table.column("gone")[a].as_py(), np.int32) for p, table, a, _ in side.rows(batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy())}
            texts, counts = [], []
            for i, page in enumerate(batch.column("html").to_pylist()):
                lines = text_lines(page) if page else []
                gone = set(drops[i].tolist()) if i in drops else ()
                texts.append(None if page is None else "\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else "\n".join(lines))
                counts.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["page_id", "url", "text", "n_removed"])

    return run


def removed_lines(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """FILE, ROW, gone (int32 numbers of the lines to delete) of pages that share lines. See extract_pages()."""
    keyed = with_row_key(pages, ["url", "html"]).where("url is not null and html is not null")
    host, rest = parsed(F.col("url"))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/+$", "")
    # the query after the least character, so that a path's queries come next to it and before longer paths
    query = F.regexp_extract(rest, r"^[^?]*\?(.+)$", 1)
    path = F.when(query == "", path).otherwise(F.concat(path, F.lit("\0"), query))
    keyed = keyed.select(FILE, ROW, host.alias("host"), path.alias("path"), "html").where("host <> ''")
    lines = saved(keyed.transform(mapped, _hashed, f"{FILE} long, {ROW} long, host string, path string, lines binary, h long"), "page-lines")
    contents = saved(lines.groupBy("host", "h").agg(F.min("path").alias("path"), F.max("lines").alias("lines")), "contents")

    # hosts may be of any size, so they are cut by ranges of paths; only the ends of ranges meet on the driver
    paths = contents.groupBy("host", "path").agg(F.min("h").alias("rep"))
    near = saved(paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path").transform(mapped, _neighbours, _NEAR), "near-paths")
    span = near.groupBy("pid").agg(F.min(F.struct("host", "path", "rep")).alias("lo"), F.max(F.struct("host", "path", "rep")).alias("hi")).orderBy("pid").collect()
    ends = {r.pid: (tuple(span[i - 1].hi) if i else None, tuple(span[i + 1].lo) if i + 1 < len(span) else None) for i, r in enumerate(span)}
    partners = near.transform(mapped, _nearest(ends), "host string, path string, partner long")

    other = contents.select("host", F.col("h").alias("partner"), F.col("lines").alias("other"))
    pairs = contents.join(partners, ["host", "path"]).join(other, ["host", "partner"])
    gone = pairs.select("host", "h", "lines", "other").transform(mapped, _differenced, "host string, h long, gone binary")
    return lines.select(FILE, ROW, "host", "h").join(gone, ["host", "h"]).select(FILE, ROW, "gone")


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_removed (lines deleted) for each row of pages.

    A page's text is its lines: block elements break them, entities are decoded, white space runs become
    one space; comments, scripts, styles and titles are left out. Of a host's pages, in order of
    their paths and queries (lower-case host; without fragment and slashes at the end of the path), each is paired with the one next
    to it that has the longer start of path and query in common, the earlier one in case of a tie, and loses
    the lines of a longest common subsequence with it. Pages of a host with the same lines are
    one page, at the least of their paths, so copies don't erase each other; different contents of one path and
    query are versions of a page, which aren't paired, and the one with the least hash stands for them. A page
    without such a partner keeps its lines: so do those with a null or hostless URL. A null html
    gives a null text, an empty one an empty text. Pages are read whole; columns other than page_id, url and html aren't
    read; repeated rows give equal rows; an empty table gives none.
    """
    pages = stored(pages.select("page_id", "url", "html"))
    side = write_side(removed_lines(spark, pages), "page-gone", pages)
    keyed = with_row_key(pages, ["page_id", "url", "html"])
    return keyed.transform(mapped, _rendered(side), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_removed int")
