"""Posting lists as bytes: version, count, first row id and gaps, all but the version as base-128 numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

VERSION, MOST = 1, (1 << 63) - 1


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_list(rows) -> bytes | None:
    """Sorted and without repeats; null stays null. Null or negative row ids are errors."""
    if rows is None:
        return None
    rows = list(rows)
    if any(r is None or r != r for r in rows):
        raise ValueError("a posting list can't hold a null row id")
    rows = sorted({int(r) for r in rows})
    if rows and rows[0] < 0:
        raise ValueError("a posting list can't hold a negative row id")
    return bytes([VERSION]) + _number(len(rows)) + b"".join(_number(b - a) for a, b in zip([0, *rows], rows))


def decode_list(raw: bytes | None) -> list[int] | None:
    """The inverse of encode_list(). Anything that it doesn't write is an error."""
    if raw is None:
        return None
    if not raw or raw[0] != VERSION:
        raise ValueError("unknown version of a posting list")
    at, numbers, count = 1, [], None
    while count is None or len(numbers) < count:
        value = shift = 0
        while True:
            if at >= len(raw):
                raise ValueError("a posting list ends too early")
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if value > MOST:
                raise ValueError("a number of a posting list is too large")
            if byte < 128:
                if not byte and shift:
                    raise ValueError("a number of a posting list is longer than needed")
                break
            shift += 7
        if count is None:
            count = value
        else:
            if numbers and value == 0:
                raise ValueError("a posting list repeats a row id")
            numbers.append(value + (numbers[-1] if numbers else 0))
            if numbers[-1] > MOST:
                raise ValueError("a row id of a posting list is too large")
    if at != len(raw):
        raise ValueError("bytes after the end of a posting list")
    return numbers


def posting_count(raw: bytes) -> int:
    """The number of row ids by the head alone."""
    value = shift = 0
    for byte in raw[1:]:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value
    raise ValueError("a posting list ends too early")


def encode_lists(lists: list) -> list[bytes | None]:
    """encode_list() of many lists at once."""
    out: list[bytes | None] = [None] * len(lists)
    known = [i for i, x in enumerate(lists) if x is not None]
    arrays = [np.asarray(lists[i]) for i in known]
    plain = [k for k, x in enumerate(arrays) if x.dtype.kind in "iu" and (not len(x) or x.min() >= 0)]
    for k in set(range(len(known))) - {*plain}:
        out[known[k]] = encode_list(lists[known[k]])  # an empty list, or an error
    if not plain:
        return out
    size = np.array([len(arrays[k]) for k in plain])
    flat = np.concatenate([arrays[k].astype(np.int64) for k in plain])
    owner = np.repeat(np.arange(len(plain)), size)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.concatenate((np.ones(min(len(flat), 1), bool), (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))
    flat, owner = flat[new], owner[new]
    size = np.bincount(owner, minlength=len(plain))
    first = np.cumsum(size) - size
    gaps = flat.copy()
    gaps[1:] -= flat[:-1]
    begins = first[size > 0]
    gaps[begins] = flat[begins]
    # each list's numbers: how many, the first row id, the gaps
    numbers = np.insert(gaps, first, size).astype(np.uint64)
    heads = first + np.arange(len(plain))
    width = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        width += numbers >= np.uint64(1 << (7 * k))
    version = np.zeros(len(numbers), np.int64)
    version[heads] = 1
    ends = np.cumsum(width + version)
    raw = np.empty(int(ends[-1]), np.uint8)
    begin = ends - width
    raw[begin[heads] - 1] = VERSION
    for k in range(9):
        some = np.flatnonzero(width > k)
        raw[begin[some] + k] = ((numbers[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(width[some] > k + 1, 128, 0).astype(np.uint8)
    cuts = np.append(begin[heads] - 1, len(raw))
    blob = raw.tobytes()
    for k, a, b in zip(plain, cuts[:-1].tolist(), cuts[1:].tolist()):
        out[known[k]] = blob[a:b]
    return out


def decode_lists(blobs: list) -> list[np.ndarray | None]:
    """decode_list() of many lists at once."""
    out: list = [None] * len(blobs)
    known = [i for i, x in enumerate(blobs) if x is not None]
    if not known:
        return out

    def one_by_one() -> list:
        for i in known:
            out[i] = np.array(decode_list(blobs[i]), np.int64)
        return out

    if any(len(blobs[i]) < 2 or blobs[i][0] != VERSION or blobs[i][-1] > 127 for i in known):
        return one_by_one()  # an error
    raw = np.frombuffer(b"".join(blobs[i][1:] for i in known), np.uint8)
    bytes_ = np.cumsum([len(blobs[i]) - 1 for i in known])
    last = np.flatnonzero(raw < 128)
    start = np.concatenate(([0], last[:-1] + 1))
    width = last - start + 1
    if width.max() > 9 or ((raw[last] == 0) & (width > 1)).any():
        return one_by_one()
    place = np.arange(len(raw)) - np.repeat(start, width)
    numbers = np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start)
    ends = np.searchsorted(last, bytes_)  # of each list's numbers
    heads = np.concatenate(([0], ends[:-1]))
    size = ends - heads - 1
    if (numbers[heads] != size.astype(np.uint64)).any():
        return one_by_one()
    values = np.delete(numbers, heads)
    first = np.cumsum(size) - size
    later = np.ones(len(values), bool)
    later[first[size > 0]] = False
    if (later & (values == 0)).any():
        return one_by_one()
    if len(values):
        sums = np.cumsum(values.astype(np.float64))
        if sums[-1] > 2.0**62:
            return one_by_one()  # sums of all lists could overflow
        total = np.cumsum(values.astype(np.int64))
        total -= np.repeat(np.where(first > 0, total[np.maximum(first, 1) - 1], 0), size)
    else:
        total = values.astype(np.int64)
    for i, x in zip(known, np.split(total, first[1:])):
        out[i] = x
    return out


def encode_postings(c: Column | str) -> Column:
    @pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series(encode_lists(lists.tolist()), dtype=object)

    return run(c)


def decode_postings(c: Column | str) -> Column:
    @pandas_udf("array<bigint>")
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series(decode_lists(blobs.tolist()), dtype=object)

    return run(c)
