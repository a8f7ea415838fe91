"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegram.llm.common import FILE, ROW, Side, mapped, saved, with_row_key, write_side

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A chunk ends where the low bits of the rolling hash over WINDOW bytes are 0, on average each so many bytes.
WINDOW, MASK = 32, np.uint32(1023 << 22)
MIN_CHUNK, MAX_CHUNK = 128, 16384

_GEAR = (np.random.RandomState(7).randint(0, 1 << 32, 256, dtype=np.uint64)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The tokenizer, made once in each process."""
    if vocabulary not in _encodings:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def encoded(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash of the last WINDOW bytes."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunks(h: np.ndarray) -> list[int]:
    """Ends of a text's chunks, all set by what is around them: where the rolling hash calls for a cut, and where there is none
    for MAX_CHUNK bytes, at the least hash of those."""
    out, at, end = [], 0, len(h)

    def cut_until(stop: int) -> None:
        nonlocal at
        while stop - at > MAX_CHUNK:
            part = h[at + MIN_CHUNK : at + MAX_CHUNK]
            at += MAX_CHUNK - int(np.argmin(part[::-1]))  # the last of several
            out.append(at)

    for m in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        cut_until(m)
        if m - at >= MIN_CHUNK and m < end:
            out.append(m)
            at = m
    cut_until(end)
    if end > at:
        out.append(end)
    return out


def inside(chunk: np.ndarray) -> tuple[int, int]:
    """First and last place in the chunk where white space follows another byte; (0, 0) if none.

    The tokenizer's words never run across such a place, whatever comes before or after it, so
    what is between the two has the same tokens in each text that has the chunk.
    """
    space = _SPACE[chunk]
    safe = np.flatnonzero(space[1:] & ~space[:-1] & (chunk[:-1] < 128)) + 1
    return (int(safe[0]), int(safe[-1])) if len(safe) else (0, 0)


def in_letters(chunk: bytes) -> tuple[int, int]:
    """First and last place of whole characters in a chunk of letters alone; (0, 0) if it has other characters.

    Such a chunk lies in one word of the tokenizer, whose tokens near the chunk's ends depend on what is around it.
    """
    lo, hi = 0, len(chunk)
    while lo < hi and chunk[lo] & 0xC0 == 0x80:
        lo += 1
    back = hi - 1
    while back > lo and chunk[back] & 0xC0 == 0x80:
        back -= 1
    if back >= lo and len(chunk) - back < (1 if chunk[back] < 0x80 else 2 if chunk[back] < 0xE0 else 3 if chunk[back] < 0xF0 else 4):
        hi = back
    return (lo, hi) if hi > lo and chunk[lo:hi].decode().isalpha() else (0, 0)


def _chunked(batches):
    for batch in batches:
        texts, f, r = batch.column("text").to_pylist(), batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy()
        rows = []
        for text, file, row in zip(texts, f.tolist(), r.tolist()):
            raw = text.encode()
            begin = 0
            # a short text is one chunk, which only other such texts share
            for end in chunks(rolling(np.frombuffer(raw, np.uint8))) if len(raw) >= MIN_CHUNK else [len(raw)] * bool(raw):
                digest = xxhash.xxh3_128_intdigest(raw[begin:end], int(len(raw) < MIN_CHUNK))
                rows.append((file, row, begin, end, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
                begin = end
        for at in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 100_000])], [FILE, ROW, "begin", "end", "h1", "h2"])


def _dictionary(side_path: str, vocabulary: str):
    def run(batches):
        side, enc = Side(side_path), encoding(vocabulary)
        for batch in batches:
            texts, rows = batch.column("text"), []
            for p, table, a, b in side.rows(batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy()):
                raw = texts[p].as_py().encode()
                for begin, end, h1, h2 in zip(*(table.column(c).slice(a, b - a).to_pylist() for c in ("begin", "end", "h1", "h2"))):
                    chunk = raw[begin:end]
                    lo, hi = (0, len(raw)) if len(raw) < MIN_CHUNK else inside(np.frombuffer(chunk, np.uint8))
                    letters = hi <= lo
                    if letters:
                        lo, hi = in_letters(chunk)
                        ids = np.array(enc._core_bpe.encode_single_piece(chunk[lo:hi]) if hi > lo else [], np.uint32)
                    else:
                        ids = encoded(enc, chunk[lo:hi].decode())
                    rows.append((h1, h2, lo, hi, letters, ids.astype("<u4").tobytes()))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["h1", "h2", "lo", "hi", "letters", "tokens"])

    return run


class _Apart(Exception):
    """The tokens of a chunk agree with those around it nowhere."""


def stitched(enc: tiktoken.Encoding, raw: bytes, parts: list[tuple[int, int, bool, bytes]]) -> np.ndarray:
    """Tokens of raw, of which the parts (begin, end, in letters, tokens) are known: what lies between them is encoded anew.

    Parts that aren't in letters end at places that no token crosses. Those in letters lie in one word: what is encoded anew
    grows into them, token by token, until the tokens at the join agree, that is, are the tokens of their
    bytes together. Tokens of a word of which that holds for all neighbours are those of the word, so the
    result is that of encoding the whole text.
    """
    try:
        return _stitched(enc, raw, parts)
    except _Apart:
        return encoded(enc, raw.decode())


def _stitched(enc: tiktoken.Encoding, raw: bytes, parts: list[tuple[int, int, bool, bytes]]) -> np.ndarray:
    out, at = [], 0
    ahead: tuple[np.ndarray, np.ndarray, int] | None = None  # a part in letters whose end isn't joined yet: tokens, their places, first

    def agree(a: int, b: int) -> bool:
        both = [int(a), int(b)]
        return enc._core_bpe.encode_single_piece(enc._core_bpe.decode_bytes(both)) == both

    def whole(place: int) -> bool:
        return place == len(raw) or raw[place] & 0xC0 != 0x80

    def between(end: int) -> np.ndarray:
        """Tokens from the last part to end, after which the last part is out."""
        nonlocal at, ahead
        if ahead is None:
            return encoded(enc, raw[at:end].decode())
        ids, places, first = ahead
        for last in range(len(ids), first, -1):
            if whole(places[last]) and places[last] <= end:
                new = encoded(enc, raw[places[last] : end].decode())
                if len(new) and agree(ids[last - 1], new[0]) or places[last] == len(raw):
                    out.append(ids[first:last])
                    at, ahead = int(places[last]), None
                    return new
        raise _Apart

    for begin, end, letters, tokens in parts:
        ids = np.frombuffer(tokens, "<u4")
        if not letters:
            if begin > at or ahead is not None:
                out.append(between(begin))
            out.append(ids)
            at = end
            continue
        places = begin + np.concatenate(([0], np.cumsum([len(enc._core_bpe.decode_bytes([int(x)])) for x in ids])))
        before = None  # the token before what is encoded anew
        for first in range(1, len(ids)):
            if not whole(places[first]):
                continue
            if before is None:
                joined = ahead is not None
                new = between(int(places[first]))
                before = int(out[-1][-1]) if joined else -1
            else:
                new = encoded(enc, raw[at : places[first]].decode())
            if len(new) and agree(new[-1], ids[first]) and (before < 0 or agree(before, new[0])):
                out.append(new)
                at, ahead = int(places[first]), (ids, places, first)
                break
        else:
            if before is not None and before >= 0:
                raise _Apart
    if at < len(raw) or ahead is not None:
        out.append(between(len(raw)))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _assembled(side_path: str, vocabulary: str):
    def run(batches):
        side, enc = Side(side_path), encoding(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = {}
            for p, table, a, b in side.rows(batch.column(FILE).to_numpy(), batch.column(ROW).to_numpy()):
                known[p] = sorted(zip(*(table.column(c).slice(a, b - a).to_pylist() for c in ("begin", "end", "letters", "tokens"))))
            ids = [None if t is None else stitched(enc, t.encode(), known[i]) if i in known else encoded(enc, t) for i, t in enumerate(texts)]
            back = [None if t is None else enc._core_bpe.decode_bytes(x.tolist()) == t.encode() for t, x in zip(texts, ids)]
            sizes = np.array([0 if x is None else len(x) for x in ids], np.int32)
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            values = np.concatenate([np.empty(0, np.uint32), *(x for x in ids if x is not None)]).view(np.int32)
            empty = pa.array([x is None for x in ids], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=empty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(sizes), pa.array(back, pa.bool_())], ["doc_id", "tokens", "n_tokens", "exact"])

    return run


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, n_tokens, exact (decoding gives the text's bytes again) for each row of docs.

    Texts are cut into chunks where a rolling hash of their bytes says so. A chunk that occurs more
    than once, in any texts, is encoded once; its tokens are used wherever it occurs, and the joins are
    encoded anew between the nearest places that no token crosses, or, in chunks of letters alone, until the tokens at
    both ends agree. A text below MIN_CHUNK bytes is one chunk. All other text is encoded where it is. The
    vocabulary's file must be at its path on every executor. The tokens are those of encoding each whole text. A null text has null tokens, 0 n_tokens and
    null exact; an empty one an empty list; repeated rows have the same tokens. Other columns aren't read.
    """
    keyed = with_row_key(docs, ["doc_id", "text"])
    found = keyed.where("text is not null").select("text", FILE, ROW).transform(mapped, _chunked, f"{FILE} long, {ROW} long, begin long, end long, h1 long, h2 long")
    found = saved(found, "chunks")
    shared = saved(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(FILE, ROW, "begin", "end")).alias("own")).where("n > 1"), "shared")
    owners = shared.select("own.*", "h1", "h2")
    once = saved(keyed.select("text", FILE, ROW).transform(mapped, _dictionary(write_side(owners, "owners", docs), vocabulary), "h1 long, h2 long, lo long, hi long, letters boolean, tokens binary"), "dictionary")
    uses = found.join(once.where("hi > lo"), ["h1", "h2"]).select(FILE, ROW, (F.col("begin") + F.col("lo")).alias("begin"), (F.col("begin") + F.col("hi")).alias("end"), "letters", "tokens")
    kind = dict(docs.dtypes)["doc_id"]
    return keyed.transform(mapped, _assembled(write_side(uses, "uses", docs), vocabulary), f"doc_id {kind}, tokens array<int>, n_tokens int, exact boolean")


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, tokens. Null tokens give a null text, an empty list an empty one; bytes
    that aren't UTF-8 become U+FFFD, an id that the vocabulary lacks fails."""

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            texts = [None if x is None else enc._core_bpe.decode_bytes(x).decode("utf-8", "replace") for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "tokens").transform(mapped, run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
