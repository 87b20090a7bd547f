"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is laid out in chunks that overlap, and the chunks are dealt over all tasks. Each is
pre-tokenised by itself, knowing nothing of the text before it; its first matches may be wrong,
and so may those at its end whose extent depends on text beyond. Where a settled boundary of the
chunk before also is a boundary of the next chunk, both agree from there on (a match looks only
forward), so the pieces are stitched there. A chunk's task encodes its pieces by rank and sends
their ids and, of the overlaps only, boundaries and token counts; stitching a text drops the ids
that two chunks have in common. A text in which a seam finds no boundary (one match as long as
the overlap) is decoded from the ids of its chunks by the task that would stitch it, and encoded
whole there, so no text is read or exchanged again. Decoding concatenates the raw bytes of the ids.

A match is settled if the chunk holds what it may have looked at: three characters from its
start, the white space after it and three more. Patterns that look back, or further ahead than
that, are refused when they load; some are probed for by cutting short texts.

Defined cases: null and empty texts have no ids and decode to empty bytes; repeated rows are
encoded one by one; an empty table gives an empty table; other columns are ignored by
this operator. A lost task is run again on the same rows, since rows of Parquet files keep their
places.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_slices, pick, spread
from .merging import Pairs, merge_all

CHUNK_CHARS, OVERLAP_CHARS = 1 << 14, 1 << 8
#: Pieces that a worker remembers, and the longest one it keeps.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Symbols merged in one ragged array.
ROUND_SYMBOLS = 1 << 20
#: Characters beyond a match, after white space, and from its start, that it may look at.
AHEAD = 3

_CLASS = re.compile(r"\[(?:\\.|[^\]\\])*\]")
_UNBOUNDED = re.compile(r"\(\?<[=!]|\\[bBAGZzKXR1-9]|[\^$]|\(\?[=!](?!(?:\\.|\[\]|.)\))")


@dataclass(frozen=True)
class Matched:
    """The pieces of a chunk, their edges, and how many of its first pieces are settled."""

    pieces: list[str]
    edges: np.ndarray
    settled: int


def matched(pattern: regex.Pattern, text: str, last: bool) -> Matched:
    pieces = pattern.findall(text)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    if edges[-1] != len(text):
        raise ValueError("the pattern must match every character")
    settled = len(pieces)
    while not last and settled:
        start, stop = int(edges[settled - 1]), int(edges[settled])
        while stop < len(text) and text[stop].isspace():
            stop += 1
        if max(stop, start) + AHEAD <= len(text):
            break
        settled -= 1
    return Matched(pieces, edges, settled)


def common_edge(before: np.ndarray, after: np.ndarray) -> int | None:
    """The first place that is an edge of both, and its indices; None without one."""
    both = np.intersect1d(before, after)
    return int(both[0]) if both.size else None


def stitch(pattern: regex.Pattern, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str] | None:
    """The matches of ``pattern`` in the whole text, from those in chunks; None if a seam finds
    no common edge. What the distributed encoder does, on pieces instead of ids."""
    starts = range(0, max(1, len(text)), chunk)
    parts = [matched(pattern, text[s : s + chunk + overlap], s + chunk >= len(text)) for s in starts]
    pieces: list[str] = []
    low = 0
    for k, part in enumerate(parts):
        high = len(part.pieces)
        if k + 1 < len(parts):
            inside = part.edges[: part.settled + 1]
            x = common_edge(inside[inside >= chunk] - chunk, parts[k + 1].edges[parts[k + 1].edges <= overlap])
            if x is None:
                return None
            high = int(np.searchsorted(part.edges, x + chunk))
            following = int(np.searchsorted(parts[k + 1].edges, x))
        pieces += part.pieces[low:high]
        low = following if k + 1 < len(parts) else 0
    return pieces


@lru_cache(maxsize=8)
def checked(pattern: str) -> regex.Pattern:
    """The compiled pattern, if chunks of it can be stitched."""
    compiled = regex.compile(pattern)
    if compiled.groups or _UNBOUNDED.search(_CLASS.sub("[]", pattern)):
        raise ValueError("the pattern has groups, looks back, or looks ahead without a bound")
    rng = random.Random(1)
    bits = ["a", "Bc", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "7", "12", "é", "中", "🙂", "#", "--", "\x85", " \n "]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(60))
        found = stitch(compiled, text, 24, 12)
        if found is not None and found != compiled.findall(text):
            raise ValueError("the pattern looks further than chunks overlap")
    return compiled


class Codec:
    """Ranks of a tiktoken file: pieces to ids as little-endian unsigned 32-bit bytes, and back."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = checked(pattern)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        get = ranks.get
        halves = ((get(t[:i]), get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t)))
        self.pairs = Pairs(((a, b, r, r) for a, b, r in halves if a is not None and b is not None), len(self.tokens))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}

    def _merge(self, pieces: list[str], raw: list[bytes]) -> None:
        lengths = np.array([len(x) for x in raw], np.int64)
        ids, lengths = merge_all(self.pairs, self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], lengths)
        said, ends = ids.astype("<u4").tobytes(), (np.cumsum(lengths) * 4).tolist()
        self.known.update((p, said[e - 4 * n : e]) for p, e, n in zip(pieces, ends, lengths.tolist(), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that are tokens are looked up, the others merged in rounds of bounded size."""
        batch, raw, size = [], [], 0
        for piece in pieces:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
                continue
            batch.append(piece)
            raw.append(data)
            size += len(data)
            if size >= ROUND_SYMBOLS:
                self._merge(batch, raw)
                batch, raw, size = [], [], 0
        if batch:
            self._merge(batch, raw)

    def encode_pieces(self, lists: list[list[str]]) -> list[list[bytes]]:
        """The ids of each piece of each list."""
        distinct = set().union(*lists)
        fresh = [p for p in distinct if p not in self.known]
        if fresh and len(self.known) + len(fresh) > CACHE_ENTRIES:
            self.known.clear()
            fresh = list(distinct)
        self._learn(fresh)
        out = [list(map(self.known.__getitem__, pieces)) for pieces in lists]
        for p in [p for p in fresh if len(p) > CACHE_CHARS]:
            del self.known[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(x) for x in self.encode_pieces([self.pattern.findall(t) for t in texts])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


CHUNK = "row long, doc_id long, k int, n int, ids binary, head array<int>, head_tokens array<int>, tail array<int>, tail_tokens array<int>"


def chunked(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, k, n and the k-th of n chunks of each text, by column functions."""
    named = long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = held(named, "parts", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0))).drop("text")
    both = F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.left(F.get("parts", i + 1), F.lit(overlap)), F.lit(""))))
    return parts.select("row", "doc_id", F.size("parts").alias("n"), F.posexplode(both).alias("k", "text")).select("row", "doc_id", "k", "n", "text")


def encoded_chunks(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def run(part: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        last = [k + 1 == n for k, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
        found = [matched(own.pattern, t, end) for t, end in zip(part.column(4).to_pylist(), last, strict=True)]
        rows: list[list] = [[] for _ in range(5)]
        for m, pieces in zip(found, own.encode_pieces([m.pieces for m in found]), strict=True):
            tokens = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)])
            head = m.edges <= overlap
            tail = np.flatnonzero(m.edges[: m.settled + 1] >= chunk)
            for column, value in zip(rows, (b"".join(pieces), m.edges[head], tokens[head], m.edges[tail] - chunk, tokens[tail]), strict=True):
                column.append(value)
        lists = [pa.array(x, pa.list_(pa.int32())) for x in rows[1:]]
        return {f"c{i}": part.column(i) for i in range(4)} | {"ids": pa.array(rows[0], pa.binary())} | {f"l{i}": x for i, x in enumerate(lists)}

    names = [x.split()[0] for x in CHUNK.split(", ")]

    def named(part: pa.RecordBatch) -> dict:
        return dict(zip(names, run(part).values(), strict=True))

    return map_slices(chunks, CHUNK, named, text=4)


def joined_ids(parts: list[dict]) -> bytes | None:
    """The ids of a text from its chunks in order; None if a seam finds no common edge."""
    out, low = [], 0
    for k, part in enumerate(parts):
        high, following = len(part["ids"]) // 4, 0
        if k + 1 < len(parts):
            after = parts[k + 1]
            x = common_edge(np.array(part["tail"], np.int64), np.array(after["head"], np.int64))
            if x is None:
                return None
            high, following = part["tail_tokens"][part["tail"].index(x)], after["head_tokens"][after["head"].index(x)]
        out.append(part["ids"][4 * low : 4 * high])
        low = following
    return b"".join(out)


def joined_text(own: Codec, parts: list[dict], chunk: int) -> str:
    """A text from the ids of its chunks in order, which hold every byte of them."""
    return "".join(own.decode(part["ids"]).decode()[:chunk] for part in parts)


def _encoded(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, finish: Callable[[Codec, bytes], tuple], chunk: int, overlap: int) -> DataFrame:
    """doc_id and what ``finish`` makes of the ids of every row, in the columns of ``schema``."""
    checked(pattern)
    docs = pick(df, doc_id=id_col, text=text_col)
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def columns(rows: list[tuple]) -> dict:
        return {name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)}

    def whole(part: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        ids = own.encode([x or "" for x in part.column(1).to_pylist()])
        return {"doc_id": part.column(0).cast(pa.int64())} | columns([finish(own, x) for x in ids])

    def joined(parts: pa.Table) -> pa.Table:
        own, rows = codec(path, pattern), sorted(parts.to_pylist(), key=lambda r: r["k"])
        ids = joined_ids(rows)
        if ids is None:
            ids = own.encode([joined_text(own, rows, chunk)])[0]
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64())} | columns([finish(own, ids)]))

    is_long = F.length("text") > chunk + overlap
    short = map_slices(spread(docs.where(~F.coalesce(is_long, F.lit(False)))), f"doc_id long, {schema}", whole)
    # a chunk for each row of an exchange, so that the chunks of one text are matched in many tasks
    chunks = chunked(docs.where(is_long), chunk, overlap).repartition(F.col("row"), F.col("k"))
    grouped = encoded_chunks(chunks, path, pattern, chunk, overlap).groupBy("row", "doc_id")
    return short.unionByName(grouped.applyInArrow(joined, f"doc_id long, {schema}"))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens and token_ids (little-endian unsigned 32-bit) of every row."""
    return _encoded(df, path, pattern, id_col, text_col, "n_tokens long, token_ids binary", lambda _, ids: (len(ids) // 4, ids), chunk, overlap)


def decode_column(path: str, pattern: str):
    """A column function: token_ids to the bytes that they stand for; null to null."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield pa.array([None if x is None else codec(path, pattern).decode(x) for x in ids.to_pylist()], pa.binary())

    return decoded


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Encode, decode the ids again, and reduce both to digests in the worker that holds the ids:
    what ``encode`` and ``decode_column`` give, without sending ids and bytes between processes."""

    def reduce(own: Codec, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _encoded(df, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", reduce, chunk, overlap)
