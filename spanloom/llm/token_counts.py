"""Token counts by rank-synchronous array merging.

Texts are cut at the special string, then into pre-tokens. The distinct pre-tokens that a
worker has not counted before are held as one ragged numpy array of symbol ids; in every
round each sequence's lowest-rank pair is merged at all its places at once, until no sequence
has a mergeable pair. What survives of a sequence is its token count.

A file whose model, normaliser or pre-tokeniser is of another kind than what is computed here is
refused when it loads.

Defined cases: null and empty texts have no tokens; repeated rows are counted one by one;
an empty table gives an empty table; other columns are ignored; a text is never cut short.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import full_texts, map_slices, pick, spread
from .merging import Pairs, merge_all

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Pre-tokens that a worker remembers, and the longest one it keeps.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 48
#: Symbols merged in one ragged array.
ROUND_SYMBOLS = 1 << 20
#: What a file says of a plain byte-level model, with the pre-tokeniser whose regular expression
#: is the byte-level one's own.
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + sum(x not in plain for x in range(b))))
    return [letters[b] for b in range(256)]


def check_plain(spec: dict, pattern: str) -> None:
    """Raise unless the file's tokens are those of ``pattern`` and merges alone."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k, v in PLAIN_MODEL.items() if (model.get(k) or v) != v]
    if spec.get("normalizer") is not None:
        odd.append("normalizer")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or pattern != BYTE_LEVEL:
        odd.append("pre_tokenizer")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        odd.append("added_tokens")
    if odd:
        raise ValueError(f"not a plain byte-level file: {', '.join(odd)}")


class Merges:
    """Merge table of a byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_plain(spec, pattern)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.pairs = Pairs(((vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)), max(vocab.values()) + 1)
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]


def merge_counts(merges: Merges, sequences: list[bytes]) -> np.ndarray:
    """Surviving symbols of each sequence."""
    return merge_all(merges.pairs, merges.byte_ids[np.frombuffer(b"".join(sequences), np.uint8)], np.array([len(s) for s in sequences], np.int64))[1]


class Counter:
    """Counts tokens of texts; remembers the counts of short pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path, pattern)
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.specials, key=len, reverse=True)))) if self.merges.specials else None
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > CACHE_ENTRIES:
            self.known.clear()
        batch: list[str] = []
        held = 0
        for piece in pieces:
            batch.append(piece)
            held += len(piece)
            if held >= ROUND_SYMBOLS:
                self._count(batch)
                batch, held = [], 0
        if batch:
            self._count(batch)

    def _count(self, batch: list[str]) -> None:
        self.known.update(zip(batch, merge_counts(self.merges, [p.encode() for p in batch]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        plain, specials, find = [], [], self.pattern.findall
        for text in texts:
            n = 0
            if self.special is not None and any(s in text for s in self.merges.specials):
                parts = self.special.split(text)
                n, pieces = len(parts) - 1, [p for part in parts for p in find(part)]
            else:
                pieces = find(text)
            plain.append(pieces)
            specials.append(n)
        distinct = set().union(*plain)
        fresh = [p for p in distinct if p not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > CACHE_ENTRIES:
                self.known.clear()
                fresh = list(distinct)
            self.learn(fresh)
        get = self.known.__getitem__
        out = [sum(map(get, pieces)) + n for pieces, n in zip(plain, specials, strict=True)]
        for p in [p for p in fresh if len(p) > CACHE_CHARS]:
            self.known.pop(p, None)
        return out


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    """One counter for each worker process."""
    return Counter(path, pattern)


def token_counts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row, by the byte-level BPE file at ``path``."""

    def run(part: pa.RecordBatch) -> dict:
        texts = full_texts(part.column(1))
        return {"doc_id": part.column(0).cast(pa.int64()), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(counter(path, pattern).count(texts.to_pylist()), pa.int64())}

    return map_slices(spread(pick(df, doc_id=id_col, text=text_col)), SCHEMA, run)
