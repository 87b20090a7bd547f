"""Quality rules by repetition coverage.

Words are runs of anything but ASCII white space. Rolling hashes over the words' ids give
the keys of all n-grams of several lengths in numpy; a character counts as covered if it lies
in a word of an n-gram that its text holds twice or more, or in a repeated line. Texts are
measured whole, in slices of bounded bytes; no row is exchanged between tasks.

Defined cases: a null or empty text has no words, so its base check fails and it is not kept;
repeated rows are measured one by one; an empty table gives an empty table; other columns
of the input are ignored by ``repetition_rules`` and returned as they are by ``keep_rows``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import filter_rows, full_texts, map_slices, pick, spread

#: n-gram length in words -> largest share of word characters inside duplicated n-grams. Words in
#: repeated n-grams are in repeated 3-grams too, which the base check caps at half of the words:
#: limits near that half would reject nothing more, so these are the published ones.
NGRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest share of line characters in lines that repeat an earlier one.
LINE_LIMIT = 0.20
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS)).astype(np.int64)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_cover double, "
    + ", ".join(f"cover_{n} double" for n in NGRAM_LIMITS)
    + ", base_failed boolean, kept boolean"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Where a key occurs more than once."""
    if keys.size < 2:
        return np.zeros(keys.size, bool)
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not again.size:
        return np.zeros(keys.size, bool)
    again = again[np.r_[True, again[1:] != again[:-1]]]
    at = np.minimum(np.searchsorted(again, keys), again.size - 1)
    return again[at] == keys


def _by_doc(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and where each text's words start."""
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():
        starts = np.concatenate([[0], np.cumsum(mask)])[starts]
        flat = flat.filter(full)
    return flat, starts


def _exact_windows(mask: np.ndarray, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Of windows that share a hash, those that share their words."""
    at = np.flatnonzero(mask)
    if at.size:
        rows = np.stack([doc[at], *(ids[at + k] for k in range(n))], axis=1)
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        mask[at[counts[inverse.ravel()] < 2]] = False
    return mask


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id for an array of texts without nulls."""
    n_docs = len(texts)
    words, starts = _words(texts)
    n_words = np.diff(starts)
    doc = np.repeat(np.arange(n_docs), n_words)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = _by_doc(chars, starts)

    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n_docs + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    n_symbols = _by_doc(_SYMBOL[raw], offsets - offsets[0])

    lines = pc.split_pattern(texts, "\n")
    at = lines.offsets.to_numpy().astype(np.int64)
    flat = lines.values.slice(at[0], at[-1] - at[0])
    line_doc = np.repeat(np.arange(n_docs), np.diff(at))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)[full]
    line_doc = line_doc[full]
    _, first = np.unique(line_doc * (codes.max(initial=0) + 1) + codes, return_index=True)
    count = lambda d, w=None: np.bincount(d, weights=w, minlength=n_docs)
    n_dup_lines = (count(line_doc) - count(line_doc[first])).astype(np.int64)
    line_chars = count(line_doc, size)
    line_cover = (line_chars - count(line_doc[first], size[first])) / np.maximum(line_chars, 1)

    # powers of the multiplier and their inverses turn one prefix sum into every window's hash
    n = ids.size
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULTIPLIER)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))]))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(ids.astype(np.uint64) + np.uint64(1)) * power[:n])])
        seed = _mixed(doc.astype(np.uint64) * _MULTIPLIER + np.uint64(7))

        def covered(length: int, exact: bool) -> np.ndarray:
            """Words inside windows of this length that their text holds at least twice."""
            if n < length:
                return np.zeros(n, bool)
            keys = _mixed((prefix[length:] - prefix[:-length]) * back[: n - length + 1]) ^ seed[: n - length + 1]
            inside = np.flatnonzero(doc[length - 1 :] == doc[: n - length + 1])
            mask = np.zeros(n - length + 1, bool)
            mask[inside] = _twice(keys[inside])
            if exact:
                mask = _exact_windows(mask, doc, ids, length)
            step = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(mask)
            step[at] += 1
            np.subtract.at(step, at + length, 1)
            return np.cumsum(step)[:n] > 0

        n_repeat_words = _by_doc(covered(3, True), starts)
        cover = {k: _by_doc(chars * covered(k, False), starts) / np.maximum(word_chars, 1) for k in NGRAM_LIMITS}

    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)
    kept = ~base_failed & (line_cover <= LINE_LIMIT)
    for k, most in NGRAM_LIMITS.items():
        kept &= cover[k] <= most
    return (
        {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "line_cover": line_cover}
        | {f"cover_{k}": v for k, v in cover.items()}
        | {"base_failed": base_failed, "kept": kept}
    )


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict per row, as SCHEMA names them."""
    return map_slices(
        spread(pick(df, doc_id=id_col, text=text_col)), SCHEMA, lambda part: {"doc_id": part.column(0).cast(pa.int64())} | measure(full_texts(part.column(1)))
    )


def keep_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns."""
    return filter_rows(df, text_col, lambda texts: measure(texts)["kept"])


_LENGTHS = (3, *NGRAM_LIMITS)
_GRAMS = ", ".join("word || ' ' || " + " || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(1, n)) + f" AS gram_{n}" for n in _LENGTHS)
_COVERS = "".join(
    f"""
cover_{n}_ AS (
  SELECT rid, sum(CASE WHEN inside THEN length(word) ELSE 0 END) AS covered, sum(inside::INT) AS n_inside FROM (
    SELECT rid, word, max(twice) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM (
      SELECT rid, pos, word, gram_{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram_{n}) > 1 AS twice FROM grams_))
  GROUP BY rid),"""
    for n in _LENGTHS
)
SQL = rf"""
WITH rows_ AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, len(words) AS n FROM documents),
words_ AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM rows_),
grams_ AS MATERIALIZED (SELECT rid, pos, word, {_GRAMS} FROM words_ WINDOW o AS (PARTITION BY rid ORDER BY pos)),
lines_ AS (
  SELECT rid, length(line) AS chars, row_number() OVER (PARTITION BY rid, line) > 1 AS again
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rows_) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
by_line AS (SELECT rid, sum(again::INT) AS n_dup_lines, sum(CASE WHEN again THEN chars ELSE 0 END) AS covered, sum(chars) AS chars FROM lines_ GROUP BY rid),
by_word AS (SELECT rid, sum(length(word)) AS word_chars FROM words_ GROUP BY rid),{_COVERS}
measured AS (
  SELECT doc_id, n::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(cover_3_.n_inside, 0)::BIGINT AS n_repeat_words,
    coalesce(l.covered::DOUBLE / greatest(l.chars, 1), 0) AS line_cover,
    {", ".join(f"coalesce(cover_{n}_.covered::DOUBLE / greatest(word_chars, 1), 0) AS cover_{n}" for n in NGRAM_LIMITS)}
  FROM rows_ LEFT JOIN by_line l USING (rid) LEFT JOIN by_word USING (rid) {" ".join(f"LEFT JOIN cover_{n}_ USING (rid)" for n in _LENGTHS)}),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND line_cover <= {LINE_LIMIT} AND {" AND ".join(f"cover_{n} <= {most}" for n, most in NGRAM_LIMITS.items())} AS kept FROM judged
"""
