"""Quality classifier by positive-unlabelled learning.

A logistic scorer over the shape of a text (shares of letters, cases, symbols and repeated
words, line and word lengths; no word, label, language, source or id is an input) minimises
the non-negative unbiased risk: with class prior p, logistic loss l and scorer g,

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

Positives are trusted labelled rows; labelled negatives are not used at all. The unlabelled side
is every row of the web text that is not held out. p is estimated from the two: a first scorer
tells one half of the positives from the unlabelled rows; above each threshold lies a share of
the other half and a share of the unlabelled rows, and the least ratio of the two, where both
are surely known, bounds p and is it if some threshold leaves only positives. The logistic loss
makes g the log odds of being positive, so its logistic value is the score.

The features of all rows are staged once. Each Newton step, the moments and the histogram for p
are sums over all of them, taken in the cluster: whole numbers, so that equal data give an equal
model in whatever order and on however many tasks they are summed. The driver gets a few hundred
sums a step. Only the labelled side is bounded: ``MAX_POSITIVES`` rows, those with the smallest
hashes of their ids.

Defined cases: texts without words (null, empty, blank) score 0; repeated rows are scored, and
count as unlabelled ones, one by one; a labelled id counts once in the fit, with one of its
texts, and only if it is never labelled bad; labels that are null, or whose id has no text, are
left out; without any positive every other score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_rows, full_texts, map_slices, pick, spread

MAX_POSITIVES = 10_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Squared weights are held back by DECAY / 2 over the number of positives.
DECAY = 30.0
#: Passes over the unlabelled rows that a fit takes at most, and the step below which it ends.
MAX_PASSES, LEAST_STEP = 20, 0.01
#: Whole-number units of inputs, weights and summed terms: products of a batch stay below 2^53.
_IN, _WEIGHT, _TERM = 1 << 8, 1 << 16, 1 << 12
_LARGEST_WEIGHT = 32.0
#: Bins of a scorer's margin, from -LIMIT to LIMIT.
_BINS, _LIMIT = 512, 16.0
#: Thresholds are trusted that leave at least this share of the positives.
LEAST_SHARE = 0.2

_BYTES = np.arange(256)
_CLASSES = {
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "blank": np.isin(_BYTES, [32, 9, 11, 12, 13]),
    "line": _BYTES == 10,
    "stop": np.isin(_BYTES, list(b".?")),
    "comma": np.isin(_BYTES, list(b",;:")),
    "shout": _BYTES == ord("!"),
    "bar": _BYTES == ord("|"),
    "mark": np.isin(_BYTES, list(b"#*$%&<>@^~=+_\\{}[]")),
    "quote": np.isin(_BYTES, list(b"\"'()-/`")),
    "wide": _BYTES >= 128,
}
FEATURES = [*_CLASSES, "log_words", "log_word_length", "distinct_words", "runs", "line_words", "repeated_lines", "no_words"]


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of an array without nulls, as staged: in single precision."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    code = np.zeros(256, np.uint8)
    for k, member in enumerate(_CLASSES.values()):
        code[member] = k + 1
    width = len(_CLASSES) + 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * width + code[raw], minlength=n * width).reshape(n, width)[:, 1:]
    shares = counts / np.maximum(size, 1)[:, None]

    def parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, id, byte length) of the non-empty items."""
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(at[0], at[-1] - at[0])
        length = pc.binary_length(flat).to_numpy(zero_copy_only=False)
        ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        full = length > 0
        return np.repeat(np.arange(n), np.diff(at))[full], ids[full], length[full]

    def distinct(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
        keys = np.unique(doc * (ids.max(initial=0) + 1) + ids)
        return np.bincount(keys // (ids.max(initial=0) + 1), minlength=n)

    word_doc, words, length = parts(pc.ascii_split_whitespace(texts))
    line_doc, lines, _ = parts(pc.split_pattern(texts, "\n"))
    n_words, n_lines = np.bincount(word_doc, minlength=n), np.bincount(line_doc, minlength=n)
    same = np.zeros(words.size, bool)
    same[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
    some = np.maximum(n_words, 1)
    return np.column_stack(
        [
            shares,
            np.log1p(n_words),
            np.log1p(np.bincount(word_doc, weights=length, minlength=n) / some),
            distinct(word_doc, words) / np.sqrt(some),
            np.bincount(word_doc, weights=same, minlength=n) / some,
            np.log1p(n_words / np.maximum(n_lines, 1)),
            1 - distinct(line_doc, lines) / np.maximum(n_lines, 1),
            n_words == 0,
        ]
    ).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # one for each feature, and the bias

    def design(self, x: np.ndarray) -> np.ndarray:
        """Rows of standardised inputs and a constant, in whole units of 1 / _IN."""
        z = np.rint(np.clip((x.astype(np.float64) - self.mean) / self.scale, -4, 4) * _IN)
        return np.hstack([z, np.full((len(z), 1), float(_IN))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights / _IN

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, FEATURES.index("no_words")] > 0, 0.0, _sigmoid(self.margin(x)))


N_WEIGHTS = len(FEATURES) + 1
CONSTANT = Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(N_WEIGHTS))
_UPPER = np.triu_indices(N_WEIGHTS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _whole(w: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(w, -_LARGEST_WEIGHT, _LARGEST_WEIGHT) * _WEIGHT) / _WEIGHT


@dataclass(frozen=True)
class Terms:
    """Means over the unlabelled rows at some weights: loss of calling them negative, its
    gradient and its second derivatives."""

    loss: float
    gradient: np.ndarray
    hessian: np.ndarray


def loss_sums(model: Model, x: np.ndarray) -> np.ndarray:
    """Whole-number sums over rows: count, losses, gradients, upper second derivatives."""
    d = model.design(x)
    g = d @ model.weights / _IN
    s = _sigmoid(g)
    curve = np.rint(s * (1 - s) * _TERM)
    second = (d * curve[:, None]).T @ d
    return np.concatenate([[len(x), np.rint(_softplus(g) * _TERM).sum()], np.rint(s * _TERM) @ d, second[_UPPER]]).astype(np.int64)


def terms(sums: list[int]) -> Terms:
    n = max(1, sums[0])
    hessian = np.zeros((N_WEIGHTS, N_WEIGHTS))
    hessian[_UPPER] = [x / (n * _TERM * _IN * _IN) for x in sums[2 + N_WEIGHTS :]]
    hessian = hessian + np.triu(hessian, 1).T
    return Terms(sums[1] / (n * _TERM), np.array([x / (n * _TERM * _IN) for x in sums[2 : 2 + N_WEIGHTS]]), hessian)


def pu_risk(t: Terms, positive: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The non-negative risk, its negative side, and the derivatives where that is above 0.
    positive: design rows in units of 1. With the logistic loss, p * (E_pos[l(g)] - E_pos[l(-g)])
    is -p * E_pos[g], so the risk bends as the unlabelled rows say."""
    g = positive @ w
    negative = t.loss - prior * float(_softplus(g).mean())
    return prior * float(_softplus(-g).mean()) + max(0.0, negative), negative, t.gradient - prior * positive.mean(axis=0), t.hessian


def split_risk(t: Terms, positive: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The plain risk of telling positives from unlabelled rows, each side half of it."""
    g = positive @ w
    s = _sigmoid(-g)
    bend = (positive * (s * (1 - s))[:, None]).T @ positive / len(g)
    return (t.loss + float(_softplus(-g).mean())) / 2, math.inf, (t.gradient - (positive * s[:, None]).mean(axis=0)) / 2, (t.hessian + bend) / 2


def minimised(at: Callable[[np.ndarray], Terms], risk: Callable, decay: float) -> np.ndarray:
    """Newton steps on the risk; one that raises it, or takes its negative side below 0, is
    halved until it does not."""
    hold = np.append(np.full(N_WEIGHTS - 1, decay), 1e-6)
    w, best, value = np.zeros(N_WEIGHTS), None, math.inf
    for _ in range(MAX_PASSES):
        found, negative, gradient, hessian = risk(at(w), w)
        found += float((hold * w * w).sum()) / 2
        if best is not None and (found > value + 1e-9 or negative < 0):
            w = _whole((best + w) / 2)
            if np.abs(w - best).max() < LEAST_STEP:
                break
            continue
        best, value = w, found
        step = np.linalg.solve(hessian + np.diag(hold), gradient + hold * w)
        if np.abs(step).max() < LEAST_STEP:
            break
        w = _whole(w - step * min(1.0, 4 / np.abs(step).max()))
    return best


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the counts of both by margin bin."""
    n_u, n_p = max(1, int(unlabelled.sum())), max(1, int(positive.sum()))
    above = lambda x, n: np.cumsum(x[::-1])[::-1] / n
    q_u, q_p = above(unlabelled, n_u), above(positive, n_p)
    doubt = math.sqrt(math.log(40) / (2 * n_u)) + math.sqrt(math.log(40) / (2 * n_p))
    some = q_p >= LEAST_SHARE
    at = int(np.argmin((q_u[some] + 1.01 * doubt) / q_p[some]))
    return float(np.clip(q_u[some][at] / q_p[some][at], 0.02, 0.98))


def margin_bins(margin: np.ndarray) -> np.ndarray:
    at = np.floor((np.clip(margin, -_LIMIT, _LIMIT) + _LIMIT) * (_BINS / (2 * _LIMIT)))
    return np.bincount(np.minimum(at, _BINS - 1).astype(np.int64), minlength=_BINS)


_MOMENT = 1 << 16


def moment_sums(x: np.ndarray) -> np.ndarray:
    units = np.rint(x.astype(np.float64) * _MOMENT)
    return np.concatenate([[len(x)], units.sum(axis=0), np.rint(x.astype(np.float64) ** 2 * _MOMENT).sum(axis=0)]).astype(np.int64)


def fit(sums: Callable[[Callable[[np.ndarray], np.ndarray]], list[int]], positive: np.ndarray) -> tuple[Model, float]:
    """The model and the prior. ``sums`` adds up a function of feature rows over all unlabelled
    rows; positive: feature rows."""
    n, *moments = sums(moment_sums)
    k = len(FEATURES)
    mean = np.array([x / (n * _MOMENT) for x in moments[:k]])
    spread_ = np.array([x / (n * _MOMENT) for x in moments[k:]]) - mean**2
    blank = Model(mean, np.sqrt(np.maximum(spread_, 0)) + 1e-6, np.zeros(N_WEIGHTS))
    of = lambda w: Model(blank.mean, blank.scale, w)
    at = lambda w: terms(sums(lambda x: loss_sums(of(w), x)))
    rows = blank.design(positive) / _IN
    decay = DECAY / len(rows)
    one, two = (rows[::2], positive[1::2]) if len(rows) > 1 else (rows, positive)
    first = of(minimised(at, lambda t, w: split_risk(t, one, w), decay))
    prior = estimated_prior(np.array(sums(lambda x: margin_bins(first.margin(x)))), margin_bins(first.margin(two)))
    return of(minimised(at, lambda t, w: pu_risk(t, rows, w, prior), decay)), prior


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row of docs (doc_id, text)."""
    return map_slices(spread(docs), "doc_id long, x array<float>", lambda part: {"doc_id": part.column(0).cast(pa.int64()), "x": _lists(features(full_texts(part.column(1))))})


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def summed(rows: DataFrame) -> Callable[[Callable[[np.ndarray], np.ndarray]], list[int]]:
    """Adds up whole-number vectors over the rows (x): one vector for each task, then by place."""

    def of(fn: Callable[[np.ndarray], np.ndarray]) -> list[int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                found = fn(_matrix(batch.column(0)))
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total, pa.int64())], names=["place", "n"])

        got = rows.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        return [int(r["n"]) for r in sorted(got)]

    return of


def trained(rows: DataFrame, labels: DataFrame) -> Model:
    """rows (doc_id, x) as staged, labels (doc_id, y: 1 good, 0 bad)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (_fold() != HELD_OUT))
    trusted = usable.groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1").select("doc_id")
    chosen = trusted.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVES)
    # at most MAX_POSITIVES ids; rows come in any order: sorted, equal data give an equal model
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    web = rows.where(F.coalesce(_fold() != HELD_OUT, F.lit(True))).select("x")
    if not got.num_rows or web.isEmpty():
        return CONSTANT
    return fit(summed(web), _matrix(got["x"].combine_chunks()))[0]


def _narrow(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    return pick(docs, doc_id=id_col, text=text_col), pick(labels, doc_id="doc_id", y=label_col)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    docs, labels = _narrow(docs, labels, id_col, text_col, label_col)
    scratch = Scratch(docs.sparkSession, "features")
    model = trained(scratch.stage(featured(docs), "rows"), labels)
    scratch.free_all()
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _scored(ids: pa.Array, x: np.ndarray, model: Model) -> dict:
    held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()]
    s = model.score(x)
    return {"doc_id": ids.cast(pa.int64()), "held_out": pa.array(held, pa.bool_()), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row. A null id is not held out."""
    return map_slices(spread(pick(df, doc_id=id_col, text=text_col)), SCHEMA, lambda part: _scored(part.column(0), features(full_texts(part.column(1))), model))


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``score`` by the model ``fitted`` to the same rows, whose features are computed once."""
    docs, labels = _narrow(docs, labels, id_col, text_col, label_col)
    rows = Scratch(docs.sparkSession, "features").stage(featured(docs), "rows")
    model = trained(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scored(batch.column(0), _matrix(batch.column(1)), model)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return rows.mapInArrow(run, SCHEMA)


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows predicted good, with all their columns."""
    return filter_rows(df, text_col, lambda texts: model.score(features(texts)) >= THRESHOLD)
