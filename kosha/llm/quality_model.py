"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are cut into quantile bins; cyclic boosting of shallow trees fits
one lookup table for each feature and one for each of the strongest pairs.  A
score is the logistic of an intercept and the table entries of a row's bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import broadcast_if_small, slices
from .shingles import word_hashes

FEATURES = ("log_words", "word_length", "upper", "symbols", "exclaims", "digits", "other_marks", "not_ascii", "lines", "same_next", "distinct", "distinct_pairs", "short_words", "bars")
MAX_ROWS = 20_000  # most labelled rows that a model is fitted on
BINS, PAIR_BINS, PAIRS = 48, 10, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 80, 40, 0.25, 5.0

_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _s in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>", b"!", b"0123456789", b"\"'(),-./:;?@[\\]^_`{}~+=", bytes(range(128, 256)), b"\n", b"|", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_s)] = _i


def text_features(data: np.ndarray) -> np.ndarray:
    """The features of one UTF-8 text given as uint8; zeros for an empty one."""
    out = np.zeros(len(FEATURES))
    if not len(data):
        return out
    n = len(data)
    k = np.bincount(_CLASS[data], minlength=10)
    words = word_hashes(data)
    w = max(1, len(words))
    chars = n - k[7] - k[9]
    out[:9] = np.log1p(len(words)), chars / w, k[1] / n, k[2] / w, k[3] / w, k[4] / n, k[5] / w, k[6] / n, k[7] / w
    if len(words) > 1:
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        out[9] = np.mean(words[1:] == words[:-1])
        out[11] = len(np.unique(pairs)) / len(pairs)
    out[10] = len(np.unique(words)) / w
    space = (_CLASS[data] == 9) | (_CLASS[data] == 7)
    gaps = np.diff(np.concatenate(([-1], np.flatnonzero(space), [n]))) - 1
    out[12] = np.count_nonzero((gaps > 0) & (gaps <= 3)) / w
    out[13] = k[8] / w
    return out


def _matrix(texts) -> np.ndarray:
    """Features of the texts of an Arrow column; a null text counts as empty."""
    return np.array([text_features(np.frombuffer(t.as_buffer() if t.is_valid else b"", dtype=np.uint8)) for t in texts]).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Bin edges and lookup tables; a few kilobytes whatever the corpus."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="left")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[i], x[:, i], side="left"), np.searchsorted(self.pair_edges[j], x[:, j], side="left")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a shallow tree that fits gradients g and curvatures h."""
    value = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
        return value
    return np.concatenate((_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a table of bins into four quadrants."""
    best, values = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            parts = [(cg[a, b], ch[a, b]), (cg[a, -1] - cg[a, b], ch[a, -1] - ch[a, b]), (cg[-1, b] - cg[a, b], ch[-1, b] - ch[a, b])]
            parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
            gain = sum(p[0] ** 2 / (p[1] + RIDGE) for p in parts)
            if gain > best + 1e-9:
                v = [p[0] / (p[1] + RIDGE) for p in parts]
                best, values = gain, np.zeros_like(g)
                values[: a + 1, : b + 1], values[: a + 1, b + 1 :], values[a + 1 :, : b + 1], values[a + 1 :, b + 1 :] = v
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit tables by cyclic boosting, the pairs after the single features.  Without rows of both labels the score is constant."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return Model([np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], start)
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), start)

    def slopes(m):
        p = 1 / (1 + np.exp(-m))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes(margin)
            step = RATE * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
            tables[j] += step
            margin += step[b]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(coarse)]

    def sums(i, j, values):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes(margin)
    gains = {(i, j): _quadrants(sums(i, j, g), sums(i, j, h))[0] for i, j in combinations(range(x.shape[1]), 2)}
    pairs = sorted(sorted(gains), key=lambda p: -gains[p])[:PAIRS]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            g, h = slopes(margin)
            step = RATE * _quadrants(sums(i, j, g), sums(i, j, h))[1]
            pair_tables[k] += step
            margin += step[cells[i], cells[j]]
    return Model(edges, tables, start, pairs, coarse, pair_tables)


def held_out(id_col: str, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves `part`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most max_rows labelled rows of docs that are not held out, drawn by a hash of the id.

    Null labels are skipped, repeated ones count as often as they stand.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = known.count()
    share = min(1.0, 0.95 * max_rows / max(rows, 1)) if rows > max_rows else 1.0
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(broadcast_if_small(drawn, max_rows), "id").select("y", "text")

    def run(batches):
        for b in slices(batches):
            m = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m[:, j]) for j in range(len(FEATURES))]], names=["y", *FEATURES])

    got = texts.mapInArrow(run, ", ".join(["y int", *(f"{f} double" for f in FEATURES)])).limit(max_rows).toArrow()
    m = np.column_stack([got.column(c).to_numpy() for c in ("y", *FEATURES)]).astype(float)
    m = m[np.lexsort(m.T[::-1])]  # sums in one order whatever Spark's
    return fit(m[:, 1:], m[:, 0])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """id_col, held_out, score and predicted of every row of docs.

    The model learns from labels of rows that are not held out; labels, ids and
    other columns are never inputs of a score.  Null texts count as empty and
    get a score too; repeated rows stay repeated; an empty table gives an empty
    result, and without labels of both kinds every score is the rate of 1.
    """
    model = train(docs, labels, id_col, text_col, label_col, max_rows)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType(), False)])

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=schema.names)

    scored = docs.select(id_col, text_col).mapInArrow(run, schema)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without the rows whose score is below threshold; all columns stay.

    Scores are computed beside the rows, so no text is shuffled.  Rows are judged
    as by score_documents.
    """
    model = train(docs, labels, id_col, text_col, label_col, max_rows)

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(model.score(_matrix(b.column(b.schema.get_field_index(text_col)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
