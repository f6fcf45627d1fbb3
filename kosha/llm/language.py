"""Language identification in two steps: the family first, then the language within it.

Features are hashed character n-grams within words.  One-versus-rest linear
support vector machines choose the family; inside it, one-versus-one machines
vote between the languages.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import mix

# Families of common language codes; other codes form one family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tt".split(),
    "indic": "hi bn ur mr gu pa ne".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue".split(),
}
SIZE = 2048  # hashed features
MAX_ROWS = 6_000  # most documents that a model is fitted on, in equal shares of the languages
STEPS, COST = 150, 10.0
ROWS = 1000  # rows of a matrix of vectors

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_MIXERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def ngram_vector(text: str) -> np.ndarray | None:
    """Unit vector of hashed 1- to 3-grams of letters and word edges; None for a text without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = points < 0x10000
    letter = low & _LETTER[np.where(low, points, 0)]
    for i in np.flatnonzero(~low):
        letter[i] = chr(points[i]).isalpha()
    if not letter.any():
        return None
    c = np.where(letter, points, 32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c[(c != 32) | np.concatenate(([True], c[:-1] != 32))], [np.uint64(32)]))
    counts = np.zeros(SIZE)
    for n in (1, 2, 3):
        h = np.zeros(max(0, len(c) - n + 1), dtype=np.uint64)
        for j in range(n):
            h += c[j : j + len(h)] * _MIXERS[j]
        counts += np.bincount((mix(h + np.uint64(n)) % np.uint64(SIZE)).astype(np.int64), minlength=SIZE)
    v = np.sqrt(counts)
    return v / np.sqrt((v * v).sum())


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, bias last, of a linear machine with squared hinge loss and balanced classes, by accelerated gradient steps."""
    x = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), 1)
    y = y.astype(np.float32)  # one type throughout: no product copies x
    c = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * COST).astype(np.float32)
    bound = 1.0 + 2.0 * 2.0 * COST  # of the curvature: rows have squared length 2
    w = z = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(STEPS):
        slack = np.maximum(np.float32(0), 1 - y * (x @ z))
        fresh = z - (z * np.float32(0.01) - 2 * ((c * slack * y) @ x)) / np.float32(bound)
        z = fresh + np.float32(k / (k + 3)) * (fresh - w)
        w = fresh
    return w


@dataclass
class Model:
    """Machines of families and of pairs of languages; its size depends on the number of languages only."""

    families: list[list[str]]
    family_machines: np.ndarray
    pair_machines: dict

    def predict(self, v: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of the rows of v: the family with the largest margin, then the language with most votes, of equal ones that with the largest sum of margins."""
        v = np.concatenate((v, np.ones((len(v), 1))), 1)
        best, sure = np.zeros(len(v), dtype=np.int64), np.ones(len(v))
        if len(self.families) > 1:
            margins = v @ self.family_machines.T
            best = margins.argmax(1)
            two = np.sort(margins, 1)[:, -2:]
            sure = 1 / (1 + np.exp(-2.0 * (two[:, 1] - two[:, 0])))
        found = np.empty(len(v), dtype=object)
        for i, langs in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                m = v[rows] @ self.pair_machines[langs[a], langs[b]]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                sums[:, a] += m
                sums[:, b] -= m
            won = np.lexsort((-np.arange(len(langs)) + 0 * sums, sums, votes), axis=1)[:, -1] if len(rows) else rows
            found[rows] = np.array(langs, dtype=object)[won]
            if len(langs) > 1:
                sure[rows] *= 1 / (1 + np.exp(-2.0 * sums[np.arange(len(rows)), won] / (len(langs) - 1)))
        return found.tolist(), np.clip(sure, 0.0, 1.0)


def fit(x: np.ndarray, lang: np.ndarray) -> Model:
    known = {code: f for f, codes in FAMILIES.items() for code in codes}
    langs = sorted(set(lang.tolist()))
    names = sorted({known.get(a, "other") for a in langs})
    families = [[a for a in langs if known.get(a, "other") == f] for f in names]
    of = np.array([names.index(known.get(a, "other")) for a in lang])
    machines = np.array([_machine(x, np.where(of == i, 1.0, -1.0)) for i in range(len(names))]) if len(names) > 1 else np.zeros((0, SIZE + 1))
    pairs = {}
    for group in families:
        for a, b in combinations(group, 2):
            both = (lang == a) | (lang == b)
            pairs[a, b] = _machine(x[both], np.where(lang[both] == a, 1.0, -1.0))
    return Model(families, machines, pairs)


def held_out(id_col: str, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on at most max_rows rows that are not held out and have a language, drawn by a hash of the id in equal shares; None without any."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    share = F.create_map(*[x for a, n in counts.items() for x in (F.lit(a), F.lit(int(1_000_000 * min(1.0, 0.95 * each / n if n > each else 1.0))))])
    drawn = known.where(F.pmod(F.xxhash64(id_col, F.lit("language")), F.lit(1_000_000)) < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            rows = [(a.as_py(), v) for a, t in zip(b.column(0), b.column(1), strict=True) if t.is_valid and (v := ngram_vector(t.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary())], names=["lang", "v"])

    got = drawn.mapInArrow(run, "lang string, v binary").limit(max_rows).toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got["lang"].to_pylist(), got["v"].to_pylist(), strict=True))
    return fit(np.array([np.frombuffer(v, np.float32) for _, v in rows]), np.array([a for a, _ in rows]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> DataFrame:
    """id_col, held_out, lang_pred and score of every row of docs.

    Learns from texts and languages of rows that are not held out; languages,
    ids and other columns are never inputs of a prediction.  Texts that are null
    or have no letter, and all texts where there is nothing to learn from, get
    `und` with score 0.  Whole texts; repeated rows stay repeated; an empty
    table gives an empty result.
    """
    model = train(docs, id_col, text_col, lang_col, max_rows)
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches):
        for b in batches:
            vectors = [ngram_vector(t.as_py()) if model is not None and t.is_valid else None for t in b.column(1)]
            known = [i for i, v in enumerate(vectors) if v is not None]
            langs, scores = ["und"] * len(vectors), np.zeros(len(vectors))
            for low in range(0, len(known), ROWS):
                some = known[low : low + ROWS]
                got, scores[some] = model.predict(np.array([vectors[i] for i in some]))
                for i, a in zip(some, got, strict=True):
                    langs[i] = a
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
