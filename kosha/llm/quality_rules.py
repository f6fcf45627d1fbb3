"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Text statistics are transformed to a vector; for each language and source the
half of the rows whose scatter has the least determinant is looked for from
several starts by concentration steps, its scatter is made consistent and
reweighted, and rows are rejected by their Mahalanobis distance.  All groups and
starts take their steps together; every step is one partial aggregation, so a
source that holds a third of all rows is no larger in any task than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, keep

# Fixed values of the contract.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50

FEATURES = ("word_length", "symbols", "duplicate_lines", "repeats")
STARTS = 4
FIRST_STEPS = 2  # concentration steps that every start takes; the best goes on
MOST_STEPS = 30
# Chi-square values for four dimensions: half a sample, by which a scatter is 1 / 2.109 too small; and the cut of the reweighting, which leaves out 2.5 % of normal rows, with its factor.
HALF_FACTOR = 2.1090630406
REWEIGHT_CUT, REWEIGHT_FACTOR = 11.1432867819, 1.0644658583
SETTLED = 1e-3  # largest change of the logarithm of a determinant that ends the steps
LEAST_ROWS = 5 * len(FEATURES)  # rows from which a scatter of so many dimensions is estimated; smaller groups take the estimates of their language, and these those of all rows
FLOOR = 0.08  # least standard deviation of a transformed statistic
BINS = 256  # bins of a distance for each doubling
MAX_DISTANCE = 60.0  # squared; the quantile of a chi-square variable of 4 degrees that one of 3e11 normal rows exceeds, as text statistics have longer tails


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the text.

    Windows are compared by 64-bit hashes.  Only texts with a repeated window
    sort them: equal neighbours in the order of hashes give the places of
    repeated windows, and the gaps between sorted places the words they cover.
    """

    def places(h):
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s):
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1))
            after = F.concat(F.slice(s, 2, F.size(s) - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
            trio = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
            same = F.filter(trio, lambda t: (t["s"]["h"] == t["b"]["h"]) | (t["s"]["h"] == t["a"]["h"]))
            spots = F.array_sort(F.transform(same, lambda t: t["s"]["i"]))
            zero = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"))
            return F.aggregate(spots, zero, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(order, covered)).otherwise(F.lit(0))

    def count(w):
        n = F.size(w) - 2
        windows = F.transform(F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c")), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))
        return _let(windows, places)

    return F.when(F.size(words) >= 3, _let(words, count)).otherwise(F.lit(0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, group keys and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(k) for c, k in zip(group_cols, ("g1", "g2"), strict=True)], text.alias("t"), words_of(text).alias("w"))
    found = split.select(
        "id",
        "g1",
        "g2",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        _duplicate_lines(F.col("t")).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _features(stats: DataFrame) -> DataFrame:
    """Transformed statistics: logarithms and square roots of rates, so that counts of any text length compare."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "word_length": F.log1p(F.col("word_chars") / n),
            "symbols": F.sqrt(F.col("n_symbols") / n),
            "duplicate_lines": F.sqrt(F.col("n_dup_lines") / n),
            "repeats": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def _moments() -> list[Column]:
    """Count, sums and sums of products; equal to the last digit whatever the order, as the parts are rounded to integers."""
    scaled = {f: F.round(F.col(f) * 1_000_000).cast("long") for f in FEATURES}
    out = [F.count(F.lit(1)).alias("n")] + [F.sum(scaled[f]).alias(f"s_{f}") for f in FEATURES]
    for i, f in enumerate(FEATURES):
        for g in FEATURES[: i + 1]:
            out.append(F.sum(F.round(F.col(f) * F.col(g) * 1_000_000).cast("long")).alias(f"p_{f}_{g}"))
    return out


def _estimates(kept: DataFrame, keys: list[str], factor: float = HALF_FACTOR) -> DataFrame:
    """Mean and Cholesky factor of `factor` times the scatter of each group of kept rows."""
    m = kept.groupBy(*keys).agg(*_moments())
    means = {f: F.col(f"s_{f}") / 1e6 / F.col("n") for f in FEATURES}
    m = m.select(*keys, "n", *[means[f].alias(f"m_{f}") for f in FEATURES], *[(factor * (F.col(f"p_{f}_{g}") / 1e6 / F.col("n") - means[f] * means[g])).alias(f"c_{f}_{g}") for i, f in enumerate(FEATURES) for g in FEATURES[: i + 1]])
    # Cholesky, one row of the factor after the other, with a floor under each pivot.
    for i, f in enumerate(FEATURES):
        for j, g in enumerate(FEATURES[: i + 1]):
            rest = F.col(f"c_{f}_{g}")
            for h in FEATURES[:j]:
                rest = rest - F.col(f"l_{f}_{h}") * F.col(f"l_{g}_{h}")
            value = F.sqrt(F.greatest(rest, F.lit(FLOOR**2))) if i == j else rest / F.col(f"l_{g}_{g}")
            m = m.withColumn(f"l_{f}_{g}", value)
    return m.select(*keys, "n", *[f"m_{f}" for f in FEATURES], *[f"l_{f}_{g}" for i, f in enumerate(FEATURES) for g in FEATURES[: i + 1]])


def _distance(df: DataFrame, name: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    total = F.lit(0.0)
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m_{f}")
        for g in FEATURES[:i]:
            rest = rest - F.col(f"l_{f}_{g}") * F.col(f"z_{g}")
        df = df.withColumn(f"z_{f}", rest / F.col(f"l_{f}_{f}"))
        total = total + F.col(f"z_{f}") * F.col(f"z_{f}")
    return df.withColumn(name, total)


def _nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows up to the distance bin that completes half of each group (and half a row for each dimension): counts by bin, then their running sums."""
    rows = rows.withColumn("bin", F.floor(F.log2(F.col("d") + 1e-6) * BINS).cast("int"))
    bins = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
    by_group = bins.groupBy(*keys).agg(F.sum("k").alias("all"), F.array_sort(F.collect_list(F.struct("bin", "k"))).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("cut"))

    def step(acc, x):
        done = acc["cut"].isNotNull()
        total = acc["sum"] + x["k"]
        return F.struct(total.alias("sum"), F.when(done, acc["cut"]).when(2 * total >= F.col("all") + len(FEATURES), x["bin"]).alias("cut"))

    cuts = by_group.select(*keys, F.aggregate("b", zero, step, lambda acc: acc["cut"]).alias("cut"))
    return rows.join(broadcast_if_small(cuts), keys).where(F.col("bin") <= F.col("cut")).select(*keys, *FEATURES)


def _starts(rows: DataFrame, quartiles: DataFrame, keys: list[str]) -> DataFrame:
    """rows for each of the starts, with a distance d: around the medians in units of the quartiles' distance and of the nearer quartile's, around the lower and around the upper quartiles."""
    q = lambda f, i: F.col(f"q_{f}")[i]
    unit = lambda x: F.greatest(x / 0.6745, F.lit(FLOOR))
    frames = [
        (lambda f: q(f, 1), lambda f: unit((q(f, 2) - q(f, 0)) / 2)),
        (lambda f: q(f, 1), lambda f: unit(F.least(q(f, 1) - q(f, 0), q(f, 2) - q(f, 1)))),
        (lambda f: q(f, 0), lambda f: unit(q(f, 1) - q(f, 0))),
        (lambda f: q(f, 2), lambda f: unit(q(f, 2) - q(f, 1))),
    ]
    distances = [sum((F.pow((F.col(f) - centre(f)) / scale(f), 2) for f in FEATURES), F.lit(0.0)) for centre, scale in frames]
    return rows.join(quartiles, keys).select(*keys, *FEATURES, F.posexplode(F.array(*distances)).alias("start", "d"))


def fit_mcd(rows: DataFrame, keys: list[str], most_steps: int = MOST_STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates for each group of `keys` (no nulls) with at least LEAST_ROWS rows.

    Of STARTS subsets of half the rows each takes FIRST_STEPS concentration
    steps; a step keeps the half of the rows nearest under the current estimate
    (and all that tie with the last of them, up to a bin of 1/256 of a
    doubling), which does not raise the determinant.  The start with the least
    determinant goes on until no group's changes.  The scatter of a half is made
    consistent for normal rows, and the estimates returned are those of all rows
    within the 97.5 % ellipsoid, made consistent again: they hold out against
    outliers of nearly half the rows.  Groups are summaries of a few numbers;
    rows stay where they are.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{f}") for f in FEATURES]).where(F.col("n") >= LEAST_ROWS)
    large = broadcast_if_small(keep(large.drop("n"), "quartiles"))
    log_det = sum((F.log(f"l_{f}_{f}") for f in FEATURES), F.lit(0.0))
    distances = lambda fits, ks: _distance(rows.join(broadcast_if_small(fits), keys), "d").select(*ks, *FEATURES, "d")
    tried = [*keys, "start"]
    fits = keep(_estimates(_nearest(_starts(rows, large, keys), tried), tried), "starts")
    for _ in range(FIRST_STEPS):
        fits = keep(_estimates(_nearest(distances(fits, tried), tried), tried), "starts")
    names = [c for c in fits.columns if c not in tried]
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(log_det, F.col("start"))).alias("b"))
    estimates = keep(best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in names]), "estimates")
    for _ in range(most_steps):
        fresh = keep(_estimates(_nearest(distances(estimates, keys), keys), keys), "estimates")
        was = estimates.select(*keys, log_det.alias("was"))
        moved = fresh.select(*keys, log_det.alias("now")).join(was, keys).agg(F.max(F.abs(F.col("now") - F.col("was")))).first()[0]
        estimates = fresh
        if moved is None or moved <= SETTLED:
            break
    return keep(_estimates(distances(estimates, keys).where(F.col("d") <= REWEIGHT_CUT), keys, REWEIGHT_FACTOR), "estimates")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), limit: float = MAX_DISTANCE) -> DataFrame:
    """id_col, the statistics, base_failed, distance and kept of every row.

    Rows that fail a base rule are not kept and take no part in the estimates.
    A null language or source is a group of its own.  Groups of fewer than
    LEAST_ROWS rows are judged by their language's estimates, else by those of
    all rows; where even those are too few, rows that pass the base rules are
    kept and their distance is null.  Null texts have no words.  Repeated rows
    stay repeated; an empty table gives an empty result; other columns play no
    part.
    """
    stats = keep(_features(statistics(docs, id_col, text_col, group_cols)), "statistics")
    sound = stats.where(~F.col("base_failed"))
    named = lambda df: df.withColumns({"k1": F.coalesce(F.concat(F.lit("="), F.col("g1")), F.lit("")), "k2": F.coalesce(F.concat(F.lit("="), F.col("g2")), F.lit("")), "k0": F.lit("all")})
    levels = [["k1", "k2"], ["k1"], ["k0"]]
    small = lambda keys: named(stats).groupBy(*keys).agg(F.sum((~F.col("base_failed")).cast("int")).alias("n")).where(F.col("n") < LEAST_ROWS)
    if small(levels[0]).isEmpty():  # then no row would look at the wider levels
        levels = levels[:1]
    fits = []
    for i, keys in enumerate(levels):
        fit = fit_mcd(named(sound).select(*keys, *FEATURES), keys)
        fits.append(fit.select(*keys, F.struct(*[c for c in fit.columns if c not in keys]).alias(f"fit{i}")))
    judged = named(stats)
    for keys, fit in zip(levels, fits, strict=True):
        judged = judged.join(broadcast_if_small(fit), keys, "left")
    judged = judged.withColumn("fit", F.coalesce(*[f"fit{i}" for i in range(len(levels))]))
    names = [f"m_{f}" for f in FEATURES] + [f"l_{f}_{g}" for i, f in enumerate(FEATURES) for g in FEATURES[: i + 1]]
    judged = _distance(judged.select("*", *[F.col(f"fit.{c}").alias(c) for c in names]), "distance")
    inside = F.coalesce(F.col("distance") <= limit, F.lit(True))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.when(~F.col("base_failed"), F.col("distance")).alias("distance")
    )
