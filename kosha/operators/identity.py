"""Identities of debt lines, and holdings that are one because they share an ISIN or an instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import held

# Words that do not tell issuers apart; dates, coupons with and without a percent sign.
NOISE_WORDS = ("LTD", "LIMITED", "PVT", "PRIVATE", "THE", "AND", "OF", "IN", "LT")
DATE = r"[()]?(\d{2})[./-](\d{2})[./-](\d{4})[()]?"
PERCENT = r"(\d{1,2}(?:\.\d{1,4})?)\s*%"
BARE = r"\b(\d{1,2}\.\d{1,4})\b"


def debt_key(company: Column, coupon: Column, maturity: Column) -> Column:
    """issuer|Ccoupon|Mmaturity of a debt line; null where neither coupon nor maturity is given or can be read in the name.

    coupon: double; maturity: yyyy-MM-dd.  The issuer is what is left of the
    upper-case name without dates, coupons, marks and words that don't tell.
    """
    text = F.upper(F.coalesce(company, F.lit("")))
    read_date = F.when(F.rlike(text, F.lit(DATE)), F.concat_ws("-", *[F.regexp_extract(text, DATE, i) for i in (3, 2, 1)]))
    due = F.coalesce(F.when(maturity != "", maturity), read_date)
    read_rate = F.when(F.rlike(text, F.lit(PERCENT)), F.regexp_extract(text, PERCENT, 1)).when(F.rlike(text, F.lit(BARE)), F.regexp_extract(text, BARE, 1)).cast("double")
    rate = F.coalesce(coupon, read_rate)
    plain = text
    for pattern in (DATE, PERCENT, BARE, "[^A-Z0-9 ]"):
        plain = F.regexp_replace(plain, pattern, " ")
    words = F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(*NOISE_WORDS))
    issuer = F.array_join(words, " ")
    key = F.concat_ws("|", F.when(issuer != "", issuer), F.concat(F.lit("C"), F.round(rate, 4).cast("string")), F.concat(F.lit("M"), due))
    return F.when(rate.isNotNull() | due.isNotNull(), key)


def overlap_keys(rows: DataFrame, by: str) -> DataFrame:
    """rows with key: the ISIN, else the ISIN that a line of the same set `by` and the same instrument has (the least), else the instrument, else the name.

    rows: isin, company, coupon, maturity_date.  Lines with none of them are left out.
    """
    isin, name = F.nullif(F.trim("isin"), F.lit("")), F.nullif(F.trim("company"), F.lit(""))
    known = rows.withColumn("debt_key", debt_key(F.col("company"), F.col("coupon"), F.col("maturity_date")))
    alias = known.where(isin.isNotNull() & F.col("debt_key").isNotNull()).groupBy(by, "debt_key").agg(F.min(isin).alias("alias"))
    return known.join(alias, [by, "debt_key"], "left").withColumn("key", F.coalesce(isin, "alias", "debt_key", name)).where("key IS NOT NULL").drop("alias")


def identity_classes(rows: DataFrame, first: str, second: str, most_rounds: int = 40) -> DataFrame:
    """first, second and class of all distinct pairs of identities: pairs that share either belong to one class, named by its least `first`.

    Pairs without one of them can't join others and are left out.  Each round
    takes the least class over each identity and over the class itself, so
    chains halve; rounds are checkpointed.
    """
    pairs = held(rows.select(first, second).where(F.col(first).isNotNull() & F.col(second).isNotNull()).distinct().withColumn("class", F.col(first)))
    before = None
    for _ in range(most_rounds):
        for side in (second, first):
            least = pairs.groupBy(F.col(side).alias("k")).agg(F.min("class").alias("least"))
            pairs = pairs.join(least, F.col(side) == F.col("k")).select(first, second, F.col("least").alias("class"))
        # A class's name is an identity too: what that has become is the class of all that bear the name.
        named = pairs.groupBy(F.col(first).alias("k")).agg(F.min("class").alias("least"))
        pairs = held(pairs.join(named, F.col("class") == F.col("k")).select(first, second, F.col("least").alias("class")))
        mark = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(first, second, "class"))).first()
        if mark == before:
            return pairs
        before = mark
    raise RuntimeError("identity classes did not settle")


def class_keys(rows: DataFrame, by: str) -> DataFrame:
    """rows with key: the class of the line's ISIN and instrument over all sets, else the instrument or ISIN alone, else the name.

    Unlike overlap_keys, two ISINs of one instrument are one, and so are two
    spellings of an instrument under one ISIN.
    """
    isin, name = F.nullif(F.trim("isin"), F.lit("")), F.nullif(F.trim("company"), F.lit(""))
    known = rows.withColumn("debt_key", debt_key(F.col("company"), F.col("coupon"), F.col("maturity_date"))).withColumn("own", isin)
    classes = identity_classes(known, "own", "debt_key")
    by_isin = classes.groupBy("own").agg(F.min("class").alias("isin_class"))
    by_debt = classes.groupBy("debt_key").agg(F.min("class").alias("debt_class"))
    found = known.join(by_isin, "own", "left").join(by_debt, "debt_key", "left")
    return found.withColumn("key", F.coalesce("isin_class", "own", "debt_class", "debt_key", name)).where("key IS NOT NULL").drop("own", "isin_class", "debt_class")
