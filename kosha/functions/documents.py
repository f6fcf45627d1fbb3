"""Classes of documents and of the holding sets in them, amounts' units, corporate-action subjects and bond texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names a document class, in order of precedence.
DOCUMENTS = [
    (r"(?i)fact[-_ ]?sheet|top[-_ ]*(?:10|ten)[-_ ]*holdings?\b|top[-_ ]*holdings\b|major[-_ ]*holdings?\b", "factsheet_topn"),
    (r"(?i)fortnight", "fortnightly"),
    (r"(?i)portfolio", "full_portfolio"),
]
# Coverage of a whole disclosure in percent, rows of a top list, and units in crore.
COMPLETE, TOP_ROWS = (95.0, 105.0), (8, 12)
UNITS = [
    (r"(?i)(₹|rs\.?|inr)\s*(amount)?\s*in\s*(lakhs?|lacs?|lac)\b", 0.01),
    (r"(?i)(₹|rs\.?|inr)\s*in\s*crores?\b|in\s+crore", 1.0),
    (r"(?i)in\s*millions?\b", 0.1),
    (r"(?i)figures?\s+in\s+(lakhs?|lacs?)\b", 0.01),
]


def document_class(*texts: Column) -> Column:
    """The first class that any of the texts (file, metadata, scheme names) names; unknown without one."""
    found = F.lit("unknown")
    for pattern, label in reversed(DOCUMENTS):
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.coalesce(F.rlike(t, F.lit(pattern)), F.lit(False))
        found = F.when(hit, label).otherwise(found)
    return found


def tiers(holdings: DataFrame, by: str, kind: str, weight: str) -> DataFrame:
    """by, kind, tier, coverage_pct, n_holdings, escalate, suspect of every holding set.

    A top list of 8 to 12 rows is a fallback whatever its coverage; other sets are
    complete between 95 and 105 percent; the rest escalates, as does all whose
    coverage or a single weight is out of scale.
    """
    c = F.col
    w = F.regexp_replace(F.trim(c(weight).cast("string")), r"\s*%$", "").try_cast("double")
    known = F.when(c(kind).isin("full_portfolio", "fortnightly", "factsheet_topn"), c(kind)).otherwise("unknown")
    g = holdings.select(by, known.alias("kind"), w.alias("w")).groupBy(by, "kind").agg(F.count(F.lit(1)).alias("n_holdings"), F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 6).alias("coverage_pct"), F.max("w").alias("top"), F.count("w").alias("k"))
    suspect = F.coalesce((c("coverage_pct") > COMPLETE[1]) | (c("top") > 100), F.lit(False))
    fallback = (c("kind") == "factsheet_topn") & (c("k") > 0) & c("n_holdings").between(*TOP_ROWS) & (c("top") <= 100)
    whole = (c("kind") != "factsheet_topn") & c("coverage_pct").between(*COMPLETE)
    tier = F.when(fallback, "top10_fallback").when(whole, "complete_100").otherwise("escalate")
    return g.select(by, "kind", tier.alias("tier"), "coverage_pct", "n_holdings", ((tier == "escalate") | suspect).alias("escalate"), suspect.alias("suspect"))


def unit_scale(text: Column) -> Column:
    """What printed amounts are multiplied with to be in crore, by the first unit that the text names; 1 without one."""
    out = F.lit(1.0)
    for pattern, scale in reversed(UNITS):
        out = F.when(F.rlike(text, F.lit(pattern)), scale).otherwise(out)
    return out


def quarter_start(d: Column) -> Column:
    """First day of the calendar quarter; of the one before in the first nine days of a quarter."""
    q = F.trunc(d, "quarter")
    early = (F.trunc(d, "month") == q) & (F.dayofmonth(d) < 10)
    return F.when(early, F.add_months(q, -3)).otherwise(q)


# What marks a floating rate, and payments a year by words in a text or by its first figures.
FLOATING = ("frb", "frn", "floating")
PAYMENTS = (
    (2, ("half", "semi"), "2"),
    (4, ("quart",), "4"),
    (12, ("month",), "12"),
    (1, ("year", "annual"), "1"),
    (6, (), "6"),
)


def coupon(text: Column) -> Column:
    """The coupon in percent that a text names; none for floating rates."""
    low = F.lower(text)
    floats = F.lit(False)
    for word in FLOATING:
        floats = floats | F.contains(low, F.lit(word))
    before_percent = F.regexp_extract(text, r"(\d{1,2}(?:\.\d{1,4})?)\s*%", 1)
    return F.when(~floats & (before_percent != ""), before_percent.cast("double"))


def payments_a_year(text: Column) -> Column:
    """Payments a year by the first entry of PAYMENTS that fits; none where the text says nothing."""
    low = F.lower(F.trim(text))
    found = F.lit(None).cast("int")
    for n, words, figures in reversed(PAYMENTS):
        fits = F.startswith(low, F.lit(figures))
        for word in words:
            fits = fits | F.contains(low, F.lit(word))
        found = F.when(fits, n).otherwise(found)
    return found


# Words of corporate-action subjects.
TOKEN = r"[a-z]+|\d+(?:\.\d+)?|\.+|[^\sa-z0-9./-]"  # a word, a number, dots or a mark; slashes and dashes tell nothing
PER = ("per", "pr", "p")
KINDS_OF_SHARE = ("equity", "ordinary", "ord")
CURRENCY = ("rs", "re")
NO_EQUITY = ("debenture", "preference", "ncrps")
MOST_BONUS = 500


class _Subject:
    """The words, numbers and marks of a subject line, looked at by place."""

    def __init__(self, tokens: Column):
        self.t = tokens

    def at(self, i: Column) -> Column:
        return F.coalesce(F.get(self.t, i), F.lit(""))

    def is_number(self, i: Column) -> Column:
        return F.rlike(self.at(i), F.lit(r"^\d"))

    def skip(self, i: Column, words: tuple[str, ...]) -> Column:
        return i + self.at(i).isin(*words).cast("int")

    def places(self, holds) -> Column:
        """Places at which `holds` is true."""
        return F.filter(F.sequence(F.lit(0), F.size(self.t)), lambda i: F.coalesce(holds(i), F.lit(False)))

    def any(self, holds) -> Column:
        return F.exists(self.t, holds)

    def amount_after(self, i: Column) -> Column:
        """Place of the number that follows, behind a currency and a dot."""
        k = self.skip(self.skip(i + 1, CURRENCY), (".",))
        return F.when(self.is_number(k), k)

    def per_share(self, i: Column) -> Column:
        """Whether the number at i is an amount for each share."""
        k = self.skip(self.skip(self.skip(i + 1, (":",)), PER), KINDS_OF_SHARE)
        unit = self.at(k)
        joined = F.lit("^(?:" + "|".join(PER) + ")(?:" + "|".join(KINDS_OF_SHARE) + ")?sh")
        return self.is_number(i) & (F.startswith(unit, F.lit("sh")) | F.rlike(unit, joined))

    def opens_split(self, i: Column) -> Column:
        """Whether the words from i on announce a cut of the face value."""
        one, two, three = self.at(i), self.at(i + 1), self.at(i + 2)
        splits = lambda w: F.startswith(w, F.lit("spl"))
        return ((one == "face") & (two == "value") & splits(three)) | ((one == "fv") & splits(two)) | ((one == "stock") & F.startswith(two, F.lit("split"))) | ((one == "sub") & F.startswith(two, F.lit("divis")))

    def bonus(self, i: Column) -> Column:
        """struct<a, b> of "bonus a:b" at i."""
        k = self.skip(i + 1, (":",))
        whole = lambda j: F.rlike(self.at(j), F.lit(r"^\d{1,3}$"))
        fits = F.startswith(self.at(i), F.lit("bon")) & whole(k) & (self.at(k + 1) == ":") & whole(k + 2)
        return F.when(fits, F.struct(self.at(k).try_cast("double").alias("a"), self.at(k + 2).try_cast("double").alias("b")))


def subject_events(subject: Column) -> dict[str, Column]:
    """dividend (cash a share, summed unless one figure includes the others) and split (shares after for one before) of a subject line; null where it states none.

    Bonus a:b counts as (a + b) / b shares for one, a face value cut from old to
    new as old / new; both on one line multiply.  Bonuses of debentures and
    preference shares do not count.  Amounts between the words that announce a
    cut and its last stated value are no dividends; if it states neither "from"
    nor "to", none behind those words is.
    """
    fixed = F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), r"(?<=\d)\s*\.+\s*(?=\d)", ".")
    line = _Subject(F.regexp_extract_all(fixed, F.lit(TOKEN), F.lit(0)))
    value = lambda i: line.at(i).try_cast("double")
    first = lambda places: F.get(places, F.lit(0))
    stated = lambda *words: first(F.filter(F.transform(line.places(lambda i: line.at(i).isin(*words)), line.amount_after), lambda k: k.isNotNull()))
    cut_at, old_at, new_at = first(line.places(line.opens_split)), stated("from", "frm"), stated("to")
    last = F.coalesce(F.greatest(old_at, new_at), F.size(line.t))
    free = F.filter(line.places(line.per_share), lambda i: F.coalesce((i < cut_at) | (i > last), F.lit(True)) & (value(i) > 0))
    amounts = F.transform(free, value)
    total = F.when(line.any(lambda w: F.startswith(w, F.lit("includ"))), first(amounts)).otherwise(F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x))
    pays = line.any(lambda w: (w == "div") | F.contains(w, F.lit("divid")))
    other_paper = line.any(lambda w: F.rlike(w, F.lit("|".join(NO_EQUITY)))) | (F.size(line.places(lambda i: (line.at(i) == "deb") & line.is_number(i + 1))) > 0)
    offer = first(F.filter(F.transform(line.places(lambda i: F.startswith(line.at(i), F.lit("bon"))), line.bonus), lambda x: x.isNotNull()))
    bonus = F.when(~other_paper & offer["a"].between(1, MOST_BONUS) & offer["b"].between(1, MOST_BONUS), (offer["a"] + offer["b"]) / offer["b"])
    money = F.filter(F.transform(line.places(lambda i: line.at(i).isin(*CURRENCY)), line.amount_after), lambda k: k.isNotNull())
    both = old_at.isNotNull() & new_at.isNotNull()
    old, new = value(F.when(both, old_at).otherwise(first(money))), value(F.when(both, new_at).otherwise(F.get(money, F.lit(1))))
    cut = F.when(cut_at.isNotNull() & (new > 0) & (old > new), old / new)
    split = F.when(F.coalesce(bonus, cut).isNotNull(), F.coalesce(bonus, F.lit(1.0)) * F.coalesce(cut, F.lit(1.0)))
    return {"dividend": F.when(pays & (F.size(amounts) > 0), F.round(total, 4)), "split": split}


# Segments by security type.
SEGMENTS = {"GS": "G-Sec", "GZ": "G-Sec STRIPS", "GF": "G-Sec FRB", "PR": "G-Sec", "TB": "T-Bill", "SG": "State Govt / SDL", "PT": "PSU / Sub-sovereign", "CP": "Commercial Paper", "CD": "Certificate of Deposit", "PZ": "STRIPPED Debt", "VZ": "STRIPPED Debt"}


def segment(security_type: Column) -> Column:
    """The market segment of a security type; corporate bonds are the rest."""
    names = F.create_map(*[F.lit(x) for p in SEGMENTS.items() for x in p])
    return F.coalesce(names[F.upper(F.trim(security_type))], F.lit("Corporate Bond"))


def expense_ratio(value: Column) -> Column:
    """A published ratio to six digits; 0 and less mean that there is no such plan."""
    v = F.regexp_replace(value.cast("string"), "[,%]", "").try_cast("double")
    return F.when(v > 0, F.round(v, 6))
