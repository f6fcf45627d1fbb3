"""Classes of holdings from their section, name, sector and identifier, as column expressions.

Missing texts count as empty.  Each list is in order of precedence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country prefixes of foreign identifiers.
FOREIGN = "US LU DE GB JP HK SG EU NL FR IE CH CA AU NO SE DK FI".split()
# Words that tell the asset class, in a section or in a name.
DERIVATIVE_SECTION = ("derivative", "futures", "option", "contract", "swap")
DERIVATIVE_NAME = r"future|(\bcall\b|\bput\b)\s+option|\boptions?\b\s*(trading|book)|\bf&o\b|\bstrike\b"
CASH_SECTION = ("cash", "treps", "reverse repo", "short term deposit", "net current assets", "net receivables", "bank deposit", "cbfl", "liquid fund", "money at call")
FOREIGN_SECTION = ("foreign", "overseas", "adr", "gdr", "international", "euro clear", "depositary receipt")
DEBT_SECTION = (
    "debt", "bond", "money market", "certificate of deposit", "commercial paper", "treasury", "g-sec", "gsec", "sdl", "ncd", "securitised",
    "government security", "gilt", "floating rate", "credit risk", "strips", "treps", "cp", "cd", "zero coupon",
)
DEBT_NAME = ("t-bill", "tbill", "treasury", "goi", "g-sec", "gsec", "gilt", "sdl", "repo", "treps", "money market", "bank deposit", "debenture", "ncd", "zero coupon", "commercial paper", "certificate of deposit")
EQUITY_SECTION = ("equity", "stock", "shares", "preference", "warrant")
# Words that make a holding a debt instrument among the market-cap buckets.
DEBT_WORDS = ("t-bill", "tbill", "treasury", "goi", "g-sec", "gsec", "gilt", "sdl", "commercial paper", "certificate of deposit", "ncd", "repo", "treps", "money market", "bank deposit", "debenture", "zero coupon", " 91 day", " 182 day", " 364 day", " bonds")
# Ratings as they are looked for in a text, and credit buckets in order.
RATING = "(AAA|AA\\+?|A1\\+?|A\\+?|BBB\\+?|BB\\+?|B\\+?)"
CREDIT = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BB", "B")
SOVEREIGN_TEXT = ("SOVEREIGN", "GOVT", "G-SEC", "TBILL", "TREASURY", "GILT", "SDL", "SOV", "STATE GOVERNMENT", "TREPS")
SOVEREIGN = ("SOVEREIGN", "GOVT", "G-SEC", "TBILL", "TREASURY", "GILT", "SDL", "STATE")
EXPIRY = "^[A-Z]{3}[0-9]{2}$"  # an expiry month in place of an identifier


def _any(text: Column, words) -> Column:
    """Whether the text holds any of the words, as they stand."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _upper(*cs: Column) -> Column:
    return F.upper(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cs]))


def _foreign(isin: Column) -> Column:
    return F.substring(isin, 1, 2).isin(FOREIGN)


def asset_class(section: Column, company: Column, isin: Column) -> Column:
    """stocks, debt, international, future_options or cash_equivalents; empty where the texts do not tell."""
    s, c, i = _lower(section), _lower(company), _upper(isin)
    return (
        F.when(F.rlike(i, F.lit(EXPIRY)) | _any(s, DERIVATIVE_SECTION) | F.rlike(c, F.lit(DERIVATIVE_NAME)), "future_options")
        .when(_any(s, CASH_SECTION), "cash_equivalents")
        .when(_foreign(i) | _any(s, FOREIGN_SECTION), "international")
        .when(_any(s, DEBT_SECTION) | _any(c, DEBT_NAME), "debt")
        .when(_any(s, EQUITY_SECTION), "stocks")
        .otherwise("")
    )


def refine_asset_class(found: Column, confirmed_equity: Column, isin: Column) -> Column:
    """An asset class that the section told stays; others go by identifier, then by the directory's equity mark (1, 0.5 or 0)."""
    i = _upper(isin)
    rest = F.when(F.rlike(i, F.lit(EXPIRY)), "future_options").when(_foreign(i), "international").when(confirmed_equity.isin(1, 0.5), "stocks").when(confirmed_equity == 0, "debt").otherwise("other")
    return F.when(found.isin("stocks", "debt", "international", "future_options", "cash_equivalents"), found).otherwise(rest)


def is_equity_section(section: Column) -> Column:
    s = _lower(section)
    return ~_any(s, ("derivative", "future", "option", "swap", "debt", "cash", "net", "receivable"))


def cap_bucket(company: Column, sector: Column, isin: Column, asset: Column, cap: Column) -> Column:
    """debt, fund units, the market-cap tag (sme counts as microcap) or unclassified."""
    c, text, tag = _lower(company), F.concat_ws(" ", _lower(company), _lower(sector)), F.lower(F.trim(F.coalesce(cap, F.lit("na"))))
    return (
        F.when((_lower(asset) == "debt") | _any(text, DEBT_WORDS) | F.rlike(text, F.lit(r"\b(cp|cd)\b")), "debt")
        .when(F.rlike(c, F.lit(r"\b(fund|etf)\b")) | F.startswith(_upper(isin), F.lit("INF")), "fund units")
        .when(tag.isin("large", "mid", "small", "ipo"), tag)
        .when(tag.isin("microcap", "sme"), "microcap")
        .otherwise("unclassified")
    )


def credit_bucket(rating: Column, sector: Column, section: Column, company: Column) -> Column:
    """Bucket of the rating, else of a rating in the sector or section; sovereign paper without one; Unrated/Other."""
    own = F.trim(_upper(rating))
    token = lambda c: F.nullif(F.regexp_extract(_upper(c), RATING, 1), F.lit(""))
    r = F.coalesce(F.nullif(own, F.lit("")), token(sector), token(section), F.lit(""))
    none = r.isin("", "NA", "-", "UNRATED", "NR")
    out = F.when(_any(r, SOVEREIGN) | (r == "SOV"), "Sovereign/GSec").otherwise(F.substring(r, 1, 8))
    for bucket in reversed(CREDIT):
        out = F.when(F.contains(r, F.lit(bucket)), bucket).otherwise(out)
    return F.when(none, F.when(_any(_upper(section, sector, company), SOVEREIGN_TEXT), "Sovereign/GSec").otherwise("Unrated/Other")).otherwise(out)


def instrument_type(company: Column, sector: Column, section: Column) -> Column:
    """Instrument by section first, then by name and sector, then by the kind of rating in these."""
    s, t = _upper(section), _upper(company, sector)
    either = lambda *words: _any(s, words) | _any(t, words)
    like = lambda c, pattern: F.rlike(c, F.lit(pattern))
    return (
        F.when(_any(s, ("TREASURY", "T-BILL", "TBILL", "GOVERNMENT", "G-SEC", "GILT", "SDL")) | _any(t, ("TREASURY", "T-BILL", "TBILL", "GOVT", "G-SEC", "GOI", "GILT", "SDL")), "Govt / SDL / T-Bill")
        .when(either("CERTIFICATE OF DEPOSIT") | like(s, r"\bCD\b"), "Certificate of Deposit")
        .when(either("COMMERCIAL PAPER") | like(s, r"\bCP\b"), "Commercial Paper")
        .when(either("NCD") | _any(t, ("NON CONVERTIBLE",)), "NCD")
        .when(either("BOND", "DEBENTURE"), "Corporate Bond")
        .when(either("REPO", "TREPS"), "Repo / TREPS")
        .when(either("MONEY MARKET"), "Money Market")
        .when(like(t, r"(?:^|\s)C\.?D\.?(?:\s|$)|\sCP\s|\sCP$"), F.when(_any(t, ("CD",)), "Certificate of Deposit").otherwise("Commercial Paper"))
        .when(like(t, r"SOVEREIGN|\bSOV\b"), "Govt / SDL / T-Bill")
        .when(like(t, r"A1\+|A\s?[0-9]|A-1"), "Money Market")
        .when(like(t, RATING), "Corporate Bond")
        .otherwise("Other")
    )


def debt_details(company: Column, yield_text: Column, sector: Column) -> dict[str, Column]:
    """coupon (percent in the name), maturity_date (dd/mm/yyyy in brackets), ytm (a number as it stands) and rating (a sector that reads like one)."""
    found = lambda pattern, k: F.nullif(F.regexp_extract(company, pattern, k), F.lit(""))
    date = r"\(([0-9]{2})/([0-9]{2})/([0-9]{4})\)"
    rated = F.rlike(sector, F.lit("(?i)AAA|AA\\+?|A1\\+?|A\\+?|BBB\\+?|BB\\+?|B\\+?|Sovereign|SOV|Unrated|NR"))
    return {
        "coupon": found(r"([0-9]{1,2}(?:\.[0-9]+)?)\s*%", 1).cast("double"),
        "maturity_date": F.try_to_date(F.concat(found(date, 3), F.lit("-"), found(date, 2), F.lit("-"), found(date, 1)), "yyyy-MM-dd"),
        "ytm": F.regexp_replace(yield_text, "[,%]", "").try_cast("double"),
        "rating": F.when(rated, F.trim(sector)),
    }
