"""What is no scheme's name and no holding, which open tickets come first, and stocks found by isin, name or a part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import _inside

c = F.col

# How headings and notes begin that stand in the place of a scheme's name or a holding, and cells of table heads.
JUNK_NAMES = (
    r"sheet\d+", r"top\s+\d+\s+holdings?", r"product\s+labell", r"please\s+mention", r"name\s+of\s+the\s+(?:instrument|security)", r"industry\s+classification", r"portfolio\s+summary", r"grand\s+total", r"net\s+assets",
    r"market\s+value\s+of\s+investments?", r"total\s+amount\s+invested", r"returns?\b",
)
NOTES = (
    r"top\s*\d+\s*holdings?", r"non[- ]\s*sensex", r"thinly\s+traded", r"non[- ]\s*traded", r"industry\s+classification", r"less\s+than\s*0[.,]0?\d*\s*%?", r"note\b", r"yield\s+to\s+(?:call|maturity|redemption)", r"net\s+assets",
    r"scheme\s+classification", r"as\s+on\b", r"portfolio\s+summary", r"fund\s+summary", r"top\s+holdings?", r"name\s+of\s+(?:the\s+)?(?:instrument|security)", r"market\s+value\s+of\s+investments?", r"total\s+amount\s+invested",
    r"record\s+date", r"since\s+inception", r"nil\b", r"returns?\b", r"annualised", r"annualized", r"benchmark\b", r"trio\b", r"\d{1,2}\s*-?\s*(?:year|yr)\b", r"cagr\b", r"[\*\+\^~£@#\$]",
)
RETURNS = (r"returns?\s*\(", "annualis", r"benchmark\b", r"since\s+inception", r"^\d{1,2}\s*[-–]?\s*(?:year|yr)\b", r"\btrio\b")
HEAD_CELLS = (
    "date", "underlying", "scheme", "series", "issuer", "isin", "name", "quantity", "qty", "market", "value", "market value", "pct", "pct_nav", "percent", "rating", "industry", "sector", "symbol", "security", "instrument",
    "description", "total", "sub total", "subtotal", "grand total", "particulars", "details", "company", "asset class",
)
TOTALS = (
    r"number\s+of\s+contracts", "exposure", "brokerage", "investments?", r"market\s+value", r"value\s+and\s+percentage", "outstanding", "percentage", "dividend", "idcw", "assets", "securities", "amount", r"net\s+assets", "contracts", "transactions",
)
SECTION_NOTES = (
    r"illiquid\s+securities", r"derivative\s+disclosure", r"foreign\s+securities", "adrs?", "gdrs?", r"as\s+on\b", r"as\s+at\b", r"exposure\s+due\s+to\s+futures", "hedg", r"repo\s+transactions", r"^total\b", r"^the\s+total\b", r"^\(?\d+[).]\s*",
)
MOST_PERCENT = 1000


def _begins(x: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(x, F.lit(rf"(?i)^(?:{'|'.join(patterns)})"))


def _holds(x: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(x, F.lit(rf"(?i){'|'.join(patterns)}"))


def is_junk_name(name: Column) -> Column:
    """Whether a scheme's name is empty, a sheet's code (capitals and digits) or the heading of a table."""
    n = F.trim(F.coalesce(name, F.lit("")))
    heading = F.rlike(n, F.lit(rf"(?i)^(?:{'|'.join(JUNK_NAMES)})\b"))
    return F.when(n == "", True).when(F.contains(n, F.lit(" ")), heading).otherwise(F.rlike(n, F.lit("^[A-Z0-9]{1,15}$")))


def looks_like_holding(company: Column, isin: Column, section: Column, percent: Column, market_value: Column, quantity: Column) -> Column:
    """Whether a parsed row is a holding: no head, note or return, with an identifier and no absurd weight, or else with a number outside the sections of notes.

    percent and market_value are numbers, quantity a text.
    """
    name, code, part = (F.trim(F.coalesce(x, F.lit(""))) for x in (company, isin, section))
    either = lambda test: test(name) | test(code)
    rejected = either(lambda x: F.lower(x).isin(*HEAD_CELLS)) | either(lambda x: _begins(x, NOTES)) | either(lambda x: _holds(x, RETURNS))
    valid = ~F.lower(code).isin("na", "-", "none") & F.rlike(code, F.lit("^[A-Za-z0-9]{4,20}$"))
    plausible = F.abs(percent) <= MOST_PERCENT
    note = _holds(part, (rf"total\s+(?:{'|'.join(TOTALS)})", *SECTION_NOTES)) & (part != "")
    numbers = F.coalesce(plausible, F.lit(False)) | market_value.isNotNull() | F.rlike(F.regexp_replace(F.coalesce(quantity, F.lit("")), ",", ""), F.lit(r"^\s*-?\d+(\.\d+)?\s*$"))
    return F.when(rejected, False).when(valid, F.coalesce(plausible, F.lit(True))).otherwise(~note & numbers)


def ticket_order() -> list[Column]:
    """Oldest month first (one that is no month before all), then the lowest coverage, house and scheme."""
    month = F.trim(F.coalesce("month", F.lit("")))
    known = F.rlike(month, F.lit(r"^\d{4}-(0[1-9]|1[0-2])$"))
    epoch = F.when(known, F.substring(month, 1, 4).try_cast("int") * 12 + F.substring(month, 6, 2).try_cast("int")).otherwise(0)
    return [epoch, F.coalesce("coverage_pct", F.lit(0.0)), F.coalesce("amc", F.lit("")), F.coalesce("scheme", F.lit(""))]


def select_tickets(tickets: DataFrame, most: int | None = None) -> DataFrame:
    """Open tickets (status, month, coverage_pct, amc, scheme) in the order in which they are worked, at most `most` of them."""
    ordered = tickets.where("status = 'OPEN'").orderBy(*ticket_order())
    return ordered if most is None else ordered.limit(max(0, most))


def resolve_stocks(items: DataFrame, securities: DataFrame, least: int = 3) -> DataFrame:
    """id, tier and isin of the security of each item (id, isin, name): 0 by isin, 1 by name in any case, 2 by a security's name or alias that holds the item's.

    securities: isin, name, aliases (text).  Parts of names have `least`
    characters at least.  Of several the lowest isin.
    """
    known = securities.select(F.upper("isin").alias("s_isin"), F.lower("name").alias("s_name"), F.lower(F.coalesce("aliases", F.lit(""))).alias("s_aliases"))
    asked = items.select("id", F.upper(F.trim(F.coalesce("isin", F.lit("")))).alias("i"), F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("n"))
    texts = known.select("s_isin", F.explode(F.array("s_name", "s_aliases")).alias("name"))
    held = _inside(asked.where("n <> ''").select(c("n").alias("name")).distinct(), texts.select("name").distinct(), least).join(texts, c("long") == c("name")).select(c("short").alias("n"), "s_isin").distinct()
    hits = [asked.where("i <> ''").join(known, c("i") == c("s_isin")), asked.where("n <> ''").join(known, c("n") == c("s_name")), asked.join(held, "n")]
    found = None
    for tier, h in enumerate(hits):
        part = h.select("id", F.lit(tier).alias("tier"), c("s_isin").alias("isin"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("id").agg(F.min(F.struct("tier", "isin")).alias("b")).select("id", "b.tier", "b.isin")
