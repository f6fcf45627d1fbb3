"""Portfolio sheets as rows of cells: header rows found, columns named, sections carried down, blocks of derivatives told apart.

rows have file, sheet, n (from 0) and cells (array of texts, null or empty where
a cell is).  A sheet is a group of its own; no group is larger than a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matching import match_aliases

SHEET = ["file", "sheet"]

# What the columns of portfolio sheets are called, in order of precedence.
COLUMNS = {
    "company": ("name of the instrument", "issuer", "company", "stock", "security", "instrument"),
    "isin": ("isin",),
    "sector": ("industry", "sector", "rating / industry"),
    "instrument": ("instrument type", "type of instrument"),
    "rating": ("rating", "credit rating", "grade"),
    "coupon": ("coupon (%)", "coupon %", "coupon"),
    "quantity": ("quantity", "qty", "no of shares", "face value"),
    "market_value": ("market value", "market/fair value", "mkt value", "fair value", "market value (rs"),
    "percent_nav": ("% to nav", "% to aum", "% of nav", "% nav", "percentage", "% to net assets", "weightage"),
    "derivative_pct_nav": ("derivative % to nav",),
    "unhedged_pct_nav": ("unhedged % to nav",),
    "yield": ("yield", "ytm", "ytc", "yield to maturity"),
}
# Headings of sections, whole, by their start and by a part.
HEADINGS = (
    "equity", "debt", "money market", "equity & equity related", "debt instruments", "government securities", "treasury bills", "commercial paper", "certificate of deposit",
    "non convertible debentures", "current assets", "net current assets", "cash and cash equivalents", "reverse repo", "reverse repo / treps", "treps", "tri party repo", "net receivables",
    "net receivables / (payables)", "short term deposit", "short term deposits", "bank deposit", "cash equivalents", "(a) listed / awaiting listing", "listed / awaiting listing on stock exchanges",
    "units issued by invits", "units issued by mutual funds", "money market instruments", "others", "unclassified", "units of mutual fund", "units of mutual funds",
    "equity & equity related instruments", "total net assets", "net assets", "total", "grand total", "total net asset",
)
HEADING_STARTS = (
    "listed / awaiting", "unlisted", "units issued", "debt instrument", "government securit", "state government", "central government", "non-convertible", "non convertible", "securitized debt",
    "securitised debt", "certificate of deposit", "commercial paper", "treasury bill", "state development loan", "pass through certificate", "arbitrage", "cash & cash equivalent", "net current asset",
    "short term deposit", "money market instrument", "reverse repo", "tri-party repo", "treps", "total",
)
HEADING_PARTS = ("equity & equity related instrument", "debt instrument", "units of mutual fund", "units issued", "total net asset", "grand total")
ISIN = r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"


def tidy(cell: Column) -> Column:
    """A cell with single spaces; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def number(cell: Column) -> Column:
    """A cell's number without separators, currency and percent signs, in brackets negative; null if it is none."""
    s = F.trim(F.regexp_replace(cell, "[,₹]", ""))
    inside = F.rlike(s, F.lit(r"^\(.*\)$"))
    value = F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "$1"), "%+$", "")
    plain = F.when(F.rlike(value, F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")), F.trim(value).cast("double"))
    return F.when(inside, -plain).otherwise(plain)


def column_aliases(spark, columns: dict[str, tuple[str, ...]] = COLUMNS) -> DataFrame:
    """alias, target, family_rank and rank for match_aliases."""
    rows = [(alias, target, i, 1000 * i + j) for i, (target, names) in enumerate(columns.items()) for j, alias in enumerate(names)]
    return spark.createDataFrame(rows, "alias string, target string, family_rank int, rank int")


def header_rows(rows: DataFrame, columns: dict[str, tuple[str, ...]] = COLUMNS, look: int = 30, least: int = 3) -> DataFrame:
    """file, sheet and header_n: the first of the first `look` rows that names `least` kinds of columns, else row 0."""
    text = F.lower(F.array_join(F.filter(F.transform("cells", tidy), lambda c: c != ""), " "))
    kinds = sum((F.exists(F.array(*map(F.lit, names)), lambda a: F.contains(text, a)).cast("int") for names in columns.values()), F.lit(0))
    return rows.groupBy(*SHEET).agg(F.coalesce(F.min(F.when((F.col("n") < look) & (kinds >= least), F.col("n"))), F.lit(0)).alias("header_n"))


def named_columns(rows: DataFrame, columns: dict[str, tuple[str, ...]] = COLUMNS) -> DataFrame:
    """file, sheet, header_n and at (map from kind to place): of several columns of a kind the first that equals an alias, else the first.

    A heading with both "rating" and "industry" is a sector.
    """
    heads = rows.join(header_rows(rows, columns), SHEET).where(F.col("n") == F.col("header_n"))
    cells = heads.select(*SHEET, "header_n", F.posexplode(F.transform("cells", lambda c: F.lower(tidy(c)))).alias("i", "label")).where("label <> ''")
    found = match_aliases(cells, column_aliases(rows.sparkSession, columns), "longest").select("label", "target", (F.col("score") == 1).alias("equal"))
    both = F.contains("label", F.lit("rating")) & F.contains("label", F.lit("industry"))
    equal = F.coalesce("equal", F.lit(False))
    kind = F.when(both & ~equal, "sector").otherwise(F.col("target"))
    first = cells.join(found, "label").withColumn("kind", kind).where("kind IS NOT NULL").groupBy(*SHEET, "header_n", "kind").agg(F.min(F.struct((~equal).alias("no"), "i")).alias("f"))
    return first.groupBy(*SHEET, "header_n").agg(F.map_from_entries(F.collect_list(F.struct("kind", "f.i"))).alias("at"))  # a dozen kinds


def is_heading(cell: Column) -> Column:
    """Whether a tidy cell of a sparse row is the heading of a section or a total, not an instrument."""
    low = F.lower(cell)
    bare = F.regexp_replace(F.regexp_replace(low, r"^\(?[a-e]\)?[).:]?\s*", ""), "^[. ]+|[. ]+$", "")
    capitals = (F.upper(cell) == cell) & (F.lower(cell) != cell) & (F.size(F.split(cell, " ")) <= 12) & ~F.rlike(cell, F.lit(r"\d"))
    known = low.isin(*HEADINGS) | bare.isin(*HEADINGS)
    starts = F.exists(F.array(*map(F.lit, HEADING_STARTS)), lambda p: F.startswith(low, p) | (F.startswith(bare, p) & (p != "total")))
    parts = F.exists(F.array(*map(F.lit, HEADING_PARTS)), lambda p: F.contains(low, p))
    return (F.length(cell) > 3) & (F.length(cell) < 90) & ~F.rlike(F.upper(cell), F.lit(ISIN)) & number(cell).isNull() & (known | starts | parts | capitals)


def holdings_of_sheets(rows: DataFrame, columns: dict[str, tuple[str, ...]] = COLUMNS) -> DataFrame:
    """file, sheet, n, section, nav (market value of the grand total) and one text for each kind of column, of every holding.

    Rows under the header with at most three filled cells and a heading open a
    section, totals only close it.  Of the others, holdings have an ISIN, a name
    with a quantity, or a name with a market value.
    """
    body = rows.join(named_columns(rows, columns), SHEET).where(F.col("n") > F.col("header_n")).withColumn("cells", F.transform("cells", tidy))
    filled = F.size(F.filter("cells", lambda c: c != ""))
    values = {k: F.coalesce(F.get("cells", F.try_element_at("at", F.lit(k))), F.lit("")) for k in columns}
    body = body.where(filled > 0).select(*SHEET, "n", filled.alias("filled"), *[v.alias(k) for k, v in values.items()])
    sparse = F.col("filled") <= 3
    label = F.when(sparse & is_heading(F.col("company")), F.col("company")).when(sparse & is_heading(F.col("isin")), F.col("isin"))
    total = sparse & (F.contains(F.lower("company"), F.lit("grand total")) | F.contains(F.lower("isin"), F.lit("grand total")))
    nav = number(F.col("market_value"))
    w = Window.partitionBy(*SHEET).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*SHEET).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opened = F.when(~F.contains(F.lower("label"), F.lit("total")), F.col("label"))
    body = body.withColumn("label", label).withColumn("section", F.coalesce(F.last(opened, True).over(w), F.lit("")))
    body = body.withColumn("nav", F.last(F.when(total & (nav != 0), nav), True).over(whole))
    holding = F.rlike(F.upper("isin"), F.lit(ISIN)) | ((F.col("company") != "") & ((F.col("quantity") != "") | nav.isNotNull()))
    return body.where(F.col("label").isNull() & holding).select(*SHEET, "n", "section", "nav", *columns)


# What opens a block of derivatives, its kind by the first pattern found, and the fields of its columns by what their headings hold.
OPENER = r"(?i)hedg\w+\s+position|other\s+than\s+hedg|positions?\s+through|transactions\s+in\s+credit"
KINDS = (("credit_derivatives", r"(?i)credit\s+(?:default\s+)?(?:swap|derivatives?)"), ("swaps", r"(?i)\bswaps?\b"), ("options", r"(?i)\boptions?\b"), ("futures", r"(?i)\bfutures?\b"))
TITLE = r"(?i)derivative\s+disclosure|disclosure\s+regarding\s+derivatives?"
PERCENT_TOTAL = r"(?i)total\s*(?:%age|percentage)\b|%\s*of\s*existing\s*assets"
SUMMARY = r"(?i)contract|notional\b|number\s+of|profit|\d\.\s|gross\s+notional"
FIELDS = (
    ("scheme_tag", r"scheme name|^scheme$"), ("swap_type", "swap type"), ("underlying", "reference entity|underlying|security|instrument|scrip"), ("industry", "industry|^sector$"), ("maturity", "maturity"),
    ("margin", "margin"), ("market_value", "market value|^mv$"), ("notional", "notional"), ("price_buy", "price when purchased|purchas.*price|price.*purchas"), ("price_current", "current price"),
    ("price_buy", "price.*futures|futures.*price"), ("strike_or_premium", "strike|premium|exercise"), ("option_type", "option type|call|put"), ("combined_qty", "long.*short|short.*long"), ("long_pos", "long"), ("short_pos", "short"),
)
NUMERIC = ("combined_qty", "long_pos", "short_pos", "notional", "price_buy", "price_current", "margin", "market_value")
NEEDS_COLUMNS = "underlying|instrument|scrip|security|industry|price|notional|swap type"


def _field(cell: Column) -> Column:
    """The field that a column's heading names."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FIELDS):
        out = F.when(F.rlike(F.lower(cell), F.lit(pattern)), name).otherwise(out)
    return out


def derivative_rows(rows: DataFrame) -> DataFrame:
    """Rows of sheets that disclose derivatives, by the sheet's name or a title in its first ten rows."""
    titled = F.lower("sheet").startswith("derivative") | F.coalesce(F.bool_or(F.when(F.col("n") < 10, F.exists("cells", lambda c: F.coalesce(F.rlike(c, F.lit(TITLE)), F.lit(False))))).over(Window.partitionBy(*SHEET)), F.lit(False))
    return rows.withColumn("titled", titled).where("titled").drop("titled")


def derivative_positions(rows: DataFrame) -> DataFrame:
    """file, sheet, block, kind, hedging, nil, n, role ("position" or "subtotal") and the fields of every line of derivatives; a block without lines has one row without role.

    A block begins at a lone title and ends before the next.  Its columns are
    those of its first row that names some; below it, rows with a name and a
    number are positions, and other rows with two numbers subtotals.  Totals of
    percentages and rows of counts belong to no block.
    """
    c = F.col
    r = derivative_rows(rows).withColumn("cells", F.transform("cells", tidy)).withColumn("texts", F.filter("cells", lambda x: x != "")).where(F.size("texts") > 0)
    r = r.withColumn("joined", F.lower(F.array_join("texts", " "))).withColumn("first", F.get("texts", F.lit(0)))
    hints = F.size(F.filter("texts", lambda t: F.rlike(t, F.lit(SUMMARY))))
    aside = F.rlike("joined", F.lit(PERCENT_TOTAL)) | ((hints >= 2) & (F.size("texts") >= 3))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.rlike("first", F.lit(pattern)), name).otherwise(kind)
    opens = (F.size("texts") <= 2) & (F.length("first") >= 14) & F.rlike("first", F.lit(OPENER)) & ~F.rlike(F.lower("first"), F.lit("derivative disclosure|disclosure regarding"))
    r = r.where(~aside).withColumn("kind", F.when(opens, kind))
    w = Window.partitionBy(*SHEET).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("block", F.count("kind").over(w)).where("block > 0").withColumn("fields", F.transform("cells", lambda x: F.when(x != "", _field(x))))
    names = F.size(F.filter("fields", lambda f: f.isNotNull())) > 0
    heads = c("kind").isNull() & (F.array_contains("fields", "underlying") | (names & F.rlike("joined", F.lit(NEEDS_COLUMNS))))
    block = Window.partitionBy(*SHEET, "block")
    r = r.withColumn("head_n", F.min(F.when(heads, c("n"))).over(block))
    r = r.withColumns({
        "at": F.first(F.when(c("n") == c("head_n"), c("fields")), True).over(block), "opener": F.first("kind", True).over(block),
        "hedging": F.bool_or(F.when(c("kind").isNotNull(), ~F.contains(F.lower("first"), F.lit("other than hedg")))).over(block),
        "nil": F.bool_or(F.when(c("kind").isNotNull(), F.endswith("joined", F.lit(": nil")))).over(block),
    })
    value = lambda f: F.coalesce(F.get("cells", F.nullif(F.array_position("at", f), F.lit(0)).cast("int") - 1), F.lit(""))
    fields = [f for f in dict.fromkeys(name for name, _ in FIELDS)]
    r = r.withColumns({f"f_{f}": value(f) for f in fields})
    under = c("n") > c("head_n")
    letters = F.length(F.regexp_replace("f_underlying", r"[^\p{L}]", ""))
    plausible = under & (letters >= 3) & F.greatest(*[number(c(f"f_{f}")).isNotNull().cast("int") for f in NUMERIC]).cast("boolean")
    numbers = F.size(F.filter("texts", lambda t: number(t).isNotNull()))
    role = F.when(c("kind").isNotNull() | (c("n") == c("head_n")), None).when(F.coalesce(plausible, F.lit(False)), "position").when(numbers >= 2, "subtotal")
    lines = r.withColumn("role", role)
    lines = lines.withColumn("any", F.count("role").over(block)).where(c("role").isNotNull() | (c("kind").isNotNull() & (c("any") == 0)))
    long_, short = number(c("f_long_pos")), number(c("f_short_pos"))
    quantity = F.coalesce(number(c("f_combined_qty")), F.when(long_.isNotNull() | short.isNotNull(), F.coalesce(long_, F.lit(0.0)) - F.coalesce(short, F.lit(0.0))))
    of_position = lambda x: F.when(c("role") == "position", x)
    return lines.select(
        *SHEET, "block", c("opener").alias("kind"), "hedging", "nil", "n", "role",
        of_position(c("f_underlying")).alias("underlying"), of_position(F.nullif("f_industry", F.lit(""))).alias("industry"), of_position(F.nullif("f_maturity", F.lit(""))).alias("maturity"),
        of_position(quantity).alias("quantity"), of_position(F.when(quantity < 0, "short").when(quantity > 0, "long")).alias("side"),
        *[of_position(number(c(f"f_{f}"))).alias(f) for f in ("notional", "price_buy", "price_current", "margin", "market_value")],
    )


def derivative_totals(positions: DataFrame) -> DataFrame:
    """Counts and sums of positions for each block, zero where it has none."""
    total = lambda f: F.round(F.coalesce(F.sum(f), F.lit(0.0)), 6).alias(f)
    return positions.groupBy(*SHEET, "block", "kind", "hedging", "nil").agg(F.count(F.when(F.col("role") == "position", 1)).alias("n_positions"), total("market_value"), total("notional"), total("quantity"))
