"""File sources with explicit schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOLDING = "struct<company:string,isin:string,percent_nav:string,sector:string>"
SCHEMES = f"amc string, as_of string, schemes map<string, struct<holdings:array<{HOLDING}>>>"


def scheme_documents(spark: SparkSession, path: str) -> DataFrame:
    """amc, as_of, fund and one row for each holding of JSON documents {amc, as_of, schemes: {fund: {holdings: [...]}}}."""
    docs = spark.read.schema(SCHEMES).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    funds = docs.select("amc", "as_of", F.explode("schemes").alias("fund", "s"))
    return funds.select("amc", "as_of", "fund", F.explode("s.holdings").alias("h")).select("amc", "as_of", "fund", "h.company", "h.isin", F.regexp_replace("h.percent_nav", "[,%]", "").try_cast("double").alias("percent_nav"), "h.sector")


def index_weights(spark: SparkSession, path: str) -> DataFrame:
    """index, isin, symbol, weight of documents {index: {key: weight}}.

    A key with the country prefix is an isin, any other a symbol, which is left to
    be resolved; keys are trimmed and put in capitals, weights that are no numbers
    are left out.
    """
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    rows = docs.select(F.explode("m").alias("index", "w")).select("index", F.explode("w").alias("key", "weight"))
    key, weight = F.upper(F.trim("key")), F.col("weight").try_cast("double")
    is_isin = F.startswith(key, F.lit("INE"))
    return rows.select("index", F.when(is_isin, key).alias("isin"), F.when(~is_isin, key).alias("symbol"), weight.alias("weight")).where("weight IS NOT NULL")


def nav_report(spark: SparkSession, path: str) -> DataFrame:
    """code, d, nav of reports with 8 fields between semicolons; other lines, bad codes, dates and values are left out."""
    f = F.split("value", ";")
    rows = spark.read.text(path).where(F.size(f) == 8)
    at = lambda k: F.trim(F.get(f, F.lit(k)))
    rows = rows.select(at(0).alias("code"), F.try_to_date(at(7), "dd-MMM-yyyy").alias("d"), F.regexp_replace(at(4), ",", "").try_cast("double").alias("nav"))
    return rows.where(F.rlike("code", F.lit("^[0-9]+$")) & F.col("d").isNotNull() & (F.col("nav") > 0))


# The columns of the two layouts of daily exchange files, and the series that hold equity.
LAYOUTS = (
    ("ISIN", "TradDt", "OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol", "SctySrs"),
    ("ISIN", "TIMESTAMP", "OPEN", "HIGH", "LOW", "CLOSE", "TOTTRDQTY", "SERIES"),
)
EQUITY_SERIES = ("EQ", "BE", "BZ", "SM", "ST", "SZ")


def price_days(spark: SparkSession, path: str) -> DataFrame:
    """isin, d, open, high, low, close, volume of daily exchange files in either of two layouts, equity series only.

    A folder may hold both: the files are told apart by their first lines, and each
    layout is read on its own.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.contains("value", F.lit("ISIN"))).select("file", F.contains("value", F.lit("TckrSymb")).alias("new")).distinct()
    files = {False: [], True: []}
    for r in heads.collect():  # one row for each file, as a listing has
        files[r.new].append(r.file)
    out = None
    for layout, new in zip(LAYOUTS, (True, False), strict=True):
        if not files[new]:
            continue
        i, d, o, h, low, c, v, s = (F.trim(F.col(n)) for n in layout)
        rows = spark.read.option("header", True).csv(files[new]).where(s.isin(*EQUITY_SERIES))
        when = F.coalesce(F.try_to_date(d, "yyyy-MM-dd"), F.try_to_date(d, "dd-MMM-yyyy"))
        part = rows.select(i.alias("isin"), when.alias("d"), *[x.try_cast("double").alias(n) for x, n in ((o, "open"), (h, "high"), (low, "low"), (c, "close"))], v.try_cast("long").alias("volume")).where("close > 0")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "isin string, d date, open double, high double, low double, close double, volume long")


def append_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only JSON-lines log; bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
