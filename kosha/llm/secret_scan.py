"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are
reported wherever they stand.  Weak candidates (bare 40-character keys, user
names, endpoints) are noise on their own: they are reported only when a
complementary part ends or begins within `scope` code points of them, found by an
interval join over position bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, keep

# Fixed values of the contract: the strong kinds in their listed order.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run of 24 and more, as leftmost runs of any length, the short ones dropped
# Weak kinds; each needs one of its complements nearby.
KEY40 = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
USER = r"(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
ENDPOINT = r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|s3)://[A-Za-z0-9.-]+(?::[0-9]+)?"
KINDS = ("assign", "access", "hex", "key40", "user", "endpoint")
COMPLEMENTS = {"key40": ("access",), "user": ("assign",), "endpoint": ("access", "assign")}


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, kind: str, item) -> Column:
    """item(at, x) for every x of the array, in order; item gives a struct of `kind` whose field `at` is passed on, 0 at first.

    The fold goes block by block, the square root of the number of items each, so
    that no step copies more than a block's results or the list of blocks.
    """
    none, blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def block(acc, part):
        zero = F.struct(acc["at"].alias("at"), none.alias("out"))
        step = lambda a, x: _let(item(a["at"], x), lambda got: F.struct(got["at"].alias("at"), F.concat(a["out"], F.array(got)).alias("out")))
        return F.aggregate(part, zero, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    def fold(xs):
        side = F.ceil(F.sqrt(F.size(xs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, side), lambda i: F.slice(xs, i + 1, side))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), blocks.alias("out")), block, lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(items) > 0, _let(items, fold)).otherwise(none)


def _spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, kind, value), in code points, end exclusive.

    A match starts where the texts between matches and the matches before it
    end; both lists come from one pattern, so their lengths give positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)

    def item(at, x):
        start = at + F.length(x["gap"])
        return F.struct((start + F.length(x["hit"])).alias("at"), start.alias("start"), x["value"].alias("value"))

    parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    placed = _running(parts, "struct<at:int,start:int,value:string>", item)
    spans = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["at"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(_none())


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")


def _base(text: Column) -> Column:
    assign = F.filter(_spans(text, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    access = F.filter(_spans(text, "access", ACCESS), lambda s: s["end"] - s["start"] >= 20)
    return F.concat(assign, access, _spans(text, "hex", HEX))


def link_parts(found: DataFrame, scope: int) -> DataFrame:
    """The weak spans of `found` (__id, __text, base, weak) that have a complement within scope: (l_id, l_text, linked).

    The distance is that of the nearest edges.  Positions are dealt into bins of
    `scope` code points; a complement stands in every bin it covers, a weak part
    looks into every bin within its reach.  Gaps between complements in one bin
    are shorter than a reach, so the least start and largest end of each bin are
    enough: no pairs are made, and a text with many parts is spread over its bins.
    """
    key = ["__id", "__text"]
    both = found.where(F.size("weak") > 0).dropDuplicates(key)
    strong = both.select(*key, F.explode("base").alias("s")).select(*key, F.col("s.kind").alias("part"), F.col("s.start").alias("at"), F.col("s.end").alias("to")).where("part != 'hex'")
    strong = strong.withColumn("bin", F.explode(F.expr(f"sequence(at div {scope}, (to - 1) div {scope})")))
    bins = strong.groupBy(*key, "part", "bin").agg(F.min("at").alias("low"), F.max("to").alias("high"))
    needs = F.create_map(*[x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = both.select(*key, F.explode("weak").alias("s")).select(*key, "s", F.explode(needs[F.col("s.kind")]).alias("part"))
    wanted = wanted.withColumn("bin", F.explode(F.expr(f"sequence(greatest(s.start - {scope} - 1, 0) div {scope}, (s.end + {scope}) div {scope})")))
    near = F.expr(f"r_low - s.end <= {scope} AND s.start - r_high <= {scope}")
    reach = bins.select(*[F.col(c).alias(f"r_{c}") for c in bins.columns])
    same = F.expr("__id <=> r___id AND __text = r___text AND part = r_part AND bin = r_bin")
    hits = wanted.join(reach, same).where(near).select(*key, "s").distinct()
    return hits.groupBy(F.col("__id").alias("l_id"), F.col("__text").alias("l_text")).agg(F.collect_list("s").alias("linked"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per row of docs: id_col, base and spans as arrays of (start, end, kind, value).

    base holds the strong spans; spans holds these and the linked weak ones.
    Null and empty texts have none, null ids are kept.  Rows are never merged:
    rows with equal ids and texts get equal results, rows with equal ids and
    different texts their own.  An empty table gives an empty result; other
    columns, whatever their names, play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), text.alias("__full"), _base(text).alias("base"))
    weak = F.concat(*[_spans(F.col("__full"), k, p) for k, p in (("key40", KEY40), ("user", USER), ("endpoint", ENDPOINT))])
    found = keep(found.select("__id", "__text", "base", F.when(F.size("base") > 0, weak).otherwise(_none()).alias("weak")), "secret-spans")
    added = link_parts(found, scope)
    return found.join(added, F.expr("__id <=> l_id AND __text = l_text"), "left").select(F.col("__id").alias(id_col), "base", F.concat("base", F.coalesce("linked", _none())).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Counts, a digest of the strong spans and all spans as text, one row per row of docs; see find_spans."""
    spans = find_spans(docs, id_col, text_col, scope)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with the union of the sorted spans replaced.  UTF-32 gives code points fixed places; a mark before each piece is taken off by decoding."""
    encoded = F.encode(text, "UTF-32")

    def item(at, s):
        return F.struct(F.greatest(at, s["end"]).alias("at"), at.alias("low"), F.when(s["start"] >= at, s["start"]).alias("high"))

    gaps = F.filter(_running(spans, "struct<at:int,low:int,high:int>", item), lambda g: g["high"].isNotNull())
    last = F.array(F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("low"), F.length(text).alias("high")))
    gaps = F.concat(F.transform(gaps, lambda g: F.struct(g["low"].alias("low"), g["high"].alias("high"))), last)

    def pieces(e):
        cut = lambda g: F.substring(e, 4 * g["low"] + 1, 4 * (g["high"] - g["low"]))
        return F.transform(gaps, lambda g: F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), cut(g)), "UTF-32"))

    return F.array_join(_let(encoded, pieces), mask)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every span that find_spans reports replaced by mask; all rows and columns stay.

    Overlapping spans are replaced once, as their union.  Null texts stay null,
    texts without spans stay as they are, repeated rows stay repeated, and an
    empty table gives an empty result.  Columns may have any names but those that
    begin with two underscores.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("__text", F.xxhash64(text)).withColumn("__base", _base(text))
    weak = F.concat(*[_spans(text, k, p) for k, p in (("key40", KEY40), ("user", USER), ("endpoint", ENDPOINT))])
    found = marked.where(F.size("__base") > 0).select(F.col(id_col).alias("__id"), "__text", F.col("__base").alias("base"), weak.alias("weak"))
    linked = keep(link_parts(found, scope), "secret-links").select(F.col("l_id").alias("__l_id"), F.col("l_text").alias("__l_text"), F.col("linked").alias("__linked"))
    marked = marked.join(broadcast_if_small(linked), F.col(id_col).eqNullSafe(F.col("__l_id")) & (F.col("__text") == F.col("__l_text")), "left")
    spans = F.sort_array(F.concat("__base", F.coalesce("__linked", _none())))
    cleaned = F.when(F.size("__base") > 0, _masked(F.col(text_col), spans, mask)).otherwise(F.col(text_col))
    return marked.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])
