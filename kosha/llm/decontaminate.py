"""Benchmark decontamination against a hash set of normalised test n-grams, in DataFrame functions only.

Every window of the test items carries an anchor, its longest word.  The scan
explodes the words of the training texts and probes the broadcast anchors; where
one stands, the window around it is hashed and looked up in the set of test
windows.  A window can only occur where its anchor does, so no occurrence is
lost, whatever the anchors are; they only decide how many windows are hashed.
Windows found by hash are verified word by word.  Anchors beyond the broadcast
bound are left aside: then every window of the texts is looked up by a shuffle
of windows, never of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, keep, lower_ascii

# Fixed value of the contract: characters that separate words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the whole text; of a null text, none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def test_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows of the test items: gram (its words), hash, n (their number), anchor, shift (place of the anchor), item."""
    words = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(width), F.size("w"))
    at = words.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    window = at.select("item", "n", F.expr("slice(w, at + 1, n)").alias("g"))
    longest = F.array_max(F.transform("g", lambda x, i: F.struct(F.length(x).alias("l"), x.alias("x"), (-i).alias("i"))))
    found = window.select("item", "n", F.array_join("g", " ").alias("gram"), longest.alias("a"))
    return found.select("item", "n", "gram", F.xxhash64("gram").alias("hash"), F.col("a.x").alias("anchor"), (-F.col("a.i")).alias("shift")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", width: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of docs that holds a window: __id, __text (hash of the text), hits (sorted distinct (start, n)), items (sorted).

    Anchors and test windows are broadcast only if they are at most
    `broadcast_rows` rows.
    """
    windows = keep(test_windows(items, item_col, item_text_col, width), "test-windows")
    anchors = windows.groupBy("anchor").agg(F.collect_set(F.struct("n", "shift")).alias("cuts"))
    few = anchors.limit(broadcast_rows + 1).count() <= broadcast_rows
    grams = windows.groupBy("hash", F.col("gram").alias("g_gram")).agg(F.collect_set("item").alias("g_items"))
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), words_of(F.col(text_col)).alias("w"))
    if few:
        spots = texts.select("__id", "__text", "w", F.posexplode("w").alias("pos", "anchor")).join(F.broadcast(anchors), "anchor")
        spots = spots.select("__id", "__text", "w", "pos", F.explode("cuts").alias("c")).select("__id", "__text", "w", F.expr("pos - c.shift").alias("start"), F.col("c.n").alias("n"))
    else:
        lengths = [r.n for r in windows.select("n").distinct().collect()]  # at most `width` numbers
        spots = texts.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where("size(w) >= n")
        spots = spots.select("__id", "__text", "w", "n", F.explode(F.expr("sequence(0, size(w) - n)")).alias("start"))
    spots = spots.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("w")))
    looked = spots.select("__id", "__text", "start", "n", F.expr("array_join(slice(w, start + 1, n), ' ')").alias("gram")).withColumn("hash", F.xxhash64("gram"))
    hits = looked.join(broadcast_if_small(grams, broadcast_rows), "hash").where("gram = g_gram")
    return hits.groupBy("__id", "__text").agg(
        F.array_sort(F.collect_set(F.struct("start", "n"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("g_items")))).alias("items"),
    )


def _covered(hits: Column) -> Column:
    """Words inside the union of sorted (start, n) spans."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("sum"))

    def step(acc, h):
        end = h["start"] + h["n"]
        return F.struct(F.greatest(acc["to"], end).alias("to"), (acc["sum"] + F.greatest(F.lit(0), end - F.greatest(acc["to"], h["start"]))).alias("sum"))

    return F.aggregate(hits, zero, step, lambda acc: acc["sum"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `width` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A document word inside any occurrence of a
    window is hit.  Null and empty texts have no words and no hits; null and
    empty items, and an empty items table, have no windows.  Repeated rows stay
    repeated, null ids stay; repeated items count once.  Other columns play no
    part.
    """
    found = find_hits(docs, items, id_col, text_col, item_col, item_text_col, width, broadcast_rows)
    found = found.select(F.col("__id").alias("__h_id"), F.col("__text").alias("__h_text"), _covered(F.col("hits")).alias("covered"), "items")
    found = broadcast_if_small(keep(found, "contamination"), broadcast_rows)
    counted = docs.select(F.col(id_col), F.xxhash64(text_col).alias("__text"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    joined = counted.join(found, F.col(id_col).eqNullSafe(F.col("__h_id")) & (F.col("__text") == F.col("__h_text")), "left")
    return joined.select(
        id_col,
        "n_words",
        F.coalesce("covered", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("covered", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, mode: str = "documents", broadcast_rows: int = 200_000) -> DataFrame:
    """docs without contaminated documents (mode "documents") or without the words that are hit (mode "spans").

    In mode "spans" texts with hits are put together again from their other
    words, normalised and joined by one space; texts without hits stay as they
    are, and no row goes.  All columns stay; they may have any names but those
    that begin with two underscores.
    """
    found = find_hits(docs, items, id_col, text_col, item_col, item_text_col, width, broadcast_rows).select(F.col("__id").alias("__h_id"), F.col("__text").alias("__h_text"), F.col("hits").alias("__hits"))
    found = broadcast_if_small(keep(found, "contaminated"), broadcast_rows)
    same = F.col(id_col).eqNullSafe(F.col("__h_id")) & (F.xxhash64(text_col) == F.col("__h_text"))
    if mode == "documents":
        return docs.join(found, same, "left_anti")
    words = F.transform(words_of(F.col(text_col)), lambda w, i: F.when(F.exists("__hits", lambda h: (h["start"] <= i) & (i < h["start"] + h["n"])), F.lit("")).otherwise(w))
    cleaned = F.when(F.col("__hits").isNotNull(), F.array_join(F.array_remove(words, ""), " ")).otherwise(F.col(text_col))
    return docs.join(found, same, "left").select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])
