"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns; it is named by hashes that are
totals over its turns, so they come from running totals and no conversation is
put together anywhere.  Every node belongs to the least conversation that
begins with it.  The nodes of one conversation are a run of depths, and with
children ordered by the conversation they belong to, that run is also a run of
the preorder.  So runs are ranked, lexicographically by the turns-off that lead
to them, and a node's place is that of its run and its depth.  A subtree ends
behind the conversation that brings the count of ended ones to the node's
members; leaves and savings are differences of running totals between the two
ends.

Two different conversations share every node before they part, and each of them
has a row for each, so a path with b turns-off takes b^2 / 2 rows at least: lists
of turns-off stay short, whatever the length of conversations.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running
from .shared import keep

NODE = ["a", "b", "depth"]  # two hashes of the turns, and their number


def number_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), two hashes k1 and k2 of role and text, and n_bytes of the text in UTF-8, of every turn.

    Turns stand by number, null first; equal numbers by role, then by SHA-256 of
    the text.  Null roles and texts are empty.  Rows without conv_id belong to no
    conversation and are left out.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one")
    )
    turns = keep(turns, "turns").select("*", F.xxhash64(F.lit(1), "role", "digest").alias("k1"), F.xxhash64(F.lit(2), "role", "digest").alias("k2"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    found = running(turns, order, {"before": ("one", "sum")}, "conv_id", ["conv_id", "k1", "k2", "n_bytes", "one"])
    return found.select("conv_id", (F.col("before") + 1).alias("pos"), "k1", "k2", "n_bytes")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations given as turns (conv_id, pos, k1, k2, n_bytes) and convs (conv_id, n_turns; those without turns too).

    nodes: a, b, depth, conv_id (least member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, preorder and subtree_end (the subtree's places are
    preorder to subtree_end - 1).  ends: a, b, depth and conv_id of the node at
    which each conversation ends.  Positions of a conversation are 1 to n_turns.
    Without conversations there are no nodes.
    """
    turns, convs = keep(turns.select("conv_id", "pos", "k1", "k2", "n_bytes"), "turns"), keep(convs.select("conv_id", "n_turns"), "convs")
    terms = turns.select("conv_id", F.col("pos").alias("depth"), "n_bytes", F.xxhash64("pos", "k1").alias("t1"), F.xxhash64("pos", "k2").alias("t2"))
    seen = running(terms, [F.col("depth")], {"p1": ("t1", "xor"), "p2": ("t2", "xor")}, "conv_id")
    seen = seen.select("conv_id", "depth", "n_bytes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("t1")).alias("a"), F.col("p2").bitwiseXOR(F.col("t2")).alias("b"))
    seen = keep(seen.join(convs, "conv_id").withColumn("last", (F.col("depth") == F.col("n_turns")).cast("long")).drop("n_turns"), "prefixes")

    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("n_turns") == 0).cast("long")).alias("n_ends")).where("n_convs > 0")
    root = top.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("n_bytes"), zero.alias("p1"), zero.alias("p2"), "n_ends")
    below = seen.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("last").alias("n_ends"))
    nodes = keep(below.unionByName(root), "nodes")

    # Parents; those of first turns are the root, which may have very many.
    above = nodes.select(F.col("a").alias("p1"), F.col("b").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above, ["p1", "p2", "depth"])
    least = convs.agg(F.min("conv_id")).first()[0]
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    tied = deep.unionByName(first).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    children = tied.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    tied = keep(tied.drop("p1", "p2").join(children, ["conv_id", "depth"], "left"), "tied")

    # Runs: depths that belong to one conversation.  Turns-off: first nodes of runs, deepest first where they leave the same run.
    off = tied.where("conv_id <> parent_conv_id").select(*NODE, F.col("conv_id").alias("run"))
    paths = seen.select("conv_id", *NODE).join(off, NODE).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "run"))).alias("path"))
    paths = paths.where(F.element_at("path", -1)["run"] == F.col("conv_id")).select("conv_id", F.transform("path", lambda x: F.struct((-x["depth"]).alias("d"), x["run"].alias("run"))).alias("path"))
    runs = tied.groupBy("conv_id").agg(F.min("depth").alias("top"), F.count(F.lit(1)).alias("size")).join(paths, "conv_id", "left")
    runs = keep(runs.withColumn("path", F.coalesce("path", F.array().cast(paths.schema["path"].dataType))), "runs")
    starts = running(runs, [F.col("path")], {"start": ("size", "sum")}, columns=["conv_id", "top", "size"]).select("conv_id", "top", "start")

    placed = tied.join(starts, "conv_id").select(
        *tied.columns,
        (F.col("start") + F.col("depth") - F.col("top")).alias("preorder"),
        F.isnull("n_children").cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving"),
    )
    placed = keep(running(keep(placed, "placed"), [F.col("preorder")], {"ended": ("n_ends", "sum"), "leaves": ("leaf", "sum"), "saved": ("saving", "sum")}), "totals")
    stops = placed.where("n_ends > 0").select(
        (F.col("ended") + F.col("n_ends")).alias("reach"), (F.col("preorder") + 1).alias("subtree_end"), (F.col("leaves") + F.col("leaf")).alias("to_leaves"), (F.col("saved") + F.col("saving")).alias("to_saved")
    )
    found = placed.withColumn("reach", F.col("ended") + F.col("n_convs")).join(stops, "reach")
    found = found.select(
        *NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        (F.col("to_leaves") - F.col("leaves")).alias("n_leaves"), (F.col("to_saved") - F.col("saved")).alias("saved_tokens"), "preorder", "subtree_end",
    )
    ends = seen.where("last = 1").select(*NODE, "conv_id").unionByName(convs.where("n_turns = 0").select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv_id"))
    return found, ends


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of whole conversations; see number_turns for the order of turns and prefix_trie for the columns.

    A node's last turn is turn number `depth` of its conv_id.  Null roles and
    texts are empty, rows without id are left out, repeated rows are turns of
    their own, an empty table has no nodes; other columns are not read.
    """
    turns = keep(number_turns(conversations, id_col, turn_col, role_col, text_col), "numbered")
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns")))


def _cuts(b: pa.RecordBatch) -> list[int]:
    """Where the rows of another node begin, and the number of rows."""
    cut = np.zeros(b.num_rows, bool)
    for name in NODE:
        x = b.column(name).to_numpy()
        cut[1:] |= x[1:] != x[:-1]
    return [0, *np.flatnonzero(cut).tolist(), b.num_rows]


def digest_ends(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """a, b, depth and ends_sha256: SHA-256 of the ids of the conversations that end at a node, in decimal, ascending, comma-joined.

    Ids are joined to texts of at most `chunk` ids over ranges of (node, id), so
    many conversations with one end are spread over tasks; then the texts of a
    node pass through its digest one by one.
    """
    order = [*NODE, "conv_id"]
    fields = "a long, b long, depth long"

    def join(batches):
        for b in batches:
            cuts, ids = _cuts(b), b.column("conv_id").to_pylist()
            parts = [(i, min(i + chunk, stop)) for start, stop in zip(cuts, cuts[1:], strict=False) for i in range(start, stop, chunk)]
            at = pa.array([i for i, _ in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in order), pa.array([",".join(map(str, ids[i:j])) for i, j in parts], pa.string())], names=[*order, "ids"])

    def digest(batches):
        now, sha = None, None
        for b in batches:
            done = []
            for *node, ids in zip(*(b.column(n).to_pylist() for n in [*NODE, "ids"]), strict=True):
                if node == now:
                    sha.update(b"," + ids.encode())
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
            if done:
                yield _digests(done)
        if now:
            yield _digests([(*now, sha.hexdigest())])

    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{fields}, conv_id long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(digest, f"{fields}, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])
