"""Exact Jaccard self-join of word n-gram sets with prefix trees.

Texts that are equal share one node.  The n-grams of a set are globally ordered:
those that are frequent in the corpus come last, the most frequent at the end; all
others come first, those of the rarest words at the head, so that unrelated texts
share few of them in a large corpus too.  Two sets of sufficient similarity share
several n-grams among their first ones in that order (their prefixes), so only
prefixes are indexed, once, by a shuffle on the n-gram.

Under an n-gram that few sets index, each set meets the others; a pair that meets
under fewer n-grams than the prefixes guarantee is dropped.  A group of sets that
meets under as many n-grams as that is connected in a line; pairs are counted only
of sets that no such group connects.  Under other n-grams,
sets that meet others under as many n-grams as a link takes, in order of size, meet
the one before where the lengths that remain behind their places allow a link.  Sets that meet, also through others, form a
neighbourhood.  Its texts are brought together once, compressed, and their sets
are stored in a prefix tree,
which is traversed once for all of them: at each node, every set that is still in
the running has the overlap with the path from the root, which all sets below
share, and leaves where the remaining lengths cannot reach the bound.  Links
within one class found already are not made again; the result has every class
that all links would give.

A neighbourhood over a size limit is dealt into parts, twice and differently;
their links give classes, and only n-grams under which several classes meet are
looked at again: sets outside the largest class against all that they meet there.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import broadcast_if_small, keep, slices
from .shingles import shingle_set, shingles, word_hashes

FREQUENT = 1 << 18  # most n-grams that the order puts last; which they are has no bearing on the result
CHUNK_GRAMS = 2_000_000  # n-grams that are counted together in a task
LEAST_COUNT = 2  # count in a chunk from which an n-gram takes part in the order by frequency
CELL_BITS = 20  # words are counted in so many cells (a power of two), by hash
LEAST_WORDS = 4  # count of a cell in a chunk from which it takes part; words of other cells are the rarest
MARGIN = 32  # the prefix of a set of n is longer by n div MARGIN than the shortest one that shows a link
FEW = 16  # sets under an n-gram that all meet each other
UNIT_GRAMS = 500_000  # n-grams of a neighbourhood that one task takes, 8 bytes each
BATCH_GRAMS = 250_000  # n-grams in an Arrow batch on its way out


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())


def _words(batches):
    """(node, hashes of its words) of every text of a task that has words; of equal texts, once."""
    seen = set()
    for b in batches:
        for node, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if node not in seen:
                seen.add(node)
                words = word_hashes(np.frombuffer(t.as_buffer(), dtype=np.uint8))
                if len(words):
                    yield node, words


def _cells(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _quarters(counts: np.ndarray) -> np.ndarray:
    """Four times the binary logarithm, rounded down; 0 for counts under 1."""
    return np.minimum(4 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


def _weighed(words: np.ndarray, width: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text given by its word hashes, sorted, and the sums of their words' weights."""
    s = shingles(words, width)
    each, weight = weights[_cells(words)], np.zeros(len(s), np.uint16)
    for j in range(len(words) - len(s) + 1):
        weight += each[j : j + len(s)]
    by = np.argsort(s)
    s = s[by]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    return s[new], weight[by[new]]


class Order(NamedTuple):
    """The global order of n-grams.

    grams: those that come last, sorted by hash; places: theirs among each other.
    The others are in order of the sum of their words' weights, then of hash;
    weights has one for each cell, in quarters of the count's binary logarithm.
    """

    grams: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    def ordered(self, words: np.ndarray, width: int) -> np.ndarray:
        """The distinct n-grams of a text given by its word hashes, in this order."""
        s, weight = _weighed(words, width, self.weights)
        s = s[np.argsort(weight, kind="stable")]
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
            often = self.grams[at] == s
            if often.any():
                s = np.concatenate((s[~often], s[often][np.argsort(self.places[at[often]])]))
        return s


def frequent_grams(docs: DataFrame, text_col: str, width: int, most: int = FREQUENT) -> Order:
    """The global order: which n-grams come last, and how frequent words are.

    All texts are counted, chunk by chunk; counts of LEAST_COUNT and more in a
    chunk are summed, and the `most` n-grams with the largest sums are taken.
    Words are counted likewise, by cell.
    """

    def rows(keys, counts, least, word):
        often = counts >= least
        return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often]), pa.array(np.full(often.sum(), word))], names=["key", "c", "word"])

    def counted(held):
        words = np.concatenate(held)
        cells = np.bincount(_cells(words), minlength=1 << CELL_BITS)
        grams, counts = np.unique(np.concatenate([np.unique(shingles(w, width)) for w in held]), return_counts=True)
        yield rows(grams, counts, LEAST_COUNT, False)
        yield rows(np.arange(1 << CELL_BITS), cells, LEAST_WORDS, True)

    def run(batches):
        held, n = [], 0
        for _, words in _words(batches):
            held.append(words)
            n += len(words)
            if n >= CHUNK_GRAMS:
                yield from counted(held)
                held, n = [], 0
        if held:
            yield from counted(held)

    sums = keep(_texts(docs, text_col).mapInArrow(run, "key long, c long, word boolean").groupBy("word", "key").agg(F.sum("c").alias("c")), "counts")
    got = sums.where("NOT word").orderBy(F.desc("c"), "key").limit(most).select("key").toArrow()
    grams = got.column("key").to_numpy().view(np.uint64)
    by_hash = np.argsort(grams)
    cells, weights = sums.where("word").select("key", "c").toArrow(), np.zeros(1 << CELL_BITS, np.uint8)
    weights[cells.column("key").to_numpy()] = _quarters(cells.column("c").to_numpy())
    return Order(grams[by_hash], (len(grams) - by_hash).astype(np.int64), weights)


def prefix_entries(docs: DataFrame, text_col: str, width: int, percent: int, order: Order) -> DataFrame:
    """(token, node, n, place): the prefix of every set in the global order; place counts from 0, n is the size of the set."""

    def batch(nodes, ns, tokens):
        sizes = [len(x) for x in tokens]
        columns = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(nodes, np.int64), sizes), np.repeat(np.array(ns, np.int32), sizes), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "place"])

    def run(batches):
        nodes, ns, tokens, held = [], [], [], 0
        for node, words in _words(batches):
            s = order.ordered(words, width)
            n = len(s)
            nodes.append(node)
            ns.append(n)
            tokens.append(s[: n - (n * percent + 99) // 100 + 1 + n // MARGIN])
            held += len(tokens[-1])
            if held >= BATCH_GRAMS:
                yield batch(nodes, ns, tokens)
                nodes, ns, tokens, held = [], [], [], 0
        if nodes:
            yield batch(nodes, ns, tokens)

    return _texts(docs, text_col).mapInArrow(run, "token long, node long, n int, place int")


def meetings(entries: DataFrame, percent: int, few: int = FEW) -> DataFrame:
    """Entries under n-grams that several nodes index: token, node, n, place, many (over `few` nodes) and all.

    all: of an n-gram of few nodes, these as (n, node) in order, in the row of the last one.
    """
    rows = entries.repartition("token").groupBy("token", "node").agg(F.first("n").alias("n"), F.first("place").alias("place"))
    order = W.partitionBy("token").orderBy("n", "node")
    k = F.count(F.lit(1)).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.select("token", "node", "n", "place", k.alias("k"), F.collect_list(F.struct("n", "node")).over(order.rowsBetween(1 - few, 0)).alias("all"), F.row_number().over(order).alias("i")).where("k > 1")
    return rows.select("token", "node", "n", "place", (F.col("k") > few).alias("many"), F.when(F.expr(f"i = k AND k <= {few}"), F.col("all")).alias("all"))


def chains(met: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) under n-grams of many nodes, over which every link of two sets that meet there is connected.

    A node and its partner share one n-gram more than the smaller size div
    MARGIN, so a node that meets others under fewer has no links and stands in
    no chain; a text that has one n-gram of a large class by chance stays out.
    The others, in order of size, meet the one in front if the places within
    the shortest prefixes allow links across.
    """
    able = met.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.max("many").alias("m")).where(f"m AND c >= 1 + n * {percent}L div {100 * MARGIN}")
    rows = met.where("many").join(able.select("node"), "node", "left_semi").where(f"place <= n - (n * {percent}L + 99) div 100")
    # An n-gram at this place, if it is the first of an overlap, leaves room for links with sizes up to this.
    rows = rows.withColumn("reach", F.expr(f"(n - place) * {100 + percent}L div {percent} - n"))
    order = W.partitionBy("token").orderBy("n", "node")
    reached = F.max("reach").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select(F.col("node").alias("a"), F.lag("node").over(order).alias("b"), (F.col("n") <= reached).alias("near"))
    return rows.where("near").select("a", "b").distinct()


def _groups(met: DataFrame) -> DataFrame:
    """Distinct groups of nodes that meet under n-grams of few: all, c (how many n-grams) and sure.

    sure: c is what a link of any two takes, so each pair of them is an edge.
    """
    groups = met.where("all is not null").groupBy("all").agg(F.count(F.lit(1)).alias("c"))
    return groups.withColumn("sure", F.expr(f"c >= 1 + element_at(all, -1).n div {MARGIN}"))


def _in_line(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of sure groups: neighbours in order of size, over which all pairs whose sizes allow a link are connected."""
    steps = F.arrays_zip(F.expr("slice(all, 1, size(all) - 1)").alias("x"), F.expr("slice(all, 2, size(all) - 1)").alias("y"))
    steps = groups.where("sure").select(F.explode(steps).alias("s")).where(f"s.x.n * 100L >= s.y.n * {percent}L")
    return steps.select(F.col("s.x.node").alias("a"), F.col("s.y.node").alias("b"))


def _pairs_across(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different classes that meet, how many n-grams they share, and the smaller size n.

    Groups within one class are left out before pairs are made.
    """
    rows = groups.where("NOT sure").select(F.xxhash64("all").alias("id"), "c", F.explode("all").alias("x")).select("id", "c", "x.n", "x.node")
    rows = rows.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.groupBy("id").agg(F.first("c").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"), F.collect_list(F.struct("n", "node", "root")).alias("all")).where("low <> high")
    rows = rows.select("c", "all", F.explode("all").alias("y"))
    rows = rows.select("c", "y", F.explode(F.filter("all", lambda x: (x["root"] != F.col("y.root")) & (F.struct(x["n"], x["node"]) < F.struct("y.n", "y.node")) & (x["n"] * 100 >= F.col("y.n") * percent))).alias("x"))
    rows = rows.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), "c", F.col("x.n").alias("n"))
    return rows.groupBy("a", "b").agg(F.sum("c").alias("shared"), F.first("n").alias("n"))


def candidate_edges(met: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) over which every link of two sets is connected.

    A pair that is linked shares one n-gram more than the smaller size div MARGIN
    among the prefixes.  It met under those of few nodes; of those of many nodes it
    shares at most as many as either of the two has.  Near copies meet in the
    same groups under most n-grams, so groups are counted first, and pairs are
    made only of nodes that groups met often enough don't connect.
    """
    groups = keep(_groups(met), "groups")
    sure = keep(_in_line(groups, percent), "sure")
    pairs = keep(_pairs_across(groups, components(sure), percent), "pairs")
    lacking = pairs.where(f"shared < 1 + n div {MARGIN}")
    often = met.where("many").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    often_a, often_b = (often.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    saved = lacking.join(often_a, "a").join(often_b, "b").where(f"shared + least(ca, cb) >= 1 + n div {MARGIN}")
    return sure.unionByName(pairs.where(f"shared >= 1 + n div {MARGIN}").select("a", "b")).unionByName(saved.select("a", "b")).unionByName(chains(met, percent))


def packed_texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """node, its text compressed (binary) and the text's length in bytes, of the wanted nodes; far smaller than their sets."""

    def run(batches):
        codec, seen = pa.Codec("zstd", compression_level=3), set()
        for b in slices(batches):
            nodes, packed, sizes = [], [], []
            for node, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if node not in seen:
                    seen.add(node)
                    raw = t.as_buffer()
                    nodes.append(node)
                    packed.append(codec.compress(raw, asbytes=True))
                    sizes.append(raw.size)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], names=["node", "packed", "bytes"])

    texts = _texts(docs, text_col).join(broadcast_if_small(wanted.select("node").distinct(), 1_000_000), "node", "left_semi")
    return texts.mapInArrow(run, "node long, packed binary, bytes long").groupBy("node").agg(F.first("packed").alias("packed"), F.first("bytes").alias("bytes"))


def _unpacked(table: pa.Table, width: int) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    return [shingle_set(np.frombuffer(codec.decompress(x.as_buffer(), n), np.uint8), width) for x, n in zip(table.column("packed"), table.column("bytes").to_pylist(), strict=True)]


class _Classes:
    """Classes of members 0 to k - 1, merged the smaller into the larger."""

    def __init__(self, k: int):
        self.of, self.members, self.version = np.arange(k), [[i] for i in range(k)], 0

    def merge(self, a: int, b: int) -> bool:
        a, b = self.of[a], self.of[b]
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        self.version += 1
        return True


def linked_pairs(sets: list[np.ndarray], percent: int, stored: np.ndarray | None = None, walking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places in `sets` whose links give the classes of all; where told apart, of stored sets with walking ones.

    Sets are arrays of distinct integers.  Stored sets, ordered rarest n-gram
    first and without n-grams that only one set has, are the paths of a prefix
    tree.  A walking set enters it under the first n-gram that it shares with a
    path, if both have it in their prefixes, and keeps its overlap with the path
    on the way down.
    """
    k, size = len(sets), np.array([len(s) for s in sets])
    if k < 2:
        return []
    flat, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(flat), dtype=np.int32)
    shared = counts[number] > 1
    owner = np.repeat(np.arange(k, dtype=np.int32), size)[shared]
    number = rank[number[shared]]
    number, length = number[np.lexsort((number, owner))], np.bincount(owner, minlength=k)
    del flat, counts, rank, shared
    ends = np.cumsum(length)
    paths = [number[e - n : e] for e, n in zip(ends, length, strict=True)]
    prefix = length - (size * percent + 99) // 100 + 1  # of each path; not positive: no link is possible
    # From here on sets are numbered in the order of their paths, so those below a tree node are neighbours.
    order = sorted(np.flatnonzero(prefix > 0).tolist(), key=lambda i: paths[i].astype(">u4").tobytes())
    if len(order) < 2:
        return []
    paths, size, length, prefix = [paths[i] for i in order], size[order], length[order], prefix[order]
    k, both = len(order), stored is None
    walks = np.ones(k, bool) if both else walking[order]
    stays = np.ones(k, bool) if both else stored[order]
    starts = np.cumsum(length) - length
    number, owner = np.concatenate(paths), np.repeat(np.arange(k, dtype=np.int32), length)
    span = int(number.max()) + 1
    keys = owner.astype(np.int64) * span + number  # ascending: of any set, how many n-grams up to a given one
    by_gram = np.argsort(number, kind="stable")
    first = np.searchsorted(number[by_gram], np.arange(span + 1))
    holders = owner[by_gram]
    begins = (np.arange(len(number)) - starts[owner] < prefix[owner]) & walks[owner]
    begin_gram = np.argsort(np.where(begins, number, span), kind="stable")[: begins.sum()]
    begin_first, beginners = np.searchsorted(number[begin_gram], np.arange(span + 1)), owner[begin_gram]
    same = np.zeros(k + 1, np.int64)  # n-grams that a path has in common with the path before
    for i in range(1, k):
        m = min(length[i - 1], length[i])
        differ = np.flatnonzero(paths[i - 1][:m] != paths[i][:m])
        same[i] = differ[0] if len(differ) else m
    classes, out = _Classes(k), []

    def gather(run, bounds, values):
        low, count = bounds[run], bounds[run + 1] - bounds[run]
        total = int(count.sum())
        return values[np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)] if total else values[:0]

    del number, owner, begins, begin_gram, by_gram
    none = np.zeros(0, np.int64)
    stack = [(0, k, 0, none, none)]
    while stack:
        low, high, depth, active, common = stack.pop()
        below = slice(low, high)
        if not stays[below].any():
            continue
        kind = classes.of[low] if (classes.of[below] == classes.of[low]).all() else -1
        if kind >= 0:
            if len(classes.members[kind]) == k:
                continue
            other = classes.of[active] != kind
            active, common = active[other], common[other]
        bottom = int(same[low + 1 : high].min()) if high - low > 1 else int(length[low])
        run = paths[low][depth:bottom]
        if len(run):
            fresh = gather(run[: max(0, int(prefix[below].max()) - depth)], begin_first, beginners)
            if len(fresh):
                fresh = fresh[(classes.of[fresh] != kind) & ((fresh > low) | (not both))]
                fresh = np.setdiff1d(fresh, active)
                if len(fresh):
                    merged = np.concatenate((active, fresh))
                    by = np.argsort(merged)
                    active, common = merged[by], np.concatenate((common, np.zeros(len(fresh), np.int64)))[by]
            if not len(active):
                if kind >= 0 and bottom >= prefix[below].max():
                    continue
            elif len(active) * len(run) * 4 < int((first[run + 1] - first[run]).sum()):
                wanted = (active[:, None] * span + run).ravel()
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                common = common + (keys[at] == wanted).reshape(len(active), -1).sum(1)
            else:
                who = gather(run, first, holders)
                at = np.minimum(np.searchsorted(active, who), len(active) - 1)
                common = common + np.bincount(at[active[at] == who], minlength=len(active))
            if len(active):
                rest = starts[active] + length[active] - np.searchsorted(keys, active * span + run[-1], side="right")
                fewest = np.maximum(size[below].min(), (size[active] * percent + 99) // 100)
                room = common + np.minimum(rest, int(length[below].max()) - bottom)
                fits = ((100 + percent) * room >= percent * (size[active] + fewest)) & (100 * size[below].max() >= percent * size[active])
                active, common = active[fits], common[fits]
        if not len(active) and bottom >= prefix[below].max():
            continue
        at = low + int(np.searchsorted(length[below] > bottom, True)) if high - low > 1 else high  # sets that end here come first
        ended = np.flatnonzero(stays[low:at]) + low
        for n in np.unique(size[ended]) if len(active) and len(classes.members[classes.of[low]]) < k else ():
            near = active[(100 + percent) * common >= percent * (size[active] + n)]
            group = ended[size[ended] == n]
            for w in near[classes.of[near] != classes.of[group[0]]]:
                if w != group[0] and classes.merge(group[0], w):
                    out.append((order[group[0]], order[int(w)]))
            for other in group[1:]:  # all of `near` are in one class by now
                w = near[0] if len(near) and near[0] != other else near[-1] if len(near) else other
                if w != other and classes.merge(other, w):
                    out.append((order[other], order[int(w)]))
        if at < high:
            cuts = [at, *(np.flatnonzero(same[at + 1 : high] == bottom) + at + 1).tolist(), high]
            stack.extend((a, b, bottom, active, common) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    return out


def _unit_links(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Links (a, b) of one unit: of side 0 within it, of sides 1 and 2 between them."""
    nodes, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    pairs = linked_pairs(_unpacked(table, width), percent, *(() if not side.any() else (side == 1, side == 2)))
    at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(nodes[at[:, 0]], pa.int64()), "b": pa.array(nodes[at[:, 1]], pa.int64())})


def _links(units: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of units (unit, i, j, side, node); their sets are made of the texts where they meet."""
    ready = units.join(texts, "node")
    return ready.groupBy("unit", "i", "j").applyInArrow(lambda t: _unit_links(t, width, percent), "a long, b long")


def tree_links(met: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int, most: int = UNIT_GRAMS) -> DataFrame:
    """Links (a, b) that give the classes of all sets that meet.

    A neighbourhood whose sets have at most `most` n-grams together is one unit;
    for a larger one see _cut_links.
    """
    near = keep(components(candidate_edges(met, percent)), "neighbourhoods")
    members = keep(near.join(met.groupBy("node").agg(F.first("n").alias("n")), "node"), "neighbours")
    large = keep(members.groupBy("root").agg(F.sum("n").alias("grams")).where(F.col("grams") > most), "large")
    one = members.join(broadcast_if_small(large), "root", "left_anti").select(F.col("root").alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node")
    links = keep(_links(one, packed_texts(docs, text_col, one), width, percent), "links")
    if large.isEmpty():
        return links
    rest = members.join(broadcast_if_small(large), "root")
    return links.unionByName(_cut_links(rest, met, keep(packed_texts(docs, text_col, rest), "large-texts"), width, percent, most))


def _cut_links(members: DataFrame, met: DataFrame, texts: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """Links of large neighbourhoods (node, root, n, grams), in units of about `most` n-grams on each side.

    Two dealings into parts give most classes.  Then, under each n-gram where
    several classes meet, the nodes outside the largest class of the
    neighbourhood are stored, in parts of one band of sizes, and all nodes there
    of the same or the next band walk.
    """
    members = keep(members.withColumn("band", F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")), "large-members")
    links = None
    for turn in range(2):
        part = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("grams") / most)).cast("int")
        dealt = members.select(F.col("root").alias("unit"), part.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node")
        got = keep(_links(dealt, texts, width, percent), "part-links")
        links = got if links is None else links.unionByName(got)
    classes = keep(components(links), "part-classes").withColumnRenamed("root", "class")
    members = keep(members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "classed-members")
    sizes = members.groupBy("root", "class").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("root").agg(F.max_by("class", F.struct("k", "class")).alias("main"))
    rows = met.select("token", "node").join(members, "node")
    mixed = rows.groupBy("token", "root").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("token", "root")
    rows = keep(rows.join(mixed, ["token", "root"]).join(broadcast_if_small(main), "root").select("token", "root", "node", "n", "band", (F.col("class") != F.col("main")).alias("apart")), "mixed")
    outside = rows.where("apart").select("root", "band", "node", "n").distinct()
    parts = outside.groupBy("root", "band").agg(F.ceil(F.sum("n") / most).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    store = keep(outside.join(broadcast_if_small(parts), ["root", "band"]).select("root", "band", part.alias("i"), "node"), "stored")
    under = rows.join(store.select("node", F.col("band").alias("its"), "i"), "node").select("token", "root", "its", "i").distinct()
    walk = rows.join(under, ["token", "root"]).where("abs(band - its) <= 1").select("root", F.col("its").alias("band"), "i", "node", "n").distinct()
    walk = keep(walk, "walking")
    parts = walk.groupBy("root", "band", "i").agg(F.ceil(F.sum("n") / most).cast("int").alias("walks"))
    unit = F.xxhash64("root", "band").alias("unit")
    walk = walk.join(broadcast_if_small(parts), ["root", "band", "i"]).select(unit, "i", F.pmod(F.xxhash64("node"), F.col("walks")).cast("int").alias("j"), F.lit(2).alias("side"), "node")
    store = store.join(parts, ["root", "band", "i"]).select(unit, "i", F.explode(F.sequence(F.lit(0), F.col("walks") - 1)).alias("j"), F.lit(1).alias("side"), "node")
    return links.unionByName(_links(store.unionByName(walk), texts, width, percent))


def similar_classes(docs: DataFrame, text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(node, root) of all distinct texts in a class of several.

    Sets of size n and m with c n-grams in common are linked if
    100 * c >= percent * (n + m - c).
    """
    entries = prefix_entries(docs, text_col, width, percent, frequent_grams(docs, text_col, width))
    met = keep(meetings(entries, percent), "met")
    return keep(components(keep(tree_links(met, docs, text_col, width, percent), "all-links")), "classes")


def _set_sizes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, node (hash of the text) and n (size of its set) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("t"))
    schema = T.StructType([rows.schema["id"], rows.schema["node"], T.StructField("n", T.LongType(), False)])

    def run(batches):
        for b in batches:
            n = [len(shingle_set(np.frombuffer(t.as_buffer(), dtype=np.uint8), width)) if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs: id_col, n_shingles and component_id, the least id reachable by links, itself included.

    The set of a text is its distinct shingles of `width` words after A-Z are
    lower-cased; with fewer words, the whole sequence as one; null texts and
    texts without words have an empty set and link with nothing.  Equal texts
    link with each other.  Rows with equal ids keep one row each; null ids stay
    and never name a class that has another id.  Texts and shingles are compared
    by 64-bit hashes.  An empty table gives an empty result; other columns play
    no part.
    """
    rows = _set_sizes(docs, id_col, text_col, width)
    rows = _classed(rows.select("id", "node", "n", (F.col("n") > 0).alias("words")), similar_classes(docs, text_col, width, percent))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with root (null without words) and least (id of the class, null for classes of one row)."""
    rows = keep(rows.join(classes, "node", "left").withColumn("root", F.when(F.col("words"), F.coalesce("root", "node"))), "rows")
    least = rows.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select("r", "least")
    return rows.join(least, F.col("root") == F.col("r"), "left")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each class of similar texts: that with the least id; all columns stay.

    Null ids come last.  Of rows that repeat both id and text one stays; texts
    without words belong to no class, and all their rows stay.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"), F.coalesce(F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("words"))
    rows = _classed(rows, similar_classes(docs, text_col, width, percent))
    last = F.struct(F.col("id").isNull().alias("u"), F.col("id").alias("id"), F.col("node").alias("node"))
    best = rows.where("root is not null").groupBy("root").agg(F.min(last).alias("b")).select(F.col("b.id").alias("__id"), F.col("b.node").alias("__node"))
    loose = rows.where("root is null").select(F.col("id").alias("__id"), F.col("node").alias("__node")).distinct()
    stay = broadcast_if_small(keep(best.unionByName(loose), "stay"), 1_000_000)
    chosen = docs.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__node")), "left_semi")
    twice = rows.where("root is not null").groupBy(F.col("id").alias("__id"), F.col("node").alias("__node")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    twice = keep(twice, "repeated")
    if twice.isEmpty():
        return chosen
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__node"))
    return chosen.join(twice, same, "left_anti").unionByName(chosen.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
