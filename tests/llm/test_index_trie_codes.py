"""Digest index, conversation trie and vector codes against brute force, edge cases included."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kosha.llm import conversation_trie, exact_dedup, vector_codes
from kosha.llm.conversation_queries import rebuild
from kosha.llm.running import running

DOCS = "doc_id long, text string, digest string, row long, keep_id string"
TEXTS = [(1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "a"), (5, "é" * 30000), (6, "é" * 30000), (7, "a "), (None, "b"), (None, "b"), (8, "A")]


def documents(spark, rows):
    """Extra columns clash with names inside the operator."""
    return spark.createDataFrame([(i, t, "d", 7, "k") for i, t in rows], DOCS)


def test_duplicate_groups(spark, tmp_path):
    rows = exact_dedup.duplicate_groups(documents(spark, TEXTS), exact_dedup.DigestIndex(spark, f"file://{tmp_path}/i", 4)).collect()
    assert len(rows) == len(TEXTS)
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.id == r.keep_id
    assert Counter(r.text_sha256 for r in rows if r.kept) == dict.fromkeys(groups, 1)
    empty = exact_dedup.duplicate_groups(documents(spark, []), exact_dedup.DigestIndex(spark, f"file://{tmp_path}/e", 2))
    assert empty.count() == 0 and empty.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"]


def test_index_outlives_sessions_and_batches_repeat(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 3)
    first = documents(spark, TEXTS[:5])
    stay = exact_dedup.deduplicate(first, index, "day-1")
    assert sorted((r.doc_id, r.text or "", r.row) for r in stay.collect()) == [(3, "", 7), (4, "a", 7)]
    other = spark.newSession()
    again = exact_dedup.DigestIndex(other, path, 99)
    assert again.buckets == 3  # an index keeps its own number
    more = other.createDataFrame([(9, "a", "d", 7, "k"), (10, "new", "d", 7, "k"), (11, "new", "d", 7, "k")], DOCS)
    assert [(r.doc_id, r.text) for r in exact_dedup.deduplicate(more, again, "day-2").collect()] == [(11, "new")]
    before = sorted(map(str, again.entries().collect()))
    exact_dedup.deduplicate(more, again, "day-2")
    assert sorted(map(str, again.entries().collect())) == before
    index.refresh()
    assert index.entries().count() == 3
    with pytest.raises(ValueError):
        again.add(exact_dedup.fingerprints(more), "x'; --")


def test_index_side_is_not_shuffled(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/plan", 5)
    index.add(exact_dedup.fingerprints(documents(spark, TEXTS)), "0")
    sizes = exact_dedup.fingerprints(documents(spark, TEXTS)).groupBy("digest").count()
    plan = index.find(sizes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "SelectedBucketsCount: 5 out of 5" in plan
    assert plan.count("hashpartitioning(digest") == plan.split("SortMergeJoin")[1].count("hashpartitioning(digest")


@pytest.mark.parametrize("within", [None, "k"])
def test_running_totals(spark, within):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, -3, 40]), i, rng.randrange(-(2**50), 2**50)) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    got = {(r.k, r.i): (r.s, r.x) for r in running(frame, [frame["i"]], {"s": ("v", "sum"), "x": ("v", "xor")}, within).collect()}
    sums, xors = defaultdict(int), defaultdict(int)
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        g = k if within else 0
        assert got[k, i] == (sums[g], xors[g])
        sums[g] += v
        xors[g] ^= v


def brute_trie(convs):
    """Nodes by first turns: {path: (least member, parent's, members, children, leaves, saved, ends)} of {conv: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if ends[p] else None)
        for p, m in members.items()
    }


def numbered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in convs.items()}


def check_trie(nodes, ends, convs):
    want = brute_trie(convs)
    digests = {tuple(r[:3]): r.ends_sha256 for r in conversation_trie.digest_ends(ends, chunk=3).collect()}
    rows = nodes.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests.get((r.a, r.b, r.depth))) == want[r.conv_id, r.depth]
    assert sorted(r.preorder for r in rows) == list(range(len(rows)))
    by_place = sorted(rows, key=lambda r: r.preorder)
    open_ends = []
    for r in by_place:  # intervals nest, and parents are what is open
        while open_ends and open_ends[-1].subtree_end <= r.preorder:
            open_ends.pop()
        assert len(open_ends) == r.depth and (not open_ends or (open_ends[-1].conv_id == r.parent_conv_id and r.subtree_end <= open_ends[-1].subtree_end))
        open_ends.append(r)


TURNS = "conv_id long, turn long, role string, text string, depth string, a long"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        kind = rng.random()
        n = 90 if kind < 0.05 else rng.randrange(1, 7)
        rows += [(c * 3 - 20, t if rng.random() < 0.95 else None, rng.choice(["user", "bot", None]), "x" if kind < 0.3 else rng.choice(["x", "yé", "", None])) for t in range(n)]
    rows += [rows[0], rows[7], (None, 1, "user", "lost"), (1000, None, None, None), (1001, 5, "user", "z" * 100_000)]
    rows += [(2000 + i, t, "user", "same") for i in range(40) for t in range(4)]
    frame = spark.createDataFrame([(*r, "d", 1) for r in rows], TURNS).repartition(5)
    convs = numbered(rows)
    nodes, ends = conversation_trie.conversation_trie(frame)
    check_trie(nodes, ends, convs)
    turns, lengths = rebuild(conversation_trie.number_turns(frame))
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    check_trie(*conversation_trie.prefix_trie(turns, lengths), new)
    assert any(not t for t in new.values()) or seed != 1


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], TURNS)
    nodes, ends = conversation_trie.conversation_trie(frame)
    assert nodes.count() == 0 and conversation_trie.digest_ends(ends).count() == 0


def brute_codes(rows, parts, entries, rounds):
    """Plain Python integers: {id: (codes, error)} and codebooks."""
    vectors = sorted((i, [math.floor(256 * x) for x in v]) for i, v in rows)
    n = len(vectors[0][1]) // parts
    cut = [[v[p * n : p * n + n] for p in range(parts)] for _, v in vectors]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            near = defaultdict(list)
            for v in cut:
                near[nearest(v[p], books[p])[0]].append(v[p])
            for e, xs in near.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = {i: [nearest(v[p], books[p]) for p in range(parts)] for (i, _), v in zip(vectors, cut, strict=True)}
    return {i: ([e for e, _ in c], sum(d for _, d in c)) for i, c in coded.items()}, books


VECTORS = "vec_id long, embedding array<float>, label int, codes string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "v") for i, v, label in rows], VECTORS)


@pytest.mark.parametrize(("seed", "n", "width"), [(1, 300, 16), (2, 9, 8), (3, 200, 4)])
def test_codes_by_brute_force(spark, seed, n, width):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1).astype(np.float32)  # rounding makes ties
    x[n // 2 :: 7] = x[0]
    good = [(i * 2, [float(c) for c in v], int(i % 3) if i % 5 else None) for i, v in enumerate(x)]
    bad = [(1, None, 1), (3, [None] * width, 1), (5, [float("nan")] * width, None), (7, [float("inf")] + [0.0] * (width - 1), 2), (9, [1.0] * (width - 1), 2), (11, [], 0)]
    frame = vectors(spark, good + bad).repartition(5)
    coded, books = vector_codes.compress(frame, parts=4, entries=16, rounds=2)
    want, want_books = brute_codes([(i, v) for i, v, _ in good], 4, 16, 2)
    assert books.tolist() == want_books
    totals = Counter()
    for i, _, label in good:
        totals[label] += want[i][1]
    rows = coded.collect()
    assert {r.id: (r.codes, r.error) for r in rows} == want and len(rows) == len(good)
    assert all(r.label_error == totals[r.label] for r in rows)


def test_codes_of_few_and_equal_vectors(spark):
    coded, books = vector_codes.compress(vectors(spark, [(1, None, 1)]))
    assert coded.count() == 0 and vector_codes.codebooks_text(books) == ""
    assert vector_codes.compress(vectors(spark, []))[0].count() == 0
    same = [(5, [0.5] * 16, 1), (5, [0.5] * 16, 1), (None, [0.25] * 16, None)]
    rows = vector_codes.compress(vectors(spark, same))[0].collect()
    assert sorted((r.id or 0, r.codes[0], r.error, r.label_error) for r in rows) == [(0, 2, 0, 0), (5, 0, 0, 0), (5, 0, 0, 0)]


def test_distances_are_exact_or_refused():
    big = np.array([[2**27, -(2**27), 2**27, 5]])
    index, distance = vector_codes.nearest(big, np.array([[[-(2**27), 2**27, -(2**27), 0], [2**27, -(2**27), 2**27, 1]]]))
    assert index.tolist() == [[1]] and distance.tolist() == [[16]]
    import pyarrow as pa

    with pytest.raises(ValueError):
        vector_codes._integers(pa.array([[1e30] * 4], pa.list_(pa.float32())), 4)
