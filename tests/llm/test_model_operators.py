"""N-gram join, BPE, token shards, language and quality models against brute force, the library, round trips and held-out accuracy."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kosha.llm import bpe, components, jaccard, language, quality_model, shared, token_output
from kosha.llm.bpe_queries import vocabulary

SCHEMA = "doc_id long, text string, n long, tokens string"


def docs(spark, rows):
    """Extra columns n and tokens clash with names inside the operators."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def gram_set(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_classes(rows, width, percent):
    sets = [gram_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in inverted[g])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
        for g in s:
            inverted[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n):
    """Copies, near copies with few or many edits, shared passages, and short texts."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("aeiou") + str(r.randrange(60))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5 and rows:
            w = (r.choice(rows)[1] or "").split()
            for _ in range(r.choice((0, 1, 1, 2, 4, 9))):
                if w:
                    k = r.randrange(len(w))
                    w[k : k + r.choice((0, 1))] = [word()] * r.choice((0, 1))
        elif kind < 0.75:
            w = passage + [word() for _ in range(r.choice((0, 2, 4, 6, 30)))]
        else:
            w = [word() for _ in range(r.choice((1, 3, 4, 5, 20, 90, 300)))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_classes(spark, seed, width, percent):
    rows = [*corpus(seed, 350), (900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (3, corpus(seed, 5)[3][1]), (None, "lonely text with no id here at all"), (None, corpus(seed, 2)[1][1])]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs(spark, rows), width=width, percent=percent).collect()), key=str)
    assert got == brute_classes(rows, width, percent)
    kept = jaccard.keep_one_of_each(docs(spark, rows), width=width, percent=percent)
    assert kept.columns == ["doc_id", "text", "n", "tokens"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted({i for i in ids if i is not None}) == sorted({c for d, _, c in got if d == c and d is not None}) and ids.count(None) == sum(d is None and c is None for d, _, c in got)


def test_cut_neighbourhoods_give_the_same_classes(spark):
    """With neighbourhoods cut at 60 or 400 n-grams, and with few nodes or many meeting under each n-gram, the classes don't change."""
    rows = corpus(7, 200)
    frame = docs(spark, rows)
    entries = shared.keep(jaccard.prefix_entries(frame, "text", 4, 85, jaccard.frequent_grams(frame, "text", 4)))
    met = {few: shared.keep(jaccard.meetings(entries, 85, few)) for few in (2, 16)}
    classes = [{r.node: r.root for r in components.components(jaccard.tree_links(met[few], frame, "text", 4, 85, most)).collect()} for few, most in ((16, 10**9), (16, 400), (2, 60))]
    assert classes[0] == classes[1] == classes[2] and classes[0]


def test_unrelated_texts_share_no_prefix(spark):
    """Texts of frequent words and a few words of their own, in a corpus with more n-grams than the order by frequency takes: none meets another."""
    r = random.Random(3)
    frame = docs(spark, [(i, " ".join(r.choice("abcdefgh") if r.random() < 0.85 else f"w{r.randrange(10**9)}" for _ in range(80))) for i in range(300)])
    entries = jaccard.prefix_entries(frame, "text", 4, 85, jaccard.frequent_grams(frame, "text", 4, 0))
    assert jaccard.meetings(entries, 85).count() == 0


def test_chance_meetings_chain_no_classes(spark):
    """Texts that have one n-gram of a class of many by chance don't join it; one that has as many as a link takes does."""
    rows = [(t, node, 320, t) for node in range(20) for t in range(30)] + [(t, 50, 320, t) for t in range(9)]
    rows += [(t if t == 5 else 1000 * node + t, node, 320, t) for node in range(100, 140) for t in range(30)]
    met = shared.keep(jaccard.meetings(spark.createDataFrame(rows, "token long, node long, n int, place int"), 85))
    edges = met.sparkSession.createDataFrame(jaccard.candidate_edges(met, 85).collect(), "a long, b long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {node: 0 for node in (*range(20), 50)}


def test_near_copies_take_little_room(spark):
    """Sixteen near copies are connected in a line, not by 120 pairs; a group that meets under too few n-grams not at all; texts travel packed."""
    rows = [(100 * c + t, 100 * c + node, 320, t) for c in range(5) for node in range(16) for t in range(30)]
    rows += [(9000 + t, 900 + node, 320, t) for node in range(3) for t in range(10)] + [(9100 + t, 910 + node, 320, t) for node in range(2) for t in range(11)]
    met = shared.keep(jaccard.meetings(spark.createDataFrame(rows, "token long, node long, n int, place int"), 85))
    edges = jaccard.candidate_edges(met, 85).collect()
    assert len(edges) == 5 * 15 + 1
    assert {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {**{100 * c + node: 100 * c for c in range(5) for node in range(16)}, 910: 910, 911: 910}
    texts = [t for _, t in corpus(11, 60) if len(t.split()) > 80]
    frame = docs(spark, list(enumerate(texts)))
    packed = jaccard.packed_texts(frame, "text", frame.select(F.xxhash64("text").alias("node"))).toArrow()
    assert sorted(map(len, jaccard._unpacked(packed, 4))) == sorted(len(gram_set(t, 4)) for t in set(texts))
    assert sum(map(len, packed.column("packed").to_pylist())) < 4 * sum(len(gram_set(t, 4)) for t in set(texts))


def test_linked_pairs_by_brute_force():
    r = random.Random(5)
    for _ in range(200):
        sets, universe, percent = [], r.choice((20, 60, 400)), r.choice((50, 80, 85, 95, 100))
        for _ in range(r.randrange(1, 40)):
            if sets and r.random() < 0.6:
                s = set(r.choice(sets))
                for _ in range(r.choice((0, 1, 1, 2, 3, 8))):
                    s -= {r.choice(sorted(s))} if len(s) > 1 and r.random() < 0.5 else set()
                    s |= {r.randrange(universe)}
            else:
                s = {r.randrange(universe) for _ in range(r.choice((1, 2, 5, 15, 40)))}
            sets.append(s)
        k, stored = len(sets), np.array([r.random() < 0.4 for _ in sets])
        similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
        for apart in (False, True):
            up = components.Forest()
            for i in range(k):
                for j in range(i):
                    if similar(i, j) and (not apart or stored[i] != stored[j]):
                        up.join(i, j)
            got = components.Forest()
            for i, j in jaccard.linked_pairs([np.array(sorted(s), dtype=np.uint64) for s in sets], percent, *((stored, ~stored) if apart else ())):
                assert similar(i, j)
                got.join(i, j)
            assert [up.find(i) for i in range(k)] == [got.find(i) for i in range(k)]


def test_tree_takes_time_in_proportion():
    """Four times the sets take far less than sixteen times the time: unrelated sets, and near copies of one."""
    r = np.random.default_rng(1)

    def near():
        s, j = np.arange(100), r.integers(0, 97)
        s[j : j + 4] = r.integers(1000, 2**40, 4)
        return np.unique(s).astype(np.uint64)

    for kind in (lambda k: np.unique(r.integers(0, 3 * k, 10)).astype(np.uint64), lambda k: near()):
        took = []
        for k in (2000, 8000):
            sets = [kind(k) for _ in range(k)]
            began = time.process_time()
            jaccard.linked_pairs(sets, 85)
            took.append(time.process_time() - began)
        assert took[1] < 9 * took[0] + 0.5


def test_jaccard_empty(spark):
    assert jaccard.jaccard_classes(docs(spark, [(1, "x")]).where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7), (7, 8)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100}


TEXTS = ["", None, "Hello, wörld's  12", "a<|endoftext|>B<|startoftext|>", "ΑΣ Σ ﬁ İ", "it'll I'M 日本語", " \n\t ", "é é", "🙂🙃!!??", "x" * 30000, "a\u0000b", "foo " * 20000, "<|endoftext", "À̖b"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary()
    library = Tokenizer.from_file(path)
    frame = docs(spark, [*enumerate(TEXTS), (2, TEXTS[2])])
    rows = bpe.decode_ids(bpe.encode_texts(frame, path, ids_col="tokens"), path, ids_col="tokens").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.tokens) == want, TEXTS[r.doc_id]
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_texts(frame.where("false"), path).count() == 0


def test_forced_cuts_are_safe():
    codec = bpe.load(vocabulary())
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choice(list(codec.symbols.values())) for _ in range(r.randrange(1, 12)))
        fragments = codec.cut(word)
        assert "".join(fragments) == word
        assert codec.merge(word, True) == [i for k, f in enumerate(fragments) for i in codec.merge(f, k == len(fragments) - 1)]


def test_permutation():
    for n in (1, 2, 3, 10, 997, 5000):
        for key in (0, 7):
            p = token_output.permute(np.arange(n), n, key)
            assert sorted(p) == list(range(n)) and (token_output.invert(p, n, key) == np.arange(n)).all()


def test_token_shards(spark):
    path, folder = vocabulary(), shared.scratch(spark) + "/shards"
    texts = ["one two three", None, "", "one two three", "four " * 700, "é"]
    frame = docs(spark, enumerate(texts))
    n = token_output.write_shards(frame, path, folder, length=16, per_shard=10)
    index = token_output.read_index(folder)
    rows = token_output.read_slots(spark, folder).collect()
    assert sorted(r.slot for r in rows) == list(range(n)) and all(r.shard == r.slot // 10 and r.byte_offset == r.slot % 10 * 32 for r in rows)
    stream = np.concatenate([np.frombuffer(r.tokens, "<u2") for r in sorted(rows, key=lambda r: r.sequence)])
    codec = bpe.load(path)
    end = codec.special[token_output.END]
    assert (stream[index["tokens"] :] == end).all()
    found, at = Counter(), 0
    for e in np.flatnonzero(stream[: index["tokens"]] == end):
        found[tuple(stream[at:e].tolist())] += 1
        at = e + 1
    assert found == Counter(tuple(codec.encode(t or "").tolist()) for t in texts)
    assert [r.slot for r in token_output.read_slots(spark, folder, first=n - 3).collect()] == [n - 3, n - 2, n - 1]
    assert token_output.write_shards(frame, path, folder, length=16, per_shard=10) == n  # what stands is left
    for other in ({"key": 2}, {"length": 8}, {"per_shard": 9}):
        with pytest.raises(ValueError, match=next(iter(other))):
            token_output.write_shards(frame, path, folder, **{"length": 16, "per_shard": 10} | other)
    with pytest.raises(ValueError, match="stream"):
        token_output.write_shards(frame.where("doc_id <> 5"), path, folder, length=16, per_shard=10)
    empty = shared.scratch(spark) + "/none"
    assert token_output.write_shards(frame.where("false"), path, empty) == 0 and token_output.read_slots(spark, empty).count() == 0


def test_shards_resume(spark):
    """A write that was stopped midway goes on: shards in full stay, the others are written again, with equal bytes."""
    from pathlib import Path

    folder = shared.scratch(spark) + "/shards"
    frame = docs(spark, enumerate(["some words " * (k % 50) for k in range(300)]))
    token_output.write_shards(frame, vocabulary(), folder, length=16, per_shard=10)
    files = sorted(Path(folder.removeprefix("file://")).glob("shard-*.bin"))
    before = {f.name: f.read_bytes() for f in files}
    assert len(files) > 20
    for f in files[3:]:  # as if the job had ended here: one shard half written, the rest not there, one written in full and not to be touched
        f.unlink()
    files[2].write_bytes(before[files[2].name][:100])
    files[0].write_bytes(bytes(len(before[files[0].name])))
    token_output.write_shards(frame, vocabulary(), folder, length=16, per_shard=10)
    after = {f.name: f.read_bytes() for f in files}
    assert after[files[0].name] == bytes(len(before[files[0].name])) and all(after[f.name] == before[f.name] for f in files[1:])


def test_bpe_of_every_code_point():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(vocabulary()), bpe.load(vocabulary())
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(texts), 20_000):
        some = texts[low : low + 20_000]
        want = library.encode_batch(some, add_special_tokens=False)
        assert [x.tolist() for x in codec.encode_many(some)] == [x.ids for x in want]


def test_language_vote_by_brute_force():
    r = np.random.default_rng(2)
    langs = ["de", "en", "nl", "es", "fr", "ja"]
    x = r.normal(size=(240, language.SIZE)).astype(np.float32)
    model = language.fit(x, np.array(langs)[r.integers(0, 6, 240)])
    found, scores = model.predict(x)
    for v, a, s in zip(x, found, scores):
        v = np.append(v, 1.0)
        margins = [float(m @ v) for m in model.family_machines]
        group = model.families[max(range(len(margins)), key=margins.__getitem__)]
        votes, sums = Counter(), Counter()
        for (p, q), m in model.pair_machines.items():
            if p in group and q in group:
                votes[p if m @ v > 0 else q] += 1
                sums[p] += float(m @ v)
                sums[q] -= float(m @ v)
        assert a == max(group, key=lambda g: (votes[g], sums[g])) and 0 <= s <= 1


def test_quality_score_is_a_sum_of_tables():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 5))
    model = quality_model.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    assert len(model.pairs) == quality_model.PAIRS
    for v, s in zip(x[:60], model.score(x[:60])):
        total = model.intercept
        for j, (edges, table) in enumerate(zip(model.edges, model.tables)):
            total += table[sum(e < v[j] for e in edges)]
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[sum(e < v[i] for e in model.pair_edges[i])][sum(e < v[j] for e in model.pair_edges[j])]
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_model_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_model.score_documents(d, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert right > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_quality_model_edges(spark):
    frame = docs(spark, [(1, None), (2, ""), (2, ""), (None, "some text"), (3, "x " * 40000)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    assert quality_model.score_documents(frame, labels).count() == 5
    assert quality_model.score_documents(frame, labels.where("false")).count() == 5
    assert quality_model.score_documents(frame.where("false"), labels).count() == 0
    assert quality_model.filter_documents(frame, labels).columns == frame.columns


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    rows = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "12 34 !", "en"), (3, "", "fr"), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (8, "the the", None), (8, "the the", None), (None, "le chat", "xx")]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.identify(frame).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.identify(frame.where("lang is null")).where("lang_pred <> 'und'").count() == 0
    assert language.identify(frame.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    rows = out.collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows) and all(r.n_tokens == len(r.ids) for r in rows)


def test_pipeline_edges(spark, tmp_path):
    """Null and empty texts, null and repeated ids, extra columns and empty tables pass through all stages."""
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1"), "doc_id").first()
    rows = [(1, None), (None, None), (2, ""), (None, good.text), (3, good.text), (3, good.text), (4, good.text + " a few more words")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, hits string"
    spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert out.count(3) == 1 and 4 not in out
    (tmp_path / "none").mkdir()
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_quality_and_tokens(spark):
    """Stage one drops planted junk and keeps prose; stage five gives the library's ids."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in p.quality(spark, frame, sf).select("doc_id").collect()}
    assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.97
    library = Tokenizer.from_file(vocabulary())
    some = frame.where("doc_id < 40")
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    for r in p.token_ids(spark, some, sf).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_pipeline_stages(spark):
    """The second to fourth stages take effect on planted cases and leave the rest alone."""
    import corpus_pipeline as p

    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 150").first().text
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, body(1)), (2, body(1) + " end"), (3, body(3)), (4, body(4) + " " + item), (5, body(5) + " password=abcdef99 z")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame = p.near_duplicates(spark, frame, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in frame.collect()) == [1, 3, 4, 5]
    frame = p.contamination(spark, frame, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in frame.collect()) == [1, 3, 5]
    got = {r.doc_id: r for r in p.secrets(spark, frame, "/root/testdata/sf0.001").collect()}
    assert got[5].text == body(5) + " [REDACTED] z" and got[5].n_chars == len(got[5].text) and got[1].text == body(1)
