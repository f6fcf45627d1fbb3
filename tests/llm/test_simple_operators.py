"""URL filter, secrets, decontamination, quality rules and WARC against brute force, edge cases included."""

import hashlib
import re
from collections import Counter

import pytest

from kosha.llm import decontaminate, quality_rules, secret_scan, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, base string, weak string"


def docs(spark, texts):
    """Extra columns base and weak clash with names inside the operators."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", "b", "w") for i, t in texts], DOCS)


def test_url_filter_edges(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "/en/", "allow")], "host string, path string, verdict string")
    urls = [(1, "http://a.Example.com/en/71?x#y"), (2, "http://x.com/en/"), (3, None), (4, "no scheme"), (5, ""), (6, "http://com/en/1"), (7, "http://xcom/en/"), (2, "http://x.com/en/"), (8, "a\nb://h.com/en/")]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in urls], "page_id long, url string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    assert got == [(1, "a.example.com", "/en/71", "example.com/en/7", "allow"), (2, "x.com", "/en/", "com/en/", "block"), (2, "x.com", "/en/", "com/en/", "block"), (3, "", "", "", "allow"), (4, "", "", "", "allow"), (5, "", "", "", "allow"), (6, "com", "/en/1", "com/en/", "block"), (7, "xcom", "/en/", "", "allow"), (8, "h.com", "/en/", "com/en/", "block")]
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.where("false")).collect()} == {"allow"}
    assert sorted(map(str, url_filter.judge_urls(pages, rules, broadcast_rows=0).collect())) == sorted(map(str, url_filter.judge_urls(pages, rules).collect()))


def test_pages_of_one_site_are_dealt_over_tasks(spark):
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    pages = spark.range(20_000).selectExpr("id AS page_id", "'http://big.com/en/' || id % 3 AS url").repartition(8)
    judged = url_filter.judge_urls(pages, rules, broadcast_rows=0)
    assert judged.where("verdict = 'block'").count() == 20_000
    assert "__salt" in judged._jdf.queryExecution().optimizedPlan().toString()


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


KEY = "AKIA" + "Z" * 16
SECRETS = [None, "", "é" * 5 + ' Token = "abcdef1" x', "secret:token : abcdef12", "token=ab token=abcdefg", f"{KEY} and {'A1b+' * 10}", f"{'A1b+' * 10} alone", f"{KEY} " + "x" * 500 + " " + "A1b+" * 10, "0" * 24 + "g" + "f" * 23, "user: bob password=hunter22", "𝒳 api_key=" + "a" * 30, "token=" + "a1" * 15000]


def test_secrets(spark):
    frame = docs(spark, [*enumerate(SECRETS), (2, SECRETS[2]), (None, SECRETS[5]), (5, SECRETS[9])])
    rows = secret_scan.scan_secrets(frame).collect()
    assert len(rows) == len(SECRETS) + 3
    by = {r.doc_id: r for r in rows if r.doc_id not in (5, None)}
    for i, t in enumerate(SECRETS):
        if i != 5:
            assert by[i].base_sha256 == hashlib.sha256(base_spans(t or "").encode()).hexdigest(), t
    assert "key40" in next(r.spans for r in rows if r.doc_id is None)
    assert by[6].spans == "" and "key40" not in by[7].spans  # alone, and too far away
    assert by[9].spans.startswith("user:0:9,assign:10:")
    cleaned = {r.doc_id: r for r in secret_scan.redact(frame).where("doc_id not in (2, 5)").collect()}
    assert cleaned[9].text == "[REDACTED] [REDACTED]" and cleaned[0].text is None and cleaned[6].text == SECRETS[6] and cleaned[9].base == "b"
    assert secret_scan.scan_secrets(frame.where("false")).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_contamination(spark):
    item = "One two three, four five six seven eight nine ten eleven"
    texts = [None, "", item.upper(), "x " + item + " y " + item, "one two three", "short item É", "zz short ITEM É zz short item É", " ".join(["pad"] * 20000) + " " + item, "ten eleven one two three four five six seven eight nine"]
    frame = docs(spark, [*enumerate(texts), (3, texts[3]), (None, item)])
    items = spark.createDataFrame([(1, item), (2, "short item É"), (3, None), (4, ""), (12, item)], "item_id long, text string")
    grams = {}
    for i, t in ((1, item), (2, "short item É"), (12, item)):
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    got = {}
    for r in decontaminate.contamination(frame, items).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[3]) == 2 and got[None][0].contaminated
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= owners
        r = got[i][0]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()), t
    shuffled = decontaminate.contamination(frame, items, broadcast_rows=0).collect()
    assert sorted(map(str, shuffled)) == sorted(str(r) for rows in got.values() for r in rows)
    kept = decontaminate.decontaminate(frame, items)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 8]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(frame, items, mode="spans").collect()}
    assert spans[3] == "x y" and spans[0] is None and spans[4] == "one two three"
    assert decontaminate.contamination(frame, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(frame.where("false"), items).count() == 0


def test_quality_rules(spark):
    texts = [None, "", "a b c a b c", "x # y\nx # y\n\n \nx # y", "word " * 60, " ".join(f"w{i}" for i in range(80)), "a b c d " * 3000]
    frame = docs(spark, [*enumerate(texts), (5, texts[5])])
    rows = quality_rules.judge(frame).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c, cover = Counter(tri), set()
        for i, x in enumerate(tri):
            cover |= {i, i + 1, i + 2} if c[x] > 1 else set()
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed), t
        assert r.kept == (not failed)
    assert quality_rules.judge(frame.where("false")).count() == 0


def test_outliers_are_rejected(spark):
    normal = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(100))) for i in range(400)]
    odd = [(1000 + i, " ".join(f"w{i}x{k}###$$$" for k in range(100))) for i in range(8)]
    rows = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, normal + odd)).collect()}
    assert all(rows[i] for i, _ in normal) and not any(rows[i] for i, _ in odd)


def test_warc(spark):
    big = "é<p>x</p>" * 20000
    pages = [(1, "http://a/\r\nX-Page-ID: 9", None), (2, None, ""), (3, "u", big), (4, "u", big), (3, "u", big), (None, "u", "z" * 3000), (7, "u", "s" * 999), (8, "u", "s" * 999), (9, "u", "WARC/1.1\r\n\r\n" * 200)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    rows = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, frame, segment=5000).collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = h == big and i == 3
        want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 4 if revisit else None))
    assert rows == sorted(want, key=str)
    assert warc.archive_round_trip(spark, frame.where("false")).count() == 0


def test_warc_payloads_and_missing_segments(spark):
    from kosha.llm.shared import scratch

    text = "0123456789é" * 3000
    frame = spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.classify(frame), scratch(spark) + "/w", 1000)
    parts = warc.read_parts(manifest)
    assert warc.reassemble(parts).first().payload.decode() == text
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(parts.where("number <> 3")).collect()
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc")


def test_clashing_names(spark):
    """Columns named like the operators' own helpers of old stay untouched."""
    pages = spark.createDataFrame([(1, "http://a.com/en/", "b")], "page_id long, url string, best string")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    assert url_filter.judge_urls(pages, rules).select("best", "verdict").first() == ("b", "block")
    item = "one two three four five six seven eight nine ten"
    names = ("hits", "h_id", "h_text", "linked", "l_id", "l_text", "spans", "items", "w", "n", "id")
    frame = spark.createDataFrame([(1, f"x {item} user: bob password=hunter22", *names), (1, None, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    cleaned = {r.text: r for r in decontaminate.decontaminate(frame, items, mode="spans").collect()}
    assert cleaned["x user bob password hunter22"].hits == "hits" and None in cleaned
    redacted = {r.text: r for r in secret_scan.redact(frame).collect()}
    assert redacted[f"x {item} [REDACTED] [REDACTED]"].linked == "linked" and None in redacted
    assert decontaminate.contamination(frame, items).where("contaminated").count() == 1 and secret_scan.scan_secrets(frame).count() == 2


def test_windows_are_verified_by_words(spark):
    """The two ways to find windows agree, and rows that only share a hash would not count."""
    items = spark.createDataFrame([(i, f"a{i} b c d e f g h i j k{i}") for i in range(30)], "item_id long, text string")
    frame = docs(spark, [(i, f"pad a{i % 40} b c d e f g h i j k{i % 37}") for i in range(200)])
    ways = [sorted(map(str, decontaminate.contamination(frame, items, broadcast_rows=n).collect())) for n in (200_000, 3, 0)]
    assert ways[0] == ways[1] == ways[2]


def test_very_many_secrets_in_a_text(spark):
    """Time grows far less than with the square of the matches; ends and order stay right, beyond the BMP too."""
    import time

    took = []
    for n in (2_500, 20_000):
        text = " ".join(f"\U0001d4b3 token=abcdef{k} ﻿" for k in range(n))
        frame = docs(spark, [(1, text)])
        began = time.time()
        row = secret_scan.scan_secrets(frame).first()
        cleaned = secret_scan.redact(frame).first().text
        took.append(time.time() - began)
        assert row.n_assign == n and row.base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
        assert cleaned == " ".join("\U0001d4b3 [REDACTED] ﻿" for _ in range(n))
    assert took[1] < 24 * took[0] + 3


def numpy_mcd(x, tries=400):
    """Squared distances by the minimum covariance determinant of many random starts, made consistent and reweighted, with a floor under each pivot."""
    import numpy as np

    r, (n, p) = np.random.default_rng(1), x.shape
    h = (n + p + 1) // 2

    def fit(kept, factor):
        cov, low = factor * np.cov(kept.T, bias=True), np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                rest = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, quality_rules.FLOOR**2)) if i == j else rest / low[j, j]
        return kept.mean(0), low

    def distances(mean, low):
        return (np.linalg.solve(low, (x - mean).T) ** 2).sum(0)

    best = None
    for _ in range(tries):
        mean, low = fit(x[r.choice(n, p + 1, replace=False)], 1.0)
        for _ in range(30):
            mean, fresh = fit(x[np.argsort(distances(mean, low), kind="stable")[:h]], quality_rules.HALF_FACTOR)
            if np.allclose(fresh, low):
                break
            low = fresh
        det = np.log(np.diag(low)).sum()
        if best is None or det < best[0]:
            best = det, mean, low
    mean, low = fit(x[distances(*best[1:]) <= quality_rules.REWEIGHT_CUT], quality_rules.REWEIGHT_FACTOR)
    return mean, low, distances(mean, low)


@pytest.mark.parametrize("share", [0.3, 0.45])
def test_mcd_by_brute_force(spark, share):
    import numpy as np

    r = np.random.default_rng(3)
    rows, want = [], {}
    for g, n in (("a", 25), ("b", 200), ("c", 600), ("few", quality_rules.LEAST_ROWS - 1)):
        x = r.normal(size=(n, 4)) @ r.normal(size=(4, 4)) + r.normal(size=4)
        x[: int(n * share)] = r.normal(size=4) * 0.2 + x.mean(0) + [40, -30, 40, 30] + r.normal(size=(int(n * share), 4))
        rows += [(g, *map(float, v)) for v in x]
        want[g] = x, *numpy_mcd(x)
    frame = spark.createDataFrame(rows, "g string, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    got = {r.g: r for r in quality_rules.fit_mcd(frame, ["g"]).collect()}
    assert set(got) == {"a", "b", "c"}
    names = quality_rules.FEATURES
    for g, row in got.items():
        x, mean, low, distance = want[g]
        found = np.array([[row[f"l_{f}_{h}"] if j <= i else 0.0 for j, h in enumerate(names)] for i, f in enumerate(names)])
        d = (np.linalg.solve(found, (x - [row[f"m_{f}"] for f in names]).T) ** 2).sum(0)
        if len(x) - int(len(x) * share) >= (len(x) + 5) // 2:  # as many others as the subset takes
            assert (d[: int(len(x) * share)] > quality_rules.MAX_DISTANCE).all(), g
        if len(x) >= 200:  # a few rows have many subsets of about the least determinant
            assert ((d > quality_rules.MAX_DISTANCE) == (distance > quality_rules.MAX_DISTANCE)).all(), g
            assert np.allclose(np.diag(found), np.diag(low), rtol=0.25), g


@pytest.mark.parametrize("share", [0.2, 0.4])
def test_many_outliers_of_a_group_are_rejected(spark, share):
    """Texts of 80 to 160 words; outliers have a mark behind 60 % of their words."""
    import random

    rng = random.Random(int(share * 10))
    texts = []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(80, 161))]
        texts.append((i, " ".join(w + "#" if i < 400 * share and rng.random() < 0.6 else w for w in words)))
    frame = docs(spark, texts).drop("lang").selectExpr("*", "'en' AS lang")
    kept = {r.doc_id for r in quality_rules.judge(frame).where("kept").collect()}
    assert kept == set(range(int(400 * share), 400))


def test_ordinary_pages_are_segmented(spark):
    """Most records of the test pages are in segments, and every payload comes back whole."""
    from kosha.llm.shared import keep, scratch

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    parts = keep(warc.read_parts(warc.write_archives(warc.classify(pages), scratch(spark) + "/w")))
    assert parts.where("record_type = 'continuation'").count() > 200
    got = Counter((r.id, hashlib.sha1(bytes(r.payload)).hexdigest()) for r in warc.reassemble(parts).collect() if r.payload is not None)
    want = {(r.page_id, hashlib.sha1((r.html or "").encode()).hexdigest()) for r in pages.collect()}
    assert set(got) <= want and len(got) == parts.where("record_type = 'response'").count()
