"""Linked credentials: keys right behind '=', and distances between nearest edges, against brute force."""

import random
import re

from kosha.llm import secret_scan

ID, KEY = "AKIA" + "Z" * 16, "A1b+" * 10


def spans(spark, texts, scope=200):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in secret_scan.scan_secrets(frame, scope=scope).collect()}


def test_key_behind_equals_sign(spark):
    text = f"AWS_ACCESS_KEY_ID={ID}\nAWS_SECRET_ACCESS_KEY={KEY}\n"
    assert f"key40:{text.index(KEY)}:{text.index(KEY) + 40}" in spans(spark, [text])[0]
    frame = spark.createDataFrame([(0, text)], "doc_id long, text string")
    assert KEY not in secret_scan.redact(frame).first().text


def test_parts_behind_a_long_value(spark):
    jwt = "token=" + "a1." * 200
    texts = [f"{jwt} user=bob5", f"user=bob5 {jwt}", f"{jwt} https://h.com", jwt + " " * 200 + "user=bob5", jwt + " " * 201 + "user=bob5", "login=" + "b" * 700 + " " * 9 + "secret=abcdef1"]
    got = spans(spark, texts)
    assert [k for k in range(6) if re.search("user|endpoint", got[k])] == [0, 1, 2, 3, 5]


def test_links_by_brute_force(spark):
    rng, texts = random.Random(3), []
    for _ in range(60):
        parts = [rng.choice([ID, "=" + KEY, "user=bob" + "u" * rng.randrange(60), "http://h.com", "token=" + "x1" * rng.randrange(3, 40)]) for _ in range(rng.randrange(2, 8))]
        texts.append("".join(p + " " * rng.randrange(1, 45) for p in parts))
    for k, got in spans(spark, texts, 20).items():
        text = texts[k]
        found = lambda kind, pattern: [(m.start(), m.end(), kind) for m in re.finditer(pattern, text)]
        base = found("access", secret_scan.ACCESS) + found("assign", secret_scan.ASSIGN)
        weak = found("key40", secret_scan.KEY40) + found("user", secret_scan.USER) + found("endpoint", secret_scan.ENDPOINT)
        near = [w for w in weak if any(s[2] in secret_scan.COMPLEMENTS[w[2]] and s[0] - w[1] <= 20 and w[0] - s[1] <= 20 for s in base)]
        assert got == ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(base + near)), text
