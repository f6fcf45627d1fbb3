"""Joins of names, aliases, alignment, merging in arrays, identities and audits against brute force."""

import datetime
import itertools
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kosha.operators import audits, identity, matching, merge, nested


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [2 / 3, 0.8, 0.9])
def test_similar_names_lose_no_pair(spark, least):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))) for _ in range(40)]

    def misprint(s):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "y" + s[i + 1 :]])
        return s

    left, right = [*map(misprint, base), None, "", base[0]], [*base, base[0], None, "aaaaaaaaaaaa"]
    got = {(r.l_name, r.r_name): round(r.ratio, 9) for r in matching.similar_names(names(spark, left), names(spark, right), least).collect()}
    want = {}
    for a, b in itertools.product({x for x in left if x}, {x for x in right if x}):
        r = 1 - edits(a, b) / max(len(a), len(b))
        if r >= least - 1e-9:
            want[a, b] = round(r, 9)
    assert got == want and len(want) > 10


def test_similar_names_refuse_low_ratios(spark):
    with pytest.raises(ValueError):
        matching.similar_names(names(spark, ["a"]), names(spark, ["a"]), 0.6)


def test_names_of_common_words_meet_in_blocks(spark, monkeypatch):
    """Names that share all their grams with many others, dealt over several blocks and few columns of counts: no pair is lost, and few are compared by edits."""
    for k, v in {"BLOCK": (40, 60), "STEP": 7, "ROWS": 11, "WIDTH": 64}.items():
        monkeypatch.setattr(matching, k, v)
    every = [" ".join(w) for w in itertools.product(("large", "small", "öld"), ("ring", "gear", "bolt"), ("brand 1", "brand 25", "brand 7"), ("fund direct plan", "fund regular plan", "fund etf"))]
    asked = [x[: 3 + i % 7] + "x" * (i % 2) + x[5 + i % 7 :] for i, x in enumerate(every)]
    got = {(r.l_name, r.r_name): round(r.ratio, 9) for r in matching.similar_names(names(spark, asked), names(spark, every)).collect()}
    all_ = {(a, b): round(1 - edits(a, b) / max(len(a), len(b)), 9) for a in asked for b in every}
    assert got == {k: r for k, r in all_.items() if r >= 0.85} and len(got) > 81
    monkeypatch.setattr(matching, "WIDTH", 1024)
    batch = lambda s, x: pa.RecordBatch.from_pydict({"side": [s] * len(x), "name": x})
    near = [r for b in matching._near(0.85)(iter([batch("l", asked), batch("r", every)])) for r in b.to_pylist()]
    assert len(got) <= len(near) < len(all_) / 4


def test_codes_of_one_name_and_equal_questions(spark):
    directory = spark.createDataFrame([(c, "Alpha Fund", "a") for c in (9, 7, 8, 5, 6, 5)] + [(1, "Alpha Funds", None), (9, "Alpha Fumd", "a")], "code int, name string, house string")
    asked = spark.createDataFrame([(1, "alpha fund", None, None), (2, "ALPHA  fund", None, None), (2, "alpha fund", None, None), (3, "alpha fumd", "a", None)], "id int, name string, house string, plan string")
    got = {i: [(r.code, round(r.ratio, 4)) for r in sorted(rows, key=lambda r: r.k)] for i, rows in itertools.groupby(sorted(matching.candidates(asked, directory).collect()), key=lambda r: r.id)}
    assert got[1] == got[2] == [(5, 1.0), (6, 1.0), (7, 1.0)]
    assert got[3] == [(5, 1.0), (6, 1.0), (7, 1.0)]  # the house's boost brings them to the equal name


def test_joins_of_names_compare_no_all_pairs(spark):
    a, b = names(spark, ["alpha beta fund"] * 3), names(spark, ["alpha beta funds", "gamma"])
    for df in (matching.similar_names(a, b), matching.containment_pairs(a, b)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_containment_by_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    left, right = [text(rng.randrange(3, 30)) for _ in range(60)], [text(rng.randrange(3, 16)) for _ in range(60)]
    got = sorted(map(tuple, matching.containment_pairs(names(spark, [*left, None, left[0]]), names(spark, right), 8).collect()))
    assert got == sorted({(a, b) for a in left for b in right if (a in b or b in a) and min(len(a), len(b)) >= 8}) and got


def test_boosts_and_penalties(spark):
    asked = spark.createDataFrame([(1, "Alpha Growth Series 129", "alpha", "regular"), (2, "Alpha Exchange-Traded Nifty", None, None), (3, "Alpha Growth Series 129 regular plan", "x", "direct")], "id int, name string, house string, plan string")
    directory = spark.createDataFrame([(10, "ALPHA growth series 131", "alpha"), (11, "alpha growth series 129 ", "alpha"), (12, "Alpha Growth Series 129 Regular Plan", "alpha"), (13, "alpha growth series 129 etf", None)], "code int, name string, house string")
    got = {(r.id, r.code): round(r.ratio, 4) for r in matching.candidates(asked, directory, 2 / 3).collect()}
    assert got[1, 11] == 1.0  # equal names are not adjusted
    assert got[1, 10] == round(min(1, 1 - 2 / 23 + 0.15) - 0.2, 4)  # same house, no shared number
    assert got[1, 13] == round(1 - 4 / 27 - 0.3 + 0.05, 4)  # an ETF that was not asked for, a shared number
    assert got[3, 12] == 1.0 and not any(i == 2 for i, _ in got)


def alias_table(spark):
    rows = [("profit after tax", "pat", 1, 1), ("net profit", "pat", 1, 2), ("net profit for the period", "pat", 1, 3), ("revenue from operations", "revenue", 2, 4), ("revenue", "revenue", 2, 5), ("nifty 50", "n50", 3, 6), ("nifty", "n", 4, 7)]
    return spark.createDataFrame(rows, "alias string, target string, family_rank int, rank int")


def matched(spark, labels, rule):
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    return {r.label: (r.target, r.alias, r.score) for r in matching.match_aliases(frame, alias_table(spark), rule).collect()}


def test_alias_rules(spark):
    got = matched(spark, ["net profit", "net profit for period", "nifty 500 index", "zzz", None, "net profit"], "score")
    assert got["net profit"] == ("pat", "net profit", 1.0) and len(got) == 4
    assert got["net profit for period"][:2] == ("pat", "net profit for the period") and got["net profit for period"][2] == pytest.approx(0.95)
    assert got["nifty 500 index"] == (None, None, pytest.approx(1 / 3 + 0.15)) and got["zzz"] == (None, None, None)
    first = matched(spark, ["the nifty 50 fund", "nifty 500 fund", "nifty", "net profit revenue"], "first")
    assert first["the nifty 50 fund"][0] == "n50" and first["nifty 500 fund"][0] == "n" and first["nifty"][0] == "n" and first["net profit revenue"][0] == "pat"
    longest = matched(spark, ["xrevenue from operations (net)", "for the per", "nifty 500"], "longest")
    assert longest["xrevenue from operations (net)"][:2] == ("revenue", "revenue from operations")
    assert longest["for the per"][0] == "pat" and longest["nifty 500"][:2] == ("n50", "nifty 50")
    with pytest.raises(ValueError):
        matched(spark, ["a"], "other")


def aligned(xs, anchors, most):
    """All paths of the alignment, in the order of its choices: the first of least cost, found from the end."""
    from functools import cache

    @cache
    def cost(i, j):
        if i == 0:
            return 0.0
        if j == 0:
            return float("inf")
        return min(c for c, _ in choices(i, j))

    def choices(i, j):
        d = abs(xs[i - 1] - anchors[j - 1])
        return [*([(cost(i - 1, j - 1) + d, "pair")] if d <= most else []), (cost(i - 1, j) + most, "x"), (cost(i, j - 1) + most, "anchor")]

    i, j, out = len(xs), len(anchors), []
    while i and j:
        move = min(choices(i, j), key=lambda c: c[0])[1]
        if move == "pair":
            out.append((i - 1, j - 1))
        i, j = i - (move != "anchor"), j - (move != "x")
    return out[::-1], cost(len(xs), len(anchors))


def total(pairs, xs, anchors, most):
    """Cost of a monotone assignment by its definition: distances, skipped figures, and skipped anchors behind the first figure that is met."""
    best = float("inf")
    first = pairs[0][0] if pairs else len(xs)
    for lead in range(len(anchors) + 1):  # anchors passed for free before the first figure
        if pairs and lead > pairs[0][1]:
            break
        if not lead and (first or not pairs):
            continue  # a skipped figure needs an anchor before it
        best = min(best, sum(abs(xs[i] - anchors[j]) for i, j in pairs) + most * (len(xs) - len(pairs) + len(anchors) - lead - len(pairs)))
    return best


def test_alignment_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        xs, anchors = sorted(rng.sample(range(0, 400, 5), rng.randrange(0, 5))), sorted(rng.sample(range(0, 400, 5), rng.randrange(0, 5)))
        rows.append((k, [float(x) for x in xs], [float(x) for x in anchors]))
    frame = spark.createDataFrame([*rows, (-1, None, [1.0])], "k int, xs array<double>, anchors array<double>")
    got = {r.k: [tuple(p) for p in r.p] for r in frame.select("k", matching.align_columns(F.col("xs"), F.col("anchors")).alias("p")).collect()}
    assert got[-1] == []
    for k, xs, anchors in rows:
        if not xs or not anchors:
            assert got[k] == []
            continue
        want, cost = aligned(tuple(xs), tuple(anchors), 75.0)
        assert got[k] == want
        every = [list(zip(i, j, strict=True)) for n in range(min(len(xs), len(anchors)) + 1) for i in itertools.combinations(range(len(xs)), n) for j in itertools.combinations(range(len(anchors)), n)]
        fit = [p for p in every if all(abs(xs[i] - anchors[j]) <= 75 for i, j in p)]
        assert cost == min(total(p, xs, anchors, 75.0) for p in fit) == total(want, xs, anchors, 75.0)


def test_events_merge_once(spark):
    event = "array<struct<date string, value double>>"
    old = [("2020-03-01", 2.0), ("2020-01-01", 1.0), (None, 7.0), ("2020-03-01", 9.0)]
    new = [("2020-03-01", 2.0), ("2020-03-01", 2.5), ("2021-01-01", 4.0), (None, 3.0), ("2020-01-01", 1.0 + 1e-12)]
    frame = spark.createDataFrame([(1, old, new), (2, None, new[:1]), (3, old, None), (4, [], [])], f"k int, old {event}, new {event}")
    same = lambda a, b: F.abs(a - b) <= 1e-9
    once = frame.withColumn("m", nested.merge_events(F.col("old"), F.col("new"), same))
    got = {r.k: r.m for r in once.collect()}
    assert [tuple(e) for e in got[1].merged] == [("2020-01-01", 1.0), ("2020-03-01", 2.5), ("2020-03-01", 9.0), ("2021-01-01", 4.0), (None, 7.0)] and (got[1].added, got[1].updated) == (1, 1)
    assert (got[2].added, got[2].updated, len(got[2].merged)) == (1, 0, 1) and len(got[3].merged) == 4 and got[4].merged == []
    again = once.select("k", nested.merge_events(F.col("m.merged"), F.col("new"), same).alias("m2"), "m").collect()
    assert all((r.m2.added, r.m2.updated) == (0, 0) and r.m2.merged == r.m.merged for r in again)
    known = spark.createDataFrame([([("2020-05-01", 2.0), ("2020-01-15", 2.0), ("2020-03-01", 9.0), ("2020-02-01", 3.0)], [("2020-03-01", 2.0)])], f"e {event}, known {event}")
    assert [e.date for e in known.select(nested.drop_near(F.col("e"), F.col("known")).alias("e")).first().e] == ["2020-05-01", "2020-03-01", "2020-02-01"]


def test_records_merge_once(spark):
    kind = "map<string, struct<v int, derived boolean>>"
    old = {"q1": (1, True), "q2": (2, False), "q3": (3, True), "q5": (5, True)}
    new = {"q1": (10, False), "q2": (20, False), "q3": (30, True), "q4": (40, True), "q5": (5, False)}
    once = spark.createDataFrame([(old, new)], f"old {kind}, new {kind}").withColumn("m", nested.merge_records(F.col("old"), F.col("new")))
    m = once.first().m
    assert {k: tuple(v) for k, v in m.merged.items()} == {"q1": (10, False), "q2": (2, False), "q3": (3, True), "q4": (40, True), "q5": (5, False)} and (m.added, m.changed) == (1, 2)
    again = once.select(nested.merge_records(F.col("m.merged"), F.col("new")).alias("m")).first().m
    assert (again.added, again.changed) == (0, 0) and again.merged == m.merged


def test_records_in_nested_json(spark):
    record = {"ISIN": "IN1", "AN": "Bond", "price": None, "last_price": 5, "deep": {"isin": "no"}}
    docs = [record]
    for _ in range(5):
        docs.append({"a": 1, "b": [record], "c": docs[-1]})
    shapes = [*map(json.dumps, docs), None, "not json", "[1]", json.dumps({"isin": ""}), json.dumps({"x": {"isin": "IN2"}, "y": {"Isin": "IN3", "isin": "IN4"}})]
    frame = spark.createDataFrame(list(enumerate(shapes)), "k int, text string")
    got = {r.k: [(x.isin, x.name, x.price) for x in r.r] for r in frame.select("k", nested.find_records(F.col("text")).alias("r")).collect()}
    assert all(got[k] == [("IN1", "Bond", None)] for k in range(6))
    assert all(got[k] == [] for k in range(6, 10)) and sorted(x[0] for x in got[10]) == ["IN2", "IN4"]
    deep = '{"a": ' * 7 + '{"isin": "IN9"}' + "}" * 7
    frame = spark.createDataFrame([(deep,)], "text string")
    assert frame.select(F.size(nested.find_records(F.col("text"), deeper="skip"))).first()[0] == 0
    assert frame.select(F.size(nested.find_records(F.col("text"), depth=7))).first()[0] == 1
    with pytest.raises(Exception, match="nested more than 6 deep"):
        frame.select(nested.find_records(F.col("text"))).collect()


def test_debt_keys(spark):
    rows = [("7.38% Gujarat SDL (15/11/2032)", None, None), ("Gujarat SDL 7.38 15/11/2032", None, None), ("The Gujarat SDL Ltd", 7.38, "2032-11-15"), ("Gujarat SDL", None, ""), (None, 7.0, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "company string, coupon double, due string")
    got = [r[0] for r in frame.select(identity.debt_key(F.col("company"), F.col("coupon"), F.col("due"))).collect()]
    assert got == ["GUJARAT SDL|C7.38|M2032-11-15"] * 3 + [None, "C7.0", None]


def test_classes_over_two_identities(spark):
    rng = random.Random(8)
    chain = [(f"i{n:03}", f"d{n:03}") for n in range(40)] + [(f"i{n + 1:03}", f"d{n:03}") for n in range(39)]
    loose = [(f"j{rng.randrange(30):02}", f"e{rng.randrange(40):02}") for _ in range(25)]
    pairs = [*chain, *loose, (None, "d000"), ("i000", None), chain[0]]
    rng.shuffle(pairs)
    got = {(r.a, r.b): r["class"] for r in identity.identity_classes(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a and b:
            x, y = find(("a", a)), find(("b", b))
            up[max(x, y)] = min(x, y)
    assert got == {(a, b): find(("a", a))[1] for a, b in pairs if a and b}


def test_overlap_keys_where_a_source_lacks_isins(spark):
    bond = ("7.5% X Ltd (01/02/2030)", "X 7.5 01/02/2030")
    rows = [("s", 1, "IN1", bond[0]), ("s", 2, None, bond[1]), ("s", 3, "IN2", bond[1]), ("s", 4, "", "Plain Equity"), ("s", 5, None, None), ("t", 6, None, bond[0])]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], "set string, k int, isin string, company string, coupon double, maturity_date string")
    keys = {r.k: r.key for r in identity.overlap_keys(frame, "set").collect()}
    assert keys == {1: "IN1", 2: "IN1", 3: "IN2", 4: "Plain Equity", 6: "X|C7.5|M2030-02-01"}
    classes = {r.k: r.key for r in identity.class_keys(frame, "set").collect()}
    assert classes == {1: "IN1", 2: "IN1", 3: "IN1", 4: "Plain Equity", 6: "IN1"}


AUDIT = "amc string, fund string, month date, class string, tier string, coverage_pct double, n_holdings long, escalate boolean, suspect boolean, keyable boolean"


def test_totals_merge_and_scopes_are_replaced(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(rng_amc, f"f{i}", day, ["a", None][i % 2], audits.TIERS[i % 3], 90.0 + i, i, i % 3 == 2, i == 5, i != 4) for i, rng_amc in enumerate(["x", "y", "x", None, "y", "x"])]
    frame = spark.createDataFrame(rows, AUDIT)
    whole = sorted(map(str, audits.roll_up(frame).collect()))
    parts = audits.merge_totals(audits.roll_up(frame.where("coverage_pct < 93")), audits.roll_up(frame.where("coverage_pct >= 93")))
    assert sorted(map(str, parts.select(audits.roll_up(frame).columns).collect())) == whole
    total = next(r for r in audits.roll_up(frame).collect() if r.level == 7)
    assert (total.n_schemes, total.n_holding_rows, total.n_escalated, total.n_suspect, total.n_unkeyable, total.n_with_holdings) == (6, 15, 2, 1, 1, 5)
    fresh = frame.where("fund = 'f0'").withColumn("coverage_pct", F.lit(1.0))
    kept = audits.replace_scope(frame, fresh, "amc").collect()
    assert sorted((r.amc or "", r.fund) for r in kept) == [("", "f3"), ("x", "f0"), ("y", "f1"), ("y", "f4")]


def test_samples_depend_on_keys_only(spark):
    rows = [(i, i % 3, rng) for i, rng in enumerate(["v"] * 300)]
    frame = spark.createDataFrame(rows, "k int, s int, v string")
    whole = {r.k for r in audits.smallest_hashes(frame.repartition(7), "k", "s", 4).collect()}
    halves = audits.smallest_hashes(frame.where("k < 100"), "k", "s", 4).unionByName(audits.smallest_hashes(frame.where("k >= 100"), "k", "s", 4))
    assert {r.k for r in audits.smallest_hashes(halves, "k", "s", 4).collect()} == whole and len(whole) == 12


def test_three_sources_side_by_side(spark):
    d = datetime.date(2024, 1, 1)
    dated = lambda rows: spark.createDataFrame(rows, "k int, date date, value double")
    got = {r.k: (r.date_current, r.nav_match, r.stored_match, r.only) for r in audits.three_way(dated([(1, d, 1.0), (2, d, 1.0), (3, d, None)]), dated([(1, d, 1.00005), (2, None, 1.1), (4, d, 1.0)]), spark.createDataFrame([(1, 1.02), (3, 1.0), (5, 1.0)], "k int, value double"), "k").collect()}
    assert got == {1: (True, True, False, "hls"), 2: (False, False, False, "hl"), 3: (False, False, False, "hs"), 4: (False, False, False, "l"), 5: (False, False, False, "s")}


def test_left_rows_meet_one_right_row_of_a_key(spark):
    """All rows share the key of the second tier: each left row meets its preferred row only, not all of them."""
    left = spark.range(2_000).selectExpr("id", "if(id % 2 = 0, concat('same key ', id), 'same key of none') AS name")
    right = spark.range(1_999, -1, -1).selectExpr("id AS rid", "concat('same key ', id) AS key", "id % 1000 AS worth")
    tiers = [(F.col("name"), F.col("key")), (F.substring("name", 1, 8), F.substring("key", 1, 8))]
    found = merge.resolve(left, right, tiers, "id", "rid", [F.col("worth"), F.col("rid").alias("tie")])
    assert {(r.id, r.rid, r.tier) for r in found.collect()} == {(i, 1999, 1) if i % 2 else (i, i, 0) for i in range(2_000)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == plan.count("AS y#") == 2  # both sides of the union aggregate before they join


def test_universe_rows_of_one_beginning_are_ranked_before_they_meet(spark):
    """Two rows of each name and 500 names of one beginning: names asked for meet one row of a name and one of a beginning."""
    universe = spark.range(1_000).selectExpr("id AS key", "concat('samebeginning', id % 500, 'fund') AS name", "if(id >= 500, 'Regular', null) AS plan", "cast(id % 7 AS double) AS aum")
    asked = spark.createDataFrame([(1, "samebeginning3fund"), (2, "samebeginning7funds"), (3, "samebeginningx"), (3, "samebeginning8fund"), (4, "other"), (5, "")], "id int, name string")
    found = matching.match_universe(asked, universe)
    best = min(range(500, 1_000), key=lambda i: (-(i % 7), i))
    assert {(r.id, r.tier, r.key) for r in found.collect()} == {(1, 0, 503), (2, 1, 507), (3, 0, 508)}
    assert [(r.tier, r.key) for r in matching.match_universe(asked.where("name = 'samebeginningx'"), universe).collect()] == [(2, best)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "AS head#" in plan.split("Join Inner")[-1]  # beginnings are aggregated below the last join


def test_events_of_a_long_history_merge_in_time(spark):
    """300 dates: each look-up was made anew for each event, in time cubic in the dates."""
    event = "array<struct<date string, value double>>"
    day = [str(datetime.date(2000, 1, 1) + datetime.timedelta(days=i)) for i in range(300)]
    old, new = [(d, 1.0) for d in day[::2]], [(d, 2.0) for d in day[::3]]
    frame = spark.createDataFrame([(old, new)], f"old {event}, new {event}")
    merge_ = nested.merge_events(F.col("old"), F.col("new"), lambda a, b: F.abs(a - b) <= 1e-9)
    m = frame.select(merge_.alias("m")).first().m
    assert [tuple(e) for e in m.merged] == [(d, 2.0 if i % 3 == 0 else 1.0) for i, d in enumerate(day) if i % 2 == 0 or i % 3 == 0] and (m.added, m.updated) == (50, 50)
    text = frame.select(merge_.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("map_from_entries") == 1  # the map of overrides is made once, not inside a look-up
