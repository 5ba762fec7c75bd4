"""Survivors and identities: examples, brute force over random groups, and the defined edge cases."""

from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from specimatrix.llm import identity as I
from specimatrix.llm import survivor as S

SCHEMA = "row_id bigint, species_voucher_new string, lat_lon string, geo_loc_name string, country string, updated_at timestamp"


@pytest.mark.parametrize(
    ("text", "unit"),
    [("10.0142 N 75.3773 E", 4.0), ("10°00'13\"N 80°32'10\"E", 3.5), ("10°00'S 72°33'W", 1.5), ("10 N 74 E", 0.0), ("N10.0190 E77.2082", 4.0), ("-35.2, 168.3", 1.0), ("46.39S 176.70E", 2.0), ("50, -0", 0.0), ("40.4677S 172.2750E", 4.0), ("1.5, 2.25", 2.0),
     ("0.0, 0.0", None), ("0°00'00\"N 0°00'00\"E", None), ("94.21 N 12.3 E", None), ("99.9999 N 999.9999 E", None), ("10°61'N 10°00'E", None), ("10 N 20", None), ("missing", None), ("", None), (None, None), ("x" * 5000, None)],
)
def test_positions(spark, text, unit):
    got = spark.createDataFrame([(text,)], "t string").select(S.position(F.col("t")).alias("p")).first().p
    assert (got and got.unit) == unit


def test_places(spark):
    texts = ["Norway: Old Orvack, Tern Bay,jetty", "Norway:", "N/A", " ", None, "Peru"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.places(F.col("t"))).collect()]
    assert got == [["Norway", "Old Orvack", "Tern Bay", "jetty"], ["Norway"], None, None, None, ["Peru"]]


def table(spark, data):
    return spark.createDataFrame([(i, v, ll, g, c, t and datetime(2024, 1, t)) for i, v, ll, g, c, t in data], SCHEMA)


def test_best_rows(spark, rows):
    df = table(
        spark,
        [
            (5, "Aus_bus_X:1", "10 N 20 E", "Peru: a", None, 1), (3, "aus-bus__x1", "10.12 N 20.12 E", "Peru", None, 2), (7, "AUS BUS X 1", "10.12 N 20.12 E", "Peru: b", None, 3), (9, "Aus.bus.X.1", "10.12 N 20.12 E", "Peru: c", None, 3),
            (1, "single", "1 N 1 E", "Peru", None, 1), (11, "none1", "0, 0", "unknown", None, 1), (12, "NONE-1", None, None, None, None), (2, None, "1 N 1 E", "Peru", None, 1), (4, None, "1 N 1 E", "Peru", None, 1), (6, "_", "1 N 1 E", "x", None, 1), (8, "-", "1 N 1 E", "x", None, 1),
        ],
    )
    assert rows(S.best_rows(df)) == [(11, 0, 0), (3, 7, 7)]
    assert rows(S.best_rows(df.withColumn("position", F.lit(1)).withColumn("t0", F.lit(2)))) == [(11, 0, 0), (3, 7, 7)]
    assert S.best_rows(df.limit(0)).count() == 0


def test_search_against_all_choices():
    """Three bundles under two dependencies, on random groups."""
    rng = random.Random(11)
    for _ in range(400):
        levels = [rng.choice([0, 0, 1]) for _ in range(3)]
        scores = [[rng.choice([0.25, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 4))] for _ in range(3)]
        claims = [[[rng.choice(["x", "y", "z", None]), rng.choice(["u", "v", None])] for _ in s] for s in scores]
        best = None
        for choice in itertools.product(*[range(-1, len(s)) for s in scores]):
            held = [claims[b][k] for b, k in enumerate(choice) if k >= 0]
            if any(len({h[i] for h in held} - {None}) > 1 for i in range(2)):
                continue
            value = []
            for level in sorted(set(levels)):
                mine = [b for b in range(3) if levels[b] == level]
                value += [sum(scores[b][choice[b]] for b in mine if choice[b] >= 0), *[-(choice[b] if choice[b] >= 0 else len(scores[b])) for b in mine]]
            if best is None or tuple(value) > best[0]:
                best = tuple(value), list(choice)
        assert S.search(scores, claims, levels) == best[1]


def test_search_prunes():
    """Without a bound this tree would have 3 ** 40 leaves."""
    n = 40
    got = S.search([[1.0, 0.5]] * n, [[["x"], ["y"]]] * n, [0] * n)
    assert got == [0] * n


def test_place_and_country_agree_as_brute_force_says(spark):
    rng = random.Random(11)
    data = []
    for i in range(240):
        c = rng.choice(["Peru", "Chile", None])
        data.append((i, f"s{i % 60}", None, rng.choice([None, "Peru", "Peru: a", "Chile: a, b", "Chile"]), c, rng.randint(1, 28)))
    df = table(spark, data)
    got = {r.group_row_id: r for r in S.survivors(df.withColumn("places", F.lit(1)).withColumn("named", F.lit("x"))).collect()}
    for k in range(60):
        group = [d for d in data if d[1] == f"s{k}"]
        place = max([(d[3].count(",") + d[3].count(":"), d[5], -d[0], d) for d in group if d[3]], default=None)
        own = place and place[3][3].split(":")[0]
        state = max([(d[5], -d[0], d) for d in group if d[4] and (not own or own == d[4])], default=None)
        r = got[min(d[0] for d in group)]
        assert (r.n_rows, r.geo_row_id, r.geo_loc_name) == (4, place and place[3][0], place and place[3][3])
        assert (r.country_row_id, r.country) == (state and state[2][0], state[2][4] if state else own)


def test_bundles_under_two_dependencies(spark):
    """Groups of rows with three bundles, two attributes and equal levels, against all choices of rows."""
    rng = random.Random(5)
    data = [(i, i % 40, *[rng.choice([None, 1, 2, 3]) for _ in range(3)], rng.choice([None, "x", "y"]), rng.choice(["u", "v", None])) for i in range(200)]
    df = spark.createDataFrame(data, "id bigint, k bigint, a int, b int, c int, p string, q string")
    col = F.col
    bundles = [S.Bundle("one", col("a").isNotNull(), (col("a"),), col("a") * 1.0, {"p": col("p")}), S.Bundle("two", col("b").isNotNull(), (col("b"),), col("b") * 1.0, {"p": col("p"), "q": col("q")}, {"b": col("b")}), S.Bundle("three", col("c").isNotNull(), (col("c"),), col("c") * 1.0, {"q": col("q")})]
    got = {r.group_row_id: r for r in S.choose_bundles(df, col("k").cast("string"), "id", bundles).collect()}
    assert len(got) == 40
    for k in range(40):
        rows_of = [d for d in data if d[1] == k]
        best = 0
        for x, y, z in itertools.product(*[[None, *[d for d in rows_of if d[f] is not None]] for f in (2, 3, 4)]):
            ps, qs = {d[5] for d in (x, y) if d} - {None}, {d[6] for d in (y, z) if d} - {None}
            if len(ps) < 2 and len(qs) < 2:
                best = max(best, sum(d[f] for d, f in ((x, 2), (y, 3), (z, 4)) if d))
        r = got[min(d[0] for d in rows_of)]
        by = {d[0]: d for d in rows_of}
        chosen = [(by[i], f) for i, f in ((r.one_row_id, 2), (r.two_row_id, 3), (r.three_row_id, 4)) if i is not None]
        assert sum(d[f] for d, f in chosen) == best and r.b == (by[r.two_row_id][3] if r.two_row_id is not None else None)
        assert len({d[5] for d, f in chosen if f in (2, 3)} - {None}) < 2 and len({d[6] for d, f in chosen if f in (3, 4)} - {None}) < 2


def forms(code, rng):
    pieces = list(code)
    if rng.random() < 0.4:
        rng.shuffle(pieces)
        text = rng.choice([" ", ":", ", ", "/"]).join(pieces)
    else:
        text = rng.choice(["", " ", ":", "::", "-", "　", " #"]).join(pieces)
    return rng.choice([str.upper, str.lower, str])(rng.choice(["{}", "({})", '"{}"', "{}."]).format(text))


def test_identities_of_random_forms(spark):
    rng = random.Random(2)
    codes = [(a, n) for a in ("KLQN", "QLKN", "OMGU") for n in ("100", "101b", "1011")] + [("KLQN", "Wet", "100"), ("KLQN", "Twe", "100")]
    data, truth = [], {}
    for i in range(300):
        a, b = rng.choice(codes), rng.choice([None, ("HT", "7"), ("HT", "8")])
        fields = [forms(a, rng), forms(b, rng) if b else rng.choice([None, "", "unknown"])]
        rng.shuffle(fields)
        data.append((i, *fields))
        truth.setdefault((tuple(x.lower() for x in a), b), []).append(i)
    df = spark.createDataFrame(data, "row_id bigint, specimen_voucher string, isolate string")
    expected = {(g[0], x) for g in truth.values() for x in g[1:]}
    assert {tuple(r) for r in I.copies(df).collect()} == expected
    assert {tuple(r) for r in I.collapsed(df.repartition(7)).collect()} == {(g[0], len(g)) for g in truth.values()}


def test_identity_does_not_depend_on_other_rows(spark, rows):
    schema = "row_id bigint, specimen_voucher string, isolate string"
    two = [(1, "AB C 12", None), (2, "A BC 12", None)]
    assert rows(I.copies(spark.createDataFrame(two, schema))) == [(1, 2)]
    assert rows(I.copies(spark.createDataFrame([*two, (3, "A B C 12", None)], schema))) == [(1, 2), (1, 3)]
    for order in itertools.permutations([("ab c", "abc"), ("a bc", "abc"), ("c ab", "cab"), ("a c b", "acb"), ("cba", "cba"), ("d", "d")]):
        got: dict = {}
        for form, c in zip(order, I.classes(list(order))):
            got.setdefault(c, set()).add(form)
        assert sorted(map(len, got.values())) == [1, 5]
    assert not I.glued(["a"] * 200 + ["b"], ["a" * 199 + "bb"]) and I.glued(["a"] * 200 + ["b"], ["a" * 100 + "b" + "a" * 100])
    three = spark.createDataFrame([(1, "a 1", "b", "c"), (2, "C.", "1-A", "B"), (3, "c", "a1", None)], "row_id bigint, x string, y string, z string")
    assert rows(I.copies(three, fields=("x", "y", "z"))) == [(1, 2)]


def test_identity_edges(spark, rows):
    schema = "row_id bigint, specimen_voucher string, isolate string, root string, form string"
    df = spark.createDataFrame([(1, None, None, "r", "f"), (2, "", " ", "r", "f"), (3, "K.L.Q.N. 5", None, "r", "f"), (4, None, "klqn5", "r", "f"), (5, "KLQN 5", "HT 1", "r", "f"), (6, "x" * 30000 + "1", None, "r", "f"), (7, "X" * 30000 + " 1", None, "r", "f")], schema)
    assert rows(I.copies(df)) == [(3, 4), (6, 7)]
    assert I.copies(df.limit(0)).count() == 0
    assert rows(I.copies(spark.createDataFrame([(1, "a1", None), (1, "A 1", None)], "row_id bigint, specimen_voucher string, isolate string"))) == []
    assert I.glued(["ab", "1"], ["1ab"]) and not I.glued(["ab", "1"], ["ba1"]) and I.glued([], [])


def test_hot_groups_come_out_whole(spark):
    """A third of all rows in one identity, and in one specimen."""
    data = [(i, "KLQN 5" if i % 3 == 0 else f"OMGU {i}", None) for i in range(3000)]
    df = spark.createDataFrame(data, "row_id bigint, specimen_voucher string, isolate string").repartition(6)
    got = I.copies(df).collect()
    assert len(got) == 999 and {r.first_row_id for r in got} == {0}
    sizes = {r.first_row_id: r.n_rows for r in I.collapsed(df).collect()}
    assert sizes[0] == 1000 and len(sizes) == 2001
    rows_of = table(spark, [(i, "hot" if i % 3 else f"s{i}", "1.25 N 2.25 E" if i == 1000 else "1 N 2 E", ["Peru", "Chile: a", "Peru: a, b"][i % 3], ["Peru", "Chile"][i % 2], 1 + i % 28) for i in range(3000)])
    hot = [r for r in S.best_rows(rows_of).collect()]
    assert [(r.group_row_id, r.lat_lon_row_id) for r in hot] == [(1, 1000)] and hot[0].geo_row_id % 3 == 2
    one = [r for r in S.survivors(rows_of).collect() if r.n_rows > 1]
    assert len(one) == 1 and one[0].n_rows == 2000 and one[0].country == "Peru"
