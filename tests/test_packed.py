"""Packed fields: round trips, brute force over all segmentations, and the defined edge cases."""

from __future__ import annotations

import itertools
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from specimatrix.operators.packed import DELIMITERS, SPAN, atoms, lattice, longer_spans, posteriors, runs, scores, split_values, text_of, viterbi

SCHEMA = "row_id bigint, field_name string, cell string"


def split(spark, cells):
    df = spark.createDataFrame([(i, "f", c) for i, c in enumerate(cells)], SCHEMA)
    out = {}
    for r in split_values(df).collect():
        out.setdefault(r.row_id, []).append((r.pos, r.item))
    return {k: [i for _, i in sorted(v)] for k, v in out.items()}


def test_atoms_of_quoted_and_doubled_quotes():
    assert [a[0] for a in atoms('"16s; 5\' end" ; coi,,\'18s, partial\'')[0]] == ["16s; 5' end", "coi", "18s, partial"]
    assert [a[0] for a in atoms('28s;"18s ""mt"""')[0]] == ["28s", '18s "mt"']
    assert [a[0] for a in atoms("fwd_name: A::rev_name: B")[0]] == ["fwd_name: A", "rev_name: B"]
    assert atoms("")[0] == [] and atoms(" ;, ")[0] == []


value = st.text("abcxyz019 -_", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(value, st.booleans()), min_size=1, max_size=6), st.sampled_from([d for d in DELIMITERS if d != "\r"]))
def test_round_trip(values, delimiter):
    cell = delimiter.join(f'"{v};{v}"' if quoted else v for v, quoted in values)
    assert [a[0] for a in atoms(cell)[0]] == [f"{v};{v}" if quoted else v for v, quoted in values]


@settings(max_examples=60, deadline=None)
@given(st.lists(value, min_size=2, max_size=5), st.lists(st.floats(0.1, 50), min_size=30, max_size=30))
def test_lattice_against_all_segmentations(values, seen):
    cell = ",".join(values)
    found, gaps, spans = lattice(cell)
    n = len(found)
    w = scores(n, gaps, spans, seen[: len(spans)], 100.0, 0.1, {",": 0.7})
    weight = {s[:2]: x for s, x in zip(spans, w)}
    every = []
    for cuts in itertools.product((0, 1), repeat=n - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        parts = [(a, b - 1) for a, b in zip(edges, edges[1:])]
        every.append((sum(weight[p] for p in parts), parts))
    total = math.log(sum(math.exp(x) for x, _ in every))
    best = max(every)[0]
    assert abs(sum(w[k] for k in viterbi(n, spans, w)) - best) < 1e-9
    for (i, j, _), p in zip(spans, posteriors(n, spans, w)):
        brute = sum(math.exp(x - total) for x, parts in every if (i, j) in parts)
        assert abs(p - brute) < 1e-6


def test_values_of_cells(spark):
    cells = ["coi, 16s", "coi", "16s", '"coi; x"', "16s|coi", 'coi + "a, b"', "12s,,coi;", None, "", "  ", "16s\tcoi\n12s", "12s"]
    got = split(spark, cells)
    assert got == {0: ["coi", "16s"], 4: ["16s", "coi"], 5: ["coi", "a, b"], 6: ["12s", "coi"], 10: ["16s", "coi", "12s"]}


def test_a_value_that_contains_a_delimiter_is_learned(spark):
    names = ["Abba", "Blur", "Cream", "Doors", "Eels", "Free", "Genesis", "Heart", "Incubus", "Japan"]
    cells = [f'"AC/DC", {n}' for n in names] + [f"AC/DC; {n}" for n in names[:3]] + [f"{a}, {b}" for a, b in itertools.combinations(names, 2)]
    got = split(spark, cells)
    assert got[0] == ["AC/DC", "Abba"] and got[10] == ["AC/DC", "Abba"] and got[12] == ["AC/DC", "Cream"] and got[13] == ["Abba", "Blur"]


def test_edges(spark):
    assert split(spark, []) == {}
    df = spark.createDataFrame([(1, "f", "a,b", "x"), (1, "f", "a,b", "x")], SCHEMA + ", item string")
    assert split_values(df).count() == 4  # repeated rows; an extra column of the result's name
    long = ",".join(f"v{i}" for i in range(3000))
    assert len(split(spark, [long])[0]) == 3000


def test_a_value_of_many_atoms(spark):
    """Values are not bounded in length: one that the column has elsewhere stays whole."""
    names = [f"N{i}" for i in range(30)]
    longs = ("A/B/C/D/E/F", "G/H/I/J/K/L/M", "/".join(f"P{i}" for i in range(40)))
    cells = [f'"{long}";{n}' for long in longs for n in names] + [f"{long};{names[0]}" for long in longs]
    cells += [f"{a};{b}" for a, b in itertools.combinations(names[:12], 2)] + ["A/B;N1;C/D;N2;E/F;N3;G/H"]
    got = split(spark, cells)
    for k, long in enumerate(longs):
        assert got[90 + k] == [long, "N0"] and all(got[30 * k + i] == [long, n] for i, n in enumerate(names))


def test_longer_spans_against_brute_force(spark):
    import random

    rng, cells = random.Random(6), set()
    while len(cells) < 60:
        part = rng.choice(["a,b,c,d,e,f,g,h,i,j,k,l,m,n", "q,r,s,t,u,v,w,x", "a,b,c,d,e,f,g"])
        cells.add(rng.choice(["{}", "z,{}", '"{}";y', "{},{}", "o,{};1,2,3"]).format(part, part) + f";{rng.randint(0, 30)}")
    df = spark.createDataFrame([("f", c) for c in cells], "field_name string, cell string")
    got = {(r.cell, x.i, x.j) for r in longer_spans(df).collect() for x in r.longer}
    seen: dict = {}
    for c in cells:
        for text, part, first in runs(c):
            for i in range(len(part)):
                for j in range(i + SPAN, len(part)):
                    seen.setdefault(text_of(text, part, i, j), []).append((c, first + i, first + j) if first >= 0 else None)
    assert got == {x for places in seen.values() if len(places) > 1 for x in places if x} and len(got) > 100


def test_hot_cell_and_key(spark):
    cells = ["coi, 16s"] * 300 + [f"coi, m{i}" for i in range(40)] + ["12s"]
    got = split(spark, cells)
    assert len(got) == 340 and got[0] == ["coi", "16s"] and got[299] == ["coi", "16s"] and got[305] == ["coi", "m5"]
