"""Packing, mixing and subjects on small corpora."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from specimatrix.llm import mixing, packing, subjects, tokens

PLACES = "container_kind string, capacity_tokens int"
DOCS = "doc_id bigint, text string, source string, lang string, tokens bigint"


def test_pack_within_limits_and_near_the_bound():
    rng = np.random.default_rng(0)
    demand = np.stack([rng.integers(1, 60, 400), np.ones(400), rng.integers(0, 50, 400)], axis=1).astype(float)
    limits = np.array([100.0, 12.0, 98.0])
    where = packing.pack(demand, limits)
    total = np.stack([np.bincount(where, weights=demand[:, d]) for d in range(3)], axis=1)
    assert (total <= limits).all() and (where >= 0).all()
    assert where.max() + 1 <= math.ceil((demand / limits).sum(axis=0).max()) * 1.05 + 1


def test_pack_against_all_assignments():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randint(1, 9) for _ in range(6)]
        demand = np.array([[s, 1.0] for s in sizes], dtype=float)
        got = packing.pack(demand, np.array([10.0, 3.0])).max() + 1
        best = min(len(set(a)) for a in itertools.product(range(6), repeat=6) if all(sum(s for s, x in zip(sizes, a) if x == b) <= 10 and a.count(b) <= 3 for b in set(a)))
        assert got <= best + 1


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", "en", -1) for i, t in enumerate(texts)], DOCS)


def test_containers_hold_every_token_once(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["worm", "sea", "gill. ", "palp"]) for _ in range(rng.randint(0, 120))) for _ in range(150)] + [None, "", "mud " * 900, "same text", "same text"]
    df = docs(spark, texts)
    kinds = spark.createDataFrame([("tiny", 64), ("big", 256), ("none", 0), (None, 5)], PLACES)
    packed = packing.fill_containers(df, kinds).collect()
    sizes = {r.doc_id: r.tokens for r in tokens.sized(df).collect()}
    assert None not in sizes and sizes[151] == 0 and sizes[152] > 800
    for kind, capacity in (("tiny", 64), ("big", 256)):
        mine = [r for r in packed if r.container_kind == kind]
        for i, n in sizes.items():
            parts = sorted((r for r in mine if r.doc_id == i), key=lambda r: r.piece)
            assert sum(r.tokens for r in parts) == n and [r.start_token for r in parts] == [sum(p.tokens for p in parts[:k]) for k in range(len(parts))]
            assert len(parts) == 1 or n > capacity * packing.PackLimits().loss_share
        bins = {}
        for r in mine:
            b = bins.setdefault(r.container_id, [0, 0, 0])
            b[0] += r.tokens
            b[1] += 1
            b[2] += r.loss_tokens
        assert all(b[0] <= capacity and b[1] <= capacity // 8 and b[2] <= capacity * 0.98 for b in bins.values())
    report = {r.container_kind: r for r in packing.filling(packing.fill_containers(df, kinds), kinds).collect()}
    assert report["tiny"].filled > 0.75 and report["big"].filled > 0.9 and report["tiny"].containers >= report["tiny"].least_containers
    assert packing.fill_containers(df.limit(0), kinds).count() == 0 and packing.fill_containers(df, kinds.limit(0)).count() == 0


def test_a_text_that_fits_the_capacity_is_whole(spark):
    texts = ["one\n" + "mud " * k for k in range(50, 75)] + ["one two"] * 40
    df, kinds = docs(spark, texts), spark.createDataFrame([("tiny", 64)], PLACES)
    packed = packing.fill_containers(df, kinds).collect()
    sizes = {r.doc_id: r for r in tokens.sized(df).collect()}
    over = {i for i, r in sizes.items() if r.tokens <= 64 and r.tokens - r.prompt_tokens > 62}
    assert over and all((r.parts == 1) == (sizes[r.doc_id].tokens <= 64) for r in packed)
    bins: dict = {}
    for r in packed:
        bins.setdefault(r.container_id, []).append(r)
    for b in bins.values():
        assert sum(r.tokens for r in b) <= 64 and len(b) <= 8
        assert sum(r.loss_tokens for r in b) <= 62 or sum(r.loss_tokens > 0 for r in b) == 1 and over & {r.doc_id for r in b}
    assert sum(r.tokens for r in packed) == sum(r.tokens for r in sizes.values())


def test_first_part():
    assert tokens.first_part("Head line\nrest") == "Head line" and tokens.first_part("One. Two.") == "One." and tokens.first_part("") == ""


def corpus(spark):
    rng = random.Random(9)
    words = {"a": ["worm", "gill", "palp", "seta"], "b": ["court", "permit", "clause", "treaty"], "c": ["loop", "parser", "cache", "build"]}
    rows = []
    for i in range(600):
        s = rng.choices("abc", (8, 3, 1))[0]
        rows.append((i, " ".join(rng.choice(words[s]) for _ in range(rng.randint(5, 60))), s if i % 10 else None, "en", -1))
    return spark.createDataFrame(rows + [(1000, None, "a", "en", 0), (1001, "", "a", "en", 0), (1002, "worm", "unlisted", "en", 0)], DOCS)


def test_mix_reaches_its_shares(spark):
    df = corpus(spark)
    target = spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 2), ("c", 0.2, 3), (None, 0.5, 1), ("d", 0.0, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, target)
    got = {r.source: r for r in mixing.shares(mixed, target).collect()}
    for s, share, most in (("a", 0.4, 2), ("b", 0.4, 2), ("c", 0.2, 3)):
        assert abs(got[s].share - share) < 0.02 and got[s].most_copies <= most
    assert {r.doc_id for r in mixed.collect()}.isdisjoint({1000, 1001})
    assert mixing.mix(df.limit(0), target).count() == 0 and mixing.mix(df, target.limit(0)).count() == 0


def test_hidden_and_wrong_sources_are_mixed_by_their_words(spark):
    """A third of the sources is not stated, and some are wrong: the shares of the true sources still meet their targets."""
    rng = random.Random(2)
    words = {"a": ["worm", "gill", "palp", "seta"], "b": ["court", "permit", "clause", "treaty"], "c": ["loop", "parser", "cache", "build"]}
    rows, truth = [], {}
    for i in range(3000):
        s = rng.choices("abc", (5, 3, 2))[0]
        truth[i] = s
        stated = rng.choice([None, "?", s]) if i % 2 else s if rng.random() > 0.03 else rng.choice("abc")
        rows.append((i, " ".join(rng.choice(words[s] + ["and", "the", "of"]) for _ in range(rng.randint(8, 60))), stated, "en", -1))
    df = spark.createDataFrame(rows, DOCS)
    share = {"a": 0.3, "b": 0.4, "c": 0.3}
    mixed = mixing.mix(df, spark.createDataFrame([(s, x, 3) for s, x in share.items()], "source string, target_share double, max_repeats int")).collect()
    total = sum(r.tokens * r.copies for r in mixed)
    for s, x in share.items():
        assert abs(sum(r.tokens * r.copies for r in mixed if truth[r.doc_id] == s) / total - x) < 0.015
    hidden = [r for r in mixed if rows[r.doc_id][2] in (None, "?")]
    assert len(hidden) > 500 and sum(r.source == truth[r.doc_id] for r in hidden) / len(hidden) > 0.99
    assert all(r.source == rows[r.doc_id][2] for r in mixed if rows[r.doc_id][2] in share)


def test_judged_labels(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["worm gill palp", "court permit clause"][i % 2].split() + ["the"]) for _ in range(30)), ("ab"[i % 2] if rng.random() > 0.1 else "ab"[1 - i % 2])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    model = mixing.MixModel()
    sample = mixing.labelled_sample(df, ["a", "b"], model)
    soft, wrong = mixing.judge(sample, mixing.fit_sources(sample, ["a", "b"], model), ["a", "b"], model)
    few = mixing.labelled_sample(df, ["a", "b"], mixing.MixModel(labelled=500)).count()
    assert 0.03 < wrong < 0.2 or soft > 1 and abs(few - 500) < 100
    assert mixing.membership(np.array([0.01, 0.99]), 0, 0.1)[1] > 0.5 > mixing.membership(np.array([0.4, 0.6]), 0, 0.1)[1] and mixing.membership(np.array([0.2, 0.8]), None, 0.1)[1] == 0.8


def test_rates_solve_the_least_squares_problem():
    rng = np.random.default_rng(5)
    n = rng.integers(10, 100, 300).astype(float)
    p = rng.dirichlet([0.2, 0.2, 0.2], 300)
    there, share, repeats = n @ p, np.array([0.5, 0.3, 0.2]), np.array([2.0, 2.0, 3.0])
    goal = share * (there * repeats / share).min() * 0.8
    steps = mixing.descend(n, p, repeats, goal, mixing.MixModel(steps=200))
    r = mixing.rates(p, p @ repeats, steps, 0.9)
    assert np.abs((r * n) @ p - goal).max() < 0.01 * goal.sum() and (r >= 0).all() and (r <= p @ repeats + 1e-9).all()


TEXT = {
    "law": "The {0} court upheld the permit. A {0} treaty clause binds the ministry. The permit expired before the {0} court. The clause of the treaty names the permit.",
    "software": "The {0} parser throws in the loop. A {0} cache returns the build. The loop fills the cache of the {0} parser. The build breaks the loop.",
    "health": "The {0} patient had fever. A {0} nurse treated the wound. The wound of the {0} patient swelled. The nurse noted the fever.",
}


def test_subjects(spark):
    rng = random.Random(8)
    rows, labels, truth = [], [], {}
    for i in range(240):
        wanted = rng.sample(sorted(TEXT), rng.choice([1, 1, 2]))
        lines = [s + "." for w in wanted for s in rng.sample(TEXT[w].rstrip(".").format(rng.choice(["old", "new", "third"])).split(". "), rng.choice([2, 3]))]
        if len(wanted) == 1 and i % 4 == 0:  # a passing sentence
            other = rng.choice([t for t in TEXT if t not in wanted])
            lines.insert(0, TEXT[other].format("new").split(". ")[0] + ".")
        lines.insert(rng.randint(0, len(lines)), "Thanks to everyone involved.")
        rows.append((i, " ".join(lines), "s", rng.choice(["en", "EN", None]), 0))
        truth[i] = set(wanted)
        if i % 3 == 0:
            labels += [(i, w, "r1") for w in wanted]
    rows += [(900, None, "s", "en", 0), (901, "", "s", "en", 0), (902, "The court upheld the permit.", "s", "en", 0), (903, "12 34", "s", "xx", 0)]
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(0, "nonsense", "r2"), (99999, "law", "r1"), (3, "none", "r2")], "doc_id bigint, subject string, reader string")
    listed = spark.createDataFrame([(1, "law"), (2, "software"), (3, "health")], "subject_id int, subject string")
    model = subjects.SubjectModel(cells=4096, iterations=3, free_topics=1, smooth=20.0)
    got: dict = {}
    for r in subjects.assign_subjects(df, lab, listed, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right / len(truth) > 0.9 and got.get(902) == {"law"} and not {900, 901, 903} & set(got)
    assert subjects.assign_subjects(df, lab, listed.limit(0), model).count() == 0
    more = listed.unionAll(spark.createDataFrame([(4, "sport"), (4, "law"), (None, None)], listed.schema))  # without labels; listed twice
    assert {(r.doc_id, r.subject) for r in subjects.assign_subjects(df, lab, more, model).collect()} == {(i, s) for i, g in got.items() for s in g}
    assert subjects.assign_subjects(df.limit(0), lab, listed, model).count() == 0
    assert subjects.assign_subjects(df, lab.limit(0), listed, model).count() == 0


def test_subjects_of_rare_languages(spark):
    """Documents of languages beyond the most frequent one are fitted and assigned too."""
    turned = str.maketrans("abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")
    rng, rows, labels, truth = random.Random(4), [], [], {}
    for i in range(300):
        s = rng.choice(sorted(TEXT))
        lines = rng.sample(TEXT[s].rstrip(".").format(rng.choice(["old", "new"])).split(". "), 3)
        rare = i % 5 == 0
        rows.append((i, ". ".join(x.lower().translate(turned).capitalize() if rare else x for x in lines) + ".", "s", ("de" if i % 2 else "fr") if rare else rng.choice(["en", None]), 0))
        truth[i] = s
        labels += [(i, s, "r1")] if rng.random() < 0.4 else []
    listed = spark.createDataFrame([(1, "law"), (2, "software"), (3, "health")], "subject_id int, subject string")
    model = subjects.SubjectModel(cells=4096, iterations=3, free_topics=1, smooth=20.0, languages=1)
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, reader string")
    got: dict = {}
    for r in subjects.assign_subjects(spark.createDataFrame(rows, DOCS), lab, listed, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == {s} for i, s in truth.items() if i % 5 == 0) > 50 and sum(got.get(i) == {s} for i, s in truth.items()) > 280


def test_a_subject_of_one_sentence_only_in_a_text_of_such():
    counts = np.array([[1, 0], [1, 0], [1, 1], [1, 1], [2, 1], [2, 0], [0, 0]])
    got = subjects.decide(counts, np.array([1, 9, 2, 5, 3, 9, 1]))
    assert got.tolist() == [[True, False], [False, False], [True, True], [False, False], [True, False], [True, False], [False, False]]


def test_sentences_and_digamma():
    assert subjects.sentences("One toge-\nther. Two <b>x</b>!\n\nThree") == ["One together.", "Two  x !", "Three"]
    begins = np.zeros(64, dtype=bool)
    begins[subjects.cell("The", 64)] = True
    assert subjects.divided("near Old Point The worm", begins) == ["near Old Point ", "The worm"]
    assert subjects.divided("gel (n = 80)  The worm", begins) == ["gel (n = 80)  ", "The worm"]
    x = np.array([0.01, 0.5, 1.0, 7.3])
    h = 1e-5
    assert np.allclose(subjects.digamma(x), [(math.lgamma(v + v * h) - math.lgamma(v - v * h)) / (2 * v * h) for v in x], rtol=1e-4)


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p6_found", "p9_found"])
def test_columns_of_the_found_queries(spark, name):
    from pathlib import Path

    from specimatrix.llm.queries import QUERIES

    base = "/root/testdata/sf0.001"
    if not Path(base).exists():
        pytest.skip("the driver's tables are not here")
    columns = {"p1_found": ["group_row_id", "lat_lon_row_id", "geo_row_id"], "p3_found": ["row_id", "field_name", "marker"], "p4_found": ["name_a", "name_b"], "p6_found": ["first_row_id", "copy_row_id"], "p9_found": ["doc_id", "subject"]}[name]
    df = QUERIES[name](spark, base)
    assert df.columns == columns
    got = df.collect()
    assert got and len(got) == len(set(got))
