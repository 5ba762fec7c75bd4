"""Marker mapping against brute-force edit distance, and name linking on made-up people."""

from __future__ import annotations

import random

from specimatrix.llm import markers as K
from specimatrix.llm import names as N

FULL = {"mtgenome": "complete or near-complete mitochondrial genome", "coi": "cytochrome c oxidase subunit I", "16s": "16S ribosomal RNA, mitochondrial large subunit", "12s": "12S ribosomal RNA, mitochondrial small subunit", "cob": "cytochrome b", "cox2": "cytochrome c oxidase subunit II", "cox3": "cytochrome c oxidase subunit III", "18s": "18S ribosomal RNA, nuclear small subunit", "28s": "28S ribosomal RNA, nuclear large subunit", "its1-its2": "internal transcribed spacers 1 and 2 with 5.8S", "18-28s": "whole nuclear ribosomal cluster running from 18S through 28S", "ef-1": "elongation factor 1 alpha", "h3": "histone H3"}
TRIE = K.Trie(K.spellings(sorted(FULL.items())))
LISTED = "marker_id int, marker string, full_name string"
FINAL = "row_id bigint, definition string, organism string"
ASSIGNED = "row_id bigint, gene_type string"


def test_spellings():
    for text, found in [
        ("CO1", ["coi"]), ("cyt. c oxidase sub. I", ["coi"]), ("16SrRNA", ["16s"]), ("EF1Α", ["ef-1"]), ("cty ox III", ["cox3"]), ("cyt ox II", ["cox2"]), ("mitochondrail genome", ["mtgenome"]), ("ITS regoin", ["its1-its2"]), ("18S-ITS-28S", ["18-28s"]), ("coi, partial", ["coi"]),
        ("gene for subunit I of cytochrome c oxidase", ["coi"]), ("nuclear rDNA operon (18S-ITS1-5.8S-ITS2-28S)", ["18-28s"]), ("mitochondrial gene for 16S rRNA; mitochondrial", ["16s"]), ("COI and 16S rRNA", ["coi", "16s"]),
        ("cytochrome c gene", []), ("elongation factor 2", []), ("histone H4", []), ("cox4", []), ("cyt P450", []), ("12 kDa binding protein", []), ("", []), ("???", []), ("word " * 3000 + "coi", ["coi"]),
    ]:
        assert sorted(K.denoted(TRIE, text)) == sorted(found), text


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_every_single_error_in_long_words():
    rng, trie, known = random.Random(4), TRIE, K.spellings(sorted(FULL.items()))
    long = sorted(s for s in known if K.within(s) == 1 and all(w.isalpha() and len(w) > 2 for w in s.split()))
    for _ in range(150):
        s = rng.choice(long)
        i = rng.choice([k for k in range(1, len(s) - 1) if s[k - 1 : k + 2].isalpha()])
        bad = rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + "q" + s[i + 1 :], s[: i - 1] + s[i] + s[i - 1] + s[i + 1 :]])
        hits = {(h[1], h[3]): h[2] for h in trie.near(bad, 0)}
        assert any(end == len(bad) and e <= 1 for (end, _), e in hits.items()), (s, bad)
        for start, end, e, _ in trie.near(bad, 0):
            assert min(distance(x, bad[start:end]) for x in known) <= e


def test_map_markers(spark, rows):
    listed = spark.createDataFrame([(i, m, f) for i, (m, f) in enumerate(FULL.items())] + [(99, None, "x"), (1, "coi", None)], LISTED)
    final = spark.createDataFrame([(1, "Aus bus isolate 18S-586 COI gene", "Aus bus"), (2, "Aus bus voucher H3:12 actin", "Aus cf. bus"), (3, None, None), (4, "", None), (5, "coi", None)], FINAL + "")
    assigned = spark.createDataFrame([(1, 'coi; "16s, partial" ; actin'), (2, "mtgenome,coi"), (3, None), (4, " "), (5, "COI / CO1")], ASSIGNED)
    expected = [(1, "definition", "coi"), (1, "gene_type", "16s"), (1, "gene_type", "coi"), (1, "gene_type", "unmatched"), (2, "definition", "unmatched"), (2, "gene_type", "coi"), (2, "gene_type", "mtgenome"), (4, "definition", "unmatched"), (5, "definition", "coi"), (5, "gene_type", "coi")]
    assert rows(K.map_markers(final, assigned, listed)) == expected
    few = K.map_markers(final.where("row_id = 5"), assigned.where("row_id = 5"), listed.where("marker = '16s'"))
    assert rows(few) == [(5, "definition", "unmatched"), (5, "gene_type", "unmatched")]
    assert K.map_markers(final.limit(0), assigned.limit(0), listed).count() == 0
    twice = final.where("row_id = 5")
    assert K.map_markers(twice.unionAll(twice), assigned.limit(0), listed).count() == 2


def test_entries_come_from_the_list(spark, rows):
    """Entries that nothing in the library knows are found by name, by full name and with an error, and by given aliases."""
    listed = spark.createDataFrame([(1, "nad5", "NADH dehydrogenase subunit 5"), (2, "coi", None), (3, "h4", "histone H4"), (4, "h4b", "histone H4")], LISTED)
    cells = ["nad5", "nad 5", "NADH dehydrogenase subunit 5", "NADH dehydrogenase subunit V", "NADH dehydrogenas subunti 5 gene", "nadh dehydrogenase subunit 6", "coi", "CO1", "cytb", "histone H4", "trnK gene"]
    assigned = spark.createDataFrame(list(enumerate(cells)), ASSIGNED)
    got = rows(K.map_markers(spark.createDataFrame([], FINAL), assigned, listed), "row_id", "marker")
    want = {0: ["nad5"], 1: ["nad5"], 2: ["nad5"], 3: ["nad5"], 4: ["nad5"], 6: ["coi"], 7: ["coi"], 9: ["h4", "h4b"]}
    assert got == sorted(((i, m) for i in range(len(cells)) for m in want.get(i, ["unmatched"])), key=str)
    given = K.map_markers(spark.createDataFrame([], FINAL), assigned, listed, {"trnk gene": "nad5"})
    assert {(r.row_id, r.marker) for r in given.collect()} >= {(10, "nad5"), (7, "unmatched"), (2, "nad5")}


def test_every_spelling_within_its_distance_is_returned():
    """The automaton's hits against edit distances of all spellings to all beginnings that end at a word's end."""
    rng = random.Random(12)
    words = ["annel", "setal", "gill", "nerve", "chaeta", "elong"]
    known = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))): (str(i),) for i in range(25)}
    trie = K.Trie(known)
    for _ in range(60):
        text = rng.choice(sorted(known))
        for _ in range(rng.randint(0, 2)):
            i = rng.choice([k for k in range(1, len(text) - 1) if text[k - 1 : k + 2].isalpha()])
            text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
        text += " tail"
        ends = [i for i in range(1, len(text) + 1) if i == len(text) or text[i] == " "]
        want = {}
        for s, entry in known.items():
            for end in ends:
                if s.count(" ") == text[:end].count(" ") and s[0] == text[0]:
                    e = sum(distance(a, b) for a, b in zip(s.split(" "), text[:end].split(" ")))
                    if e <= K.within(s) and all(a[0] == b[0] for a, b in zip(s.split(" "), text[:end].split(" "))):
                        want[end, entry] = e
        got = {(end, entry): e for _, end, e, entry in trie.near(text, 0)}
        assert all(got.get(k, 9) <= e for k, e in want.items()), (text, want, got)


PEOPLE = {
    "margaret": ["Margaret Jonanesksen", "Jonanesksen, Margaret C.", "M. Jonanesksen", "Jonanesksen MC", "M. C. Jonanesksen", "margaret jonanesksen", "Margaret (Peggy) Jonanesksen", "Peggy Jonanesksen", "JONANESKSEN, Margaret", "Dr. Margaret Jonanesksen", "Margaret Jonánesksen", "Mar. Jonanesksen", "Jonanesksen Margaret", "M. Jnanesksen", "Margaret Jonaneskesn", "Margaert Jonanesksen"],
    "oskar": ["Oskar Jonanesksen", "Jonanesksen, O.", "O.Jonanesksen"],
    "boris": ["Boris Wivalkovuti", "Wivalkovuti, B.", "Prof B. Wivalkovuti"],
    "museum": ["Museum of Natural Objects, Dralovasen", "Dralovasen Museum of Natural Objects", "Dralovasen Mus. Nat. Obj.", "MNO (Dralovasen)", "Dralovasen MNO", "The Dralovasen Museum of Natural Objects", "MUSEUM OF NATURAL OBJECTS, DRALOVASEN", "Museum of Naturral Objects, Draolvasen"],
    "station": ["Coastal Research Station, Tonditenberg", "Coast. Res. Stn Tonditenberg", "Tonditenberg Coast. Res. Stn", "CRS Tonditenberg"],
    "other": ["Museum of Natural Objects, Zindanolova", "Zindanolova MNO"],
}


def test_linked_names(spark):
    names = [n for group in PEOPLE.values() for n in group]
    final = spark.createDataFrame([(n, m) for n, m in zip(names, reversed(names))] + [("unknown", None), ("", "-"), (None, "  ")], "collected_by string, identified_by string")
    got = {tuple(r) for r in N.same_names(final).collect()}
    expected = {tuple(sorted((a, b), key=lambda s: s.encode())) for g in PEOPLE.values() for i, a in enumerate(g) for b in g[i + 1 :]}
    assert got == expected
    canonical = {r.name: r.canonical for r in N.canonical_names(final).collect()}
    assert len(set(canonical.values())) == len(PEOPLE) and set(canonical) == set(names)


def test_titles_that_are_given_names(spark):
    """Beside a surname alone, what looks like a title is a given name or initials."""
    names = ["Ingrid Zematesksen", "Zematesksen, Ingrid", "Ing. Zematesksen", "I. Zematesksen", "Zematesksen, D. R.", "Daniela Zematesksen", "Zematesksen DR", "Dr. Daniela Zematesksen"]
    got: dict = {}
    for r in N.canonical_names(spark.createDataFrame([(n, None) for n in names], "collected_by string, identified_by string")).collect():
        got.setdefault(r.canonical, set()).add(r.name)
        assert r.links == 3
    assert sorted(map(sorted, got.values())) == [sorted(names[4:]), sorted(names[:4])]


def test_distortion():
    """Log-likelihoods against the least number of errors, and what they are made of."""
    c = N.Channel()
    assert N.distortion("hesopituti", "hesoiptuti") == c.usual and N.distortion("hesopituti", "heesopituti") == c.usual and N.distortion("hesopituti", "hespituti") == c.usual
    assert N.distortion("hesopituti", "hesoxituti") == c.rare and N.distortion("hesopituti", "ehsopituti") == c.usual + c.head
    assert abs(N.distortion("hesopituti", "heosiptuti") - 2 * c.usual - c.second) < 1e-9 and N.distortion("hesopituti", "heosiptui") == -float("inf")
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 8)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice([[], [b[i], b[i]], ["d"], [b[i], "d"]])
        if not b or abs(len(a) - len(b)) > 2:
            continue
        e, ll = distance(a, "".join(b)), N.distortion(a, "".join(b))
        assert (ll > -float("inf")) == (e <= 2) and (ll == 0) == (e == 0)


def test_spellings_with_two_errors_and_long_chains(spark):
    words = [("hesopituti", 9), ("heosiptuti", 1), ("hespittuti", 1), ("zzzzzzzzzz", 1)]
    df = spark.createDataFrame([("p", w, f, f) for w, f in words], "block string, word string, forms bigint, n bigint")
    assert {r.word: r.root for r in N.attach(df, 5).collect()} == {"hesopituti": "hesopituti", "heosiptuti": "hesopituti", "hespittuti": "hesopituti", "zzzzzzzzzz": "zzzzzzzzzz"}
    chain = ["q" * k + "abcdefg" for k in range(1, 21)]
    df = spark.createDataFrame([("p", w, 3**k, 1) for k, w in enumerate(chain)], "block string, word string, forms bigint, n bigint")
    assert {r.root for r in N.attach(df, 5, N.Channel(long=99)).collect()} == {chain[-1]}


def test_name_edges(spark):
    empty = spark.createDataFrame([], "collected_by string, identified_by string, name string, entity string")
    assert N.same_names(empty).count() == 0
    odd = spark.createDataFrame([("123", "?!", "a", "b"), ("Solo", "Solo", "a", "b"), ("x" * 4000, None, "a", "b")], empty.schema)
    assert N.same_names(odd).count() == 0


def test_known_words_that_are_errors_in_their_place():
    for text, entry in [("cytochrom oxidase 1", "coi"), ("rdna gene cluster", "18-28s"), ("ribosomal dna gene cluster", "18-28s"), ("rna operon", "18-28s"), ("16s ribosomal rna gene", "16s"), ("cytochrome c oxidase subunit I (COI) gene, partial cds; mitochondrial", "coi")]:
        assert K.denoted(TRIE, text) == (entry,), text
