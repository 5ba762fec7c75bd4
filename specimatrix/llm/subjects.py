"""Subject areas of documents from a latent Dirichlet topic model.

The model is fitted by variational expectation-maximisation over all documents. A sentence is the unit that a topic
generates, so that a document's topic proportions count sentences. Words are hashed into a fixed number of cells: every
word counts and the model's size does not depend on the corpus. Some topics start from the words of documents that
readers labelled, others are free; after fitting, each topic's top terms decide which subject it stands for, if any.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimatrix.session import cut, fixed_rows, width


@dataclass(frozen=True)
class SubjectModel:
    """Parameters. ``labelled`` bounds the labelled documents that seed topics and name them (the lowest ids are taken)."""

    cells: int = 1 << 15
    languages: int = 12  # the most frequent ones that `lang` names have topics of their own; all others share theirs
    language_share: float = 0.005  # of the documents, for topics of its own
    free_topics: int = 2  # for each language
    iterations: int = 4
    inner: int = 4
    alpha: float = 0.04
    alpha_free: float = 0.17
    eta: float = 0.02
    smooth: float = 200.0
    top_terms: int = 30
    labelled: int = 20_000
    sure: float = 0.5
    opener: float = 0.8  # share of a capitalised word's uses that begin sentences, above which it begins one anywhere


_BROKEN = re.compile(r"(\w)-\s*\n\s*(\w)")
_TAG = re.compile(r"<[^<>\n]{1,200}>|&[a-z]{2,8};")
_END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\s*\n+\s*")
_WORD = re.compile(r"[^\W\d_]{3,}")


def sentences(text: str) -> list[str]:
    """The sentences of a text: markup and line-end hyphens removed, split at line ends and after full stops."""
    plain = _TAG.sub(" ", _BROKEN.sub(r"\1\2", text))
    return [s for s in _END.split(plain) if s.strip()]


def words(sentence: str) -> list[str]:
    """Lower case words of three letters or more."""
    return _WORD.findall(sentence.lower())


def cell(word: str, cells: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word) % cells


_LEAD = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"(?<=[\w)]) +(?=[^\W\d_a-z])([^\W\d_]+)")


def openers(texts: list[str], cells: int) -> np.ndarray:
    """How often the words of each cell begin a sentence, and how often they stand capitalised within one (cells x 2)."""
    first, within = Counter(), Counter()
    for t in texts:
        for s in sentences(t or ""):
            if (m := _LEAD.match(s)) and m[0][0].isupper():
                first[m[0]] += 1
            within.update(w for w in _CAPITAL.findall(s) if w[0].isupper())
    out = np.zeros((cells, 2), dtype=np.int64)
    for k, counts in enumerate((first, within)):
        for w, n in counts.items():
            out[cell(w, cells), k] += n
    return out


def divided(sentence: str, begins: np.ndarray) -> list[str]:
    """The sentences that a missing full stop ran together: divided before words that nearly always begin one."""
    cuts = [m.start(1) for m in _CAPITAL.finditer(sentence) if m[1][0].isupper() and begins[cell(m[1], len(begins))]]
    return [sentence[a:b] for a, b in zip([0, *cuts], [*cuts, len(sentence)])]


def bags(texts: list[str], cells: int, begins: np.ndarray | None = None) -> list[list[list[int]]]:
    """Texts -> sentences -> distinct cells of their words."""
    known: dict[str, int] = {}

    def at(w: str) -> int:
        if (c := known.get(w)) is None:
            c = known[w] = cell(w, cells)
        return c

    whole = (lambda s: [s]) if begins is None else (lambda s: divided(s, begins))
    return [[b for s in sentences(t or "") for d in whole(s) if (b := sorted({at(w) for w in words(d)}))] for t in texts]


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log-gamma function for positive x: recurrence up to six, then the asymptotic series."""
    shift = np.zeros_like(x)
    x = x.copy()
    while (low := x < 6).any():
        shift -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


@dataclass(frozen=True)
class Words:
    """Documents as flat arrays: the cell and the sentence of each word, the document of each sentence."""

    cells: np.ndarray
    of: np.ndarray
    doc: np.ndarray
    documents: int


def flat(batches, most: int = 200):
    """(rows of a batch, their words), of at most ``most`` documents, so that memory stays bounded."""
    for b in batches:
        for a in range(0, b.num_rows, most):
            part = b.slice(a, most)
            cells, lengths = part.column("cells"), part.column("lengths")
            sizes = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = pc.list_value_length(lengths).to_numpy(zero_copy_only=False).astype(np.int64)
            words_of = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part, Words(words_of, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(part.num_rows), counts), part.num_rows)


def expect(w: Words, log_beta: np.ndarray, alpha: np.ndarray, inner: int) -> np.ndarray:
    """Topic probabilities of every sentence given the topics (cells x topics)."""
    cells, of, doc = w.cells, w.of, w.doc
    k = log_beta.shape[1]
    like = np.zeros((len(doc), k))
    if len(cells):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a in range(0, len(starts), 2000):  # in slices, so that memory does not follow a text's length
            part = starts[a : a + 2000]
            stop = starts[a + 2000] if a + 2000 < len(starts) else len(cells)
            like[of[part]] = np.add.reduceat(log_beta[cells[part[0] : stop]], part - part[0], axis=0)
    gamma = np.tile(alpha, (w.documents, 1)) + 1.0
    phi = np.zeros_like(like)
    for _ in range(inner):
        logit = like + digamma(gamma)[doc]
        logit -= logit.max(axis=1, keepdims=True) if len(logit) else 0
        phi = np.exp(logit)
        phi /= phi.sum(axis=1, keepdims=True) if len(phi) else 1
        gamma = np.tile(alpha, (w.documents, 1))
        add_rows(gamma, doc, phi)
    return phi


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray, of: np.ndarray | None = None) -> None:
    """``total[at] += rows[of]`` (``rows`` if ``of`` is None) with repeated ``at``: column by column, without a copy of all rows."""
    if len(at):
        used, where = np.unique(at, return_inverse=True)
        for k, column in enumerate(np.ascontiguousarray(rows.T)):
            total[used, k] += np.bincount(where, weights=column if of is None else column[of], minlength=len(used))


def _slices(frames, most: int = 200):
    for f in frames:
        for a in range(0, len(f), most):
            yield f.iloc[a : a + most]


def _language(lang) -> str:
    code = (lang or "").lower().split("-")[0]
    return code if len(code) == 2 and code.isascii() and code.isalpha() and code not in ("xx", "zz") else ""


def count_openers(documents: DataFrame, model: SubjectModel) -> np.ndarray:
    """Which cells' words begin a sentence wherever they are capitalised; counted over all documents."""

    def part(frames):
        out = np.zeros((model.cells, 2), dtype=np.int64)
        for f in frames:
            out += openers(f["text"].tolist(), model.cells)
        used = np.flatnonzero(out.any(axis=1))
        yield pd.DataFrame({"cell": used, "begins": out[used, 0], "within": out[used, 1]})

    found = documents.select("text").mapInPandas(part, "cell int, begins bigint, within bigint").groupBy("cell").agg(F.sum("begins").alias("begins"), F.sum("within").alias("within"))
    begins = np.zeros(model.cells, dtype=bool)
    for r in found.where((F.col("begins") >= 5) & (F.col("begins") > model.opener * (F.col("begins") + F.col("within")))).select("cell").collect():  # at most one row for each cell
        begins[r.cell] = True
    return begins


def _counts(df: DataFrame, values, columns: int, model: SubjectModel) -> np.ndarray:
    """Sums over all rows of ``values(rows, words, total)``, which adds to cells x columns; a fixed number of rows comes to the driver."""
    names = [f"v{i}" for i in range(columns)]

    def part(batches):
        total = np.zeros((model.cells, columns))
        for rows, w in flat(batches):
            values(rows, w, total)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, i]) for i in range(columns)]], names=["cell", *names])

    schema = "cell int, " + ", ".join(f"{n} double" for n in names)
    found = df.mapInArrow(part, schema).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((model.cells, columns))
    out[found["cell"].to_numpy()] = found[names].to_numpy()
    return out


def name_topics(beta: np.ndarray, profiles: np.ndarray, frequency: np.ndarray, top_terms: int) -> np.ndarray:
    """The subject (column of ``profiles``) of each topic (column of ``beta``), -1 for none, by its top terms.

    Top terms are those that add most to the divergence of the topic from the corpus. Each speaks for a subject by how
    much more frequent it is in the documents that readers gave that subject than in those of other subjects.
    """
    told = profiles.sum(axis=0) > 0  # a subject without labelled words names no topic
    if not told.any():
        return np.full(beta.shape[1], -1)
    every = profiles.sum(axis=1, keepdims=True)
    expected = profiles.sum(axis=0) / profiles.sum()
    lift = np.zeros(profiles.shape)
    if told.sum() > 1:  # odds, so that a subject that most labels give is told as well as a rare one
        own = (profiles + 2 * expected)[:, told]
        lift[:, told] = np.log(own / (every + 2 - own)) - np.log(expected[told] / (1 - expected[told]))
    else:
        lift[:, told] = 1.0
    p = (frequency + 0.5) / (frequency + 0.5).sum()
    named = np.full(beta.shape[1], -1)
    for k in range(beta.shape[1]):
        adds = beta[:, k] * np.log(beta[:, k] / p)
        top = np.argsort(-adds)[:top_terms]
        weight = np.maximum(adds[top], 0)
        if weight.sum() > 0:
            speaks = np.where(told, weight @ lift[top] / weight.sum(), -np.inf)
            first, second = np.sort(speaks)[::-1][:2] if len(speaks) > 1 else (speaks[0], -1.0)
            if first > 0.5 and first > second + 0.25:
                named[k] = speaks.argmax()
    return named


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], model: SubjectModel):
    """(bags of all documents, log-probabilities of cells in topics, prior, subject of each topic)."""
    spark, ns = documents.sparkSession, len(subjects)
    begins = spark.sparkContext.broadcast(count_openers(documents, model))

    def bag(frames):
        for f in _slices(frames):
            found = bags(f["text"].tolist(), model.cells, begins.value)
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang": [_language(x) for x in f["lang"]], "cells": [[c for s in d for c in s] for d in found], "lengths": [[len(s) for s in d] for d in found]})

    docs = cut(documents.select("doc_id", "text", "lang").where("text is not null").repartition(width(spark)).mapInPandas(bag, "doc_id bigint, lang string, cells array<int>, lengths array<int>"))
    spoken = sorted(((-r["count"], r.lang) for r in docs.groupBy("lang").count().collect()))  # a row for each code of two letters
    n = -sum(c for c, _ in spoken)
    langs = [lang for c, lang in spoken if lang and -c >= model.language_share * n][: model.languages]
    if len(langs) < sum(lang != "" for _, lang in spoken) or not langs:
        langs.append("")  # the further languages together
    read = labels.where(F.col("subject").isin(*subjects)).groupBy("doc_id", "subject").agg(F.countDistinct("reader").alias("votes"))
    share = [F.coalesce(F.sum(F.when(F.col("subject") == x, F.col("votes"))), F.lit(0)) for x in subjects]
    seeds = read.groupBy("doc_id").agg(F.array(*[c / F.sum("votes") for c in share]).alias("shares")).orderBy("doc_id").limit(model.labelled)
    seeds = docs.join(seeds, "doc_id").select("lang", "cells", "lengths", "shares")
    at = {lang: i for i, lang in enumerate(langs)}

    def frequency(rows, w, total):
        column = np.array([len(langs) if not x else at.get(x, len(langs) - 1) for x in rows.column("lang").to_pylist()], dtype=np.int64)
        np.add.at(total, (w.cells, column[w.doc[w.of]]), 1)

    seen = _counts(docs.select("lang", "cells", "lengths"), frequency, len(langs) + 1, model)
    typical = np.log((seen[:, : len(langs)] + 0.5) / (seen[:, : len(langs)] + 0.5).sum(axis=0))

    def profile(rows, w, total):
        """Adds a labelled document's words to its language's subjects; where it states none, to those of the likeliest."""
        shares = np.array(rows.column("shares").to_pylist(), dtype=float).reshape(w.documents, ns)
        column = np.array([at.get(x, len(langs) - 1) if x else -1 for x in rows.column("lang").to_pylist()], dtype=np.int64)
        like = np.zeros((w.documents, len(langs)))
        add_rows(like, w.doc[w.of], typical[w.cells])
        column = np.where(column < 0, like.argmax(axis=1), column)
        mine = column[w.doc[w.of]]
        for k in np.unique(mine):
            here = mine == k
            add_rows(total[:, k * ns : (k + 1) * ns], w.cells[here], shares[w.doc[w.of[here]]])

    profiles = _counts(seeds, profile, len(langs) * ns, model)
    each = ns + model.free_topics
    rng = np.random.default_rng(17)
    beta = np.zeros((model.cells, len(langs) * each))
    prior = np.tile(np.r_[np.full(ns, model.alpha), np.full(model.free_topics, model.alpha_free)], len(langs))
    for i in range(len(langs)):
        p = (seen[:, i] + 1e-3) / (seen[:, i] + 1e-3).sum()
        for s in range(ns):
            words_of = profiles[:, i * ns + s]
            beta[:, i * each + s] = (words_of + model.smooth * p) / (words_of.sum() + model.smooth)
        for k in range(ns, each):
            beta[:, i * each + k] = p * rng.uniform(0.7, 1.3, model.cells)
    log_beta = np.log(beta / beta.sum(axis=0) + 1e-12).astype(np.float32)
    for _ in range(model.iterations):
        shared = spark.sparkContext.broadcast(log_beta)

        def gather(rows, w, total, shared=shared):
            add_rows(total, w.cells, expect(w, shared.value, prior, model.inner), w.of)

        lam = _counts(docs.select("cells", "lengths"), gather, log_beta.shape[1], model) + model.eta
        log_beta = (digamma(lam) - digamma(lam.sum(axis=0, keepdims=True))).astype(np.float32)
        shared.unpersist()
    pooled = profiles.reshape(model.cells, len(langs), ns).sum(axis=1)
    named = name_topics(lam / lam.sum(axis=0), pooled, seen.sum(axis=1), model.top_terms)
    return docs, log_beta, prior, named


def decide(counts: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """Subjects of at least two sentences, or of one if the text has only sentences that are each the one of a subject."""
    only = (counts.max(axis=1) == 1) & (counts.sum(axis=1) >= sentences)
    return (counts >= 2) | ((counts == 1) & only[:, None])


def assign_subjects(documents: DataFrame, labels: DataFrame, subject_list: DataFrame, model: SubjectModel = SubjectModel()) -> DataFrame:
    """(doc_id, subject) for each subject that a document is about, by the proportions of its sentences' topics.

    Null, empty and wordless texts have none. Repeated texts are treated alike, repeated rows each give theirs. A sentence
    counts for the subject that holds more than ``sure`` of its probability. Labels of unknown subjects or documents,
    and further labels of one reader, change nothing; a subject without labelled words names no topic, so that without any
    label the result is empty. Languages that are rare or beyond ``languages`` share one set of topics. Whole texts are read. Extra columns are not read.
    """
    listed = fixed_rows(subject_list.where("subject is not null").groupBy("subject").agg(F.min("subject_id").alias("at")), "subjects")
    subjects = [r.subject for r in sorted(listed, key=lambda r: (r["at"] is None, r["at"], r.subject))]
    if not subjects:
        return documents.select("doc_id", F.lit("").alias("subject")).limit(0)
    docs, log_beta, prior, named = fit(documents, labels, subjects, model)
    shared = documents.sparkSession.sparkContext.broadcast(log_beta)
    member = np.stack([named == s for s in range(len(subjects))], axis=1).astype(float)

    def found(batches):
        for rows, w in flat(batches):
            share = expect(w, shared.value, prior, model.inner) @ member
            counts = np.zeros((w.documents, len(subjects)), dtype=int)
            if len(share):
                sure = share.max(axis=1) > model.sure
                np.add.at(counts, (w.doc[sure], share.argmax(axis=1)[sure]), 1)
            sizes = np.bincount(w.of, minlength=len(w.doc))
            long = np.bincount(w.doc, weights=sizes > 1, minlength=w.documents)  # a single word, as 'Reposted.', is no sentence
            at, which = np.nonzero(decide(counts, long))
            if len(at):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(at)), pa.array([subjects[s] for s in which])], names=["doc_id", "subject"])

    return docs.select("doc_id", "cells", "lengths").mapInArrow(found, "doc_id bigint, subject string")
