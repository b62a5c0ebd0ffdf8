"""Subject areas of documents: a calibrated classifier chain over sentence evidence.

*Terms.*  From a bounded sample of labelled documents a mixture over sentences is fitted: each
sentence deals with one subject or none, its words depend on its subject and language, and a
document's labels only make its subject likelier, by as much as their rater has proved right.
So wrong labels, second subjects and passing remarks sort themselves out sentence by sentence.

*Chain.*  The share of sentences per subject (term features), the length, the spread over subjects and
the share of sentences without known terms (structure features) and the rate of a subject in the
document's source (source feature) go into a chain of logistic models, one per subject, each of which
also sees the decisions on the subjects before it, so that subjects that go together are learned.  The
chain is fitted on held-out folds: the features of a fold come from a mixture that was fitted
without it, its target from the one that saw all labels.  So the chain learns how far shares can be
trusted, and its probabilities are calibrated on documents that the terms don't come from.  The
likeliest combination is found by beam search, and it is the result.

Cases and their result
----------------------
* NULL, blank and sentence-less texts, and documents about no listed subject: no row.
* Labels of unknown documents or with a subject outside the list are ignored; repeated labels
  count once per rater.  Without any label there is no model and no row.
* A NULL or unseen source counts as the average source.  The same id twice gives one row.
* Whole texts of any length are read.  Columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.text import sentences
from quadrat.session import joined, kept

#: Least share of a document's sentences that deal with one of its subjects.
SHARE = 0.2
#: Labelled documents that the model is fitted on, at most (chosen by the hash of their id).
SAMPLE = 4000
#: Characters of the texts of these documents, at most.
SAMPLE_CHARS = 64_000_000
BEAM = 4
#: Penalties of the chain's weights: of the constant and a subject's own terms, and of all others.
OWN, OTHERS = 0.05, 5.0
#: Weight of "the share is large enough" that little data leave as it is.
TRUSTED = 3.0
#: Structure features, the constant among them.
STRUCTURE = 5
#: Folds that the chain is fitted on.
FOLDS = 2
#: Slope of the term features near ``SHARE``.
STEEP = 60
#: Share of a term's documents that must deal with a subject for the term to speak for it, first by labels, then by content.
PURE_LABELLED = 0.35
PURE = 0.5
#: Greatest probability with which a term's share may have come about by chance.
CHANCE = 0.05

#: Frequent words that tell the languages apart (fixed values).
STOP_WORDS = [
    "the of and to in is are was were been for from on at by with that this until whereas although while no not as our",
    "os as dos das do da no na nos nas e que foram sao seguem ainda ate segundo uma um com para ao perto entre por mais como nao desde em",
    "los las del el la y que fueron son han sido hasta segun una un con para al cerca entre por mas como no desde en",
]
_LANGUAGES = len(STOP_WORDS)


def _language_votes() -> dict[str, np.ndarray]:
    votes: dict[str, np.ndarray] = {}
    for k, text in enumerate(STOP_WORDS):
        for word in text.split():
            votes.setdefault(word, np.zeros(_LANGUAGES))[k] = 1
    return {w: v / v.sum() for w, v in votes.items()}


def _languages(votes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Language of each sentence, by its own stop words and, less, those of its document."""
    total = np.stack([np.bincount(doc, weights=votes[:, k], minlength=docs) for k in range(_LANGUAGES)], 1)
    size = np.maximum(1, np.bincount(doc, minlength=docs))[:, None]
    return (votes + 0.3 * (total / size)[doc]).argmax(1)


@dataclass
class SubjectModel:
    """Everything an executor needs to find the subjects of a document."""

    subjects: list[str]
    words: dict[str, int]
    votes: np.ndarray  # word, language
    weights: np.ndarray  # language, word, subject or none
    sources: dict[str, np.ndarray]
    average: np.ndarray
    chain: list[np.ndarray]

    def shares(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Share of the sentences per document and subject, and the number of sentences."""
        k, get = len(self.subjects), self.words.get
        sizes = np.array([len(t) for t in texts], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        tokens, lengths = [], []
        for text in texts:
            for sentence in text:
                known = [i for i in map(get, set(sentence)) if i is not None]
                tokens += known
                lengths.append(len(known))
        out = np.zeros((len(texts), k))
        if not len(doc):
            return out, sizes
        token, length = np.array(tokens, np.int64), np.array(lengths, np.int64)
        some = np.flatnonzero(length)
        starts = np.concatenate(([0], np.cumsum(length)[:-1]))[some]
        votes = np.zeros((len(doc), _LANGUAGES))
        scores = np.zeros((len(doc), k + 1))
        if len(some):
            votes[some] = np.add.reduceat(self.votes[token], starts)
            language = _languages(votes, doc, len(texts))
            scores[some] = np.add.reduceat(self.weights[np.repeat(language, length), token], starts)
        scores[:, :k] += np.log(0.04)
        scores[:, k] += np.log(0.5)
        best = scores.argmax(1)
        np.add.at(out, (doc[best < k], best[best < k]), 1)
        return out / np.maximum(1, sizes)[:, None], sizes

    def features(self, shares: np.ndarray, sizes: np.ndarray, sources: list[str | None]) -> np.ndarray:
        """Term, structure and source features of each document."""
        rate = np.array([self.sources.get(s, self.average) for s in sources]).reshape(len(sizes), -1)
        spread = (shares > 0).sum(1)
        structure = [np.ones(len(sizes)), np.log1p(sizes) / 5, spread / 5, shares.max(1, initial=0), shares.sum(1)]
        near = np.tanh((shares - SHARE) * STEEP + 0.5)  # how surely a share is large enough
        return np.column_stack([*structure, shares, near, np.log(rate / (1 - rate)) / 3])

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest combination of subjects of each document, by beam search."""
        n, k = len(features), len(self.subjects)
        paths, logs = np.zeros((n, 1, 0)), np.zeros((n, 1))
        for weight in self.chain:
            own, before = weight[: features.shape[1]], weight[features.shape[1] :]
            z = np.clip((features @ own)[:, None] + paths @ before[: paths.shape[2]], -30, 30)
            yes, no = logs - np.log1p(np.exp(-z)), logs - np.log1p(np.exp(z))
            both = np.concatenate([no, yes], 1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            last = (keep >= paths.shape[1]).astype(float)
            paths = np.concatenate([np.take_along_axis(paths, (keep % paths.shape[1])[:, :, None], 1), last[:, :, None]], 2)
            logs = np.take_along_axis(both, keep, 1)
        return paths[:, 0, :].astype(bool).reshape(n, k)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; each weight is drawn to its centre by its own penalty."""
    w = centre.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - centre)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-5:
            break
    return w


def speaks(holding: np.ndarray, spread: np.ndarray, base: np.ndarray, least: float) -> np.ndarray:
    """Whether a term speaks for a subject (term, subject), by one rule for samples of any size.

    Of the ``spread`` documents that hold the term, ``holding`` deal with the subject.  That must be a
    share of at least ``least``, and no chance: at the subject's rate ``base`` among all documents, so
    many would do so with a probability of at most ``CHANCE`` (by Chernoff's bound, exact if all do).
    """
    n = np.maximum(1, spread)[:, None]
    share, base = np.clip(holding / n, 0, 1), np.clip(base, 1e-6, 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    return (share >= least) & (share > base) & (n * gain >= -np.log(CHANCE))


def fit(texts: list[list[list[str]]], labels: list[list[tuple[str, str]]], sources: list[str | None], subjects: list[str], rounds: int = 10) -> SubjectModel:
    """The model from labelled documents: sentences, (subject, rater) pairs and source of each."""
    model, truth = _mixture(texts, labels, sources, subjects, rounds)
    fold = np.arange(len(texts)) % FOLDS
    x = np.zeros((len(texts), 0))
    for k in range(FOLDS):
        own, others = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if not len(own) or not len(others):
            continue
        pick = lambda rows, at: [rows[i] for i in at]
        apart, _ = _mixture(pick(texts, others), pick(labels, others), pick(sources, others), subjects, rounds)
        found = apart.features(*apart.shares(pick(texts, own)), pick(sources, own))
        x = np.zeros((len(texts), found.shape[1])) if not x.shape[1] else x
        x[own] = found
    if not x.shape[1]:  # a single document
        x = model.features(*model.shares(texts), sources)
    for c in range(len(subjects)):
        every = np.column_stack([x, truth[:, :c]])
        near = STRUCTURE + len(subjects) + c
        ridge, centre = np.full(every.shape[1], OTHERS), np.zeros(every.shape[1])
        ridge[[0, STRUCTURE + c, near]] = OWN
        centre[near] = TRUSTED
        model.chain.append(_logistic(every, truth[:, c], ridge, centre))
    return model


def _mixture(texts: list[list[list[str]]], labels: list[list[tuple[str, str]]], sources: list[str | None], subjects: list[str], rounds: int) -> tuple[SubjectModel, np.ndarray]:
    """The sentence mixture as a model without chain, and the subjects of the documents by it and their labels."""
    k, docs = len(subjects), len(texts)
    where = {s: i for i, s in enumerate(subjects)}
    words: dict[str, int] = {}
    token, sent, doc = [], [], []
    for d, text in enumerate(texts):
        for sentence in text:
            for w in sorted(set(sentence)):
                token.append(words.setdefault(w, len(words)))
                sent.append(len(doc))
            doc.append(d)
    token, sent, doc = np.array(token, np.int64), np.array(sent, np.int64), np.array(doc, np.int64)
    known = _language_votes()
    votes = np.array([known.get(w, np.zeros(_LANGUAGES)) for w in words]).reshape(-1, _LANGUAGES)
    n, size = len(doc), len(words)
    language = _languages(np.stack([np.bincount(sent, weights=votes[token, j], minlength=n) for j in range(_LANGUAGES)], 1), doc, docs)
    term = language[sent] * size + token
    seen_in, seen = np.unique(np.stack([doc[sent], term]), axis=1)
    spread = np.bincount(seen, minlength=_LANGUAGES * size)
    often = spread >= 2
    raters = sorted({r for row in labels for _, r in row})
    trust = dict.fromkeys(raters, 0.7)

    def calm(share: np.ndarray) -> np.ndarray:
        """Chances of a sentence's subject before it is read: half that it has none."""
        out = share.copy()
        out[:, :k] *= 0.5 / np.maximum(1e-9, out[:, :k].sum(1, keepdims=True))
        out[:, k] = 0.5
        return out

    def belief() -> np.ndarray:
        base = np.full((docs, k + 1), 0.25)
        base[:, k] += 1
        for d, row in enumerate(labels):
            for subject, rater in row:
                base[d, where[subject]] += 3 * max(0.0, trust[rater] - 0.2)
        return base

    prior = belief()
    prior /= prior.sum(1, keepdims=True)
    post = prior[doc]
    member = np.zeros((docs, k))
    for d, row in enumerate(labels):
        for subject, _ in row:
            member[d, where[subject]] = 1
    for step in range(rounds):
        count = np.stack([np.bincount(term, weights=post[sent, c], minlength=_LANGUAGES * size) for c in range(k + 1)], 1)
        whole = np.stack([np.bincount(language, weights=post[:, c], minlength=_LANGUAGES) for c in range(k + 1)], 1)
        per_term = np.repeat(whole, size, axis=0)
        rate = count.sum(1, keepdims=True) / np.maximum(1e-9, per_term.sum(1, keepdims=True))
        sure = np.maximum(0, count - np.sqrt(count))
        weight = np.where(often[:, None] & (rate > 0), np.log((sure + 2 * rate + 1e-12) / (per_term + 2)) - np.log(np.maximum(rate, 1e-12)), 0)
        weight = np.clip(weight, -4, 4)
        # A term speaks for a subject only if most documents that hold it deal with that subject; what stands
        # in documents of every kind (headings, signatures, standing phrases) says nothing at all.
        base = member.mean(0)
        pure = np.stack([np.bincount(seen, weights=member[seen_in, c], minlength=_LANGUAGES * size) for c in range(k)], 1)
        own = speaks(pure, spread, base, PURE_LABELLED if step == 0 else PURE)
        weight = np.where(np.column_stack([own, np.zeros(len(own), bool)]), weight, np.minimum(weight, 0))
        weight[~own.any(1)] = 0
        score = np.stack([np.bincount(sent, weights=weight[term, c], minlength=n) for c in range(k + 1)], 1) + np.log(calm(prior)[doc])
        score -= score.max(1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(1, keepdims=True)
        held = np.stack([np.bincount(doc, weights=post[:, c], minlength=docs) for c in range(k + 1)], 1)
        lengths = np.maximum(1, held.sum(1))
        right, asked = dict.fromkeys(raters, 2.0), dict.fromkeys(raters, 3.0)
        for d, row in enumerate(labels):
            for subject, rater in row:
                asked[rater] += 1
                right[rater] += min(1.0, 3 * held[d, where[subject]] / lengths[d])
        trust = {r: right[r] / asked[r] for r in raters}
        member = (held[:, :k] / lengths[:, None] >= SHARE).astype(float)
        base = belief()
        prior = (held + base) / (held + base).sum(1, keepdims=True)

    useful = (often & (np.abs(weight).max(1) > 0.3)).reshape(_LANGUAGES, size).any(0) | (votes.sum(1) > 0)
    index = np.flatnonzero(useful)
    names = list(words)
    truth = (held[:, :k] / lengths[:, None] >= SHARE).astype(float)
    average = (truth.sum(0) + 1) / (docs + 2)
    by_source: dict[str, np.ndarray] = {}
    for source in {s for s in sources if s is not None}:
        rows = [d for d, s in enumerate(sources) if s == source]
        by_source[source] = (truth[rows].sum(0) + 5 * average) / (len(rows) + 5)
    model = SubjectModel(subjects, {names[i]: j for j, i in enumerate(index)}, votes[index], weight.reshape(_LANGUAGES, size, k + 1)[:, index, :].astype(np.float32), by_source, average, [])
    return model, truth


def _sample(documents: DataFrame, rated: DataFrame) -> DataFrame:
    """The labelled documents to fit on: those with the lowest hashes, at most ``SAMPLE`` and ``SAMPLE_CHARS``.

    Only ids and lengths of about twice ``SAMPLE`` documents reach the driver for the choice.
    """
    spark = documents.sparkSession
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    sized = kept(joined(documents.where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n")), rated.select("doc_id"), ["doc_id"]).groupBy("doc_id").agg(F.max("n").alias("n")))
    share = 2 * SAMPLE / max(1, sized.count())
    rows = sized.select(drawn.alias("h"), "doc_id", "n").where(F.col("h") < int(min(1.0, share) * (1 << 40))).collect()
    chosen, chars = [], 0
    for _, doc_id, n in sorted(map(tuple, rows)):
        chars += n
        if len(chosen) == SAMPLE or chars > SAMPLE_CHARS:
            break
        chosen.append((doc_id,))
    ids = spark.createDataFrame(chosen, "doc_id bigint")
    return documents.where("text is not null").select("doc_id", "text", "source").join(F.broadcast(ids), "doc_id")


def fit_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> SubjectModel | None:
    """The model from a bounded sample of labelled documents; None if there is none."""
    names = [r["subject"] for r in subjects.where("subject is not null").select("subject").distinct().sort("subject").collect()]
    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source")
    rated = labels.where("doc_id is not null").where(F.col("subject").isin(names)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_set(F.struct("subject", F.coalesce("rater", F.lit("")).alias("rater"))).alias("given"))
    rated = kept(rated)
    rows = _sample(plain, rated).join(rated, "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"], r["source"] or ""))
    if not rows:
        return None
    return fit([sentences(r["text"]) for r in rows], [sorted((g["subject"], g["rater"]) for g in r["given"]) for r in rows], [r["source"] for r in rows], names)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id, subject`` of every document: a narrow map over whole texts."""
    schema = "doc_id bigint, subject string"
    spark = documents.sparkSession
    model = fit_subjects(documents, labels, subjects)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(vars(model))  # as large as the sample's vocabulary, which SAMPLE_CHARS bounds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SubjectModel(**shared.value)
        names = np.array(model.subjects, object)
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.iloc[begin : begin + 512]
                shares, sizes = model.shares([sentences(t) for t in part["text"]])
                found = model.decode(model.features(shares, sizes, list(part["source"]))) & (shares > 0)
                row, subject = np.nonzero(found)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row], "subject": names[subject]})

    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").where("doc_id is not null and text is not null")
    return narrow.mapInPandas(run, schema).distinct()
