"""Mixing to target weights with soft membership.

A classifier learned from the labelled table gives each document a posterior over domains; a document counts for a
domain by its posterior share of its tokens. Rates (how often a document is repeated, a fraction being a chance) are
nonnegative and solve

    min over r >= 0 of  sum_k ((sum_d r_d t_d p_dk - target_k) / total)^2 + ridge * sum_d (t_d / total) (r_d - 1)^2

The minimum has r_d = max(0, 1 - p_d . m) with one multiplier m_k a domain, ridge * m being the K residuals: the
projected gradient step in r is the projection of a point that K numbers describe. So steps are taken on the multipliers,
along gradients scaled by the curvature, one sum over the documents a step, until the residuals agree with the
multipliers to ``TOLERANCE``; a document's rate follows from the multipliers and nothing is kept for each document. The
ridge is ``RIDGE`` of the smallest domain's share, so it only decides between rates that meet targets alike.

Target weights are shares of the tokens by likeliest domain. Posteriors are soft, so a mix of nothing but likely good
documents still has some expected tokens of every domain: a weight w_k stands for w_k of the tokens with the mean
posterior of the documents that are likeliest of domain k. Such targets can always be met, by rates that are equal
within a domain if by no others; ``totals`` gives targets and expected totals.

Domains are the labelled combinations of quality and toxic; the classifier is a multinomial logistic regression on at
most ``MOST_WORDS`` words and a few marks of style, fitted on at most ``MOST_LABELLED`` labelled documents, those with
the smallest hashes of their ids. Everything else covers all documents. Words are chosen from counts that Spark sums,
and only marks and the chosen words of labelled documents reach the driver, a kilobyte or two for each.

Defined results: a null text has no tokens, keeps the prior as posterior and a rate of its own; labels of absent documents,
null labels and labels other than the domains' are not used; without labels there is one domain and every rate is 1; a
weight of a domain that no document is likeliest of goes to the other domains in proportion; if there is no such other
domain the shares stay as they are; rows with equal ids are rows of their own; an empty table gives an empty table;
further columns stay.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.llm.lean import lean
from tessera.llm.rows import fresh
from tessera.llm.store import bounded_batches, saved
from tessera.llm.textkit import slices, word_hashes, words

#: (quality, toxic) of each domain, and the share of the tokens that documents likeliest of each should have.
DOMAINS = {"good": (1, 0), "poor": (0, 0), "toxic": (1, 1), "poor_toxic": (0, 1)}
TARGETS = {"good": 0.97, "poor": 0.03, "toxic": 0.0, "poor_toxic": 0.0}
MOST_LABELLED = 4000
MOST_WORDS = 512
#: Ridge as a part of the smallest domain's share, the least ridge, and the error of the residuals at which steps end.
RIDGE, LEAST_RIDGE, TOLERANCE = 1e-3, 1e-8, 1e-9
#: Newton steps after which a warning is given, and the dampings tried at each; the largest is a gradient step, which always descends.
STEPS, DAMPINGS = 100, (0.0, *10.0 ** np.arange(-8, 1))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words of each text without outer punctuation, marks of style, tokens of each text."""
    texts = pc.fill_null(texts, "")
    codes, ends, distinct = words(texts)
    counts = np.diff(ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    bare = pc.utf8_trim(distinct, characters=".,;:!?\"'()[]").dictionary_encode()
    which = np.asarray(bare.indices, dtype=np.int64)[codes] if len(codes) else codes
    size = max(len(bare.dictionary), 1)
    row, word = np.divmod(np.unique(owner * size + which), size)
    chars = np.maximum(np.asarray(pc.utf8_length(texts)), 1)
    some = np.maximum(counts, 1)
    marks = np.stack(
        [
            np.sqrt(np.asarray(pc.count_substring_regex(texts, "[A-Z]")) / chars),
            np.sqrt(np.minimum(np.asarray(pc.count_substring_regex(texts, r"[#*$%&|<>!]")) / some, 2.0)),
            np.bincount(row, minlength=len(counts)) / some,
            np.log1p(counts) / 10,
        ],
        axis=1,
    )
    return row, word_hashes(bare.dictionary)[word] if len(word) else np.zeros(0, np.uint64), marks, counts


@dataclass(frozen=True)
class Classifier:
    """A multinomial logistic regression on the presence of selected words and on marks of style; of bounded size."""

    words: np.ndarray
    weights: np.ndarray
    center: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(posterior over domains of each text, tokens of each text)."""
        row, word, marks, counts = features(texts)
        n, m = len(self.words), marks.shape[1]
        z = (marks - self.center) @ self.weights[n : n + m] + self.weights[-1]
        z[counts == 0] = self.weights[-1]
        if len(row) and n:
            place = np.minimum(np.searchsorted(self.words, word), n - 1)
            hit = self.words[place] == word
            np.add.at(z, row[hit], self.weights[place[hit]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, domain, documents with the word) of labelled texts, summed for each slice."""
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            row, word, _, _ = features(batch.column("text"))
            domain = np.asarray(batch.column("domain")).astype(np.int64)
            found, place = np.unique(word, return_inverse=True)
            k = len(DOMAINS)
            n = np.bincount(place * k + domain[row], minlength=len(found) * k).reshape(-1, k)
            at, of = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({"word": found[at].astype(np.int64), "domain": of.astype(np.int32), "n": n[at, of].astype(np.int64)})


def chosen_words(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words that tell domains apart best by chi square, sorted; documents of each domain)."""
    k = len(DOMAINS)
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    share = np.array([sizes.get(d, 0) for d in range(k)], dtype=float)
    if not share.sum():
        return np.zeros(0, np.uint64), share
    expect = share / share.sum()
    table = labelled.mapInArrow(lean(_counted), "word long, domain int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in range(k)))
    n = sum((F.col(f"n{d}") for d in range(1, k)), F.col("n0"))
    parts = [F.pow(F.col(f"n{d}") - n * float(expect[d]), 2) / F.greatest(n * float(expect[d]), F.lit(1e-9)) for d in range(k)]
    best = table.where(n >= 3).select("word", F.greatest(*parts).alias("score")).orderBy(F.desc("score"), "word").limit(MOST_WORDS).select("word").toArrow()
    return np.sort(np.asarray(best.column("word")).astype(np.int64).view(np.uint64)), share


def fit(held: list[np.ndarray], marks: np.ndarray, label: np.ndarray, found: np.ndarray, k: int, steps: int = 400, rate: float = 1.0, penalty: float = 1e-3) -> Classifier:
    """Fit the regression on the places of ``found`` that each text holds and on its marks, by accelerated gradient steps."""
    y = np.eye(k)[label]
    share = y.mean(axis=0)
    x = np.zeros((len(label), len(found) + marks.shape[1] + 1))
    for i, at in enumerate(held):
        x[i, at] = 1.0
    center = marks.mean(axis=0)
    x[:, len(found) : -1] = (marks - center) * 4
    x[:, -1] = 1.0
    w = np.zeros((x.shape[1], k))
    w[-1] = np.log(share + 1e-3)
    v, shrink = w.copy(), np.full((x.shape[1], 1), penalty)
    shrink[-1] = 0
    scale = rate * 4 / max((x**2).sum(axis=1).mean(), 1.0)
    for t in range(steps):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - scale * (x.T @ (p - y) / len(label) + shrink * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    w[len(found) : -1] *= 4
    return Classifier(found, w, center)


def learned(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Classifier:
    """The classifier, fitted on the bounded sample of labelled documents."""
    bounded_batches(docs.sparkSession)
    domain = reduce(lambda e, kd: e.when((F.col("quality") == kd[1][0]) & (F.col("toxic") == kd[1][1]), kd[0]), enumerate(DOMAINS.values()), F)
    pair = labels.select(F.col("doc_id").cast("long").alias("labelled"), domain.cast("int").alias("domain")).where("domain is not null and labelled is not null").distinct()
    chosen = pair.orderBy(F.xxhash64("labelled"), "labelled", "domain").limit(most)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "domain")
    found, share = chosen_words(labelled)
    if not share.sum():
        return Classifier(np.zeros(0, np.uint64), np.vstack([np.zeros((4, len(DOMAINS))), [0.0, *[-60.0] * (len(DOMAINS) - 1)]]), np.zeros(4))

    @lean
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                row, word, marks, _ = features(batch.column("text"))
                place = np.minimum(np.searchsorted(found, word), max(len(found) - 1, 0))
                hit = found[place] == word if len(found) else np.zeros(len(word), bool)
                at, to = place[hit].astype(np.int32), np.searchsorted(row[hit], np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(at)), pa.FixedSizeListArray.from_arrays(pa.array(marks.ravel()), 4).cast(pa.list_(pa.float64()))], names=["doc_id", "domain", "held", "marks"])

    rows = labelled.mapInArrow(marked, "doc_id long, domain int, held array<int>, marks array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "domain", "marks", "held").limit(most).collect()
    return fit([np.array(r["held"], dtype=int) for r in rows], np.array([r["marks"] for r in rows]), np.array([r["domain"] for r in rows]), found, len(DOMAINS))


def memberships(docs: DataFrame, w: Classifier) -> DataFrame:
    """(doc_id, tokens, p_<domain>...) of each row."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(w)
    names = [f"p_{d}" for d in DOMAINS]

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                p, counts = held.value.posteriors(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *(pa.array(p[:, k].astype(np.float64)) for k in range(len(names)))], names=["doc_id", "tokens", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, tokens long, " + ", ".join(f"{n} double" for n in names))


class Rates:
    """Rates of documents as a function of their posteriors and of a multiplier for each domain."""

    def __init__(self, targets: np.ndarray, total: float, keep_first: bool = False, ridge: float = RIDGE) -> None:
        """keep_first: a document whose likeliest domain is the first has a rate of 1 at least, so that none is lost."""
        self.keep_first, self.ridge = keep_first, ridge
        self.targets, self.total = targets, max(total, 1.0)
        self.multipliers = np.zeros(len(targets))
        #: Residuals of plain gradient steps from the multipliers on.
        self.residuals: list[np.ndarray] = []

    def of(self, p: np.ndarray) -> np.ndarray:
        m = self.multipliers
        for e in self.residuals:
            # The step is below 1 / Lipschitz constant: the squares of K shares of at most 1 sum to 1 at most.
            m = m + (e - self.ridge * m) / (1.0 + self.ridge)
        return np.maximum(self._least(p), 1.0 - p @ m)

    def _least(self, p: np.ndarray) -> np.ndarray:
        return (p.argmax(axis=1) == 0).astype(float) if self.keep_first else np.zeros(len(p))

    def sums(self, p: np.ndarray, tokens: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """For each row of multipliers: the documents' part of the dual value, K masses and K x K curvatures."""
        least, out = self._least(p), []
        for m in tried:
            u = p @ m
            free = np.minimum(u, 1.0 - least)
            value = tokens @ (free * (free / 2 - 1.0) - least * (u - free))
            mass = (tokens * np.maximum(least, 1.0 - u)) @ p
            active = p * (tokens * (u <= 1.0 - least))[:, None]
            out.append(np.concatenate([[value], mass, (active.T @ p).ravel()]))
        return np.array(out)

    def best(self, sums: np.ndarray, tried: np.ndarray) -> tuple[float, np.ndarray]:
        """Keep the multipliers of least dual value; (error of their residuals, the damped Newton steps from there)."""
        k = len(self.targets)
        value = self.ridge / 2 * (tried**2).sum(axis=1) + (tried @ self.targets + sums[:, 0]) / self.total
        slopes = self.ridge * tried - (sums[:, 1 : k + 1] - self.targets) / self.total
        error = np.abs(slopes).max(axis=1)
        at = int(error.argmin()) if error.min() < TOLERANCE else int(value.argmin())
        self.multipliers = tried[at]
        curve = sums[at, k + 1 :].reshape(k, k) / self.total + self.ridge * np.eye(k)
        return float(error[at]), -np.array([np.linalg.solve(curve + d * np.eye(k), slopes[at]) for d in DAMPINGS])


def sums_of(members: DataFrame) -> tuple[float, np.ndarray]:
    """(tokens of all documents, K x K: expected tokens of each domain in documents likeliest of each; rows are the likeliest)."""
    names = [f"p_{d}" for d in DOMAINS]
    most = F.greatest(*names)
    likeliest = reduce(lambda e, k: e.when(F.col(names[k]) == most, k), range(len(names)), F)
    rows = members.withColumn("likeliest", likeliest).groupBy("likeliest").agg(F.sum("tokens").alias("n"), *(F.sum(F.col("tokens") * F.col(n)).alias(n) for n in names)).collect()
    out = np.zeros((len(names), len(names)))
    for r in rows:
        if r["likeliest"] is not None:
            out[r["likeliest"]] = [r[n] or 0.0 for n in names]
    return float(sum(r["n"] or 0 for r in rows)), out


def soft_targets(weights: np.ndarray, total: float, held: np.ndarray) -> np.ndarray:
    """Expected tokens of each domain in a mix whose tokens are of documents likeliest of domain k by weights[k]."""
    own = held.sum(axis=1)
    some = (own > 0) & (weights > 0)
    if not some.any():
        return held.sum(axis=0)
    share = np.where(some, weights, 0.0)
    return total * (share / share.sum()) @ (held / np.maximum(own, 1e-300)[:, None])


def solved(members: DataFrame, targets: dict[str, float] | None = None, keep_first: bool = False, steps: int = STEPS) -> Rates:
    """The rates of least squares: each step is one sum over all documents, for several dampings of the step at once."""
    names = [f"p_{d}" for d in DOMAINS]
    total, held = sums_of(members)
    wanted = soft_targets(np.array([(targets or TARGETS)[d] for d in DOMAINS]), total, held)
    shares = np.concatenate([held.sum(axis=0), wanted]) / max(total, 1.0)
    smallest = min((s for s in shares if s > 0), default=1.0)
    rates = Rates(wanted, total, keep_first, ridge=max(LEAST_RIDGE, RIDGE * smallest))
    tried = np.zeros((1, len(names)))
    for _ in range(steps):

        def sums(batches: Iterator[pd.DataFrame], tried: np.ndarray = tried) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(tried), 1 + len(names) + len(names) ** 2))
            for batch in batches:
                out += rates.sums(batch[names].to_numpy(), batch["tokens"].to_numpy().astype(float), tried)
            yield pd.DataFrame({"at": np.arange(len(tried)), "sums": list(out)})

        width = 1 + len(names) + len(names) ** 2
        parts = members.mapInPandas(sums, "at int, sums array<double>")
        rows = {r["at"]: r for r in parts.groupBy("at").agg(*(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width))).collect()}
        if not rows:
            break
        found = np.array([[rows[n][f"s{k}"] for k in range(width)] for n in range(len(tried))])
        error, moves = rates.best(found, tried)
        if error < TOLERANCE:
            break
        # The present multipliers stay among those tried, so the dual value never rises.
        tried = np.vstack([rates.multipliers, rates.multipliers + moves])
    else:
        warnings.warn(f"the rates' residuals are off by {error:.1e} after {steps} steps", stacklevel=2)
    return rates


def repeats(rate: Column, *identity: Column) -> Column:
    """How often a document is taken: the whole part of its rate, and one more with the chance of the rest."""
    chance = F.pmod(F.xxhash64(*identity, F.lit(17)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def totals(rated_docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(domain, target, expected): target and expected tokens of each domain under the rates of ``rated_docs``."""
    total, held = sums_of(rated_docs)
    wanted = soft_targets(np.array([(targets or TARGETS)[d] for d in DOMAINS]), total, held)
    row = rated_docs.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS)).first()
    return rated_docs.sparkSession.createDataFrame([(d, float(t), float(row[d] or 0.0)) for d, t in zip(DOMAINS, wanted, strict=True)], "domain string, target double, expected double")


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies) of each row of ``docs``."""
    members = saved(memberships(docs, learned(docs, labels)), "members")
    rates = solved(members, targets)
    names = [f"p_{d}" for d in DOMAINS]

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(rate=rates.of(batch[names].to_numpy()))

    schema = "doc_id long, tokens long, " + ", ".join(f"{n} double" for n in names) + ", rate double"
    return members.mapInPandas(rate, schema).withColumn("copies", repeats(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep_first: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; scored where they are, so that texts are not shuffled.

    keep_first: a document whose likeliest domain is the first is taken once at least.
    """
    w = learned(docs, labels)
    rates = solved(saved(memberships(docs, w), "members"), targets, keep_first)
    held = docs.sparkSession.sparkContext.broadcast(w)
    rate, copies, copy = (fresh(docs.columns, c) for c in ("_rate", "_copies", "_copy"))

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                p, _ = held.value.posteriors(batch.column("text"))
                yield batch.append_column(rate, pa.array(rates.of(p)))

    schema = StructType(list(docs.schema.fields)).add(rate, DoubleType())
    out = docs.mapInArrow(score, schema).withColumn(copies, repeats(F.col(rate), F.col("doc_id"))).where(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
