"""Mixing to target weights by soft domain membership.

A naive Bayes classifier over hashed words, fitted on the labelled table,
gives each document posterior probabilities of the domains. Nonnegative rates
are then fitted so that the expected tokens of each domain, sum of rate x
tokens x posterior, meet their targets in the least-squares sense. Everything
is DataFrame operations; what comes to the driver is one row of sums a pass.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import SPACE, stage

#: Word buckets of the classifier: the size of its tables, whatever the vocabulary.
BUCKETS = 4096
#: The classifier is fitted on at most so many labelled documents, chosen by a hash of doc_id.
FIT_ROWS = 20_000
#: Passes over the table of memberships at most, and the residual (relative to the target) at which fitting ends.
PASSES, NEAR = 40, 1e-6
#: Halvings of a step after which no better one is looked for: the targets are out of reach.
SHRINK = 6


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _table(values: list, kind: str) -> Column:
    """A literal array, folded to a constant when the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


@dataclass
class DomainModel:
    """Log prior of each domain, and log probability of each word bucket in it."""

    domains: list[str]
    prior: list[float]
    tables: list[list[float]]

    def membership(self, text: Column) -> Column:
        """Struct of n, the number of words, and p, the array of probabilities
        in the order of ``domains``. The evidence of n words counts as that of
        sqrt(n) independent ones, so that long documents keep a soft membership;
        without words it is the prior."""
        def share(scores: Column) -> Column:
            top = F.array_max(scores)
            exps = F.transform(scores, lambda s: F.exp(s - top))
            total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
            return F.transform(exps, lambda x: x / total)

        def evidence(b: Column, prior: float, logs: list[float]) -> Column:
            logs_at = _table(logs, "array<double>")
            return F.lit(prior) + F.aggregate(b, F.lit(0.0), lambda a, k: a + F.get(logs_at, k)) / F.sqrt(F.greatest(F.size(b), F.lit(1)))

        def score(b: Column) -> Column:
            # Only differences count: the last domain is the measure of the others.
            last = np.array(self.tables[-1])
            return F.array(*[evidence(b, p, (np.array(t) - last).tolist()) for p, t in zip(self.prior[:-1], self.tables[:-1])],
                           F.lit(self.prior[-1]))

        # Each step is bound once by a one-element transform, so that it isn't computed again by each use.
        at = F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).alias("n"), F.transform(w, _bucket).alias("at")))
        scores = F.transform(at, lambda s: F.struct(s["n"].alias("n"), score(s["at"]).alias("s")))
        return F.transform(scores, lambda s: F.struct(s["n"].cast("long").alias("n"), share(s["s"]).alias("p")))[0]


def label_domain() -> Column:
    """Domain of a labelled row: toxic, else good or poor by quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column | None = None,
                rows: int = FIT_ROWS) -> DomainModel:
    """Classifier for ``domains`` from labelled documents; labels of other
    domains or NULL are not used. Domains without labelled rows, or an empty
    labelled table, get even odds for every word."""
    domain = label_domain() if domain is None else domain
    known = (labels.select(F.col("doc_id").alias("_id"), domain.alias("_domain")).where(F.col("_domain").isin(domains))
             .groupBy("_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(rows))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(known), "_id")  # ``rows`` ids
    counts = texts.select("_domain", F.explode(F.transform(words(F.col("_text")), _bucket)).alias("k")).groupBy("_domain", "k").count()
    table = np.ones((len(domains), BUCKETS))
    for d, k, n in counts.collect():  # domains x BUCKETS rows at most
        table[domains.index(d), k] += n
    docs_of = dict(known.groupBy("_domain").count().collect())
    prior = np.array([docs_of.get(d, 0) + 1.0 for d in domains])
    # Words weigh by how they differ between domains; what is common to all cancels out.
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    return DomainModel(domains, np.log(prior / prior.sum()).tolist(), (logs - logs.mean(axis=0)).round(9).tolist())


def _rate(p: Column, steps: list[list[float]], start: float, least: float) -> Column:
    """The rate after the given steps: each moves along the document's posteriors and projects onto rate >= least."""
    def move(rate: Column, step: Column) -> Column:
        toward = F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(least), rate - toward)
    return F.aggregate(_table(steps, "array<array<double>>"), F.lit(start), move) if steps else F.lit(start)


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n, p of every row, written to the shared folder."""
    return stage(docs.select("doc_id", model.membership(F.col("text")).alias("m")).select("doc_id", "m.n", "m.p"), "memberships")


@dataclass
class Mixture:
    model: DomainModel
    steps: list[list[float]]
    start: float
    least: float
    reached: list[float]
    target: list[float]


def fit_mixture(held: DataFrame, model: DomainModel, weights: dict[str, float], budget: float = 1.0, least: float = 0.0) -> Mixture:
    """``held`` is ``memberships`` of the documents. Rates (at least ``least``) whose expected domain tokens come nearest to
    ``weights`` (made to sum to 1) times ``budget`` times the corpus's tokens.

    Projected gradient on the squared residual, measured in the inverse Gram
    matrix of the memberships that are off the bound and with a document's step
    divided by its tokens, so equal posteriors get equal rates and few passes
    are needed. A step after which the residual is larger is halved. A pass
    sums one row; rates are a function of the steps so far, so none are stored.
    """
    if set(weights) != set(model.domains) or min(weights.values()) < 0 or not sum(weights.values()):
        raise ValueError("weights must name the model's domains, be nonnegative and not all zero")
    k = len(model.domains)
    total = held.agg(F.sum("n")).first()[0] or 0
    target = np.array([weights[d] for d in model.domains]) / sum(weights.values()) * budget * total
    start, steps = max(budget, least), []
    if not total:
        return Mixture(model, steps, start, least, [0.0] * k, target.tolist())
    m, p = F.col("m"), F.col("p")
    before, shrunk = np.inf, 0
    for _ in range(PASSES):
        rated = held.select("p", "n", _rate(p, steps, start, least).alias("rate")).select(
            "p", (F.col("rate") * F.col("n")).alias("m"), F.when(F.col("rate") > (least if steps else -1.0), F.col("n")).otherwise(0).alias("free"))  # at first all may move
        row = np.array(rated.agg(*[F.sum(m * p[i]) for i in range(k)], *[
            F.sum(F.col("free") * p[i] * p[j]) for i in range(k) for j in range(k)]).first())
        sums, gram = row[:k], row[k:].reshape(k, k)
        away = np.linalg.norm(sums - target)
        if away <= NEAR * target.sum() or shrunk == SHRINK:
            break
        if away > before:
            steps[-1] = [x / 2 for x in steps[-1]]
            shrunk += 1
            continue
        if before - away <= NEAR * away:  # as near as it gets
            break
        before, shrunk = away, 0
        steps.append((np.linalg.pinv(gram, hermitian=True) @ (sums - target)).tolist())
    else:
        steps.pop()  # no pass has measured it
    return Mixture(model, steps, start, least, sums.tolist(), target.tolist())


def _copies(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """Adds rate and copies to rows with doc_id and p."""
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = docs.withColumn("rate", _rate(F.col("p"), mixture.steps, mixture.start, mixture.least))
    return out.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def with_rates(held: DataFrame, mixture: Mixture) -> DataFrame:
    """A row for each row of ``held`` (``memberships``): doc_id, n_words,
    posteriors (array), rate, and copies: the whole part of the rate, and one
    more where a hash of doc_id falls under the rest, so that equal ids decide
    alike on every run. NULL text has no words; an empty table gives no rows."""
    return _copies(held, mixture).select("doc_id", F.col("n").alias("n_words"), F.col("p").alias("posteriors"), "rate", "copies")


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as its copies say,
    with the columns of ``docs`` whatever their names. Texts stay where they
    are: memberships are computed again rather than joined."""
    rows = docs.select(F.struct("*").alias("whole"), "doc_id", mixture.model.membership(F.col("text")).alias("m"))
    out = _copies(rows.select("whole", "doc_id", F.col("m.p").alias("p")), mixture)
    return out.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
