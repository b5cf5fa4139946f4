"""Variational topics held in tables: a row per term, a row per document, and a pass as joins and sums."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.models.bags import Part, add_by_term, alike, read_weights, summed, sweep, sweep_whole, term_places, write_weights
from docspark.session import materialize

# Fixed value of the original features.
TOPICS = 9
#: Passes over all documents, and steps on a document's shares in each.
PASSES, STEPS = 4, 5


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log gamma function for positive numbers: six steps of the recurrence, then its series."""
    x, back = np.array(x, "float64"), 0.0
    for _ in range(6):
        back = back + 1 / x
        x = x + 1
    r = 1 / (x * x)
    return np.log(x) - back - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, "float64"), 0.0
    for _ in range(8):
        small = x < 8
        shift = shift - np.where(small, np.log(x), 0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def shares_of(gamma: np.ndarray) -> np.ndarray:
    return digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True))


def document_step(totals: list[float], prior: float, steps: int, whole: bool, learn: bool):
    """Steps on documents with state ``gamma``; with ``learn`` it also adds up the terms' shares and their likelihood.

    A document that lies ``whole`` in its part takes several ``steps``. Otherwise its part gives one, from the
    state it came with, and so do the terms' shares, since no part knows the others' sums.
    """
    total = digamma(np.array(totals))

    def prepare(weights: np.ndarray) -> np.ndarray:
        return np.exp(digamma(np.maximum(weights, 1e-300)) - total)

    def step(part: Part, beta: np.ndarray, sums: dict) -> np.ndarray:
        gammas, thetas, factors, likelihood = np.empty_like(part.state), np.empty_like(part.state), np.empty(len(part.ids)), 0.0
        beta = np.ascontiguousarray(beta)
        for docs, entry, real in alike(part.starts):
            counts, near = np.where(real, part.counts[entry], 0.0), beta[part.ids[entry]]
            near[~real] = 1.0
            near = np.ascontiguousarray(near.transpose(0, 2, 1))
            gamma = part.state[docs]
            theta = np.exp(shares_of(gamma))
            for _ in range(steps if whole else 1):
                share = counts / np.matmul(theta[:, None, :], near)[:, 0, :]
                gamma = prior + theta * np.matmul(near, share[:, :, None])[:, :, 0]
                if whole:
                    theta = np.exp(shares_of(gamma))
            gammas[docs] = gamma
            if learn:
                norm = np.matmul(theta[:, None, :], near)[:, 0, :]
                thetas[docs], factors[entry[real]] = theta, (counts / norm)[real]
                likelihood += float((counts * np.log(norm)).sum())
        if learn:
            add_by_term(part, factors, thetas, sums, len(beta))
            sums["all"] = sums.get("all", np.zeros(1)) + likelihood
        return gammas

    return prepare, step


class TopicModel:
    """Numbered terms (``term_id, term, df``), their weights on the topics, and the topics' totals."""

    def __init__(self, terms: DataFrame, path: str, totals: list[float], prior: float, blocks: int, bounds: list[float]):
        self.terms, self.path, self.totals, self.prior, self.blocks, self.bounds = terms, path, totals, prior, blocks, bounds

    def shares(self, bags: DataFrame, key: str, steps: int = 20) -> DataFrame:
        """``key, topics``: the topic shares of the documents that have any term of the vocabulary."""
        state = first_state(bags, key, self.prior, len(self.totals))
        state = new_state(one_pass(bags, state, key, self.path, self.totals, self.prior, steps, self.blocks, False), key)
        total = F.aggregate("gamma", F.lit(0.0), lambda a, x: a + x)
        return state.select(key, F.transform("gamma", lambda g: g / total).alias("topics"))

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        read_weights(spark, self.path).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/weights")
        meta = json.dumps({"totals": self.totals, "prior": self.prior, "blocks": self.blocks, "bounds": self.bounds})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> TopicModel:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        return cls(spark.read.parquet(f"{path}/terms"), f"{path}/weights", meta["totals"], meta["prior"], meta["blocks"], meta["bounds"])


def first_state(bags: DataFrame, key: str, prior: float, k: int) -> DataFrame:
    """``key, gamma``: every topic the same share of a document's words."""
    words = F.aggregate("counts", F.lit(0.0), lambda a, n: a + n.cast("double"))
    sizes = bags.groupBy(key).agg(F.sum(words).alias("_n"))
    return sizes.select(key, F.array_repeat(F.lit(prior) + F.col("_n") / k, k).alias("gamma"))


def one_pass(bags, state, key, path, totals, prior, steps, blocks, learn) -> DataFrame:
    prepare, step = document_step(totals, prior, steps, True, learn)
    rows = bags.join(state, key).select(key, "block", "ids", "counts", "gamma")
    finish = lambda beta, sums: sums * beta
    if blocks == 1:
        return sweep(rows, path, step, finish=finish, prepare=prepare)
    return sweep_whole(rows, path, step, finish, prepare)


def new_state(found: DataFrame, key: str) -> DataFrame:
    """The documents' states after a pass."""
    return found.where("kind = 'doc'").select(F.col("key").alias(key), F.col("values").alias("gamma"))


def summed_rows(rows: DataFrame, column: str, value) -> tuple[float, int]:
    """Sum of ``value`` over batches of the arrays in a column, and the number of rows."""

    def part(batches):
        for batch in batches:
            matrix = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([float(value(matrix))]), pa.array([batch.num_rows])], ["value", "n"])

    row = rows.select(column).mapInArrow(part, "value double, n long").agg(F.sum("value"), F.sum("n")).first()
    return row[0] or 0.0, row[1] or 0


def weight_bound(spark: SparkSession, path: str, totals: list[float], eta: float) -> float:
    """What the terms' weights themselves add to the bound."""
    total = digamma(np.array(totals))
    value, n = summed_rows(read_weights(spark, path), "weights", lambda w: ((eta - w) * (digamma(w) - total) + log_gamma(w) - log_gamma(np.array(eta))).sum())
    return float(value + (log_gamma(np.array(n * eta)) - log_gamma(np.array(totals))).sum())


def state_bound(state: DataFrame, prior: float, k: int) -> float:
    """What the documents' states themselves add to the bound."""
    ends = log_gamma(np.array(k * prior)) - k * log_gamma(np.array(prior))
    return float(summed_rows(state, "gamma", lambda g: ((prior - g) * shares_of(g) + log_gamma(g)).sum() + (ends - log_gamma(g.sum(axis=1))).sum())[0])


def topic_totals(spark: SparkSession, path: str, k: int) -> list[float]:
    row = read_weights(spark, path).agg(*[F.sum(F.get("weights", F.lit(j))) for j in range(k)]).first()
    return [float(x) for x in row]


def fit_topics(bags: DataFrame, terms: DataFrame, key: str, k: int = TOPICS, passes: int = PASSES, prior: float | None = None, eta: float | None = None, seed: int = 7, watch: bool = False) -> TopicModel:
    """Variational topics of ``packed`` bags over numbered ``terms``; every pass reads all documents.

    A pass joins the documents' states to their bags, whose entries meet the terms' weights block by
    block, and sums the terms' shares by term. States and weights are updated from the same shares and start from
    the pass before, so the bound on the likelihood rises with every pass; ``watch`` fills ``bounds`` with it.
    A document takes ``STEPS`` steps in a pass, over its terms of all blocks. First weights follow from a hash of the term, so
    the result does not depend on the cluster but for the order of sums.
    """
    spark = bags.sparkSession
    prior, eta = (1.0 / k if x is None else x for x in (prior, eta))
    uniform = [(F.pmod(F.xxhash64("term", F.lit(j), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) for j in range(k)]
    path = write_weights(term_places(terms).select("block", "id", F.array(*[eta + F.col("df") * (0.5 + u) / k for u in uniform]).alias("weights")), "weights")
    blocks = read_weights(spark, path).agg(F.max("block")).first()[0]
    if blocks is None:
        raise ValueError("no term is frequent enough for a vocabulary")
    blocks, bounds = blocks + 1, []
    every = materialize(term_places(terms).select("block", "id"), "places")
    state = materialize(first_state(bags, key, prior, k), "states")
    totals = topic_totals(spark, path, k)
    for _ in range(passes):
        found = materialize(one_pass(bags, state, key, path, totals, prior, STEPS, blocks, True), "pass", small=True)
        state = new_state(found, key)
        if watch:
            likelihood = found.where("kind = 'all'").agg(F.sum(F.get("values", F.lit(0)))).first()[0] or 0.0
            bounds.append(likelihood + state_bound(state, prior, k) + weight_bound(spark, path, totals, eta))
        shares = summed(found.where("kind = 'term'"), k, "block", "id")
        rows = every.join(shares, ["block", "id"], "left")
        path = write_weights(rows.select("block", "id", F.transform(F.coalesce("values", F.array_repeat(F.lit(0.0), k)), lambda v: v + eta).alias("weights")), "weights")
        totals = topic_totals(spark, path, k)
    return TopicModel(terms, path, totals, prior, blocks, bounds)
