"""Document vectors: the leading directions of the term weights of all documents, by block power iteration."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.models.bags import Part, add_wide, read_weights, summed, sweep, term_places, weighted_rows, write_weights
from docspark.session import materialize, spread

# Fixed value of the original features.
VECTOR_SIZE = 40
#: Directions beyond the wanted ones, and passes that sharpen them.
SPARE, PASSES = 8, 2


def log_counts(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def projection(part: Part, weights: np.ndarray, sums: dict) -> np.ndarray:
    """A document's counts, dampened, times the weights of its terms."""
    return weighted_rows(log_counts(part.counts), weights, part.ids, part.starts)


def back_projection(part: Part, weights: np.ndarray, sums: dict) -> None:
    add_wide(part, log_counts(part.counts), part.state, sums, len(weights))


def there_and_back(part: Part, weights: np.ndarray, sums: dict) -> None:
    """Both at once, for documents that lie in one block."""
    part.state = projection(part, weights, sums)
    back_projection(part, weights, sums)


def projected(bags: DataFrame, key: str, path: str, width: int, blocks: int) -> DataFrame:
    """``key, vector``: every document's sum over its terms; parts in several blocks are added up."""
    found = sweep(bags.select(key, "block", "ids", "counts"), path, projection, blocks=blocks)
    if blocks > 1:
        found = summed(found, width, "key")
    return found.select(F.col("key").alias(key), F.col("values").alias("vector"))


def squared(bags: DataFrame, key: str, path: str, width: int, blocks: int) -> DataFrame:
    """``block, id, values``: the term weights times the documents' matrix and its transpose."""
    if blocks == 1:
        found = sweep(bags.select(key, "block", "ids", "counts"), path, there_and_back, single=True)
    else:
        state = materialize(projected(bags, key, path, width, blocks), "projected", small=True)
        found = sweep(bags.join(state, key).select(key, "block", "ids", "counts", "vector"), path, back_projection, blocks=blocks, single=True)
    return summed(found.where("kind = 'term'"), width, "block", "id")


def gram(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Sums of products of the columns of a table of arrays, ``width`` squared numbers."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            total += values.T @ values
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["one", "values"])

    found = rows.select(column).mapInArrow(products, "one int, values array<double>")
    long = found.select(F.posexplode("values").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(width * width)
    for row in long.collect():
        out[row.place] = row.value
    return out.reshape(width, width)


def multiplied(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``block, id, weights`` with every weight row times a matrix, in Arrow batches."""

    def product(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1) @ matrix
                offsets = np.arange(batch.num_rows + 1, dtype="int32") * matrix.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["block", "id", "weights"])

    return rows.select("block", "id", "weights").mapInArrow(product, "block int, id int, weights array<double>")


def whitened(products: np.ndarray) -> np.ndarray:
    """What makes columns with these products orthonormal; directions of no length become zero."""
    values, vectors = np.linalg.eigh(products)
    length = np.sqrt(np.maximum(values, 0))
    small = length <= 1e-7 * max(length.max(initial=0.0), 1e-300)
    return vectors * np.where(small, 0, 1 / np.where(small, 1, length))


class VectorModel:
    """Numbered terms and their weights on each direction."""

    def __init__(self, terms: DataFrame, path: str, size: int, blocks: int, strengths: list[float]):
        self.terms, self.path, self.size, self.blocks, self.strengths = terms, path, size, blocks, strengths

    def vectors(self, bags: DataFrame, key: str) -> DataFrame:
        """``key, vector`` of unit length, of the documents that have any term of the vocabulary."""
        rows = projected(bags, key, self.path, self.size, self.blocks)
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        return rows.withColumn("_l", length).select(key, F.transform("vector", lambda x: F.when(F.col("_l") > 0, x / F.col("_l")).otherwise(0.0)).alias("vector"))

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        read_weights(spark, self.path).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/weights")
        meta = json.dumps({"size": self.size, "blocks": self.blocks, "strengths": self.strengths})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> VectorModel:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        return cls(spark.read.parquet(f"{path}/terms"), f"{path}/weights", meta["size"], meta["blocks"], meta["strengths"])


def fit_vectors(bags: DataFrame, terms: DataFrame, key: str, n_docs: int, size: int = VECTOR_SIZE, passes: int = PASSES, spare: int = SPARE, seed: int = 7) -> VectorModel:
    """The ``size`` strongest directions of the documents' dampened, inverse-frequency weighted counts.

    Randomised subspace iteration (Halko, Martinsson and Tropp 2011): a table of random weights per term is sent through all
    documents and back, made orthonormal by its small product matrix, and again. Only such matrices,
    ``size + spare`` squared numbers, reach the driver. First weights follow from a hash of the term.
    Directions beyond the rank of the documents are zero.
    """
    spark, width = bags.sparkSession, size + spare
    unit = lambda j, k: (F.pmod(F.xxhash64("term", F.lit(j), F.lit(k), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = [F.sqrt(-2 * F.log(unit(j, 0))) * F.cos(2 * np.pi * unit(j, 1)) for j in range(width)]
    rare = F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0))  # inside the weights, once on the way there and once back
    places = materialize(term_places(terms).select("term", "block", "id", "df"), "places")
    idf = materialize(places.select("block", "id", rare.alias("rare")), "rare")
    scale = lambda rows: rows.join(idf, ["block", "id"]).select("block", "id", F.transform("weights", lambda w: w * F.col("rare")).alias("weights"))
    blocks = places.agg(F.max("block")).first()[0]
    if blocks is None:
        raise ValueError("no term is frequent enough for a vocabulary")
    blocks += 1
    base = materialize(spread(places).select("block", "id", F.array(*normal).alias("weights")), "directions")
    products = gram(base, "weights", width)
    for _ in range(passes):
        base = multiplied(base, whitened(products))
        back = squared(bags, key, write_weights(scale(base), "weights"), width, blocks).withColumnRenamed("values", "weights")
        base = materialize(scale(back), "directions")
        products = gram(base, "weights", width)
    base = materialize(multiplied(base, whitened(products)), "directions")
    path = write_weights(scale(base), "weights")
    values, turn = np.linalg.eigh(gram(projected(bags, key, path, width, blocks), "vector", width))
    order = np.argsort(-values)[:size]
    final = write_weights(scale(multiplied(base, turn[:, order] * np.where(turn[:, order].sum(axis=0) < 0, -1.0, 1.0))), "weights")
    return VectorModel(terms, final, size, blocks, [float(np.sqrt(max(v, 0))) for v in values[order]])
