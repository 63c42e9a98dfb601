"""Whitening of embeddings by distributed block matrices.

Every vector becomes whole numbers x = floor(SCALE * c) + OFFSET.  The fit list has each distinct x once; its rows are
numbered, centred and laid into a BlockMatrix of BLOCK_ROWS rows a block.  The transposed matrix times the matrix is the
scatter, whose parts are summed over as many splits as there are groups of blocks, so that no task gets all of them.  The
eigenvectors of the scatter, a matrix as wide as a vector, are found locally; the BlockMatrix times the whitening matrix
projects the rows.  Rows of the input meet their projection by a SHA-256 of x, so a vector that a third of all rows
have is projected once, and Spark may split its rows.

Centred entries are (n * x - S) / n with an exact numerator.  All stays in the JVM but for the eigenvectors.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries go; so do rows of another length
than the commonest one (the longer of equally common ones).  Repeated rows get equal values.  Components whose
eigenvalue is not above RANK times the greatest aren't returned, for nothing varies along them: constant vectors, one
row or an empty table give no rows.  The sign of a component makes its largest entry positive.  ``deviation`` is a long;
should it not fit, the query fails rather than wraps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix, RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taplight.llm.common import drop, shared_dir, table, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block, blocks whose products one task sums, and the share of the greatest eigenvalue below which a component is none.
BLOCK_ROWS, BLOCKS_PER_TASK, RANK = 1024, 16, 1e-12


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that remain, entries as whole numbers."""
    c = F.col("c")
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("c")).where((F.size(c) > 0) & good)
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + OFFSET)
    width = rows.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(c) == (width[0]["d"] if width else 0)).select("vec_id", x.alias("x"))


def _key(x: Column) -> Column:
    return F.sha2(F.array_join(x.cast("array<string>"), ",").cast("binary"), 256)


def numbered(rows: DataFrame, path: str) -> DataFrame:
    """``rows``, written to ``path``, with ``index`` from 0 without gaps: places within a task's rows after the rows of the tasks before it."""
    each = rows.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    kept = written(each, path)
    sizes = kept.groupBy("task").agg(F.count("*").alias("n"))  # a row per task that wrote
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return kept.join(F.broadcast(before), "task").withColumn("index", F.col("before") + F.col("place")).drop("task", "place", "before")


def _blocks(spark: SparkSession, rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """(index, row: array of doubles) as a BlockMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, width)


def scatter(centred: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix, summed in splits of BLOCKS_PER_TASK blocks."""
    java = centred._java_matrix_wrapper._java_model
    blocks = -(-centred.numRows() // centred.rowsPerBlock)
    product = java.transpose().multiply(java, max(1, -(-blocks // BLOCKS_PER_TASK)))
    out = BlockMatrix(product, centred.colsPerBlock, centred.colsPerBlock).toLocalMatrix().toArray()
    product.blocks().cleanShuffleDependencies(False)  # two copies of all rows lie in its shuffle files
    return (out + out.T) / 2


@dataclass
class Whitening:
    """Mean-free directions of unit variance of a fit list of ``n`` vectors with sums ``sums``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def eigen(scatter_matrix: np.ndarray, n: int, sums: list[int], components: int = COMPONENTS) -> Whitening:
    """The leading components of a scatter matrix."""
    values, vectors = np.linalg.eigh(scatter_matrix / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > RANK * max(values[0], 0.0) if values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[keep], vectors[:, keep]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, vectors, values / np.trace(scatter_matrix / n))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component."""
    spark = vectors.sparkSession
    folder = shared_dir(spark, "whitening")
    kind = dict(vectors.dtypes)[id_col]
    nothing = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whole_vectors(vectors, id_col, vector_col)
    fit = numbered(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x", _key(F.col("x")).alias("key")), f"{folder}/fit")
    shape = fit.select(F.size("x").alias("d")).limit(1).collect()
    if not shape:
        drop(spark, folder)
        return nothing
    width = shape[0]["d"]
    found = fit.agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(k))).alias(f"s{k}") for k in range(width))).first()
    n, sums = found["n"], [int(found[f"s{k}"]) for k in range(width)]
    off = F.transform(F.arrays_zip(F.col("x"), F.array(*map(F.lit, sums)).alias("s")), lambda e: e["x"] * n - e["s"])
    centred = fit.select("index", "key", off.alias("off"))
    blocks = _blocks(spark, centred.select("index", F.transform("off", lambda v: v.cast("double") / float(n)).alias("row")), n, width)
    model = eigen(scatter(blocks), n, sums, components)
    if not len(model.values):
        drop(spark, folder)
        return nothing
    projected = written(centred.select("index", "key", _squares("off").alias("deviation")).join(_project(spark, blocks, model), "index").select("key", "deviation", "z"), f"{folder}/projected")
    drop(spark, f"{folder}/fit")
    error = identity_error(projected, n)
    explained = F.array(*map(F.lit, model.explained.tolist()))
    out = rows.select("vec_id", _key(F.col("x")).alias("key")).join(projected, "key").select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )


def _squares(column: str) -> Column:
    """The exact sum of squares of longs; an error where a long can't hold it."""
    about = F.aggregate(column, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    exact = F.aggregate(column, F.lit(0).cast("long"), lambda a, v: a + v * v)
    return F.when(about < 2.0**63 * (1 - 1e-9), exact).otherwise(F.raise_error(F.lit("a deviation is beyond a long")).cast("long"))


def _project(spark: SparkSession, blocks: BlockMatrix, model: Whitening) -> DataFrame:
    """(index, z): rows of the matrix times the whitening matrix."""
    width, kept = model.vectors.shape
    matrix = DenseMatrix(width, kept, (model.vectors / np.sqrt(model.values)).ravel(order="F").tolist())
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), matrix)], 1), width, kept, width, kept)
    rows = blocks.multiply(whitening).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("z"))


def identity_error(projected: DataFrame, n: int) -> float:
    """The largest absolute entry of the covariance (divisor n) of whitened rows ``z`` minus the identity."""
    vectors = MLUtils.convertVectorColumnsFromML(projected.select(array_to_vector("z").alias("z")), "z")
    covariance = RowMatrix(vectors).computeCovariance().toArray() * ((n - 1) / n)
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
