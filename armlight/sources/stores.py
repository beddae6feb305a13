"""Saved models: weights tables of linear models, and a block store of nets with versions.

A net is stored as rows of at most ``BLOCK`` numbers: one row per layer, part (matrix, bias, or a moment of the optimizer)
and block. A version counts only once its commit row is there, which is written last and names the folder of its blocks;
a writer that dies leaves blocks that no reader sees, and writing a version again replaces it. Everything goes through
Spark's writers, so the store may lie wherever Spark writes.
"""

import time
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet, LinearModel, weights_table
from armlight.operators.backprop import BLOCK, Adam, flatten, shapes, unflatten
from armlight.operators.policies import model_from_table

_BLOCKS = "layer int, part string, block int, numbers array<double>"
_COMMIT = (
    "version bigint, written bigint, folder string, features array<string>, inputs array<int>, outputs array<int>, "
    "sigmoid_out boolean, steps bigint, rate double, decay double, first_beta double, second_beta double, epsilon double, n_blocks bigint"
)


def model_table(spark: SparkSession, model: LinearModel) -> DataFrame:
    """A linear model as rows (feature, w), intercept first."""
    rows = [("intercept", float(model.intercept))] + [(f, float(w)) for f, w in model.weights.items()]
    return weights_table(spark, rows, ["w"])


def save_model(spark: SparkSession, model: LinearModel, path: str, version: int = 0) -> None:
    """Writes one version; writing it again replaces it, so a repeated batch is harmless."""
    model_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_model(spark: SparkSession, path: str, like: LinearModel, version: int | None = None) -> LinearModel:
    """The given version, or the last one."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return model_from_table(table.where(F.col("version") == version), like)


def _rows(flat: np.ndarray, sizes, kind: str):
    for layer, (matrix, bias) in enumerate(unflatten(flat, sizes)):
        for part, numbers in ((f"{kind}matrix", matrix.ravel()), (f"{kind}bias", bias)):
            for at in range(0, len(numbers), BLOCK):
                yield layer, part, at // BLOCK, numbers[at : at + BLOCK].tolist()


def save_net(spark: SparkSession, net: DenseNet, path: str, version: int = 0, optimizer: Adam | None = None) -> None:
    """Writes the blocks of a version, then its commit row; with an optimizer also its moments, so a fit can go on."""
    sizes, state = shapes(net), optimizer or Adam()
    rows = list(_rows(flatten(net), sizes, ""))
    if state.first is not None:
        rows += [*_rows(state.first, sizes, "first_"), *_rows(state.second, sizes, "second_")]
    folder = uuid.uuid4().hex
    spark.createDataFrame(rows, _BLOCKS).coalesce(1).write.parquet(f"{path}/blocks/{folder}")
    commit = (
        version, time.time_ns(), folder, list(net.features), [n for _, n in sizes], [n for n, _ in sizes], net.sigmoid_out,
        state.steps, state.rate, state.decay, *state.betas, state.epsilon, len(rows),
    )
    spark.createDataFrame([commit], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _has_rows(spark: SparkSession, path: str, schema: str) -> bool:
    """Whether a table is there and not empty; asked of its own file system."""
    try:
        return not spark.read.schema(schema).parquet(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def has_commits(spark: SparkSession, path: str) -> bool:
    """Whether any version of a net was ever committed."""
    return _has_rows(spark, f"{path}/commits", _COMMIT)


def has_model(spark: SparkSession, path: str) -> bool:
    """Whether any version of a linear model was written."""
    return _has_rows(spark, path, "feature string, w double")


def net_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, written, folder, ...) of the committed versions, each once: the last commit holds."""
    commits = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    newest = commits.groupBy("version").agg(F.max("written").alias("written"))
    return commits.join(newest, ["version", "written"])


def load_net(spark: SparkSession, path: str, version: int | None = None) -> tuple[DenseNet, Adam]:
    """The net and the optimizer of a committed version, by default of the last one."""
    found = net_versions(spark, path)
    found = found.where(F.col("version") == version) if version is not None else found.orderBy(F.desc("version")).limit(1)
    commit = found.first()
    if commit is None:
        raise ValueError(f"no committed version {'' if version is None else version} in {path}")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks/{commit.folder}").orderBy("part", "layer", "block").collect()
    if len(blocks) != commit.n_blocks:
        raise ValueError(f"version {commit.version} in {path} has {len(blocks)} of {commit.n_blocks} blocks")
    sizes = list(zip(commit.outputs, commit.inputs))

    def flat(kind):
        parts = {}
        for row in blocks:
            parts.setdefault((row.layer, row.part), []).append(row.numbers)
        pieces = [parts[k, f"{kind}{part}"] for k in range(len(sizes)) for part in ("matrix", "bias")]
        return np.concatenate([np.asarray(b, float) for piece in pieces for b in piece])

    optimizer = Adam(commit.rate, commit.decay, (commit.first_beta, commit.second_beta), commit.epsilon, commit.steps)
    if commit.steps:
        optimizer.first, optimizer.second = flat("first_"), flat("second_")
    return DenseNet(tuple(commit.features), tuple(unflatten(flat(""), sizes)), commit.sigmoid_out), optimizer
