"""Scores of fixed models over named feature columns.

Weights are kept by feature name, so the column order of a file does not matter.
A model is as wide as the table has feature columns, so it fits on the driver.
"""

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armlight.functions.vectors import sigmoid

# nets with more weights than this are scored in Arrow batches with numpy
COLUMN_NET_WEIGHTS = 400


def number(value) -> str:
    """A double literal in SQL text."""
    return f"{float(value)!r}D"


# terms of one expression; generated methods stay small however wide the model is
TERM_BLOCK = 64


def _added(parts) -> str:
    """The parts added in halves, so the expression is as deep as the logarithm of their number."""
    while len(parts) > 1:
        parts = [f"({' + '.join(parts[k : k + 2])})" for k in range(0, len(parts), 2)]
    return f"({parts[0]})"


def weighted_sum(weights, terms, bias=0.0) -> str:
    """SQL text of a weighted sum.

    Scores are built as SQL text: one expression per model instead of one call into the JVM per operation. Terms are
    summed in blocks of features, and the blocks' sums as the elements of an array, which Spark compiles one by one, so
    thousands of features will do.
    """
    parts = [f"{number(w)} * {t}" for w, t in zip(weights, terms)] + [number(bias)]
    blocks = [_added(parts[k : k + TERM_BLOCK]) for k in range(0, len(parts), TERM_BLOCK)]
    if len(blocks) == 1:
        return blocks[0]
    return f"aggregate(array({', '.join(blocks)}), 0D, (total, block) -> total + block)"


def _quoted(columns):
    return [f"`{c}`" for c in columns]


def _sigmoid(text: str) -> str:
    return f"(1D / (1D + exp(-{text})))"


@dataclass(frozen=True)
class LinearModel:
    """``w.x + b``, through a sigmoid if ``link`` is "logit"."""

    weights: dict
    intercept: float = 0.0
    link: str = "logit"

    @property
    def features(self):
        return list(self.weights)

    def part(self, columns, bias: float = 0.0) -> Column:
        """The share of ``w.x`` that the given columns contribute, plus ``bias``."""
        used = [c for c in columns if c in self.weights]
        return F.expr(weighted_sum([self.weights[c] for c in used], _quoted(used), bias))

    def activate(self, z: Column) -> Column:
        return sigmoid(z) if self.link == "logit" else z

    def score(self) -> Column:
        z = weighted_sum(self.weights.values(), _quoted(self.weights), self.intercept)
        return F.expr(_sigmoid(z) if self.link == "logit" else z)

    def with_values(self, weights: dict, intercept: float) -> "LinearModel":
        return replace(self, weights=dict(weights), intercept=float(intercept))


@dataclass(frozen=True)
class DenseNet:
    """Fully connected net: ReLU layers and a last layer with one or more outputs.

    ``layers`` holds (matrix, bias) pairs, the matrix as one row per output unit.
    ``sigmoid_out`` puts the outputs through a sigmoid.
    """

    features: tuple
    layers: tuple
    sigmoid_out: bool = True

    @property
    def n_weights(self):
        return sum(len(m) * len(m[0]) + len(b) for m, b in self.layers)

    @property
    def small(self):
        return self.n_weights <= COLUMN_NET_WEIGHTS

    def _finish(self, hidden):
        """Outputs from the values of the first layer before its ReLU, as SQL text."""
        for matrix, bias in self.layers[1:]:
            inputs = [f"greatest({h}, 0D)" for h in hidden]
            hidden = [weighted_sum(row, inputs, b) for row, b in zip(matrix, bias)]
        return [_sigmoid(h) if self.sigmoid_out else h for h in hidden]

    def outputs(self):
        """One Column per output unit, null or NaN if a feature is; all arithmetic stays in generated code."""
        matrix, bias = self.layers[0]
        inputs = _quoted(self.features)
        found = self._finish([weighted_sum(row, inputs, b) for row, b in zip(matrix, bias)])
        # greatest() skips nulls, so a missing feature has to be asked for
        missing = " or ".join(f"{x} is null" for x in inputs)
        return [F.expr(f"if({missing}, null, {o})") for o in found]

    def output_vector(self) -> Column:
        """All outputs as one array."""
        return F.array(*self.outputs()) if self.small else self._batched(lambda net, x: net.forward(x))

    def score(self) -> Column:
        """First output, in generated code for small nets and in Arrow batches for wide ones."""
        return self.outputs()[0] if self.small else self.batch_score()

    def batch_score(self) -> Column:
        return self._batched(lambda net, x: net.forward(x)[:, 0], "double")

    def score_array(self, vector: str) -> Column:
        """First output for features held in one array column, in Arrow batches."""
        net = self.to_arrays()

        @F.pandas_udf("double")
        def run(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=float)
            return pd.Series(net.forward(np.stack(vectors.to_numpy()).astype(float))[:, 0])

        return run(F.col(vector))

    def _batched(self, compute, returns="array<double>", columns=None) -> Column:
        net = self.to_arrays()

        @F.pandas_udf(returns)
        def run(batch: pd.DataFrame) -> pd.Series:
            return pd.Series(list(compute(net, batch.to_numpy(dtype=float))))

        return run(F.struct(*(columns or self.features)))

    def first_layer(self, columns, with_bias: bool) -> Column:
        """Share of the given columns in each first-layer unit, as one array.

        ``W.[o, u] + b`` is ``W_o.o + (W_u.u + b)``: each side is computed once per
        offer and once per user instead of once per pair.
        """
        matrix, bias = self.layers[0]
        used = [c for c in self.features if c in set(columns)]
        if not self.small:
            places = [self.features.index(c) for c in used]
            part = np.asarray(matrix, dtype=float)[:, places]
            shift = np.asarray(bias, dtype=float) if with_bias else 0.0
            return self._batched(lambda net, x: x @ part.T + shift, columns=used)
        places = [self.features.index(c) for c in used]
        units = [
            weighted_sum([row[i] for i in places], _quoted(used), b if with_bias else 0.0)
            for row, b in zip(matrix, bias)
        ]
        return F.expr(f"array({', '.join(units)})")

    def to_arrays(self) -> "ArrayNet":
        return ArrayNet(
            [(np.asarray(m, dtype=float), np.asarray(b, dtype=float)) for m, b in self.layers],
            self.sigmoid_out,
        )


@dataclass
class ArrayNet:
    """The same net on numpy blocks, used inside tasks."""

    layers: list = field(default_factory=list)
    sigmoid_out: bool = True

    def finish(self, hidden):
        for matrix, bias in self.layers[1:]:
            hidden = np.maximum(hidden, 0.0) @ matrix.T + bias
        return 1.0 / (1.0 + np.exp(-hidden)) if self.sigmoid_out else hidden

    def forward(self, x):
        matrix, bias = self.layers[0]
        return self.finish(x @ matrix.T + bias)


def weights_table(spark: SparkSession, rows, names) -> DataFrame:
    """Rows (feature, number, ...) as a table that is part of the plan itself."""
    cells = ", ".join("('" + r[0] + "', " + ", ".join(number(v) for v in r[1:]) + ")" for r in rows)
    return spark.sql(f"select * from values {cells} as t(feature, {', '.join(names)})")


def layer_widths(n: int, rule: str = "quarter"):
    """Widths by rule: "quarter" is n, n/4, n/8, 1 rounded half to even;
    "halving" is n, n//2, n//4, n//8, n//16, 1; "critic" is n, n/4, 1.
    """
    if rule == "halving":
        return [n // 2**i for i in range(5)] + [1]
    if rule == "critic":
        return [n, round(n / 4), 1]
    return [n, round(n / 4), round(n / 8), 1]


def rule_net(widths, features=None) -> DenseNet:
    """A net of any size with weights from a rule: waves over unit and input."""
    layers = []
    for depth, (n_in, n_out) in enumerate(zip(widths, widths[1:])):
        unit, place = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
        matrix = np.sin(1.0 + 1000.0 * depth + 37.0 * unit + 11.0 * place) / np.sqrt(n_in)
        layers.append((matrix.tolist(), np.cos(np.arange(n_out) + float(depth)).tolist()))
    return DenseNet(tuple(features or (f"x{i}" for i in range(widths[0]))), tuple(layers))


def reward(prob: str, threshold: float = 0.5) -> Column:
    """1.0 from the threshold on, else 0.0; the threshold itself counts as 1."""
    return (F.col(prob) >= F.lit(threshold)).cast("double")
