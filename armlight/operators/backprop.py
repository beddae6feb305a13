"""Distributed back-propagation.

Weights are one flat array, cut into blocks. Every task runs the net forward and back over its rows as matrix products
and emits one sum per block; the sums of a block meet in one task, so nothing that grows with the number of tasks reaches
the driver, which holds the weights and the moments of the optimizer. A net without hidden layers is a linear or logistic
model, so all widths and depths take this one path.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlight.functions.models import DenseNet
from armlight.operators.permutation import permute

LEARNING_RATE = 1e-4
WEIGHT_DECAY = 1e-5
BLOCK = 1 << 16
CELLS = 1 << 21  # numbers of one block of rows
MODEL_BYTES = 64 << 20  # models that one pass scores at once
_SUMS = -1  # the block of row count and squared error


def flatten(net: DenseNet) -> np.ndarray:
    """All weights in a row: per layer the matrix by output unit, then the bias."""
    return np.concatenate([np.concatenate([np.ravel(m), np.ravel(b)]) for m, b in net.layers]).astype(float)


def shapes(net: DenseNet) -> list:
    return [(len(m), len(m[0])) for m, _ in net.layers]


def unflatten(flat: np.ndarray, sizes) -> list:
    """(matrix, bias) pairs, as views."""
    layers, at = [], 0
    for n_out, n_in in sizes:
        end = at + n_out * n_in
        layers.append((flat[at:end].reshape(n_out, n_in), flat[end : end + n_out]))
        at = end + n_out
    return layers


def with_weights(net: DenseNet, flat: np.ndarray) -> DenseNet:
    return DenseNet(net.features, tuple(unflatten(np.asarray(flat, float), shapes(net))), net.sigmoid_out)


def forward(layers, x, sigmoid_out=True):
    """Outputs of every layer, the input first; ReLU but for the last one."""
    outs = [x]
    for k, (matrix, bias) in enumerate(layers):
        z = outs[-1] @ matrix.T + bias
        last = k == len(layers) - 1
        outs.append(np.maximum(z, 0.0) if not last else 1.0 / (1.0 + np.exp(-z)) if sigmoid_out else z)
    return outs


def gradient(layers, x, y, weight, sigmoid_out=True):
    """(flat gradient, row count, squared error), summed over the rows; ``weight`` counts a row several times."""
    outs = forward(layers, x, sigmoid_out)
    p = outs[-1]
    gap = p - y[:, None]
    delta = 2.0 * gap * weight[:, None]
    if sigmoid_out:
        delta = delta * p * (1.0 - p)
    grads = []
    for k in range(len(layers) - 1, -1, -1):
        grads.append(np.concatenate([(delta.T @ outs[k]).ravel(), delta.sum(axis=0)]))
        if k:
            delta = (delta @ layers[k][0]) * (outs[k] > 0)
    return np.concatenate(grads[::-1]), weight.sum(), (weight[:, None] * gap * gap).sum()


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """An array column of one length as a matrix; a null row or cell is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pa.array([v if v is not None else [None] * width for v in column.to_pylist()], column.type)
    cells = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return cells.reshape(len(column), width)


def usable(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows without a null, NaN or infinite feature or target; only these train or count."""
    return np.isfinite(x).all(axis=1) & np.isfinite(y)


def _row_blocks(batch, width, keep=None):
    step = max(1, CELLS // max(width, 1))
    for start in range(0, len(batch), step):
        part = batch.slice(start, step)
        x, y = matrix_of(part["x"], width), part["y"].to_numpy(zero_copy_only=False).astype(float)
        weight = part["n"].to_numpy(zero_copy_only=False).astype(float) if "n" in part.schema.names else np.ones(len(part))
        good = usable(x, y)
        if keep is not None:
            good &= keep[start : start + step]
        if good.any():
            yield x[good], y[good], weight[good]


PACK_ROWS = 1 << 16  # rows of one packed block of narrow rows
_PACKED = "numbers binary, x binary, y binary"


def packed(rows: DataFrame, width: int) -> DataFrame:
    """The usable ones of ``rows`` (number, x, y) as blocks of numbers in binary, for rows that many steps read.

    A row of a block costs neither Spark nor Arrow anything, so a step over them is little more than its arithmetic.
    """
    most = max(1, min(PACK_ROWS, CELLS // max(width, 1)))

    def pack(batches):
        waiting, held = [], 0
        for batch in batches:
            for start in range(0, len(batch), most):
                part = batch.slice(start, most)
                x, y = matrix_of(part["x"], width), part["y"].to_numpy(zero_copy_only=False).astype(float)
                good = usable(x, y)
                waiting.append((part["number"].to_numpy()[good], x[good], y[good]))
                held += good.sum()
                if held >= most:
                    yield _pack_of(waiting)
                    waiting, held = [], 0
        if held:
            yield _pack_of(waiting)

    return rows.select("number", "x", "y").mapInArrow(pack, _PACKED)


def _pack_of(parts) -> pa.RecordBatch:
    cells = [np.concatenate(c).tobytes() for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["numbers", "x", "y"])


def _usable_blocks(batch, width, select):
    """(x, y, weight) of the rows of a batch that count, of plain or packed rows."""
    if "numbers" not in batch.schema.names:
        yield from _row_blocks(batch, width, select(batch) if select else None)
        return
    for numbers, x, y in zip(batch["numbers"], batch["x"], batch["y"]):
        x, y = np.frombuffer(x.as_buffer(), float).reshape(-1, width), np.frombuffer(y.as_buffer(), float)
        if select:
            keep = select({"number": np.frombuffer(numbers.as_buffer(), np.int64)})
            x, y = x[keep], y[keep]
        if len(y):
            yield x, y, np.ones(len(y))


_BLOCK_ROWS = "block int, sums binary"


def _as_blocks(sums: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    parts = [sums, *(flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK))]
    numbers = pa.array(range(_SUMS, len(parts) + _SUMS), pa.int32())
    return pa.RecordBatch.from_arrays([numbers, pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "sums"])


def _summed_blocks(parts: DataFrame, size: int) -> DataFrame:
    """The blocks of all tasks added up, each block in one task."""

    def summed(batches):
        totals = {}
        for batch in batches:
            for block, sums in zip(batch["block"].to_pylist(), batch["sums"]):
                part = np.frombuffer(sums.as_buffer(), float)
                totals[block] = totals[block] + part if block in totals else part
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["block", "sums"])

    tasks = min(1 + -(-size // BLOCK), 200)
    return parts.repartition(tasks, "block").mapInArrow(summed, _BLOCK_ROWS)


def _collected(blocks: DataFrame):
    """(sums, flat array) of summed blocks, or None if there was no row."""
    found = {r.block: np.frombuffer(r.sums, float) for r in blocks.collect()}
    if not found:
        return None
    sums = found.pop(_SUMS)
    return sums, np.concatenate([found[k] for k in sorted(found)])


def gradient_blocks(rows: DataFrame, net: DenseNet, shared, select=None) -> DataFrame:
    """(block, sums) of the gradient over ``rows`` (x array, y, optionally a count n, or ``packed``); a block is summed in one task.

    ``shared`` is the broadcast of the flat weights; ``select`` maps a record batch to the rows that count.
    """
    sizes, sigmoid_out = shapes(net), net.sigmoid_out
    width, n_weights = sizes[0][1], sum(n_out * (n_in + 1) for n_out, n_in in sizes)

    def partial(batches):
        total, n, error = None, 0.0, 0.0
        layers = unflatten(shared.value, sizes)
        for batch in batches:
            for x, y, weight in _usable_blocks(batch, width, select):
                g, rows_in, e = gradient(layers, x, y, weight, sigmoid_out)
                total = g if total is None else total + g
                n, error = n + rows_in, error + e
        if total is not None:
            yield _as_blocks(np.array([n, error]), total)

    return _summed_blocks(rows.mapInArrow(partial, _BLOCK_ROWS), n_weights)


def summed_gradient(rows: DataFrame, net: DenseNet, select=None):
    """(gradient, row count, squared error) over ``rows``; as much reaches the driver as the net has weights."""
    flat = flatten(net)
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    found = _collected(gradient_blocks(rows, net, shared, select))
    shared.destroy()
    if found is None:
        return np.zeros_like(flat), 0.0, 0.0
    return found[1], *found[0]


def predicted(x: np.ndarray, weights: np.ndarray, link: str) -> np.ndarray:
    """Scores of a linear or logistic model; the first weight is the intercept."""
    z = x @ weights[1:] + weights[0]
    return 1.0 / (1.0 + np.exp(-z)) if link == "logit" else z


def linear_sums(rows: DataFrame, model, extras=()) -> dict:
    """All sums that training a linear or logistic model takes, in one pass over ``rows`` (x array, r, n and ``extras``).

    "gradient" of the squared error, "log_gradient" of the log loss and "precision", sum(x^2 p (1-p)), are arrays with
    the intercept first; "n", "log_loss" and the n-fold extras are numbers. Rows with a null, NaN or infinite value are
    left out of all but "given", which counts them too. Features are summed as matrix products, so the width may be thousands.
    """
    width = len(model.features)
    weights = np.array([model.intercept, *model.weights.values()], float)
    link = model.link

    def partial(batches):
        total, flat = np.zeros(3 + len(extras)), np.zeros(3 * (width + 1))
        for batch in batches:
            step = max(1, CELLS // max(width, 1))
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                x = matrix_of(part["x"], width)
                r, n, *rest = (part[c].to_numpy(zero_copy_only=False).astype(float) for c in ("r", "n", *extras))
                given = n.sum()
                good = usable(x, r + sum(rest))
                x, r, n, rest = x[good], r[good], n[good], [e[good] for e in rest]
                p = predicted(x, weights, link)
                slope = p * (1 - p)
                gap = n * (p - r)
                for k, factor in enumerate((2 * gap * (slope if link == "logit" else 1.0), gap)):
                    at = k * (width + 1)
                    flat[at] += factor.sum()
                    flat[at + 1 : at + width + 1] += factor @ x
                at = 2 * (width + 1)
                flat[at] += (n * slope).sum()
                flat[at + 1 :] += (n * slope) @ (x * x)
                with np.errstate(divide="ignore", invalid="ignore"):
                    loss = -np.where(r == 1, np.log(p), np.where(r == 0, np.log(1 - p), r * np.log(p) + (1 - r) * np.log(1 - p)))
                total += [given, n.sum(), (n * loss).sum() if link == "logit" else 0.0, *((n * e).sum() for e in rest)]
        yield _as_blocks(total, flat)

    found = _collected(_summed_blocks(rows.select("x", *dict.fromkeys(("r", "n", *extras))).mapInArrow(partial, _BLOCK_ROWS), 3 * (width + 1)))
    total, flat = found if found else (np.zeros(3 + len(extras)), np.zeros(3 * (width + 1)))
    named = dict(zip(("gradient", "log_gradient", "precision"), flat.reshape(3, width + 1)))
    return named | dict(zip(("given", "n", "log_loss", *extras), total.tolist()))


@dataclass
class Adam:
    """Adam with weight decay; ``first`` and ``second`` are the moments kept from step to step."""

    rate: float = LEARNING_RATE
    decay: float = WEIGHT_DECAY
    betas: tuple = (0.9, 0.999)
    epsilon: float = 1e-8
    steps: int = 0
    first: np.ndarray = field(default=None, repr=False)
    second: np.ndarray = field(default=None, repr=False)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        g = gradient + self.decay * weights
        if self.first is None:
            self.first, self.second = np.zeros_like(g), np.zeros_like(g)
        one, two = self.betas
        self.steps += 1
        self.first = one * self.first + (1 - one) * g
        self.second = two * self.second + (1 - two) * g * g
        mean = self.first / (1 - one**self.steps)
        spread = np.sqrt(self.second / (1 - two**self.steps))
        return weights - self.rate * mean / (spread + self.epsilon)


def in_batch(n: int, epoch: int, batch: int, size: int, seed: int):
    """Selects the rows of one shuffled batch by their ``number`` below n."""

    def select(part):
        return permute(np.asarray(part["number"]), n, epoch, seed) // size == batch

    return select


def train(rows: DataFrame, net: DenseNet, n: int, epochs: int, batches: int = 1, seed: int = 100, optimizer: Adam = None, first_epoch: int = 0):
    """Yields (epoch, net, optimizer) after every epoch over ``rows`` (number, x, y; also ``packed``), numbered from 0 to n - 1.

    An epoch takes each row once, in ``batches`` batches of a new order. A step is one job that reads the rows and uses
    those of its batch, so batches should be few and large. A batch without a usable row takes no step.
    """
    optimizer = optimizer or Adam()
    weights, size = flatten(net), max(1, -(-n // batches))
    for epoch in range(first_epoch, epochs):
        for batch in range(batches):
            select = in_batch(n, epoch, batch, size, seed) if batches > 1 else None
            total, count, _ = summed_gradient(rows, with_weights(net, weights), select)
            if count:
                weights = optimizer.step(weights, total / count)
        yield epoch + 1, with_weights(net, weights), optimizer


def errors(rows: DataFrame, nets: dict, group: str = "split") -> DataFrame:
    """(name, group, n, mse) of every net over ``rows`` (x, y and the group).

    All nets are scored in one pass, as many as ``MODEL_BYTES`` hold at a time; tasks emit one sum per net and group.
    """
    spark = rows.sparkSession
    names = list(nets)
    size = flatten(nets[names[0]]).nbytes
    step = max(1, MODEL_BYTES // size)
    found = None
    for at in range(0, len(names), step):
        some = {name: nets[name] for name in names[at : at + step]}
        shared = spark.sparkContext.broadcast([(name, flatten(net), shapes(net), net.sigmoid_out) for name, net in some.items()])
        part = rows.mapInArrow(_error_sums(shared, group), f"name bigint, {group} string, n double, error double")
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy("name", group).agg(F.sum("n").cast("bigint").alias("n"), F.sum("error").alias("error"))
    return sums.select("name", group, "n", (F.col("error") / F.col("n")).alias("mse"))


def _error_sums(shared, group):
    def run(batches):
        totals = {}
        for batch in batches:
            for kind in batch[group].unique().to_pylist():
                here = pc.fill_null(pc.equal(batch[group], kind), False).to_numpy(zero_copy_only=False) if kind is not None else pc.is_null(batch[group]).to_numpy(zero_copy_only=False)
                for x, y, weight in _row_blocks(batch, shared.value[0][2][0][1], here):
                    for name, flat, sizes, sigmoid_out in shared.value:
                        layers = unflatten(flat, sizes)
                        gap = forward(layers, x, sigmoid_out)[-1][:, 0] - y
                        n, error = totals.get((name, kind), (0.0, 0.0))
                        totals[name, kind] = n + weight.sum(), error + (weight * gap * gap).sum()
        if totals:
            rows = [(*key, *sums) for key, sums in totals.items()]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["name", group, "n", "error"])

    return run
