"""Every user beside every offer, and the best offer per user.

A pairing is an equi join on a group number: each user falls into one group by a
hash of its key, and the offers are repeated in every group. All groups get the
same share of the users whatever the data look like. For the best partner both
sides are cut into groups, and each pair of groups is a cell that one task scores.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlight.operators.backprop import matrix_of
from armlight.session import fits_broadcast, shuffle_width, sized
from armlight.sources.files import stage

BROADCAST_GROUPS = 8
TILE_ROWS = 1024
# pairs scored at once: as many as one matrix product should have, as many as keep a
# handful of planes in cache, and as many hidden cells as one task should hold
DOT_PAIRS = 500_000
PLANE_PAIRS = 20_000
HIDDEN_CELLS = 4_000_000
# vectors of a box, and how far a bound may be below a score by rounding
BOX_ROWS = 32
SLACK = 1e-9
# largest product of first and second layer width that is scored unit by unit
NARROW_UNITS = 256
# cells of a pairing per task slot, and the numbers of one side that a cell may hold
CELLS_PER_SLOT = 4
CELL_NUMBERS = 1 << 24
_NO_KEY, _LAST_KEY = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BEST_TYPES = {"left_key": pa.int64(), "right_key": pa.int64(), "score": pa.float64(), "scored": pa.int64()}


def pair_all(left: DataFrame, right: DataFrame, left_key: str, groups: int | None = None) -> DataFrame:
    """All (left, right) pairs; ``right`` is the smaller side.

    The right side is broadcast only if all its copies fit the limit; otherwise
    both sides are shuffled on the group number.
    """
    small = fits_broadcast(right, copies=groups or BROADCAST_GROUPS)
    groups = groups or (BROADCAST_GROUPS if small else 4 * shuffle_width(left.sparkSession))
    grouped = left.withColumn("_group", F.pmod(F.xxhash64(left_key), F.lit(groups)).cast("int"))
    copies = right.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if small:
        copies = F.broadcast(copies)
    return grouped.join(copies, "_group").drop("_group")


def _dot_block(left, right):
    return left @ right.T


def _dot_rows(left, right):
    """Row by row, so that equal vectors give equal scores wherever they stand in a block."""
    return (left * right).sum(axis=1)


def _net_block(net):
    """Scores of users against offers from first-layer parts, and the pairs per block."""
    matrix, bias = net.layers[1]
    units = matrix.shape[1]
    is_narrow = matrix.size <= NARROW_UNITS

    def narrow(left, right):
        # unit by unit on contiguous (users x offers) planes: with few units the
        # matrix products below would be too thin to be worth it
        sums = [np.full((len(left), len(right)), b) for b in bias]
        plane = np.empty((len(left), len(right)))
        for unit in range(left.shape[1]):
            np.add(left[:, unit, None], right[None, :, unit], out=plane)
            np.maximum(plane, 0.0, out=plane)
            for out, row in zip(sums, matrix):
                out += row[unit] * plane
        return sums

    def block(left, right):
        if not is_narrow:
            hidden = left[:, None, :] + right[None, :, :]
            return net.finish(hidden.reshape(-1, hidden.shape[2]))[:, 0].reshape(hidden.shape[:2])
        planes = narrow(left, right)
        for weights, shift in net.layers[2:]:
            inputs = [np.maximum(p, 0.0) for p in planes]
            planes = [sum(w * x for w, x in zip(row, inputs)) + b for row, b in zip(weights, shift)]
        return 1.0 / (1.0 + np.exp(-planes[0])) if net.sigmoid_out else planes[0]

    return block, PLANE_PAIRS if is_narrow else max(1, HIDDEN_CELLS // units), _net_bound(net)


def _dot_bound(left, low, high):
    """Upper bounds of the dot products with any vector of each box."""
    return np.maximum(left, 0.0) @ high.T + np.minimum(left, 0.0) @ low.T


def _net_bound(net):
    """Upper bounds of a net's output over boxes of first-layer parts, by interval arithmetic through the layers.

    Units are bounded one by one, so the bounds of wide nets are loose and rule out little; they stay exact.
    """

    def bound(left, low, high):
        step = max(1, HIDDEN_CELLS // max(1, low.size))
        out = []
        for at in range(0, len(left), step):
            part = left[at : at + step, None, :]
            least, most = part + low[None], part + high[None]
            for matrix, shift in net.layers[1:]:
                least, most = np.maximum(least, 0.0), np.maximum(most, 0.0)
                up, down = np.maximum(matrix, 0.0).T, np.minimum(matrix, 0.0).T
                least, most = least @ up + most @ down + shift, most @ up + least @ down + shift
            out.append(most[:, :, 0])
        z = np.concatenate(out)
        return 1.0 / (1.0 + np.exp(-z)) if net.sigmoid_out else z

    return bound


def _boxes(vectors, rows=None):
    """Row numbers of boxes of at most ``BOX_ROWS`` vectors, halved along their widest dimension."""
    rows = np.arange(len(vectors)) if rows is None else rows
    if len(rows) <= BOX_ROWS:
        return [np.sort(rows)]
    here = vectors[rows]
    axis = np.argmax(here.max(0) - here.min(0))
    order = rows[np.argsort(here[:, axis], kind="stable")]
    return _boxes(vectors, order[: len(rows) // 2]) + _boxes(vectors, order[len(rows) // 2 :])


def _branch_and_bound(left, right, boxes, corners, score_block, bound_block, block_pairs):
    """(best row of ``right``, its score, pairs scored) per row of ``left``.

    Each row first meets the box of its highest bound, then only the boxes whose bound is not below its best score; the
    small slack covers rounding, so nothing that could win is left out.
    """
    best, top, scored = np.zeros(len(left), np.int64), np.full(len(left), -np.inf), 0
    bounds = bound_block(left, *corners)
    # a row with a NaN has no score with anyone
    bounds = np.where(np.isnan(bounds), -np.inf, bounds)
    first = bounds.argmax(axis=1)

    def meet(rows, box):
        nonlocal scored
        members = boxes[box]
        step = max(1, block_pairs // len(members))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            scores = score_block(left[some], right[members])
            scores = np.where(np.isnan(scores), -np.inf, scores)
            scored += scores.size
            place = scores.argmax(axis=1)
            value, member = scores[np.arange(len(some)), place], members[place]
            # rows of right stand in key order, so of equal scores the lower row wins
            better = (value > top[some]) | ((value == top[some]) & (member < best[some]) & np.isfinite(value))
            best[some[better]], top[some[better]] = member[better], value[better]

    for box in range(len(boxes)):
        meet(np.flatnonzero((first == box) & (bounds[:, box] > -np.inf)), box)
    for box in np.argsort(-bounds.max(axis=0), kind="stable"):
        slack = SLACK * (1.0 + np.abs(np.where(np.isfinite(top), top, 0.0)))
        meet(np.flatnonzero((first != box) & (bounds[:, box] >= top - slack) & (bounds[:, box] > -np.inf)), box)
    return best, top, scored


def _sorted_rows(rows, width):
    """(keys, vectors) of a side of a cell, by key; a null key stands as ``_NO_KEY``."""
    keys = rows["key"].combine_chunks().fill_null(_NO_KEY).to_numpy(zero_copy_only=False)
    order = np.argsort(keys, kind="stable")
    return keys[order], matrix_of(rows["vector"], width)[order]


def _right_tile(keys, vectors):
    """(lowest key, keys, vectors, boxes, corners) of a tile of rows by key; only finite vectors can win."""
    lowest = keys[0]
    whole = np.isfinite(vectors).all(axis=1)
    right, right_keys = vectors[whole], keys[whole]
    # of equal vectors only the lowest key can win
    right, first = np.unique(right, axis=0, return_index=True)
    by_key = np.argsort(first)
    right, right_keys = right[by_key], right_keys[first[by_key]]
    boxes = _boxes(right) if len(right) else []
    corners = boxes and (np.stack([right[b].min(0) for b in boxes]), np.stack([right[b].max(0) for b in boxes]))
    return lowest, right_keys, right, boxes, corners


def _best_in_cell(width, tile_rows, score_block, block_pairs, bound_block, score_rows=None):
    """Every left row of a cell against the right rows of the cell, tile by tile; one row per left row goes out."""

    def run(left, right):
        if not len(left) or not len(right):
            return pa.table({name: pa.array([], kind) for name, kind in _BEST_TYPES.items()})
        left_keys, left_vectors = _sorted_rows(left, width)
        right_keys, right_vectors = _sorted_rows(right, width)
        best_keys, best_scores, scored = np.full(len(left_keys), _LAST_KEY), np.full(len(left_keys), -np.inf), 0
        for start in range(0, len(right_keys), tile_rows):
            here = slice(start, start + tile_rows)
            lowest, tile_keys, tile, boxes, corners = _right_tile(right_keys[here], right_vectors[here])
            for at in range(0, len(left_keys), tile_rows):
                mine = slice(at, at + tile_rows)
                rows = left_vectors[mine]
                keys, top = np.full(len(rows), lowest), np.full(len(rows), -np.inf)
                if len(tile):
                    best, top, n = _branch_and_bound(rows, tile, boxes, corners, score_block, bound_block, block_pairs)
                    scored += n
                    if score_rows:
                        top = np.where(np.isinf(top), top, score_rows(rows, tile[best]))
                    keys = np.where(np.isinf(top), lowest, tile_keys[best])
                better = (top > best_scores[mine]) | ((top == best_scores[mine]) & (keys < best_keys[mine]))
                best_keys[mine] = np.where(better, keys, best_keys[mine])
                best_scores[mine] = np.where(better, top, best_scores[mine])
        counts = np.zeros(len(left_keys), np.int64)
        counts[0] = scored
        columns = (
            pa.array(left_keys, mask=left_keys == _NO_KEY), pa.array(best_keys, mask=best_keys == _NO_KEY), best_scores, counts
        )
        return pa.table(dict(zip(_BEST_TYPES, columns)))

    return run


def _grid(n_left: int, n_right: int, width: int, tile_rows: int, slots: int) -> tuple[int, int]:
    """Groups of the left and of the right rows; each pair of groups is a cell, and so the work of one task.

    A left row is sent once per right group and a right row once per left group, so the groups follow the sizes of the
    sides: their number depends on the slots, and grows only where a group would pass ``CELL_NUMBERS``. No group is meant
    to be smaller than a tile.
    """
    fewest = [max(1, -(-n * width // CELL_NUMBERS)) for n in (n_left, n_right)]
    most = [max(least, -(-n // tile_rows)) for n, least in zip((n_left, n_right), fewest)]
    cells = CELLS_PER_SLOT * slots

    def held(groups, side):
        return min(most[side], max(fewest[side], groups))

    of_left = held(round((cells * n_left / max(n_right, 1)) ** 0.5), 0)
    of_right = held(-(-cells // of_left), 1)
    return held(-(-cells // of_right), 0), of_right


def _dealt(rows: DataFrame, groups: int, others: int, place) -> DataFrame:
    """Rows once per group of the other side, under the number of their cell."""
    # the vector too is hashed, so rows that share a key do not share a group
    group = F.pmod(F.xxhash64("key", "vector"), F.lit(groups))
    copies = rows.select("key", "vector", group.alias("_mine"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("_other"))
    cell = place(F.col("_mine"), F.col("_other")).cast("int").alias("cell")
    # the number of partitions is given, as cells are few bytes but much work and would otherwise be coalesced
    return copies.select(cell, "key", "vector").repartition(4 * groups * others, "cell")


def _cell_bests(left, right, left_key, right_key, left_vector, right_vector, scorer, tile_rows) -> DataFrame:
    """(left_key, right_key, score, scored) per left row and cell; scored counts the pairs of a cell once."""
    sides = []
    for df, key, vector, label in ((left, left_key, left_vector, "left-vectors"), (right, right_key, right_vector, "right-vectors")):
        rows = stage(df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vector")), label)
        # the size of a null is null or -1
        sides.append((rows, *rows.agg(F.count(F.lit(1)), F.greatest(F.max(F.size("vector")), F.lit(1))).first()))
    (left, n_left, left_width), (right, n_right, right_width) = sides
    width = max(left_width or 1, right_width or 1)
    of_left, of_right = _grid(n_left, n_right, width, tile_rows, left.sparkSession.sparkContext.defaultParallelism)
    lefts = _dealt(left, of_left, of_right, lambda mine, other: mine * of_right + other)
    rights = _dealt(right, of_right, of_left, lambda mine, other: other * of_right + mine)
    schema = "left_key bigint, right_key bigint, score double, scored bigint"
    return lefts.groupBy("cell").cogroup(rights.groupBy("cell")).applyInArrow(_best_in_cell(width, tile_rows, *scorer), schema)


def pairs_scored(left, right, left_key, right_key, left_vector, right_vector, scorer=None, tile_rows=1024) -> int:
    """How many pairs ``best_partner`` scores; the others are ruled out by their bounds."""
    scorer = scorer or (_dot_block, DOT_PAIRS, _dot_bound, _dot_rows)
    found = _cell_bests(left, right, left_key, right_key, left_vector, right_vector, scorer, tile_rows)
    return found.agg(F.sum("scored")).first()[0] or 0


def best_partner(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_vector: str,
    right_vector: str,
    scorer=(_dot_block, DOT_PAIRS, _dot_bound, _dot_rows),
    tile_rows: int = TILE_ROWS,
    score_name: str = "score",
) -> DataFrame:
    """For each left row the right row with the highest score, exactly.

    Default score is the dot product (maximum inner product search). Both sides
    are written once, counted and dealt into a grid of bounded cells; nothing is
    broadcast. Inside the tasks a right tile is cut into boxes; a row is scored
    only against boxes whose upper bound reaches its best score, and only the
    best partner per row and cell leaves a task. Ties go to the lowest key.
    Vectors with a null or NaN are never the best; a row that has no score with
    any partner gets a null score.
    """
    partial = _cell_bests(left, right, left_key, right_key, left_vector, right_vector, scorer, tile_rows)
    order = Window.partitionBy("left_key").orderBy(F.desc("score"), F.asc("right_key"))
    return (
        partial.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") == 1)
        .select(
            F.col("left_key").alias(left_key),
            F.col("right_key").alias(right_key),
            F.when(F.col("score") > F.lit(float("-inf")), F.col("score")).alias(score_name),
        )
    )


def best_offer_by_net(users, offers, net, offer_features, tile_rows: int = TILE_ROWS, score_name: str = "score"):
    """Best offer per user by a net of any width."""
    user_features = [f for f in net.features if f not in offer_features]
    left = users.select("user_key", net.first_layer(user_features, True).alias("_uv"))
    right = offers.select("offer_key", net.first_layer(offer_features, False).alias("_ov"))
    return best_partner(
        left, right, "user_key", "offer_key", "_uv", "_ov", _net_block(net.to_arrays()), tile_rows, score_name
    )


def best_pair_value(users: DataFrame, offers: DataFrame, user_columns, net, offer_features, name: str) -> DataFrame:
    """Highest score over all offers for each user, beside the user's columns.

    Pairs are scored as blocks inside the tasks: ten times as many per second as
    one generated row per pair and an aggregation over them.
    """
    best = best_offer_by_net(users, offers, net, offer_features, score_name=name).select("user_key", name)
    return sized(users.select(*user_columns)).join(best, "user_key").select(*user_columns, name)


def best_by_rank(scored: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Row with the highest score per group of a frame of pairs; ties to the lowest key.

    Spark keeps one row per group in each task before the shuffle
    (WindowGroupLimit), so a large group does not reach one task.
    """
    order = Window.partitionBy(group).orderBy(F.desc(F.nanvl(score, F.lit(float("-inf")))), F.asc(key))
    return scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")
