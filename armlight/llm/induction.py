"""Equal strings around shared samples, by induced sorting with common-prefix values.

A fragment is a sample's string with what stands left and right of it. The fragments of a sample are sorted once by what
starts at the sample. Each step to the left then induces the order one byte earlier: fragments are dealt stably into
buckets by the byte in front, and the common prefix of neighbours in a bucket is one more than the least of the values
between them. Fragments that no step to come can bring to ``LENGTH`` common bytes are left out of the later ones.
"""

import numpy as np

LENGTH, SAMPLE = 100, 32
REACH = LENGTH - SAMPLE


def _range_minima(values, low, high):
    """The least of ``values[low + 1 .. high]`` for each pair of places ``low < high``."""
    out = values[high]
    wide = np.flatnonzero(high - low > 1)
    if len(wide):
        a, b = low[wide] + 1, high[wide]
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        table = values
        for k in range(int(level.max()) + 1):
            here = level == k
            out[wide[here]] = np.minimum(table[a[here]], table[b[here] - (1 << k) + 1])
            table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def covered_windows(group, ids, start, lead, content, offsets):
    """(fragment, window) of the windows of ``LENGTH`` bytes that an earlier fragment of the same group has too.

    ``group`` ascends; fragment i holds the bytes ``content[offsets[i]:offsets[i + 1]]``, stands at byte ``start`` of row
    ``ids`` and has its sample at its byte ``lead``. A window is numbered by its first byte in the fragment, at most
    ``lead``; earlier means a smaller id, then a smaller place. Fragments of repeated rows stand at the same place.
    """
    n = len(group)
    lengths = np.diff(offsets)
    count = lengths - LENGTH + 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    sooner = np.lexsort((start + lead, ids))
    at = np.stack([ids, start + lead])[:, sooner]
    rank[sooner] = np.cumsum(np.append(False, (at[:, 1:] != at[:, :-1]).any(0)))

    def bytes_at(places):
        held = (places >= 0) & (places < lengths[:, None])
        return np.where(held, content[np.where(held, places + offsets[:-1, None], 0)], 0).astype(np.uint8)

    right = np.zeros((n, -(-LENGTH // 8) * 8), np.uint8)
    right[:, :LENGTH] = bytes_at(lead[:, None] + np.arange(LENGTH))
    left = bytes_at(lead[:, None] - 1 - np.arange(REACH))
    words = right.view(">u8")
    order = np.lexsort((*words.T[::-1], group))
    differ = right[order[1:], :LENGTH] != right[order[:-1], :LENGTH]
    prefix = np.zeros(n, np.int64)
    prefix[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    prefix[1:][group[order[1:]] != group[order[:-1]]] = 0
    found = []
    for step in range(REACH + 1):
        if step:
            key = group[order] << 8 | left[order, step - 1]
            place = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[place[1:]] == key[place[:-1]]) + 1
            induced = np.zeros(len(order), np.int64)
            induced[same] = np.minimum(_range_minima(prefix, place[same - 1], place[same]) + 1, LENGTH)
            order, prefix = order[place], induced
        # what may still come to LENGTH common bytes with a neighbour
        near = prefix + (REACH - step) >= LENGTH
        alive = (near | np.append(near[1:], False)) & (lead[order] >= step)
        kept = np.flatnonzero(alive)
        if not len(kept):
            break
        if len(kept) < len(order):
            folded = np.zeros(len(kept), np.int64)
            folded[1:] = _range_minima(prefix, kept[:-1], kept[1:])
            order, prefix = order[kept], folded
        class_of = np.cumsum(prefix < LENGTH)
        here = np.flatnonzero(lead[order] - count[order] + 1 <= step)
        first = np.full(class_of[-1] + 1, n, np.int64)
        np.minimum.at(first, class_of[here], rank[order[here]])
        again = order[here][rank[order[here]] > first[class_of[here]]]
        found.append((again, lead[again] - step))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))
