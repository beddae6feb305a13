"""Encoding a column of texts piece by piece: each distinct piece once, the others by gathering.

A text may be cut where no match of the usual word patterns of tokenizers can reach across: before white space that
follows a visible character, behind a single line break or tab between two such characters, and where letters or digits
end. Special tokens may hold marks between letters, so where one occurs only white space cuts.

Where a vocabulary drops white space and lowers letters, pieces are looked up lowered and without the white space that
starts them, so that fewer are new.
"""

import numpy as np
import pyarrow as pa

from armlight.llm.batches import utf8
from armlight.llm.terms import LOWER, WHITE

_MARK, _LETTER, _DIGIT, _WHITE = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _MARK
_KINDS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[WHITE] = _WHITE
# whether a piece may start at a byte of the second kind behind one of the first
_CUTS = np.zeros((5, 5), bool)
_CUTS[[_MARK, _LETTER, _DIGIT], _WHITE] = True
_CUTS[_LETTER, [_MARK, _DIGIT]] = True
_CUTS[_DIGIT, [_MARK, _LETTER]] = True


def piece_starts(content: np.ndarray, offsets: np.ndarray, special=()) -> np.ndarray:
    """Where pieces start in the bytes of texts that lie in a row; every text that isn't empty starts one."""
    kinds = _KINDS[content]
    # the second byte of U+00C0 to U+00FF ends a letter, but for the signs of times and division
    kinds[1:][(content[:-1] == 0xC3) & (content[1:] != 0x97) & (content[1:] != 0xB7)] = _LETTER
    starts = np.zeros(len(content), bool)
    if any(t in content.tobytes() for t in special):
        starts[1:] = (kinds[1:] == _WHITE) & (kinds[:-1] > 0) & (kinds[:-1] < _WHITE)
    else:
        starts[1:] = _CUTS[kinds[:-1], kinds[1:]]
        visible = (kinds > 0) & (kinds < _WHITE)
        starts[2:] |= visible[2:] & (kinds[1:-1] == _WHITE) & (content[1:-1] != 32) & visible[:-2]
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


class PieceCache:
    """The ids of pieces met lately, as bytes; two generations of at most ``limit`` and a slice's pieces each."""

    def __init__(self, limit: int):
        self.limit, self.recent, self.older = limit, {}, {}

    def ids(self, pieces: list, encode_new) -> list:
        """The ids of the distinct ``pieces``; ``encode_new`` maps a list of pieces to their ids."""
        if len(self.recent) > self.limit:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        found = list(map(recent.get, pieces))
        new = []
        for place in [k for k, ids in enumerate(found) if ids is None]:
            piece = pieces[place]
            if piece in older:
                recent[piece] = found[place] = older[piece]
            else:
                new.append(place)
        for at in range(0, len(new), 2000):
            some = [pieces[k] for k in new[at : at + 2000]]
            for place, piece, ids in zip(new[at : at + 2000], some, encode_new(some), strict=True):
                recent[piece] = found[place] = ids
        return found


def _folded(content: np.ndarray, starts: np.ndarray, special):
    """(content, starts) with A to Z lowered and without the white space byte that starts a piece.

    A letter before a mark that may combine with it stays: some pairs are one letter in lower case only. So does all of
    a content that would spell a special token.
    """
    lowered = LOWER[content]
    lowered[:-1] = np.where((content[1:] < 128) | (content[1:] == 0xC3), lowered[:-1], content[:-1])
    lowered[-1:] = content[-1:]
    if any(t in lowered.tobytes() for t in special):
        lowered = content
    blank = WHITE[content[starts]]
    kept = np.ones(len(content), bool)
    kept[starts[blank]] = False
    return lowered[kept], starts - (np.cumsum(blank) - blank)


def encode_column(column, cache: PieceCache, encode_new, dtype: str, special=(), whole: bool = False, fold: bool = False):
    """(all ids of the texts in a row, ids per text); null counts as empty, ``whole`` keeps texts uncut.

    ``fold`` is for vocabularies that drop white space and lower letters.
    """
    content, offsets = utf8(column)
    if not len(content):
        return np.zeros(0, dtype), np.zeros(len(column), np.int64)
    starts = offsets[:-1][np.diff(offsets) > 0] if whole else piece_starts(content, offsets, special)
    begins = starts
    if fold and not whole:
        content, begins = _folded(content, starts, special)
    bounds = np.append(begins, len(content)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(content))])
    coded = pieces.dictionary_encode()
    which = coded.indices.to_numpy()
    found = cache.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), encode_new)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(dtype).itemsize
    flat = np.frombuffer(b"".join(found), dtype)
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    at = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - lengths), lengths) + np.arange(ends[-1])
    before = np.append(0, ends)[np.searchsorted(starts, offsets)]
    return flat[at], np.diff(before)
