"""BPE encoding and decoding by a token automaton.

The automaton starts as one state that any base symbol loops on. Each merge (a, b) -> c, in order, applies a gadget:
the state that a-arcs lead to is copied without its b-arc, a-arcs are redirected to the copy, and each state with an
a-arc gets a c-arc to where the b-arc led. The accepted token sequences are then exactly the BPE encodings, one per
string. All arcs of a token lead to one state, so states are named by tokens: the state of c = (a, b) is what the state
of b was when c was made, less the arcs that c has lost since. Only lost arcs are stored, with the merge that took them.

A word is encoded from left to right: the transitions out of a position are the tokens that spell the next symbols, and
each prefix has one encoding, so one state. Decoding emits the labels of the arcs taken.

Results: null and empty texts encode to no ids and decode to the empty string. The text of a special token becomes
its id. Ids are the same for a text wherever and however often it occurs.
"""

import json
import unicodedata
from array import array

import regex

WORD_END = "</w>"
# fixed: the splitting pattern of the tokenizer file this module reads
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# separators of str.split() that the tokenizer takes for symbols
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, as in byte-level BPE vocabularies."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
    return [moved.get(b, chr(b)) for b in range(256)]


class MergeAutomaton:
    """The automaton of a list of merges; see the module's text.

    ``parts`` and ``birth`` of a token are the merge that made it and its rank (base symbols: none, -1). ``lost`` maps
    (token of the state, token of the arc) to the rank of the merge that removed the arc.
    """

    def __init__(self, vocab: dict[str, int], merges):
        size = max(vocab.values()) + 1
        self.birth, self.parts = [-1] * size, [None] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._apply_gadget(rank, vocab[a], vocab[b], vocab[a + b])

    def _apply_gadget(self, rank, a, b, c):
        if self.parts[c] is None and self._has_arc(a, b):
            self.birth[c], self.parts[c] = rank, (a, b)
            self.lost[a, b] = rank

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow the token ``state``, remembered."""
        key = state << 20 | token
        found = self.known.get(key)
        if found is None:
            found = self._has_arc(state, token)
            if len(self.known) < 1_000_000:
                self.known[key] = found
        return found

    def _has_arc(self, state, token):
        """An arc is missing if the state, or one it was copied from before it was made, has lost a beginning of it."""
        before = len(self.lost) + len(self.birth)
        while True:
            start, until = token, before
            while True:
                taken = self.lost.get((state, start))
                if taken is not None and taken < before and taken <= until:
                    return False
                if self.parts[start] is None:
                    break
                until, start = self.birth[start], self.parts[start][0]
            if self.parts[state] is None:
                return True
            before, state = min(before, self.birth[state]), self.parts[state][1]


class Encoder:
    """Encodes texts with a tokenizer file of BPE merges with word ends.

    ``cache_limit`` bounds the words and chunks remembered in a Python worker; results don't depend on it.
    """

    def __init__(self, path: str, cache_limit: int = 200_000):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.automaton = MergeAutomaton(vocab, merges)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.labels = [""] * (max(max(vocab.values()), *self.special.values(), 0) + 1)
        for text, i in (vocab | self.special).items():
            self.labels[i] = text
        # tokens that no string contains have no arc
        ends = {i: t.removesuffix(WORD_END) for t, i in vocab.items()}
        vocab = {t: i for t, i in vocab.items() if len(ends[i]) == 1 or self.automaton.parts[i] is not None}
        # text of symbols -> token that it spells, or -1 where it only begins one
        self.arcs = dict(vocab)
        for text in vocab:
            symbols = text.removesuffix(WORD_END) if text != WORD_END else text
            for end in range(1, len(symbols) + 1):
                self.arcs.setdefault(symbols[:end], -1)
        # the same without the word end, for tokens that end a word
        self.final = {t.removesuffix(WORD_END): i for t, i in vocab.items() if t.endswith(WORD_END) and t != WORD_END}
        self.longest_final = max(map(len, self.final), default=0)
        self.symbols = byte_symbols()
        self.cache_limit = cache_limit
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _arcs_from(self, word, start, end):
        """Tokens that spell the next symbols but not the last one, the longest last, with the position each leads to."""
        arcs, found = self.arcs, []
        for stop in range(start + 1, end):
            token = arcs.get(word[start:stop])
            if token is None:
                break
            if token >= 0:
                found.append((stop, token))
        return found

    def word_ids(self, word: str) -> bytes:
        """Ids of one pre-split word as little-endian unsigned 16-bit numbers.

        Transitions are tried from the longest on. A position has one state however it is reached, so each is
        entered once and the walk is linear in the word.
        """
        end, final, known, has_arc = len(word), self.final, self.automaton.known, self.automaton.has_arc
        token = final.get(word)
        if token is not None:
            return token.to_bytes(2, "little")
        open_arcs, path, entered = [self._arcs_from(word, 0, end)], [], set()
        while True:
            if not open_arcs[-1]:
                open_arcs.pop()
                path.pop()
                continue
            stop, token = open_arcs[-1].pop()
            if stop in entered:
                continue
            if path and not known.get(path[-1] << 20 | token) and not has_arc(path[-1], token):
                continue
            path.append(token)
            last = final.get(word[stop:]) if end - stop <= self.longest_final else None
            if last is not None and has_arc(token, last):
                path.append(last)
                return array("H", path).tobytes()
            entered.add(stop)
            open_arcs.append(self._arcs_from(word, stop, end))

    def _chunk_ids(self, chunk: str) -> bytes:
        """Ids of a text without white space, not yet normalised."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = unicodedata.normalize("NFC", chunk)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        words, symbols, found = self.words, self.symbols, []
        for word in (text,) if text.isascii() and text.isalpha() else WORD_PATTERN.findall(text):
            ids = words.get(word)
            if ids is None:
                plain = word.isascii() and word.isprintable()
                ids = self.word_ids(word if plain else "".join(symbols[b] for b in word.encode("utf-8", "surrogatepass")))
                if len(words) < self.cache_limit and len(word) < 64:
                    words[word] = ids
            found.append(ids)
        return b"".join(found)

    def _plain_ids(self, text: str) -> bytes:
        pieces = WHITE.split(text) if any(c in text for c in _NOT_SPACE) else text.split()
        chunks, out = self.chunks, []
        for piece in pieces:
            ids = chunks.get(piece)
            if ids is None:
                ids = self._chunk_ids(piece)
                if len(chunks) < self.cache_limit and len(piece) < 64:
                    chunks[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, two bytes each; null counts as empty."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._plain_ids(text)
        parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
        return b"".join(
            self.special[p].to_bytes(2, "little") if p in self.special else self._plain_ids(p) for p in parts
        )

    def decode(self, ids) -> str:
        """Labels of the arcs, one space between two; the tokenizer file names no decoder that would join them."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


WORD_PATTERN = regex.compile(WORDS)
WHITE = regex.compile(r"[\p{White_Space}]+")
