"""Token counts of a byte-level BPE vocabulary by compiled transducers.

Two deterministic finite-state transducers stand in for the tokenizer. The *splitter* reads classes of characters
(letter, number, blank, other white space, apostrophe, the letters of contractions, anything else) and its
transitions say where a piece begins. A batch of texts is cut into blocks; every block's map from each start state
to its end state is computed for all blocks at once, the maps are composed by a parallel prefix scan, and the
blocks are read again from their true start states. The *merger* reads the bytes of a piece; its transitions carry
the change of the number of tokens emitted so far. A state of it holds, for each place at which a token that is
still open may begin, the node of the vocabulary's trie reached from there, the last token before the place, and
how many tokens lie between the place and here. A token ends a prefix exactly when the pair it makes with the token
before it survives all merges, so one candidate is left at each byte. Transitions are compiled when they are first
read and kept; equal pieces of a batch are read once. A piece that fills a whole text takes one step a byte.

Counts are those of the library for the file, without added tokens; the string of a special token inside a text is
that one token, as by its default. Null and empty texts have no tokens. Repeated rows give repeated rows, other
columns are left out, an empty table gives none. Rows stay where they are: nothing is shuffled, the vocabulary
(1.6 MB) and one byte a code point (1.1 MB) are broadcast."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import BASE, Texts, _bytes_table, pieces, span_hash

LIMIT = 512
#: States of the merger kept before it starts anew (1.3 kB each), and answers kept about pairs of tokens (100 bytes each).
MAX_STATES = 100_000
MAX_PAIRS = 1 << 19
BLOCK = 32
#: Fewer pieces than this are read one after the other.
FEW = 8
#: Nodes with no more tokens below them tell the tokens before them apart only by what they allow.
MANY = 48

# Classes of characters.
END, LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, STMD, RV, L, E = range(11)
CLASSES = 11
LETTERS = (LETTER, STMD, RV, L, E)
#: The code points that count as white space.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# States of the splitter: at a piece's first character, in a run, after an apostrophe that begins a piece, after
# that and r or v, or l; after one or more white characters of which the last is a blank or not.
START, IN_L, IN_N, IN_O, Q0, Q_RV, Q_L, BLANK1, SPACE1, BLANK2, SPACE2 = range(11)
STATES = 11


# -- the splitter --------------------------------------------------------------------------------


def _fresh(c: int) -> int:
    """State after the first character of a piece."""
    return {NUMBER: IN_N, BLANK: BLANK1, SPACE: SPACE1, OTHER: IN_O, QUOTE: Q0}.get(c, IN_L)


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, where pieces begin: 1 at this character, 2 at the one before it)."""
    if state in (Q_RV, Q_L):
        if c == (E if state == Q_RV else L):
            return START, 0
        after, here = _step(IN_L, c)
        return after, here | 2
    if c == END:
        return START, 0
    white = c in (BLANK, SPACE)
    if state in (BLANK1, SPACE1, BLANK2, SPACE2):
        if white:
            return (BLANK2 if c == BLANK else SPACE2), 0
        joined = IN_O if c == QUOTE else _fresh(c)
        return {BLANK1: (joined, 0), SPACE1: (_fresh(c), 1), BLANK2: (joined, 2), SPACE2: (_fresh(c), 3)}[state]
    if state == Q0 and c in (STMD, RV, L):
        return {STMD: START, RV: Q_RV, L: Q_L}[c], 0
    same = {IN_L: LETTERS, IN_N: (NUMBER,), IN_O: (OTHER, QUOTE), Q0: (OTHER, QUOTE)}.get(state, ())
    if c in same:
        return (IN_O if state == Q0 else state), 0
    return _fresh(c), 1


@lru_cache(None)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks for three characters at a time; bit j of a mark: a piece begins j - 1 characters after the first of the three."""
    after = np.empty((STATES, CLASSES ** 3), np.uint8)
    marks = np.empty((STATES, CLASSES ** 3), np.uint8)
    for state in range(STATES):
        for word in range(CLASSES ** 3):
            s, m = state, 0
            for j, c in enumerate((word // CLASSES ** 2, word // CLASSES % CLASSES, word % CLASSES)):
                s, here = _step(s, c)
                m |= (here >> 1 & 1) << j | (here & 1) << j + 1
            after[state, word], marks[state, word] = s, m
    return after.ravel(), marks.ravel()


def begins(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character of one sequence of classes (texts end by END)."""
    n = len(classes)
    wide = 3 * BLOCK
    blocks = max(1, -(-n // wide))
    padded = np.zeros(blocks * wide, np.int32)
    padded[:n] = classes
    words = ((padded[0::3] * CLASSES + padded[1::3]) * CLASSES + padded[2::3]).reshape(blocks, BLOCK)
    after, marks = splitter()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.int32), (blocks, STATES))
    for k in range(BLOCK):
        maps = after[maps * CLASSES ** 3 + words[:, k, None]].astype(np.int32)
    # prefix scan: after the round of width d a map covers the 2 * d blocks up to its own
    d = 1
    while d < blocks:
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d], 1)])
        d *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int32)
    found = np.empty((blocks, BLOCK), np.uint8)
    for k in range(BLOCK):
        at = state * CLASSES ** 3 + words[:, k]
        found[:, k] = marks[at]
        state = after[at].astype(np.int32)
    found = found.ravel()
    out = np.zeros(blocks * wide, bool)
    for j in range(3):
        out[j::3] = found >> j + 1 & 1 == 1
    before = np.flatnonzero(found & 1) * 3 - 1
    out[before] = True
    return out[:n]


def class_table(tokenizer) -> np.ndarray:
    """Class of every code point. Code points that this Python does not know are asked of the library."""
    table = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = NUMBER
        elif kind == "Cn" and c & 0xFFFE != 0xFFFE and not 0x40000 <= c < 0xE0000:
            unknown.append(c)
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for at in range(0, len(unknown), 500):
        part = unknown[at:at + 500]
        for kind, head in ((LETTER, "a"), (NUMBER, "1")):
            stops = {b for _, (_, b) in split("".join(f"{head}{chr(c)}\n" for c in part))}
            table[[c for i, c in enumerate(part) if 3 * i + 1 not in stops]] = kind
    table[list(WHITE)] = SPACE
    table[0x20] = BLANK
    for letters, kind in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
        table[[ord(c) for c in letters]] = kind
    return table


# -- the merger ----------------------------------------------------------------------------------


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: Latin-1 letters and signs stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Lazily compiled transducer over the bytes of a piece."""

    def __init__(self, model: dict):
        stand = _byte_of_char()
        spell = {t: bytes(stand[c] for c in t) for t in model["vocab"] if all(c in stand for c in t)}
        self.ids = {spell[t]: i for t, i in model["vocab"].items() if t in spell}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.ids[spell[a] + spell[b]]
            pair = (self.ids[spell[a]], self.ids[spell[b]])
            self.rank[pair] = r
            self.parts.setdefault(whole, pair)
        self.children: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for text, i in self.ids.items():
            if not self.whole(i):
                continue
            node = 0
            for b in text:
                self.inner[node] = True
                at = self.children.get(node << 8 | b)
                if at is None:
                    at = self.children[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = at
            self.token[node] = i
        self.below: list[list[int] | None] = [[] for _ in self.token]
        for at, child in reversed(self.children.items()):  # children were numbered after their parents
            held = self.below[child]
            own = [self.token[child]] if self.token[child] >= 0 else []
            above = self.below[at >> 8]
            self.below[at >> 8] = None if held is None or above is None or len(held) + len(own) + len(above) > MANY else above + held + own
        self.fits: dict[int, bool] = {}
        self.reset()

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(piece, rank of the merge that takes it up) along one edge of the token's merge tree."""
        out, taken = [], float("inf")
        while True:
            out.append((token, taken))
            if token not in self.parts:
                return out
            taken = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def crossed(self, a: int, b: int, own: bool) -> bool:
        """Whether some merge joins an end of ``a`` with a beginning of ``b`` (other than the two as wholes, if ``own``)."""
        right = self.spine(b, 0)
        for x, x_taken in self.spine(a, 1):
            for y, y_taken in right:
                r = self.rank.get((x, y))
                # of equal merges the left one comes first
                if r is not None and r < x_taken and r <= y_taken and not (own and x == a and y == b):
                    return True
        return False

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes merge into it."""
        stack = [token]
        while stack:
            t = stack.pop()
            if t in self.parts:
                a, b = self.parts[t]
                if self.crossed(a, b, True):
                    return False
                stack += [a, b]
        return True

    def pair(self, a: int, b: int) -> bool:
        key = a << 24 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            found = self.fits[key] = not self.crossed(a, b, False)
        return found

    def open(self, node: int, before: int) -> int | None:
        """A token that stands for all that allow the same tokens below the node as ``before`` does; None if there are none.
        Above nodes with many tokens every token stands for itself."""
        key = node << 24 | before + 1
        found = self.stand.get(key, -2)
        if found == -2:
            tokens, found = self.below[node], before
            if tokens is not None and before >= 0:
                fit = tuple(t for t in tokens if self.pair(before, t))
                found = self.first.setdefault((node, fit), before) if fit else None
            if len(self.stand) >= MAX_PAIRS:
                self.stand.clear()
            self.stand[key] = found
        return found

    def reset(self) -> None:
        self.stand: dict[int, int | None] = {}
        self.first: dict[tuple[int, tuple], int] = {}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.next = np.full(256 * 64, -1, np.int32)
        self.delta = np.zeros(256 * 64, np.int8)

    def compile(self, at: int) -> None:
        """Fill the transition ``state * 256 + byte``."""
        state, byte = self.states[at >> 8], at & 255
        kept, last, change = [], None, 0
        for node, before, tokens in state:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            if self.inner[child]:
                stand = self.open(child, before)
                if stand is not None:
                    kept.append((child, stand, tokens))
            token = self.token[child]
            if last is None and token >= 0 and (before < 0 or self.pair(before, token)):
                last, change = token, 1 - tokens
        if last is None:
            raise ValueError("no token ends here: the vocabulary is not one of byte-level merges")
        after = (*((child, before, tokens + change) for child, before, tokens in kept), (0, last, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
            if len(self.states) << 8 > len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros(len(self.delta), np.int8)])
        self.delta[at], self.next[at] = change, number

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each span of bytes."""
        if len(self.states) > MAX_STATES:
            self.reset()
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        left = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if len(size) else []
        for k, n in enumerate(left):
            if n < FEW:
                for i in range(n):
                    state[i], total[i] = self.follow(data[start[i] + k:start[i] + size[i]].tolist(), int(state[i]), int(total[i]))
                break
            at = state[:n] << 8 | data[start[:n] + k]
            after = self.next[at]
            if (after < 0).any():
                for a in np.unique(at[after < 0]).tolist():
                    self.compile(a)
                after = self.next[at]
            total[:n] += self.delta[at]
            state[:n] = after
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def follow(self, data: list[int], state: int, total: int) -> tuple[int, int]:
        for b in data:
            at = state << 8 | b
            if self.next[at] < 0:
                self.compile(at)
            total += int(self.delta[at])
            state = int(self.next[at])
        return state, total


# -- texts ---------------------------------------------------------------------------------------


class Counter:
    """Both transducers for one tokenizer file."""

    def __init__(self, file: bytes, classes: bytes):
        spec = json.loads(file)
        self.merger = Merger(spec["model"])
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.classes = np.frombuffer(classes, np.uint8)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text."""
        texts = Texts(column)
        data, offs = texts.data, texts.offs
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = code_points(data, lead)
        kinds = self.classes[code]
        tokens = np.zeros(texts.n, np.int64)
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                text = int(np.searchsorted(offs, at, side="right")) - 1
                if at + len(special) <= offs[text + 1]:
                    tokens[text] += 1
                    kinds[np.searchsorted(lead, at):np.searchsorted(lead, at + len(special))] = END
                at = raw.find(special, at + len(special))
        # an END after each text; place[i] is the character's place with them
        first = np.searchsorted(lead, offs)
        place = np.arange(len(lead)) + np.repeat(np.arange(texts.n), np.diff(first))
        classes = np.zeros(len(lead) + texts.n, np.uint8)
        classes[place] = kinds
        begin = begins(classes)
        stops = np.flatnonzero(begin | (classes == END))
        of = np.searchsorted(stops, np.flatnonzero(begin))
        byte = np.empty(len(classes), np.int64)
        byte[place] = lead
        byte[first[1:] + np.arange(texts.n)] = offs[1:]
        start, end = byte[stops[of]], byte[stops[np.minimum(of + 1, len(stops) - 1)]]
        if len(start):
            spans = span_hash(_bytes_table(False)[data], BASE)(start, end)
            _, one, which = np.unique(spans, return_index=True, return_inverse=True)
            each = self.merger.count(data, start[one], (end - start)[one])[which]
            tokens += np.bincount(np.searchsorted(offs, start, side="right") - 1, each, texts.n).astype(np.int64)
        return np.diff(offs), tokens


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 characters that begin at ``lead``."""
    b = data[lead].astype(np.int32)
    size = 1 + (b >= 0xC0).astype(np.int32) + (b >= 0xE0) + (b >= 0xF0)
    code = np.where(size == 1, b, b & (0xFF >> (size + 1)))
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
    return code


@lru_cache(2)
def _counter(file: bytes, classes: bytes) -> Counter:
    return Counter(file, classes)


@lru_cache(2)
def _compiled(path: str) -> tuple[bytes, bytes]:
    from tokenizers import Tokenizer

    file = Path(path).read_bytes()
    spec = json.loads(file)
    kind = spec["pre_tokenizer"]
    if (spec["model"]["type"], kind["type"], kind["add_prefix_space"], kind["use_regex"], spec["normalizer"]) != ("BPE", "ByteLevel", False, True, None):
        raise ValueError(f"{path} is not a byte-level BPE file without a normalizer")
    return file, class_table(Tokenizer.from_file(path)).tobytes()


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; ``path`` is the tokenizer's file on the driver."""
    shipped = docs.sparkSession.sparkContext.broadcast(_compiled(path))

    def run(batches):
        count = _counter(*shipped.value)
        for part in pieces(batches):
            size, tokens = count(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pc.greater(pa.array(tokens, pa.int64()), limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
