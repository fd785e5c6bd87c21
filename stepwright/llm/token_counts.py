"""Token counts by two compiled transducers instead of an encoder.

A byte-level BPE tokenizer counts in two steps, both finite-state:

* **Splitter.** Its pattern cuts a text into pre-tokens. ``Splitter`` is a
  deterministic transducer over character classes whose transitions say whether a
  pre-token starts at this character or at the one before. All of its classes'
  products (functions from state to state) are compiled into a multiplication
  table. A text is taken in chunks side by side: each chunk's state map is the
  product of its classes, a parallel prefix scan composes the maps of the chunks
  before it, and a second pass from the states so found marks the starts.
* **Counter.** Within a pre-token BPE is a function of the prefix read so far:
  every prefix has one encoding. ``Counter`` keeps, for each suffix of the prefix
  that starts some longer token, the token before it and the number of tokens so
  far; which token ends a prefix follows from which pairs of tokens can stand side
  by side. That is a finite state. A transition is annotated with the change in the
  number of tokens, so the sum along a pre-token is its count. States are compiled
  when first met (at most ``MAX_MOVES`` transitions are held; beyond that the
  table starts anew) and pre-tokens run side by side, a byte each at a time.

Tokenizer files of other kinds (no byte-level BPE with this pattern, or
sentencepiece models) are counted by their library.

Defined cases: a null text is empty and has no tokens and no bytes. A special
token's string inside a text is one token, as the library has it by default, and
what stands on either side is split apart. Long texts are cut where white space
follows other characters, which is always the start of a pre-token, so memory does
not grow with a text that has white space. Repeated rows are counted one by one;
columns beside the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TASK_MEMORIES, map_arrow, values_of
from .token_store import default_tokenizer

#: Characters that are taken side by side, and the length of a splitter's chunk.
SLAB, CHUNK = 1 << 20, 256
#: Bytes of a pre-token that are taken side by side with others; longer ones are walked alone.
LANE_BYTES = 64
#: Transitions that a counter holds.
MAX_MOVES = 4_000_000
LIMIT = 1024

_COMPILED: dict = {}
TASK_MEMORIES.append(_COMPILED)

# -- the splitter --------------------------------------------------------------------------------------------------

#: The pre-token pattern of byte-level BPE that ``Splitter`` is compiled for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Character classes. The first five are letters; SHORT ends a one-letter contraction, R_V is r or v.
SHORT, R_V, EL, EE, LETTER, NUMBER, BLANK, WHITE, QUOTE, OTHER, END = range(11)
#: States: what the open pre-token is. BLANK1 and WHITE1 are white space of one character (a blank, another), BLANK2 and
#: WHITE2 longer runs by their last character; QUOTED is an apostrophe that starts a pre-token, QUOTED_RV and QUOTED_L
#: one with a letter after it; CLOSED can only be followed by a new pre-token.
START, LETTERS, NUMBERS, OTHERS, BLANK1, WHITE1, BLANK2, WHITE2, QUOTED, QUOTED_RV, QUOTED_L, CLOSED = range(12)
N_CLASSES, N_STATES = 11, 12
#: Marks of a transition.
HERE, BEFORE = 1, 2

_OPENS = [LETTERS] * 5 + [NUMBERS, BLANK1, WHITE1, QUOTED, OTHERS, START]
_JOINS = [LETTERS] * 5 + [NUMBERS, BLANK2, WHITE2, OTHERS, OTHERS, START]
_STAYS = {LETTERS: range(5), NUMBERS: (NUMBER,), OTHERS: (QUOTE, OTHER)}
_ENDS_CONTRACTION = {QUOTED_RV: EE, QUOTED_L: EL}


def _move(state: int, c: int) -> tuple[int, int]:
    """(next state, marks) of the splitter."""
    fresh = (_OPENS[c], HERE)
    if state in _STAYS:
        return (state, 0) if c in _STAYS[state] else fresh
    if state in _ENDS_CONTRACTION:
        if c == _ENDS_CONTRACTION[state]:
            return CLOSED, 0
        after, marks = _move(LETTERS, c)  # the apostrophe stands alone and its letter starts a word
        return after, marks | BEFORE
    if state == QUOTED:
        special = {SHORT: CLOSED, R_V: QUOTED_RV, EL: QUOTED_L, QUOTE: OTHERS, OTHER: OTHERS}
        return (special[c], 0) if c in special else fresh
    if state in (BLANK1, WHITE1, BLANK2, WHITE2):
        if c in (BLANK, WHITE):
            return _JOINS[c], 0
        if c == END:
            return fresh
        after, marks = (_JOINS[c], 0) if state in (BLANK1, BLANK2) else fresh
        return after, marks | (BEFORE if state in (BLANK2, WHITE2) else 0)
    return fresh  # START, CLOSED


class Splitter:
    """Starts of pre-tokens in texts, by chunks whose state maps are composed."""

    def __init__(self, probe):
        """``probe(s)``: the number of pre-tokens that the library makes of ``s``; it decides the class of unseen characters."""
        self.probe = probe
        self.next = np.empty(N_STATES * N_CLASSES, dtype=np.intp)
        self.marks = np.empty(N_STATES * N_CLASSES, dtype=np.uint8)
        for s, c in product(range(N_STATES), range(N_CLASSES)):
            self.next[s * N_CLASSES + c], self.marks[s * N_CLASSES + c] = _move(s, c)
        self._monoid()
        self.classes = np.full(0x110000, 255, dtype=np.uint8)
        ascii_class = [self._class_of(chr(i)) for i in range(128)]
        self.classes[:128] = ascii_class

    def _monoid(self) -> None:
        """All state maps that classes generate, their products, and each one's exit from START."""
        step = self.next.reshape(N_STATES, N_CLASSES)
        maps = [tuple(range(N_STATES))]
        number, by_class, at = {maps[0]: 0}, [], 0
        while at < len(maps):
            row = []
            for c in range(N_CLASSES):
                m = tuple(int(step[s, c]) for s in maps[at])
                if m not in number:
                    number[m] = len(maps)
                    maps.append(m)
                row.append(number[m])
            by_class.append(row)
            at += 1
        table = np.array(maps)
        self.then_class = np.array(by_class, dtype=np.intp).reshape(-1)
        self.then = np.array([[number[tuple(table[b][list(maps[a])])] for b in range(len(maps))] for a in range(len(maps))], dtype=np.intp)
        self.from_start = table[:, START]

    def _class_of(self, ch: str) -> int:
        fixed = {"s": SHORT, "t": SHORT, "m": SHORT, "d": SHORT, "r": R_V, "v": R_V, "l": EL, "e": EE, " ": BLANK, "'": QUOTE}
        if ch in fixed:
            return fixed[ch]
        for lead, found in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if self.probe(lead + ch) == 1:
                return found
        return WHITE

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points; those not seen before are asked of the library, once each."""
        c = self.classes[points]
        new = c == 255
        if new.any():
            for p in np.unique(points[new]).tolist():
                self.classes[p] = self._class_of(chr(p))
            c = self.classes[points]
        return c

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character; END classes stand between texts."""
        n = len(classes)
        m = -(-n // CHUNK)
        flat = np.full(m * CHUNK, END, dtype=np.intp)
        flat[:n] = classes
        columns = np.ascontiguousarray(flat.reshape(m, CHUNK).T)
        maps = np.zeros(m, dtype=np.intp)
        for c in columns:
            maps = self.then_class[maps * N_CLASSES + c]
        gap = 1
        while gap < m:  # prefix scan: after each turn a map covers twice as many chunks
            maps[gap:] = self.then[maps[:-gap], maps[gap:]]
            gap *= 2
        state = np.concatenate([[START], self.from_start[maps[:-1]]])
        marks = np.empty((CHUNK, m), dtype=np.uint8)
        for k, c in enumerate(columns):
            at = state * N_CLASSES + c
            marks[k], state = self.marks[at], self.next[at]
        marks = marks.T.reshape(-1)
        out = (marks & HERE).astype(bool)
        out[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return out[:n]


# -- the counter ---------------------------------------------------------------------------------------------------


class Counter:
    """Number of BPE tokens of pre-tokens, by a transducer over bytes that is compiled as it runs."""

    def __init__(self, spell: dict[bytes, int], merges: list[tuple[int, int, int]]):
        """``spell``: token of a byte string. ``merges``: (left, right, made) tokens by rank."""
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {made: (a, b, r) for r, (a, b, made) in enumerate(merges)}
        self.child: dict[int, int] = {}
        self.token, self.inner, n = [-1], [False], 1
        for word, t in spell.items():
            at = 0
            for b in word:
                self.inner[at] = True
                key = at << 8 | b
                if key not in self.child:
                    self.child[key] = n
                    self.token.append(-1)
                    self.inner.append(False)
                    n += 1
                at = self.child[key]
            self.token[at] = t
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._pairs: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        """An empty table with the state of no byte read."""
        self.states = [((0, -1, 0),)]
        self.known = {self.states[0]: 0}
        self.keys = np.full(1 << 16, -1, dtype=np.int64)
        self.moves = np.zeros(1 << 16, dtype=np.int64)
        self.n_moves, self.scalar = 0, {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token at its right (1) or left (0) border, each with the rank of the merge that takes it up."""
        memo = (self._left, self._right)[side]
        if token not in memo:
            found, taken, at = [], float("inf"), token
            while True:
                found.append((at, taken))
                if at not in self.parts:
                    break
                taken = self.parts[at][2]
                at = self.parts[at][side]
            memo[token] = found
        return memo[token]

    def side_by_side(self, a: int, b: int) -> bool:
        """Does BPE leave token ``a`` before token ``b`` as they are?

        Not if a part at the right border of ``a`` and one at the left border of ``b``
        that exist at the same time would be merged before either is taken up within its
        own token. Of equal merges the left one comes first.
        """
        key = a << 32 | b
        if key not in self._pairs:
            ok, rank = True, self.rank
            for x, x_taken in self._spine(a, 1):
                for y, y_taken in self._spine(b, 0):
                    r = rank.get((x, y))
                    if r is not None and r < x_taken and r <= y_taken:
                        ok = False
                        break
                if not ok:
                    break
            self._pairs[key] = ok
        return self._pairs[key]

    def _next(self, state: int, byte: int) -> tuple[int, int]:
        """(state, change of the count) after one more byte."""
        grown, change, last = [], None, -1
        for node, before, so_far in self.states[state]:
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            t = self.token[at]
            if change is None and t >= 0 and (before < 0 or self.side_by_side(before, t)):
                change, last = so_far + 1, t
            if self.inner[at]:
                grown.append((at, before, so_far))
        if change is None:
            raise ValueError("a byte that no token begins with")
        key = (*((at, before, n - change) for at, before, n in grown), (0, last, 0))
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.states)
            self.states.append(key)
        return found, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or the free slot where it would."""
        shift = np.uint64(64 - (len(self.keys).bit_length() - 1))
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.intp)
        held = self.keys[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held >= 0)]
        return at

    def _add(self, keys: np.ndarray) -> None:
        """Compile the transitions of distinct keys."""
        if 2 * (self.n_moves + len(keys)) > len(self.keys):
            old, moves = self.keys[self.keys >= 0], self.moves[self.keys >= 0]
            size = len(self.keys)
            while size < 4 * (self.n_moves + len(keys)):
                size *= 2
            self.keys, self.moves = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
            self._put(old, moves)
        values = []
        for k in keys.tolist():
            state, change = self._next(k >> 8, k & 255)
            values.append(state << 8 | (change + 128))
        self._put(keys, np.array(values, dtype=np.int64))
        self.n_moves += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):
            at = self._slots(keys)
            self.keys[at] = keys  # of several for one slot the last stays
            here = self.keys[at] == keys
            self.moves[at[here]] = values[here]
            keys, values = keys[~here], values[~here]

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state << 8 | byte
        at = self._slots(keys)
        missing = self.keys[at] < 0
        if missing.any():
            self._add(np.unique(keys[missing]))
            at = self._slots(keys)
        move = self.moves[at]
        return move >> 8, (move & 255) - 128

    def _walk(self, data: bytes, state: int = 0) -> int:
        """Tokens of one pre-token, a byte at a time."""
        n, scalar = 0, self.scalar
        for b in data:
            key = state << 8 | b
            if key not in scalar:
                scalar[key] = self._next(state, b)
            state, change = scalar[key]
            n += change
        return n

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens ``data[start : start + length]``."""
        if self.n_moves + len(self.scalar) > MAX_MOVES:
            self._restart()
        n = np.zeros(len(start), dtype=np.int64)
        long = np.flatnonzero(length > LANE_BYTES)
        for i in long.tolist():
            n[i] = self._walk(data[start[i] : start[i] + length[i]].tobytes())
        lanes = np.flatnonzero((length <= LANE_BYTES) & (length > 0))
        lanes = lanes[np.argsort(-length[lanes], kind="stable")]
        sizes, at = -length[lanes], start[lanes]
        state, found = np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
        for k in range(int(-sizes[0]) if len(lanes) else 0):
            m = int(np.searchsorted(sizes, -k))  # those of more than k bytes come first
            state[:m], change = self._step(state[:m], data[at[:m] + k].astype(np.int64))
            found[:m] += change
        n[lanes] = found
        return n


# -- both ----------------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Compiled:
    """Token counts under one tokenizer file."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.splitter = self.counter = None
        if path.endswith(".json"):
            self._compile()

    def _compile(self) -> None:
        import json

        tok = self.library
        spec = json.loads(tok.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        specials = spec.get("added_tokens", [])
        if not plain or model.get("type") != "BPE" or any(odd) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in specials):
            return
        letters = _byte_letters()
        vocab = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        special = {t["content"] for t in specials}
        spell = {bytes(map(letters.__getitem__, w)): t for w, t in vocab.items() if w not in special}
        if len({m[2] for m in merges}) != len(merges) or len(spell) != len(merges) + 256:
            return  # a token that is made in two ways, or in none
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.splitter = Splitter(lambda s: len(tok.pre_tokenizer.pre_tokenize_str(s)))
        self.counter = Counter(spell, merges)

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        if self.counter is None:
            return _library_counts(self.library, texts)
        totals, pieces, owner, held = [0] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                totals[i] += len(parts) - 1
            for part in parts:
                for piece in _cut(part):
                    if held and held + len(piece) > SLAB:
                        self._take(pieces, owner, totals)
                        pieces, owner, held = [], [], 0
                    pieces.append(piece)
                    owner.append(i)
                    held += len(piece) + 1
        self._take(pieces, owner, totals)
        return totals

    def _take(self, pieces: list[str], owner: list[int], totals: list[int]) -> None:
        if not pieces:
            return
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        points = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le"), dtype=np.uint32)
        classes = self.splitter.classify(points)
        ends = np.cumsum(sizes + 1) - 1
        classes[ends] = END
        cuts = np.flatnonzero(self.splitter.starts(classes))
        wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        wide[ends] = 0
        place = np.concatenate([[0], np.cumsum(wide)])
        data = np.frombuffer("".join(pieces).encode("utf-8"), dtype=np.uint8)
        start = place[cuts]
        length = np.diff(start, append=place[-1])
        length[classes[cuts] == END] = 0
        found = self.counter.counts(data, start, length)
        total = np.bincount(np.searchsorted(ends, cuts), weights=found, minlength=len(pieces)).astype(np.int64)
        for i, n in zip(owner, total.tolist()):
            totals[i] += n


def _cut(text: str, size: int = SLAB) -> list[str]:
    """The text in pieces of about ``size`` characters, cut where ASCII white space follows another character."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        found = _BREAK.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start() + 1])
        at = found.start() + 1
    return [*out, text[at:]]


#: A character that is white space in no table, then ASCII white space.
_BREAK = re.compile("[^\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff][ \n\t]")


def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _library_counts(library, texts: list[str]) -> list[int]:
    if hasattr(library, "encode_batch_fast"):
        return [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(ids) for ids in library.encode(texts, num_threads=1)]


def compiled(path: str) -> Compiled:
    """The transducers of a file, compiled once in a task."""
    if path not in _COMPILED:
        _COMPILED[path] = Compiled(path)
    return _COMPILED[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes and n_tokens of each row, in one pass without a shuffle."""
    import pyarrow as pa

    path = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType

    def run(batches):
        for b in batches:
            column, at = b.column(1), 0
            while at < b.num_rows:
                texts = [s or "" for s in column.slice(at, 250).to_pylist()]
                n = pa.array(compiled(path).counts(texts), pa.int64())
                size = pa.array([len(s.encode("utf-8")) for s in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), size, n], names=[key, "n_bytes", "n_tokens"])
                at += len(texts)

    return map_arrow(docs.select(key, F.col(text).alias("text")), run, f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: bytes and tokens of every document."""
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
