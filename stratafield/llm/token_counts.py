"""Token counts from a deterministic transducer that is compiled from the tokenizer's pieces.

A state is what a greedy pair-merging tokenizer can still need of the text so far: the longest suffix that some piece
continues, and for each place in it the last token of the encoding up to there and its count against the present one.
An arc reads a character; it carries by how much the number of tokens of the text read so far changes. The last token
of a prefix is the one piece that ends there and stands next to the last token before it in an encoding of just the
two (a sequence of tokens is an encoding if each neighbouring pair is). Arcs are compiled when first met and kept.

Two characters that are neighbours in no piece have a boundary between them that no token crosses; there the state
forgets the past. Texts are cut at boundaries into chunks, whose maps do not depend on the state before: one number
each, kept for short chunks. The numbers of a batch of texts compose by one prefix sum, of which each text takes two
places. A chunk longer than a block is cut anywhere into blocks, whose maps are made apart, each as the states and counts
that it goes through from the first state: entered in another state, a block is read until that run meets the kept
one, from where the kept numbers hold. Such maps compose; a chunk's blocks are joined in rounds of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratafield.llm.common import append_columns
from stratafield.llm.sentencepiece_codec import MARK, marked_words

#: Characters of a block, and of a stretch of blocks after which states may be forgotten.
BLOCK, STRETCH = 1 << 12, 1 << 17
#: Chunks and states that a worker keeps before it starts anew, and characters of the longest chunk that is kept.
KEPT_CHUNKS, KEPT_STATES, KEPT_LENGTH = 700_000, 400_000, 48


@dataclass(frozen=True)
class StateMap:
    """What a block does, entered in state 0: the state and the count after each of its characters."""

    text: str
    states: list[int]
    counts: list[int]


class Transducer:
    _loaded: dict[str, Transducer] = {}

    def __init__(self, model_path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = library.get_piece_size()
        plain = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in plain}
        self.prefixes = {p[:k] for p in self.score for k in range(len(p))}
        self.neighbours = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.single = {p for p in self.score if self.merge(p) == [p]}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}  # by what follows the first marker
        self.chunks: dict[str, int] = {}  # parts of longer words
        self.reset()

    @classmethod
    def load(cls, model_path: str) -> Transducer:
        if model_path not in cls._loaded:
            cls._loaded[model_path] = cls(model_path)
        return cls._loaded[model_path]

    def reset(self) -> None:
        """Forget compiled arcs. State 0: nothing before, or a boundary."""
        self.states = [("", "", ((None, 0),))]
        self.number = {self.states[0]: 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def merge(self, text: str) -> list[str]:
        """Pair merging of a short string by score, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[key] = self.merge(left + right) == [left, right]
        return known

    def compile_arc(self, state: int, c: str) -> tuple[int, int]:
        before, held, places = self.states[state]
        if before and before + c not in self.neighbours:
            held, places = "", ((None, places[-1][1]),)
        if c not in self.score:  # falls back to bytes; no token crosses it
            new, last, count = "", ((None, 0),), places[-1][1] + len(c.encode())
            target = ("", new, last)
        else:
            text = held + c
            token, count = None, 0
            for k in range(len(text)):
                piece = text[k:]
                if piece in self.single and (places[k][0] is None or self.fit(places[k][0], piece)):
                    token, count = piece, places[k][1] + 1
                    break
            assert token is not None, "a piece of one character always fits somewhere"
            k = next(k for k in range(len(text) + 1) if text[k:] in self.prefixes)
            kept = [*places[k:], (token, count)]
            target = (c, text[k:], tuple((t, n - count) for t, n in kept))
        to = self.number.setdefault(target, len(self.states))
        if to == len(self.states):
            self.states.append(target)
            self.arcs.append({})
        self.arcs[state][c] = arc = (to, count)
        return arc

    def run(self, state: int, text: str) -> tuple[int, int]:
        """End state, and by how much the count grows."""
        total, arcs = 0, self.arcs
        for c in text:
            try:
                state, more = arcs[state][c]
            except KeyError:
                state, more = self.compile_arc(state, c)
            total += more
        return state, total

    def trace(self, text: str, state: int = 0) -> StateMap:
        """Map of a block, or of one that is entered in another state."""
        states, counts, total = [], [], 0
        for c in text:
            state, more = self.arcs[state].get(c) or self.compile_arc(state, c)
            total += more
            states.append(state)
            counts.append(total)
        return StateMap(text, states, counts)

    def join(self, f: StateMap, g: StateMap) -> StateMap:
        """First f, then g: g is read from f's end until its kept states are met."""
        if not f.text or not g.text:
            return f if f.text else g
        state, total = f.states[-1], f.counts[-1]
        states, counts = list(f.states), list(f.counts)
        for i, c in enumerate(g.text):
            state, more = self.arcs[state].get(c) or self.compile_arc(state, c)
            total += more
            states.append(state)
            counts.append(total)
            if state == g.states[i]:
                states += g.states[i + 1 :]
                counts += [total - g.counts[i] + n for n in g.counts[i + 1 :]]
                break
        return StateMap(f.text + g.text, states, counts)

    def joined(self, maps: list[StateMap]) -> StateMap:
        """All maps, one after the other, in rounds of pairs that do not depend on each other."""
        while len(maps) > 1:
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def long_chunk(self, text: str, block: int) -> int:
        """Stretch by stretch; only the last state of a stretch is needed after it."""
        total, last = 0, self.states[0]
        for at in range(0, len(text), STRETCH):
            if len(self.states) > KEPT_STATES:
                self.reset()
            stretch = text[at : at + STRETCH]
            whole = self.joined([self.trace(stretch[i : i + block]) for i in range(0, len(stretch), block)])
            state = self.number.setdefault(last, len(self.states))
            if state == len(self.states):
                self.states.append(last)
                self.arcs.append({})
            if state:
                before = StateMap(" ", [state], [0])
                whole = self.join(before, whole)
            total += whole.counts[-1]
            last = self.states[whole.states[-1]]
        return total

    def alone(self, chunk: str) -> int:
        """Tokens of a chunk, or of a word; it begins at a boundary, so states may be forgotten before it."""
        if len(self.states) > KEPT_STATES:
            self.reset()
        return self.run(0, chunk)[1]

    def cut(self, text: str) -> list[str]:
        """A marked word between its boundaries."""
        at = [0, *[i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.neighbours], len(text)]
        return [text[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]

    def word(self, w: str, block: int = BLOCK) -> int:
        """Tokens of a marked word, without its first marker."""
        if len(w) <= KEPT_LENGTH:
            count = self.words[w] = self.alone(MARK + w.replace(" ", MARK))
            return count
        total = 0
        for chunk in self.cut(MARK + w.replace(" ", MARK)):
            if len(chunk) > block:
                total += self.long_chunk(chunk, block)
            elif len(chunk) > KEPT_LENGTH:
                total += self.alone(chunk)
            else:
                if chunk not in self.chunks:
                    self.chunks[chunk] = self.alone(chunk)
                total += self.chunks[chunk]
        return total

    def counts(self, texts: list[str], block: int = BLOCK) -> np.ndarray:
        """Tokens of each text: the prefix sum over all chunks, at the texts' ends."""
        if len(self.words) + len(self.chunks) > KEPT_CHUNKS:
            self.words.clear()
            self.chunks.clear()
        split = [marked_words(t) for t in texts]
        words = [w for x in split for w in x]
        found = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        for i in np.flatnonzero(found == 0).tolist():  # a word has one token at least
            found[i] = self.words.get(words[i]) or self.word(words[i], block)
        prefix = np.concatenate([[0], np.cumsum(found)])
        ends = np.cumsum([0, *map(len, split)])
        return prefix[ends[1:]] - prefix[ends[:-1]]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """df with n_bytes and n_tokens (long) and over_limit (boolean), as the library counts without begin and end ids.

    Null and empty texts have 0 bytes and 0 tokens. Very long texts are counted whole. Existing columns of
    these names, the text's own too, are replaced; repeated rows stay; an empty table gives an empty table.
    """

    def make():
        machine = Transducer.load(model_path)

        def work(column: pa.Array) -> list[pa.Array]:
            tokens = pa.array(machine.counts([t or "" for t in column.to_pylist()]), pa.int64())
            return [pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), tokens, pc.greater(tokens, limit)]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(df, [text], fields, make)
