"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton on folded text and normalised by length.

Folding lower-cases, maps homoglyphs to the letters that they look like, and digits and signs to those that they stand
for where a letter is in the same word, and blanks all that is no letter then. Terms are word starts or whole words. Their weights are log odds of being in toxic documents, learnt
from a bounded sample of labelled rows; at each word the longest matched term counts. A phrase of the exception list
takes away the terms that it covers. Weight and length together give a probability by a fitted logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.llm.common import append_columns, apart, materialize, slices

#: Letters of other scripts that look like Latin ones, and signs that are used for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁһӏԛԝαβεικνορτυχ", "abekmhopctyxijsdhlqwabeikvoptux", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a word that is often abuse is none. A caller adds those of their own lexicon's words.
EXCEPTIONS = (
    "trash bag",
    "trash bags",
    "trash bin",
    "trash bins",
    "trash can",
    "trash cans",
    "trash collection",
    "trash compactor",
    "trash pickup",
    "take out the trash",
    "clown fish",
    "clown loach",
    "circus clown",
    "rodeo clown",
    "pond scum",
    "soap scum",
    "idiot light",
    "idiot proof",
    "pathetic fallacy",
    "worthless check",
    "worthless securities",
    "worthless stock",
    "dumb bell",
    "dumb waiter",
    "cock a doodle",
    "weather cock",
    "moby dick",
    "dick van dyke",
    "pussy cat",
    "pussy willow",
    "tit for tat",
    "blue tit",
    "great tit",
    "crap shoot",
    "craps table",
    "hell's kitchen",
    "damn yankees",
    "killer whale",
    "killer app",
    "sucker punch",
    "kick ass movie",
    "ass and ox",
)


class _Fold(dict):
    def __missing__(self, code: int):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c).lower()
        plain = HOMOGLYPHS.get(plain, plain) if len(plain) == 1 else plain
        self[code] = out = plain if plain.isalpha() or unicodedata.category(c) == "Mn" else " "
        return out


_RUN, _SIGNS_THEN_DIGIT = re.compile(r"[0-9@$!]+"), re.compile(r"[@$!]+(?=[0-9])")


def _letters_of(m: re.Match) -> str:
    """Of a run of digits and signs: without a letter beside it a number; signs that stand before no letter are punctuation."""
    text, a, z = m.string, m.start(), m.end()
    after = text[z : z + 1].isalnum()
    if not after and not text[a - 1 : a].isalnum():
        return " "
    run = _SIGNS_THEN_DIGIT.sub(" ", m[0])
    return run if after and not text[z].isdecimal() else run.rstrip("@$!") + " "


_FOLD = _Fold({ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()})


def fold(text: str) -> str:
    """Folded words with a blank around each; a digit or sign counts as a letter only in a word that has others."""
    return f" {' '.join(_RUN.sub(_letters_of, text.lower()).translate(_FOLD).split())} "


def terms_of(text: str, shortest: int = 4, longest: int = 10) -> set[str]:
    """Words (blank at either end) and word starts (blank in front) of a text."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= shortest:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(shortest, min(len(w), longest + 1)))
    return out


@dataclass(frozen=True)
class Lexicon:
    """weights: term -> log odds; curve: factors of the columns of `shape`."""

    weights: dict[str, float]
    curve: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        """Function from a text to (weight of its matches, words)."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, w in self.weights.items():
            machine.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            machine.add_word(term := " " + " ".join(fold(phrase).split()) + " ", (len(term), None))
        if not len(machine):
            return lambda text: (0.0, len(fold(text).split()))
        machine.make_automaton()

        def match(text: str) -> tuple[float, int]:
            folded = fold(text)
            best: dict[int, tuple[int, float]] = {}
            spared: list[tuple[int, int]] = []
            for end, (n, w) in machine.iter(folded):
                at = end - n + 1
                if w is None:
                    spared.append((at, end))
                elif at not in best or best[at][0] < n:
                    best[at] = (n, w)
            for a, z in spared:
                for at in [at for at in best if a <= at < z]:
                    del best[at]
            return sum(w for _, w in best.values()), len(folded) > 2 and folded.count(" ") - 1

        return match

    def score(self, weight, words):
        """Probability of being toxic, for arrays."""
        return 1 / (1 + np.exp(-np.clip(shape(weight, words) @ np.array(self.curve), -40, 40)))


def shape(weight, words) -> np.ndarray:
    """Constant, log weight, log weight by length, and their product; without weight the length does not count."""
    weight = np.maximum(np.asarray(weight, float), 0)
    words = np.where(weight > 0, np.asarray(words, float), 0)
    total, share = np.log1p(weight), np.log((weight + 0.05) / (words + 20))
    return np.stack([np.ones_like(total), total, share, total * share], axis=-1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> tuple[float, ...]:
    """Logistic regression by Newton's method; a step is halved until it lowers the loss enough, so that it always ends."""

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * b @ b)

    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope = x.T @ (y - p) - ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), slope)
        size = 1.0
        while size > 1e-9 and (then := loss(b + size * step)) > now - 1e-4 * size * (slope @ step):
            size /= 2
        if size <= 1e-9 or now - then < 1e-10 * max(1.0, now):
            break
        b, now = b + size * step, then
    return tuple(float(v) for v in b)


def held_out(doc_id):
    """True where the remainder of the CRC-32 of the id's text by 3 is 1: such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 20_000, least_docs: int = 5, least_share: float = 0.03, least_odds: float = 8.0) -> Lexicon:
    """Lexicon from labelled rows that are not held out, at most `most_rows` of them (by a hash of the id).

    A term is in `least_docs` toxic documents and in a share of them at least, and `least_odds` times likelier there.
    Rows without a label, id or text are not learnt from; of several labels of one id the largest counts. Without toxic
    or without clean rows the lexicon is empty.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).dropna().where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).dropna().join(F.broadcast(chosen), "id")  # at most most_rows ids
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")  # an id's rows count once
    rows = materialize(rows.repartition(32), "labelled-sample")

    def split(batches):
        for batch in (part for whole in batches for part in slices(whole, 1 << 20)):
            seen = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y > 0].update(terms_of(t))
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([n[t] for t in terms], pa.int64()) for n in seen]], names=["term", "b", "a"])

    counts = rows.mapInArrow(split, "term string, b long, a long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n1, n0 = rows.agg(F.count(F.when(F.col("y") > 0, 1)), F.count(F.when(F.col("y") <= 0, 1))).first()
    if not n1 or not n0:
        return Lexicon({})
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    best = counts.where(F.col("a") >= max(least_docs, least_share * n1)).withColumn("w", odds).where(F.col("w") >= math.log(least_odds))
    # Of a word start and a longer term that is in nearly the same toxic documents, the longer one says more. Terms are
    # in a share of the toxic rows each, so there are at most the words of such a row by that share.
    found = {r.term: (r.a, r.w) for r in best.toLocalIterator()}
    covered = {t[:k] for t in found for k in range(2, len(t)) if t[:k] in found and found[t][0] >= 0.95 * found[t[:k]][0]}
    lexicon = Lexicon({t: w for t, (_, w) in found.items() if t not in covered})

    def weigh(batches):
        match = lexicon.matcher()
        for batch in batches:
            found = [match(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), batch.column(1)], names=["w", "n", "y"])

    sample = rows.mapInArrow(weigh, "w double, n long, y int").toPandas().sort_values(["w", "n", "y"])  # at most most_rows
    return Lexicon(lexicon.weights, fit_curve(shape(sample.w, sample.n), sample.y.to_numpy(float)))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold`, else 0).

    Null and empty texts weigh nothing and get the curve's value for that, as long texts without a match do. Texts are
    read whole; repeated rows stay; existing columns of these names are replaced; an empty table gives an empty table.
    """

    def make():
        match = lexicon.matcher()

        def work(column: pa.Array) -> list[pa.Array]:
            found = [match(t or "") for t in column.to_pylist()]
            return [pa.array(lexicon.score([x[0] for x in found], [x[1] for x in found]), pa.float64())]

        return work

    return append_columns(docs, [text], [T.StructField("score", T.DoubleType())], make).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that are not predicted to be toxic, with their own columns and values, whatever their names."""
    return apart(docs, [text], lambda held, t: score(held, lexicon, t, threshold).where(F.col("predicted") == 0))


def accuracy(predicted: Iterable[int], truth: Iterable[int]) -> float:
    pairs = list(zip(predicted, truth, strict=True))
    return sum(p == t for p, t in pairs) / max(1, len(pairs))
