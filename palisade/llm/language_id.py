"""Language identification by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features, hashed into one weight table with a column per
language; learned transitions tie neighbouring words.  Forward-backward gives each word's chances in its
context, so a text that switches languages is labelled word by word.  A text gets the language with the most
letters, each word counted by its chances; its share of the letters is the score.

The field is fitted on a bounded sample, `train_rows` whole texts per language at most, the first by a hash of
identifier and text.  Fragments of texts in different languages are joined into sequences, so that the
transitions see switches.  Fitted weights have a fixed size and are sent to every task.

Long and short texts are worked on together: step t of the recursions runs over all texts of a block that have
a word t, so the number of steps is that of the longest text.

Defined cases: a text that is null or has no letter is `und` with score 0; a null identifier is kept; null
labels are not learned from; without any labelled row every text is `und`; repeated rows are predicted each;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize, small_batches

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Words kept by a worker; beyond it the memory is emptied and filled anew, which changes no result.
MEMO_WORDS = 600_000
#: Slices of a language's hashes among which the first are chosen.
SLICES = 64


#: Marks that are no part of a word.
MARKS = ".,;:!?()[]\"'|#*$%&<>"


def words_of(text: str) -> list[bytes]:
    """Words in lower case, without marks, in UTF-8."""
    return text.lower().encode().translate(None, MARKS.encode()).split()


def letters_in(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def features(word: bytes) -> list[int]:
    """Hashed features of a word: the word itself, its ends, and all runs of three bytes."""
    w = b"<%b>" % word
    return list(map(zlib.crc32, [b"w" + w, b"p" + w[:4], b"s" + w[-4:], *[w[i:i + 3] for i in range(len(w) - 2)]]))


@dataclass
class Field:
    """Fitted weights: languages, emission weights (BUCKETS x languages), transitions, start."""

    languages: list[str]
    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def _emissions(rows: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """Score per word and language: the mean weight of the word's features."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), weights.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(counts.sum())) % BUCKETS
        sums = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(counts[full])[:-1]]))
        out[full] = sums / np.sqrt(counts[full])[:, None]
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Chances of each label at each word, log-likelihood over all sequences, and expected transitions.

    `scores` holds the sequences one after another, the longest first.  The recursions work on rows in order of
    time, so that step t is one slice over all sequences that have a word t.
    """
    if not len(scores):
        return scores, 0.0, np.zeros_like(transition)
    steps, n = int(lengths[0]), len(lengths)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    begin = np.concatenate([[0], np.cumsum(active)])
    sequence = np.repeat(np.arange(n), lengths)
    time = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = begin[time] + sequence
    top = scores.max(axis=1)
    emit = np.empty_like(scores)
    emit[place] = np.exp(scores - top[:, None])
    move, back = np.exp(transition), np.exp(transition).T.copy()
    forward, scale = np.empty_like(emit), np.empty(len(emit))
    before = np.exp(start)[None, :]
    for t in range(steps):
        at = slice(begin[t], begin[t + 1])
        now = (before if t == 0 else before[:active[t]] @ move) * emit[at]
        total = now.sum(axis=1)
        scale[at] = total
        before = np.divide(now, total[:, None], out=forward[at])
    chance, moved = forward.copy(), np.zeros_like(move)
    emit /= scale[:, None]
    later = np.ones((active[-1], scores.shape[1]))
    for t in range(steps - 2, -1, -1):
        after = emit[begin[t + 1]:begin[t + 2]] * later
        k = active[t + 1]
        moved += forward[begin[t]:begin[t] + k].T @ after
        later = np.ones((active[t], scores.shape[1])) if active[t] > k else np.empty_like(after)
        np.matmul(after, back, out=later[:k])
        chance[begin[t]:begin[t] + k] *= later[:k]
    return chance[place], float(np.log(scale).sum() + top.sum()), moved * move


def fit(texts: list[str], labels: list[str], seed: int = 7, rounds: int = 30, fragment: int = 12) -> Field:
    """Full-gradient fit by Adagrad over sequences of fragments from different texts."""
    languages = sorted(set(labels))
    index = {name: i for i, name in enumerate(languages)}
    rng = random.Random(seed)
    vocabulary: dict[bytes, int] = {}
    fragments = []
    for text, label in zip(texts, labels, strict=True):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        while ids:
            n = rng.randint(2, 2 * fragment)
            fragments.append((ids[:n], index[label]))
            ids = ids[n:]
    rng.shuffle(fragments)
    sequences = []
    while fragments:
        parts, fragments = fragments[-4:], fragments[:-4]
        sequences.append(([i for ids, _ in parts for i in ids], [y for ids, y in parts for _ in ids]))
    sequences.sort(key=lambda s: -len(s[0]))
    n = len(languages)
    field = Field(languages, np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n))
    if not sequences or n < 2:
        return field
    lengths = np.array([len(s[0]) for s in sequences])
    words = np.concatenate([s[0] for s in sequences]).astype(np.int64)
    gold = np.concatenate([s[1] for s in sequences]).astype(np.int64)
    rows = [features(w) if letters_in(w.decode()) else [] for w in vocabulary]
    counts = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) % BUCKETS
    owner = np.repeat(np.arange(len(rows)), counts)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.ones(len(words), bool)
    inside[first] = False
    seen_moves = np.zeros((n, n))
    np.add.at(seen_moves, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    seen_start = np.bincount(gold[first], minlength=n)
    squares = [np.full_like(a, 1e-8) for a in (field.emission, field.transition, field.start)]
    for _ in range(rounds):
        scores = _emissions(rows, field.emission)[words]
        chance, _, moves = forward_backward(scores, lengths, field.transition, field.start)
        wrong = -chance
        wrong[np.arange(len(words)), gold] += 1
        per_word = np.stack([np.bincount(words, wrong[:, y], len(rows)) for y in range(n)], axis=1)
        per_word /= np.sqrt(np.maximum(counts, 1))[:, None]
        slope = np.stack([np.bincount(flat, per_word[owner, y], BUCKETS) for y in range(n)], axis=1)
        slopes = (
            slope / len(words) - 1e-6 * field.emission,
            (seen_moves - moves) / len(words) - 1e-4 * field.transition,
            (seen_start - chance[first].sum(axis=0)) / len(words) - 1e-4 * field.start,
        )
        for value, g, s in zip((field.emission, field.transition, field.start), slopes, squares, strict=True):
            s += g * g
            value += 0.3 * g / np.sqrt(s)
    return field


class _Memo(dict):
    """Row of each word in a growing table of scores."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.table, self.letters = np.zeros((0, len(field.languages))), np.zeros(0)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at

    def rows(self, words: list[list[bytes]]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.table, self.letters = self.table[:0], self.letters[:0]
        flat = itertools.chain.from_iterable(words)
        found = np.fromiter(map(self.__getitem__, flat), np.int64, sum(map(len, words)))
        if self.new:
            letters = [letters_in(w.decode()) for w in self.new]
            scores = _emissions([features(w) if n else [] for w, n in zip(self.new, letters, strict=True)], self.field.emission)
            self.table, self.letters = np.concatenate([self.table, scores]), np.concatenate([self.letters, letters])
            self.new = []
        return found


def label_texts(texts: list[str], field: Field, memo: _Memo) -> list[tuple[str, float]]:
    """Language and score of each text."""
    words = [words_of(t) for t in texts]
    order = sorted((i for i, w in enumerate(words) if w), key=lambda i: -len(words[i]))
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if not order or not field.languages:
        return out
    lengths = np.array([len(words[i]) for i in order])
    rows = memo.rows([words[i] for i in order])
    chance, _, _ = forward_backward(memo.table[rows], lengths, field.transition, field.start)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letters = memo.letters[rows]
    mass = np.add.reduceat(chance * letters[:, None], first)
    total = np.add.reduceat(letters, first)
    best = mass.argmax(axis=1)
    for at, i in enumerate(order):
        if total[at] > 0:
            score = float(mass[at, best[at]] / total[at])
            out[i] = (field.languages[best[at]], min(1.0, max(0.0, score)))
    return out


#: The memory of the last field that this worker used.
_last: list = []


def _memo_of(field: Field) -> _Memo:
    mark = zlib.crc32(field.emission.tobytes())
    if not _last or _last[0] != mark:
        _last[:] = [mark, _Memo(field)]
    return _last[1]


def predict(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """All columns with `prediction`, a struct of language and score."""
    spark = small_batches(docs.sparkSession)
    sent = spark.sparkContext.broadcast(field)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def labelled(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _memo_of(sent.value)
        for part in parts:
            found = label_texts([t or "" for t in part.to_pylist()], sent.value, memo)
            yield pa.array([{"lang": lang, "score": score} for lang, score in found], kind)

    return docs.withColumn("prediction", labelled(F.col(text_col)))


def training_sample(docs: DataFrame, train: Column, train_rows: int, id_col: str, text_col: str, label_col: str):
    """At most `train_rows` texts per language, the first by hash; the languages themselves are a closed set.

    The hashes are chosen by themselves, repeated ones once; only the texts of chosen hashes leave their tasks.
    """
    rows = docs.filter(train & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")
    )
    # A language may hold most rows: the first of each of its slices, then the first of those.
    chosen = rows.select("label", "h").distinct()
    for part in (["label", F.pmod("h", F.lit(SLICES))], ["label"]):
        first = F.row_number().over(Window.partitionBy(*part).orderBy("h"))
        chosen = chosen.withColumn("at", first).filter(F.col("at") <= train_rows).drop("at")
    # At most train_rows rows per language on either side.
    found = rows.join(F.broadcast(materialize(chosen, "language-sample")), ["label", "h"]).groupBy("label", "h").agg(
        F.min("text").alias("text")
    )
    sample = sorted((r["label"], r["h"], r["text"]) for r in found.collect())
    return [text for _, _, text in sample], [label for label, _, _ in sample]


def identify(
    docs: DataFrame, train: Column, train_rows: int = 80, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "lang",
) -> tuple[DataFrame, Field]:
    """`docs` with a column `prediction`, and the field fitted on the rows for which `train` holds."""
    field = fit(*training_sample(docs, train, train_rows, id_col, text_col, label_col))
    return predict(docs, field, text_col), field

