"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The automaton holds all pieces; it reads a text once and at each position follows its output links to every
piece that ends there, longest first, each of which relaxes the best score of that position.  A character that
is no piece by itself costs ten less than the worst piece and is written as byte pieces.  This is the unigram
reading of a model file: the segmentation with the highest sum of the file's scores.

Texts are normalised by the library's rules of the file.  Where no piece runs from other characters into a
following space mark, the best segmentation of a text is that of its words in a row, so the different words of
a group of texts are segmented once, many at a time: `Transitions` is the same automaton over UTF-8 bytes as a
table, by which all words of a chunk advance by one byte in one array operation.  Nothing is kept between
batches.  Longer words, and whole texts of other models, are read by one walk each (`viterbi`).

Defined cases: a null text is empty and has no pieces; an empty table gives an empty result; repeated rows are
encoded each; all columns of the table are kept, and the output column replaces one of its name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import small_batches, whole

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Words of more UTF-8 bytes are walked one by one; the others advance together, so many at a time.
LONG_WORD = 64
CHUNK_WORDS = 8192
#: Characters of texts (or bytes of ids) that are taken together; a longer one stands alone.
GROUP_SIZE = 500_000
#: Bytes of the character that this byte begins in UTF-8, 0 if it goes on with one.
LEAD = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


class Transitions:
    """Aho-Corasick over UTF-8 bytes with all moves written out: of states without children, those of their failure link.

    State 0 is the root.  `first` is the longest piece that ends in a state (a state itself, 0 if none), `then` the
    next shorter one; `piece`, `length` (bytes) and `score` are of the state's own piece, `shortest` the bytes of
    the shortest piece that ends there.
    """

    def __init__(self, pieces: list[tuple[str, int, float]]):
        children: list[dict[int, int]] = [{}]
        depths: list[list[tuple[int, int, int]]] = []
        ends: dict[int, tuple[int, int, float]] = {}
        for text, i, score in pieces:
            state = 0
            for depth, byte in enumerate(own := text.encode()):
                known = children[state].get(byte)
                if known is None:
                    known = children[state][byte] = len(children)
                    children.append({})
                    if depth == len(depths):
                        depths.append([])
                    depths[depth].append((state, byte, known))
                state = known
            ends[state] = i, len(own), score
        n = len(children)
        self.piece, self.length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.score, self.shortest = np.zeros(n), np.zeros(n, np.int64)
        self.first, self.then = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for state, (i, length, score) in ends.items():
            self.piece[state], self.length[state], self.score[state] = i, length, score
        parents = np.array([bool(c) for c in children])
        parents[0] = True
        self.row = np.where(parents, np.cumsum(parents) - 1, 0)
        self.moves = np.zeros((int(parents.sum()), 256), np.int32)
        fail = np.zeros(n, np.int64)
        for depth, edges in enumerate(depths):
            above, byte, state = np.array(edges).T
            if depth:
                fail[state] = self.moves[self.row[fail[above]], byte]
            else:
                self.moves[0, byte] = state
            back, own = fail[state], self.length[state]
            self.then[state] = self.first[back]
            self.first[state] = np.where(own > 0, state, self.first[back])
            self.shortest[state] = np.where(self.first[back] > 0, self.shortest[back], own)
            inner = parents[state]
            self.row[state[~inner]] = self.row[back[~inner]]
            self.moves[self.row[state[inner]]] = self.moves[self.row[back[inner]]]
            if depth + 1 < len(depths):
                above, byte, state = np.array(depths[depth + 1]).T
                self.moves[self.row[above], byte] = state


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = tool = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.single: set[str] = set()
        texts, scores = [], []
        for i in range(tool.get_piece_size()):
            piece = tool.id_to_piece(i)
            scores.append(tool.get_score(i))
            if tool.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.shown.append(bytes([int(piece[3:-1], 16)]))
            elif tool.is_control(i) or tool.is_unknown(i):
                self.shown.append(b"" if tool.is_control(i) else " ⁇ ".encode())
            else:
                self.shown.append(piece.replace(SPACE, " ").encode())
                if not tool.is_unused(i):
                    texts.append((piece, i))
        self.unknown_id = tool.unk_id()
        self.scored = [(piece, i, scores[i]) for piece, i in texts]
        self.single.update(piece for piece, _ in texts if len(piece) == 1)
        self.unknown_score = min(scores[i] for _, i in texts) - UNKNOWN_COST
        self.by_words = all(SPACE not in piece.lstrip(SPACE) for piece, _ in texts)
        self.prefixed = tool.normalize("a").startswith(SPACE)
        self.byte_ids = np.array([self.bytes.get(b, self.unknown_id) for b in range(256)], np.uint32)
        self.shown_array = pa.array(self.shown, pa.large_binary())

    # Built by the workers that encode; those that decode need neither.

    @cached_property
    def automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for piece, i, score in self.scored:
            automaton.add_word(piece, (i, len(piece), score))
        automaton.make_automaton()
        return automaton

    @cached_property
    def moves(self) -> Transitions:
        return Transitions(self.scored)

    def viterbi(self, word: str) -> tuple[bytes, float]:
        """Ids (little-endian, 32 bits) and score of the best segmentation."""
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        single, unknown = self.single, self.unknown_score
        done = 0  # positions up to here have their final score

        def close(upto: int) -> None:
            for at in range(done + 1, upto + 1):
                if word[at - 1] not in single and best[at - 1] + unknown > best[at]:
                    best[at], back[at] = best[at - 1] + unknown, (-1, 1)

        for last, (i, length, score) in self.automaton.iter(word):
            if last > done:
                close(last)
                done = last
            start = last + 1 - length
            if best[start] + score > best[last + 1]:
                best[last + 1], back[last + 1] = best[start] + score, (i, length)
        close(n)
        ids: list[int] = []
        at = n
        while at:
            i, length = back[at]
            if i >= 0:
                ids.append(i)
            else:
                own = word[at - 1].encode()
                ids += [self.bytes[b] for b in reversed(own)] if self.bytes else [self.unknown_id]
            at -= length
        return array("I", reversed(ids)).tobytes(), best[n]

    def _chunk(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`viterbi` for many words, longest first: their ids in a row, ids per word, scores."""
        auto, n, most = self.moves, len(lengths), int(lengths[0])
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((most + 1, n), np.int32)  # the piece's state; below 0: an unknown character of so many bytes
        state = width = left = np.zeros(n, np.int64)
        for at in range(1, most + 1):
            k = int(np.count_nonzero(lengths >= at))
            byte = data[starts[:k] + at - 1]
            state = auto.moves[auto.row[state[:k]], byte]
            lead = LEAD[byte]
            width, left = np.where(lead, lead, width[:k]), np.where(lead, lead, left[:k]) - 1
            here, origin = best[at], back[at]
            ending = auto.first[state]
            word = np.flatnonzero(ending)
            ending = ending[word]
            while word.size:
                score = best[at - auto.length[ending], word] + auto.score[ending]
                better = score > here[word]
                here[word[better]], origin[word[better]] = score[better], ending[better]
                ending = auto.then[ending]
                more = np.flatnonzero(ending)
                word, ending = word[more], ending[more]
            word = np.flatnonzero((left == 0) & (auto.shortest[state] != width))
            if word.size:
                score = best[at - width[word], word] + self.unknown_score
                better = score > here[word]
                here[word[better]], origin[word[better]] = score[better], -width[word[better]]

        # From the ends back, one piece of every word at a time.
        word, at, steps = np.flatnonzero(lengths), lengths[lengths > 0], []
        count = np.zeros(n, np.int64)
        while word.size:
            piece = back[at, word].astype(np.int64)
            at = at - np.where(piece > 0, auto.length[np.maximum(piece, 0)], -piece)
            steps.append((word, piece, at))
            count[word] += 1
            more = at > 0
            word, at = word[more], at[more]
        after = np.cumsum(count)
        words, pieces, begins = (np.empty(int(count.sum()), np.int64) for _ in range(3))
        for step, (word, piece, at) in enumerate(steps):
            place = after[word] - 1 - step
            words[place], pieces[place], begins[place] = word, piece, at
        unknown = np.flatnonzero(pieces < 0)
        sizes = np.ones(len(pieces), np.int64)
        if self.bytes:
            sizes[unknown] = -pieces[unknown]
        own = auto.piece[np.maximum(pieces, 0)].astype(np.uint32)
        own[unknown] = self.unknown_id
        ids = np.repeat(own, sizes)
        if self.bytes:
            places = np.cumsum(sizes) - sizes
            for k in range(4):
                some = unknown[sizes[unknown] > k]
                ids[places[some] + k] = self.byte_ids[data[starts[words[some]] + begins[some] + k]]
        return ids, np.bincount(words, sizes, n).astype(np.int64), best[lengths, np.arange(n)]

    def _segment(self, words: pa.StringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids and score of each word."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        long = int(np.count_nonzero(lengths > LONG_WORD))
        walked = [self.viterbi(words[int(w)].as_py()) for w in order[:long]]
        ids = [np.frombuffer(found, np.uint32) for found, _ in walked]
        counts, scores = [np.array([len(i) for i in ids], np.int64)], [np.array([score for _, score in walked])]
        for at in range(long, len(order), CHUNK_WORDS):
            some = order[at : at + CHUNK_WORDS]
            for parts, part in zip((ids, counts, scores), self._chunk(data, offsets[some], lengths[some]), strict=True):
                parts.append(part)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) * 4
        flat = np.concatenate([np.empty(0, np.uint32), *ids])
        found = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return found.take(pa.array(rank)), np.concatenate(scores)[rank]

    def _words(self, text: str) -> list[str]:
        if not self.by_words:
            return [text]
        if SPACE + SPACE not in text and text.startswith(SPACE):
            return [SPACE + w for w in text[1:].split(SPACE)]
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, float]]:
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += self._words(self.library.normalize(text) if text else "")
            ends.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        ids, scores = self._segment(coded.dictionary)
        data, places = _joined(ids.take(coded.indices))
        scores = scores[coded.indices.to_numpy()].tolist()
        return [
            (bytes(data[places[a] : places[b]]), float(sum(scores[a:b]))) for a, b in zip(ends, ends[1:], strict=False)
        ]

    def encode(self, text: str) -> tuple[bytes, float]:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        ends = np.cumsum([0, *(len(array("I", i)) for i in ids)])
        data, places = _joined(self.shown_array.take(pa.array(np.frombuffer(b"".join(ids), np.uint32))))
        texts = [str(data[places[a] : places[b]], errors="replace") for a, b in zip(ends, ends[1:], strict=False)]
        return [text[1:] if self.prefixed and text.startswith(" ") else text for text in texts]

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]


def _joined(values: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """The values in a row and where each begins, and the last ends, in them."""
    places = np.frombuffer(values.buffers()[1] or bytes(8), np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2] or b""), places


def _groups(values: list) -> Iterator[list]:
    """The values in order, so many that a group has about `GROUP_SIZE` characters or bytes, or a single longer value."""
    start = held = 0
    for at, value in enumerate(values):
        if held and held + len(value) > GROUP_SIZE:
            yield values[start:at]
            start, held = at, 0
        held += len(value)
    if values:
        yield values[start:]


_loaded: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, text_col: str = "text", out: str = "encoded") -> DataFrame:
    """All columns and `out`, a struct of ids (little-endian unsigned 32-bit numbers) and score."""
    small_batches(docs.sparkSession)
    kind = pa.struct([("ids", pa.binary()), ("score", pa.float64())])

    @F.arrow_udf("struct<ids:binary,score:double>")
    def encoded(text: pa.Array) -> pa.Array:
        tool = load(model)
        found = [pair for group in _groups(text.to_pylist()) for pair in tool.encode_all(group)]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.float64())], fields=list(kind)
        )

    return docs.withColumn(out, encoded(whole(text_col)))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and `out`, the text of the ids."""
    small_batches(encoded.sparkSession)

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        tool = load(model)
        values = [i or b"" for i in ids.to_pylist()]
        return pa.array([text for group in _groups(values) for text in tool.decode_all(group)], pa.string())

    return encoded.withColumn(out, decoded(F.col(ids_col)))
