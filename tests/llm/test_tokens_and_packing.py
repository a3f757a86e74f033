"""Token counts, pieces and packing against the libraries and brute force."""

import itertools
import random
import re
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from palisade.llm import packing, pieces, token_counts, tokens
from palisade.llm.common import new_folder

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a b\n", "don't stop", "x<|endoftext|>y z", "a <|endoftext|> b",
    "é è ê", "tab\tand\x0bmore", "12 345 6,7", "　wide   line", "emoji 😀 é", "a\x1cb c", "x" * 5000,
    "many words in one row " * 400,
]


def plain():
    return tokenizers.Tokenizer.from_file(JSON)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, b"d", 1, "z") for i, t in rows], "doc_id bigint, text string, digest binary, n_tokens int, id string")


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(text):
    assert list(array("I", tokens.load(JSON).packed(text))) == plain().encode(text, add_special_tokens=False).ids


def test_ids_of_given_texts(spark, sf):
    library = plain()
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert list(array("I", tokens.load(JSON).packed(row.text))) == library.encode(row.text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(name):
    path = public_tokenizers.path(name)
    text = "Some  words, é and\nmore"
    if name.endswith(".model"):
        expected = sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    elif name.endswith(".json"):
        expected = tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    else:
        expected = tokens._ranked(path)[0].encode_ordinary(text)
    assert list(array("I", tokens.load(path).packed(text))) == list(expected)


def test_counts_and_cache(spark):
    cache = new_folder(spark, "test-cache")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, " "), (1, " "), (50, None), (None, "a"), (60, "many words in one row " * 400)]
    library = plain()
    expected = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)

    def counted(some):
        return sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(frame(spark, some), cache, JSON).collect())

    assert counted(rows) == expected
    stored = token_counts.read_cache(spark, cache)
    assert stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    before = stored.count()
    assert counted(rows) == expected
    assert token_counts.read_cache(spark, cache).count() == before
    counted([*rows, (99, "a new text")])
    assert token_counts.read_cache(spark, cache).count() == before + 1
    assert counted([]) == []


def test_common_texts_and_both_ways_to_the_missing(spark, monkeypatch):
    rows = [(i, "the same words" if i % 3 == 0 else f"text {i % 1500}" if i % 7 else None) for i in range(6000)]
    library = plain()
    expected = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for few in (0, 10_000):
        cache = new_folder(spark, "test-cache")
        counts = token_counts.token_counts(frame(spark, rows).repartition(5), cache, JSON, few_misses=few)
        assert sorted(map(tuple, counts.collect())) == expected
        assert token_counts.read_cache(spark, cache).count() == len({t or "" for _, t in rows})
    monkeypatch.setattr(token_counts, "_counted", lambda path: pytest.fail("a warm cache encodes nothing"))
    assert sorted(map(tuple, token_counts.token_counts(frame(spark, rows), cache, JSON).collect())) == expected


def test_cache_is_kept_per_tokenizer(spark):
    cache = new_folder(spark, "test-cache")
    token_counts.token_counts(frame(spark, [(1, "two words")]), cache, JSON).collect()
    token_counts.token_counts(frame(spark, [(1, "two words")]), cache, MODEL).collect()
    assert token_counts.read_cache(spark, cache).select("tokenizer").distinct().count() == 2


# ---- SentencePiece ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """The file's pieces and scores as a unigram model, its lowest scores lifted.

    Runs of space marks have the score -1e9 in the file.  The library compares sums in single precision, which steps
    by 64 there, so it cannot tell segmentations with such a piece apart.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000.0)
    path = tmp_path_factory.mktemp("unigram") / "lifted.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_pieces_equal_the_library_in_unigram_mode(spark, sf, unigram_file):
    library, own = sentencepiece.SentencePieceProcessor(model_file=unigram_file), pieces.load(unigram_file)
    # The library sums in single precision, which an unknown character (a line break here) uses up in longer texts.
    texts = ["", " ", "  two  spaces ", "line\nbreak\ttab", "é ü 梦 😀", "a▁b", "Hello world"]
    texts += [" ".join(r.text.split()[:40]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for text in texts:
        assert list(array("I", own.encode(text)[0])) == library.encode(text), text


def test_viterbi_finds_the_best_segmentation():
    own = pieces.load(MODEL)
    scores = {own.library.id_to_piece(i): own.library.get_score(i) for i in range(3, own.library.get_piece_size())}
    rng = random.Random(4)
    for _ in range(100):
        word = "▁" + "".join(rng.choice("thearingo") for _ in range(rng.randint(1, 9)))
        best = max(
            sum(scores[p] for p in parts)
            for cuts in itertools.product([0, 1], repeat=len(word) - 1)
            for parts in ["".join(c + ("\0" if k else "") for c, k in zip(word, [*cuts, 0], strict=True)).split("\0")]
            if all(p in scores for p in parts)
        )
        assert own.viterbi(word)[1] == best


def odd_texts(seed, n=200):
    rng = random.Random(seed)
    texts = ["", " ", "  ", "\n", "▁", "a▁▁b", "\0", "x\0y", " lead", "trail  ", "梦" * 40, "ab" * 90, "one two one two"]
    return texts + ["".join(rng.choice("theare ▁\n梦😀é中国\x7fñ., ") for _ in range(rng.randint(0, 90))) for _ in range(n)]


def walked_by_word(own, text):
    text = own.library.normalize(text) if text else ""
    words = re.findall("▁+[^▁]*|[^▁]+", text) if own.by_words else [text]
    found = [own.viterbi(word) for word in words]
    return b"".join(ids for ids, _ in found), sum(score for _, score in found)


def test_short_words_are_not_walked_one_by_one(monkeypatch):
    own, texts = pieces.PieceModel(MODEL), odd_texts(5)
    expected = [walked_by_word(own, text) for text in texts]
    walk, walked = own.viterbi, []
    monkeypatch.setattr(own, "viterbi", lambda word: walked.append(word) or walk(word))
    assert [own.encode(text) for text in texts] == expected
    assert walked and all(len(word.encode()) > 64 for word in walked)
    monkeypatch.setattr(pieces, "CHUNK_WORDS", 7)
    assert own.encode_all(texts) == expected
    assert [own.decode(ids) for ids, _ in expected] == own.decode_all([ids for ids, _ in expected])


def test_words_together_equal_single_walks_at_ties_and_without_byte_pieces(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    for piece in model.pieces:
        piece.score = -1.0 - len(piece.piece) % 2
    path = tmp_path / "ties.model"
    path.write_bytes(model.SerializeToString())
    for by_words, with_bytes in [(True, True), (True, False), (False, True)]:
        own, texts = pieces.PieceModel(str(path)), odd_texts(6, 80)
        own.by_words = by_words
        if not with_bytes:
            own.bytes.clear()
        assert own.encode_all(texts) == [walked_by_word(own, text) for text in texts]


def test_texts_are_taken_in_groups_of_bounded_size(monkeypatch):
    monkeypatch.setattr(pieces, "GROUP_SIZE", 5)
    assert list(pieces._groups(["", "abc", "de", "f", "longer than five", "", "g"])) == [
        ["", "abc", "de"], ["f"], ["longer than five"], ["", "g"]
    ]
    assert list(pieces._groups([])) == []


def test_encode_and_decode_tables(spark):
    docs = frame(spark, [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (4, " lead"), (5, "é 😀 " * 3000)])
    encoded = pieces.encode(docs, MODEL)
    assert encoded.columns == [*docs.columns, "encoded"]
    back = pieces.decode(encoded.select("doc_id", "text", "encoded.ids"), MODEL).collect()
    assert [r.decoded for r in back] == [r.text or "" for r in back]
    assert pieces.encode(frame(spark, []), MODEL).collect() == []


# ---- packing ------------------------------------------------------------------------------------------------


def best_fit_by_item(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            rooms.append((min(fitting) if fitting else capacity) - length)
            if fitting:
                rooms.remove(min(fitting))
    return len(rooms)


def fewest(items, capacity):
    """Exact number of sequences, by search."""
    best = [len(items)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(items):
            best[0] = len(rooms)
            return
        for room in sorted(set(r for r in rooms if r >= items[at])):
            rest = list(rooms)
            rest.remove(room)
            place(at + 1, [*rest, room - items[at]])
        place(at + 1, [*rooms, capacity - items[at]])

    place(0, [])
    return best[0]


def instance(rng, capacity, most):
    counts = {}
    for _ in range(rng.randint(1, most)):
        w = rng.randint(1, capacity)
        counts[w] = counts.get(w, 0) + 1
    return counts


def test_best_fit_over_counts_is_best_fit_by_item():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        counts = instance(rng, capacity, 60)
        assert sum(g.bins for g in packing.best_fit(dict(counts), capacity)) == best_fit_by_item(counts, capacity)


def test_reduction_never_costs_a_sequence():
    rng = random.Random(2)
    for _ in range(250):
        capacity = rng.choice([10, 13, 20])
        counts = instance(rng, capacity, 9)
        fixed, rest = packing.reduce_counts(dict(counts), capacity)
        items = sorted((w for w, n in counts.items() for _ in range(n)), reverse=True)
        left = sorted((w for w, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(g.bins for g in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity), counts


def test_plan_holds_every_item_once():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 100, 1024])
        counts, got = instance(rng, capacity, 80), {}
        for group in packing.plan(dict(counts), capacity):
            assert group.room == capacity - sum(w * n for w, n in group.slots) >= 0
            for w, n in group.slots:
                got[w] = got.get(w, 0) + n * group.bins
        assert got == counts


def test_pieces_and_places(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 3000), (5, "x" * 9000)] + [
        (10 + i, "some text " * i) for i in range(150)
    ]
    library = plain()
    cut = packing.pieces(frame(spark, rows), JSON).cache()
    by_doc = {}
    for r in cut.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted({(r.piece, r.start, r.length, bytes(r.ids)) for r in by_doc[i]})
        assert [x for p in own for x in array("I", p[3])] == ids
        assert [p[0] for p in own] == list(range(-(-len(ids) // 1024)))
        assert all(p[2] == 1024 for p in own[1:]) and 1 <= own[0][2] <= 1024
    placed = packing.pack(cut, 1024, ["doc_id", "piece", "ids"]).collect()
    assert len(placed) == cut.count()
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in placed)
    assert len(sequences) <= -(-total // 1024) + 2
    joined = packing.sequences(packing.pack(cut, 1024, ["doc_id", "piece", "ids"])).collect()
    assert sorted(zlib.crc32(bytes(r.ids)) for r in joined) == sorted(
        zlib.crc32(b"".join(p[2] for p in sorted(parts))) for parts in sequences.values()
    )
    assert packing.pack(cut.filter("false"), 1024, ["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="between 1 and"):
        packing.pack(cut, 100, ["doc_id"])
