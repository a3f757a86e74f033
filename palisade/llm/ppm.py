"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to `order` bytes, with the number of times that each symbol followed.
A symbol is predicted by the longest context of the text that training has seen; where it has not followed
there, an escape (as likely as the context's number of different symbols, method C) leads to the next shorter
context, in which the symbols already ruled out take no part (symbol exclusion).  Below order zero, symbols that
training never saw are equally likely.  The end of a text is a symbol; byte 255, which no UTF-8 text holds, stands
for it and for what lies before a text.

A pretrained model is counted over all training texts.  No task holds it whole: texts lie in blocks of bounded
size, which also end where they hold many different words or strings; a block asks for the different (context,
symbol) strings it holds, dealt by a hash of the context into buckets whose number grows with the input; a bucket's
counts are summed over all blocks, some dozens of blocks at a time; the answers go back to the block with what was
asked, where a text's code length is summed, a slice of the block at a time.  Requests, answers and texts travel as
packed arrays.  Since symbols in a longer context are a part of those in its suffix, exclusion takes from
a context's total just the sum that belongs to its child, which is kept with each child.

`adaptive` scores each text by itself, with a trie that learns along the text.

Beside it, the base: the add-one chance of each white-space word and of the end, counted over the same texts.

Defined cases: a null text is empty and has the end alone; texts longer than `CHUNK` bytes travel in parts cut at
white space and are summed again; rows that repeat an identifier keep a row each; without training texts all
symbols and all words are equally likely; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, small_batches, whole

END = 255
#: The end of a text among the words; no word holds a line break.
END_WORD = b"\n"
#: Bytes after which a text is cut at the next white space, bytes of a block, and bytes worked on at once.
CHUNK, BLOCK, SLICE = 1 << 20, 32_000_000, 2_000_000
#: Different words and strings after which a block ends, and bytes that a part of a text counts besides its own.
BLOCK_WORDS, BLOCK_STRINGS, PART_BYTES = 500_000, 4_000_000, 64
#: Bytes of text per bucket of the model, and blocks whose requests meet in one task.
BUCKET_BYTES, FAN_IN = 16_000_000, 64
ALPHABET = 256


def _chunks(data: bytes) -> list[bytes]:
    """Parts of about CHUNK bytes that each end before a white-space byte, so no word is cut."""
    out, start = [], 0
    while len(data) - start > CHUNK:
        at = next((i for i in range(start + CHUNK, len(data)) if data[i] in b" \t\n\x0b\x0c\r"), None)
        if at is None:
            break
        out.append(data[start:at])
        start = at
    return [*out, data[start:]]


def symbols(parts: list[tuple[bytes, bytes, bool]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, symbol), `order` + 1 bytes each, of all parts in a row, and how many each part has.

    A part is (context before it, its bytes, whether the text ends with it).
    """
    lengths = np.array([len(data) + last for _, data, last in parts])
    joined = b"".join(
        context.rjust(order, bytes([END])) + data + (bytes([END]) if last else b"") for context, data, last in parts
    )
    octets = np.frombuffer(joined, np.uint8)
    codes = np.zeros(max(0, len(octets) - order), np.uint64)
    for j in range(order + 1):
        codes <<= np.uint64(8)
        codes |= octets[j:j + len(codes)]
    # Windows that end in a part's own context belong to no symbol.
    starts = np.cumsum(lengths + order) - (lengths + order)
    keep = np.ones(len(octets), bool)
    for j in range(order):
        keep[starts + j] = False
    return codes[keep[order:]].view(np.int64), lengths


def _slices(rows: Iterable, size: Callable) -> Iterator[list]:
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= SLICE:
            yield part
            part, held = [], 0
    if part:
        yield part


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Places in sorted numbers where a new one begins."""
    return np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys = keys[order]
    at = _starts(keys)
    counts = np.concatenate([n for _, n in parts])[order]
    return keys[at], (np.add.reduceat(counts, at) if len(at) else counts).astype(np.int64)


# ---- packed columns -----------------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, other numbers as they are, compressed."""
    if values.dtype == np.int64 and len(values):
        values = np.diff(values, prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
    return np.cumsum(values) if kind is np.int64 else values


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    text = zstandard.ZstdDecompressor().decompress(data)
    return text.split(b" ") if text else []


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each string, by its context."""
    mixed = (grams >> 8).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _dealt(grams: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of sorted strings; places keep their order."""
    own = _bucket_of(grams, buckets)
    order = np.argsort(own.astype(np.min_scalar_type(buckets)), kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=buckets))
    for bucket in range(buckets):
        at = order[ends[bucket - 1] if bucket else 0:ends[bucket]]
        if len(at):
            yield bucket, at


def _dealt_words(words: Iterable[bytes], buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, its words, sorted)."""
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for word in words:
        out[zlib.crc32(word) % buckets].append(word)
    for bucket, some in enumerate(out):
        if some:
            yield bucket, sorted(some)


REQUESTS = "block bigint, texts binary, bucket bigint, g binary, g_n binary, w binary, w_n binary"
_REQUEST_FIELDS = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("bucket", pa.int64()), ("g", pa.binary()),
                             ("g_n", pa.binary()), ("w", pa.binary()), ("w_n", pa.binary())])

#: A part of a text: identifier, mark, number, whether the last, whether to learn, context before it, bytes.
Part = tuple


def _strings(parts: list[Part], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different strings of parts and how often training parts hold them."""
    found = []
    for learn in (True, False):
        chosen = [(p[5], p[6], p[3]) for p in parts if p[4] == learn]
        if chosen:
            codes = np.sort(symbols(chosen, order)[0])
            at = _starts(codes)
            found.append((codes[at], np.diff(at, append=len(codes)) if learn else np.zeros_like(at)))
    return found[0] if len(found) == 1 else _merge(found)


def _parts(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[Part]:
    for batch in batches:
        for key, mark, train, text in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "train", "content")), strict=True):
            cut = _chunks(text.encode().lower())
            for at, (before, data) in enumerate(zip([b"", *cut[:-1]], cut, strict=True)):
                yield key, mark, at, at == len(cut) - 1, train, before[-order:] if order else b"", data


def _size(part: Part) -> int:
    return len(part[6]) + PART_BYTES


class _Block:
    """What the slices of a block hold: strings and words with their counts in training parts."""

    def __init__(self, order: int):
        self.order = order
        self.bytes = 0
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words = Counter({END_WORD: 0})

    def add(self, parts: list[Part]) -> None:
        self.bytes += sum(map(_size, parts))
        self.grams.append(_strings(parts, self.order))
        # The first is what was merged before; the rest are merged into it when they have become as many.
        if sum(len(k) for k, _ in self.grams[1:]) > len(self.grams[0][0]) + SLICE:
            self.grams = [_merge(self.grams)]
        for p in parts:
            if p[4]:
                self.words.update(p[6].split())
                self.words[END_WORD] += p[3]
            else:
                self.words.update({w: 0 for w in p[6].split() if w not in self.words})

    def full(self) -> bool:
        return self.bytes >= BLOCK or len(self.words) >= BLOCK_WORDS or len(self.grams[0][0]) >= BLOCK_STRINGS

    def requests(self, number: int, buckets: int) -> pa.RecordBatch:
        keys, counts = _merge(self.grams)
        self.grams = []
        asked = [{"block": number, "bucket": bucket, "g": _pack(keys[at]), "g_n": _pack(counts[at].astype(np.float64))}
                 for bucket, at in _dealt(keys, buckets)]
        asked += [{"block": number, "bucket": bucket, "w": _pack_words(some),
                   "w_n": _pack(np.array([self.words[w] for w in some], np.float64))}
                  for bucket, some in _dealt_words(self.words, buckets)]
        return pa.RecordBatch.from_pylist(asked, _REQUEST_FIELDS)


def _requests(order: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of texts, a compressed row per slice; then per bucket the strings and words the block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block(order)
        for own in _slices(_parts(batches, order), _size):
            block.add(own)
            yield pa.RecordBatch.from_pylist(
                [{"block": number, "texts": zstandard.ZstdCompressor(level=1).compress(pickle.dumps(own))}], _REQUEST_FIELDS
            )
            if block.full():
                yield block.requests(number, buckets)
                number, block = number + 1, _Block(order)
        if block.grams:
            yield block.requests(number, buckets)

    return run


MERGED = "bucket bigint, g binary, g_n binary, w binary, w_n binary"
_MERGED_FIELDS = pa.schema([f for f in _REQUEST_FIELDS if f.name in ("bucket", "g", "g_n", "w", "w_n")])


def _merged(table: pa.Table) -> pa.Table:
    """Sums over the rows of a bucket."""
    rows = table.to_pylist()
    grams = [(_unpack(r["g"], np.int64), _unpack(r["g_n"], np.float64)) for r in rows if r["g"]]
    words: dict[bytes, float] = {}
    for r in rows:
        if r["w"]:
            own = dict(zip(_unpack_words(r["w"]), _unpack(r["w_n"], np.float64).tolist(), strict=True))
            if len(words) < len(own):
                words, own = own, words
            for w, n in own.items():
                words[w] = words.get(w, 0) + n
    out = {"bucket": rows[0]["bucket"]}
    if grams:
        keys, counts = _merge(grams)
        out |= {"g": _pack(keys), "g_n": _pack(counts.astype(np.float64))}
    if words:
        listed = sorted(words)
        out |= {"w": _pack_words(listed), "w_n": _pack(np.array([words[w] for w in listed], np.float64))}
    return pa.Table.from_pylist([out], _MERGED_FIELDS)


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (row for batch in batches for row in batch.to_pylist()):
        keys, counts = _unpack(row["g"], np.int64), _unpack(row["g_n"], np.float64).astype(np.int64)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + 100_000]), pa.array(counts[at:at + 100_000])], names=["g", "n"])


def _word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (row for batch in batches for row in batch.to_pylist()):
        counts = _unpack(row["w_n"], np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], names=["tokens", "kinds"])


def _packed_values(table: pa.Table) -> pa.Table:
    """(bucket, g, v) rows of one bucket, packed."""
    keys, values = table.column("g").to_numpy(), table.column("v").to_numpy()
    order = np.argsort(keys)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()]), "g": pa.array([_pack(keys[order])], pa.binary()),
                     "g_v": pa.array([_pack(values[order])], pa.binary())})


ANSWERS = "to_block bigint, g binary, g_v binary, w binary, w_n binary"
_ANSWER_FIELDS = pa.schema([("to_block", pa.int64()), ("g", pa.binary()), ("g_v", pa.binary()), ("w", pa.binary()), ("w_n", pa.binary())])


def _answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The requests of some blocks to one bucket with their values."""
    values, counts = (np.zeros(0, np.int64), np.zeros(0)), {}
    for r in known.to_pylist():
        if r["g"]:
            values = (_unpack(r["g"], np.int64), _unpack(r["g_v"], np.float64))
        if r["w"]:
            counts = dict(zip(_unpack_words(r["w"]), _unpack(r["w_n"], np.float64).tolist(), strict=True))
    out = []
    for r in asked.to_pylist():
        row = {"to_block": r["block"], "g": r["g"], "w": r["w"]}
        if r["g"]:
            row["g_v"] = _pack(values[1][np.searchsorted(values[0], _unpack(r["g"], np.int64))])
        if r["w"]:
            row["w_n"] = _pack(np.array([counts[w] for w in _unpack_words(r["w"])], np.float64))
        out.append(row)
    return pa.Table.from_pylist(out, _ANSWER_FIELDS)


def _gram_bucket(buckets: int):
    @F.arrow_udf("bigint")
    def bucket(g: pa.Array) -> pa.Array:
        return pa.array(_bucket_of(g.to_numpy(zero_copy_only=False), buckets))

    return bucket


# ---- values of strings --------------------------------------------------------------------------------------


def _context_stats(counts: DataFrame, shorter: DataFrame | None, order: int) -> DataFrame:
    """(c, total, kinds, below): a context's sum, its different symbols, and their sum in the next shorter one."""
    rows = counts.withColumn("c", F.shiftrightunsigned("g", 8))
    if shorter is None:
        rows = rows.withColumn("m", F.lit(0).cast("bigint"))
    else:
        parent = shorter.select(F.col("g").alias("s"), F.col("n").alias("m"))
        rows = rows.join(parent, F.col("g").bitwiseAND(F.lit(_mask(order))) == F.col("s"))
    return rows.groupBy("c").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("m").alias("below"))


def _mask(length: int) -> int:
    return (1 << (8 * length)) - 1


def string_values(grams: DataFrame, order: int) -> DataFrame:
    """(g, v): log10 of the chance of each string's last symbol after the bytes before it.

    `grams` is a written table of all strings wanted, each once, with its training count (0: never seen).
    """
    counts = {order: grams.filter("n > 0").select("g", "n")}
    for j in range(order - 1, -1, -1):
        shorter = counts[j + 1].groupBy(F.col("g").bitwiseAND(F.lit(_mask(j + 1))).alias("g")).agg(F.sum("n").alias("n"))
        counts[j] = materialize(shorter, f"ppm-counts-{j}")
    stats = {
        j: materialize(_context_stats(counts[j], counts.get(j - 1), j), f"ppm-contexts-{j}") for j in range(order + 1)
    }
    top = counts[order].join(stats[order], F.shiftrightunsigned("g", 8) == F.col("c")).select(
        "g", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("v")
    )
    # The others walk down: v so far, and what the longer context rules out (kinds and sum).
    zero = F.lit(0).cast("bigint")
    left = grams.filter("n = 0").select("g", F.lit(0.0).alias("v"), zero.alias("out_kinds"), zero.alias("out_sum"))
    found = [top]
    for j in range(order, -1, -1):
        at = F.col("g").bitwiseAND(F.lit(_mask(j + 1)))
        own = stats[j]
        if j < order:
            own_counts = counts[j].select(F.col("g").alias("s"), "n")
            step = left.join(own_counts, at == F.col("s"), "left").join(
                own, F.shiftrightunsigned(at, 8) == F.col("c"), "left"
            )
        else:
            step = left.join(own, F.shiftrightunsigned(at, 8) == F.col("c"), "left").withColumn("n", F.lit(None).cast("bigint"))
        new = F.col("kinds") - F.col("out_kinds")
        room = F.col("total") - F.col("out_sum") + new
        step = materialize(step.select(
            "g",
            F.when(F.col("n").isNotNull(), F.col("v") + F.log10(F.col("n") / room))
            .when(new > 0, F.col("v") + F.log10(new / room)).otherwise(F.col("v")).alias("v"),
            F.coalesce("kinds", "out_kinds").alias("out_kinds"),
            F.coalesce("below", "out_sum").alias("out_sum"),
            F.col("n").isNotNull().alias("seen"),
        ), f"ppm-walk-{j}")
        found.append(step.filter("seen").select("g", "v"))
        left = step.filter("not seen").drop("seen")
    found.append(left.select("g", (F.col("v") - F.log10(F.lit(ALPHABET) - F.col("out_kinds"))).alias("v")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _places(keys: np.ndarray) -> np.ndarray:
    """A hash table of sorted keys: the place of one key of each slot."""
    bits = min(24, max(10, int(len(keys)).bit_length() + 2))
    table = np.zeros(1 << bits, np.int32)
    table[_slots(keys, bits)] = np.arange(len(keys), dtype=np.int32)
    return table


def _lookup(keys: np.ndarray, codes: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Places of codes in sorted keys that hold them all: a hash table, and a search where two keys share a slot."""
    table = _places(keys) if table is None else table
    at = table[_slots(codes, len(table).bit_length() - 1)]
    wrong = np.flatnonzero(keys[at] != codes)
    at[wrong] = np.searchsorted(keys, codes[wrong])
    return at


_SCORED = pa.schema([
    ("id", pa.int64()), ("mark", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])
SCORED = "id bigint, mark bigint, part int, last boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scorer(order: int, denominator: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    base = math.log10(denominator)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams, logs = [], {}
        for g, g_v, w, w_n in zip(*(answers.column(c) for c in ("g", "g_v", "w", "w_n")), strict=True):
            if g.is_valid:
                grams.append((_unpack(g.as_py(), np.int64), _unpack(g_v.as_py(), np.float64)))
            if w.is_valid:
                different, at = np.unique(_unpack(w_n.as_py(), np.float64), return_inverse=True)
                values = [math.log10(c + 1) for c in different.tolist()]
                logs.update(zip(_unpack_words(w.as_py()), map(values.__getitem__, at.tolist()), strict=True))
        keys = np.concatenate([k for k, _ in grams])
        values = np.concatenate([v for _, v in grams])
        grams.clear()
        at = np.argsort(keys)
        keys, values = keys[at], values[at]
        table = _places(keys)
        out = []
        for data in texts.column("texts"):
            own = pickle.loads(zstandard.ZstdDecompressor().decompress(data.as_py()))  # noqa: S301  own bytes
            codes, lengths = symbols([(p[5], p[6], p[3]) for p in own], order)
            # Every part has a symbol: the end, or the bytes before a cut.
            scores = np.add.reduceat(values[_lookup(keys, codes, table)], np.cumsum(lengths) - lengths)
            known, bases, counts = [], [], []
            for p in own:
                chances = list(map(logs.__getitem__, p[6].split()))
                if p[3]:
                    chances.append(logs[END_WORD])
                counts.append(len(chances))
                known.append(len(chances) - chances.count(0.0))  # log10(0 + 1): not known
                bases.append(math.fsum(chances) - base * len(chances))
            columns = [*([p[i] for p in own] for i in range(4)), counts, known, bases, scores]
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, train: Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier, n_tokens, n_known, train_tokens, base_score, score (log10 of chances)."""
    if not 0 <= order <= 6:
        raise ValueError("orders 0 to 6 fit the packed strings")
    small_batches(docs.sparkSession)
    content = whole(text_col)
    size = docs.agg(F.sum(F.octet_length(content).cast("bigint"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    asked = materialize(
        docs.select(
            F.col(id_col).cast("bigint").alias("id"), F.xxhash64(content).alias("mark"), train.alias("train"),
            content.alias("content"),
        ).mapInArrow(_requests(order, buckets), REQUESTS),
        "ppm-requests",
    )
    texts = asked.filter(F.col("texts").isNotNull()).select("block", "texts")
    requests = asked.filter(F.col("bucket").isNotNull()).drop("texts")
    # Some dozens of blocks meet in a task; how many such groups there are follows from the number of blocks.
    groups = max(1, -(-requests.select("block").distinct().count() // FAN_IN))
    grouped = requests.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
    sums = grouped.groupBy("bucket", "part").applyInArrow(_merged, MERGED).groupBy("bucket").applyInArrow(_merged, MERGED)
    model = materialize(sums, "ppm-model")
    tokens, kinds = model.filter(F.col("w").isNotNull()).mapInArrow(_word_sums, "tokens bigint, kinds bigint").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))
    ).first()
    grams = materialize(model.filter(F.col("g").isNotNull()).mapInArrow(_string_rows, "g bigint, n bigint"), "ppm-strings")
    values = string_values(grams, order).withColumn("bucket", _gram_bucket(buckets)("g")).groupBy("bucket").applyInArrow(
        _packed_values, "bucket bigint, g binary, g_v binary"
    )
    none = F.lit(None).cast("binary")
    known = values.select("bucket", "g", "g_v", none.alias("w"), none.alias("w_n")).unionByName(
        model.filter(F.col("w").isNotNull()).select("bucket", none.alias("g"), none.alias("g_v"), "w", "w_n")
    ).select(F.col("bucket").alias("of"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("for_part"),
             "g", "g_v", "w", "w_n")
    answers = grouped.groupBy("bucket", "part").cogroup(known.groupBy("of", "for_part")).applyInArrow(_answered, ANSWERS)
    scored = materialize(
        texts.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(
            _scorer(order, tokens + kinds + 1), SCORED
        ),
        "ppm-scored",
    )
    totals = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    plain = scored.filter("last and part = 0").drop("mark", "part", "last")
    # Parts of long texts: copies of a row have equal parts, so each part counts once and the row comes back as often.
    once = scored.filter("not last or part > 0").groupBy("id", "mark", "part").agg(
        F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    long = once.groupBy("id", "mark").agg(F.max("copies").alias("copies"), *totals).select(
        "id", "n_tokens", "n_known", "base_score", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).drop("copy")
    return plain.unionByName(long).select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )


# ---- adaptive -----------------------------------------------------------------------------------------------


class Trie:
    """Counts of symbols by context, up to `order` bytes."""

    def __init__(self, order: int):
        self.order = order
        self.followers: dict[bytes, dict[int, int]] = {}

    def log_chance(self, context: bytes, symbol: int) -> float:
        """log10 of the chance of a symbol after a context of at least `order` bytes."""
        ruled_out: set[int] = set()
        out = 0.0
        for j in range(self.order, -1, -1):
            seen = self.followers.get(context[len(context) - j:], {})
            left = {s: n for s, n in seen.items() if s not in ruled_out}
            room = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / room)
            if left:
                out += math.log10(len(left) / room)
            ruled_out |= left.keys()
        return out - math.log10(ALPHABET - len(ruled_out))

    def learn(self, context: bytes, symbol: int) -> None:
        for j in range(self.order + 1):
            seen = self.followers.setdefault(context[len(context) - j:], {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def read(self, text: str, learn: bool) -> float:
        """log10 of the chance of a whole text and its end; the trie learns along the way if asked to."""
        data = bytes([END]) * self.order + text.encode().lower() + bytes([END])
        out = 0.0
        for at in range(self.order, len(data)):
            context = data[at - self.order:at]
            out += self.log_chance(context, data[at])
            if learn:
                self.learn(context, data[at])
        return out


def adaptive(docs: DataFrame, order: int = 3, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns and the log10 chance of each text under a trie that learns from that text alone."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array([Trie(order).read(t, True) for t in text.to_pylist()], pa.float64())

    return docs.withColumn(out, scored(whole(text_col)))
