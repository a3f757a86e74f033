"""Public tokenizers in tasks: one object per worker, whole words remembered.

A byte-level vocabulary without normaliser splits a text at every space that stands between two characters
which are not white space, so such texts are the sum of their space-separated words.  The worker keeps the ids
of words it has met; texts where a word begins or ends in white space, or holds a special token, go to the
library as a whole.  Where the same vocabulary also lies there as ranks, and is found equal entry by entry, new
words are encoded from the ranks, which gives the same ids sooner.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from array import array

#: Words kept by a worker; beyond it the memory is emptied and filled anew, which changes no result.
MEMO_WORDS = 400_000


class _Words(dict):
    """Ids of a word as little-endian 32-bit numbers; None if the word can't stand alone."""

    def __init__(self, encode, lead: str, special: list[str]):
        super().__init__()
        self.encode, self.lead, self.special = encode, lead, special

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= MEMO_WORDS:
            self.clear()
        if not word or word[0].isspace() or word[-1].isspace() or any(s in word for s in self.special):
            ids = None
        else:
            ids = array("I", self.encode(self.lead + word)).tobytes()
        self[word] = ids
        return ids


def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def _shown_bytes() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _twin(path: str, tool) -> object | None:
    """The same vocabulary as ranks, if it lies there and every entry and merge agrees."""
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    encoding, ranks = _ranked(ranks_path)
    special = {t.content for t in tool.get_added_tokens_decoder().values()}
    shown = _shown_bytes()
    vocabulary = {w: i for w, i in tool.get_vocab().items() if w not in special}
    if {bytes(shown[c] for c in w): i for w, i in vocabulary.items()} != ranks:
        return None
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    ids = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    return encoding if ids == sorted(ids) else None


class Tokenizer:
    """Ids of whole texts as the library of the file gives them; no begin, end or added special tokens."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".json"):
            import tokenizers

            tool = tokenizers.Tokenizer.from_file(path)
            tool.no_truncation()
            tool.no_padding()
            self._encode = lambda text: tool.encode(text, add_special_tokens=False).ids
            splits = tool.normalizer is None and type(tool.pre_tokenizer).__name__ == "ByteLevel"
            splits = splits and not tool.pre_tokenizer.add_prefix_space and tool.post_processor is None
            special = [t.content for t in tool.get_added_tokens_decoder().values()]
            twin = _twin(path, tool) if splits else None
            of_word = twin.encode_ordinary if twin else self._encode
        elif path.endswith(".tiktoken"):
            tool, _ = _ranked(path)
            self._encode, splits = tool.encode_ordinary, False
        else:
            import sentencepiece

            tool = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode, splits = (lambda text: tool.encode(text, num_threads=1)), False
        self._first = _Words(of_word, "", special) if splits else None
        self._later = _Words(of_word, " ", special) if splits else None

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self._later is not None and text:
            first, *rest = text.split(" ")
            found = [self._first[first], *map(self._later.__getitem__, rest)]
            if None not in found:
                return b"".join(found)
        return array("I", self._encode(text)).tobytes()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import importlib.metadata as installed

    library = {"json": "tokenizers", "tiktoken": "tiktoken"}.get(path.rpartition(".")[2], "sentencepiece")
    digest = hashlib.sha256(f"{library} {installed.version(library)} ".encode())
    with open(path, "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()
