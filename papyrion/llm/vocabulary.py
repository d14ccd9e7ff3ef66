"""Token ids of whole texts, with a bounded cache of words.

A text is cut only where the tokenizer itself always starts a new word, so encoding the
pieces one by one gives the ids of the whole text.  Pieces that were met before come from the
cache; new ones go to the tokenizers library in batches.  The cache keeps two generations of
at most ``limit`` pieces each and never holds pieces over 64 characters, so its memory is
bounded whatever the texts are.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: A space before a visible character always starts a new word in byte-level BPE.
CUT = re.compile(r"(?= \S)")
#: A space that may belong to a run of white space.
ODD = re.compile(r" (?=\s|\Z)")
LONGEST = 64
#: Pieces in a generation of a worker's cache, unless an operator is told otherwise.
CACHE = 500_000


class Cache(dict):
    """piece -> value; a missing piece is looked up in the older generation, then made."""

    def __init__(self, make: Callable, limit: int = 500_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= LONGEST:
            self.put(piece, value)
        return value

    def put(self, piece, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoded(tokenizer: Tokenizer, pieces: list[str], step: int = 4096) -> Iterator[list[int]]:
    """The ids of each piece; the library's results, far larger than the ids, are held for a few pieces at a time."""
    for at in range(0, len(pieces), step):
        for found in tokenizer.encode_batch_fast(pieces[at : at + step], add_special_tokens=False):
            yield found.ids


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def packed(ids: Iterable[int], kind: str) -> bytes:
    return np.array(ids, kind).tobytes()


def spaced_pieces(text: str) -> tuple[str, list[str]]:
    """(first, rest): the text is first followed by a space and a piece for each of rest.

    Only for texts in which each space stands before a visible character.
    """
    first, *rest = text.split(" ")
    return first, rest


# The normaliser and the cut of words that ``WordEncoder`` relies on.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Small Latin-1 letters, which folding leaves as they are, and ASCII marks after them, which are a piece of their own.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space (``word_bpe_49k``): words apart by ASCII white space.

    The file must fold case and cut words as that one does; any other raises an error.
    """

    def __init__(self, path: str, limit: int = 500_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] != FOLDING or spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [WORD_CUT, BYTES]} or spec["post_processor"] is not None:
            raise ValueError("only a tokenizer that folds case and drops white space is supported")
        self.tokenizer = load(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4"
        #: How the byte-level vocabulary writes bytes that aren't ASCII letters.
        self.shown = {byte: letter for letter, byte in byte_letters().items()}
        self.cache = Cache(self._one, limit)

    def pack(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little":  # far quicker than numpy for a few ids
            return array("H" if self.kind == "<u2" else "I", ids).tobytes()
        return packed(ids, self.kind)

    def _one(self, word: bytes) -> bytes:
        """The packed ids of a word; letters go to the library's merges directly, which takes it less than half the time."""
        if found := PLAIN.fullmatch(word):
            letters, marks = found.groups()
            if marks:
                return self.cache[letters] + self.cache[marks]
            shown = word.decode() if word.isascii() else word.decode("latin-1").translate(self.shown)
            return self.pack([token.id for token in self.tokenizer.model.tokenize(shown)])
        return self.pack(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        cut = [self.folded(t).encode("utf-8", "replace").split() for t in texts]
        old, get = self.cache.old, self.cache.get
        codes = [list(map(get, words)) for words in cut]
        gaps = [(k, i) for k, known in enumerate(codes) if None in known for i, code in enumerate(known) if code is None]
        new = [w for w in {cut[k][i] for k, i in gaps} if w not in old and len(w) <= LONGEST and not PLAIN.fullmatch(w)]
        fresh = {w: self.pack(ids) for w, ids in zip(new, encoded(self.tokenizer, [w.decode("utf-8", "replace") for w in new]), strict=True)}
        for k, i in gaps:
            word = cut[k][i]
            codes[k][i] = fresh[word] if word in fresh else self.cache[word]
        for word, code in fresh.items():
            self.cache.put(word, code)
        return list(map(b"".join, codes))

    def folded(self, text: str) -> str:
        """The text in lower case, as the tokenizer folds case itself, so that fewer words differ.

        Two letters whose folding depends on more than themselves are left to the tokenizer,
        and so are texts with one of its special tokens.
        """
        return text.lower() if "\u03a3" not in text and "\u0130" not in text and "<|" not in text else text


class TokenCounter:
    """Number of ids of whole texts under a byte-level BPE tokenizer that starts words at spaces."""

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab(True)
        #: Whether each token begins with a space, which the vocabulary writes as this letter.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.inner = Cache(lambda piece: self._count(" " + piece), limit)
        self.other = Cache(self._count, min(limit, 10_000))

    def _count(self, piece: str) -> int:
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _counts(self, pieces: list[str], step: int = 4096) -> Iterator[int]:
        """The number of ids of a space and each piece.

        Pieces are encoded as one text, which takes the library half the time, and cut at the tokens
        that begin with a space.  Added tokens may cut a text elsewhere, so with one all go apart.
        """
        for at in range(0, len(pieces), step):
            text = " " + " ".join(pieces[at : at + step])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(pieces[at : at + step]) and not any(a in text for a in self.added):
                yield from np.diff(begins, append=len(ids)).tolist()
            else:
                yield from (self._count(" " + piece) for piece in pieces[at : at + step])

    def count(self, texts: list[str]) -> list[int]:
        split = [None if ODD.search(t) else spaced_pieces(t) for t in texts]
        cache, old = self.inner, self.inner.old
        new = [p for p in set().union(*(s[1] for s in split if s)) if p not in cache and p not in old and len(p) <= LONGEST]
        for piece, n in zip(new, self._counts(new), strict=True):
            cache.put(piece, n)
        out = []
        for text, parts in zip(texts, split, strict=True):
            if parts:
                out.append(self.other[parts[0]] + sum(map(cache.__getitem__, parts[1])))
            else:
                out.append(sum(map(self.other.__getitem__, CUT.split(text))))
        return out


_KEPT: dict[tuple, object] = {}


def kept(make: Callable, path: str, limit: int):
    """This process's encoder of a file: a Python worker keeps it, and its cache of ``limit`` pieces, from task to task.

    Only the last one is kept, so stages that share a worker don't add up their caches.
    """
    if (make, path, limit) not in _KEPT:
        forget()
        _KEPT[make, path, limit] = make(path, limit)
    return _KEPT[make, path, limit]


def forget() -> None:
    """Free the kept encoder, and give unused memory back to the system, before work that needs it."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # an encoder's cache refers back to it
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pieces of a cache otherwise
    if trim:
        trim(0)


def word_encoder(path: str) -> WordEncoder:
    return kept(WordEncoder, path, CACHE)


def token_counter(path: str, limit: int) -> TokenCounter:
    return kept(TokenCounter, path, limit)


def small_groups(texts: Iterable[str | None], most: int = 1 << 20):
    """The texts (null as empty) in lists of about ``most`` characters at most, longer texts alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
