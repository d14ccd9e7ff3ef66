"""Byte-level BPE as a streaming transducer, and its inverse.

Words are cut as the byte-level pattern cuts them, and every word, long or short, runs through
the transducer as a stream of parts.  For each prefix the transducer finds the one token that
ends the prefix's encoding: the only vocabulary entry that may follow the last token of the
shorter prefix.  Two tokens may stand side by side if no merge of the list would have crossed
their border while they were built, which their derivations decide.  So a prefix's encoding is
a path of back links.

The sufficient lookahead of a merge list is its longest token: any encoding of a continuation
passes through a prefix end within the last ``lookahead`` bytes, so what the paths from all
those ends share is stable, is emitted and forgotten.  Memory stays constant for a given merge
list however long a word is.  Short pieces are kept in a bounded cache of the transducer's output.

Decoding feeds the tokens' bytes to an incremental UTF-8 machine that keeps at most three
bytes between steps and replaces malformed sequences by U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.vocabulary import CUT, LONGEST, ODD, Cache, byte_letters, kept

# How byte-level BPE cuts words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


SHORT = (1, 2)
#: The transducer's states are remembered for so many bytes at the start of words.
PREFIX = 16
#: Pieces in a generation of a worker's cache, and states of words' beginnings, unless an operator is told otherwise.
CACHE = 300_000


class Transducer:
    """Encoder and decoder for the byte-level BPE of a tokenizers file."""

    def __init__(self, path: str, limit: int = CACHE, step: int = 512):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE is supported")

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.bytes_of = {i: raw(t) for t, i in model["vocab"].items()}
        self.ids = {t: i for i, t in self.bytes_of.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (merge.split(" ") if isinstance(merge, str) else merge)
            a, b = raw(a), raw(b)
            self.pairs[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        del spec, model
        self._derive()
        self.kind = "<u4"
        #: Bytes of the longest token: a continuation can move no boundary without passing one of the last so many prefix ends.
        self.lookahead = max(map(len, self.ids))
        self.step, self.limit = step, limit
        sizes: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                sizes.setdefault(t[-3:], {1, 2}).add(len(t))
        #: Sizes of the tokens that end in three given bytes, ascending; other ends have tokens of one or two bytes only.
        self.sizes = {t: tuple(sorted(n)) for t, n in sizes.items()}
        self.words = regex.compile(WORDS)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.compatible: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.tokens = [-1]
        self.inner = Cache(lambda piece: self._packed(" " + piece), limit)
        self.other = Cache(self._packed, max(1, limit // 10))

    def _derive(self) -> None:
        """The merge that makes each token, and which tokens are the encoding of their own bytes."""
        self.made = {token: (a, b, rank) for (a, b), (rank, token) in reversed(self.pairs.items())}
        if any(self.made[part][2] >= rank for (a, b), (rank, _) in self.pairs.items() for part in (a, b) if part in self.made):
            raise ValueError("a merge comes before its parts")
        self.alone = set(self.single)
        for (a, b), (rank, token) in self.pairs.items():  # in order of rank
            if self.made[token][2] == rank and a in self.alone and b in self.alone and self._apart(a, b, rank):
                self.alone.add(token)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at the left (0) or right (1) edge of a token, from its byte on, with the rank at which each is merged away."""
        out = [(token, math.inf)]
        while token in self.made:
            ends, token = self.made[token][2], self.made[token][side]
            out.append((token, ends))
        return out[::-1]

    def _apart(self, before: int, token: int, until: float = math.inf) -> bool:
        """Whether no merge of a rank below ``until`` crosses the border of two tokens.

        Both are built in order of rank, leftmost first on a tie; the pieces at the border are
        compared while they last.
        """
        x, y = self._edge(before, 1), self._edge(token, 0)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = x[i], y[j]
            met = self.pairs.get((a, b))
            if met is not None and met[0] < a_ends and met[0] <= b_ends and met[0] < until:
                return False
            if a_ends <= b_ends:
                if a_ends == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _fits(self, before: int, token: int) -> bool:
        """Whether two tokens may be neighbours in an encoding."""
        return before in self.alone and token in self.alone and self._apart(before, token)

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word that comes in parts, emitted once stable."""
        held = b""  # bytes since the last stable end
        last: list[int | None] = [None]  # token that ends the encoding of each prefix of held
        state = 0  # of the word's beginning, as far as states are remembered; then -1
        ids, sizes, fits, steps, tokens = self.ids, self.sizes, self.compatible, self.steps, self.tokens
        for part in parts:
            for at in range(0, len(part), self.step):
                chunk = part[at : at + self.step]
                begin = len(held) + 1
                held += chunk
                for end, byte in enumerate(chunk, begin):
                    if state >= 0:
                        key = state << 8 | byte
                        next_state = steps.get(key)
                        if next_state is not None:
                            state = next_state
                            last.append(tokens[state])
                            continue
                    for size in sizes.get(held[end - 3 : end], SHORT) if end > 2 else SHORT:
                        start = end - size
                        if start < 0:
                            break
                        token = ids.get(held[start:end])
                        if token is not None:
                            before = last[start]
                            pair = -1 - token if before is None else before << 32 | token
                            good = fits.get(pair)
                            if good is None:
                                if len(fits) >= self.limit:
                                    fits.clear()
                                good = fits[pair] = token in self.alone if before is None else self._fits(before, token)
                            if good:
                                last.append(token)
                                break
                    if state >= 0:
                        state = self._remember(key, last[end]) if end <= PREFIX else -1
                if len(held) >= 2 * self.lookahead:
                    ends = set(range(len(held) - self.lookahead + 1, len(held) + 1))
                    while len(ends) > 1:
                        end = max(ends)
                        ends.remove(end)
                        ends.add(end - len(self.bytes_of[last[end]]))
                    cut = ends.pop()
                    yield from self._path(last, cut)
                    held, last = held[cut:], last[cut:]  # the token before still decides what may follow
        yield from self._path(last, len(held))

    def _remember(self, key: int, token: int) -> int:
        """A new state, reached by ``key`` (state, byte) and with ``token`` as the last one; all are forgotten when there are too many."""
        if len(self.tokens) >= self.limit:
            self.steps.clear()
            del self.tokens[1:]
            return -1
        self.steps[key] = len(self.tokens)
        self.tokens.append(token)
        return len(self.tokens) - 1

    def _path(self, last: list, end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def word(self, word: str, size: int = 4096) -> Iterator[int]:
        return self.stream(word[at : at + size].encode("utf-8", "replace") for at in range(0, len(word), size))

    def pieces(self, text: str) -> Iterator[int]:
        """Ids of a text, token by token."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            for word in self.words.finditer(text, at, found.start()) if found.start() > at else ():
                yield from self.word(word.group())
            yield self.added[found.group()]
            at = found.end()
        for word in self.words.finditer(text[at:]):
            yield from self.word(word.group())

    def _packed(self, piece: str) -> bytes:
        words = self.words.findall(piece) if not self.special or self.special.search(piece) is None else ()
        if len(words) > 1:  # words that begin with a space share the cache of the pieces
            return b"".join([self.inner[w[1:]] if w[0] == " " and len(w) > 1 else self.other[w] for w in words])
        ids = array("I", self.stream((piece.encode("utf-8", "replace"),)) if words else self.pieces(piece))  # quicker than numpy for a few ids
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()

    def _blocks(self, piece: str, size: int = 1 << 14) -> Iterator[bytes]:
        """Packed ids of a long piece, in blocks."""
        ids = self.pieces(piece)
        while len(block := np.fromiter(islice(ids, size), self.kind)):
            yield block.tobytes()

    def encode(self, text: str, step: int = 1 << 16) -> Iterator[bytes]:
        """Packed ids of a whole text, in blocks of about ``step`` words; long pieces pass as streams."""
        if ODD.search(text) is None:
            first, *rest = text.split(" ")
            cut = [([first], "", self.other)] + [(rest[at : at + step], " ", self.inner) for at in range(0, len(rest), step)]
        else:
            rest = CUT.split(text)
            cut = [(rest[at : at + step], "", self.other) for at in range(0, len(rest), step)]
        for group, space, cache in cut:
            if max(map(len, group)) <= LONGEST:
                yield b"".join(map(cache.__getitem__, group))
            else:
                for piece in group:
                    yield from self._blocks(space + piece) if len(piece) > LONGEST else (cache[piece],)

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """The text of packed ids that come in blocks."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.bytes_of
        for block in blocks:
            yield machine.decode(b"".join(map(table.__getitem__, np.frombuffer(block, self.kind).tolist())))
        yield machine.decode(b"", True)


def transducer(path: str, limit: int) -> Transducer:
    """This process's transducer, kept from task to task."""
    return kept(Transducer, path, limit)


def digest(transducer: Transducer, text: str) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
    ids, back = hashlib.sha256(), hashlib.sha256()
    n = 0

    def watched() -> Iterator[bytes]:
        nonlocal n
        for block in transducer.encode(text):
            ids.update(block)
            n += len(block) // 4
            yield block

    for part in transducer.decode(watched()):
        back.update(part.encode("utf-8"))
    return n, ids.hexdigest(), back.hexdigest()


def _round_trip(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path, limit)
        before, result = None, None
        for batch in batches:
            found = []
            for x in batch.column(1):
                text = x.as_py() or ""
                if text != before:  # a mixed corpus has the uses of a document next to each other
                    before, result = text, digest(own, text)
                found.append(result)
            columns = list(zip(*found, strict=True)) or [[], [], []]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), one row per document.

    Null texts count as empty and have no ids.  Repeated rows and null ids keep their rows; an
    empty table gives an empty result; other columns are ignored.  ``cache`` bounds the pieces
    that a worker remembers; it changes no result.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    out = named.mapInArrow(_round_trip(path, cache), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path, CACHE)
        for batch in batches:
            ids = [np.frombuffer(b"".join(own.encode(x.as_py() or "")), "<u4").astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; null counts as empty."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return named.mapInArrow(_ids(path), "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path, CACHE)
        for batch in batches:
            texts = [None if x is None else "".join(own.decode([np.array(x, "<u4").tobytes()])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of arrays of ids; a null array gives a null text."""
    named = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return named.mapInArrow(_texts(path), "doc_id long, text string").withColumnRenamed("doc_id", id_col)
