"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton accepts exactly the correct token sequences. It starts as one state with an arc for every byte, and
each merge ``u v`` adds one gadget in order of rank: the state that ``u`` leads to is copied without its ``v`` arc,
all ``u`` arcs are turned to the copy, and every state with a ``u`` arc gets an arc labelled ``uv`` to where ``v`` led. All
arcs of a label keep one common end, so the automaton stays deterministic and grows by a state per merge.

A word's encoding is its only path: walking the positions from left to right, each position is reached by one arc
that the table of transitions allows. Words repeat, so a worker keeps the paths of those it has seen. Decoding
emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from fluxlake.llm.common import documents, give_back, small_batches

# The byte-level alphabet's printable ranges and the pattern that splits text before the merges.
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Unicode white space. No piece goes on from other characters into it, so a text may be cut before each run of it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
# Neighbouring white space, or white space other than space and line end.
ODD_SPACE = re.compile("[ \n][ \n]|[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Marks that are neither letters, digits nor white space.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Chunks and words that each generation of a worker's memory holds.
CHUNKS_KEPT = 1 << 16
WORDS_KEPT = 1 << 17


def byte_of() -> dict[str, int]:
    """The byte behind every character of byte-level token strings: itself if printable, else 256, 257, ... in order."""
    plain = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges: states, transitions and arc labels of one vocabulary file."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        to_byte = byte_of()
        size = max([*vocab.values(), *added.values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        for token, number in vocab.items():
            self.labels[number] = bytes(to_byte[c] for c in token)
        for token, number in added.items():
            self.labels[number] = token.encode()
        self.added = added
        # State 0 is the start. Behind the arcs of a token stands a line of states, one per gadget on that token;
        # a state is a token's line up to a rank, on top of the state that the token's right part had at its birth.
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.cuts: list[dict[int, int]] = [{} for _ in range(size)]
        # Labels as a tree: a node's children by byte, and under -1 the token that ends there.
        self.tree: dict = {}
        live = [number for token, number in vocab.items() if len(token) == 1]
        self.reached = [False] * size
        for number in live:
            self.reached[number] = True
        for rank, (u, v) in enumerate(merges):
            merged = self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
            if merged is not None:
                live.append(merged)
        for number in live:
            node = self.tree
            for byte in self.labels[number]:
                node = node.setdefault(byte, {})
            node[-1] = number
        self.sizes = [len(label) for label in self.labels]
        self.most = max((self.sizes[number] for number in live), default=0)
        self.shorter = [-1] * size
        for number in live:
            self.shorter[number] = self._longest(self.labels[number][:-1])
        self.table: dict[int, bool] = {}

    def _gadget(self, rank: int, u: int, v: int, merged: int) -> int | None:
        # A part that no path has (its own merge never fires) makes this one idle too.
        if not (self.reached[u] and self.reached[v] and self._allowed(u, v)):
            return None
        self.cuts[u][v] = rank
        if self.born[merged] < 0 and merged not in (u, v):
            self.left[merged], self.right[merged], self.born[merged] = u, v, rank
            self.reached[merged] = True
            return merged
        return None

    def _allowed(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has an arc for ``token``.

        An arc for ``token`` came with its left part's arc, so it is missing if a part on its left edge was cut from the
        state, or from one that the state was copied from, before the next longer part was born. (Equal ranks are a merge of
        a token with itself: the copy then has no arc for the merged token, as its left part is what was cut.)
        """
        born, left, until = self.born, self.left, 1 << 60
        while last >= 0:
            cuts = self.cuts[last]
            if cuts:
                part, before = token, 1 << 60
                while part >= 0:
                    rank = cuts.get(part)
                    if rank is not None and rank < until and rank <= before:
                        return False
                    before, part = born[part], left[part]
            until, last = born[last], self.right[last]
        return True

    def _longest(self, word: bytes) -> int:
        node, found = self.tree, -1
        for byte in word:
            node = node.get(byte)
            if node is None:
                break
            if -1 in node:
                found = node[-1]
        return found

    def path(self, word: bytes) -> list[int]:
        """The tokens of a pre-split word: the labels of its only path.

        A position is only ever reached by the correct encoding of what lies before it. So the walk takes the longest arc
        that the table allows, goes back where none is left, and never enters a position twice.
        """
        size, sizes, shorter, table = len(word), self.sizes, self.shorter, self.table
        out: list[int] = []
        at, last, token = 0, -1, self._longest(word[:self.most])
        closed = bytearray(size + 1)
        while at < size:
            while token >= 0:
                stop = at + sizes[token]
                if not closed[stop]:
                    key = last << 20 | token
                    step = table.get(key)
                    if step is None:
                        if len(table) >= 1 << 20:
                            table.clear()
                        step = table[key] = self._allowed(last, token)
                    if step:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = stop, token
                token = self._longest(word[at:at + self.most])
            else:
                closed[at] = 1
                token = out.pop()
                at -= sizes[token]
                last, token = out[-1] if out else -1, shorter[token]
        return out


def load(path: str) -> Automaton:
    """Compile the byte-level BPE of a tokenizer file (JSON)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


class _Kept(dict):
    """A bounded memory of what ``make`` gives: a young generation, and an old one from which what is used comes back."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def forget(self) -> None:
        """Give the memory back, for whatever the worker does next."""
        self.clear()
        self.old = {}


class ChunkEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers, by the encodings of their chunks.

    ``encode_piece`` encodes a piece of the split pattern; ``added`` are token strings that are cut out of a text first.
    """

    def __init__(self, encode_piece, added: dict[str, int], words_kept: int = WORDS_KEPT):
        self.encode_piece = encode_piece
        self.split = regex.compile(PATTERN).findall
        # By chunk; and in texts of plain words, by word, which stands for the word with a space in front.
        self.chunks = _Kept(self._chunk, CHUNKS_KEPT)
        self.words = _Kept(self._word, words_kept)
        self.added = {text: self._bytes([number]) for text, number in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def forget(self) -> None:
        """Give the memory back, for whatever the worker does next."""
        for kept in (self.chunks, self.words):
            kept.forget()

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        return self._chunk(word if word[0] == "\n" else " " + word)

    def _chunk(self, chunk: str) -> bytes:
        # Letters, with a space in front or not, are one piece, and so are marks behind them.
        core = chunk.rstrip(MARKS)
        if (core[1:] if core[:1] == " " else core).isalpha():
            if len(core) == len(chunk):
                return self._bytes(self.encode_piece(chunk))
            known = self.words[core[1:]] if core[0] == " " else self.chunks[core]
            return known + self.chunks[chunk[len(core):]]
        pieces = self.split(chunk)
        if len(pieces) == 1:
            return self._bytes(self.encode_piece(chunk))
        return b"".join(map(self.chunks.__getitem__, pieces))

    def plain(self, text: str) -> bytes:
        # Words parted by single spaces and line ends only, which nearly all texts are: splitting is then enough.
        if not ODD_SPACE.search(text) and text[:1] not in " \n" and text[-1:] not in " \n":
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.chunks[first] + b"".join(map(self.words.__getitem__, rest))
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and any(token in text for token in self.added):
            return b"".join(self.added[part] if part in self.added else self.plain(part) for part in self.cut.split(text))
        return self.plain(text)


class Codec:
    """Encoder and decoder of one automaton, with the memory of a worker."""

    def __init__(self, automaton: Automaton):
        self.labels = automaton.labels
        self.automaton = automaton
        self.encode = ChunkEncoder(lambda piece: automaton.path(piece.encode()), automaton.added)

    def forget(self) -> None:
        """Give back the words and the steps of the automaton that were remembered."""
        self.encode.forget()
        self.automaton.table.clear()

    def decode(self, ids: bytes) -> str:
        """The text whose bytes the ids' labels spell."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_WORKER: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a tokenizer file, compiled once in each worker."""
    if path not in _WORKER:
        _WORKER[path] = Codec(load(path))
    return _WORKER[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on demand, ``ids`` and ``decoded``.

    The whole text is encoded and the ids are decoded again. NULL and empty texts have no tokens. NULL ids and
    repeated rows come out as they came in; an empty table gives an empty result; other columns are not read.
    ``tokenizer`` is the path of the vocabulary file, which every executor must have.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(tokenizer)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                ids = coder.encode(text)
                decoded = coder.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").astype("int64"), decoded) if with_ids else row)
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", frame["doc_id"].values)
            yield out
        coder.forget()
        give_back()

    small_batches(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if with_ids else "")
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_encode(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them; see ``encode_documents``."""
    return encode_documents(documents(spark, sf_dir), default_tokenizer())
