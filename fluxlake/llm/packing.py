"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

A task takes its documents in groups of about ``GROUP_WINDOWS`` sequences. Documents of a whole sequence or more have to be
cut anyway and are fluid; the others are packed whole. Each starts as a partial partition of its own: one window with the
document, the others empty. The two partial partitions with the greatest imbalance are merged, the fullest windows of one with the
emptiest of the other, until one is left, whose windows are nearly equal. If its fullest one is over the capacity, the window
count rises by one and the group is packed again. What then is missing in a window is filled from the fluid documents; if they
don't suffice, windows are taken apart, whose documents then are fluid. Fluid text beyond that makes full sequences, and what is
left of it goes on to the task's next group; at the end of the task it is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluxlake.llm.bpe import MARKS, _Kept, byte_of
from fluxlake.llm.common import documents, small_batches

CAPACITY = 4096
END_ID = 2
# Sequences of a group: a merge of two partial partitions costs as much. Gaps up to so many tokens are padded: a piece that short
# is of no use. Chunks that each generation of a worker's memory holds.
GROUP_WINDOWS = 64
LEAST_PIECE = 8
CHUNKS_KEPT = 1 << 19
MARKS_KEPT = 1 << 14
# What is left of a text's UTF-8 without ASCII and the letters from À to ÿ, and the two signs among those letters.
PLAIN_BYTES = bytes(range(0x80)) + b"\xc3" + bytes(range(0x80, 0xC0))
SIGNS = (b"\xc3\x97", b"\xc3\xb7")
LATIN = re.compile("[a-zà-öø-ÿ]+")
# Every mark as a full stop: a comma or full stop after another mark belongs to it.
MARK_BYTES = MARKS.encode()
LETTER_BYTES = bytes(range(0x61, 0x7B)) + b"\xc3" + bytes(range(0x80, 0xC0))
AS_STOP = bytes.maketrans(MARKS.encode() + b"'", b"." * len(MARKS) + b".")
# Separators that Python takes for white space and the tokenizers' patterns don't.
ODD_SEPARATORS = re.compile("[\x1c-\x1f]")


class WordEncoder:
    """Whole texts to ids by a tokenizer that lowers letters and drops white space: the ids of its chunks, which repeat, one by one.

    Texts of ASCII and Latin letters are lowered first, and commas and full stops are parted from the word before them. Chunks of
    letters then go to the library's model; all others to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spell = {byte: char for char, byte in byte_of().items()}
        self.model = self.tokenizer.model
        self.chunks, self.marks = _Kept(self._chunk, CHUNKS_KEPT), _Kept(self._library, MARKS_KEPT)

    def _chunk(self, chunk: bytes | str) -> bytes:
        if isinstance(chunk, bytes):
            if chunk.isalpha():
                return array("I", [token.id for token in self.model.tokenize(chunk.decode())]).tobytes()
            core = chunk.rstrip(MARK_BYTES)
            if core != chunk and core.translate(None, LETTER_BYTES) == b"":
                return (self.chunks[core] if core else b"") + self.marks[chunk[len(core):]]
            chunk = chunk.decode("utf-8", "surrogatepass")
            if LATIN.fullmatch(chunk):
                spelled = chunk.encode().decode("latin-1").translate(self.spell)
                return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()
        return self._library(chunk)

    def _library(self, text: bytes | str) -> bytes:
        text = text.decode() if isinstance(text, bytes) else text
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit integers."""
        if not text:
            return b""
        if ODD_SEPARATORS.search(text):
            return self._library(text)
        # Lowering must not make a token's name of a text.
        raw = text.lower().encode("utf-8", "surrogatepass")
        if b"<|" in raw or raw.translate(None, PLAIN_BYTES) or any(sign in raw for sign in SIGNS):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        stops = raw.translate(AS_STOP)
        if b".. " not in stops and b"..\n" not in stops:
            raw = raw.replace(b", ", b" , ").replace(b". ", b" . ").replace(b",\n", b" ,\n").replace(b".\n", b" .\n")
        return b"".join(map(self.chunks.__getitem__, raw.split()))


def differencing(sizes: list[int], windows: int) -> tuple[list[list[int]], np.ndarray]:
    """Items dealt to ``windows`` of nearly equal size: the items of each window, and the windows' sizes.

    A partial partition is an imbalance of its windows' sizes, kept in descending order. Merging adds the windows of the one
    to those of the other in opposite order, so that imbalances cancel.
    """
    heap = []
    for item, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size if windows > 1 else 0, item, sums, {0: (item,)}))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, one, held = heapq.heappop(heap)
        _, _, two, more = heapq.heappop(heap)
        sums = one + two[::-1]
        order = np.argsort(-sums, kind="stable")
        place = np.empty(windows, np.int64)
        place[order] = np.arange(windows)
        place = place.tolist()
        sums = sums[order]
        # Windows without items are not noted; the items of a window form a tree until the end.
        both: dict[int, tuple] = {place[at]: tree for at, tree in held.items()}
        for at, tree in more.items():
            at = place[windows - 1 - at]
            both[at] = (both[at], tree) if at in both else tree
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, both))
        serial += 1
    if not heap:
        return [[] for _ in range(windows)], np.zeros(windows, np.int64)
    _, _, sums, held = heap[0]
    return [_leaves(held.get(at)) for at in range(windows)], sums


def _leaves(tree: tuple | None) -> list[int]:
    out, todo = [], [tree] if tree else []
    while todo:
        node = todo.pop()
        if len(node) == 1:
            out.append(node[0])
        else:
            todo += node
    return out


def balanced(sizes: list[int], capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """``differencing`` into the least tried number of windows of which none is over ``capacity``; no item may be over it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt, sums = differencing(sizes, windows)
        if not len(sums) or sums[0] <= capacity:
            return dealt, sums
        windows += 1


@dataclass
class _Document:
    name: object
    ids: bytes
    used: int = 0

    def __len__(self) -> int:
        return len(self.ids) // 4 - self.used


class Packer:
    """The sequences of one task, group by group. ``add`` and ``finish`` give pieces ``(document, start, length, sequence, offset)``."""

    def __init__(self, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS):
        self.capacity, self.most = capacity, capacity * group_windows
        self.whole: list[_Document] = []
        self.fluid: deque[_Document] = deque()
        self.held = self.sequences = 0

    def add(self, name, ids: bytes) -> list[tuple]:
        document = _Document(name, ids)
        if len(document) >= self.capacity:
            self.fluid.append(document)
        else:
            self.whole.append(document)
        self.held += len(document)
        return self._group() if self.held >= self.most else []

    def finish(self) -> list[tuple]:
        """The last group, and what is left of the fluid text in pieces of a power of two."""
        out = self._group()
        left = sum(map(len, self.fluid))
        while left:
            size = 1 << (left.bit_length() - 1)
            out += self._sequence([], size)
            left -= size
        return out

    def _group(self) -> list[tuple]:
        dealt, sums = balanced([len(x) for x in self.whole], self.capacity)
        windows = [([self.whole[i] for i in sorted(items)], int(size)) for items, size in zip(dealt, sums) if items]
        # Fullest first: the emptiest are taken apart where the fluid text is too short for all gaps.
        fluid = sum(map(len, self.fluid))
        missing = sum(self._gap(size) for _, size in windows)
        while missing > fluid:
            documents, size = windows.pop()
            self.fluid.extend(documents)
            fluid, missing = fluid + size, missing - self._gap(size)
        out = []
        for documents, size in windows:
            out += self._sequence(documents, self._gap(size))
        left = sum(map(len, self.fluid))
        while left >= self.capacity:
            out += self._sequence([], self.capacity)
            left -= self.capacity
        self.whole, self.held = [], left
        return out

    def _gap(self, size: int) -> int:
        gap = self.capacity - size
        return gap if gap > LEAST_PIECE and size & (size - 1) else 0

    def _sequence(self, documents: list[_Document], more: int) -> list[tuple]:
        """One sequence: ``documents`` whole, then ``more`` ids of the fluid text."""
        out, offset = [], 0
        for document in documents:
            out.append((document, 0, len(document), self.sequences, offset))
            offset += len(document)
        while more:
            document = self.fluid[0]
            length = min(more, len(document))
            out.append((document, document.used, length, self.sequences, offset))
            document.used += length
            offset, more = offset + length, more - length
            if not len(document):
                self.fluid.popleft()
        self.sequences += 1
        return out


_WORKER: dict[str, WordEncoder] = {}


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    group_windows: int = GROUP_WINDOWS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on demand, its ``ids``.

    Every text is encoded whole and ``end_id`` appended. A sequence holds at most ``capacity`` ids (a power of two) and its pieces lie
    one after another from offset 0. Sequences are made inside the partitions of ``docs``, without a shuffle, so their ids
    are unique but have gaps. NULL and empty texts hold the end id alone. NULL ids and repeated rows come out as often as they came
    in. An empty table gives an empty result; other columns are not read. The tokenizer must drop white space; its
    file is needed on every executor.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _WORKER:
            _WORKER[tokenizer] = WordEncoder(tokenizer)
        encode, end = _WORKER[tokenizer], np.array([end_id], "<u4").tobytes()
        packer, base = Packer(capacity, group_windows), TaskContext.get().partitionId() << 32

        def rows(pieces: list[tuple]) -> pd.DataFrame:
            out = []
            for document, start, length, sequence, offset in pieces:
                ids = document.ids[4 * start:4 * (start + length)]
                row = (document.name, start, length, zlib.crc32(ids), len(document.ids) // 4, base + sequence, offset)
                out.append((*row, np.frombuffer(ids, "<u4").astype("int64")) if with_ids else row)
            return pd.DataFrame(out, columns=names, dtype=object)

        for frame in frames:
            for name, text in zip(frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None), frame["text"]):
                pieces = packer.add(name, encode(text) + end)
                if pieces:
                    yield rows(pieces)
        pieces = packer.finish()
        if pieces:
            yield rows(pieces)

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, schema + (", ids array<bigint>" if with_ids else ""))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4,096 ids, one row per piece; see ``pack_documents``."""
    return pack_documents(documents(spark, sf_dir), default_tokenizer())
