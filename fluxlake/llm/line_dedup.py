"""Line dedup: exact repeats by digest, near repeats by a segment-partition edit join.

Lines are compared without white space at their ends. Of equal lines the first in corpus order (id, then a hash of the text,
then place in the text) is the representative. Representatives of at least ``NEAR_CHARS`` code points are joined within
``edits_of`` edits, a number that grows with the shorter line's length: a line is cut into one segment more than its edits, of
which an edited line must hold one unchanged and hardly shifted; an index row per segment (with the line's length) meets probe
rows for the few substrings, at lengths up to that many edits less, that can be that segment. Most rows meet none, so a first
pass packs the hashes of all rows into buckets and finds those that meet; only their rows get lines. The lines of a hash are held
against each other in blocks of bounded size: matches whose parities of letter pairs differ too much are thrown away, the others are
verified on their texts by a banded bit-parallel edit distance. A representative goes if an earlier one is within that many edits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import by_shuffle, documents, give_back, member_filter, parts_for, small_batches
from fluxlake.session import fresh_path, stage

# Edits of a near-duplicate: two at any length (a swapped pair of letters, a two-digit number), and one more from each of these lengths.
LEAST_EDITS = 2
MORE_EDITS = (100, 200)
# Shorter lines only go as repeats inside their own document.
MIN_CHARS = 20
NEAR_CHARS = 24
SPACES = " \t\n\r\x0b\x0c"
PARITY_BITS = 256
# Code points hashed at a time, signs packed at a time, signs of a task and of a line on average, bits of a sign kept in a bucket.
BLOCK = 1 << 18
PACK_SIGNS = 1 << 20
TASK_SIGNS = 8_000_000
LINE_SIGNS = 36
PACK_BITS = 39
# Lines of a block at most on average, and pairs of a block whose parities are compared at a time.
BLOCK_LINES = 1024
BLOCK_PAIRS = 1 << 17
# Lines of a group that may be split by pivots if links need not be counted; comparisons, in crowds, that cost as much as a line's row
# in one more group; stretches of a pivot for lines far from it and near it.
CROWD = 64
ROW_CROWDS = 8
FINE_CELLS = 16
LARGE_CELLS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def edits_of(length: int, max_edits: int | None = None) -> int:
    """Edits within which a line is near one of ``length`` (the shorter of both): ``max_edits`` if given."""
    return LEAST_EDITS + sum(length >= n for n in MORE_EDITS) if max_edits is None else max_edits


def segments(length: int, max_edits: int) -> list[tuple[int, int]]:
    """``(start, size)`` of the segments of a line: as even as possible, the longer ones last."""
    base, extra = divmod(length, max_edits + 1)
    out, start = [], 0
    for number in range(max_edits + 1):
        size = base + (number > max_edits - extra)
        out.append((start, size))
        start += size
    return out


def substrings(length: int, indexed: int, max_edits: int) -> list[tuple[int, int, int]]:
    """``(segment, start, size)`` in a line of ``length`` that can be a segment of a line of ``indexed``.

    Edits left of the segment shift it by at most their number, which can be taken as at most the segments before it;
    those right of it bound the shift from the other end.
    """
    shift, out = length - indexed, []
    for number, (start, size) in enumerate(segments(indexed, max_edits)):
        right = max_edits - number
        low = max(start - number, start + shift - right, 0)
        high = min(start + number, start + shift + right, length - size)
        out += [(number, at, size) for at in range(low, high + 1)]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(32)
    out ^= x
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the code points of the first plane; powers of the polynomial's base, and their inverses. Made once in each worker."""
    of = np.full(BLOCK, _BASE, np.uint64), np.full(BLOCK, pow(_BASE, -1, 1 << 64), np.uint64)
    return _mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64)), *(_powers(x) for x in of)


def _powers(factors: np.ndarray) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), factors)), dtype=np.uint64)


def _sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial over the code points of ``text``, and the inverse of the power that each begins with."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    number, power, inverse = _tables()
    if len(power) <= len(points):
        # Only a line that is longer than a block.
        power, inverse = (_powers(np.full(len(points), x[1])) for x in (power, inverse))
    sums = np.zeros(len(points) + 1, np.uint64)
    # Clipping is only a quicker way of indexing here: nothing lies outside.
    terms = number.take(points, mode="clip") if points.max(initial=0) < len(number) else _mixed(points.astype(np.uint64) + np.uint64(1))
    terms *= power[:len(points)]
    np.cumsum(terms, out=sums[1:])
    return sums, inverse


def signs(lines: list[str], max_edits: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool, int]]:
    """``(which, sign, probe, edits)``: hashes of the segments of each line and of its substrings that can be another's segment.

    A hash takes in the number of the segment and the length of the line that it indexes. Running sums of a polynomial over
    the code points of all lines give every substring's hash by one difference.
    """
    sizes = np.array([len(line) for line in lines], np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + BLOCK, "right")))
        sums, inverse = _sums("".join(lines[first:last]))
        size, begin = sizes[first:last], ends[first:last] - sizes[first:last] - (ends[first] - sizes[first])
        least, most = edits_of(0, max_edits), edits_of(1 << 60, max_edits)
        for less in range(most + 1):
            for edits in range(max(least, less), most + 1):
                of = np.flatnonzero((size - less >= NEAR_CHARS) & (_edits(size - less, max_edits) == edits))
                if not len(of):
                    continue
                indexed, begins = size[of] - less, begin[of]
                base, extra = np.divmod(indexed, edits + 1)
                for number in range(edits + 1):
                    right = edits - number
                    start, part = number * base + np.maximum(0, number - (edits + 1 - extra)), base + (number > edits - extra)
                    tag = _mixed(((indexed.astype(np.uint64) << np.uint64(8)) | np.uint64(number)) * _MIX)
                    for shift in range(max(-number, less - right), min(number, less + right) + 1):
                        at, which, length, salt = start + shift, of, part, tag
                        where = begins + at
                        if not base.all():
                            # Segments without a code point: some would begin or end outside the line.
                            some = (at >= 0) & (at <= size[of] - part)
                            where, which, length, salt = where[some], of[some], part[some], tag[some]
                        # Of lines of one length, index rows meet index rows for segments in the same place.
                        value = sums[where + length]
                        value -= sums[where]
                        value *= inverse[where]
                        value ^= salt
                        yield first + which, _mixed(value), bool(less or shift), edits
        first = last


def _edits(sizes: np.ndarray, max_edits: int | None) -> np.ndarray:
    """``edits_of`` of many lengths."""
    if max_edits is not None:
        return np.full(len(sizes), max_edits)
    return LEAST_EDITS + sum((sizes >= n).astype(np.int64) for n in MORE_EDITS)


def parity(line: str) -> list[int]:
    """For each of 256 classes of neighbouring characters whether the line has an odd number of them: an edit changes four at most."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    kinds = _mixed(points[:-1] << np.uint64(21) | points[1:]) >> np.uint64(64 - PARITY_BITS.bit_length() + 1)
    odd = np.bincount(kinds.astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of ``a`` and ``b`` if at most ``most``, else ``most + 1``.

    Equal ends are cut off. The rest goes through Myers' recurrence on bit vectors of vertical differences, restricted
    to a band around the diagonal: a word holds the rows that ``most`` edits can reach in a column, and slides down by one
    row per column, so its size does not depend on the lines' length.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not b:
        return len(a)
    width = max(2 * most + 2, len(a) + 1 if len(a) <= most else 0)
    mask, diagonal, horizontal = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    at: dict[str, int] = {}
    for i, char in enumerate(a):
        at[char] = at.get(char, 0) | 1 << i
    start = min(most, len(a))
    up, down, score = mask ^ ((1 << (width - start - 1)) - 1), 0, start
    steep = len(a) - start
    for j, char in enumerate(b):
        shift = start + 1 - width + j
        rows = at.get(char, 0)
        rows = (rows >> shift if shift > 0 else rows << -shift) & mask
        same = ((((rows & up) + up) ^ up) | rows | down) & mask
        more, less = (down | ~(same | up)) & mask, same & up
        if j < steep:
            # The word's last row runs along the band's lower edge: it grows where the diagonal step is no match.
            score += not same & diagonal
        else:
            # The edge has met the last row of ``a``, along which the score now changes.
            score += bool(more & horizontal) - bool(less & horizontal)
            horizontal >>= 1
        up, down = (less | ~(same >> 1 | more)) & mask, same >> 1 & more
    return min(score, most + 1)


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return low


def _alike(a: str, i: int, b: str, j: int) -> int:
    """Length of the common start of ``a[i:]`` and ``b[j:]``; most are short."""
    most = min(len(a) - i, len(b) - j)
    for n in range(min(8, most)):
        if a[i + n] != b[j + n]:
            return n
    return _common(a[i:], b[j:]) if most > 8 else most


def reach(line: str, pivot: str, most: int) -> tuple[int, int]:
    """The lengths of the longest starts of ``pivot`` that a start of ``line`` equals, and is within ``most`` edits of.

    The second goes over the furthest ends on each diagonal, edit by edit. If two lines are within ``most`` edits, the first length of
    either is at most the second of the other: what one line has in common with the pivot, the other has but for those edits.
    """
    equal = _alike(pivot, 0, line, 0)
    ends = {0: equal}
    for _ in range(most):
        onward: dict[int, int] = {}
        for slant, end in ends.items():
            for to, at in ((slant, end + 1), (slant + 1, end + 1), (slant - 1, end)):
                at = min(at, len(pivot))
                if 0 <= at - to <= len(line) and at > onward.get(to, -1):
                    onward[to] = at
        ends = {slant: end + _alike(pivot, end, line, end - slant) for slant, end in onward.items()}
        if not ends or len(pivot) in ends.values():
            break
    return equal, max(equal, *ends.values()) if ends else equal


def cells(line: str, pivot: str, max_edits: int | None) -> tuple[bool, list[int], tuple[int, ...]]:
    """Whether ``line`` is near ``pivot``; cells of which it shares one with every line that is near it, unless both are near the pivot; its ``reach`` from both ends.

    A cell is a stretch of the pivot in which the line's first difference from it may lie, and one for the last difference. A line near
    the pivot may differ anywhere beyond its first difference, so it only meets lines that are no further from the pivot than the
    sum of two such distances, in cells of their own, which are larger.
    """
    own, others = edits_of(len(line), max_edits), edits_of(len(pivot), max_edits)
    far = edit_distance(line, pivot, own + others)
    near = far <= min(own, others)
    starts, ends = reach(line, pivot, own), reach(line[::-1], pivot[::-1], own)
    out = []
    for kind, slices, holds in ((0, FINE_CELLS, not near), (1, LARGE_CELLS, far <= own + others)):
        if holds:
            (a, b), (c, d) = ([n * slices // (len(pivot) + 1) for n in x] for x in (starts, ends))
            out += [(x * slices + y) * 2 + kind for x in range(a, b + 1) for y in range(c, d + 1)]
    return near, out, (*starts, *ends)


def _place(rows: DataFrame) -> str:
    return f"nameless int, id {rows.schema['id'].dataType.simpleString()}, version bigint, pos int"


def _stripped(text: str | None) -> list[str]:
    return [line.strip(SPACES) for line in (text or "").split("\n")]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line that may have an equal in another document: digest and place; the first of equals in a text."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests, places, counts = [], [], []
            for text in frame["text"]:
                first: dict[str, int] = {}
                for pos, line in enumerate(_stripped(text)):
                    if len(line) >= MIN_CHARS:
                        first.setdefault(line, pos)
                digests += [xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in first]
                places += first.values()
                counts.append(len(first))
            if digests:
                of = {name: np.repeat(frame[name].to_numpy(), counts) for name in ("nameless", "id", "version")}
                yield pd.DataFrame({"digest": digests, **of, "pos": places})

    return docs.select("nameless", "id", "version", "text").mapInPandas(run, "digest binary, " + _place(docs))


def _keys(version: int, name, pos: int) -> int:
    """A number for a place. Two places may share one; what is decided is decided by texts and full places."""
    return xxhash.xxh3_64_intdigest(f"{version} {pos} {name}") - (1 << 63)


def _number(sign: np.ndarray) -> np.ndarray:
    """What the filter of meeting signs knows of a sign: the bits that a bucket tells apart, spread over a number."""
    return ((sign >> np.uint64(63 - PACK_BITS - 7)) * _MIX).view(np.int64)


def _near_able(frame: pd.DataFrame) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Representatives that are long enough, and their places."""
    lines, places = [], []
    for name, version, text, firsts in frame[["id", "version", "text", "firsts"]].itertuples(index=False, name=None):
        every = _stripped(text)
        for pos in firsts:
            if len(every[pos]) >= NEAR_CHARS:
                lines.append(every[pos])
                places.append((version, name, pos))
    return lines, places


def _meeting(firsts: DataFrame, max_edits: int | None) -> DataFrame:
    """``number`` of every sign that an index row shares with any other row.

    A sign goes to the bucket of its first bits, as five bytes: ``PACK_BITS`` more bits, and whether it is a probe's. A task sorts
    bucket by bucket. Signs that only agree in those bits are let through as well; later they are compared in full.
    """
    spark = firsts.sparkSession
    total = firsts.agg(F.sum(F.size("firsts"))).first()[0] or 0
    parts = parts_for(total * LINE_SIGNS, TASK_SIGNS, spark)
    bits = np.uint64(64 - max(8, parts.bit_length() + 1))

    def packed(parts: list[np.ndarray]) -> pd.DataFrame:
        both = np.sort(np.concatenate(parts))
        bucket = (both >> bits).astype(np.int32)
        kept = (both >> np.uint64(63 - PACK_BITS - 8)) & np.uint64((1 << (PACK_BITS + 1)) - 1)
        kept = (kept & ~np.uint64(1)) | (both & np.uint64(1))
        raw = np.ascontiguousarray(kept.view(np.uint8).reshape(-1, 8)[:, :5])
        begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.concatenate((begins[1:], [len(bucket)]))
        return pd.DataFrame({"bucket": bucket[begins], "signs": [raw[i:j].tobytes() for i, j in zip(begins, ends)]})

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for frame in frames:
            for _, sign, probe, _ in signs(_near_able(frame)[0], max_edits):
                sign &= ~np.uint64(1)
                sign |= np.uint64(probe)
                held.append(sign)
                count += len(sign)
                if count >= PACK_SIGNS:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)
        held = []
        give_back()

    def meet(bucket: int, blobs: list[bytes]) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        value = np.zeros((len(raw), 8), np.uint8)
        value[:, :5] = raw
        value = np.sort(value.view(np.uint64).ravel())
        same = (value[1:] >> np.uint64(1)) == (value[:-1] >> np.uint64(1))
        # Index rows come first among equal signs.
        begins = np.concatenate(([True], ~same)) & (value & np.uint64(1) == 0)
        found = value[:-1][begins[:-1] & same] >> np.uint64(1)
        first = np.uint64(bucket) >> (np.uint64(56) - bits)
        return pd.DataFrame({"number": (((first << np.uint64(PACK_BITS)) | found) * _MIX).view(np.int64)})

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, blobs = None, []
        for frame in frames:
            for bucket, blob in frame.itertuples(index=False, name=None):
                if bucket != now and blobs:
                    yield meet(now, blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield meet(now, blobs)
        blobs = []
        give_back()

    rows = firsts.mapInPandas(pack, "bucket int, signs binary")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "number bigint")


def _signatures(firsts: DataFrame, max_edits: int | None, wanted) -> DataFrame:
    """``(sign, line, edits, probe)`` of the representatives' signs that the filter ``wanted`` lets through."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines, places = _near_able(frame)
            found = []
            for which, sign, probe, edits in signs(lines, max_edits):
                meets = np.flatnonzero(wanted.value.hold(_number(sign)))
                if len(meets):
                    found.append((which[meets], sign[meets].view(np.int64), np.full(len(meets), edits, np.int32), np.full(len(meets), probe)))
            if found:
                which, sign, edits, probe = (np.concatenate(x) for x in zip(*found))
                some, at = np.unique(which, return_inverse=True)
                keys = np.array([_keys(*places[i]) for i in some], np.int64)
                yield pd.DataFrame({"sign": sign, "line": keys[at], "edits": edits, "probe": probe})
        give_back()

    return firsts.mapInPandas(run, "sign bigint, line bigint, edits int, probe boolean")


def _texts(firsts: DataFrame, wanted) -> DataFrame:
    """``(line, place.., text, odd)`` of the representatives whose number is in the filter ``wanted``."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            columns = frame[["nameless", "id", "version", "text", "firsts"]]
            places = [(row, pos) for row in columns.itertuples(index=False, name=None) for pos in row[4]]
            keys = np.array([_keys(row[2], row[1], pos) for row, pos in places], np.int64)
            rows, of, lines = [], None, []
            for i in np.flatnonzero(wanted.value.hold(keys)):
                row, pos = places[i]
                if row is not of:
                    of, lines = row, _stripped(row[3])
                rows.append((keys[i], *row[:3], pos, lines[pos], parity(lines[pos])))
            if rows:
                yield pd.DataFrame(rows, columns=["line", "nameless", "id", "version", "pos", "text", "odd"])

    return firsts.mapInPandas(run, "line bigint, " + _place(firsts) + ", text string, odd array<bigint>")


def _compared(block: list[tuple], max_edits: int | None, every: bool) -> list[tuple]:
    """``(place.., goes, n_links)`` of the lines of a block that have a link in it. Rows are in corpus order.

    With ``every``, all links are counted, each in the least of the signs that its lines share. Without, a line that is not
    ``open`` or goes already is not held against further ones, and nothing is counted.
    """
    group, lo, hi = block[0][:3]
    slot, texts = np.array([r[3] for r in block]), [r[8] for r in block]
    odd, opens, reaches, signs_of = np.array([r[9] for r in block], np.int64), np.array([r[10] for r in block]), [r[11] for r in block], [r[12] for r in block]
    sizes, at = np.array([len(x) for x in texts], np.int64), np.arange(len(block))
    most, less = _edits(sizes, max_edits), {}
    reached = None if any(x is None for x in reaches) else np.array(reaches)
    links, goes = np.zeros(len(block), np.int64), np.zeros(len(block), bool)

    def lesser(i: int) -> frozenset:
        if i not in less:
            less[i] = frozenset(x for x in signs_of[i].tolist() if x < group)
        return less[i]

    step = max(1, BLOCK_PAIRS // len(block))
    for first in range(0, len(block) - 1, step):
        some = slice(first, first + step)
        allowed = np.minimum(most[some, None], most[None, first:])
        meets = (at[some, None] < at[None, first:]) & (np.abs(sizes[some, None] - sizes[None, first:]) <= allowed)
        meets &= np.bitwise_count(odd[some, None].view(np.uint64) ^ odd[None, first:].view(np.uint64)).sum(axis=-1, dtype=np.int64) <= 4 * allowed
        if lo != hi:
            meets &= slot[some, None] != slot[None, first:]
        if not every:
            meets &= opens[None, first:]
        if reached is not None:
            # Lines of a cell have a pivot in common: each equals it no further than the other reaches, from either end.
            x, y = reached[some, None], reached[None, first:]
            meets &= (x[..., 0] <= y[..., 1]) & (y[..., 0] <= x[..., 1]) & (x[..., 2] <= y[..., 3]) & (y[..., 2] <= x[..., 3])
        for i, j in zip(*(x.tolist() for x in np.nonzero(meets))):
            n, i, j = int(allowed[i, j]), first + i, first + j
            if (not lesser(i).isdisjoint(lesser(j))) if every else goes[j]:
                continue
            if edit_distance(texts[i], texts[j], n) <= n:
                goes[j] = True
                links[i] += 1
                links[j] += 1
    out = np.flatnonzero(links if every else goes).tolist()
    return [(*block[i][4:8], bool(goes[i]), int(links[i]) if every else None) for i in out]


def _held(rows: DataFrame, max_edits: int | None, every: bool) -> DataFrame:
    """``(place.., goes, n_links)`` of lines with a link: the lines of each group held against each other.

    ``rows``: ``(group, n, line, place, text, odd, open, reach, signs)`` with the number ``n`` of lines of the group. A group of many lines
    is dealt to slots, and every two of them meet in a block of their own, so no task holds more than a few blocks' lines.
    """
    slots = F.ceil(F.col("n") / BLOCK_LINES)
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("line"), slots)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), slots - 1)))
    key, place = ["group", "lo", "hi"], ["nameless", "id", "version", "pos"]
    dealt = dealt.select(
        "group", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), "slot", "place.*", "text", "odd", "open", "reach", "signs",
    )

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, found = [], []
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if block and row[:3] != block[0][:3]:
                    found += _compared(block, max_edits, every)
                    block = []
                block.append(row)
            if found:
                yield pd.DataFrame(found, columns=[*place, "goes", "n_links"])
                found = []
        if block and (found := _compared(block, max_edits, every)):
            yield pd.DataFrame(found, columns=[*place, "goes", "n_links"])
        block, found = [], []
        give_back()

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema["place"].dataType) + ", goes boolean, n_links bigint"
    return dealt.repartition(*key).sortWithinPartitions(*key, *place).mapInPandas(run, shape)


def near_lines(firsts: DataFrame, max_edits: int | None, count_links: bool = True) -> DataFrame:
    """``(nameless, id, version, pos, goes, n_links)`` of the representatives that are within ``edits_of`` edits of another.

    ``goes``: an earlier one is. ``n_links``: all others that are, earlier or later. Lines that share a sign are held against each other, each
    pair once. Without ``count_links`` the lines that go are the same, but ``n_links`` is NULL, other rows may be missing, and
    crowds are split by pivots first (``_by_pivots``).

    ``firsts``: rows ``(nameless, id, version, text, firsts)`` with the positions of the representatives in a text.
    """
    spark = firsts.sparkSession
    # Python gets these columns only.
    firsts = firsts.select("nameless", "id", "version", "text", "firsts")
    wanted = spark.sparkContext.broadcast(member_filter(_meeting(firsts, max_edits), "number"))
    rows = stage(_signatures(firsts, max_edits, wanted), "line-signs")
    wanted.destroy()
    rows = rows.groupBy("sign", "line").agg(F.min("probe").alias("probe"), F.first("edits").alias("edits"))
    # Signs of one line alone were let through by chance; near lines share a sign that is a segment of one of them.
    met = rows.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("probe")).where("n > 1 AND NOT probe").select("sign", "n")
    rows = stage(rows.join(by_shuffle(met), "sign"), "line-meets")
    held = spark.sparkContext.broadcast(member_filter(rows.select("line"), "line"))
    # Rows that repeat id and text hold the same lines in the same places: one of each is enough, and is not near itself.
    texts = stage(_texts(firsts, held).dropDuplicates(["line", "nameless", "id", "version", "pos"]), "line-texts")
    held.destroy()
    place = F.struct("nameless", "id", "version", "pos")
    if count_links:
        signs_of = rows.groupBy("line").agg(F.collect_list("sign").alias("signs"))
        known = texts.join(by_shuffle(signs_of), "line").select("line", place.alias("place"), "text", "odd", "signs")
        groups = rows.select(F.col("sign").alias("group"), "n", "line").join(by_shuffle(known), "line").withColumns({"open": F.lit(True), "reach": F.lit(None).cast("array<int>")})
        found = _held(groups, max_edits, True)
    else:
        placed = stage(rows.join(by_shuffle(texts.select("line", place.alias("place"), "odd")), "line").drop("n"), "line-places")
        found = _by_pivots(placed, texts, max_edits)
    return found.groupBy("nameless", "id", "version", "pos").agg(F.max("goes").alias("goes"), F.sum("n_links").alias("n_links"))


def _by_pivots(placed: DataFrame, texts: DataFrame, max_edits: int | None) -> DataFrame:
    """``(place.., goes, n_links)`` of every line that has an earlier one within its edits; links are not counted.

    Lines that share a sign are first held against the earliest of them only, their pivot, one pair a line; a line that this links is
    settled, and only the others are held against earlier lines. Near lines share most of their signs, so those groups mostly have the
    same pivot and the same lines: where that is cheaper, the groups of a pivot become one in which each line has one row. A group of more than
    ``CROWD`` lines is split by where its lines differ from the pivot (``cells``) if that at least halves its rows and comparisons, and
    the groups that come of it likewise, with pivots of their own. So rows can't multiply from split to split.
    """
    place, line = F.struct("nameless", "id", "version", "pos"), ["line", "place"]
    row_cost = ROW_CROWDS * CROWD

    @F.pandas_udf("near boolean, edits int, cells array<int>, reach array<int>")
    def against(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, split in zip(*batch):
                most = edits_of(min(len(a), len(b)), max_edits)
                near, of, ends = cells(b, a, max_edits) if split else (edit_distance(a, b, most) <= most, [], None)
                rows.append((near, edits_of(len(b), max_edits), of, ends))
            yield pd.DataFrame(rows, columns=["near", "edits", "cells", "reach"])
        give_back()

    def with_texts(pairs: DataFrame) -> DataFrame:
        of = lambda x: texts.select(F.col("line").alias(x), place.alias(f"place_{x}"), F.col("text").alias(f"text_{x}"))
        return pairs.join(by_shuffle(of("a")), "a").join(by_shuffle(of("b")), "b").where("place_a < place_b")

    def opened(rows: DataFrame) -> DataFrame:
        return rows.join(by_shuffle(settled.withColumn("done", F.lit(True))), "line", "left").withColumn("open", F.col("done").isNull()).drop("done")

    odd = functools.reduce(Column.__add__, [F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd_a")[i])) for i in range(PARITY_BITS // 64)])
    close = odd <= 4 * F.least("edits", "edits_a")
    none, key = F.lit(None).cast("array<int>").alias("reach"), F.xxhash64("a").alias("group")
    groups = placed.withColumnRenamed("sign", "group").drop("probe")
    found, settled, pairs = [], None, []
    while True:
        heads = groups.groupBy("group").agg(F.min(F.struct("place", "line", "odd", "edits")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        heads = heads.select("group", F.col("first.line").alias("a"), F.col("first.odd").alias("odd_a"), F.col("first.edits").alias("edits_a"))
        meets = groups.join(by_shuffle(heads), "group").where("line != a").select("group", "a", *line, "odd", close.alias("close"))
        meets = stage(meets, "line-members")
        members = stage(meets.groupBy("a", *line).agg(F.first("odd").alias("odd"), F.max("close").alias("close")), "line-pivots")
        # Rows and comparisons of a pivot's groups, apart and as one.
        apart = meets.groupBy("a", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("a").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        sizes = apart.join(members.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
        sizes = sizes.withColumn("one", F.expr(f"n * {row_cost} + n * n <= rows * {row_cost} + squares"))
        sizes = sizes.select("a", "n", "one", F.expr("if(one, n, rows)").alias("rows"), F.expr("if(one, n * n, squares)").alias("squares"))
        sizes = stage(sizes.withColumn("crowd", F.col("squares") > CROWD * F.col("rows")), "line-sizes")
        # Each pivot's lines against it. That of a crowd also says where the others differ.
        star = members.join(sizes.select("a", "crowd"), "a").where("crowd OR close")
        star = with_texts(star.groupBy("a", F.col("line").alias("b")).agg(F.max("crowd").alias("crowd")))
        star = stage(star.select("a", "b", "place_a", "place_b", "crowd", against("text_a", "text_b", "crowd").alias("is")).select("*", "is.*").drop("is"), "line-star-links")
        found.append(star.where("near").select("place_b.*"))
        now = star.where("near").select(F.col("b").alias("line")).distinct()
        settled = stage(now if settled is None else settled.unionByName(now).distinct(), "line-settled")
        where = star.where("crowd").select("a", F.col("b").alias("line"), F.col("place_b").alias("place"), "edits", "cells", "reach")
        crowds = stage(opened(members.join(by_shuffle(where), ["a", *line])).drop("close"), "line-crowds")
        # A crowd's cells that hold an open line and another one, if they cost half as much as the crowd; what is left after many splits is left whole.
        cell = crowds.select("a", F.explode("cells").alias("cell"), "open").groupBy("a", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("m"))
        cell = stage(cell.where("n > 1 AND m > 0"), "line-cells")
        split = crowds.groupBy("a").agg(F.count_if("open").alias("m")).where("m > 0").join(sizes, "a")
        split = split.join(cell.groupBy("a").agg(F.sum(F.expr(f"n * ({row_cost} + m)")).alias("cost")), "a", "left")
        split = stage(split.where(f"2 * coalesce(cost, 0) <= rows * {row_cost} + squares / n * m").select("a"), "line-split")
        whole = sizes.join(split, "a", "left_anti")
        pairs.append(meets.join(whole.where("NOT one"), "a", "left_semi").select("group", *line, "odd", none))
        pairs.append(members.join(whole.where("one AND NOT crowd"), "a", "left_semi").select(key, *line, "odd", none))
        pairs.append(crowds.join(whole.where("one"), "a", "left_semi").select(key, *line, "odd", "reach"))
        if split.isEmpty():
            break
        cut = crowds.join(split, "a", "left_semi").select("a", F.explode("cells").alias("cell"), *line, "odd", "edits")
        groups = stage(cut.join(cell.select("a", "cell"), ["a", "cell"], "left_semi").select(F.xxhash64("a", "cell").alias("group"), *line, "odd", "edits"), "line-groups")
    rest = opened(functools.reduce(DataFrame.unionByName, pairs))
    rest = stage(rest.dropDuplicates(["group", *line]), "line-rest")
    sizes = rest.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any")).where("n > 1 AND any").select("group", "n")
    rest = rest.join(by_shuffle(sizes), "group").join(by_shuffle(texts.select("line", place.alias("place"), "text")), line).withColumn("signs", F.lit(None).cast("array<bigint>"))
    gone = functools.reduce(DataFrame.unionByName, found).distinct().select("*", F.lit(True).alias("goes"), F.lit(None).cast("bigint").alias("n_links"))
    return gone.unionByName(_held(rest, max_edits, False))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int | None = None, report: str = "line_dedup", count_links: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and a struct ``report`` of what was done to it, by default ``line_dedup``.

    The struct: ``n_lines`` (with a word), ``n_exact`` and ``n_near`` taken out, and ``n_links`` (all near links of its representatives, to
    either side; NULL without ``count_links``, which spares comparisons where many lines are alike). Lines without a word always stay, as does the first of equal lines. Lines under ``MIN_CHARS``
    code points go only if their own text has them earlier; others if any earlier text has. NULL texts stay NULL. NULL ids
    come last in corpus order; rows that repeat id and text are one document, so they keep the same lines. An empty
    table gives an empty result; other columns are carried along.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).isNull().cast("int").alias("nameless"), F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"),
        F.xxhash64(text, F.lit(1)).alias("version"), text.alias("text"), F.struct(*[F.col(f"`{name}`") for name in docs.columns if name != text_col]).alias("row"),
    )
    key = ["nameless", "id", "version"]
    lines = _lines(rows)
    firsts = lines.groupBy("digest").agg(F.min(F.struct(*key, "pos")).alias("first")).select("first.*")
    firsts = firsts.groupBy(*key).agg(F.collect_list("pos").alias("firsts"))
    path = fresh_path(spark, "line-firsts")
    marked = rows.join(by_shuffle(firsts), key, "left").withColumn("firsts", F.coalesce("firsts", F.array().cast("array<int>")))
    marked.write.option("compression", "zstd").parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path)
    near = stage(near_lines(marked.where(F.size("firsts") > 0), max_edits, count_links), "line-near")
    touched = near.groupBy(*key).agg(F.collect_set(F.when(F.col("goes"), F.col("pos"))).alias("near"), F.sum("n_links").alias("n_links"))

    @F.pandas_udf("text string, n_lines bigint, n_exact bigint, n_near bigint")
    def rest(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in zip(*batch):
                text, count, exact, close = _rest(*x)
                # A text that lost nothing is not sent back.
                rows.append((text if exact or close else None, count, exact, close))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_exact", "n_near"])
        give_back()

    # Few documents have near repeats: only rows that the filter lets through are joined by a shuffle.
    some = spark.sparkContext.broadcast(member_filter(touched, F.xxhash64(*key)))

    @F.pandas_udf("boolean")
    def may_be_touched(number: pd.Series) -> pd.Series:
        return pd.Series(some.value.hold(number.to_numpy()))

    marked = marked.withColumn("maybe", may_be_touched(F.xxhash64(*key)))
    no_links = F.lit(0 if count_links else None).cast("long")
    none = marked.where(~F.col("maybe")).select("*", F.array().cast("array<int>").alias("near"), no_links.alias("n_links"))
    both = marked.where("maybe").join(by_shuffle(touched), key, "left").withColumns({
        "near": F.coalesce("near", F.array().cast("array<int>")), "n_links": F.coalesce("n_links", no_links),
    })
    done = none.unionByName(both).withColumn("rest", rest("text", "firsts", "near"))
    left = F.when(F.col("rest.n_exact") + F.col("rest.n_near") > 0, F.col("rest.text")).otherwise(F.col("text"))
    return done.select("row", "rest", "n_links", left.alias("left")).select(
        *[(F.col("left") if name == text_col else F.col(f"row.`{name}`")).alias(name) for name in docs.columns],
        F.struct("rest.n_lines", "rest.n_exact", "rest.n_near", "n_links").alias(report),
    )


def _rest(text: str | None, firsts, near) -> tuple[str | None, int, int, int]:
    """The text without its repeats, and the numbers of lines with a word, exact and near repeats."""
    if text is None:
        return None, 0, 0, 0
    firsts, near, seen, kept = *(set(np.asarray(x).tolist()) for x in (firsts, near)), set(), []
    count = exact = close = 0
    for pos, (line, bare) in enumerate(zip(text.split("\n"), _stripped(text))):
        if bare:
            count += 1
            if bare in seen or (len(bare) >= MIN_CHARS and pos not in firsts):
                exact += 1
                continue
            seen.add(bare)
            if pos in near:
                close += 1
                continue
        kept.append(line)
    return "\n".join(kept), count, exact, close


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, exact and near repeats taken out, near links, and the rest of the text as SHA-256."""
    docs = documents(spark, sf_dir)
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
