"""Exact dedup, line dedup and SimHash against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxlake.llm import exact_dedup, line_dedup, simhash
from fluxlake.llm.common import MemberFilter, components
from fluxlake.session import stage
from tests.llm.conftest import ODD

SPACES = " \t\n\r\x0b\x0c"


def bare(text):
    return "".join(c for c in text or "" if c not in SPACES)


def test_cuckoo_index_follows_a_dict():
    rng, live, index = random.Random(1), {}, exact_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(b"%d" % i).digest() for i in range(3000)]
    for _ in range(20_000):
        key = rng.choice(keys)
        if rng.random() < 0.4:
            assert index.delete(key) == (key in live)
            live.pop(key, None)
        else:
            live[key] = (rng.random(),)
            index.put(key, live[key])
        assert index.count == len(live)
    assert dict(index.items()) == live
    assert all(index.get(k) == live.get(k) for k in keys)


def test_exact_groups(table):
    rows = ODD + [(9, "ab c", None, None), (8, "a b c", None, None), (7, "a\tbc", None, None)]
    got = exact_dedup.exact_dedup(table(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [(i, t) for i, t, *_ in rows if hashlib.sha256(bare(t).encode()).hexdigest() == r.text_sha256]
        keep = min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), r.doc_id == keep)


def test_exact_dedup_of_real_and_no_documents(real, table):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t), i))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(real).collect()} == want
    assert exact_dedup.exact_dedup(table([]).where("false")).count() == 0


def test_index_takes_changes(spark, table):
    before = exact_dedup.digests(table([(1, "a"), (2, "b"), (3, "c c")]))
    index = exact_dedup.build_index(before, 3)
    gone = exact_dedup.digests(table([(0, "b"), (0, "z")])).select("digest")
    added = exact_dedup.digests(table([(4, "cc"), (5, "b"), (6, "d"), (7, "d")]))
    after = exact_dedup.update_index(index, added, gone).collect()
    assert sorted((r.keep_id, r.group_size) for r in after) == [(1, 1), (3, 2), (5, 1), (6, 2)]


# ---- lines -----------------------------------------------------------------------------------------


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


text = st.text(alphabet="abé", max_size=24)


@settings(max_examples=400, deadline=None)
@given(text, text, st.integers(0, 5))
def test_banded_edit_distance(a, b, most):
    assert line_dedup.edit_distance(a, b, most) == min(distance(a, b), most + 1)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab", min_size=8, max_size=30), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.sampled_from("abc")), max_size=4), st.integers(0, 3))
def test_near_lines_share_a_segment(a, edits, most):
    b = list(a)
    for kind, at, char in edits[:most]:
        at = min(at, len(b) - 1)
        b[at:at + (kind != 0)] = [] if kind == 1 else [char]
    short, long = sorted((a, "".join(b)), key=len)
    held = {(n, short[s:s + z]) for n, (s, z) in enumerate(line_dedup.segments(len(short), most))}
    assert held & {(n, long[s:s + z]) for n, s, z in line_dedup.substrings(len(long), len(short), most)}
    odd = [x ^ y for x, y in zip(line_dedup.parity(short), line_dedup.parity(long))]
    assert sum((x & (1 << 64) - 1).bit_count() for x in odd) <= 4 * most


def brute_lines(rows, most):
    """Kept text per row of ``(id, text)``, ids distinct and not NULL, straight from the definition; ``most`` None for the default edits."""
    first: dict = {}
    for i, t in sorted(rows):
        for p, line in enumerate((t or "").split("\n")):
            line = line.strip(SPACES)
            if len(line) >= line_dedup.MIN_CHARS:
                first.setdefault(line, (i, p))
    near = set()
    longer = sorted((x for x in first if len(x) >= line_dedup.NEAR_CHARS), key=len)
    for k, a in enumerate(longer):
        for b in longer[k + 1:]:
            allowed = line_dedup.edits_of(len(a), most)
            if len(b) - len(a) > allowed:
                break
            if distance(a, b) <= allowed:
                near.add(max((first[a], a), (first[b], b))[1])
    out = {}
    for i, t in rows:
        seen, kept = set(), []
        for p, raw in enumerate((t or "").split("\n")):
            line = raw.strip(SPACES)
            if line and (line in seen or (len(line) >= line_dedup.MIN_CHARS and first[line] != (i, p)) or line in near):
                continue
            seen.add(line)
            kept.append(raw)
        out[i] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("most", [0, 1, 2])
def test_line_dedup_equals_the_definition(table, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line) + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines)))
    rows.append((60, None))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(rows), max_edits=most).collect()}
    assert got == brute_lines(rows, most)


def test_signs_are_those_of_segments_and_substrings(monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab é😀") for _ in range(n)) for n in (24, 25, 26, 60, 98, 99, 100, 101, 103, 150, 199, 200, 203, 204, 333)]
    monkeypatch.setattr(line_dedup, "BLOCK", 300)
    for most in (None, 0, 1, 2):
        got: dict = {}
        for which, sign, probe, edits in line_dedup.signs(lines, most):
            for i, one in zip(which.tolist(), sign.tolist()):
                got.setdefault(i, []).append((one, probe, edits))
        told: dict = {}
        for i, line in enumerate(lines):
            want = []
            for indexed in range(line_dedup.NEAR_CHARS, len(line) + 1):
                edits = line_dedup.edits_of(indexed, most)
                if len(line) - indexed <= edits:
                    own = set(enumerate(s for s, _ in line_dedup.segments(indexed, edits))) if indexed == len(line) else set()
                    want += [((indexed, n, line[s:s + z]), (n, s) not in own, edits) for n, s, z in line_dedup.substrings(len(line), indexed, edits)]
            assert sorted((p, e) for _, p, e in want) == sorted((p, e) for _, p, e in got[i])
            told[i] = {w for w, _, _ in want}
        # As many signs as there are different segments: equal ones agree, others differ.
        assert len(set().union(*told.values())) == len({one for rows in got.values() for one, _, _ in rows})


def test_signs_of_lines_with_more_segments_than_code_points():
    lines = ["".join(random.Random(n).choices("ab", k=n)) for n in (24, 25, 27, 31)]
    for which, sign, probe, edits in line_dedup.signs(lines, 30):
        assert len(which) == len(sign) and edits == 30
    got = sorted(i for which, *_ in line_dedup.signs(lines, 30) for i in which.tolist())
    assert got == sorted(i for i, x in enumerate(lines) for n in range(max(24, len(x) - 30), len(x) + 1) for _ in line_dedup.substrings(len(x), n, 30))


def test_powers_are_made_once_for_all_frames(monkeypatch):
    made, cumprod = [], np.cumprod
    monkeypatch.setattr(np, "cumprod", lambda *a, **b: made.append(a) or cumprod(*a, **b))
    for _ in range(5):
        assert len(list(line_dedup.signs(["a line of more than twenty-four letters"], None)))
    assert len(made) <= 2


def test_member_filter_holds_its_members_and_few_others():
    rng = np.random.default_rng(5)
    numbers, words = rng.integers(-(1 << 63), 1 << 63, 20_000), np.zeros(1 << (MemberFilter.BITS - 6), np.uint64)
    for x in numbers[:10_000].tolist():
        for slot in (x & (1 << MemberFilter.BITS) - 1, (x & (1 << 64) - 1) >> 64 - MemberFilter.BITS):
            words[slot >> 6] |= np.uint64(1 << (slot & 63))
    held = MemberFilter(words).hold(numbers)
    assert held[:10_000].all() and held[10_000:].sum() < 10 and MemberFilter(words).hold([]).shape == (0,)


def test_python_is_handed_only_the_columns_that_it_reads(table, monkeypatch):
    handed, meeting = [], line_dedup._meeting
    monkeypatch.setattr(line_dedup, "_meeting", lambda firsts, most: handed.append(firsts.columns) or meeting(firsts, most))
    rows = [(1, "the same line of many letters\nand one more line of letters"), (2, "the same line of many letters"), (3, "and one more lime of letters"), (4, None), (5, "")]
    got = {r.doc_id: (r.text, r.lang) for r in line_dedup.dedup_lines(table(rows)).collect()}
    assert got == {1: (rows[0][1], None), 2: ("", None), 3: ("", None), 4: (None, None), 5: ("", None)}
    assert handed == [["nameless", "id", "version", "text", "firsts"]]


def test_lines_with_two_edits_or_more_go_at_any_length(table):
    rng = random.Random(12)
    rows, gone = [], set()
    for n, change in ((30, 2), (99, 2), (100, 3), (199, 3), (200, 4), (900, 4), (60, 3), (150, 4), (300, 5)):
        for kind in range(3):
            line = [rng.choice("abcdefgh") for _ in range(n)]
            other = list(line)
            for at in sorted(rng.sample(range(n), change), reverse=True):
                other[at:at + (kind != 1)] = ["x"] if kind < 2 else []
            rows += [(len(rows), "".join(line)), (len(rows) + 1, "".join(other))]
            # Dropped characters make the shorter line's length count.
            if change <= line_dedup.edits_of(min(len(line), len(other))):
                gone.add(len(rows) - 1)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(rows)).collect()}
    assert {i for i, t in got.items() if not t} == gone and len(gone) >= 14


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab", max_size=20), st.text(alphabet="ab", max_size=20), st.integers(0, 4))
def test_reach_is_the_longest_start_within_edits(line, pivot, most):
    near = [n for n in range(len(pivot) + 1) if any(distance(line[:k], pivot[:n]) <= most for k in range(len(line) + 1))]
    equal = [n for n in range(len(pivot) + 1) if line.startswith(pivot[:n])]
    assert line_dedup.reach(line, pivot, most) == (max(equal), max(near))


def _variant(rng, line, words):
    """``line`` with some words replaced and up to three characters changed."""
    parts = line.split(" ")
    for at in rng.sample(range(len(parts)), words):
        parts[at] = "".join(rng.choice("uvwxyz") for _ in range(rng.randint(2, 9)))
    out = list(" ".join(parts))
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(out))
        out[at:at + rng.randint(0, 1)] = rng.choice(["", "q", "?"])
    return "".join(out)


def test_near_lines_share_a_cell_of_any_pivot():
    rng, held = random.Random(8), 0
    for _ in range(1500):
        pivot = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 24)))
        a = _variant(rng, pivot, rng.randint(0, 2))
        b = _variant(rng, a, 0)
        if distance(a, b) <= line_dedup.edits_of(min(len(a), len(b))):
            (near_a, of_a, x), (near_b, of_b, y) = line_dedup.cells(a, pivot, None), line_dedup.cells(b, pivot, None)
            assert (near_a and near_b) or set(of_a) & set(of_b)
            assert x[0] <= y[1] and y[0] <= x[1] and x[2] <= y[3] and y[2] <= x[3]
            held += not (near_a and near_b)
    assert held > 300


def test_crowd_of_one_template_equals_the_definition(table, spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(12))
    rows = [(0, base)]
    while len(rows) < 160:
        rows.append((len(rows), _variant(rng, rng.choice([base, base, base, rng.choice(rows)[1]]), rng.randint(0, 2))))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(rows)).collect()}
    want = brute_lines(rows, None)
    assert got == want and 20 < sum(not t for t in want.values()) < 140


def test_pairs_of_a_crowd_do_not_grow_with_its_square(table, monkeypatch):
    names, stage = [], line_dedup.stage

    def noted(rows, name):
        out = stage(rows, name)
        names.append((name, out))
        return out

    monkeypatch.setattr(line_dedup, "stage", noted)
    rng = random.Random(10)
    base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(40))
    rows = [(i, " ".join("".join(rng.choice("uvwxyz") for _ in range(7)) if k in some else word for k, word in enumerate(base.split(" ")))) for i in range(2000) for some in [rng.sample(range(40), 2)]]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(rows)).collect()}
    assert got == dict(rows)
    # Two million pairs of lines share a sign; a line is held against some pivots, and few against others.
    assert sum(out.count() for name, out in names if name == "line-star-links") < 50_000
    assert sum(out.count() for name, out in names if name == "line-rest-pairs") < 5_000


def test_lines_that_differ_in_any_one_character_are_near(table):
    line = "words of a line that is long enough to be held against others"
    rows = [(0, line)] + [(i, line + chr(32 + i)) for i in range(1, 95)]
    assert not any(r.text for r in line_dedup.dedup_lines(table(rows)).where("doc_id > 0").collect())


@pytest.mark.parametrize("lines_of_a_block", [1024, 12])
def test_all_links_of_a_crowd_are_counted(table, monkeypatch, lines_of_a_block):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", lines_of_a_block)
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    rng = random.Random(21)
    base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(12))
    # The third line is near both others, which are not near each other: only one of its links decides.
    lines = ["x" * 30 + "abcd", "x" * 30 + "efcd", "x" * 30 + "ebcd", *{_variant(rng, base, rng.randint(0, 1)) for _ in range(120)}]
    rows = [(i, f"{a}\n{b}") for i, (a, b) in enumerate(zip(lines[::2], lines[1::2]))]
    flat = [(i, line) for i, t in rows for line in t.split("\n")]
    want = dict.fromkeys(range(len(rows)), 0)
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if a != b and distance(a, b) <= line_dedup.edits_of(min(len(a), len(b))):
                want[i] += 1
                want[j] += 1
    got = line_dedup.dedup_lines(table(rows)).collect()
    assert {r.doc_id: r.line_dedup.n_links for r in got} == want and sum(want.values()) > 4 * len(flat)
    spared = line_dedup.dedup_lines(table(rows), count_links=False).collect()
    assert {r.doc_id: r.text for r in got} == {r.doc_id: r.text for r in spared} == brute_lines(rows, None)
    assert {r.line_dedup.n_links for r in spared} == {None}


@pytest.mark.parametrize("count_links", [True, False])
def test_lines_of_repeated_rows_are_not_near_themselves(table, count_links):
    line = "a line that is long enough to be held against others"
    rows = [(1, f"{line}\nanother line that no other text has, or so it seems"), (2, line + "s"), (3, "x")]
    got = line_dedup.dedup_lines(table(rows + rows), count_links=count_links).collect()
    # The line of row 2 goes, as row 1 has one within an edit; the lines of row 1 stay in both copies.
    assert sorted((r.doc_id, r.text, r.line_dedup.n_near, r.line_dedup.n_links) for r in got) == sorted(
        (i, "" if i == 2 else t, int(i == 2), (int(i < 3) if count_links else None)) for i, t in rows + rows)


def test_lines_go_alike_without_counted_links(table, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(12))
    rows = [(0, base)]
    while len(rows) < 160:
        rows.append((len(rows), _variant(rng, rng.choice([base, base, base, rng.choice(rows)[1]]), rng.randint(0, 2))))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(rows), count_links=False).collect()}
    assert got == brute_lines(rows, None)


def test_lines_that_share_many_signs_meet_once(table, monkeypatch):
    counts, stage = {}, line_dedup.stage

    def noted(rows, name):
        out = stage(rows, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "stage", noted)
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(6, 8)))
    base = [word("abcde") for _ in range(40)]
    rows = [(i, " ".join(word("uvwxyz") if k in some else x for k, x in enumerate(base))) for i in range(300) for some in [rng.sample(range(40), 2)]]
    rows += [(300 + i, rows[rng.randrange(300)][1][:-1] + "!") for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(rows), count_links=False).collect()}
    assert got == dict(rows[:300]) | {i: "" for i in range(300, 320)}
    # All share signs with the first that has them, and each line meets the others of such a first line in one row, not in one per sign or cell.
    assert counts["line-meets"] > 5000 and counts["line-rest"] < 2000


@pytest.mark.parametrize("count_links", [True, False])
def test_tables_of_lines_are_not_broadcast(table, monkeypatch, count_links):
    plans, text = {}, "a line that stands in many a document with a number, {}"

    def noted(rows, name):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return stage(rows, name)

    monkeypatch.setattr(line_dedup, "stage", noted)
    done = line_dedup.dedup_lines(table([(i, text.format(i)) for i in range(8)]), count_links=count_links)
    plans["done"] = done._jdf.queryExecution().executedPlan().toString()
    for name in ("line-meets", "line-near", "done", *([] if count_links else ["line-places", "line-members", "line-crowds"])):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name], name


def test_line_dedup_of_odd_rows(table):
    long = "a line that is long enough to be compared"
    rows = ODD + [(20, f"{long}\nx\nx\n\n{long}s", None, None), (21, f"  {long}\t\nx", None, None), (None, f"new words for a line in here\n{long}", None, None)]
    done = line_dedup.dedup_lines(table(rows))
    assert done.columns == [*table([]).columns, "line_dedup"] if rows is None else done.columns[:-1] == table(rows).columns
    got = [(r.doc_id, r.text, r.line_dedup) for r in done.collect()]
    assert len(got) == len(rows)
    by_id = {i: (t, d) for i, t, d in got if i is not None}
    assert by_id[20][0] == f"{long}\nx\n" and (by_id[20][1].n_exact, by_id[20][1].n_near) == (1, 1)
    assert by_id[21][0] == "x"
    assert ("new words for a line in here" in [t for i, t, _ in got if i is None])
    assert line_dedup.dedup_lines(table(rows).where("false")).count() == 0


# ---- SimHash ---------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_ball_layout_never_misses():
    rng = random.Random(0)
    for segments, most in ((3, 4), (4, 4), (2, 3), (5, 2)):
        parts = simhash.layout(segments, most)
        assert sum(w for _, w, _ in parts) == 64
        for _ in range(3000):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
            assert any((flips >> first & (1 << width) - 1).bit_count() <= radius for first, width, radius in parts)


def test_links_equal_all_pairs(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints):
        for _ in range(4):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}


def test_crowded_segments_give_the_same_components(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(30)}
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp bigint"), crowd=2)).collect()}
    groups: dict = {}
    for x, c in zip(prints, brute_components([x & (1 << 64) - 1 for x in prints])):
        groups.setdefault(c, set()).add(x)
    mine: dict = {}
    for x in prints:
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values())) and len(groups) > 30


def test_rows_made_by_an_explode_are_not_broadcast(spark):
    prints = stage(spark.range(300).select(F.xxhash64("id").alias("fp")), "prints")
    for edges in (simhash.links(prints), simhash._midpoints(prints, 2)):
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 207)}}


def test_simhash_equals_brute_force(real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").orderBy("doc_id").collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    smallest: dict = {}
    for (i, _), c in zip(rows, roots):
        smallest[c] = min(i, smallest.get(c, i))
    want = {i: (f"{p:016x}", smallest[c]) for (i, _), p, c in zip(rows, prints, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(real).collect()} == want


def test_simhash_of_odd_rows(table):
    rows = ODD + [(30, "w " * 200_000, None, None)]
    got = simhash.simhash_groups(table(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[3].fingerprint == "0" * 16 and by_id[3].component_id == 1
    assert by_id[5].component_id == 4 and by_id[30].fingerprint == f"{brute_fingerprint('w ' * 10):016x}"
    kept = simhash.keep_first(table(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 6, 30]
    assert simhash.simhash_groups(table(rows).where("false")).count() == 0


def test_long_text_in_blocks(monkeypatch):
    words = " ".join(np.random.default_rng(0).integers(0, 500, 4000).astype(str))
    whole = simhash.fingerprint(words)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(words) == whole
