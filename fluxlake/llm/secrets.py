"""Secret scans: patterns, and a battery of randomness tests for strings that no pattern knows.

Everything is DataFrame and SQL functions. Base spans come from three patterns. Candidates are runs of key-like characters; each
gets the narrowest encoding that its characters fit (hexadecimal, base32, letters and digits, base64). Three tests ask whether
its symbols are a uniform draw from that alphabet: chi-squared of the symbol counts, the number of runs above and below
the alphabet's middle, and the serial correlation of neighbours. Ordinary words fail them as soon as they are long enough. What does
not fail is weighed against ordinary text: the likelihood of its sequence of character kinds under the encoding over
that under a chain fitted to all text outside candidates and to the candidates that fail the battery, so that keys never explain
themselves, however many there are. The inverse of this ratio bounds a p-value, and per length band the Benjamini-Hochberg
rule keeps the share of false discoveries below ``ALPHA``: short strings need more evidence than the same share of long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import documents, hot_join
from fluxlake.session import stage

# The base patterns, the part of each that must be long enough, and that length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
# Equal matches of at least the least length only, where shorter ones can't hide a longer one.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
# Encodings from narrow to wide: name, pattern of the whole string, alphabet in order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hexupper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", LOWER + DIGITS),
    ("base36upper", "^[A-Z0-9]+$", UPPER + DIGITS),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "", UPPER + LOWER + DIGITS + "+/-_"),
)
# Level of a test of the battery (each of three), share of false discoveries, lengths at which bands begin.
LEVEL = 0.001
ALPHA = 0.01
BANDS = (16, 20, 24, 32, 48, 64, 128)
# Steps of the logarithm (base 10) of a p-value, and the smallest that is told apart.
P_STEPS, P_LOWEST = 20, 60
KINDS = 4


# Matches whose places are summed at a time.
_BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def marks(text: Column, pattern: str, keep: int, least: int) -> Column:
    """``(start, stop, token)`` of the matches in code points, less those whose group ``keep`` is shorter than ``least``.

    Matches and what lies between them alternate, so running sums of their lengths are their places: first over blocks
    of matches, then inside each, so a text with very many matches costs no square of their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep))
    between = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(between.alias("gap"), found.alias("token"), parts.alias("part")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["token"]), F.lit(0)).alias("size"), x["token"].alias("token"), F.length(x["part"]).alias("part")),
    )
    none = F.array().cast("array<struct<start:int,stop:int,token:string,part:int>>")

    def inside(block: Column, begin: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            mark = F.struct(start.alias("start"), (start + x["size"]).alias("stop"), x["token"].alias("token"), x["part"].alias("part"))
            return F.struct((start + x["size"]).alias("at"), F.concat(state["out"], F.array(mark)).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("out")), step, lambda state: state["out"])

    def placed(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        begins = F.aggregate(
            blocks, first, lambda state, block: F.struct((state["at"] + size(block)).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out")), lambda state: state["out"]
        )
        return F.flatten(F.zip_with(blocks, begins, inside))

    cut = lambda all_rows: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / _BLOCK).cast("int")), lambda i: F.slice(all_rows, i * _BLOCK + 1, F.lit(_BLOCK))
    )
    every = _let(_let(rows, cut), placed)
    kept = F.filter(every, lambda m: m["part"] >= least)
    out = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["token"].alias("token")))
    # Most texts have no match, and one search is all that they cost.
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<start:int,stop:int,token:string>>"))


def _encoding(token: Column, of) -> Column:
    """The value ``of(alphabet)`` for the narrowest encoding that the token fits."""
    out = None
    for _, pattern, alphabet in reversed(ENCODINGS):
        out = F.lit(of(alphabet)) if out is None else F.when(token.rlike(pattern), F.lit(of(alphabet))).otherwise(out)
    return out


def kind_of(char: str) -> str:
    return "d" if char in DIGITS else "u" if char in UPPER else "l" if char in LOWER else "o"


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens(token)`` with ``encoding, size, z_symbols, z_runs, z_serial``: how far each test is from a uniform draw.

    Under a uniform draw all three are near standard normal: chi-squared by the cube-root transform (large: uneven), the runs
    and the serial correlation by their exact mean and variance.
    """
    token = F.col("token")
    names = {alphabet: name for name, _, alphabet in ENCODINGS}
    halves = {a: "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for a in names}
    df = tokens.select(
        "*", F.length(token).alias("size"), _encoding(token, names.get).alias("encoding"), _encoding(token, lambda a: a).alias("alphabet"),
        _encoding(token, halves.get).alias("halves"), F.split(token, "").alias("chars"),
    )
    n, a = F.col("size").cast("double"), F.length("alphabet").cast("double")
    # The sum of squared counts, from the distinct symbols.
    times = lambda c: n - F.length(F.replace(token, c, F.lit("")))
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda total, c: total + times(c) * times(c))
    chi = squares * a / n - n
    free = a - 1
    cube = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    sides = F.translate(token, ENCODINGS[-1][2], ENCODINGS[-1][2])
    for alphabet in names:
        sides = F.when(F.col("alphabet") == alphabet, F.translate(token, alphabet, halves[alphabet])).otherwise(sides)
    runs = 1 + F.regexp_count(sides, F.lit("0(?=1)|1(?=0)"))
    centred = F.transform("chars", lambda c: F.instr(F.col("alphabet"), c) - 1 - (a - 1) / 2)
    product = lambda x: F.aggregate(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda p, q: p * F.coalesce(q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    serial = _let(centred, product) / ((a * a - 1) / 12) / F.sqrt(n - 1)
    return df.select(
        *tokens.columns, "encoding", "size", cube.alias("z_symbols"), ((runs - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("z_runs"), serial.alias("z_serial"),
    )


def _kinds(token: Column) -> Column:
    every = ENCODINGS[-1][2]
    return F.translate(token, every, "".join(map(kind_of, every)))


_STEPS = [(i, j) for i in "ludo" for j in "ludo"]


def _kind_counts(kinds: Column) -> dict[str, Column]:
    """How often each kind, and each kind after each, occurs. Pairs of two kinds can't overlap, so cutting them out counts them."""
    cut = lambda x: (F.length(kinds) - F.length(F.replace(kinds, F.lit(x), F.lit("")))) / F.lit(len(x))
    pairs = {f"n_{i}{j}": cut(i + j) if i != j else F.regexp_count(kinds, F.lit(f"{i}(?={i})")) for i, j in _STEPS}
    return {name: value.cast("long") for name, value in {**{f"f_{i}": cut(i) for i in "ludo"}, **pairs}.items()}


def _even() -> Column:
    """Whether no test of the battery fails; normal quantiles of ``LEVEL``, one- and two-sided."""
    return (F.col("z_symbols") <= 3.0902) & (F.abs("z_runs") <= 3.2905) & (F.abs("z_serial") <= 3.2905)


def text_kinds(text: DataFrame) -> dict[str, int]:
    """Counts of kinds and of pairs of kinds in all of ``text(text)``: 4 + 16 sums reach the driver."""
    sums = text.select(_kinds(F.col("text")).alias("kinds")).agg(*[F.sum(c).alias(name) for name, c in _kind_counts(F.col("kinds")).items()]).first()
    return {name: value or 0 for name, value in sums.asDict().items()}


def evidence(tokens: DataFrame, text: dict[str, int]) -> DataFrame:
    """``tokens(token, times, encoding, z_.., ..)`` with ``log_p``: log10 of the bound on the chance that ordinary text looks so random.

    Ordinary text is all text, whose counts are ``text``, less the candidates that pass the battery.
    """
    kinds = tokens.withColumn("kinds", _kinds(F.col("token")))
    counted = stage(kinds.select("*", F.substring("kinds", 1, 1).alias("k_first"), *[c.alias(name) for name, c in _kind_counts(F.col("kinds")).items()]), "token-kinds")
    passing = counted.where(_even()).agg(*[F.sum(F.col(name) * F.col("times")).alias(name) for name in text]).first()
    null = {name: max(0, value - (passing[name] or 0)) + 1 for name, value in text.items()}
    # Marks part a token like words of a path: each part between them is weighed on its own, and the marks are not.
    ordinary, drawn = F.lit(0.0), F.lit(0.0)
    for i in "lud":
        begins = F.col(f"n_o{i}") + (F.col("k_first") == i).cast("int")
        ordinary = ordinary + begins * F.lit(math.log10(null[f"f_{i}"] / sum(null[f"f_{k}"] for k in "lud")))
        for j in "lud":
            ordinary = ordinary + F.col(f"n_{i}{j}") * F.lit(math.log10(null[f"n_{i}{j}"] / sum(null[f"n_{i}{k}"] for k in "lud")))
        share = None
        for name, _, alphabet in ENCODINGS:
            some = sum(kind_of(c) == i for c in alphabet) / sum(kind_of(c) != "o" for c in alphabet)
            value = F.lit(math.log10(some) if some else 0.0)
            share = F.when(F.col("encoding") == name, value) if share is None else share.when(F.col("encoding") == name, value)
        drawn = drawn + share * F.col(f"f_{i}")
    return counted.select(*tokens.columns, F.least(F.lit(0.0), ordinary - drawn).alias("log_p"))


def discoveries(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens(size, log_p, z_..)`` that pass the battery and the Benjamini-Hochberg rule of their length band.

    p-values are rounded up to steps, so one count per band and step (at most ``BANDS * P_STEPS * P_LOWEST``) decides.
    """
    band = F.lit(0)
    for low in BANDS[1:]:
        band = band + (F.col("size") >= low).cast("int")
    steps = F.greatest(F.ceil(F.col("log_p") * P_STEPS), F.lit(-P_STEPS * P_LOWEST))
    tested = stage(tokens.select("*", band.alias("band"), F.when(_even(), steps).otherwise(F.lit(0)).cast("int").alias("p_step")), "tested-tokens")
    tally: dict[int, dict[int, int]] = {}
    for row in tested.groupBy("band", "p_step").count().collect():
        tally.setdefault(row["band"], {})[row["p_step"]] = row["count"]
    limit = F.lit(None).cast("int")
    for number, counts in tally.items():
        total, upto, best = sum(counts.values()), 0, None
        for step in sorted(counts):
            upto += counts[step]
            if 10 ** (step / P_STEPS) <= ALPHA * upto / total:
                best = step
        if best is not None:
            limit = F.when(F.col("band") == number, F.lit(best)).otherwise(limit)
    return tested.where(F.col("p_step") <= limit)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base, random``; the last two are arrays of spans.

    ``base``: ``(start, rank, stop)`` by start, then kind (0 assignment, 1 access key, 2 hexadecimal); ``random``:
    ``(start, stop)`` of strings that the battery finds, less those that touch a base span. Starts and ends are code
    points, ends exclusive. NULL text counts as empty. Rows that repeat id and text get the same spans; an empty table
    gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), text)
    # For access keys and hexadecimal runs a shorter match never hides a long one, so the search is for long ones.
    ranked = lambda m, rank: F.transform(m, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))
    spans = [marks(text, ASSIGN, 2, 8), marks(text, LONG_ACCESS, 0, 16), marks(text, LONG_HEX, 0, 32)]
    found = stage(docs.select(
        F.col(id_col).alias("doc_id"), key.alias("row_key"),
        *[ranked(m, rank).alias(f"base{rank}") for rank, m in enumerate(spans)],
        marks(text, CANDIDATE, 0, 16).alias("candidates"),
    ), "secret-spans")
    places = found.select("row_key", F.explode("candidates").alias("c")).select("row_key", "c.*")
    tokens = stage(places.groupBy("token").agg(F.count(F.lit(1)).alias("times")), "tokens")
    total = tokens.agg(F.sum("times")).first()[0] or 0
    kinds = text_kinds(docs.select(text.alias("text")))
    secret = stage(discoveries(evidence(battery(tokens), kinds)).select("token", "times"), "secret-tokens")
    random = hot_join(places, secret, "token", "times", total).groupBy("row_key").agg(F.collect_set(F.struct("start", "stop")).alias("random"))
    base = F.sort_array(F.concat("base0", "base1", "base2"))
    both = found.select("doc_id", "row_key", *[F.size(f"base{r}").cast("long").alias(n) for r, n in enumerate(("n_assign", "n_access", "n_hex"))], base.alias("base")).join(random, "row_key", "left")
    apart = lambda r: ~F.exists("base", lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.sort_array(F.filter(F.coalesce("random", none), apart)).alias("random"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Base spans and random strings of every document; see ``scan``."""
    names = F.array(*[F.lit(name) for name, *_ in BASE], F.lit("random"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    more = F.transform("random", lambda r: F.struct(r["start"].alias("start"), F.lit(len(BASE)).alias("rank"), r["stop"].alias("stop")))
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.sort_array(F.concat("base", more))).alias("spans"),
    )
