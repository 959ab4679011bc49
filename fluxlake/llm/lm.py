"""Language-model scoring with a gated recurrent network.

Words are counted over all training texts. The most frequent ones, an end mark and "any other word" are the network's
vocabulary; which other word it is follows add-one counts. The network is a gated recurrent unit with a class-factored
softmax: first the class of the next word, then the word among its class. It is trained by truncated backpropagation over
windows, with the state carried from window to window of a document, in rounds: in a round each partition trains on its
share of the documents, then the weights are averaged. Every training document is used in one round, whole. Scoring
carries the state through the complete document too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import crc_slot, documents
from fluxlake.session import stage

VOCABULARY = 1024
CLASSES = 20
HIDDEN = 16
# Steps of a window: at least so many, and more when few texts of a group go on, up to so many tokens or steps.
WINDOW = 16
LONGEST_WINDOW = 256
TRAIN_TOKENS = 4096
SCORE_TOKENS = 16_384
# Documents that step together in training and scoring, and tokens that are held at a time.
TRAIN_ROWS = 256
SCORE_ROWS = 1024
HOLD_TOKENS = 3_000_000
# Sixteenths of the training documents in each round: a short one first, so that all partitions go on from a common start.
ROUNDS = ((0, 1), (1, 5), (5, 16))
RATES = (0.02, 0.01, 0.005)
# A word with one in so many training tokens is frequent: at most this many are, so their counts may be broadcast.
FREQUENT_PARTS = 1 << 19
# Distinct words that a partition counts before it hands them on.
HOLD_WORDS = 400_000
END, OTHER = 0, 1
_UNIT = 1 << 30


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, with A-Z in lower case; NULL has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, count)`` over ``docs(text)``; the empty word stands for the ends."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                held.update(words_of(text))
                held[b""] += 1
                if len(held) >= HOLD_WORDS:
                    yield pd.DataFrame({"word": list(held), "count": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "count": list(held.values())})

    return docs.select("text").mapInPandas(run, "word binary, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


class Words:
    """The frequent words: index of each in the network's vocabulary (the rest is OTHER) and its count."""

    def __init__(self, rows: list[tuple[bytes, int]], vocabulary: int = VOCABULARY):
        """``rows``: frequent words with counts, most frequent first."""
        ends = next((c for w, c in rows if w == b""), 0)
        rows = [(w, c) for w, c in rows if w != b""]
        self.place = {w: i for i, (w, _) in enumerate(rows)}
        named = min(len(rows), vocabulary - 2)
        self.token = np.full(len(rows) + 1, OTHER, np.int32)
        self.token[:named] = np.arange(named) + 2
        self.count = np.array([c for _, c in rows] + [0], float)
        self.size = named + 2
        self.ends = ends
        self.named = float(self.count[:named].sum()) + ends
        self.n_named = named

    def places(self, words: list[bytes]) -> np.ndarray:
        """Index of each word; the last index is that of a word that is not frequent."""
        get, last = self.place.get, len(self.place)
        return np.fromiter((get(w, last) for w in words), np.int64, len(words))


class Network:
    """Weights of the model and its forward and backward passes; all arrays are float32."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 1):
        """``counts`` of the tokens, from which they are dealt to classes by equal shares of root counts."""
        rng = np.random.default_rng(seed)
        weight = np.sqrt(counts + 1.0)
        order = np.argsort(-counts, kind="stable")
        share = np.cumsum(weight[order]) / weight.sum()
        of = np.minimum((share * classes - 1e-9).astype(int), classes - 1)
        self.klass = np.empty(len(counts), np.int32)
        self.klass[order] = np.unique(of, return_inverse=True)[1]
        self.members = [np.flatnonzero(self.klass == c) for c in range(self.klass.max() + 1)]
        self.rank = np.empty(len(counts), np.int32)
        for members in self.members:
            self.rank[members] = np.arange(len(members))
        self.hidden = hidden
        prior = np.log(counts + 1.0)
        by_class = np.array([counts[m].sum() for m in self.members])
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.w = {
            "inputs": draw(len(counts) + 1, 3 * hidden), "state": draw(hidden, 3 * hidden), "bias": np.zeros(3 * hidden, np.float32),
            "classes": draw(hidden, len(self.members)), "class_bias": np.log(by_class + 1.0).astype(np.float32),
            "words": draw(len(counts), hidden), "word_bias": prior.astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in self.w.items():
            self.w[name] = np.asarray(flat[at:at + w.size], np.float32).reshape(w.shape)
            at += w.size

    def states(self, tokens: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
        """States before each of the ``tokens`` (steps by rows), from the state ``h`` and the token before the first.

        ``tokens`` has one step more in front. Returns states per step, and what the backward pass needs.
        """
        k, kept = self.hidden, []
        out = np.empty((len(tokens) - 1, *h.shape), np.float32)
        given = self.w["inputs"][tokens[:-1]] + self.w["bias"]
        for step in range(len(tokens) - 1):
            inner = h @ self.w["state"]
            gates = 1 / (1 + np.exp(-(given[step, :, :2 * k] + inner[:, :2 * k])))
            keep, reset = gates[:, :k], gates[:, k:]
            new = np.tanh(given[step, :, 2 * k:] + reset * inner[:, 2 * k:])
            kept.append((h, keep, reset, inner[:, 2 * k:], new))
            h = new + keep * (h - new)
            out[step] = h
        return out, kept

    def losses(self, h: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, dict | None, np.ndarray | None]:
        """Log-probability (natural) of each target after its state and, if ``learn``, gradients of their negative sum."""
        klass = self.klass[target]
        rows = np.arange(len(target))
        score, p = _log_softmax(h @ self.w["classes"] + self.w["class_bias"], klass, rows)
        grads = back = None
        if learn:
            p[rows, klass] -= 1
            back = p @ self.w["classes"].T
            grads = {"classes": h.T @ p, "class_bias": p.sum(0), "words": np.zeros_like(self.w["words"]), "word_bias": np.zeros_like(self.w["word_bias"])}
        order = np.argsort(klass, kind="stable")
        ends = np.searchsorted(klass[order], np.arange(len(self.members) + 1))
        for c, members in enumerate(self.members):
            some = order[ends[c]:ends[c + 1]]
            if not len(some) or len(members) == 1:
                continue
            own, words = h[some], self.w["words"][members]
            inside, q = _log_softmax(own @ words.T + self.w["word_bias"][members], self.rank[target[some]], np.arange(len(some)))
            score[some] += inside
            if learn:
                q[np.arange(len(some)), self.rank[target[some]]] -= 1
                back[some] += q @ words
                grads["words"][members] = q.T @ own
                grads["word_bias"][members] = q.sum(0)
        return score, grads, back

    def gradients(self, tokens: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients over one window, and the state after it. ``live`` marks the targets that exist."""
        k = self.hidden
        out, kept = self.states(tokens, h)
        where = np.nonzero(live)
        _, grads, back = self.losses(out[where], tokens[1:][where], True)
        above = np.zeros_like(out)
        above[where] = back
        given = np.empty((len(out), len(h), 3 * k), np.float32)
        d_state = np.zeros_like(self.w["state"])
        flow = np.zeros_like(h)
        for step in range(len(out) - 1, -1, -1):
            before, keep, reset, inner, new = kept[step]
            flow = flow + above[step]
            d_new = flow * (1 - keep) * (1 - new * new)
            d_keep = flow * (before - new) * keep * (1 - keep)
            d_reset = d_new * inner * reset * (1 - reset)
            given[step, :, :k], given[step, :, k:2 * k], given[step, :, 2 * k:] = d_keep, d_reset, d_new
            d_inner = np.concatenate((d_keep, d_reset, d_new * reset), axis=1)
            d_state += before.T @ d_inner
            flow = flow * keep + d_inner @ self.w["state"].T
        flat, used = given.reshape(-1, 3 * k), tokens[:-1].ravel()
        order = np.argsort(used, kind="stable")
        names, starts = np.unique(used[order], return_index=True)
        grads["inputs"] = np.zeros_like(self.w["inputs"])
        grads["inputs"][names] = np.add.reduceat(flat[order], starts, axis=0)
        grads["state"], grads["bias"] = d_state, flat.sum(0)
        return grads, out[-1]


def _log_softmax(x: np.ndarray, target: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each row's target, and all probabilities."""
    x = x - x.max(1, keepdims=True)
    e = np.exp(x)
    total = e.sum(1)
    score = x[rows, target] - np.log(total)
    e /= total[:, None]
    return score, e


def _windows(texts: list[np.ndarray], rows: int, most: int, start: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Windows over groups of texts of like lengths: ``(which texts, place, tokens, live, first)``.

    Texts that have ended leave the group at the next window. ``tokens`` holds one step before the window, at first ``start``.
    A window has ``most`` tokens if that makes ``WINDOW`` to ``LONGEST_WINDOW`` steps.
    """
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for at in range(0, len(order), rows):
        group = order[at:at + rows]
        sizes = np.array([len(texts[i]) for i in group])
        begin = 0
        while begin < sizes[0]:
            n = int(np.searchsorted(-sizes, -begin, side="left"))
            steps = min(max(WINDOW, min(LONGEST_WINDOW, most // n)), int(sizes[0]) - begin)
            tokens = np.full((steps + 1, n), END, np.int64)
            live = (np.arange(steps)[:, None] + begin) < sizes[:n]
            for column, i in enumerate(group[:n]):
                if begin:
                    part = texts[i][begin - 1:begin + steps]
                    tokens[:len(part), column] = part
                else:
                    part = texts[i][:steps]
                    tokens[0, column] = start
                    tokens[1:len(part) + 1, column] = part
            yield group[:n], begin, tokens, live, begin == 0
            begin += steps


def train_texts(net: Network, texts: list[np.ndarray], rate: float, memory: dict) -> None:
    """Truncated backpropagation over whole texts of tokens, by Adam on the mean gradient of a window's tokens."""
    start = len(net.klass)
    h = np.zeros((0, net.hidden), np.float32)
    for group, _, tokens, live, first in _windows(texts, TRAIN_ROWS, TRAIN_TOKENS, start):
        h = np.zeros((len(group), net.hidden), np.float32) if first else h[:len(group)]
        grads, h = net.gradients(tokens, live, h)
        count = live.sum()
        memory["step"] = step = memory.get("step", 0) + 1
        speed = rate * min(1.0, count / 256) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        for name, w in net.w.items():
            g = grads[name]
            g /= count
            m, v = memory.setdefault(name, (np.zeros_like(w), np.zeros_like(w)))
            m += (g - m) * np.float32(0.1)
            v += (g * g - v) * np.float32(0.01)
            w -= np.float32(speed) * m / (np.sqrt(v) + np.float32(1e-6))


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each text of tokens, over its whole length."""
    out, h = np.zeros(len(texts)), np.zeros((0, net.hidden), np.float32)
    for group, _, tokens, live, first in _windows(texts, SCORE_ROWS, SCORE_TOKENS, len(net.klass)):
        h = np.zeros((len(group), net.hidden), np.float32) if first else h[:len(group)]
        states, _ = net.states(tokens, h)
        h = states[-1]
        where = np.nonzero(live)
        score, _, _ = net.losses(states[where], tokens[1:][where], False)
        out[group] += np.bincount(where[1], score, len(group))
    return out


def _held(frames: Iterable[pd.DataFrame], words: Words) -> Iterator[tuple[list, list[np.ndarray], list[np.ndarray], list[list[bytes]]]]:
    """Rows with the places and tokens of their texts, as many as fit ``HOLD_TOKENS``."""
    rows, places, tokens, rare, size = [], [], [], [], 0
    last, end = len(words.place), np.array([END], np.int32)
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            some = words_of(row[-1])
            place = words.places(some)
            rows.append(row[:-1])
            places.append(place)
            tokens.append(np.concatenate((words.token[place], end)))
            rare.append([some[i] for i in np.flatnonzero(place == last)])
            size += len(some) + 1
            if size >= HOLD_TOKENS:
                yield rows, places, tokens, rare
                rows, places, tokens, rare, size = [], [], [], [], 0
    if rows:
        yield rows, places, tokens, rare


def train(docs: DataFrame, words: Words, other: float) -> Network:
    """The network after all rounds over the training rows ``docs(slice, text)``; ``other``: tokens that aren't named."""
    spark = docs.sparkSession
    counts = np.concatenate(([words.ends, other], words.count[:words.n_named]))
    net = Network(counts)
    shared = spark.sparkContext.broadcast(words)
    for (low, high), rate in zip(ROUNDS, RATES):
        now = spark.sparkContext.broadcast(net)

        def run(frames: Iterable[pd.DataFrame], now=now, rate=rate) -> Iterator[pd.DataFrame]:
            own, memory, seen = now.value, {}, 0
            own.load(own.flat().copy())
            for _, _, tokens, _ in _held(frames, shared.value):
                train_texts(own, tokens, rate, memory)
                seen += sum(map(len, tokens))
            if seen:
                yield pd.DataFrame({"weights": [own.flat().astype(float)], "seen": [seen]})

        part = docs.where(F.col("slice").between(low, high - 1)).select("text").mapInPandas(run, "weights array<double>, seen bigint")
        # Averages in whole units of 2^-30, which come out alike in whatever order they are added.
        each = part.select("seen", F.posexplode("weights").alias("at", "weight"))
        sums = each.groupBy("at").agg(F.sum((F.col("weight") * _UNIT).cast("decimal(20,0)") * F.col("seen")).cast("double").alias("total"), F.sum("seen").alias("seen"))
        mean = sums.select("at", (F.col("total") / F.col("seen") / _UNIT).alias("weight")).toArrow()
        if mean.num_rows:
            flat = np.empty(mean.num_rows)
            flat[mean["at"].to_numpy()] = mean["weight"].to_numpy()
            net.load(flat)
    return net


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose crc32 of the id modulo 7 is not 2. ``base_score`` is the log10 probability by add-one counts
    of all words, ``score`` that of the network; both hold every word of the text and one end. NULL text counts as
    empty: an end alone. Repeated rows are scored alike; an empty table gives an empty result; other columns are not
    read. Words that never occur in training share one smoothed count, as in the base.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_slot(F.col(id_col), 7) == 2).alias("held_out"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.col(text_col)).alias("row_key"),
    )
    training = rows.where(~F.col("held_out")).withColumn("slice", F.pmod(F.xxhash64("row_key", F.lit(3)), F.lit(16)))
    counts = stage(count_words(training), "word-counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("count"), F.count(F.lit(1))).first())
    frequent = counts.where(F.col("count") * FREQUENT_PARTS >= F.lit(total)).orderBy(F.desc("count"), "word")
    words = Words([(bytes(w), c) for w, c in zip(*frequent.toArrow().to_pydict().values())])
    other = total - words.named
    net = train(training, words, other) if total else Network(np.array([1.0, 1.0]))
    # Add-one weight of all words outside of the network's vocabulary, the unseen as one of them.
    outside = np.log10(other + (distinct - words.n_named - (words.ends > 0)) + 1.0)
    held, model = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, net = held.value, model.value
        logs, last = np.log10(words.count + 1), len(words.place)
        for rows, places, tokens, rare in _held(frames, words):
            out = pd.DataFrame(rows, columns=["doc_id", "held_out", "row_key"])
            out["n_tokens"] = [len(t) for t in tokens]
            out["n_known"] = [int((p != last).sum()) + int(words.ends > 0) for p in places]
            out["log_counts"] = [float(logs[p].sum()) + float(np.log10(words.ends + 1)) for p in places]
            other = [p[words.token[p] == OTHER] for p in places]
            out["n_other"] = [len(p) for p in other]
            out["log_others"] = [float(logs[p].sum()) for p in other]
            out["net_score"] = score_texts(net, tokens) / np.log(10)
            found = [Counter(some) for some in rare]
            out["rare"] = [list(c) for c in found]
            out["times"] = [list(c.values()) for c in found]
            yield out

    schema = (
        f"doc_id {kind}, held_out boolean, row_key bigint, n_tokens bigint, n_known bigint, log_counts double, n_other bigint, "
        "log_others double, net_score double, rare array<binary>, times array<bigint>"
    )
    scored = stage(rows.select("doc_id", "held_out", "row_key", "text").mapInPandas(score, schema), "scored")
    # Words that aren't frequent meet their counts in a shuffle: none of them has many rows.
    each = scored.select("row_key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_key", "x.rare", "x.times")
    known = counts.where(F.col("count") * FREQUENT_PARTS < F.lit(total)).select(F.col("word").alias("rare"), F.col("count").alias("c"))
    more = each.join(known, "rare").groupBy("row_key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    # Rows that repeat id and text share a key, whose sums then hold each of them.
    copies = scored.where(F.size("rare") > 0).groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    more = more.join(copies, "row_key").select("row_key", (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"), (F.col("more_logs") / F.col("copies")).alias("more_logs"))
    both = scored.drop("rare", "times").join(more, "row_key", "left").fillna({"more_known": 0, "more_logs": 0.0})
    scale = float(np.log10(total + distinct + 1))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("more_logs") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("net_score") + F.col("log_others") + F.col("more_logs") - F.col("n_other") * F.lit(float(outside))).alias("score"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
