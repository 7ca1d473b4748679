"""Language-model scores by prediction by partial matching (PPM) over bytes.

The pretrained model is the byte-context trie of order ``ORDER`` of all training documents, kept as Spark tables: one
row for each context and next symbol, with its count; shorter contexts are sums over longer ones. A symbol that a
context has not seen is coded by its escape (distinct symbols seen over that and the count) and then by the context
one byte shorter, where the symbols of the longer context are excluded. In a trie of one corpus the symbols of a
context are among those of its suffix, so what exclusion leaves depends on the two contexts alone and is worked out once
for each context by a join. The code length of a document is the sum over its symbols; symbol 256 stands before and
after a text.

Two passes read the texts: one counts context-symbol rows and words, one scores. Scoring looks the most frequent rows and
words up in a broadcast of bounded size (``HEAD_GRAMS``, ``HEAD_WORDS``); every other row or word of a document goes
through a shuffled join, so results cover the whole trie at any size and no frequent key is ever shuffled.

``adaptive`` scores instead learn from the document itself, byte by byte, with the same escapes and exclusion.

Defined results: null text is the empty text (one end symbol, one end token); a null doc_id counts as the empty text
for the split; without training documents every symbol is equally likely; equal rows are scored alike, one row out for
each row in; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, slices, stored, text_of

ORDER = 4
EDGE = 256
SYMBOLS = 257
HEAD_GRAMS = 1 << 20
HEAD_WORDS = 1 << 18
WIDTH = 9  # bits of a symbol


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every position of the lower-cased texts, as numbers of ``order + 1`` symbols; ends of the texts."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths + order) - (lengths + order)
    s = np.full(int((lengths + order).sum()), EDGE, np.int64)
    for a, t in zip(starts.tolist(), texts, strict=True):
        s[a + order : a + order + len(t)] = np.frombuffer(t.lower(), np.uint8)
    n = len(s) - order
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = s[:n].copy()
    for j in range(1, order + 1):
        g <<= WIDTH
        g |= s[j : j + n]
    keep = np.ones(n, bool)
    for j in range(order):
        at = starts + lengths + j  # windows that begin behind a text's end symbol
        keep[at[at < n]] = False
    return g[keep], np.cumsum(lengths)


def _counted(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    return g[first], np.add.reduceat(c, first) if len(g) else c


def _tally(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    return g[first], np.diff(np.concatenate([first, [len(g)]])).astype(np.int64)


def _count(order: int):
    """Rows (gram, word, n, trained) of a task; ``n`` counts all documents, ``trained`` the training documents."""

    def rows(grams: list, words: Counter, known: Counter) -> Iterator[pa.RecordBatch]:
        names = ["gram", "word", "n", "trained"]
        for t, kept in enumerate(grams):
            if kept:
                g, c = _counted([x[0] for x in kept], [x[1] for x in kept])
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.nulls(len(g), pa.binary()), pa.array(c), pa.array(c * t)], names)
                kept.clear()
        for t, w in enumerate((words, known)):
            if w:
                c = pa.array(w.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), pa.array(w.keys(), pa.binary()), c, c if t else pa.array([0] * len(w), pa.int64())], names)
                w.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[list] = [[], []]
        words: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, texts in slices(batches):
            trained = batch.column(batch.schema.get_field_index("trained")).to_pylist()
            for t in (0, 1):
                mine = [x for x, y in zip(texts, trained, strict=True) if bool(y) == bool(t)]
                if not mine:
                    continue
                grams[t].append(_tally(grams_of(mine, order)[0]))
                if sum(len(x[0]) for x in grams[t]) > 1_200_000:
                    grams[t] = [_counted([x[0] for x in grams[t]], [x[1] for x in grams[t]])]
                for x in mine:
                    words[t].update(x.lower().split())
            if sum(map(len, words)) > 250_000 or sum(len(x[0]) for k in grams for x in k) > 1_500_000:
                yield from rows(grams, *words)
        yield from rows(grams, *words)

    return run


def _low(column: Column | str, symbols: int) -> Column:
    return F.col(column).bitwiseAND((1 << (WIDTH * symbols)) - 1) if isinstance(column, str) else column.bitwiseAND((1 << (WIDTH * symbols)) - 1)


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, logp: the log10 probability of every (context, symbol) of ``grams`` (gram, n, trained) under its own trained counts."""
    tries = {order: stored(grams.where("trained > 0").select("gram", F.col("trained").alias("c")), f"trie{order}")}
    for k in range(order - 1, -1, -1):
        tries[k] = stored(tries[k + 1].groupBy(_low("gram", k + 1).alias("gram")).agg(F.sum("c").alias("c")), f"trie{k}")
    contexts = {}
    for k in range(order + 1):
        ctx = F.shiftright("gram", WIDTH).alias("ctx")
        contexts[k] = tries[k].groupBy(ctx).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    # What a context leaves to its suffix: (count + kinds) and kinds of the suffix's symbols that it has not seen itself.
    left = {}
    for k in range(1, order + 1):
        long, short = tries[k], tries[k - 1].withColumnsRenamed({"gram": "g_", "c": "c_"})
        seen = long.join(short, _low("gram", k) == F.col("g_")).groupBy(F.shiftright("gram", WIDTH).alias("ctx")).agg(F.sum("c_").alias("seen"), F.count("*").alias("kinds"))
        upper = contexts[k - 1].select(F.col("ctx").alias("u_"), F.col("total").alias("t_"), F.col("kinds").alias("k_"))
        rest = F.col("k_") - F.col("kinds")
        left[k] = seen.join(upper, _low("ctx", k - 1) == F.col("u_")).select("ctx", (F.col("t_") - F.col("seen") + rest).alias("weight"), rest.alias("rest"))
    direct = grams.where("trained > 0").join(contexts[order].withColumn("gram_ctx", F.col("ctx")), F.shiftright("gram", WIDTH) == F.col("gram_ctx"))
    direct = direct.select("gram", "n", F.log10(F.col("trained") / (F.col("total") + F.col("kinds"))).alias("logp"))
    # The others escape: state = log so far, whether it is coded, and whether a longer context was seen (its exclusion holds).
    x = grams.where("trained = 0").select("gram", "n", F.lit(0.0).alias("logp"), F.lit(False).alias("done"), F.lit(False).alias("above"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("rest"))
    for k in range(order, -1, -1):
        here = contexts[k].select(F.col("ctx").alias("x_"), "total", "kinds")
        own = tries[k].select(F.col("gram").alias("o_"), "c")
        suffix = F.shiftright(_low("gram", k + 1), WIDTH)
        x = x.join(here, suffix == F.col("x_"), "left").join(own, _low("gram", k + 1) == F.col("o_"), "left")
        if k:
            x = x.join(left[k].select(F.col("ctx").alias("l_"), F.col("weight").alias("w2"), F.col("rest").alias("r2")), suffix == F.col("l_"), "left")
        weight = F.when(F.col("above"), F.col("weight")).otherwise(F.col("total") + F.col("kinds"))
        escape = F.when(F.col("above"), F.col("rest")).otherwise(F.col("kinds"))
        step = F.when(F.col("total").isNull() | (weight == 0), 0.0).when(F.col("c").isNotNull(), F.log10(F.col("c") / weight)).otherwise(F.log10(escape / weight))
        nxt = [F.coalesce(F.col("w2"), F.col("weight")).alias("weight"), F.coalesce(F.col("r2"), F.col("rest")).alias("rest")] if k else [F.coalesce("kinds", F.lit(0)).alias("weight"), F.lit(0).alias("rest")]
        x = x.select("gram", "n", F.when(F.col("done"), F.col("logp")).otherwise(F.col("logp") + step).alias("logp"), (F.col("done") | F.col("c").isNotNull()).alias("done"), (F.col("above") | F.col("total").isNotNull()).alias("above"), *nxt)
    escaped = x.select("gram", "n", F.when(F.col("done"), F.col("logp")).otherwise(F.col("logp") - F.log10(F.lit(float(SYMBOLS)) - F.col("weight"))).alias("logp"))
    return direct.union(escaped)


def frequent(table: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` rows have a count ``n`` of it or more."""
    sizes = {r["b"]: r["r"] for r in table.groupBy(F.floor(F.log2(F.greatest("n", F.lit(1)).cast("double") + 0.5)).cast("int").alias("b")).agg(F.count("*").alias("r")).collect()}
    total = 0
    for b in range(max(sizes, default=0), -1, -1):
        total += sizes.get(b, 0)
        if total > most:
            return 1 << (b + 1)
    return 1


class Slots:
    """Numbers looked up as whole arrays: open addressing, a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]
            placed = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are not held."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = self.values[slot]
        off = np.flatnonzero(held != keys)
        while len(off):
            missing = held[off] == -1
            out[off[missing]] = np.nan
            off = off[~missing]
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
            held[off] = self.keys[slot[off]]
            out[off] = self.values[slot[off]]
            off = off[held[off] != keys[off]]
        return out, np.isnan(out)


_built: dict[str, tuple] = {}


def _score(order: int, head):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            grams, logs, words, counts = head.value
            _built.clear()
            _built[name] = (Slots(grams, logs), dict(zip(words, range(len(words)), strict=True)), np.log10(counts + 1.0), counts > 0)
        slots, places, logs, positive = _built[name]
        names = ["doc_id", "n_tokens", "known", "base", "logp", "grams", "gram_n", "words", "word_n"]
        for batch, texts in slices(batches, limit=2_000_000):
            g, ends = grams_of(texts, order)
            values, missing = slots.find(g)
            at = np.flatnonzero(missing)
            values[at] = 0.0
            starts = np.concatenate([[0], ends[:-1]])
            sums = np.add.reduceat(values, starts) if len(values) else np.zeros(0)
            cut = np.searchsorted(at, np.concatenate([starts, ends[-1:]]))
            out: list[list] = [[] for _ in names]
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(texts):
                words = text.lower().split()
                where = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
                rare = Counter(words[j] for j in np.flatnonzero(where < 0).tolist())
                where = where[where >= 0]
                kinds, times = _tally(g[at[cut[i] : cut[i + 1]]])
                for column, v in zip(out, (ids[i], len(words) + 1, int(positive[where].sum()), float(logs[where].sum()), float(sums[i]), kinds.tolist(), times.tolist(), list(rare), list(rare.values())), strict=True):
                    column.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    return run


SCORED = "doc_id long, n_tokens long, known long, base double, logp double, grams array<long>, gram_n array<long>, words array<binary>, word_n array<long>"


def score(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = ORDER, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text), n_symbols."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), (crc_remainder("doc_id", modulus) != held).alias("trained"))
    counts = stored(base.mapInArrow(_count(order), "gram long, word binary, n long, trained long"), "counts")
    grams = stored(counts.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")), "grams")
    words = stored(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("c")), "words")
    lengths = stored(code_lengths(grams, order), "code-lengths")
    n_docs = base.select("trained").agg(F.coalesce(F.sum(F.col("trained").cast("long")), F.lit(0))).first()[0]
    n_words, n_kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    n, v = n_words + n_docs, n_kinds + (1 if n_docs else 0)
    denominator = log10(n + (v + 1))
    gram_least, word_least = frequent(lengths, head_grams), frequent(words, head_words)
    top_grams, top_words = lengths.where(F.col("n") >= gram_least).select("gram", "logp").toArrow(), words.where(F.col("n") >= word_least).select("word", "c").toArrow()
    head = spark.sparkContext.broadcast((top_grams.column(0).to_numpy(), top_grams.column(1).to_numpy(), top_words.column(0).to_pylist(), top_words.column(1).to_numpy()))
    scored = stored(base.select("doc_id", "text").mapInArrow(_score(order, head), SCORED).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare_grams = scored.select("rid", F.explode(F.arrays_zip("grams", "gram_n")).alias("t")).select("rid", F.col("t.grams").alias("gram"), F.col("t.gram_n").alias("times"))
    rare_grams = rare_grams.join(lengths.where(F.col("n") < gram_least).select("gram", F.col("logp").alias("l")), "gram").select("rid", (F.col("l") * F.col("times")).alias("logp"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"))
    rare_words = scored.select("rid", F.explode(F.arrays_zip("words", "word_n")).alias("t")).select("rid", F.col("t.words").alias("word"), F.col("t.word_n").alias("times"))
    rare_words = rare_words.join(words.where(F.col("n") < word_least).select("word", "c"), "word")
    rare_words = rare_words.select("rid", F.lit(0.0).alias("logp"), (F.log10(F.col("c") + 1.0) * F.col("times")).alias("base"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"))
    rare = rare_grams.union(rare_words).groupBy("rid").agg(F.sum("logp").alias("logp2"), F.sum("base").alias("base2"), F.sum("known").alias("known2"))
    out = scored.select("rid", "doc_id", "n_tokens", "known", "base", "logp").join(rare, "rid", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        (crc_remainder("doc_id", modulus) == held).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + log10(n_docs + 1) - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("logp") + F.coalesce("logp2", zero)).alias("score"),
    )


class Trie:
    """A byte-context trie in memory: counts of symbols by context; for adaptive scores and as the plain form of the model."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], Counter] = {}

    def symbols(self, text: bytes) -> list[int]:
        return [EDGE] * self.order + list(text.lower()) + [EDGE]

    def add(self, context: tuple[int, ...], symbol: int) -> None:
        for k in range(self.order + 1):
            self.counts.setdefault(context[len(context) - k :], Counter())[symbol] += 1

    def learn(self, text: bytes) -> None:
        s = self.symbols(text)
        for i in range(self.order, len(s)):
            self.add(tuple(s[i - self.order : i]), s[i])

    def log10p(self, context: tuple[int, ...], symbol: int) -> float:
        excluded: set[int] = set()
        total = 0.0
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            weight = sum(left.values()) + len(left)
            if weight:
                if symbol in left:
                    return total + log10(left[symbol] / weight)
                total += log10(len(left) / weight)
            excluded |= set(seen)
        return total - log10(SYMBOLS - len(excluded))

    def score(self, text: bytes, adaptive: bool = False) -> float:
        s = self.symbols(text)
        total = 0.0
        for i in range(self.order, len(s)):
            context = tuple(s[i - self.order : i])
            total += self.log10p(context, s[i])
            if adaptive:
                self.add(context, s[i])
        return total


def score_adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, score: each text coded by a trie that starts empty and learns from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Trie(order).score(t, adaptive=True) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
