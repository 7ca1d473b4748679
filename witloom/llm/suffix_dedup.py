"""Removal of long repeats by a Burrows-Wheeler transform with threshold-bounded interval expansion.

Core (``long_repeats``): the suffixes of a set of strings are sorted, and starting from the interval of the empty string
all intervals are extended backward by one symbol at a time, breadth first. A boundary that an extension meets for the
first time gets the current length as its common prefix, so prefixes come in increasing order and the search stops at the
minimum length: boundaries without a value then separate suffixes that share at least that much.

At scale no task can sort all suffixes, so Spark first brings together what can repeat. In every window of ``length``
bytes the places whose 32-byte hash is least are anchors; a repeat of the window repeats the anchor. An anchor's core is
its first ``core`` bytes; with up to ``length - core`` bytes either side it has a context that holds all windows with that
anchor. Then:

1. cores that occur once are dropped (counted by a map-side aggregate);
2. contexts that occur whole more than once are repeats as a whole (the same); one of each stays as a partner for others;
3. contexts that share a core but differ are grouped by core. A group's core becomes one symbol, each side is cut
   where it stops agreeing with any other member, and the group's strings go through the transform.

A group above ``group_limit`` contexts is split before step 3: its windows are halved by their place about the core, each
half's common part joins the core, and steps 1 and 2 run again, down to single windows if need be. So neither a common
passage nor a group of copies is one task, and no pairs are listed. Texts are told apart by a 96-bit hash and their length;
equal texts are one key with a count.

Defined results: null text is the empty text; texts below ``length`` bytes keep everything; equal rows are separate
documents whose texts repeat each other; an empty table gives no rows; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, spread_join, spread_left_join, stored, text_of

LENGTH = 200
CORE = 100
ORDERED = 32  # bytes whose hash orders the places of a window
GROUP_LIMIT = 20_000
#: Symbols that go through one transform, unless one group has more.
BUNDLE = 1_500_000
KEY = ["k1", "k2", "kn"]
KEY_TYPES = "k1 long, k2 int, kn int"


# --- the transform ---------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``s`` and each suffix's place in it. ``s`` ends in a symbol that occurs once."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    take = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(take):
        key <<= bits
        key[: n - j] |= s[j:]
    h = take
    while True:
        order = np.argsort(key)
        ordered = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order, rank
        key = rank * n
        key[: n - h] += rank[h:]
        h *= 2


def long_repeats(s: np.ndarray, length: int) -> np.ndarray:
    """Places of ``s`` whose next ``length`` symbols occur at another place of ``s`` too.

    Symbols that occur once (such as a separator after each string) match nothing, so repeats do not cross them.
    """
    n = len(s)
    order, rank = suffix_array(s)
    lf = rank[order - 1]  # row of the suffix one symbol longer; the first suffix wraps round to the last symbol's
    row = np.empty(n, np.int64)
    row[lf] = np.arange(n)
    symbol = s[order - 1]
    # Rows before and after with the same preceding symbol.
    same = symbol[row[1:]] == symbol[row[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[row[1:][same]] = row[:-1][same]
    after[row[:-1][same]] = row[1:][same]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        first = at[before[at] < np.repeat(low, size)]
        last = at[after[at] >= np.repeat(high, size)]
        # One interval for each symbol before each interval; they are disjoint, so sorted bounds belong together.
        low, high = np.sort(lf[first]), np.sort(lf[last]) + 1
        new = unset[high]
        low, high = low[new], high[new]
        unset[high] = False
        if not len(low):
            break
    run = unset[:n]
    member = run.copy()
    member[:-1] |= run[1:]
    return np.sort(order[member])


def repeated_bytes(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text a mask of the bytes inside strings of ``length`` bytes that start at another place as well."""
    if not texts:
        return []
    m = len(texts)
    parts = []
    for i, t in enumerate(texts):
        parts += [np.frombuffer(t, np.uint8).astype(np.int64) + m, np.array([i])]
    found = long_repeats(np.concatenate(parts), length)
    out, start = [], 0
    for t in texts:
        marks = np.zeros(len(t) + 1, np.int64)
        mine = found[(found >= start) & (found < start + len(t))] - start
        np.add.at(marks, mine, 1)
        np.add.at(marks, mine + length, -1)
        out.append(np.cumsum(marks)[:-1] > 0)
        start += len(t) + 1
    return out


# --- anchors ---------------------------------------------------------------------------------------------------------


def _slide(v: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        v = pick(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return pick(v[:-rest], v[rest:]) if rest else v


def anchor_places(texts: list[bytes], length: int, core: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts end to end, their bounds, and the anchors' places in them."""
    joined = b"".join(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    if len(joined) < length:
        return joined, bounds, np.zeros(0, np.int64)
    h = np.frombuffer(joined, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    span = 1
    while span < ORDERED:
        h = h[:-span] * np.uint32(0xC2B2AE3D) + h[span:]
        h ^= h >> np.uint32(13)
        span *= 2
    h = h * np.uint32(0x27D4EB2F) + np.uint32(1)
    h ^= h >> np.uint32(16)
    h |= np.uint32(1)  # 0 is below every hash
    width = length - core + 1
    h = h[: len(joined) - core + 1] if ORDERED <= core else h
    least = _slide(h, width, np.minimum)
    # Windows that reach over the end of a text are none.
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        least[max(start, end - length + 1) : end] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(len(h) - len(least), np.uint32)])
    best = _slide(padded, width, np.maximum)
    return joined, bounds, np.flatnonzero(best == h)


def _anchors(length: int, core: int):
    side = length - core

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch, texts in slices(batches, limit=400_000):
            joined, bounds, at = anchor_places(texts, length, core)
            cut = np.searchsorted(at, bounds)
            cores = np.fromiter((digest(joined[p : p + core]) for p in at.tolist()), np.uint64, len(at))
            start, end = np.repeat(bounds[:-1], np.diff(cut)), np.repeat(bounds[1:], np.diff(cut))
            low, high = np.maximum(start, at - side), np.minimum(end, at + length)
            whole = np.fromiter((digest(joined[a:b], seed=p - a) for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)), np.uint64, len(at))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v)) for v in ((at - start).astype(np.int32), cores.view(np.int64), whole.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in KEY], *lists], [*KEY, "at", "core", "whole"])

    return run


def _contexts(length: int, core: int):
    """Bytes before (nearest first) and after each core asked for; equal texts of a task only once."""
    side = length - core

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch, texts in slices(batches):
            out: list[list] = [[] for _ in range(9)]
            keys = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in KEY], strict=True))
            wanted = batch.column(batch.schema.get_field_index("wanted")).to_pylist()
            for key, text, asked in zip(keys, texts, wanted, strict=True):
                if key in seen:
                    continue
                seen.add(key)
                for w in asked:
                    p = w["at"]
                    for column, v in zip(out, (w["core"], *key, p, text[max(0, p - side) : p][::-1], text[p + core : p + length], w["alone"], side + 1), strict=True):
                        column.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["core", *KEY, "at", "before", "behind", "alone", "width"])

    return run


CONTEXT = f"core long, {KEY_TYPES}, at int, before binary, behind binary, alone boolean, width int"


# --- groups of contexts ----------------------------------------------------------------------------------------------


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes plus one, filled with zeros; their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lengths = np.minimum(np.diff(offsets), width)
    out = np.zeros((len(column), width), np.uint8)
    rows = np.repeat(np.arange(len(column)), lengths)
    cols = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, cols] = data[offsets[:-1][rows] + cols] + np.uint8(1)
    return out, lengths


def _agreement(group: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row the most leading bytes that it shares with another row of its group."""
    n, width = rows.shape
    out = np.zeros(n, np.int64)
    if n < 2 or not width:
        return out
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{width + 4}").ravel().view(f"S{width + 4}"), kind="stable")
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(lengths[a], lengths[b])) * (group[a] == group[b])
    np.maximum.at(out, a, shared)
    np.maximum.at(out, b, shared)
    return out


def repeats_in_groups(group: np.ndarray, before: tuple[np.ndarray, np.ndarray], behind: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bytes before the core) of each window of a group that another member of the group has too.

    ``width`` windows lie about a core: one with ``o`` bytes before it has ``width - 1 - o`` behind it.
    """
    left, right = _agreement(group, *before), _agreement(group, *behind)
    rows = np.flatnonzero(left + right >= width - 1)
    if len(rows) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, kinds = left[rows], right[rows], np.unique(group[rows], return_inverse=True)
    m, cores = len(rows), len(kinds[0])
    sizes = left + right + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    s = np.empty(int(ends[-1]), np.int64)
    s[ends - 1] = np.arange(m)  # separators occur once
    s[starts + left] = m + kinds[1]
    for (data, _), count, sign in ((before, left, -1), (behind, right, 1)):
        which = np.repeat(np.arange(m), count)
        k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        s[(starts + left)[which] + sign * (k + 1)] = data[rows[which], k].astype(np.int64) + m + cores
    # Of both sides at most width - 1 symbols each, so a string of ``width`` symbols holds the core.
    found = long_repeats(s, width)
    which = np.searchsorted(ends, found, side="right")
    return rows[which], left[which] - (found - starts[which])


def _groups(length: int):
    """Rows of CONTEXT of a partition, sorted by width and core: spans of repeats."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        get = lambda c: t.column(c).chunk(0)
        core, width = get("core").to_numpy(), t.column("width")[0].as_py()
        group = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
        rows, o = repeats_in_groups(group, _padded(get("before"), width - 1), _padded(get("behind"), width - 1), width)
        mine = get("alone").to_numpy(zero_copy_only=False)[rows]
        rows, first = rows[mine], get("at").to_numpy()[rows[mine]] - o[mine]
        order = np.lexsort([first, rows])
        rows, first = rows[order], first[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (first[1:] > first[:-1] + length)]) if len(rows) else np.zeros(0, bool)
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(rows) - 1]]) if len(rows) else np.zeros(0, int)
        keys = [get(k).take(pa.array(rows[new])) for k in KEY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(first[new].astype(np.int32)), pa.array((first[last] + length).astype(np.int32))], [*KEY, "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(ended: bool) -> Iterator[pa.RecordBatch]:
            """Solves the whole groups held; the last one may go on in the next batch."""
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            core, width = t.column("core").to_numpy(), t.column("width").to_numpy()
            wider = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1]])).tolist()
            upto = t.num_rows if ended else int(np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))[-1])
            for low, high in zip(wider, [*wider[1:], t.num_rows], strict=True):
                if min(high, upto) > low:
                    yield solve(t.slice(low, min(high, upto) - low))
            held = t.slice(upto).to_batches()
            size = (t.num_rows - upto) * int(width[-1])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows * batch.column(batch.schema.get_field_index("width"))[0].as_py()
                if size >= BUNDLE:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


SPAN = f"{KEY_TYPES}, low int, high int"


def _halves(rows: DataFrame) -> DataFrame:
    """The windows about each core in two halves, as contexts of their own.

    In the first half, with at most h bytes before the core, the core grows behind; in the second it grows in front.
    """
    h = F.floor((F.col("width") - 1) / 2).cast("int")
    rest = F.col("width") - 1 - h
    part = lambda c, a, n: F.substring(F.col(c), a + 1, n)
    zero = F.lit(0)
    first = rows.where(F.octet_length("behind") >= rest).select(
        F.xxhash64("core", "width", zero, part("behind", zero, rest)).alias("core"), *KEY, "at", part("before", zero, h).alias("before"), part("behind", rest, h).alias("behind"), "alone", (h + 1).alias("width")
    )
    second = rows.where(F.octet_length("before") > h).select(
        F.xxhash64("core", "width", F.lit(1), part("before", zero, h + 1)).alias("core"), *KEY, (F.col("at") - (h + 1)).alias("at"), part("before", h + 1, rest - 1).alias("before"), part("behind", zero, rest - 1).alias("behind"), "alone", rest.alias("width")
    )
    return first.unionByName(second)


def _solve_groups(contexts: DataFrame, length: int, limit: int) -> list[DataFrame]:
    """Spans of repeats (SPAN) among different contexts of the same core; groups above ``limit`` are split first."""
    out = []
    while True:
        large = stored(contexts.groupBy("core").count().where(F.col("count") > limit).select("core"), "large-groups")
        some = large.limit(1).count() > 0
        small = contexts.join(large, "core", "left_anti") if some else contexts
        out.append(small.repartition("core").sortWithinPartitions("width", "core", *KEY, "at").mapInArrow(_groups(length), SPAN))
        if not some:
            return out
        half = stored(_halves(contexts.join(large, "core", "left_semi")), "half-contexts")
        context = ["core", "width", "before", "behind"]
        counts = half.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "at", "alone")).alias("one"))
        counts = stored(counts, "half-counts")
        kinds = counts.groupBy("core").count().where("count > 1").select("core")
        same = half.where("alone").join(counts.where("n > 1").select(*context), context, "left_semi")
        low = F.col("at") - F.octet_length("before")
        high = F.col("at") + (length + 1 - F.col("width")) + F.octet_length("behind")
        out.append(same.select(*KEY, low.alias("low"), high.alias("high")).where(F.col("high") - F.col("low") >= length))
        rest = counts.where("width > 1").join(kinds, "core", "left_semi").select(*context, "n", "one.*")
        contexts = stored(rest.select("core", *KEY, "at", "before", "behind", (F.col("alone") & (F.col("n") == 1)).alias("alone"), "width"), "contexts")


# --- the operator ----------------------------------------------------------------------------------------------------


def keyed_texts(docs: DataFrame, *keep: str) -> DataFrame:
    text = text_of()
    return docs.select(*keep, F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), F.octet_length(text).alias("kn"), text.cast("binary").alias("text"))


def repeat_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, limit: int = GROUP_LIMIT) -> DataFrame:
    """k1, k2, kn, whole (places of anchors whose context repeats as a whole), spans (low, high): one row for each text with repeats."""
    if not ORDERED <= core < length:
        raise ValueError("the core must be shorter than the length, and hold the ordered bytes")
    keyed = keyed_texts(docs)
    anchors = stored(keyed.where(F.col("kn") >= length).mapInArrow(_anchors(length, core), f"{KEY_TYPES}, at array<int>, core array<long>, whole array<long>"), "anchors")
    cores = anchors.select(F.explode("core").alias("core")).groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    cores = stored(cores, "cores")
    places = anchors.select(*KEY, F.explode(F.arrays_zip("at", "core", "whole")).alias("t")).select("t.core", "t.whole", *KEY, "t.at")
    places = stored(spread_join(places, cores, ["core"], [*KEY, "at"]), "places")
    drop(anchors)
    drop(cores)
    kinds = places.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "at")).alias("one"))
    kinds = stored(kinds, "kinds")
    mixed = stored(kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    asked = spread_join(kinds.withColumnRenamed("n", "copies"), mixed, ["core"], ["whole"]).groupBy("one.k1", "one.k2", "one.kn").agg(F.collect_list(F.struct("core", "one.at", (F.col("copies") == 1).alias("alone"))).alias("wanted"), F.max("copies").alias("n"))
    asked = stored(asked, "asked")
    # A text stands in at most as many rows as its contexts; copies of a frequent one are dealt out, and each task takes one of them.
    dealt = spread_join(keyed.withColumn("at_", F.monotonically_increasing_id()), asked, KEY, ["at_"], sized=True)
    contexts = stored(dealt.select(*KEY, "text", "wanted").mapInArrow(_contexts(length, core), CONTEXT), "contexts")
    found = _solve_groups(contexts, length, limit)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = stored(spans, "spans")
    whole = spread_join(places, kinds.where("n > 1").select("core", "whole", "n"), ["core", "whole"], [*KEY, "at"]).groupBy(*KEY).agg(F.collect_set("at").alias("whole"))
    whole = stored(whole, "whole")
    drop(places)
    drop(kinds)
    drop(asked)
    drop(contexts)
    spans = spans.groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    return whole.join(spans, KEY, "full_outer")


def _apply(length: int, core: int, kept: list[str], as_text: bool):
    side = length - core

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            out: list[list] = [[], [], [], []]
            for text, whole, spans in zip(texts, column("whole").to_pylist(), column("spans").to_pylist(), strict=True):
                n = len(text)
                pairs = [(max(0, p - side), min(n, p + length)) for p in whole or []] + [(s["low"], s["high"]) for s in spans or []]
                runs: list[list[int]] = []
                for low, high in sorted(pairs):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                parts, at = [], 0
                for low, high in runs:
                    parts.append(text[at:low])
                    at = high
                rest = b"".join([*parts, text[at:]])
                shown = rest.decode("utf-8", "ignore") if as_text else hashlib.sha256(rest).hexdigest()
                for values, v in zip(out, (n, n - len(rest), len(runs), shown), strict=True):
                    values.append(v)
            types = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*map(column, kept), *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], [*kept, "n_bytes", "n_removed", "n_spans", "rest"])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, core: int = CORE, limit: int = GROUP_LIMIT, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id (or the columns ``keep``), n_bytes, n_removed, n_spans, kept_sha256; with ``as_text`` the rest itself as
    ``text`` (bytes of characters cut in two are left out)."""
    kept = keep or ["doc_id"]
    spans = stored(repeat_spans(docs, length, core, limit), "repeats")
    keyed = spread_left_join(keyed_texts(docs, *kept).withColumn("at_", F.monotonically_increasing_id()), spans, KEY, ["at_"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "n_bytes long, n_removed long, n_spans long, rest string"])
    out = keyed.select(*kept, "text", "whole", "spans").mapInArrow(_apply(length, core, kept, as_text), schema)
    return out.withColumnRenamed("rest", "text" if as_text else "kept_sha256")
