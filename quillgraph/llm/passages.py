"""Operator 9: passages that occurred before, by longest-previous-factor arrays over suffix arrays.

A passage is a run of at least ``MIN_WORDS`` words (separated by blanks, compared
byte for byte). Windows of that many words are spread over buckets by the least
hash of the shingles in them, so equal windows meet in one bucket; a bucket's
text is what its windows cover. Within buckets a suffix array puts equal
beginnings beside each other, and for each place the nearest smaller places
before and after it in suffix order give its longest earlier match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import kernels
from quillgraph.llm.common import order_key, strings
from quillgraph.llm.lines import window_runs
from quillgraph.sources.staging import stage

#: Least words of a passage, and words of a shingle.
MIN_WORDS, SHINGLE = 50, 10
#: Words in one suffix array; more buckets of a task take several arrays.
ARRAY_WORDS = 400_000


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    have = 1
    while have < depth:
        key = rank * (rank.max() + 2)
        key[: n - have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        have *= 2
        if new[-1] == n - 1:
            break
    return order


def adjacent_common(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common beginning of each suffix and the one before it in ``order``, counted to less than twice ``depth``.

    Hashes of runs of 2**k symbols let all pairs take their largest steps first.
    """
    n = len(symbols)
    a, b = order[1:], order[:-1]
    limit = n - np.maximum(a, b)
    levels = [kernels.mix(symbols.astype(np.uint64) + np.uint64(1))]
    while (1 << len(levels)) <= min(n, depth):
        step = 1 << (len(levels) - 1)
        last = levels[-1]
        levels.append(kernels.mix(last[:-step] * np.uint64(0x9E3779B97F4A7C15) + last[step:]))
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        fits = np.flatnonzero(out + step <= limit)
        same = level[a[fits] + out[fits]] == level[b[fits] + out[fits]]
        out[fits[same]] += step
    return np.concatenate([[0], out])


def previous_factors(symbols: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, length, source) of the suffixes with an earlier match of ``least`` symbols or more.

    ``place`` says which suffix is earlier; one place may appear several times
    and is no match of itself. The longest earlier match is with the nearest
    entry of a smaller place on either side in suffix order, as all others share
    no more; one stack finds both in linear time. Only stretches of the order
    whose neighbours share ``least`` symbols can hold a match. Lengths are
    counted to less than four times ``least``. The source is the suffix of the
    least place that shares ``least`` symbols, so the first copy of those.
    """
    if len(symbols) < 2:
        return (np.zeros(0, np.int64),) * 3
    depth = 1 << (least - 1).bit_length()
    order = suffix_array(symbols, depth)
    common = adjacent_common(symbols, order, depth)
    linked = common >= least
    inside = linked.copy()
    inside[:-1] |= linked[1:]
    order, common = order[inside], np.where(linked, common, 0)[inside]
    length = np.zeros(len(order), np.int64)
    stack: list[list[int]] = []  # entry, its place, common beginning with the one below
    for k, (at, shared) in enumerate(zip(place[order].tolist(), common.tolist())):
        while stack and stack[-1][1] >= at:
            top, where, below = stack.pop()
            if where > at and shared > length[top]:  # next smaller place
                length[top] = shared
            shared = min(shared, below)
        if not stack:
            shared = 0
        elif shared > length[k]:  # previous smaller place
            length[k] = shared
        stack.append([k, at, shared])
    found = length >= least
    stretch = np.cumsum(common == 0) - 1
    lowest = np.minimum.reduceat(place[order], np.flatnonzero(common == 0))
    first = np.flatnonzero(place[order] == lowest[stretch])
    head = np.empty(len(lowest), np.int64)
    head[stretch[first]] = first
    return order[found], length[found], order[head[stretch[found]]]


def _marks(min_words: int, shingle: int):
    """Arrow function: (doc, same, text) to one row (mark, doc, same, first, windows) per run of windows with one least shingle.

    ``windows`` is below zero where that shingle occurs more than once in the
    run, so that windows of it may equal each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernels.slices(strings(batch, "text")):
                words = kernels.tokenize(texts, kernels.NON_SPACE)
                value, width = kernels.grams(words.hash, shingle), min_words - shingle + 1
                row, first, count, low = window_runs(value, words.row_at, width, min_words)
                span = count + width - 1
                ends = np.cumsum(span)
                place = np.repeat(words.row_at[row] + first - ends + span, span) + np.arange(ends[-1] if len(ends) else 0)
                least = np.concatenate([[0], np.cumsum(value[place] == np.repeat(low, span))])
                count = np.where(least[ends] - least[ends - span] > 1, -count, count)
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["mark", "doc", "same", "first", "windows"],
                )

    return run


_MARK = "mark long, doc long, same long, first int, windows int"


def _shared(hot: int):
    """Arrow function on all rows of some marks: those whose mark occurs at several places, one of equal texts; ``hot``: at more than so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        mark, doc, same, first, windows = (t.column(i).to_numpy() for i in range(5))
        order = np.argsort(mark, kind="stable")
        _, start, size = np.unique(mark[order], return_index=True, return_counts=True)
        order = order[np.repeat(size > 1, size) | (windows[order] < 0)]
        # Of equal texts the first one stands for all.
        order = order[np.lexsort((doc[order], first[order], same[order], mark[order]))]
        m, s, f = mark[order], same[order], first[order]
        if len(order):
            order = order[np.concatenate([[True], (m[1:] != m[:-1]) | (s[1:] != s[:-1]) | (f[1:] != f[:-1])])]
        _, inverse, size = np.unique(mark[order], return_inverse=True, return_counts=True)
        n = size[inverse] if len(order) else size
        keep = (n > 1) | (windows[order] < 0)
        order, n, windows = order[keep], n[keep], np.abs(windows)
        yield pa.RecordBatch.from_arrays([*[pa.array(x[order]) for x in (mark, doc, same, first, windows)], pa.array(n > hot)], ["mark", "doc", "same", "first", "windows", "hot"])

    return run


def _contexts(min_words: int):
    """Arrow function: (doc, same, text, marks) to one row per mark with the words that its windows cover, as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, texts in kernels.slices(strings(whole, "text")):
                batch = whole.slice(at, len(texts))
                words = kernels.tokenize(texts, kernels.NON_SPACE)
                value = (words.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
                marks = batch.column(3)
                row = np.repeat(np.arange(len(texts)), marks.value_lengths().to_numpy())
                flat = marks.flatten()
                first, windows = flat.field("first").to_numpy(), flat.field("windows").to_numpy()
                size = windows.astype(np.int64) + min_words - 1
                offsets = np.concatenate([[0], np.cumsum(size)])
                place = np.repeat(words.row_at[row] + first - offsets[:-1], size) + np.arange(offsets[-1])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("mark"), batch.column(0).take(take), batch.column(1).take(take), flat.field("first"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value[place])), flat.field("hot")],
                    ["mark", "doc", "same", "first", "words", "hot"],
                )

    return run


def _repeats(min_words: int, array_words: int):
    """Arrow function on all contexts of some marks: spans (doc, same, begin, stop, source) of words that occurred before."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        doc, same, first = (t.column(c).to_numpy() for c in ("doc", "same", "first"))
        order = np.lexsort((first, same, doc))
        doc, same, first = doc[order], same[order], first[order]
        words = t.column("words").combine_chunks().take(pa.array(order))
        size = words.value_lengths().to_numpy().astype(np.int64)
        # Sentinels, each its own symbol, end the contexts.
        text_rank = np.unique(words.flatten().to_numpy(), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(size + 1)])
        symbols = np.empty(at[-1], np.int64)
        ends = at[1:] - 1
        body = np.ones(at[-1], bool)
        body[ends] = False
        symbols[body] = text_rank
        symbols[ends] = (text_rank.max() + 1 if len(text_rank) else 0) + np.arange(len(ends))
        text_no = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (same[1:] != same[:-1]))])
        context = np.repeat(np.arange(len(size)), size + 1)
        word = first[context] + np.arange(at[-1]) - at[context]
        suffix, length, source = previous_factors(symbols, (text_no[context] << 32) | word, min_words)
        where, begin = context[suffix], word[suffix]
        stop, origin = begin + length, doc[context[source]]
        # Spans of one text that touch and have one source are one.
        key = np.lexsort((begin, origin, text_no[where]))
        where, begin, stop, origin = where[key], begin[key], stop[key], origin[key]
        if len(key):
            group = np.concatenate([[0], np.cumsum((text_no[where][1:] != text_no[where][:-1]) | (origin[1:] != origin[:-1]))])
            reach = np.maximum.accumulate(stop + (group << 32)) - (group << 32)
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (begin[1:] > reach[:-1])])
            head = np.flatnonzero(new)
            where, begin, origin = where[head], begin[head], origin[head]
            stop = reach[np.concatenate([head[1:] - 1, [len(reach) - 1]])]
        return pa.RecordBatch.from_arrays([pa.array(doc[where]), pa.array(same[where]), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(origin)], ["doc", "same", "begin", "stop", "source"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("mark")
        mark = t.column("mark").to_numpy()
        size = np.cumsum(pa.compute.list_value_length(t.column("words")).to_numpy())
        heads = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        at = 0
        while at < len(heads):
            begun = size[heads[at] - 1] if heads[at] else 0
            stop = at + 1
            while stop < len(heads) and size[heads[stop] - 1] - begun < array_words:
                stop += 1
            yield spans(t.slice(heads[at], (heads[stop] if stop < len(heads) else len(mark)) - heads[at]))
            at = stop

    return run


_SPAN = "doc long, same long, begin int, stop int, source long"


def _hot_repeats(contexts: DataFrame, min_words: int) -> DataFrame:
    """The same spans for marks of very many places: every window of words is a row, grouped by mark and hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(4)[i].values.to_numpy().astype(np.int64).view(np.uint64)
                win = kernels.grams(kernels.mix(words), min_words)
                take = pa.array(np.full(len(win), i))
                place = np.arange(len(win)) + batch.column(3)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(win.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take), pa.array(place.astype(np.int32))], ["mark", "win", "doc", "same", "place"])

    each = contexts.select("mark", "doc", "same", "first", "words").mapInArrow(windows, "mark long, win long, doc long, same long, place int")
    here = F.struct("doc", "same", "place")
    firsts = each.groupBy("mark", "win").agg(F.min(here).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = each.join(firsts, ["mark", "win"]).where(here > F.col("head"))
    return later.select("doc", "same", F.col("place").alias("begin"), (F.col("place") + min_words).alias("stop"), F.col("head.doc").alias("source"))


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans (and the blanks after each), and how many words went."""
    out: list[str] = []
    gone: list[int] = []
    for text, own in zip(texts, spans):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        words = kernels.tokenize(pa.array([raw.decode()]), kernels.NON_SPACE)
        drop = np.zeros(len(words.start) + 1, np.int64)
        for span in own.as_py():
            drop[span["begin"]] += 1
            drop[min(span["stop"], len(words.start))] -= 1
        lost = np.cumsum(drop)[:-1] > 0
        edge = np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))
        parts, at = [], 0
        for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            parts.append(raw[at : words.start[b]])
            at = words.start[e] if e < len(words.start) else len(raw)
        parts.append(raw[at:])
        out.append(b"".join(parts).decode())
        gone.append(int(lost.sum()))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(gone, pa.int32())], ["text", "n"])


def drop_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text", hot: int = 20_000, array_words: int = ARRAY_WORDS) -> DataFrame:
    """``(doc_id, text, words_removed, first_doc_ids)`` of the documents that lose a passage.

    A run of ``min_words`` words or more that occurred before, in the order of
    (key, hash of the text, word), is removed, its first copy stays; copies that
    overlap within one text count as well, so a period that repeats stays once.
    ``first_doc_ids`` are the documents that hold the first copy of each run of
    ``min_words`` words that goes. Words are
    runs of bytes other than blanks; case and punctuation matter, the blanks
    between words don't. Null, empty and short texts never appear, nor does
    anything of an empty table; rows with a null key are last in order and appear
    with a null id. Keys that are no integers are in the order of their hash. Rows
    equal in key and text are one document. Texts of any length are read whole;
    one text must fit a worker, with some forty times its size beside it. Marks of
    more than ``hot`` places are compared window by window in a distributed
    aggregation in place of one suffix array.
    """
    last = F.lit((1 << 63) - 1)
    source = docs.select(order_key(docs, key).alias("doc"), F.xxhash64(text).alias("same"), F.col(text).alias("text")).where("text is not null")
    marks = source.mapInArrow(_marks(min_words, shingle), _MARK)
    shared = marks.repartition("mark").mapInArrow(_shared(hot), _MARK + ", hot boolean")
    wanted = shared.groupBy("doc", "same").agg(F.collect_list(F.struct("mark", "first", "windows", "hot")).alias("marks"))
    suspects = stage(source.join(wanted, ["doc", "same"]).select("doc", "same", "text", "marks").dropDuplicates(["doc", "same"]))
    contexts = suspects.mapInArrow(_contexts(min_words), "mark long, doc long, same long, first int, words array<int>, hot boolean")
    if suspects.where(F.exists("marks", lambda m: m["hot"])).limit(1).count():
        contexts = stage(contexts)
        spans = contexts.where("not hot").drop("hot").repartition("mark").mapInArrow(_repeats(min_words, array_words), _SPAN).union(_hot_repeats(contexts.where("hot"), min_words))
    else:
        spans = contexts.drop("hot").repartition("mark").mapInArrow(_repeats(min_words, array_words), _SPAN)
    per_text = spans.groupBy("doc", "same").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"), F.array_sort(F.collect_set("source")).alias("first_doc_ids"))
    cut = F.arrow_udf(_typed(_cut), "text string, n int")
    changed = suspects.join(per_text, ["doc", "same"]).withColumn("cut", cut("text", "spans")).select("doc", F.col("cut.text").alias("text"), F.col("cut.n").alias("words_removed"), "first_doc_ids")
    # A text equal to an earlier document's goes as a whole.
    words = F.size(F.filter(F.split("text", "[\\x00-\\x20]+"), lambda w: w != ""))
    lead = source.groupBy("same").agg(F.min("doc").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = source.join(lead, "same").where("doc > lead").withColumn("words", words).where(F.col("words") >= min_words)
    whole = copies.dropDuplicates(["doc", "same"]).select("doc", F.lit("").alias("text"), F.col("words").alias("words_removed"), F.array("lead").alias("first_doc_ids"))
    out = changed.unionByName(whole).select(F.when(F.col("doc") != last, F.col("doc")).alias("doc_id"), "text", "words_removed", "first_doc_ids")
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return out
    # Back from the hashes of keys to the keys.
    out = stage(out)
    names = docs.select(order_key(docs, key).alias("k"), F.col(key).alias("name")).where("name is not null").distinct()
    firsts = out.select("doc_id", F.xxhash64("text").alias("t"), F.explode("first_doc_ids").alias("k")).join(names, "k").groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("name")).alias("first_doc_ids"))
    own = out.join(names, out["doc_id"] == names["k"], "left").select("doc_id", F.col("name"), "text", "words_removed", F.xxhash64("text").alias("t"))
    same = own["doc_id"].eqNullSafe(firsts["doc_id"]) & (own["t"] == firsts["t"])
    return own.join(firsts, same, "left").select(own["name"].alias("doc_id"), "text", "words_removed", "first_doc_ids")


def _typed(f):
    f.__annotations__ = {k: pa.Array for k in ("texts", "spans", "return")}
    return f
