"""Operator 4: repeated runs of lines, found by winnowing over line hashes.

The unit is a window of lines that just reaches ``min_chars`` bytes: from each
line onwards, and up to each line. A long line is a window by itself, short ones
join their neighbours. Any run of so many bytes begins and ends with a window of
its own, so runs repeat where their windows do. A window's fingerprint is its
least line hash; equal windows select the same, and only windows whose
fingerprint occurs elsewhere are compared. Matching windows that overlap extend a
match to both sides, up to the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernels
from quillgraph.llm.common import free_name, order_key, strings
from quillgraph.sources.staging import stage

#: A line ends at a line feed only.
_IN_LINE = np.array([i != 10 for i in range(256)])


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, line starts, line ends, and the first line of each row; an empty line is a line, an empty text has one."""
    raw, at = kernels.buffers(texts)
    feeds = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([at[:-1], feeds + 1]))
    # A row's end closes its last line. A feed belongs to the row in which it lies.
    row_of_feed = np.searchsorted(at, feeds, "right") - 1
    per_row = np.bincount(row_of_feed, minlength=len(texts)) + 1
    row_at = np.concatenate([[0], np.cumsum(per_row)])
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[row_at[1:] - 1] = at[1:]
    return raw, start, end, row_at


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every line and the first line of each row."""
    _, start, end, row_at = _lines(texts)
    words = kernels.tokenize(texts, _IN_LINE)
    value = np.full(len(start), np.uint64(0x5EED), np.uint64)
    full = np.flatnonzero(end > start)
    value[full] = words.hash
    return value, start, end, row_at


def window_runs(value: np.ndarray, row_at: np.ndarray, width: int, span: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: (row, first window, windows, minimum) of each run of windows that select the same fingerprint.

    Windows have ``width`` values and cover ``span`` items of their row (as many
    by default; more where a value already covers several). Equal windows have the
    same minimum, so two places that agree on a window meet at a fingerprint.
    """
    low = kernels.window_minima(value, width)
    first = np.arange(len(low))
    row = np.searchsorted(row_at, first, "right") - 1
    inside = first + (span or width) <= row_at[row + 1]
    first, row, low = first[inside], row[inside], low[inside]
    if not len(first):
        return row, first, first, low
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new)
    return row[at], first[at] - row_at[row[at]], np.diff(np.concatenate([at, [len(first)]])), low[at]


def line_windows(value: np.ndarray, size: np.ndarray, row_at: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, fingerprint, hash) of each window that just reaches ``min_chars`` bytes within its row.

    ``value`` and ``size`` are the hashes and bytes of lines. From each line the
    shortest window that begins there, and the shortest that ends there: both
    are told by their lines alone, whatever stands around them.
    """
    n = len(value)
    total = np.concatenate([[0], np.cumsum(size)])
    line = np.arange(n)
    row = np.searchsorted(row_at, line, "right") - 1
    last = np.searchsorted(total[1:], total[:-1] + min_chars, "left")
    ahead = np.flatnonzero(last < row_at[row + 1])
    first = np.searchsorted(total, total[1:] - min_chars, "right") - 1
    back = np.flatnonzero(first >= row_at[row])
    spans = kernels.distinct(np.concatenate([(ahead << 32) | last[ahead], (first[back] << 32) | back]).astype(np.uint64))
    begin, end = (spans >> np.uint64(32)).astype(np.int64), (spans & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(begin):
        return begin, begin, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    many = end - begin + 1
    low, levels = np.empty(len(begin), np.uint64), value
    for k in range(int(many.max()).bit_length()):
        own = np.flatnonzero((many >> k) == 1)  # 2**k lines at least, less than twice as many
        low[own] = np.minimum(levels[begin[own]], levels[end[own] - (1 << k) + 1])
        levels = np.minimum(levels[: -(1 << k)], levels[1 << k :]) if len(levels) > 1 << k else levels[:0]
    return begin, many, low, kernels.spans_hash(value, begin, end + 1)


def _fingerprints(min_chars: int):
    """Arrow function: (doc, same, text) to one row per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernels.slices(strings(batch, "text")):
                value, start, end, row_at = line_hashes(texts)
                first, many, low, win = line_windows(value, end - start, row_at, min_chars)
                row = np.searchsorted(row_at, first, "right") - 1
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), pa.array(win.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((first - row_at[row]).astype(np.int32)), pa.array(many.astype(np.int32))],
                    ["mark", "win", "doc", "same", "place", "lines"],
                )

    return run


def repeated_windows(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc, same, place, lines)`` of every window that occurred before, in the order of (doc, same, place).

    ``docs`` has ``doc long, same long, text string``. Windows of fingerprints that
    occur once are dropped before any comparison.
    """
    marks = stage(docs.mapInArrow(_fingerprints(min_chars), "mark long, win long, doc long, same long, place int, lines int"))
    shared = marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    met = stage(marks.join(shared, "mark").select("win", "doc", "same", "place", "lines"))
    here = F.struct("doc", "same", "place")
    firsts = met.groupBy("win", "lines").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").select("win", "lines", "first")
    return met.join(firsts, ["win", "lines"]).where(here > F.col("first")).select("doc", "same", "place", "lines")


def _without(text: pa.Array, spans: pa.Array) -> tuple[list, list]:
    out, removed = [], []
    for t, own in zip(text.to_pylist(), spans):
        if t is None or not own.is_valid:
            out.append(t)
            removed.append(0)
            continue
        lines = t.split("\n")
        place, many = (own.values.field(k).to_numpy() for k in ("place", "lines"))
        edge = np.zeros(len(lines) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + many, -1)
        keep = np.cumsum(edge[:-1]) == 0
        out.append("\n".join(x for x, k in zip(lines, keep) if k))
        removed.append(int(len(lines) - keep.sum()))
    return out, removed


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, key: str = "doc_id", text: str = "text", removed: str = "lines_removed") -> DataFrame:
    """``docs`` without the lines of runs that occurred before, and how many lines each row lost.

    A run is any number of consecutive lines, one included, with ``min_chars``
    bytes or more in all, line feeds not counted; so blank and short lines go
    with what repeats around them and never alone. Order is that of (key, hash of
    the text, line); keys that are no integers are in the order of their hash. The
    first copy of a run stays, later ones go, within a document too (overlapping
    copies included). Rows equal in key and text are one document and treated
    alike; a null key comes last. A null text stays null, a text of which every
    line goes becomes empty, and an empty table stays empty. Texts of any length
    are read whole; one text must fit a worker, with some thirty times its size
    beside it. A column already named ``removed`` is replaced, all others keep
    their values. One shuffle of the text, to bring it to its deletions.
    """
    doc, same, own_doc, own_same, spans, cut = free_name(docs, "doc_key", "same_key", "own_doc_key", "own_same_key", "spans", "cut")
    order = order_key(docs, key)
    source = docs.select(order.alias("doc"), F.xxhash64(text).alias("same"), F.col(text).alias("text")).where("text is not null")
    found = repeated_windows(source, min_chars).groupBy("doc", "same").agg(F.collect_list(F.struct("place", "lines")).alias(spans)).toDF(doc, same, spans)

    def without(texts: pa.Array, where: pa.Array) -> pa.Array:
        out, n = _without(texts, where)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int32())], ["text", "n"])

    rebuild = F.arrow_udf(without, "text string, n int")
    joined = docs.withColumns({own_doc: order, own_same: F.xxhash64(text)})
    joined = joined.join(found, (F.col(own_doc) == F.col(doc)) & (F.col(own_same) == F.col(same)), "left")
    joined = joined.withColumn(cut, rebuild(F.when(F.col(spans).isNotNull(), F.col(text)), F.col(spans)))
    columns = [F.coalesce(F.col(cut)["text"], F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns if c.lower() != removed.lower()]
    return joined.select(*columns, F.coalesce(F.col(cut)["n"], F.lit(0)).alias(removed))
