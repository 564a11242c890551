"""Operator 7: benchmark passages in documents, with edits, by CGK embedding and bit-sampling LSH.

The random walk of Chakraborty, Goldenberg and Koucky reads a string of words:
step j writes the word under the pointer and moves on by a random bit of (j,
word). Walks over strings with few edits between them fall into step again, so
edit distance becomes Hamming distance of what they write. Locality-sensitive
hashing then samples places of the walks, several times over with other walks
and places; where a window of an item and one of a document agree on a sample,
the exact edit distance of the item and the document around there decides.

How many walks an item needs for the target recall is found by simulation of
edits at its limit. Walks of short items rarely agree there (at 30 % of the words:
0.1 to 0.8 of the items of 8 to 30 words are found, whatever the window). Such
items are cut into one piece more than they may have edits, so that a piece is
left as it is, and found with certainty.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import kernels
from quillgraph.llm.common import strings

#: Words of a window.
WINDOW = 10
#: Least share of items with as many edits as they may have that their walks must find, by simulation.
RECALL = 0.95
#: What stands for the number of a walk where pieces are sought; candidates looked at together.
SEED, CANDIDATES = -1, 1 << 14
#: Walks at most, steps of a walk, and places sampled of each; items that so many walks don't find are sought by pieces.
REPEATS, STEPS, SAMPLES = 4, 16, 9
#: An item is found where at most this share of its words must be edited.
MAX_EDITS = 0.3
#: Text of benchmark items held by a task at a time; a larger benchmark takes more scans.
SLICE_BYTES = 16 << 20
_BLANK = kernels.mix(np.arange(1, REPEATS + 1, dtype=np.uint64) << np.uint64(32))


def _walk_keys(hashes: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """For the window of ``size`` words that begins at each word: a key of the sampled places of its walk.

    A walk that leaves its window writes blanks. The random bit of step j is bit
    j of the word's hash, mixed anew for each repeat.
    """
    steps = STEPS * size // WINDOW
    places = set(np.random.default_rng([steps, repeat, 7]).choice(steps, min(SAMPLES, steps), replace=False).tolist())
    own = kernels.mix(hashes ^ _BLANK[repeat])
    padded = np.concatenate([own, np.zeros(size + 1, np.uint64)])
    n = len(hashes)
    start = np.arange(n, dtype=np.int32)
    at, limit = start.copy(), start + np.int32(size)
    key = np.full(n, _BLANK[repeat], np.uint64)
    for j in range(max(places) + 1):
        word = padded[at]
        if j in places:
            if j >= size:
                word = np.where(at < limit, word, np.uint64(0))
            key ^= word
            key *= np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
        word >>= np.uint64(j)
        at += (word & np.uint64(1)).astype(np.int32)
        if j >= size:
            np.minimum(at, limit, out=at)
    return kernels.mix(key)


def _pieces(size: int, edits: int) -> np.ndarray:
    """Bounds of ``edits + 1`` pieces of ``size`` words, as even as can be; so many edits leave one piece as it is."""
    n = min(edits + 1, size)
    return np.arange(n + 1) * size // n


@functools.cache
def walks_needed(size: int, edits: int, recall: float = RECALL) -> int:
    """Least number of walks by which the share ``recall`` of items of ``size`` words with so many edits are found; 0: more than REPEATS.

    Items of random words are edited by replacements at random places, which walks
    miss more often than words left out or put in.
    """
    if size < WINDOW:
        return 0
    rng = np.random.default_rng([size, edits])
    trials = 400
    words = iter(rng.integers(0, 1 << 63, trials * (2 * size + 3 * WINDOW), dtype=np.uint64))
    items = np.array([next(words) for _ in range(trials * size)], np.uint64).reshape(trials, size)
    texts = []
    for t in range(trials):
        text = items[t].tolist()
        for at in rng.choice(size, edits, replace=False).tolist():
            text[at] = next(words)
        texts.append(text + [next(words) for _ in range(2 * WINDOW)])
    whole = np.concatenate([np.array(t, np.uint64) for t in texts])
    # Windows meet within their trial only, and an item's own windows end with it.
    trial_of, place = np.repeat(np.arange(trials), size), np.tile(np.arange(size), trials)
    inside = np.flatnonzero(place <= size - WINDOW)
    other = kernels.mix(np.repeat(np.arange(trials), [len(t) for t in texts]).astype(np.uint64))
    seen, found = np.zeros(trials, bool), np.zeros(REPEATS)
    for repeat in range(REPEATS):
        own = _walk_keys(items.ravel(), WINDOW, repeat)[inside] ^ kernels.mix(trial_of[inside].astype(np.uint64))
        seen[trial_of[inside][np.isin(own, _walk_keys(whole, WINDOW, repeat) ^ other)]] = True
        found[repeat] = seen.mean()
    # Two standard errors above, so that the share itself is reached.
    enough = np.flatnonzero(found >= recall + 2 * math.sqrt(recall * (1 - recall) / trials))
    return int(enough[0]) + 1 if len(enough) else 0


def _bit_set(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A set of the upper ``bits`` bits of hashes, a bit for each value."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out


def _in_bit_set(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _member_hash(words: np.ndarray, item: np.ndarray | int) -> np.ndarray:
    return kernels.mix(words ^ kernels.mix(np.atleast_1d(item).astype(np.uint64)))


class Index:
    """Items of a slice of the benchmark: their words, the seeds of short ones, and the keys of all windows of the others."""

    def __init__(self, ids: list, texts: pa.Array, max_edits: float):
        words = kernels.tokenize(pc.utf8_lower(texts)) if len(texts) else None
        self.ids = ids
        self.words = [words.hash[words.row_at[i] : words.row_at[i + 1]] for i in range(len(ids))] if words else []
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.array([int(max_edits * len(w)) for w in self.words], np.int64)
        groups: dict[tuple[int, int], list[tuple[np.ndarray, int, np.ndarray]]] = {}
        member = [np.zeros(0, np.uint64)]
        for i, w in enumerate(self.words):
            # Beyond 64 words the share of edits, not their number, decides.
            size = min(len(w), 64)
            walks = walks_needed(size, -(-int(self.slack[i]) * size // len(w))) if len(w) else 0
            if walks:
                for repeat in range(walks):
                    k = _walk_keys(w, WINDOW, repeat)[: len(w) - WINDOW + 1]
                    groups.setdefault((WINDOW, repeat), []).append((k, i, np.arange(len(k))))
            elif len(w):
                member.append(_member_hash(w, i))
                bounds = _pieces(len(w), int(self.slack[i]))
                for size in np.unique(np.diff(bounds)).tolist():
                    at = bounds[:-1][np.diff(bounds) == size]
                    groups.setdefault((size, SEED), []).append((kernels.grams(w, size)[at], i, at))
        # The words of each short item; other words may seem to belong to it.
        member = np.concatenate(member)
        self.member_bits = max(16, int(math.ceil(math.log2(len(member) + 1))) + 4)
        self.member = _bit_set(member, self.member_bits)
        self.tables = []
        for (size, repeat), parts in sorted(groups.items()):
            key = np.concatenate([k for k, _, _ in parts])
            item = np.concatenate([np.full(len(k), i, np.int32) for k, i, _ in parts])
            offset = np.concatenate([o for _, _, o in parts]).astype(np.int32)
            order = np.argsort(key, kind="stable")
            key = key[order]
            bits = max(16, int(math.ceil(math.log2(len(key) + 1))) + 6)
            self.tables.append((size, repeat, bits, _bit_set(key, bits), key, item[order], offset[order]))

    def size_in_bytes(self) -> int:
        """What a task holds of the index, without the words of items."""
        return len(self.member) + sum(t[3].nbytes + t[4].nbytes + t[5].nbytes + t[6].nbytes for t in self.tables)

    def _holds(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether there are enough words of each item around where it may begin; a word that lacks is an edit at least."""
        lo = np.maximum(low, begin - self.slack[item])
        span = np.minimum(high, begin + self.size[item] + self.slack[item]) - lo
        ends = np.cumsum(span)
        place = np.repeat(lo - ends + span, span) + np.arange(ends[-1] if len(ends) else 0)
        known = _in_bit_set(self.member, _member_hash(hashes[place], np.repeat(item, span)), self.member_bits)
        total = np.concatenate([[0], np.cumsum(known)])
        return total[ends] - total[ends - span] >= (self.size - self.slack)[item]

    def found(self, hashes: np.ndarray, row_at: np.ndarray) -> list[tuple[int, object, int]]:
        """(row, item id, edits) of the items in rows of words, with the least number of edits."""
        if not len(hashes):
            return []
        found = [np.zeros((3, 0), np.int64)]
        for size, repeat, bits, filled, key, item, offset in self.tables:
            own = kernels.grams(hashes, size) if repeat == SEED else _walk_keys(hashes, size, repeat)
            maybe = np.flatnonzero(_in_bit_set(filled, own, bits))
            left, right = np.searchsorted(key, own[maybe], "left"), np.searchsorted(key, own[maybe], "right")
            many = np.cumsum(right - left)
            done = 0
            while done < len(maybe):
                stop = max(done + 1, int(np.searchsorted(many, (many[done - 1] if done else 0) + CANDIDATES, "right")))
                n = (right - left)[done:stop]
                ends = np.cumsum(n)
                k = np.repeat(left[done:stop] - ends + n, n) + np.arange(ends[-1])
                at = np.repeat(maybe[done:stop], n)
                row = np.searchsorted(row_at, at, "right") - 1
                who, begin = item[k], at - offset[k]
                if repeat == SEED:
                    held = self._holds(hashes, row_at[row], row_at[row + 1], who, begin)
                    row, who, begin = row[held], who[held], begin[held]
                found.append(np.stack([row, who, begin]))
                done = stop
        row, who, begin = np.concatenate(found, axis=1)
        order = np.lexsort((begin, who, row))
        row, who, begin = row[order], who[order], begin[order]
        # Candidates of one item that begin within its length of each other are one region.
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (who[1:] != who[:-1]) | (begin[1:] - begin[:-1] > self.size[who[1:]])])) if len(row) else order
        last = begin[np.concatenate([new[1:], [len(row)]]) - 1] if len(row) else order
        best: dict[tuple[int, int], int] = {}
        for r, i, first, final in zip(row[new].tolist(), who[new].tolist(), begin[new].tolist(), last.tolist()):
            word, slack = self.words[i], int(self.slack[i])
            part = hashes[max(int(row_at[r]), first - slack) : min(int(row_at[r + 1]), final + len(word) + slack)]
            # A word that the region lacks is an edit at least.
            if len(word) - np.isin(word, part).sum() > slack:
                continue
            edits = best_match(word, part)
            if edits <= slack and edits < best.get((r, i), slack + 1):
                best[r, i] = edits
        return [(row, self.ids[i], edits) for (row, i), edits in sorted(best.items())]


def best_match(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance (words put in, left out or replaced) between ``item`` and any part of ``text``."""
    m = len(item)
    rows = np.arange(m + 1)
    column = rows.copy()
    least = m
    for word in text:
        step = np.empty(m + 1, np.int64)
        step[0] = 0
        step[1:] = np.minimum(column[:-1] + (item != word), column[1:] + 1)
        # Deletions run down the column: the least of step[k] + (row - k).
        column = np.minimum.accumulate(step - rows) + rows
        least = min(least, int(column[m]))
    return least


def _slices(benchmark: DataFrame, item: str, text: str, limit: int, max_edits: float) -> Iterator[Index]:
    """Indexes of about ``limit`` bytes of items each; an item is in one of them."""
    items = benchmark.select(F.col(item).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / limit))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        t = part.orderBy("id", "text").toArrow()
        yield Index(t.column("id").to_pylist(), t.column("text").combine_chunks(), max_edits)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", max_edits: float = MAX_EDITS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(doc_id, item_id, edits)``: items that occur in documents with at most ``max_edits`` of their words edited.

    Words are compared in lower case and without punctuation. An item without
    words is never found, a null item id or text is left out; items may share
    an id, then the fewest edits count. Null, empty and wordless documents have
    no items; rows with a null key are left out, and rows that share a key count
    as one document; keys and ids keep their types. Without documents or items
    there are no rows. A benchmark beyond ``slice_bytes`` of text is searched in
    several scans, each with a part of the items; a task then holds an index of
    at most some thirty times ``slice_bytes``. A text of any length is searched
    whole, with some fifty times its size beside it in a worker.
    """
    found = None
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema[item].dataType.simpleString()}, edits int"
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    for index in _slices(benchmark, item, "text", slice_bytes, max_edits):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, object, int]] = []
                for at, rows in kernels.slices(strings(batch, "text")):
                    words = kernels.tokenize(pc.utf8_lower(rows))
                    out += [(at + r, i, e) for r, i, e in shared.value.found(words.hash, words.row_at)]
                rows, items, edits = list(zip(*out)) or [[], [], []]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(items), pa.array(edits, pa.int32())], ["doc_id", "item_id", "edits"])

        part = source.mapInArrow(search, kinds)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", max_edits: float = MAX_EDITS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``docs`` without any benchmark item, columns unchanged; a narrow scan for each slice of the benchmark.

    Each row is judged by its own text, whatever its key; null, empty and
    wordless texts stay, repeated rows are judged alike, and a table without rows
    stays empty, as does a corpus whose benchmark is.
    """
    for index in _slices(benchmark, item, "text", slice_bytes, max_edits):
        docs = docs.where(_without_items(docs.sparkSession.sparkContext.broadcast(index))(F.col(text)))
    return docs


def _without_items(shared: Broadcast):
    """Arrow UDF: whether a text has none of the items of a broadcast index."""

    def clean(texts: pa.Array) -> pa.Array:
        keep = np.ones(len(texts), bool)
        for at, rows in kernels.slices(texts.fill_null("")):
            words = kernels.tokenize(pc.utf8_lower(rows))
            for r, _, _ in shared.value.found(words.hash, words.row_at):
                keep[at + r] = False
        return pa.array(keep)

    clean.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(clean, T.BooleanType())
