"""Operator 10: token counts by a byte-pair tokenizer compiled to a deterministic transducer.

The tokenizer cuts a text into pieces by its pattern and merges the bytes of each
piece. A piece's tokens are the only sequence in which every two neighbours
stay apart when merged alone, so the last token of a prefix follows from the
last tokens of shorter prefixes. The transducer's state after a prefix is the
node of the vocabulary's Aho-Corasick automaton, with the last token and the
relative count at each place where a token may yet begin. Its transitions are
annotated with the tokens they add (below zero where tokens merge), so that the
sum over a text is its count. States are compiled when first reached.

Texts are cut into chunks that advance in lock step. A chunk maps the state at
its beginning to one at its end and a count; from the first piece that begins
in it on, the map no longer depends on the state, so a map is a head of bytes,
a count and an end. Composed with any map before it, such a map has its own end:
so the prefix scan over the maps is settled at once for every chunk but those
that lie whole within a piece, and all heads are read in lock step, each from the
end of what comes before. Chunks within one long piece follow one another, all
such pieces side by side.

The driver compiles the states of some texts and broadcasts them with the
automaton, as a cache that all workers begin with.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
import uuid
from array import array
from collections.abc import Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernels

#: Bytes of a chunk, and compiled states after which the table begins anew.
CHUNK, MAX_STATES = 1024, 400_000

_OTHER, _LETTER, _NUMBER, _BLANK = 0, 1, 2, 3
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            out[i] = {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
        out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
        _classes = out
    return _classes


def piece_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets, and whether a piece begins at each byte.

    The pattern: contractions ('s 't 're 've 'm 'll 'd), then runs of letters,
    of numbers and of other characters, each with one space before it; then
    blanks, of which the last stays with what follows.
    """
    raw, at = kernels.buffers(texts)
    starts = np.zeros(len(raw), bool)
    if not len(raw):
        return raw, at, starts
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = _class_table()[code]
    new_row = np.zeros(n + 1, bool)
    new_row[np.searchsorted(first, at)] = True
    ends = new_row[1:]  # last character of its row
    new_row = new_row[:-1]
    before = np.concatenate([[_OTHER], kind[:-1]])
    after = np.concatenate([kind[1:], [_OTHER]])
    prior = np.concatenate([[0], code[:-1]])
    blank = kind == _BLANK
    begin = new_row | (kind != before)
    # A space before something else that isn't blank takes the start from it.
    lends = (code == 32) & ~ends & (after != _BLANK)
    takes = np.concatenate([[False], lends[:-1]])
    begin[takes] = False
    # The last of several blanks stays with what follows, or alone.
    begin |= blank & ~ends & (after != _BLANK)
    quote = np.flatnonzero((code == 39) & (new_row | ((before != _OTHER) & (prior != 32))))
    if len(quote):
        row_end = np.flatnonzero(ends) + 1
        room = row_end[np.searchsorted(row_end, quote, "right")] - quote
        one = code[np.minimum(quote + 1, n - 1)]
        two = code[np.minimum(quote + 2, n - 1)]
        short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        double = (room > 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        begin[quote[short] + 1] = False
        begin[quote[double] + 1] = False
        stop = np.concatenate([quote[short] + 2, quote[double] + 3])
        stop = stop[stop < n]
        # A space that follows lends or begins as it did; anything else begins.
        begin[stop] = True
    starts[first[begin]] = True
    return raw, at, starts


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines "base64 rank"."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Transducer:
    """Deterministic transducer of byte-pair merging within one piece, compiled as far as it was needed."""

    def __init__(self, ranks: Mapping[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = dict(ranks), max_states
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.goto: list[dict[int, int]] = [{}]
        self.depth = [0]
        self.token = [-1]  # rank of the token that ends at a node
        self.bytes: dict[int, bytes] = {rank: t for t, rank in self.ranks.items()}
        for t, rank in self.ranks.items():
            if self.merge(t) != [t]:
                continue  # never the result of merges
            node = 0
            for b in t:
                if b not in self.goto[node]:
                    self.goto[node][b] = len(self.goto)
                    self.goto.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = self.goto[node][b]
            self.token[node] = rank
        self.link = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for node in queue:
            for b, child in self.goto[node].items():
                f = self.link[node]
                while f and b not in self.goto[f]:
                    f = self.link[f]
                self.link[child] = self.goto[f].get(b, 0)
                queue.append(child)
        self.apart: dict[tuple[int, int], bool] = {}
        self.states: list[bytes] = []
        self.base = 0
        self.flush()

    def flush(self) -> None:
        """Forgets all states but those kept."""
        base = self.base
        old = np.flatnonzero((self.keys >= 0) & (self.keys >> 8 < base) & (self.step < base)) if base > 1 else np.zeros(0, np.int64)
        flat, step, adds = (x[old] for x in (self.keys, self.step, self.adds)) if base > 1 else (np.zeros(0, np.int64),) * 3
        self.states = self.states[:base] if base > 1 else []
        self.number: dict[bytes, int] = {s: i for i, s in enumerate(self.states)}
        self.apart = {}
        bits = max(18, (2 * len(flat)).bit_length() + 1)
        self.shift = 64 - bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.step = np.zeros(1 << bits, np.int32)
        self.adds = np.zeros(1 << bits, np.int16)
        self.filled = len(flat)
        if base > 1:
            self.put(flat, step, adds)
        else:
            self.intern(0, [-1, 0])

    def keep(self) -> None:
        """Keeps the present states when others are forgotten."""
        self.base = len(self.states)

    def merge(self, piece: bytes) -> list[bytes]:
        """Tokens of a piece by its definition: the leftmost pair of least rank is merged first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def intern(self, node: int, chain: list[int]) -> int:
        state = array("i", [node, *chain]).tobytes()
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def place(self, flat: np.ndarray) -> np.ndarray:
        """Where the transitions state * 256 + byte are in the open-addressed table, or would be."""
        at = ((flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)
        found = self.keys[at]
        open_ = np.flatnonzero((found != flat) & (found >= 0))
        mask = len(self.keys) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            open_ = open_[(found != flat[open_]) & (found >= 0)]
        return at

    def compile(self, flats: np.ndarray) -> None:
        """Adds the transitions state * 256 + byte, distinct and new."""
        made = [self.transition(f >> 8, f & 255) for f in flats.tolist()]
        if 2 * (self.filled + len(made)) > len(self.keys):
            keys, step, adds = self.keys, self.step, self.adds
            while 2 * (self.filled + len(made)) > len(keys):
                keys = np.full(2 * len(keys), -1, np.int64)
            self.shift = 64 - int(len(keys)).bit_length() + 1
            old = np.flatnonzero(self.keys >= 0)
            flat = self.keys[old]
            self.keys, self.step, self.adds = keys, np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int16)
            self.put(flat, step[old], adds[old])
        self.put(flats, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))
        self.filled += len(made)

    def put(self, flat: np.ndarray, step: np.ndarray, adds: np.ndarray) -> None:
        """Stores transitions; of those that meet at one free place one stays at a time."""
        rest = np.arange(len(flat))
        while len(rest):
            at = self.place(flat[rest])
            self.keys[at] = flat[rest]
            won = self.keys[at] == flat[rest]
            self.step[at[won]], self.adds[at[won]] = step[rest[won]], adds[rest[won]]
            rest = rest[~won]

    def transition(self, number: int, byte: int) -> tuple[int, int]:
        """(target, tokens added) of a state on a byte."""
        node, *open_ = array("i", self.states[number])
        # Last token and count (less the present one) by distance from here.
        known, at = {}, node
        for k in range(0, len(open_), 2):
            known[self.depth[at]] = (open_[k], open_[k + 1])
            at = self.link[at]
        now = node
        while now and byte not in self.goto[now]:
            now = self.link[now]
        now = self.goto[now].get(byte, 0)
        at = now
        while True:
            t = self.token[at]
            if t >= 0:
                last, count = known[self.depth[at] - 1]
                if last < 0:
                    break
                fits = self.apart.get((last, t))
                if fits is None:
                    pair = [self.bytes[last], self.bytes[t]]
                    fits = self.apart[last, t] = self.merge(pair[0] + pair[1]) == pair
                if fits:
                    break
            at = self.link[at]
        added = count + 1
        chain, at = [], now
        while True:
            d = self.depth[at]
            chain += (t, 0) if d == 0 else (known[d - 1][0], known[d - 1][1] - added)
            if not at:
                break
            at = self.link[at]
        return self.intern(now, chain), added

    def run(self, state: np.ndarray, data: np.ndarray, reset: np.ndarray, out: np.ndarray) -> np.ndarray:
        """States after lanes read the rows of ``data``; ``out`` gets the annotation of each transition.

        ``reset`` marks the bytes at which pieces begin.
        """
        for k in range(len(data)):
            flat = np.where(reset[k], 0, state) * 256 + data[k]
            at = self.place(flat)
            new = self.keys[at] < 0
            if new.any():
                self.compile(np.unique(flat[new]))
                at = self.place(flat)
            out[k] = self.adds[at]
            state = self.step[at].astype(np.int64)
        return state

    def read(self, state: np.ndarray, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, tokens added) after lanes read bytes of a piece from ``begin`` on, in lock step."""
        order = np.argsort(-length, kind="stable")
        now, at0, size = state[order].copy(), begin[order], length[order]
        total = np.zeros(len(order), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, "left"))  # lanes longer than k
            flat = now[:live] * 256 + raw[at0[:live] + k]
            at = self.place(flat)
            new = self.keys[at] < 0
            if new.any():
                self.compile(np.unique(flat[new]))
                at = self.place(flat)
            total[:live] += self.adds[at]
            now[:live] = self.step[at]
        out, added = np.empty_like(now), np.empty_like(total)
        out[order], added[order] = now, total
        return out, added

    def counts(self, texts: pa.Array, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text; 0 for null and empty ones."""
        raw, at, starts = piece_starts(texts)
        n = len(raw)
        if not n:
            return np.zeros(len(texts), np.int64)
        if len(self.states) > self.max_states:
            self.flush()
        lanes = -(-n // chunk)
        begins = np.flatnonzero(starts)
        # The body of a chunk begins with its first piece, its head belongs to a piece of an earlier one.
        edges = np.arange(lanes) * chunk
        k = np.searchsorted(begins, edges)
        body = np.where(k < len(begins), begins[np.minimum(k, len(begins) - 1)], n)
        body = np.minimum(body, np.minimum(edges + chunk, n))
        ends = np.minimum(edges + chunk, n)
        width = lanes * chunk
        data = np.zeros(width, np.uint8)
        data[:n] = raw
        marks = np.ones(width, bool)
        marks[:n] = starts
        grid = np.ascontiguousarray(data.reshape(lanes, chunk).T)
        resets = np.ascontiguousarray(marks.reshape(lanes, chunk).T)
        added = np.zeros((chunk, lanes), np.int16)
        # Bodies: heads are read as if pieces began at each byte, and what they add is set right below.
        inside = np.arange(chunk)[:, None] < (body - edges)[None, :]
        resets |= inside
        state = self.run(np.zeros(lanes, np.int64), grid, resets, added)
        added = added.T.astype(np.int64).ravel()[:n]
        total = np.concatenate([[0], np.cumsum(np.where(inside.T.ravel()[:n], 0, added))])
        # Composition: each head is read from the end of the chunk before, once that is known.
        extra = np.zeros(lanes, np.int64)
        heads = np.flatnonzero(body > edges)
        whole = body == ends
        known = ~whole
        while len(heads):
            ready = known[heads - 1] | (heads == 0)
            own = heads[ready]
            after, extra[own] = self.read(state[own - 1], raw, edges[own], body[own] - edges[own])
            inner = own[whole[own]]
            state[inner], known[inner] = after[whole[own]], True
            heads = heads[~ready]
        # A row begins a piece, so a head lies in one row: that of its first byte.
        out = np.diff(total[at])
        heads = np.flatnonzero(extra)
        np.add.at(out, np.searchsorted(at, edges[heads], "right") - 1, extra[heads])
        return out


_made: dict[str, Transducer] = {}


@functools.cache
def _automaton(vocabulary: str) -> Transducer:
    """The automaton of a rank file, made once in a driver."""
    return Transducer(read_ranks(vocabulary))


#: Texts of more characters aren't taken to compile states from; all are counted whole.
_WARM_CHARS = 16_384


def warmed(docs: DataFrame, vocabulary: str, text: str, rows: int, limit: int) -> Transducer:
    """A transducer with the states that up to ``rows`` rows and some ``limit`` bytes of text need; all others are compiled where they are met.

    The rows are the first that a few partitions give, collected as a limit at the
    root of a plan is: partition after partition until there are enough.
    """
    machine = _automaton(vocabulary)
    some = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= _WARM_CHARS)).limit(rows).collect()
    left = limit
    for at in range(0, len(some), 64):
        batch = pa.array([r["t"] for r in some[at : at + 64]], pa.string())
        if left > 0:
            machine.counts(batch)
            left -= batch.nbytes
    machine.keep()
    return machine


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", warm_rows: int = 1_500, warm_bytes: int = 3 << 20) -> DataFrame:
    """``docs`` with the number of tokens of each text; a narrow projection without shuffle.

    ``vocabulary`` is the path of a rank file, read by the driver; the pattern is
    that of byte-level vocabularies of 50k tokens, and special tokens in a text
    are ordinary text. The automaton is broadcast (some 50 MB, whatever the
    corpus) with the states that ``warm_rows`` rows or ``warm_bytes`` of text need:
    a cache, on which no count depends. A null text has null tokens, an empty one
    0; repeated rows are counted alike, and a table without rows stays empty. A
    text of any length is counted whole; it must fit a worker, with some fifty
    times its size beside it. A column already named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(warmed(docs, vocabulary, text, warm_rows, warm_bytes))
    key = uuid.uuid4().hex

    def count(texts: pa.Array) -> pa.Array:
        if key not in _made:
            _made.clear()
            _made[key] = shared.value
        parts = [_made[key].counts(rows) for _, rows in kernels.slices(texts)]
        n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.array(n, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(count, "long")(F.col(text)))
