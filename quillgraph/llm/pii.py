"""Operator 8: personal data by a linear-chain conditional random field over word shapes.

A token is a run of letters and digits or any other character but blanks. Its
shape says of what characters it is made and how long it is, and whether a blank
stands before it; features are the shapes around a token, alone and in pairs.
The field is trained from a small labelled table and decoded by Viterbi. Most
tokens are so surely outside that no run of other labels could hold them; what
lies between them is decoded on its own, with the same result as over the whole
text.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import kernels

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET"]
#: Outside, and of each kind the first token of a piece and any later one.
LABELS = ["O", *[f"{place}-{kind}" for kind in KINDS for place in "BI"]]
#: Sentences of the labelled table and steps of training.
SENTENCES, STEPS = 1600, 120

_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 lower, 2 upper, 3 digit, 4 of a longer character, 5 other
for _i in range(33, 256):
    _c = chr(_i)
    _KIND[_i] = 4 if _i >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5
_LENGTHS = np.array([0, 1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 8, 8, 8, 8, 8, *[9] * 8, *[10] * 8, *[11] * 32, 12])
#: Shapes: seven kinds of words by length, numbers by exact length up to 20, and each ASCII mark.
_WORDS, _NUMBERS, _MARKS = 0, 6 * 13, 6 * 13 + 22
SHAPES = _MARKS + 128
SYMBOLS = 2 * SHAPES + 1  # with and without a blank before; beyond the text
_END = SYMBOLS - 1


def shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and of each token the first byte, the end, and the symbol; and the first token of each row."""
    raw, at = kernels.buffers(texts)
    n = len(raw)
    kind = _KIND[raw]
    wordy = (kind > 0) & (kind < 5)
    begin = kind > 0
    begin[1:] &= ~(wordy[1:] & wordy[:-1])
    cut = at[:-1][at[:-1] < n]
    begin[cut] = kind[cut] > 0
    start = np.flatnonzero(begin)
    if not len(start):
        return raw, start, start, start, np.zeros(len(texts) + 1, np.int64)
    blank_next = np.ones(n, bool)
    blank_next[:-1] = begin[1:] | (kind[1:] == 0)
    blank_next[cut[cut > 0] - 1] = True
    end = np.flatnonzero(blank_next & (kind > 0)) + 1
    length = end - start
    word = wordy[start]

    def has(k: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])[np.stack([start, end])], axis=0)[0]

    digits, upper, lower = has(3), has(2), has(1)
    hexes = (raw >= 97) & (raw <= 102) | (raw >= 48) & (raw <= 57)
    hexed = np.diff(np.concatenate([[0], np.cumsum(hexes, dtype=np.int64)])[np.stack([start, end])], axis=0)[0] == length
    size = _LENGTHS[np.minimum(length, len(_LENGTHS) - 1)]
    # Kinds of words: plain, capital first, capitals, with digits, lower-case hexadecimal with digits, capitals with digits.
    plain = np.where((upper == 1) & (kind[start] == 2) & (length > 1), 1, np.where((upper > 0) & (upper == length), 2, 0))
    mixed = np.where(hexed, 4, np.where(upper + digits == length, 5, 3))
    shape = np.where(digits > 0, mixed, plain) * 13 + size
    shape = np.where(word & (digits == length), _NUMBERS + np.minimum(length, 21), shape)
    shape = np.where(word, shape, _MARKS + (raw[start] & 127))
    before = np.zeros(len(start), bool)
    before[1:] = start[1:] == end[:-1]
    row_at = np.searchsorted(start, at)
    first = row_at[:-1][row_at[:-1] < len(start)]
    before[first] = False
    return raw, start, end, shape + np.where(before, SHAPES, 0), row_at


#: Places of the symbols of each feature, relative to the token.
FEATURES: list[tuple[int, ...]] = [(0,), (-1,), (1,), (-2,), (2,), (3,), (0, 1), (-1, 0)]
_PAIR = 1 << 16  # pairs of symbols share so many weights


def feature_ids(symbols: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Index of each token's weights for each feature; a row of _END stands before and after each text."""
    n = len(symbols)
    row = np.repeat(np.arange(len(row_at) - 1), np.diff(row_at))
    low, high = row_at[:-1][row], row_at[1:][row]
    place = np.arange(n)
    out = np.empty((len(FEATURES), n), np.int64)
    seen: dict[int, np.ndarray] = {}
    for by in range(-2, 4):
        at = place + by
        inside = (at >= low) & (at < high)
        seen[by] = np.where(inside, symbols[np.clip(at, 0, max(n - 1, 0))], _END)
    for i, f in enumerate(FEATURES):
        out[i] = seen[f[0]] if len(f) == 1 else (seen[f[0]] * 40503 + seen[f[1]] * 2654435761) % _PAIR
    return out


def training_table(n: int = SENTENCES, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with (first byte, end, label) of the personal data in them, made from patterns by a seeded generator."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word(least: int = 1, most: int = 11) -> str:
        w = "".join(rng.choice(letters + "éüñß" * (rng.random() < 0.1)) for _ in range(rng.randint(least, most)))
        return w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.04 else w

    def ascii_word(least: int = 2, most: int = 9) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))

    def email() -> str:
        name = rng.choice(["{a}", "{a}.{b}", "{a}_{b}", "{a}.{d}", "{a}{d}", "{a}-{b}", "{a}+{b}", "{b}.{d}"]).format(a=ascii_word(1), b=ascii_word(1) if rng.random() < 0.9 else word(2), d=digits(rng.randint(1, 4)))
        host = rng.choice(["{a}", "{a}{d}", "{a}.{b}", "{a}{d}.{b}", "{a}-{b}"]).format(a=ascii_word(2), b=ascii_word(2), d=digits(rng.randint(1, 2)))
        return f"{name}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'edu'])}"

    def phone() -> str:
        return rng.choice(["+{c} ({a}) {b}-{e}", "({a}) {b}-{e}", "+{c} {a} {b} {e}", "{a}-{b}-{e}", "+{c}-{a}-{b}-{e}", "+{c}{a}{b}{e}", "{a}.{b}.{e}", "+{c} {a}-{b}-{e}"]).format(c=rng.choice(["1", "44", "49", "33", "34"]), a=digits(3), b=digits(3), e=digits(4))

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        parts = [digits(4) for _ in range(4)]
        return rng.choice(["", "", "", " ", "-"]).join(parts)

    def secret() -> str:
        return rng.choice([lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64]))), lambda: "".join(rng.choice("0123456789" + letters + letters.upper()) for _ in range(rng.randint(24, 44)))])()

    makers = {"EMAIL": email, "PHONE": phone, "IP": ip, "CARD": card, "SSN": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "IBAN": lambda: rng.choice(["DE", "FR", "ES", "GB"]) + digits(rng.choice([18, 20, 20, 22])), "SECRET": secret}

    def outside() -> str:
        return rng.choice(
            [
                lambda: digits(rng.randint(1, 8)), lambda: f"{digits(1)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"${digits(3)}.{digits(2)}",
                lambda: f"{digits(2)},{digits(3)}", lambda: f"{digits(2)},{digits(3)},{digits(3)}", lambda: f"https://www.{ascii_word()}.com/{ascii_word()}/{digits(3)}?page={digits(1)}&ref={ascii_word(1, 3)}", lambda: f"www.{ascii_word()}.org", lambda: f"@{ascii_word()}", lambda: f"{ascii_word()}-{ascii_word()}-{ascii_word()}", lambda: f"{ascii_word()}.{ascii_word()}.{ascii_word()}()",
                lambda: f"{digits(1)}-{digits(1)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"#{digits(3)}", lambda: f"[{digits(2)}]", lambda: f"({digits(4)})", lambda: f"+{digits(2)}%", lambda: f"v{digits(1)}.{digits(2)}", lambda: f"{ascii_word(1, 3)}{digits(2)}", lambda: f"{ascii_word()} = {digits(2)}", lambda: f'{ascii_word()} = "{ascii_word()}"', lambda: "".join(rng.choice("0123456789abcdef") for _ in range(7)),
                lambda: rng.choice(["***", "###", "$$$", "%%%", "&&&", "!!!", "...", "---"]), lambda: f"{ascii_word().upper()}{digits(1)}", lambda: f"{digits(3)} {digits(4)}", lambda: f"{digits(1)} {digits(2)} {digits(2)}", lambda: f"{word()} @ {word()}", lambda: f"({word()}) {word()}", lambda: f"({digits(3)}) {word()}", lambda: f"({digits(2)}) {digits(2)}", lambda: ascii_word(20, 40),
                lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)), lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(2)}.{digits(1)}.{digits(4)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}",
            ]
        )()

    out = []
    for _ in range(n):
        text, spans = "", []
        noise = rng.choice(["###", "***", "$$$", "%%%", "&&&"]) if rng.random() < 0.12 else ""
        count = rng.randint(3, 12)
        lead = rng.randrange(count)
        for k in range(count):
            if text:
                text += rng.choice([" ", " ", " ", " ", " ", "\n"])
            roll = rng.random()
            if (k == lead and rng.random() < 0.75) or roll < 0.04:
                label = rng.choice(KINDS)
                quote = label == "SECRET" and rng.random() < 0.7
                before = rng.choice(['token = "', 'key="', "password: '", '"', "api_key: "]) if quote else rng.choice(["", "", "", "", "(", "<", '"', "mail: ", "tel.: "])
                after = {'"': '"', "'": "'", "(": ")", "<": ">"}.get(before[-1:], "") + (rng.choice([",", ".", ";", "!", "?"]) if rng.random() < 0.25 else "")
                text += before
                for again in range(1 if rng.random() < 0.8 or quote else rng.randint(2, 3)):
                    # Several of a kind in a row, with nothing but a blank or a comma between them.
                    text += rng.choice([" ", " ", ", ", "\n"]) if again else ""
                    value = makers[label]()
                    begin = len(text.encode())
                    spans.append((begin, begin + len(value.encode()), label))
                    text += value
                text += after
            elif roll < 0.2:
                text += outside()
            else:
                text += word() + (rng.choice([",", ".", "!", ":"]) if rng.random() < 0.15 else "")
            text += noise if noise and rng.random() < 0.8 else ""
        out.append((text, spans))
    return out


def train_on(table: DataFrame, max_rows: int = 20_000, seed: int = 5) -> Field:
    """The field of a labelled table ``(text, spans)`` as :func:`labelled_table` gives it.

    At most ``max_rows`` rows, drawn by a seeded hash of the text, go to the
    driver, which trains on all of them at once. Rows without a text are left out.
    """
    rows = table.where("text is not null").orderBy(F.xxhash64(F.lit(seed), "text"), "text").limit(max_rows).collect()
    return train([(r["text"], [(s["begin"], s["stop"], s["label"]) for s in r["spans"] or []]) for r in rows])


def labelled_table(spark: SparkSession, n: int = SENTENCES, seed: int = 5) -> DataFrame:
    """:func:`training_table` as ``(text, spans)``; a table of one's own may stand in for it."""
    return spark.createDataFrame(training_table(n, seed), "text string, spans array<struct<begin:int, stop:int, label:string>>")


class Field:
    """Weights of features (one row each) and of label pairs, with the label before the first and after the last outside."""

    def __init__(self, weights: list[np.ndarray], moves: np.ndarray):
        self.weights = [w.astype(np.float32) for w in weights]
        self.moves = moves.astype(np.float32)
        # What a run of other labels can gain over O by its transitions, at its ends and for each step.
        self.enter, self.inner, self.leave = (float(x.max() - moves[0, 0]) for x in (moves[0, 1:], moves[1:, 1:], moves[1:, 0]))
        self.sure = [(w[:, :1] - w[:, 1:]).min(axis=1) for w in self.weights]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return sum(w[ids[i]] for i, w in enumerate(self.weights))

    def undecided(self, ids: np.ndarray) -> np.ndarray:
        """Tokens that a run of other labels might hold and be likelier than O; all the others are O for certain.

        The scores of O exceed those of any other label by a margin of at least the
        sum of each feature's least one. A token's best run is the best that ends
        there and the best that begins there, both by a scan of maxima.
        """
        gain = self.inner - sum(s[ids[i]].astype(np.float64) for i, s in enumerate(self.sure))

        def runs(gain: np.ndarray) -> np.ndarray:
            total = np.cumsum(gain)
            return total - np.minimum.accumulate(total - gain)

        best = runs(gain) + runs(gain[::-1])[::-1] - gain
        return np.flatnonzero(best + self.enter + self.leave - self.inner > -1e-3)

    def decode(self, ids: np.ndarray, row_at: np.ndarray) -> np.ndarray:
        """The likeliest labels of each row's tokens."""
        n = ids.shape[1]
        label = np.zeros(n, np.int8)
        open_ = self.undecided(ids)
        if not len(open_):
            return label
        row = np.searchsorted(row_at, open_, "right")
        new = np.concatenate([[True], (open_[1:] != open_[:-1] + 1) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(open_)]]))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        scores = self.scores(ids[:, open_])
        back = np.zeros((len(open_), len(LABELS)), np.int8)
        best = scores[first] + self.moves[0]
        live = len(first)
        last = np.empty((len(first), len(LABELS)), np.float32)
        last[:live] = best
        for k in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -k, "left"))  # sequences longer than k
            at = first[:live] + k
            through = last[:live, :, None] + self.moves[None]
            back[at] = through.argmax(axis=1)
            last[:live] = through.max(axis=1) + scores[at]
        now = (last + self.moves[:, 0]).argmax(axis=1).astype(np.int8)
        for k in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -k, "left"))
            at = first[:live] + k
            label[open_[at]] = now[:live]
            now[:live] = back[at, now[:live]]
        return label


def train(table: Sequence[tuple[str, Sequence[tuple[int, int, str]]]], steps: int = STEPS, rate: float = 1.0, decay: float = 1e-4) -> Field:
    """Greatest conditional likelihood by full-batch AdaGrad, with forward and backward sums over all sentences at once."""
    table = sorted(table, key=lambda x: -len(x[0]))
    texts = pa.array([t for t, _ in table], pa.string())
    *_, row_at = shapes(texts)
    # Longest first, so that the sentences that go on at a place are the first ones.
    table = [table[i] for i in np.argsort(-np.diff(row_at), kind="stable")]
    texts = pa.array([t for t, _ in table], pa.string())
    _, start, end, symbol, row_at = shapes(texts)
    ids = feature_ids(symbol, row_at)
    byte_at = kernels.buffers(texts)[1]
    truth = np.zeros(len(start), np.int64)
    for r, (_, spans) in enumerate(table):
        for begin, stop, label in spans:
            own = slice(row_at[r], row_at[r + 1])
            at = np.flatnonzero((start[own] - byte_at[r] >= begin) & (end[own] - byte_at[r] <= stop)) + row_at[r]
            truth[at] = LABELS.index(f"I-{label}")
            truth[at[:1]] = LABELS.index(f"B-{label}")
    rows, width, m = len(table), int(np.diff(row_at).max()), len(LABELS)
    row = np.repeat(np.arange(rows), np.diff(row_at))
    col = np.arange(len(start)) - row_at[row]
    size = np.diff(row_at)
    used = [np.unique(ids[i], return_inverse=True) for i in range(len(FEATURES))]
    weights = [np.zeros((len(u), m)) for u, _ in used]
    moves = np.zeros((m, m))
    squares = [np.full_like(w, 1e-6) for w in [*weights, moves]]
    before, after = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    before[1:], after[:-1] = truth[:-1], truth[1:]
    before[row_at[:-1][size > 0]], after[row_at[1:][size > 0] - 1] = 0, 0
    seen = np.zeros((m, m))
    np.add.at(seen, (before, truth), 1)
    last_of = np.flatnonzero(col == size[row] - 1)
    np.add.at(seen, (truth[last_of], np.zeros(len(last_of), np.int64)), 1)
    goal = np.eye(m)[truth]
    live = [int((size > k).sum()) for k in range(width)]
    for _ in range(steps):
        score = sum(w[at] for w, (_, at) in zip(weights, used))
        grid = np.zeros((width, rows, m))
        grid[col, row] = score
        e = np.exp(moves - moves.max())
        forward, backward = np.zeros((width, rows, m)), np.zeros((width, rows, m))
        backward[:] = e[:, 0] / e[:, 0].sum()
        emit = np.exp(grid - grid.max(axis=2, keepdims=True))
        expected = np.zeros((m, m))
        a = emit[0] * e[0]
        forward[0] = a / a.sum(axis=1, keepdims=True)
        for k in range(1, width):
            n = live[k]
            a = (forward[k - 1, :n] @ e) * emit[k, :n]
            forward[k, :n] = a / a.sum(axis=1, keepdims=True)
        for k in range(width - 2, -1, -1):
            n = live[k + 1]
            ahead = backward[k + 1, :n] * emit[k + 1, :n]
            b = ahead @ e.T
            backward[k, :n] = b / b.sum(axis=1, keepdims=True)
            whole = (forward[k, :n] * b).sum(axis=1, keepdims=True)
            expected += e * ((forward[k, :n] / whole).T @ ahead)
        p = forward * backward
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
        some = size > 0
        expected[0] += p[0][some].sum(axis=0)
        expected[:, 0] += p[size[some] - 1, np.flatnonzero(some)].sum(axis=0)
        lack = goal - p[col, row]
        grads = [np.stack([np.bincount(at, lack[:, y], len(u)) for y in range(m)], axis=1) / rows for u, at in used] + [(seen - expected) / rows]
        for w, g, s in zip([*weights, moves], grads, squares):
            g -= decay * w
            s += g * g
            w += rate * g / np.sqrt(s)
    full = [np.zeros((SYMBOLS if len(f) == 1 else _PAIR, m)) for f in FEATURES]
    for w, f, (u, _) in zip(weights, full, used):
        f[u] = w
    return Field(full, moves)


@functools.cache
def default_field() -> Field:
    """The field of :func:`training_table`, trained once in a driver."""
    return train(training_table())


def find_spans(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte in the row, end, kind) of the personal data in texts; kinds as places in KINDS."""
    raw, start, end, symbol, row_at = shapes(texts)
    label = field.decode(feature_ids(symbol, row_at), row_at)
    at = np.flatnonzero(label)
    row = np.searchsorted(row_at, at, "right") - 1
    kind, first_token = (label[at] - 1) >> 1, (label[at] & 1) == 1
    new = np.concatenate([[True], first_token[1:] | (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    stop = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(at) else first
    begin = kernels.buffers(texts)[1][row[first]]
    return row[first], start[at[first]] - begin, end[at[stop]] - begin, kind[first]


def personal_data(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind, begin, stop, value)`` of every piece of personal data; a narrow scan without shuffle.

    ``begin`` and ``stop`` count bytes of UTF-8. ``field`` is trained from
    :func:`training_table` by default and broadcast; its size does not depend on
    the documents. Keys keep their type. Null and empty texts have nothing; rows
    with a null key appear with a null id, and repeated rows each give their own.
    A table without rows gives none. Pieces of one kind beside each other are
    told apart by the label of first tokens. A text of any length is read whole;
    it must fit a worker, with some fifty times its size beside it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(KINDS)
        for batch in batches:
            for at, texts in kernels.slices(batch.column(1).fill_null("")):
                row, begin, stop, label = find_spans(shared.value, texts)
                raw, offsets = kernels.buffers(texts)
                values = [raw[offsets[r] + b : offsets[r] + s].tobytes().decode() for r, b, s in zip(row, begin, stop)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), names.take(pa.array(label)), pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(values, pa.string())], ["doc_id", "kind", "begin", "stop", "value"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id {docs.schema[key].dataType.simpleString()}, kind string, begin int, stop int, value string")


def redact(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """``docs`` with each piece of personal data replaced by its kind in brackets; columns unchanged, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def cover(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for _, rows in kernels.slices(texts):
            row, begin, stop, label = find_spans(shared.value, rows.fill_null(""))
            plain = rows.to_pylist()
            bounds = np.searchsorted(row, np.arange(len(rows) + 1))
            for r in np.flatnonzero(np.diff(bounds)):
                raw, parts, at = plain[r].encode(), [], 0
                for k in range(bounds[r], bounds[r + 1]):
                    parts += [raw[at : begin[k]], f"[{KINDS[label[k]]}]".encode()]
                    at = stop[k]
                plain[r] = b"".join([*parts, raw[at:]]).decode()
            out += plain
        return pa.array(out, pa.string())

    cover.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(text, F.arrow_udf(cover, "string")(F.col(text)))
