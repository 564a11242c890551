"""Operator 6: quality rules with adaptive thresholds from mergeable quantile sketches."""

import unicodedata
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.llm import kernels
from quillgraph.llm.common import free_name
from quillgraph.sources.staging import small_enough, stage

#: metric: (least margin below the lower quartile, least margin above the upper one).
#: A margin of None leaves that side open. Margins keep a rule from firing where
#: almost every document has the same value and the quartiles coincide.
RULES: dict[str, tuple[float | None, float | None]] = {
    "word_length": (1.5, 2.5),
    "symbol_share": (None, 0.05),
    "upper_share": (None, 0.15),
    "vocabulary": (0.12, None),
}


_SPACE, _LETTER, _CAPITAL, _PLAIN = 1, 2, 4, 8
_classes: np.ndarray | None = None

MEASURES = T.StructType([T.StructField(m, T.DoubleType()) for m in ("n_words", "word_length", "symbol_share", "upper_share", "vocabulary")])


def _class_table() -> np.ndarray:
    """Class bits of every code point, made once in a worker."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))
            if kind[0] == "L":
                out[i] = _LETTER | _PLAIN | (_CAPITAL if kind == "Lu" else 0)
            elif kind[0] == "N":
                out[i] = _PLAIN
        out[[ord(c) for c in ".,;:?'\"()-"]] |= _PLAIN
        out[[ord(c) for c in " \t\r\n"]] = _SPACE
        _classes = out
    return _classes


def measure_texts(texts: pa.Array) -> pa.Array:
    """Measures of each text that don't depend on its length.

    ``n_words``: runs of characters other than blank, tab and line ends;
    ``word_length``: such characters per word; ``symbol_share``: share of them
    that are no letters, digits or common punctuation; ``upper_share``: capitals
    among letters (0 without letters); ``vocabulary``: ln(distinct words) /
    ln(words), 1 for one word. A null text or one without words has nulls.
    """
    table = _class_table()
    parts = []
    for _, rows in kernels.slices(texts):
        raw, at = kernels.buffers(rows)
        code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
        kinds = table[code]

        def count(bit: int) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum((kinds & bit) != 0, dtype=np.int64)])[chars])

        words = kernels.tokenize(rows, _WORD_BYTES)
        n = np.diff(words.row_at)
        row = np.repeat(np.arange(len(rows), dtype=np.uint64), n)
        kinds_of_word = np.bincount((kernels.distinct((row << np.uint64(44)) | (words.hash >> np.uint64(20))) >> np.uint64(44)).astype(np.int64), minlength=len(rows))
        solid, letters = np.diff(chars) - count(_SPACE), count(_LETTER)
        with np.errstate(all="ignore"):
            parts.append(
                np.stack(
                    [
                        n.astype(np.float64),
                        solid / n,
                        (solid - count(_PLAIN)) / solid,
                        np.where(letters > 0, count(_CAPITAL) / letters, 0.0),
                        np.where(n > 1, np.log(kinds_of_word) / np.log(n), 1.0),
                    ]
                )
            )
    values = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0))
    none = ~(values[0] > 0)
    return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=none) for v in values], MEASURES.fieldNames())


#: A word ends at the four blanks of the measures, not at other control characters.
_WORD_BYTES = np.array([i not in b" \t\r\n" for i in range(256)])
measure = F.arrow_udf(measure_texts, MEASURES)


#: Widths of a sketch's bins, each up to a limit: powers of two, so that bins are exact in any engine.
BINS: list[tuple[float, float]] = [(1.0, 1 / 4096), (64.0, 1 / 256), (4096.0, 1 / 4), (float(1 << 18), 16.0), (float("inf"), 4096.0)]


def bin_of(value: Column) -> Column:
    """Lower bound of the bin of a value that isn't negative."""
    out = None
    for limit, width in BINS[:-1]:
        own = F.floor(value / width) * F.lit(width)
        out = F.when(value < limit, own) if out is None else out.when(value < limit, own)
    return out.otherwise(F.floor(value / BINS[-1][1]) * F.lit(BINS[-1][1]))


def sketch(measured: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(keys, metric, bin, n)``: a mergeable quantile sketch of each metric, as the counts of its bins.

    Merging two sketches adds their counts, so the result is the same for any
    order and any partitions; a quantile is its true value rounded down to a bin.
    A group has some ten thousand bins at most where values stay below 2**18.
    """
    each = measured.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in metrics])).alias("e"))
    return each.groupBy(*keys, "e.metric", "e.bin").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(keys, n, <metric>)``: size of each group and the bins of rank ceil(n / 4) and ceil(3 n / 4) as ``<metric>.q1`` and ``.q3``."""
    group = Window.partitionBy(*keys, "metric")
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("bin")))
    per = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    return per.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == m, F.struct("q1", "q3"))).alias(m) for m in metrics])


def thresholds(measured: DataFrame, rules: Mapping[str, tuple[float | None, float | None]], spread: float, min_group: int) -> DataFrame:
    """``(lang, source)`` with the quartiles of each metric and the margins below and above them.

    A margin is ``spread`` times the distance of the quartiles, or the least
    margin of the rule where that is wider.

    One sketch per metric, language and source; a language's sketch is the merge
    of its sources', the corpus' that of all languages. A group of fewer than
    ``min_group`` documents takes its language's quartiles, and a small language
    those of the corpus.
    """
    metrics = list(rules)
    by_source = stage(sketch(measured, ["lang", "source"], metrics))
    by_lang = merged(by_source, ["lang"])

    def level(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        return quartiles(df, keys, metrics).select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col("n").alias(f"{name}_n"), *[F.col(m).alias(f"{name}_{m}") for m in metrics])

    own, lang, all_ = level(by_source, "own", ["lang", "source"]), level(by_lang, "lang", ["lang"]), level(merged(by_lang, []), "all", [])
    joined = own.join(lang, F.col("own_lang").eqNullSafe(F.col("lang_lang"))).crossJoin(all_)
    out = [F.col("own_lang").alias("lang"), F.col("own_source").alias("source")]
    for m, (low, high) in rules.items():
        q = F.coalesce(F.when(F.col("own_n") >= min_group, F.col(f"own_{m}")), F.when(F.col("lang_n") >= min_group, F.col(f"lang_{m}")), F.col(f"all_{m}"))
        reach = F.lit(spread) * (q["q3"] - q["q1"])
        out += [q["q1"].alias(f"{m}_q1"), q["q3"].alias(f"{m}_q3")]
        for side, least in (("below", low), ("above", high)):
            out.append((F.greatest(reach, F.lit(least)) if least is not None else F.lit(None).cast("double")).alias(f"{m}_{side}"))
    return joined.select(*out)


def quality_filter(
    docs: DataFrame,
    rules: Mapping[str, tuple[float | None, float | None]] = RULES,
    spread: float = 3.0,
    short_words: int = 20,
    min_group: int = 50,
    broadcast_rows: int = 50_000,
) -> DataFrame:
    """Rows of ``docs`` within the adaptive limits of their language and source, columns unchanged.

    Measures of a short text scatter more, so the margins of a text of n words
    are widened by the factor 1 + ``short_words`` / n. Two narrow scans: one fills
    the sketches, the other measures again and compares with the joined limits, so
    no text is shuffled; limits of up to ``broadcast_rows`` groups are broadcast,
    more are joined by shuffle. A null, empty or blank text has no measures and is
    rejected. Null languages and sources are groups of their own. Repeated rows
    are judged alike, and a value equal to a limit passes. A table without rows
    stays empty. A text of any length is measured whole; it must fit a worker with
    some thirty times its size beside it. The result is the same in every run.
    """
    first = next(iter(rules))
    measured = docs.select(F.col("lang"), F.col("source"), measure("text").alias("m")).select("lang", "source", "m.*").where(F.col(first).isNotNull())
    limits = stage(thresholds(measured, rules, spread, min_group))
    m, *names = free_name(docs, "measures", *[f"limit_{c}" for c in limits.columns])
    renamed = limits.toDF(*names)
    at = dict(zip(limits.columns, names))
    side = F.broadcast(renamed) if small_enough(limits, broadcast_rows) else renamed
    judged = docs.withColumn(m, measure("text")).where(F.col(m)[first].isNotNull())
    joined = judged.join(side, judged["lang"].eqNullSafe(renamed[at["lang"]]) & judged["source"].eqNullSafe(renamed[at["source"]]))
    wider = 1 + F.lit(float(short_words)) / F.col(m)["n_words"]
    for r in rules:
        value, mid, margin = F.col(m)[r], [F.col(at[f"{r}_q{q}"]) for q in (1, 3)], [F.col(at[f"{r}_{side}"]) for side in ("below", "above")]
        joined = joined.where(F.coalesce((value >= mid[0] - margin[0] * wider) & (value <= mid[1] + margin[1] * wider), F.coalesce(value >= mid[0] - margin[0] * wider, value <= mid[1] + margin[1] * wider), F.lit(True)))
    return joined.select(*[docs[c] for c in docs.columns])
