"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from quillgraph.llm.quality import BINS, RULES

_M = "18446744073709551616"
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _hash_step(source: str, value: str, seed: str, out: str, tag: str) -> tuple[list[str], str]:
    """CTEs that add ``out`` = the 64-bit xxHash of the long ``value`` with ``seed``; both are 128-bit unsigned."""
    def u(x: object) -> str:
        return f"{x}::UHUGEINT"

    def rot(x: str, by: int) -> str:
        return f"((({x}) * {u(1 << by)}) % {u(_M)} + ({x}) // {u(1 << (64 - by))})"

    def shift(x: str, by: int) -> str:
        return f"(({x}) // {u(1 << by)})"

    steps = [
        f"{tag}1 AS (SELECT *, (({value}) * {u(_P2)}) % {u(_M)} AS k_ FROM {source})",
        f"{tag}2 AS (SELECT * EXCLUDE (k_), xor((({seed}) + {u(_P5)} + {u(8)}) % {u(_M)}, ({rot('k_', 31)} * {u(_P1)}) % {u(_M)}) AS h_ FROM {tag}1)",
        f"{tag}3 AS (SELECT * EXCLUDE (h_), (({rot('h_', 27)} * {u(_P1)}) % {u(_M)} + {u(_P4)}) % {u(_M)} AS h_ FROM {tag}2)",
        f"{tag}4 AS (SELECT * EXCLUDE (h_), (xor(h_, {shift('h_', 33)}) * {u(_P2)}) % {u(_M)} AS h_ FROM {tag}3)",
        f"{tag}5 AS (SELECT * EXCLUDE (h_), (xor(h_, {shift('h_', 29)}) * {u(_P3)}) % {u(_M)} AS h_ FROM {tag}4)",
        f"{tag}6 AS (SELECT * EXCLUDE (h_), xor(h_, {shift('h_', 32)}) AS {out} FROM {tag}5)",
    ]
    return steps, f"{tag}6"


_UNIT = "((({h}) // 2048::UHUGEINT)::DOUBLE + 0.5) / 9007199254740992.0"


def _as_unsigned(x: str) -> str:
    return f"(({x})::HUGEINT + CASE WHEN ({x}) < 0 THEN {_M}::HUGEINT ELSE 0::HUGEINT END)::UHUGEINT"


def sharding(source: str, shards: Sequence[tuple[int, float]]) -> str:
    key, at = _hash_step("docs_", _as_unsigned("doc_id"), "42::UHUGEINT", "key_", "a")
    both, at2 = _hash_step("pairs_", "shard_id_::UHUGEINT", "42::UHUGEINT", "first_", "b")
    last, at3 = _hash_step(at2, _as_unsigned("signed_"), "first_", "score_", "c")
    rows = ", ".join(f"({s}, {w!r}::DOUBLE)" for s, w in shards)
    return (
        f"WITH docs_ AS (SELECT doc_id, row_number() OVER () AS row_ FROM {source}), "
        + ", ".join(key)
        + f", shards_(shard_id_, w_) AS (VALUES {rows})"
        + f", pairs_ AS (SELECT row_, shard_id_, w_, key_, key_ AS signed_ FROM {at}, shards_), "
        + ", ".join(both)
        + ", "
        + ", ".join(x.replace(_as_unsigned("signed_"), "signed_") for x in last)
        + f", best_ AS (SELECT row_, arg_min(shard_id_, (-ln({_UNIT.format(h='score_')}) / w_)) AS shard FROM {at3} GROUP BY row_)"
        + f" SELECT d.*, b.shard::BIGINT AS shard FROM (SELECT *, row_number() OVER () AS row_ FROM {source}) d JOIN best_ b USING (row_)"
    ).replace("SELECT d.*,", "SELECT d.* EXCLUDE (row_),")


def mixing(source: str, weights: Mapping[str, float], max_epochs: float, seed: int, default_weight: float = 1.0, columns: str = "d.*, c.copy_::INTEGER AS epoch") -> str:
    first, at = _hash_step("docs_", f"{seed}::UHUGEINT", "42::UHUGEINT", "first_", "a")
    last, at2 = _hash_step(at, _as_unsigned("doc_id"), "first_", "draw_", "b")
    given = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in weights.items())
    return (
        f"WITH docs_ AS (SELECT *, row_number() OVER () AS row_ FROM {source}), "
        + ", ".join(first)
        + ", "
        + ", ".join(last)
        + f""", sizes_ AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size_, (CASE source {given} ELSE {default_weight!r} END)::DOUBLE AS w_ FROM {source} GROUP BY source),
        live_ AS (SELECT *, size_ * {max_epochs!r}::DOUBLE AS cap_, (SELECT sum(size_) FROM sizes_) AS budget_ FROM sizes_ WHERE w_ > 0 AND size_ > 0),
        levels_ AS (SELECT *, (budget_ - coalesce(sum(cap_) OVER (ORDER BY cap_ / w_, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w_) OVER (ORDER BY cap_ / w_, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_ FROM live_),
        level_ AS (SELECT max(level_) AS level_ FROM levels_ WHERE cap_ / w_ > level_),
        shares_ AS (SELECT source AS source_, least(cap_, coalesce((SELECT level_ FROM level_) * w_, cap_)) / size_ AS share_ FROM live_),
        copies_ AS (SELECT row_, unnest(range(1, (floor(share_) + CASE WHEN {_UNIT.format(h='draw_')} < share_ - floor(share_) THEN 1 ELSE 0 END)::BIGINT + 1)) AS copy_
            FROM {at2} JOIN shares_ ON source IS NOT DISTINCT FROM source_)
        SELECT {columns} FROM (SELECT *, row_number() OVER () AS row_ FROM {source}) d JOIN copies_ c USING (row_)"""
    ).replace("d.*,", "d.* EXCLUDE (row_),")


def quality(source: str, spread: float = 3.0, short_words: int = 20, min_group: int = 50) -> str:
    """Quartiles are the values at rank ceil(q n), each rounded down to its bin."""
    names = list(RULES)

    def binned(m: str) -> str:
        steps = " ".join(f"WHEN {m} < {limit!r} THEN floor({m} / {width!r}) * {width!r}" for limit, width in BINS[:-1])
        return f"CASE {steps} ELSE floor({m} / {BINS[-1][1]!r}) * {BINS[-1][1]!r} END"

    def level(keys: str, tag: str) -> str:
        by = f"GROUP BY {keys}" if keys else ""
        cols = ", ".join(f"quantile_disc({binned(m)}, 0.25) AS {m}_q1, quantile_disc({binned(m)}, 0.75) AS {m}_q3" for m in names)
        return f"{tag} AS (SELECT {keys + ', ' if keys else ''}count(*) AS n_, {cols} FROM m_ WHERE n_words > 0 {by})"

    tests = []
    for m, (low, high) in RULES.items():
        def q(k: str) -> str:
            return f"CASE WHEN o.n_ >= {min_group} THEN o.{m}_{k} WHEN l.n_ >= {min_group} THEN l.{m}_{k} ELSE a.{m}_{k} END"
        reach = f"{spread!r} * (({q('q3')}) - ({q('q1')}))"
        wide = f"(1 + {float(short_words)!r} / n_words)"
        if low is not None:
            tests.append(f"{m} >= ({q('q1')}) - greatest({reach}, {low!r}) * {wide}")
        if high is not None:
            tests.append(f"{m} <= ({q('q3')}) + greatest({reach}, {high!r}) * {wide}")
    return (
        f"""WITH w_ AS (SELECT *, row_number() OVER () AS row_, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS words_,
            length(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', '', 'g')) AS solid_,
            length(regexp_replace(coalesce(text, ''), '[\\p{{L}}\\p{{N}} \\t\\r\\n.,;:?''"()-]+', '', 'g')) AS odd_,
            length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]+', '', 'g')) AS letters_,
            length(regexp_replace(coalesce(text, ''), '[^\\p{{Lu}}]+', '', 'g')) AS capitals_ FROM {source}),
        m_ AS (SELECT *, len(words_)::DOUBLE AS n_words, solid_ / nullif(len(words_), 0)::DOUBLE AS word_length, odd_ / nullif(solid_, 0)::DOUBLE AS symbol_share,
            CASE WHEN letters_ > 0 THEN capitals_ / letters_::DOUBLE ELSE 0.0 END AS upper_share,
            CASE WHEN len(words_) > 1 THEN ln(len(list_distinct(words_))) / ln(len(words_)) ELSE 1.0 END AS vocabulary FROM w_),
        """
        + ",\n".join([level("lang, source", "own_"), level("lang", "lang_"), level("", "all_")])
        + """ SELECT m.doc_id, m.text, m.lang, m.source, m.n_chars FROM m_ m
            JOIN own_ o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
            JOIN lang_ l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN all_ a WHERE n_words > 0 AND """
        + " AND ".join(tests)
    )


def line_dedup(source: str, min_chars: int = 40) -> str:
    """Every shortest window of so many bytes, from each line on and up to each line, against the first place of an equal one."""
    return f"""WITH l_ AS (SELECT doc_id, string_split(text, chr(10)) AS ls_ FROM {source} WHERE text IS NOT NULL),
        a_ AS (SELECT doc_id, unnest(ls_) AS line_, unnest(range(1, len(ls_) + 1)) AS p_ FROM l_),
        c_ AS (SELECT *, sum(strlen(line_)) OVER (PARTITION BY doc_id ORDER BY p_)::BIGINT AS upto_ FROM a_),
        b_ AS (SELECT *, (upto_ * 1000000 + p_)::BIGINT AS end_, ((upto_ - strlen(line_)) * 1000000 + p_)::BIGINT AS begin_ FROM c_),
        w_ AS (SELECT x.doc_id, x.p_ AS from_, y.p_ AS to_ FROM b_ x ASOF JOIN b_ y ON x.doc_id = y.doc_id AND (x.begin_ - x.p_) + {min_chars} * 1000000 <= y.end_
            UNION SELECT x.doc_id, y.p_, x.p_ FROM b_ x ASOF JOIN b_ y ON x.doc_id = y.doc_id AND (x.end_ - x.p_) - {min_chars} * 1000000 + 999999 >= y.begin_),
        k_ AS (SELECT doc_id, from_, to_, array_to_string(list_slice(ls_, from_, to_), chr(10)) AS win_ FROM w_ JOIN l_ USING (doc_id)),
        f_ AS (SELECT doc_id, from_, to_, row_number() OVER (PARTITION BY win_ ORDER BY doc_id, from_) AS rn_ FROM k_),
        d_ AS (SELECT DISTINCT doc_id, unnest(range(from_, to_ + 1)) AS p_ FROM f_ WHERE rn_ > 1),
        r_ AS (SELECT a_.doc_id, string_agg(line_, chr(10) ORDER BY a_.p_) FILTER (d_.p_ IS NULL) AS text_, count(d_.p_) AS n_ FROM a_ LEFT JOIN d_ USING (doc_id, p_) GROUP BY 1)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(text_, '') END AS text, lang, source, n_chars, coalesce(n_, 0)::INTEGER AS lines_removed FROM {source} d LEFT JOIN r_ USING (doc_id)"""


def passages(source: str, least: int = 50) -> str:
    """Every window of so many words against the first place of an equal one, all as text; whole copies of a text go as a whole."""
    blank = "[\\x00-\\x20]"
    return f"""WITH u_ AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS lead_, regexp_extract_all(text, '[^\\x00-\\x20]+{blank}*') AS ps_ FROM {source} WHERE text IS NOT NULL),
        s_ AS (SELECT doc_id, text, ps_, list_transform(ps_, lambda p: regexp_replace(p, '{blank}+$', '')) AS ws_ FROM u_ WHERE doc_id = lead_ AND len(ps_) >= {least}),
        p_ AS (SELECT doc_id, ws_, unnest(range(1, len(ws_) - {least} + 2)) AS p_ FROM s_),
        w_ AS (SELECT doc_id, p_, array_to_string(list_slice(ws_, p_, p_ + {least} - 1), ' ') AS win_ FROM p_),
        f_ AS (SELECT doc_id, p_, row_number() OVER o_ AS rn_, first_value(doc_id) OVER o_ AS first_ FROM w_ WINDOW o_ AS (PARTITION BY win_ ORDER BY doc_id, p_)),
        h_ AS (SELECT doc_id, list_sort(list(DISTINCT first_)) AS first_doc_ids FROM f_ WHERE rn_ > 1 GROUP BY doc_id),
        d_ AS (SELECT DISTINCT doc_id, unnest(range(p_, p_ + {least})) AS p_ FROM f_ WHERE rn_ > 1),
        a_ AS (SELECT doc_id, unnest(ps_) AS piece_, unnest(range(1, len(ps_) + 1)) AS p_ FROM s_ WHERE doc_id IN (SELECT doc_id FROM h_)),
        r_ AS (SELECT a_.doc_id, coalesce(string_agg(piece_, '' ORDER BY a_.p_) FILTER (d_.p_ IS NULL), '') AS rest_, count(d_.p_)::INTEGER AS words_removed FROM a_ LEFT JOIN d_ USING (doc_id, p_) GROUP BY 1)
        SELECT doc_id, regexp_extract(text, '^{blank}*') || rest_ AS text, words_removed, first_doc_ids FROM r_ JOIN h_ USING (doc_id) JOIN s_ USING (doc_id)
        UNION ALL SELECT doc_id, '', len(ps_)::INTEGER, [lead_] FROM u_ WHERE doc_id > lead_ AND len(ps_) >= {least}"""
