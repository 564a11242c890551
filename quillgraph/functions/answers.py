"""What models answer: verdicts in JSON, and entities and relations in JSON that may be cut off or broken."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.columns import let
from quillgraph.functions.text import blank_to_null

GRAPH = "struct<entities:array<struct<id:string,type:string,properties:map<string,string>>>,relations:array<struct<start:string,end:string,relation:string,context:string>>>"


def unfenced(answer: Column) -> Column:
    """An answer without the marks of code blocks."""
    return F.trim(F.regexp_replace(answer, r"^\s+|\s+$|```(?:json)?", ""))


def parsed(answer: Column) -> Column:
    """An answer as a variant, missing braces supplied at its end; null where that is no JSON."""

    def read(bare: Column) -> Column:
        count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
        more = F.greatest(F.lit(0), count("{") - count("}"))
        return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.concat(bare, F.repeat(F.lit("}"), more))))

    return let(unfenced(answer), read)


def json_items(answer: Column, key: str, schema: str) -> Column:
    """Objects below ``key`` of a model's JSON answer; null where it can't be read."""
    bare = unfenced(answer)
    value = F.coalesce(parsed(answer), F.try_parse_json(F.concat(bare, F.lit("]}"))))
    return F.try_variant_get(value, f"$.{key}", f"array<{schema}>")


def graph_answer(answer: Column) -> Column:
    """``struct<entities, relations>`` of an answer; empty lists where it has none.

    The answer is an object with ``entities`` and ``relations``, or a list of such
    objects. Ends go by ``start_id``, ``start`` or ``source`` and ``end_id``,
    ``end`` or ``target``, names by ``relation`` or ``type``, contexts by
    ``context`` or ``evidence``. Entities without id or type, relations without
    ends or name and whatever is no object are left out. An answer that is no
    JSON, even with its missing braces, is searched for whole objects. Lists of
    objects of any shape take some twenty passes over a variant in expressions,
    ten times slower than one pass by Arrow batches.
    """
    return F.arrow_udf(_read, GRAPH)(answer)


def _text(x: object) -> str:
    return "" if x is None else x.strip() if isinstance(x, str) else json.dumps(x)


def _first(x: dict, *names: str) -> str:
    return next((t for t in (_text(x.get(n)) for n in names) if t), "")


def _as_entity(x: dict) -> list[dict]:
    own = x.get("properties") if isinstance(x.get("properties"), dict) else {}
    e = {"id": _first(x, "id"), "type": _first(x, "type"), "properties": [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in own.items() if v is not None]}
    return [e] if e["id"] and e["type"] and e["id"].lower() != "none" else []


def _as_relation(x: dict) -> list[dict]:
    r = {"start": _first(x, "start_id", "start", "source"), "end": _first(x, "end_id", "end", "target"), "relation": _first(x, "relation", "type"), "context": _first(x, "context", "evidence")}
    return [r] if r["start"] and r["end"] and r["relation"] and "None" not in (r["start"], r["end"]) else []


def read(answer: str) -> dict[str, list]:
    """Entities and relations of an answer."""
    bare = re.sub(r"```(?:json)?", "", answer).strip()
    for text in (bare, bare + "}" * max(0, bare.count("{") - bare.count("}"))):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        out: dict[str, list] = {"entities": [], "relations": []}
        for part in found if isinstance(found, list) else [found]:
            for name, made in (("entities", _as_entity), ("relations", _as_relation)):
                items = part.get(name) if isinstance(part, dict) else None
                out[name] += [y for x in items if isinstance(x, dict) for y in made(x)] if isinstance(items, list) else []
        return out
    return scrape(bare)


def whole_objects(text: str) -> list[object]:
    """Objects and lists of a text that are JSON by themselves, from left to right; what is in one isn't searched again."""
    out, at, read = [], 0, json.JSONDecoder()
    while (at := min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)) >= 0:
        try:
            found, at = read.raw_decode(text, at)
            out.append(found)
        except ValueError:
            at += 1
    return out


def scrape(text: str) -> dict[str, list]:
    """Entities and relations among the whole objects of a broken answer."""
    out: dict[str, list] = {"entities": [], "relations": []}

    def add(x: object) -> None:
        if isinstance(x, dict) and "id" in x and "type" in x:
            out["entities"] += _as_entity(x)
        elif isinstance(x, dict) and ("start_id" in x or "relation" in x):
            out["relations"] += _as_relation(x)

    for found in whole_objects(text):
        if isinstance(found, list):
            for x in found:
                add(x)
        else:
            for part in ("entities", "relations"):
                for x in found.get(part) if isinstance(found.get(part), list) else []:
                    add(x)
            add(found)
    return out


_ARROW = pa.struct([("entities", pa.list_(pa.struct([("id", pa.string()), ("type", pa.string()), ("properties", pa.map_(pa.string(), pa.string()))]))), ("relations", pa.list_(pa.struct([(n, pa.string()) for n in ("start", "end", "relation", "context")])))])


def _read(answers: pa.Array) -> pa.Array:
    return pa.array([read(a or "") for a in answers.to_pylist()], _ARROW)


_read.__annotations__ = {"answers": pa.Array, "return": pa.Array}


def judgement(answer: Column) -> Column:
    """``struct<correct boolean, reason string>`` of a judge's JSON answer; unreadable ones count as wrong, with themselves as the reason."""
    v = parsed(answer)
    right = F.coalesce(F.try_variant_get(v, "$.is_useful", "boolean"), F.try_variant_get(v, "$.correct", "boolean"), F.lit(False))
    return F.struct(right.alias("correct"), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.try_variant_get(v, "$.reasoning", "string"), answer).alias("reason"))
