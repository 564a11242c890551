"""Triples with labels: their making from relations, samples for annotators, and scores against a gold set.

A triple row is ``(email_id, subject_label, predicate, object_label,
evidence_sentence, subject_type, object_type)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators.evaluation import assigned, guarded, max_pool, prf, ranked
from quillgraph.sources.corpus import Ontology
from quillgraph.sources.staging import stage

PAIR_KEYS = ["entity_label_1", "evidence_1", "entity_label_2", "evidence_2"]


def named_entities(entities: DataFrame) -> DataFrame:
    """``(id, label, type)`` of entities ``(id, type, props, rid)``; the last row of an id counts."""
    own = entities.select("id", "type", "rid", text.display_label(F.col("type"), F.col("props")).alias("label"))
    return own.groupBy("id").agg(F.max_by("label", "rid").alias("label"), F.max_by("type", "rid").alias("type"))


def comparison_triples(relations: DataFrame, entities: DataFrame, wanted: DataFrame, source_type: str) -> DataFrame:
    """Triples of the relations whose mail is among ``wanted(email_id)`` and both of whose ends are known."""
    named = named_entities(entities)
    mail = F.coalesce(text.mail_key(F.col("source")), F.trim("source"))
    own = relations.where("source is not null").withColumn("email_id", mail).join(wanted.select("email_id").distinct(), "email_id", "left_semi")
    s, o = named.toDF("start", "subject_label", "subject_type"), named.toDF("end", "object_label", "object_type")
    out = own.join(s, "start").join(o, "end")
    return out.select("email_id", "subject_label", F.col("relation").alias("predicate"), "object_label", F.col("context").alias("evidence_sentence"), "subject_type", "object_type", F.lit(source_type).alias("source_type"))


def annotation_sample(relations: DataFrame, entities: DataFrame, mails: DataFrame, n: int = 250, seed: int = 42) -> DataFrame:
    """``(subject, predicate, object, evidence_sentence, full_email_context, original_source_id)`` of up to ``n`` sampled mails.

    ``mails(source, text)`` holds the records; a mail counts where a relation that
    is not from headers names it. Mails are drawn by a seeded hash of their key.
    """
    sources = relations.where("source <> 'header'").select("source").distinct().join(mails.select("source").distinct(), "source", "left_semi")
    drawn = sources.orderBy(F.xxhash64(F.lit(seed), "source"), "source").limit(n)
    named = named_entities(entities).select("id", "label")
    # At most ``n`` mails: sent to the relations, each text made a cell once; rows get it last, when nothing is shuffled any more.
    drawn = stage(drawn)
    texts = mails.join(F.broadcast(drawn), "source", "left_semi").groupBy("source").agg(text.one_line(F.min("text")).alias("full_email_context"))
    own = relations.select("source", "start", "end", "relation", "context").join(F.broadcast(drawn), "source", "left_semi")
    met = own.join(named.toDF("start", "subject"), "start").join(named.toDF("end", "object"), "end")
    evidence = F.replace(F.replace(F.coalesce("context", F.lit("")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    return met.join(F.broadcast(stage(texts)), "source").select("subject", F.col("relation").alias("predicate"), "object", evidence.alias("evidence_sentence"), "full_email_context", F.col("source").alias("original_source_id"))


def cell(c: Column | str) -> Column:
    """A cell as text without blanks around it; null is the word for it that tables carry."""
    return F.trim(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("nan")))


def judged_pairs(golden: DataFrame, resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """Annotated pairs with their prediction and with their rank among the candidates.

    Pairs meet by two labels and two contexts; equal ones meet as often as they
    are there. Only ``MATCH`` and ``NO_MATCH`` labels count, whatever their case.
    The rank is by falling ``similarity_score`` (then ``rid``) within the first
    label; of equal candidates the best counts, none gives null.
    """
    label = F.upper(F.trim("label"))
    gold = golden.withColumns({k: cell(k) for k in PAIR_KEYS}).withColumn("label", label).where(F.col("label").isin("MATCH", "NO_MATCH"))
    said = resolved.select(*[cell(k).alias(k) for k in PAIR_KEYS], "llm_prediction")
    order = ranked(candidates.select(*[cell(k).alias(k) for k in PAIR_KEYS], "similarity_score", "rid"), "entity_label_1", "similarity_score", ["rid"])
    ranks = order.groupBy(*PAIR_KEYS).agg(F.min("rank").alias("rank"))
    return gold.join(said, PAIR_KEYS).join(ranks, PAIR_KEYS, "left")


def judged_scores(pairs: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 of ``label`` against ``llm_prediction``; any other prediction than MATCH is none."""
    return prf(pairs.select((F.col("label") == "MATCH").alias("truth"), F.coalesce(F.col("llm_prediction") == "MATCH", F.lit(False)).alias("predicted")))


def misjudged(pairs: DataFrame) -> DataFrame:
    """Pairs whose prediction differs from their label, or is missing."""
    return pairs.where(~F.col("label").eqNullSafe(F.col("llm_prediction")))


def _entity(label: str, kind: str) -> Column:
    """Key of an entity: its label in lower case and its type; null where either is missing."""
    return F.concat(F.lower(F.trim(label)), F.lit("\x1f"), F.trim(kind))


def first_contexts(gold: DataFrame) -> DataFrame:
    """``(email_id, mail_text)``: the first full text (by ``rid``) that a gold row gives for its mail."""
    return gold.where("email_id is not null and full_email_context is not null").groupBy("email_id").agg(F.min_by("full_email_context", "rid").alias("mail_text"))


def entity_texts(triples: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """``(email_id, id, text)`` of every mention: what an encoder is given; with the mail's text where ``contexts`` are given, else the evidence."""
    own = triples if contexts is None else triples.join(contexts, "email_id", "left")
    context = F.coalesce("evidence_sentence" if contexts is None else "mail_text", F.lit(""))
    ends = F.array(*[F.struct(_entity(f"{e}_label", f"{e}_type").alias("id"), F.trim(f"{e}_label").alias("label")) for e in ("subject", "object")])
    each = own.where("email_id is not null").select("email_id", context.alias("context"), F.explode(ends).alias("e"))
    # Of several spellings the least names the entity.
    first = each.where("e.id is not null").select("email_id", "e.id", "e.label", "context")
    names = first.groupBy("email_id", "id").agg(F.min("label").alias("name"))
    return first.join(names, ["email_id", "id"]).select("email_id", "id", text.embedding_text(F.col("name"), F.col("context"), "context").alias("text"))


def aligned_entities(gold: DataFrame, pred: DataFrame, encode: Callable[[Column], Column], contexts: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """``(email_id, gold_id, pred_id, similarity)``: the best one-to-one assignment of each mail's entities by their pooled vectors."""

    def pooled(rows: DataFrame) -> DataFrame:
        each = entity_texts(rows, contexts).select(F.struct("email_id", "id").alias("key"), encode(F.col("text")).alias("vec"))
        return max_pool(each, "key").select(F.col("key.email_id").alias("grp"), F.col("key.id").alias("id"), F.col("pooled").alias("vec"))

    return assigned(pooled(gold), pooled(pred), least).withColumnRenamed("grp", "email_id")


def triple_scores(gold: DataFrame, pred: DataFrame, alignment: DataFrame, ontology: Ontology, taus: Sequence[float] = (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """``(tau, part, tp, n_pred, n_gold, precision, recall, f1)`` for subjects, objects, entities, predicates and triples.

    ``alignment(email_id, gold_id, pred_id, similarity)`` counts from ``tau`` on.
    Only mails with entities on both sides count. A gold entity is met if any
    predicted one is aligned to it. Triples must fit the ontology; predicted ones
    are compared after their ends were replaced by what they are aligned to.
    Distinct values of each mail are counted, then summed.
    """
    spark = gold.sparkSession
    ends = {"subject": _entity("subject_label", "subject_type"), "object": _entity("object_label", "object_type")}

    def sided(rows: DataFrame) -> DataFrame:
        return rows.where("email_id is not null").select("email_id", ends["subject"].alias("s"), ends["object"].alias("o"), F.trim("predicate").alias("p"), F.trim("subject_type").alias("start_type"), F.trim("object_type").alias("end_type"))

    g, q = sided(gold), sided(pred)
    some = lambda x: x.where("s is not null or o is not null").select("email_id").distinct()
    mails = some(g).join(some(q), "email_id", "left_semi")
    g, q = g.join(mails, "email_id", "left_semi"), q.join(mails, "email_id", "left_semi")
    steps = spark.createDataFrame([(float(t),) for t in taus], "tau double")
    links = alignment.join(F.broadcast(steps), F.col("similarity") >= F.col("tau")).select("tau", "email_id", "gold_id", "pred_id")
    matched = links.select("tau", "email_id", F.col("gold_id").alias("x")).distinct()

    def values(rows: DataFrame) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(part).alias("part"), F.col(c).alias("x")) for part, c in (("subject", "s"), ("object", "o"), ("entity", "s"), ("entity", "o"), ("predicate", "p"))])
        return rows.select("email_id", F.explode(parts).alias("v")).select("email_id", "v.part", "v.x").where("x is not null").distinct()

    gv, qv = values(g), values(q)
    totals = gv.groupBy("part").agg(F.count("*").alias("n_gold")).join(qv.groupBy("part").agg(F.count("*").alias("n_pred")), "part", "full_outer")
    met = gv.where("part <> 'predicate'").join(matched, ["email_id", "x"]).groupBy("tau", "part").agg(F.count("*").alias("tp"))
    same = gv.where("part = 'predicate'").join(qv, ["email_id", "part", "x"]).groupBy("part").agg(F.count("*").alias("tp")).crossJoin(F.broadcast(steps))
    rows = totals.crossJoin(F.broadcast(steps)).join(met.unionByName(same), ["tau", "part"], "left")

    pairs = F.broadcast(ontology.pairs(spark).withColumnRenamed("relation", "p"))
    valid = lambda x: x.where("s is not null and o is not null and p is not null").join(pairs, ["start_type", "p", "end_type"], "left_semi").select("email_id", "s", "p", "o").distinct()
    gt, qt = valid(g), valid(q).crossJoin(F.broadcast(steps))
    for c in ("s", "o"):
        to = links.select("tau", "email_id", F.col("pred_id").alias(c), F.col("gold_id").alias("to"))
        qt = qt.join(to, ["tau", "email_id", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")
    qt = qt.distinct()
    counts = qt.join(gt.withColumn("hit", F.lit(1)), ["email_id", "s", "p", "o"], "left").groupBy("tau").agg(F.count("hit").alias("tp"), F.count("*").alias("n_pred"))
    whole = steps.join(counts, "tau", "left").crossJoin(gt.agg(F.count("*").alias("n_gold"))).withColumn("part", F.lit("triple"))
    out = rows.select("tau", "part", "tp", "n_pred", "n_gold").unionByName(whole.select("tau", "part", "tp", "n_pred", "n_gold")).na.fill(0, ["tp", "n_pred", "n_gold"])
    precision, recall = guarded(F.col("tp"), F.col("n_pred")), guarded(F.col("tp"), F.col("n_gold"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": guarded(2 * precision * recall, precision + recall)})


def shot_lines(golden: DataFrame, each: int = 3, seed: int = 42) -> DataFrame:
    """``(place, text)``: ``each`` MATCH and then as many NO_MATCH pairs as examples for a prompt, drawn by a seeded hash."""
    out = None
    draw = [F.xxhash64(F.lit(seed), *PAIR_KEYS), *[F.col(k) for k in PAIR_KEYS]]
    for at, label in enumerate(("MATCH", "NO_MATCH")):
        drawn = golden.where(F.col("label") == label).orderBy(*draw).limit(each)
        lines = drawn.select(F.lit(at).alias("part"), F.struct(*draw).alias("draw"), F.concat(pair_prompt(), F.lit(" "), F.col("label"), F.lit("\n\n")).alias("text"))
        out = lines if out is None else out.unionByName(lines)
    return out.select((F.col("part") * each).alias("part"), "draw", "text").orderBy("part", "draw").select("part", "text")


def pair_prompt() -> Column:
    """What a judge is asked of a pair."""
    def line(k: int) -> list[Column]:
        return [F.lit(f"Entity {k}: "), cell(f"entity_label_{k}"), F.lit(" | Context: "), cell(f"evidence_{k}"), F.lit("\n")]

    return F.concat(*line(1), *line(2), F.lit("Output:"))


def report_lines(frame: DataFrame, digits: int = 4) -> list[str]:
    """A small frame of scores as lines ``name value ...`` for a log; numbers with so many digits. Frames grow with thresholds and parts, never with data."""
    return ["  ".join(f"{k}={v:.{digits}f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()) for r in frame.limit(100_000).toLocalIterator()]
