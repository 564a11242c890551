"""Dates among the properties of entities: the year they lack, their ISO form, threads by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import dates, text
from quillgraph.sources.corpus import numbered

DATE_FIELDS = ["meetDate", "confDate", "statusDate", "taskDate", "mailDate"]
BASE_YEAR = 2019


def entity_years(entities: DataFrame, relations: DataFrame, base: int = BASE_YEAR) -> DataFrame:
    """``(id, year)`` that a date of an entity has where it states none.

    It is the year of the first mail (by length of id, then id) that is the source
    of a relation of the entity and states one; else that of the first ISO date of
    the entity itself; else ``base``. Sources that are no mail say nothing.
    """
    own = entities.select(F.trim("id").alias("id"), "props")
    mails = own.select(F.col("id").alias("source"), dates.stated_year(F.col("props")["mailDate"]).alias("year")).where("year is not null")
    ends = relations.select(F.trim("source").alias("source"), F.explode(F.array(F.trim("start"), F.trim("end"))).alias("id")).where("source is not null and not lower(source) in ('', 'nan', 'unknown', 'header')")
    told = ends.join(mails, "source").groupBy("id").agg(F.min_by("year", F.struct(F.length("source"), "source")).alias("told"))
    iso = lambda f: F.regexp_extract(F.col("props")[f], r"^(\d{4})-", 1).try_cast("int")
    return own.join(told, "id", "left").select("id", F.coalesce("told", *[iso(f) for f in ("statusDate", "mailDate", "confDate")], F.lit(base)).alias("year"))


def normalized_entities(entities: DataFrame, years: DataFrame, fields: list[str] | None = None, base: int = BASE_YEAR, mode: str = "strict") -> DataFrame:
    """``entities`` with the date properties as ISO text, and whether any changed (``changed``)."""
    out = entities.join(years.select(F.col("id").alias("_id"), F.col("year").alias("_year")), F.trim("id") == F.col("_id"), "left")
    dated = F.array(*[F.lit(f) for f in (DATE_FIELDS if fields is None else fields)])
    fixed = F.transform_values("props", lambda k, v: F.when(F.array_contains(dated, k), dates.normalize_date(v, F.coalesce("_year", F.lit(base)), mode)).otherwise(v))
    out = out.withColumn("_new", fixed)
    same = F.forall(F.map_keys("props"), lambda k: F.col("props")[k].eqNullSafe(F.col("_new")[k]))
    return out.withColumn("changed", F.coalesce(~same, F.lit(False))).withColumn("props", F.col("_new")).select(*entities.columns, "changed")


def regrouped_threads(records: DataFrame, subject: str = "subject", order: str = "record", out: str = "thread") -> DataFrame:
    """``records`` with a thread id of six characters for each normalised subject, in the order of first appearance.

    A record without a subject is a thread of its own. Ids are the thread's number
    at base 36, scrambled by an odd factor: different for all of 36^6 threads and
    the same in each run.
    """
    key = F.coalesce(text.blank_to_null(text.thread_subject(F.col(subject))), F.concat(F.lit("\x00"), F.col(order).cast("string")))
    own = records.withColumn("_thread", key)
    firsts = numbered(own.groupBy("_thread").agg(F.min(order).alias("_first")), ["_first", "_thread"], "_n")
    # 36^6 is even and divisible by 3, so a factor prime to 6 runs through all ids.
    code = F.conv(F.pmod(F.col("_n") * F.lit(1_234_567_891), F.lit(36**6)).cast("string"), 10, 36)
    return own.join(firsts.select("_thread", F.lpad(code, 6, "0").alias(out)), "_thread").drop("_thread")
