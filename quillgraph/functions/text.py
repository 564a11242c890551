"""Text expressions: message headers, address lists, names and display labels. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADERS = {"thread_id": "Thread ID", "mail_id": "Mail ID", "date": "Date", "sender": "From", "to": "To", "cc": "Cc", "subject": "Subject"}
#: Words of names that say nothing of the person.
TITLES = sorted("board center centre chair college committee department dr dr. editorial group institute miss mr mrs ms office press prof prof. program school staff team university".split())
LABEL_KEYS = ["datasetName", "methodName", "taskName", "metricName", "personName", "journalTitle", "confTitle"]


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def header_field(message: Column, name: str, anchored: bool = True) -> Column:
    """Value of a header line and the indented lines that fold it; null where absent.

    ``anchored`` wants the name at the beginning of a line; without it the name may
    stand within one (``Update:`` then counts as ``Date:``).
    """
    lead = "(?im)^" if anchored else "(?im)"
    value = F.regexp_extract(message, rf"{lead}{name}:[ \t]*([^\n]*(?:\n[ \t]+[^\n]*)*)", 1)
    return blank_to_null(F.trim(F.regexp_replace(value, r"\s*\n\s*", " ")))


def headers(message: Column, anchored: bool = True) -> Column:
    return F.struct(*[header_field(message, name, anchored).alias(key) for key, name in HEADERS.items()])


def body(message: Column) -> Column:
    """What follows the last header line and the lines that fold it; without headers, what follows the first empty line."""
    lines = F.split(message, "\n")
    is_header = lambda x: x.rlike(r"(?i)^(Thread ID|Mail ID|Date|From|To|Cc|Subject):")
    at = F.array_max(F.transform(lines, lambda x, i: F.when(is_header(x), i)))
    tail = F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0)))
    after = F.regexp_replace(F.array_join(tail, "\n"), r"^(?:[ \t]+\S[^\n]*(?:\n|$))+", "")
    plain = F.regexp_extract(message, r"(?s)\n[ \t]*\n(.*)$", 1)
    return F.regexp_replace(F.when(at.isNotNull(), after).otherwise(plain), r"^\s+|\s+$", "")


def addresses(field: Column) -> Column:
    """``array<struct<name, email, affiliation>>`` of a list divided by commas or semicolons.

    Forms: ``Name <a@b>``, ``Name [a@b]``, ``Name (a@b)``, ``Name (Affiliation)``, a bare address, a bare name.
    """
    parts = F.filter(F.transform(F.split(field, "[,;]"), lambda x: F.trim(F.regexp_replace(x, '"', ""))), lambda x: x != "")

    def one(p: Column) -> Column:
        mail = F.regexp_extract(p, r"[\[<(]\s*([^\s\[\]<>()@]+@[^\s\[\]<>()]+)\s*[\]>)]", 1)
        bare = F.when(p.rlike(r"^[^\s@]+@[^\s@]+$"), p)
        group = F.regexp_extract(p, r"\(([^()@]+)\)", 1)
        name = F.trim(F.regexp_replace(p, r"[\[<(][^\[\]<>()]*[\]>)]", ""))
        return F.struct(
            F.when(bare.isNull(), blank_to_null(name)).alias("name"),
            F.coalesce(blank_to_null(mail), bare).alias("email"),
            blank_to_null(F.trim(group)).alias("affiliation"),
        )

    return F.transform(parts, one)


def mail_key(mail_id: Column) -> Column:
    """``e{n}`` from the first run of digits; null without one."""
    digits = F.regexp_extract(mail_id, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("e"), digits))


def thread_subject(subject: Column) -> Column:
    """Subject without leading Re:, Fwd:, Fw: and Response to:, blanks squeezed, in lower case."""
    bare = F.regexp_replace(F.trim(subject), r"(?i)^(?:(?:re|fwd|fw|response to)\s*:\s*)+", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


#: Property by which mentions of a type are one entity, and by which the entity is named.
NAMING = {"Conference": "confTitle", "Dataset": "datasetName", "Email": "mailNum", "Journal": "journalTitle", "MailThread": "threadID", "Meeting": "meetAgenda", "Method": "methodName", "Metric": "metricName", "Paper": "paperTitle", "PaperBib": "doi", "PaperStatus": "statusType", "SubmissionID": "identifier", "Task": "taskName"}


def canonical_key(kind: Column, props: Column) -> Column:
    """Key that makes mentions one entity: a person's address or else name; for others the type and their naming property.

    A missing property counts as empty, so all such mentions of a type are one.
    Null for a type without a naming property, so that each mention stays by itself.
    """
    low = lambda k: F.lower(F.trim(F.coalesce(props[k], F.lit(""))))
    mail = blank_to_null(low("personEmail"))
    out = F.when(kind == "Person", F.coalesce(F.concat(F.lit("person_email_"), mail), F.concat(F.lit("person_name_"), low("personName"))))
    for name, field in NAMING.items():
        out = out.when(kind == name, F.concat(F.lit(name.lower() + "_"), low(field)))
    return out


def display_label(kind: Column, props: Column) -> Column:
    """Name of an entity for people: its naming property or ``Unknown <type>``; a status with its date, other types by their first property."""
    pick = lambda *keys: F.coalesce(*[blank_to_null(F.trim(props[k])) for k in keys])
    unknown = lambda name: F.lit(f"Unknown {name}")
    status, day = pick("statusType", "status"), pick("statusDate")
    dated = F.coalesce(F.concat(status, F.lit(" ("), day, F.lit(")")), status, day, unknown("Status"))
    out = F.when(kind == "Person", F.coalesce(pick("personName", "personEmail"), unknown("Person"))).when(kind == "PaperStatus", dated)
    for name, word in {"Email": "Email", "MailThread": "Thread"}.items():
        out = out.when(kind == name, F.coalesce(F.concat(F.lit(f"{word} "), pick(NAMING[name])), unknown(word)))
    for name in ("Paper", "Dataset", "Method", "Task", "Metric", "SubmissionID", "Conference", "Journal", "Meeting"):
        out = out.when(kind == name, F.coalesce(pick(NAMING[name]), unknown(name.removesuffix("ID"))))
    return out.otherwise(F.coalesce(F.try_element_at(F.map_values(props), F.lit(1)), kind))


def blocking_label(props: Column) -> Column:
    """First of the naming properties that is present; a present null counts as the text ``None``."""
    return F.coalesce(*[F.when(F.map_contains_key(props, k), F.coalesce(props[k], F.lit("None"))) for k in LABEL_KEYS])


def embedding_text(label: Column, context: Column, style: str = "evidence") -> Column:
    if style == "evidence":
        return F.concat(F.lit("Entity: "), label, F.lit(". Evidence: "), context)
    return F.concat(F.lit("Entity: "), label, F.lit(" | Context: "), context)


def verdict(answer: Column, compat: bool = False) -> Column:
    """MATCH where the answer says so and doesn't deny it; ``compat`` takes ``NO MATCH`` with a blank as MATCH."""
    up = F.upper(answer)
    denied = up.contains("NO_MATCH") if compat else up.rlike("NO[ _]?MATCH")
    return F.when(up.contains("MATCH") & ~denied, F.lit("MATCH")).otherwise(F.lit("NO_MATCH"))


def name_words(name: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words of four letters or more, divided by blanks, that are no title."""
    return F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(TITLES if stop is None else stop))


def names_overlap(a: Column, b: Column, stop: list[str] | None = None) -> Column:
    """Whether one name holds the other or both share a word of four letters or more that is no title (``stop``); false for a second name under four letters."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x != "") & (F.length(y) >= 4) & (x.contains(y) | y.contains(x) | F.arrays_overlap(name_words(a, stop), name_words(b, stop))), F.lit(False))


def no_answer(gold: Column, output: Column) -> Column:
    """Whether a question without an answer was answered so."""
    g, o = F.lower(F.trim(F.coalesce(gold, F.lit("")))), F.lower(F.trim(F.coalesce(output, F.lit(""))))
    return ((g == "") | g.contains("not available")) & ((o == "") | (o == "[]") | o.contains("not available") | o.contains("could not be extracted"))


def one_line(text: Column, limit: int = 1000) -> Column:
    """Text for one cell: double quotes single, line ends spelled, cut to ``limit`` characters; null becomes empty."""
    flat = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("'")), r"\r?\n", " [NEWLINE] ")
    return F.substring(flat, 1, limit)


def truncated(text: Column, limit: int = 3000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("... [truncated]"))).otherwise(text)
