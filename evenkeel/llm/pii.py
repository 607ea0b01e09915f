"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Only DataFrame functions: every step is a JVM expression over one row, without shuffle or Python.

Defined results: a null or empty text has no spans; positions are code points, the end is
exclusive; repeated rows are reported once per row; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every run is possessive: it is followed by a character outside its class or by the end, so
# giving characters back can never help, and long runs cost linear time. `\G` admits a match
# that begins inside a run, just where the match before it ended.
LOCAL = "A-Za-z0-9._%+-"
PROPOSE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # the maximal runs of 16 to 19 digits that single spaces or hyphens may separate
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")  # always reported once their check holds
ADDED = ("iban", "ssn")  # reported from a score of REPORT_FROM

# Score of a confirmed proposal without context. A context word nearby adds NEARBY.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
NEARBY = 0.2
REPORT_FROM = 0.5
WINDOW = 48  # code points before and after the span
CONTEXT = {
    "email": r"e-?mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|master|credit|karte|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|fax|telefon|anruf",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "ssn": r"ssn|social|security|sozial|seguro",
}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: (lambda x: F.when(x > 9, x - 9).otherwise(x))(c.cast("int") * (1 + i % 2)),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 when its rearranged digits are divided by 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda r, c: F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def _octet(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(plain) <= 3) & (F.substring(plain, 1, 3).cast("int") <= 255)


CONFIRM = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _octet),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
    "iban": lambda v: mod97(F.regexp_replace(v, " ", "")),
    "ssn": lambda v: ~(v.rlike("^(000|666|9)") | v.rlike("-00-") | v.rlike("-0000$")),
}


def _proposals(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match: the pieces between matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    none = F.array().cast(kind)
    placed = F.aggregate(
        F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("v"), g.alias("g"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["g"] + F.length(m["v"])).alias("at"),
            F.array_append(
                acc["spans"],
                F.struct(
                    (acc["at"] + m["g"]).alias("start"),
                    (acc["at"] + m["g"] + F.length(m["v"])).alias("end"),
                    m["v"].alias("value"),
                ),
            ).cast(kind).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _scored(text: Column, kind: str, proposals: Column) -> Column:
    def score(span: Column) -> Column:
        begin = F.greatest(span["start"] - WINDOW, F.lit(0))
        around = F.substring(text, (begin + 1).cast("int"), (span["end"] + WINDOW - begin).cast("int"))
        near = F.lower(around).rlike(CONTEXT[kind])
        return F.struct(
            F.lit(kind).alias("kind"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["value"].alias("value"),
            F.round(F.least(F.lit(1.0), SCORE[kind] + F.when(near, NEARBY).otherwise(0.0)), 3).alias("score"),
        )

    confirmed = F.transform(F.filter(proposals, lambda s: CONFIRM[kind](s["value"])), score).cast(SPAN)
    return confirmed if kind in BASE else F.filter(confirmed, lambda s: s["score"] >= REPORT_FROM)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """`docs` with an array of (kind, start, end, value, score), by kind as listed, then start; a column that is
    already called `into` is replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = [_scored(body, kind, _proposals(body, PROPOSE[kind])) for kind in (*BASE, *ADDED)]
    return docs.withColumn(into, F.concat(*spans))


def mask_pii(docs: DataFrame, text: str = "text", into: str = "masked") -> DataFrame:
    """`docs` with `into`, the text with every span replaced by its kind in brackets; of overlapping spans the first
    stays. A column that is already called `into` is replaced; all others stay."""
    spans = "_pii"
    while spans in docs.columns:
        spans += "_"
    found = find_pii(docs, text, spans)
    body = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.lit("["),
                    s["kind"],
                    F.lit("]"),
                ).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))),
    )
    return found.withColumn(into, done).drop(spans)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans, all spans."""
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count_of(F.col("pii"), kind).alias(f"n_{kind}") for kind in (*BASE, *ADDED)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.transform("pii", lambda s: s["score"]).alias("scores"),
    )
