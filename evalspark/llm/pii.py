"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built-in expressions only. A pattern's matches come from ``regexp_extract_all`` and the text
between them from ``split`` with the same pattern, so a match starts where the lengths of all
pieces and matches before it end; offsets are code points, the end is exclusive.

Patterns are written so that the matcher neither recurses nor rescans: every repeat is
possessive where nothing behind it could need the characters back, and a match may only start
at the beginning of its run of characters, or where the last match ended. Both leave the
leftmost non-overlapping matches of the plain patterns unchanged.

The base kinds (email, ip, card, phone) are kept whatever their score. The further kinds are
kept only at a score of THRESHOLD or more:
- ``iban``: country, check digits and account, confirmed by mod 97;
- ``ssn``: ddd-dd-dddd without invalid groups, which needs a context word nearby.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: A context word within so many code points before a span, or after it, raises its score.
CONTEXT = 40
CONTEXT_BONUS = 0.4
THRESHOLD = 0.6
_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    name: str
    base: bool
    hint: str          # a cheap test of the whole text; no match without it
    pattern: str
    prior: float       # score before context
    words: tuple[str, ...]


KINDS = (
    Kind("email", True, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         0.8, ("mail", "contact", "write", "courriel", "correo")),
    Kind("ip", True, ".", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         0.6, ("ip", "host", "server", "address", "login")),
    Kind("card", True, "", r"[0-9](?:[\x20-]?[0-9])++",
         0.7, ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta")),
    Kind("phone", True, "+", r"\+[0-9][\x20().0-9-]+[0-9]",
         0.6, ("phone", "call", "tel", "mobile", "fax", "telefon")),
    Kind("iban", False, "", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         0.8, ("iban", "bank", "account", "konto", "compte", "cuenta")),
    Kind("ssn", False, "-", r"(?:\G|(?<![0-9-]))(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         0.3, ("ssn", "social", "security")),
)
BASE = tuple(k.name for k in KINDS if k.base)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _running(lens: Column) -> Column:
    """Exclusive running totals of an array<int>, in blocks so that appending stays linear."""
    zero = F.lit(0)

    def append(start: Column, part: Column) -> Column:
        state = F.struct(start.alias("t"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(part, state, lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["o"], F.array(acc["t"])).alias("o")), lambda acc: acc["o"])

    def blocks(ls: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1)), F.lit(_BLOCK)), lambda i: F.slice(ls, i, _BLOCK))

    def totals(bs: Column) -> Column:
        sums = F.transform(bs, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
        return F.flatten(F.zip_with(append(zero, sums), bs, append))

    return let(lens, lambda ls: let(blocks(ls), totals))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """16 to 19 digits whose Luhn sum divides by ten."""
    def total(ds: Column) -> Column:
        doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
        return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0
    return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), let(F.split(F.reverse(d), ""), total)).otherwise(F.lit(False)))


def _mod97(value: Column) -> Column:
    """An account number of 15 to 34 characters whose rearranged value is 1 modulo 97."""
    def rest(v: Column) -> Column:
        chars = F.split(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4)), "")
        step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        return F.length(v).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)
    return let(F.replace(value, F.lit(" "), F.lit("")), rest)


def _valid(kind: str, value: Column) -> Column:
    return {
        "ip": lambda: value.rlike(f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"),
        "card": lambda: _luhn(value),
        "phone": lambda: F.length(_digits(value)).between(8, 15),
        "iban": lambda: _mod97(value),
    }.get(kind, lambda: F.lit(True))()


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed matches of one kind in a text that is not null."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    near = "(?i)(?<![a-z])(?:" + "|".join(kind.words) + ")"

    def located(hits: Column) -> Column:
        pieces = F.split(text, kind.pattern, -1)
        steps = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        ends = F.zip_with(_running(steps), steps, lambda before, step: before + step)
        both = F.zip_with(ends, hits, lambda e, h: F.struct(h.alias("value"), (e - F.length(h)).alias("start"), e.alias("end")))
        good = F.filter(both, lambda x: _valid(kind.name, x["value"]))

        def scored(x: Column) -> Column:
            lo = F.greatest(x["start"] - CONTEXT, F.lit(0))
            around = F.concat_ws(" ", F.substring(text, lo + 1, x["start"] - lo), F.substring(text, x["end"] + 1, F.lit(CONTEXT)))
            score = F.lit(kind.prior) + F.when(around.rlike(near), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        out = F.transform(good, scored)
        return out if kind.base else F.filter(out, lambda x: x["score"] >= THRESHOLD)

    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    found = let(hits, lambda h: F.when(F.size(h) == 0, empty).otherwise(located(h)))
    hint = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike("[0-9]")
    return F.when(hint, found).otherwise(empty)


def spans(text: Column) -> Column:
    """All spans of a text by kind in the order of KINDS, then by start; a null text has none."""
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: F.concat(*[_spans(t, k) for k in KINDS]))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base kinds, digest of the base spans, all spans, findings.

    A null or empty text has no spans. Repeated rows give repeated results; other columns are
    not read; an empty table gives no rows.
    """
    found = docs.select("doc_id", spans(docs["text"]).alias("findings"))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"), "findings")


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, named after the first."""
    def rebuild(t: Column, found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, x: Column) -> Column:
            new = F.concat(acc["parts"], F.array(F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
            return F.struct(F.greatest(acc["at"], -x["back"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["parts"]).alias("parts"))

        return F.aggregate(ordered, state, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, acc["at"] + 1, F.length(t))))

    return F.when(text.isNotNull(), let(text, lambda t: let(spans(t), lambda s: F.when(F.size(s) == 0, t).otherwise(rebuild(t, s)))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its text redacted and, where there is such a column, n_chars counted anew; null texts stay null."""
    n = {"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return docs.withColumn("__text", redacted(docs["text"])).withColumns({"text": F.col("__text"), **n}).select(*docs.columns)
