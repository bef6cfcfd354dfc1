"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

The patterns propose spans; numbers are confirmed by their check digits (Luhn for cards, mod 97 for account numbers); context words
around a span move its score. Spans are found without Python: splitting a text at a pattern gives the pieces between the
matches, whose lengths are the positions. Repetitions are possessive and a match starts at the head of its run or where the last match ended, so that a long
run costs one pass and no recursion; the spans are those of the plain pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Words whose nearness speaks for a kind.
CONTEXT = {
    "email": "mail|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse|dirección",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
BASE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.2}
NEAR = 0.25
AROUND = 40
SUMS = 128   # steps between matches that are added up together
LEAST = 0.4


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed, and written into the plan, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _is_ip(value: Column) -> Column:
    """Four numbers of at most 255; leading zeros do not count."""
    return F.forall(F.split(value, "[.]"), lambda part: _let(F.ltrim(part, F.lit("0")), lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255)))


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.lit(20))

    def value(padded, i):
        digit = F.substr(padded, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))
    return _let(F.lpad(digits, 20, "0"), lambda p: F.aggregate(places, F.lit(0), lambda a, i: a + value(p, i)) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod 97 check; letters count as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(rest, c):
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _valid(kind: str, value: Column, plain: Column) -> Column:
    """``plain`` is the value without anything but letters and digits."""
    if kind == "ip":
        return _is_ip(value)
    if kind == "card":
        return F.length(plain).between(13, 19) & luhn(plain)
    if kind == "phone":
        return F.length(plain).between(9, 15)
    if kind == "iban":
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
# What a text must hold to be searched at all; a cheap test that spares most texts the search.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _spans(kind: str, text: Column) -> Column:
    """The confirmed spans of one kind, in order of start. Each step is a struct, so that the plan stays small."""
    pattern = F.lit(PATTERNS[kind])
    sum_ = lambda lengths, low, n: F.aggregate(F.slice(lengths, low + 1, n), F.lit(0), lambda a, x: a + x)

    def stepped(x: Column) -> Column:
        """Code points from the start of each match to the start of the next, and the ends of all pieces of the text, matches and what lies between, that a context may reach."""
        steps = F.transform(x["found"], lambda _, i: F.char_length(x["between"][i]) + F.when(i > 0, F.char_length(F.get(x["found"], i - 1))).otherwise(0))
        pieces = F.concat(F.flatten(F.transform(x["found"], lambda value, i: F.array(x["between"][i], value))), F.slice(x["between"], F.size(x["between"]), 1))
        return F.struct(x["found"].alias("found"), steps.alias("steps"), F.transform(pieces, lambda p: F.right(p, F.lit(AROUND))).alias("tails"),
                        F.transform(pieces, lambda p: F.left(p, F.lit(AROUND))).alias("heads"))

    def blocked(x: Column) -> Column:
        """Prefix sums of the sums of every ``SUMS`` steps: a start is one of them and the steps of its own block, so no sum runs over all matches before."""
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(x["steps"]) / SUMS).cast("int")), lambda b: sum_(x["steps"], b * SUMS, F.lit(SUMS)))
        return _let(sums, lambda s: F.struct(x["found"].alias("found"), x["steps"].alias("steps"), x["tails"].alias("tails"), x["heads"].alias("heads"),
                                             F.transform(s, lambda _, b: sum_(s, F.lit(0), b)).alias("sums")))

    def placed(x: Column) -> Column:
        def match(value: Column, i: Column) -> Column:
            block = F.floor(i / SUMS).cast("int")
            # A match has two code points or more, so AROUND pieces on either side hold the context.
            low = F.greatest(2 * i + 1 - AROUND, F.lit(0))
            before = F.right(F.array_join(F.slice(x["tails"], low + 1, 2 * i + 1 - low), ""), F.lit(AROUND))
            after = F.left(F.array_join(F.slice(x["heads"], 2 * i + 3, F.lit(AROUND)), ""), F.lit(AROUND))
            return F.struct(value.alias("value"), (x["sums"][block] + sum_(x["steps"], block * SUMS, i % SUMS + 1)).alias("start"), before.alias("before"), after.alias("after"))
        return F.transform(x["found"], match)

    def ended(x: Column) -> Column:
        return F.struct(x["value"].alias("value"), x["start"].alias("start"), (x["start"] + F.char_length(x["value"])).alias("end"), x["before"].alias("before"),
                        x["after"].alias("after"), F.regexp_replace(x["value"], "[^A-Za-z0-9]", "").alias("plain"))

    def scored(x: Column) -> Column:
        near = F.lower(F.concat_ws(" ", x["before"], x["after"]))
        score = F.lit(BASE[kind]) + F.when(F.rlike(near, F.lit(rf"\b(?:{CONTEXT[kind]})\b")), NEAR).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, PATTERNS[kind]).alias("between"))
    matches = _let(_let(found, stepped), blocked)
    spans = F.filter(F.transform(_let(matches, placed), ended), lambda x: _valid(kind, x["value"], x["plain"]))
    spans = F.transform(spans, scored)
    if kind in ("iban", "ssn"):
        spans = F.filter(spans, lambda x: x["score"] >= LEAST)
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(SPAN))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``found``: per row, the confirmed spans (kind, start, end, value, score) by kind, then start.

    Positions count code points from 0, the end is exclusive. Kinds: email, ip (parts up to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits);
    added are iban (mod 97) and, only where a context word lifts it over ``LEAST``, ssn. Spans of different kinds may overlap. A failing match
    is dropped and not tried again. A null or empty text has no spans; repeated rows and null ids stay as they are; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = [_spans(kind, F.col("text")) for kind in PATTERNS]
    return rows.select("doc_id", *(s.alias(f"_{k}") for k, s in zip(PATTERNS, spans, strict=True))).select(
        "doc_id", F.concat(*(F.col(f"_{k}") for k in PATTERNS)).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
