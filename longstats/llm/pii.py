"""Personal data in texts: patterns propose, checksums confirm, context words weigh (native).

A kind is a pattern, a check and words that make it likelier or less likely.
The pattern proposes spans from left to right, never overlapping; a proposal
that its check refuses is dropped and its characters aren't tried again.  The
checks: all parts of an address at most 255, Luhn's sum of a card's 13 to 19
digits, 9 to 15 digits of an international telephone number, the length of the
country and the remainder 1 modulo 97 of a bank account number (IBAN), the
ranges that were ever given out of a social security number.  A span's score,
0 to 100, starts at its kind's prior, rises with a known card issuer and with a
likely word near it and falls with an unlikely one; near is the last 40
characters before and the first 20 after, up to the next proposal of the kind.

Four kinds (email, ip, card, phone) are the base: their spans stay whatever
their score.  The others are added if their score reaches ``threshold``: cards
that stand in a longer row of digits, account numbers, social security numbers
and national telephone numbers (only beside a word such as "call").

All work is column expressions of one row: no shuffle, no Python.  A proposal
is marked by a control character on both sides, which splits the text into gaps
and proposals; places are running sums of their lengths, taken in blocks, so
the work grows with the text even where it is long and full of spans.

Defined results: NULL and empty texts have no spans; places are code points,
the end exclusive; repeated rows are judged each; an empty table gives an empty
result; other columns are kept by ``with_findings`` and ``redact`` (a column of
the result's name is replaced) and ignored by ``personal_data``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Characters looked at before and after a proposal.
BEFORE, AFTER = 40, 20
#: Points for a likely word, an unlikely one, a known card issuer.
LIKELY, UNLIKELY, ISSUER = 25, -25, 20
THRESHOLD = 50
#: Pieces of a text whose lengths are summed at a time.
BLOCK = 256
# parts the pieces; a text's own such character is read as the next one, which no pattern holds
MARK, OTHER = "\u0001", "\u0002"

# fixed values: lengths of account numbers by country (ISO 13616)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# Patterns that can't be slow: a run is entered at its start only (inside it the outcome is the same), and what can't
# match otherwise isn't tried again.  The plain form of each is in its comment; both find the same spans.
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ where it has 13 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_IN_ROW = r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
TEL = r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}"
IBAN = "|".join(
    f"(?:{'|'.join(c for c, m in IBAN_LENGTHS.items() if m == n)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}"
    for n in sorted(set(IBAN_LENGTHS.values())))

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_ISSUER = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"
# areas 000, 666 and 9xx, groups 00 and serials 0000 were never given out
_NEVER_GIVEN = r"^(?:000|666|9)|-00-|-0000$"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of up to 20 digits."""
    padded = F.lpad(number, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 1, F.substr(doubled, i, F.lit(1))).otherwise(F.substr(padded, i, F.lit(1))).cast("int"))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """The remainder of an account number: country and check digits last, letters as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        return F.when(c <= "9", rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


@dataclass(frozen=True)
class Kind:
    """How one kind of span is found; ``check`` takes the proposal and its gap before and after."""

    name: str
    pattern: str
    check: Callable[[Column, Column, Column], Column]
    prior: int
    likely: Sequence[str] = ()
    unlikely: Sequence[str] = ()
    base: bool = True
    bonus: Callable[[Column], Column] | None = None


def _alone(before: Column, after: Column) -> Column:
    return ~before.rlike("[A-Za-z0-9-]$") & ~after.rlike("^[A-Za-z0-9-]")


def _issued(m: Column) -> Column:
    return F.when(digits(m).rlike(_ISSUER), ISSUER).otherwise(0)


_CARD_WORDS = ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta")
_NUMBER_WORDS = ("order", "invoice", "isbn", "serial", "tracking", "version")
_CALL_WORDS = ("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono", "anruf", "appelez")

KINDS: tuple[Kind, ...] = (
    Kind("email", EMAIL, lambda m, b, a: F.lit(True), 70, ("email", "mail", "contact", "kontakt", "correo", "courriel"), ("example",)),
    Kind("ip", IP, lambda m, b, a: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 60, ("ip", "host", "server", "address"),
         ("version", "release", "section")),
    Kind("card", CARD, lambda m, b, a: luhn(digits(m)), 60, _CARD_WORDS, _NUMBER_WORDS, bonus=_issued),
    Kind("phone", PHONE, lambda m, b, a: F.length(digits(m)).between(9, 15), 70, _CALL_WORDS, _NUMBER_WORDS),
    Kind("card", CARD_IN_ROW, lambda m, b, a: _alone(b, a) & luhn(digits(m)), 30, _CARD_WORDS, _NUMBER_WORDS, base=False, bonus=_issued),
    Kind("iban", IBAN, lambda m, b, a: _alone(b, a) & (mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1), 80,
         ("iban", "account", "konto", "bank", "compte", "cuenta"), (), base=False),
    Kind("ssn", SSN, lambda m, b, a: _alone(b, a) & ~m.rlike(_NEVER_GIVEN), 50, ("ssn", "social", "security"), _NUMBER_WORDS, base=False),
    # after an international prefix it is a part of what the phone kind takes
    Kind("tel", TEL, lambda m, b, a: _alone(b, a) & ~b.rlike(r"\+[0-9][\x20().0-9-]*$"), 30, _CALL_WORDS, _NUMBER_WORDS, base=False),
)
ORDER = tuple(dict.fromkeys(k.name for k in KINDS))


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the proposals: gap, proposal, gap, ..., gap (NULL if nothing is proposed)."""
    marked = F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}")
    return F.when(marked.contains(MARK), F.split(marked, MARK))


def starts(cut: Column) -> Column:
    """Where each piece begins: running sums, over blocks of pieces and then inside each."""
    zero, none = F.lit(0), F.array().cast("array<int>")

    def running(numbers: Column) -> Column:
        """(numbers before each, their sum)"""
        return F.aggregate(numbers, F.struct(none.alias("at"), zero.alias("sum")), lambda s, n: F.struct(
            F.concat(s["at"], F.array(s["sum"])).alias("at"), (s["sum"] + n).alias("sum")))

    lengths = F.transform(cut, F.length)
    blocks = F.transform(F.sequence(zero, F.floor((F.size(cut) - 1) / BLOCK).cast("int")),
                         lambda b: running(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    offsets = running(F.transform(blocks, lambda b: b["sum"]))["at"]
    return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["at"], lambda n: n + o)))


def proposals(cut: Column, start: Column) -> Column:
    """Proposals of a cut text with their places and the text near them.

    A proposal that touches another one has a letter as its neighbour: it doesn't stand alone.
    """
    last = F.size(cut) - 1

    def one(i: Column) -> Column:
        before, after = F.get(cut, i - 1), F.get(cut, i + 1)
        return F.struct(F.get(start, i).alias("start"), F.get(start, i + 1).alias("end"), F.get(cut, i).alias("m"),
                        F.when((before == "") & (i > 1), "x").otherwise(F.substring(before, -BEFORE, BEFORE)).alias("before"),
                        F.when((after == "") & (i + 1 < last), "x").otherwise(F.substring(after, 1, AFTER)).alias("after"))

    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last - 1, F.lit(2)), one))


def _word(words: Sequence[str]) -> str:
    return f"(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)"


def score(kind: Kind, m: Column, before: Column, after: Column) -> Column:
    """Points of a confirmed proposal."""
    total = F.lit(kind.prior)
    if kind.bonus:
        total = total + kind.bonus(m)
    for words, points in ((kind.likely, LIKELY), (kind.unlikely, UNLIKELY)):
        if words:
            near = ascii_lower(before).rlike(_word(words)) | ascii_lower(after).rlike(_word(words))
            total = total + F.when(near, points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def _confirmed(kind: Kind, proposed: Column, threshold: int) -> Column:
    """Spans of one kind: struct (kind's place in ORDER, start, end, added, score)."""
    good = F.filter(proposed, lambda s: kind.check(s["m"], s["before"], s["after"]))
    spans = F.transform(good, lambda s: F.struct(
        F.lit(ORDER.index(kind.name)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.lit(not kind.base).alias("added"), score(kind, s["m"], s["before"], s["after"]).alias("score")))
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= threshold)


def _fresh(docs: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (f"__{stem}{i}" for i in range(len(taken) + 1)) if n not in taken)


def readable(text: Column) -> Column:
    """The text without the mark."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text)


def with_findings(docs: DataFrame, name: str = "findings", kinds: Sequence[Kind] = KINDS, threshold: int = THRESHOLD) -> DataFrame:
    """The documents with an array of (kind, start, end, added, score), by kind and then start.

    ``kind`` is a place in ``ORDER``.  A span that two kinds of one name find alike is given once, as the base one.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    text, cut, begin = _fresh(docs, "pii_text"), _fresh(docs, "pii_cut"), _fresh(docs, "pii_start")
    rows = docs.withColumn(text, readable(F.col("text")))
    # each step reads what the one before computed, once
    rows = rows.withColumn(cut, F.struct(*[pieces(F.col(text), k.pattern).alias(f"k{i}") for i, k in enumerate(kinds)]))
    rows = rows.withColumn(begin, F.struct(*[F.when(F.col(cut)[f"k{i}"].isNotNull(), starts(F.col(cut)[f"k{i}"])).alias(f"k{i}")
                                             for i in range(len(kinds))]))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,added:boolean,score:int>>")
    found = F.array_sort(F.concat(*[F.coalesce(_confirmed(
        k, proposals(F.col(cut)[f"k{i}"], F.col(begin)[f"k{i}"]), threshold), none) for i, k in enumerate(kinds)]))
    rows = rows.select(*kept, found.alias(cut))

    def new(s: Column, i: Column) -> Column:
        prev = F.get(F.col(cut), i - 1)
        return (i == 0) | (prev["kind"] != s["kind"]) | (prev["start"] != s["start"]) | (prev["end"] != s["end"])

    return rows.select(*kept, F.filter(F.col(cut), new).alias(name))


def _redacted(cut: Column, kind: Kind, threshold: int) -> Column:
    """A cut text put together again, the confirmed proposals as the kind's name."""
    proposed = proposals(cut, F.transform(cut, lambda p: F.lit(0)))  # places aren't asked for

    def piece(i: Column) -> Column:
        s = F.get(proposed, F.floor(i / 2).cast("int"))
        taken = kind.check(s["m"], s["before"], s["after"])
        if not kind.base:
            taken = taken & (score(kind, s["m"], s["before"], s["after"]) >= threshold)
        return F.when((i % 2 == 1) & taken, f"[{kind.name}]").otherwise(F.get(cut, i))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cut) - 1), piece), "")


def redact(docs: DataFrame, kinds: Sequence[Kind] = KINDS, threshold: int = THRESHOLD) -> DataFrame:
    """The documents with every span of their texts as its kind's name in brackets, one kind after the other."""
    text, cut = _fresh(docs, "pii_text"), _fresh(docs, "pii_cut")
    rows = docs.withColumn(text, readable(F.col("text")))
    for kind in kinds:
        rows = rows.withColumn(cut, pieces(F.col(text), kind.pattern))
        rows = rows.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(_redacted(F.col(cut), kind, threshold)))
    changed = F.when(F.col("text").isNotNull(), F.col(text))
    return rows.select(*[changed.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: base spans by kind and as a hash, all spans, and the scores in the same order."""
    found = with_findings(docs.select("doc_id", "text"), threshold=threshold).select("doc_id", "findings")
    spans = F.col("findings")
    base = F.filter(spans, lambda s: ~s["added"])

    def count(name: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == ORDER.index(name))).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(_told(base), 256).alias("base_sha256"),
        _told(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))
