"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Everything is a column expression, so the job is one scan without a shuffle. ``split`` and
``regexp_extract_all`` walk a text by the same matches; running sums over the lengths of
gaps and matches give the positions. The sums run in blocks, so a text with n matches costs
about n * (64 + n / 64) small steps rather than n * n.

Defined results: a null text counts as empty and has no spans; an empty table gives an empty
table; every input row gives one output row (repeated rows and null ids included); other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import let, whole_text

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "national_id"]
#: Signs of an account number by country.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A country's number of signs; where that does not fit, or for other countries, 15 to 34."""
    sized = [rf"(?:{'|'.join(names.split())})[0-9][0-9](?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, names in IBAN_SIGNS.items()]
    return rf"(?=[A-Z][A-Z][0-9][0-9])(?:{'|'.join(sized)}|[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){{11,30}})"


#: Possessive forms give the same matches as greedy ones here and need no stack. The guards in
#: front of email and ip only skip starts inside a run that has failed already.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A text without the sign cannot match.
NEEDS = {"email": "@", "phone": "+", "national_id": "-"}
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|taxpayer",
}
#: Score of a span by its pattern and checksum alone; a context word near it adds 0.3.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.3}
CONTEXT_GAIN, CONTEXT_CHARS, THRESHOLD, BLOCK = 0.3, 40, 0.5, 64


def _running(steps: Column) -> Column:
    """Running sums of a non-empty array of whole numbers."""

    def sums(values: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("t"))
        add = lambda acc, x: F.struct(
            F.concat(acc["a"], F.array(acc["t"] + x)).alias("a"), (acc["t"] + x).alias("t")
        )
        return F.aggregate(values, zero, add, lambda acc: acc["a"])

    def in_blocks(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(s), F.lit(BLOCK))
        blocks = F.transform(starts, lambda b: sums(F.slice(s, b, F.lit(BLOCK))))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), sums(F.transform(blocks, lambda a: F.element_at(a, -1))))
        before = F.slice(ends, F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda a, o: F.transform(a, lambda x: x + o)))

    return let(steps, in_blocks)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum of at most 19 digits is a multiple of ten."""

    def check(z: Column) -> Column:
        total = F.lit(0)
        for i in range(1, 20):
            digit = F.substring(z, i, 1)
            doubled = F.translate(digit, "0123456789", "0246813579")
            total = total + (digit if (19 - i) % 2 == 0 else doubled).cast("int")
        return total % 10 == 0

    return let(F.lpad(digits, 19, "0"), check)


def _mod_97(iban: Column) -> Column:
    """The account number, its first four signs moved to the end and letters as 10 to 35, leaves 1."""
    compact = F.translate(iban, " ", "")
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    number = F.array_join(
        F.transform(
            F.split(moved, ""),
            lambda c: F.when(c >= "A", (F.ascii(c) - 55).cast("string")).otherwise(c),
        ),
        "",
    )

    def rest(n: Column) -> Column:
        left = F.lit("")
        for i in range(1, 90, 30):
            chunk = F.concat(F.lit("0"), left, F.substring(n, i, 30))
            left = (chunk.cast("decimal(38,0)") % F.lit(97)).cast("int").cast("string")
        return left.cast("int") == 1

    return let(number, rest)


def _bare(s: Column) -> Column:
    """No letter or digit touches the span."""
    return ~s["before"].rlike("[A-Za-z0-9]$") & ~s["after"].rlike("^[A-Za-z0-9]")


def _confirmed(kind: str, s: Column) -> Column:
    x = s["match"]
    if kind == "ip":
        small = lambda q: let(
            F.regexp_replace(q, "^0+", ""), lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255"))
        )
        return F.forall(F.split(x, "[.]"), small)
    if kind == "card":
        luhn = lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
        return let(_digits(x), luhn)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        return F.when(_bare(s), _mod_97(x)).otherwise(F.lit(False))
    if kind == "national_id":
        return _bare(s) & ~x.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """array<struct<start, stop, kind, score>> of one kind; code points, end exclusive."""
    pattern = F.lit(PATTERNS[kind])
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,score:double>>")
    rank = (BASE_KINDS + ADDED_KINDS).index(kind)

    def placed(matches: Column) -> Column:
        return let(F.split(text, PATTERNS[kind], -1), lambda gaps: spans(matches, gaps))

    def spans(matches: Column, gaps: Column) -> Column:
        n = F.size(matches)
        behind = F.slice(F.concat(F.array(F.lit("")), matches), F.lit(1), n)
        steps = F.zip_with(F.slice(gaps, F.lit(1), n), behind, lambda g, m: F.length(g) + F.length(m))
        parts = F.arrays_zip(
            matches.alias("match"),
            _running(steps).alias("start"),
            F.transform(F.slice(gaps, F.lit(1), n), lambda g: F.right(g, F.lit(CONTEXT_CHARS))).alias("before"),
            F.transform(F.slice(gaps, F.lit(2), n), lambda g: F.left(g, F.lit(CONTEXT_CHARS))).alias("after"),
        )
        scored = F.transform(F.filter(parts, lambda s: _confirmed(kind, s)), one)
        return scored if kind in BASE_KINDS else F.filter(scored, lambda s: s["score"] >= THRESHOLD)

    def one(s: Column) -> Column:
        before, after = s["before"], s["after"]
        if kind in ADDED_KINDS:  # a neighbour of the kind does not end the context
            chars = F.least(s["start"], F.lit(CONTEXT_CHARS))
            before = text.substr(s["start"] - chars + 1, chars)
            after = text.substr(s["start"] + F.length(s["match"]) + 1, F.lit(CONTEXT_CHARS))
        near = F.lower(F.concat_ws(" ", before, after)).rlike(CONTEXT[kind])
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0)))
        return F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (s["start"] + F.length(s["match"])).alias("stop"),
            F.lit(kind).alias("kind"),
            score.alias("score"),
        )

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(empty) if kind in NEEDS else found


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``spans``: array<struct<start, rank, stop, kind, score>> by start, then kind.

    Base kinds keep every span that its checks confirm. Added kinds (account numbers by
    mod 97, national ids by context) need a score of ``THRESHOLD``.
    """
    rows = docs.select(F.col(id_column), whole_text(text_column).alias("_text"))
    kinds = [_found(kind, F.col("_text")) for kind in BASE_KINDS + ADDED_KINDS]
    return rows.select(id_column, F.array_sort(F.concat(*kinds)).alias("spans"))


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_KINDS))
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return find_personal_data(docs).select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        scores.alias("scores"),
    )
