"""Personal data in whole texts [native].

For every kind a regular expression proposes spans, a validator confirms them (Luhn, mod-97, ranges of
numbers and digit counts), and context words near a span adjust its score.  All of it is built-in
DataFrame functions in one pass over the text, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower

#: Context is looked for in so many characters on either side.
WINDOW = 40
#: Matches, and what lies between them, that fill a window: each pair has three characters or more.
NEARBY = 14
#: Pieces of a text whose lengths are summed one by one.
BLOCK = 256
#: What a context word adds to a score, and the score from which an added kind is reported.
CONTEXT_BONUS = 0.3
REPORT_FROM = 0.6


@dataclass(frozen=True)
class Kind:
    """``pattern`` is possessive where giving back could not help, so long runs cost linear time."""

    name: str
    pattern: str
    prior: float
    context: str
    base: bool = True


#: Characters of an IBAN by country (ISO 13616).
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV",
    22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
#: First digits of card numbers of 13 to 15 digits, and how many follow.
PAN_DIGITS = (("3[47]", 13), ("3(?:0[0-5]|[689][0-9])", 11), ("(?:2131|1800)", 11), ("4", 12))
#: A match ends where the country or the issuer says, if a word or number ends there; else where it can.
#: Country and check digits are looked at first, so that most of a text fails at its first letter.
IBAN = (
    r"[A-Z]{2}[0-9]{2}(?:"
    + "".join(rf"(?<=(?:{c})[0-9][0-9])(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])|" for n, c in IBAN_CHARS.items())
    + r"(?:\x20?[A-Z0-9]){11,30})"
)
PAN = "|".join(rf"(?<![0-9]){f}(?:[\x20-]?[0-9]){{{n}}}(?![0-9])" for f, n in PAN_DIGITS) + r"|[0-9](?:[\x20-]?[0-9])++"

#: The contract's patterns and further ones, in the order of the output.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", 0.7, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.8, "phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, 0.7, "iban|bank|account|konto", base=False),
    Kind("pan", PAN, 0.4, "card|visa|amex|credit|payment", base=False),
    Kind("ssn", r"[0-9]++(?:-[0-9]++)++", 0.4, "ssn|social|security|tax", base=False),
)

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    worth = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))
    return F.aggregate(F.transform(F.split(F.reverse(number), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN (spaces allowed) passes the mod-97 check."""
    plain = F.regexp_replace(account, r"\x20", "")
    moved = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c <= "9", (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    n = F.char_length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return n.between(16, 19) & luhn(digits(match))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.char_length(F.regexp_replace(match, r"\x20", "")).between(15, 34) & mod97(match)
    if kind == "pan":
        return n.between(13, 15) & luhn(digits(match))
    if kind == "ssn":
        return match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) < "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _starts(pieces: Column) -> Column:
    """Where each piece's match starts: prefix sums in two levels, so that no long array grows one by one."""

    def summed(blocks: Column, size, kept) -> Column:
        """struct<at,all>: the sum of ``size``, and for each element what ``kept`` gives at the sum before it."""
        none = F.array().cast("array<int>")
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("all")), lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["all"], F.array(kept(acc["at"], x))).alias("all")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda k: F.slice(pieces, k * BLOCK + 1, BLOCK))
    inside = F.transform(blocks, lambda block: summed(block, lambda x: x["gap"] + x["n"], lambda at, x: at + x["gap"]))

    def placed(inside: Column) -> Column:
        before = summed(inside, lambda x: x["at"], lambda at, _: at)["all"]
        return F.flatten(F.zip_with(inside, before, lambda x, o: F.transform(x["all"], lambda v: v + o)))

    return _bound(inside, placed)


def _spans(kind: Kind, text: Column, matches: Column) -> Column:
    """The kind's valid spans.  Only what is valid is located and given a score, in time linear in the text."""

    def piece(between: Column, match: Column) -> Column:
        ends = F.right(between, F.lit(WINDOW)).alias("tail"), F.left(between, F.lit(WINDOW)).alias("head")
        return F.struct(F.char_length(between).alias("gap"), *ends, match.alias("match"), F.coalesce(F.char_length(match), F.lit(0)).alias("n"))

    def around(pieces: Column, i: Column) -> Column:
        """WINDOW characters on either side of a match, from the pieces nearby; of a long piece its end will do."""
        back = F.least(i, F.lit(NEARBY))
        before = F.transform(F.slice(pieces, i - back + 1, back), lambda x: F.concat(x["tail"], F.right(x["match"], F.lit(WINDOW))))
        after = F.transform(F.slice(pieces, i + 2, NEARBY), lambda x: F.concat(x["head"], F.left(F.coalesce(x["match"], F.lit("")), F.lit(WINDOW))))
        left = F.right(F.concat(F.array_join(before, ""), pieces[i]["tail"]), F.lit(WINDOW))
        return F.concat(left, F.lit(" "), F.left(F.array_join(after, ""), F.lit(WINDOW)))

    def span(pieces: Column, starts: Column):
        def at(i: Column) -> Column:
            near = _bound(around(pieces, i), lambda text: ascii_lower(text).rlike(kind.context))
            score = F.round(F.lit(kind.prior) + F.when(near, CONTEXT_BONUS).otherwise(0.0), 2)
            return F.struct(F.lit(kind.name).alias("kind"), starts[i].alias("start"), (starts[i] + pieces[i]["n"]).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        return at

    def found(pieces: Column) -> Column:
        indices = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: pieces[i]["match"].isNotNull() & valid(kind.name, pieces[i]["match"]))
        spans = lambda held: F.when(F.size(held) > 0, _bound(_starts(pieces), lambda starts: F.transform(held, span(pieces, starts)))).otherwise(F.array().cast(SPAN))
        return _bound(indices, spans)

    spans = _bound(F.zip_with(F.split(text, kind.pattern), matches, piece), found)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= REPORT_FROM)
    # Most texts have no valid match: they skip the second look at the text.
    return F.when(F.exists(matches, lambda m: valid(kind.name, m)), spans).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``, the spans of each text by kind as listed, then start (code points, end exclusive).

    Spans of one kind do not overlap; those of different kinds may.  Base kinds are reported whatever
    their score, the others (iban, pan, ssn) from REPORT_FROM.  A null text has no span; an input
    column named ``pii`` is replaced.
    """
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    columns = [c for c in docs.columns if c.lower() != "pii"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    matched = rows.withColumns({k.name: F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in KINDS})
    spans = F.concat(*[_spans(k, text, F.col(k.name)) for k in KINDS])
    return matched.select("row", spans.alias("pii")).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "pii")


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores_text(spans: Column) -> Column:
    """Scores of the spans in hundredths, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
