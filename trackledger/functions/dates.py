"""Free-text German dates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, coarse keywords and tokens that mean "no date".
MONTHS = {
    "januar": 1, "jan": 1, "februar": 2, "feb": 2, "märz": 3, "maerz": 3, "mrz": 3, "mär": 3, "april": 4, "apr": 4,
    "mai": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "oktober": 10, "okt": 10, "november": 11, "nov": 11, "dezember": 12, "dez": 12,
}
KEYWORDS = {
    "anfang": 2, "frühjahr": 4, "fruehjahr": 4, "frühling": 4, "fruehling": 4, "mitte": 7, "sommer": 7, "herbst": 10,
    "ende": 12, "winter": 12,
}
NO_DATE = ("", "-", "–", "—", "‐", "‑", "n/a", "offen", "unbekannt", "k.a.", "k. a.")
ROMAN = ("i", "ii", "iii", "iv", "iiv", "iiiv")
BLANKS = " \t\n\r\f\x0b"
TOKEN = r"\d+|[\p{L}_]+|\s+|[^\d\p{L}_\s]"


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date, null outside 1900 to 2100 or when the day does not exist."""
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(year.between(1900, 2100) & month.between(1, 12) & (day >= 1), F.when(day <= last, F.make_date(year, month, day)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def kind(token: Column) -> Column:
    """One letter for a number or word, a sign for the rest.

    Y: a year from 1900 to 2099, y: other four digits, l: longer, n: three, e: one of 1 to 4,
    d: other one or two digits; Q: "quartal", q: "q", r: a roman number, m: a month, k: a word
    with a keyword, w: other words; a line break or a blank for white space; ? for other signs.
    """
    size = F.length(token)
    number = (
        F.when(size == 4, F.when((token >= "1900") & (token < "2100"), "Y").otherwise("y"))
        .when(size == 1, F.when((token > "0") & (token < "5"), "e").otherwise("d"))
        .when(size == 2, "d")
        .otherwise(F.when(size == 3, "n").otherwise("l"))
    )
    word = F.when(token.isin(*MONTHS), "m").when(token == "q", "q").when(token == "quartal", "Q").when(token.isin(*ROMAN), "r")
    word = word.when(reduce(Column.__or__, [token.contains(k) for k in KEYWORDS]), "k").otherwise("w")
    return (
        F.when(token.isin(" ", "-", ".", "/"), token)
        .when((token >= "0") & (token < ":"), number)
        .when(((token >= "_") & (token < "{")) | token.rlike(r"^\p{L}"), word)
        .when(token.rlike(r"^\s"), F.when(token.contains("\n"), "\n").otherwise(" "))
        .otherwise("?")
    )


@dataclass(frozen=True)
class Reader:
    """A text as numbers, words, white space and single other signs, and their kinds as one string."""

    tokens: Column
    shape: Column

    def at(self, i: Column) -> Column:
        return F.get(self.tokens, i)

    def number(self, i: Column) -> Column:
        return F.substring(self.at(i), 1, 4).cast("int")

    def found(self, form: str, parts: Callable[[Column], tuple[Column, ...]]) -> tuple[Column, Column]:
        """Whether the form occurs, and year, month and day from its first token."""
        start = F.regexp_instr(self.shape, F.lit(form)) - 1
        return self.shape.rlike(form), let(start, lambda i: F.array(*parts(i)))

    def last(self, form: str, i: Column) -> Column:
        """The number that ends the form."""
        return self.number(i + F.length(F.regexp_extract(self.shape, form, 0)) - 1)

    def free(self, sign: str, place: Callable[[Column], Column]) -> Column:
        """The least value of the tokens of a kind that stand free."""
        around = F.concat(F.lit("?"), self.shape, F.lit("?"))
        return F.array_min(F.transform(self.tokens, lambda t, i: F.when(around.substr(i + 1, F.lit(3)).rlike(rf"^\W{sign}\W"), place(t))))


QUARTER_WORD, QUARTER_LETTER, QUARTER_ROMAN = r"\be\s?\.?\s?Q\b.*?[Yyl]", r"\bq\s?e\b.*?[Yyl]", r"\br\s?/\s?[Yy]\b"


def date_of(tokens: Column, shape: Column) -> Column:
    """The date that the shape of a text shows, forms tried from the most exact on."""
    r = Reader(tokens, shape)
    mid = F.lit(15)
    roman = lambda i: F.array_position(F.array(*map(F.lit, ROMAN)), r.at(i)).cast("int")
    listed = lambda words, place: F.get(F.array(*map(F.lit, words.values())), place)
    iso = r.found(r"\b[Yy]-[ed]-[ed]\b", lambda i: (r.number(i), r.number(i + 2), r.number(i + 4)))
    dotted = r.found(r"\b[ed]\.[ed]\.[Yy]\b", lambda i: (r.number(i + 4), r.number(i + 2), r.number(i)))
    worded = r.found(QUARTER_WORD, lambda i: (r.last(QUARTER_WORD, i), r.number(i) * 3 - 1, mid))
    digit = lambda i: F.coalesce(r.at(i + 1).try_cast("int"), r.at(i + 2).try_cast("int"))
    lettered = r.found(QUARTER_LETTER, lambda i: (r.last(QUARTER_LETTER, i), digit(i) * 3 - 1, mid))
    slashed = r.found(QUARTER_ROMAN, lambda i: (r.last(QUARTER_ROMAN, i), F.when(roman(i) <= 4, roman(i)) * 3 - 1, mid))
    monthly = r.found(r"\b[ed][/.][Yy]\b", lambda i: (r.number(i + 2), F.when(r.number(i).between(1, 12), r.number(i)), mid))
    month = r.free("m", lambda t: F.array_position(F.array(*map(F.lit, MONTHS)), t).cast("int"))
    key = F.array_min(F.transform(tokens, lambda t: F.coalesce(*[F.when(t.contains(k), j) for j, k in enumerate(KEYWORDS)])))
    year = r"\b[Yy]\b"
    named = r.found(year, lambda i: (r.number(i), listed(MONTHS, month - 1), mid))
    keyed = r.found(year, lambda i: (r.number(i), listed(KEYWORDS, key), mid))
    bare = F.array(r.free("Y", lambda t: t).cast("int"), F.lit(7), F.lit(1))
    bare_or_named = F.when(shape.rlike(r"\bm\b"), named[1]).when(shape.contains("k"), keyed[1]).otherwise(bare)
    # An unknown roman number and a month over 12 (a null month) leave the text to the forms behind.
    with_month = lambda parts: let(parts, lambda v: F.when(F.get(v, F.lit(1)).isNotNull(), v))
    exact = [F.when(hit, value) for hit, value in (iso, dotted, worded, lettered)]
    loose = [F.when(hit, with_month(value)) for hit, value in (slashed, monthly)]
    parts = F.coalesce(*exact, *loose, F.when(shape.rlike(year), bare_or_named))
    return let(parts, lambda v: safe_date(*[F.get(v, F.lit(j)) for j in range(3)]))


def parse_flexible_date(text: Column) -> Column:
    """Date of a free text: one pass cuts it into tokens, the string of their kinds decides.

    Forms in order: ISO, day.month.year, quarters (mid-quarter; word, q, roman), month and year,
    month names, coarse keywords (mid-month; both with the first year of the text, the first in
    list order when several stand there), earliest bare year (1 July). A form that occurs
    decides even when its date does not exist; month/year with a month over 12 and unknown
    roman numbers give way to later forms. Null for null and for no-date words.
    """

    def read(low: Column) -> Column:
        shape = lambda tokens: F.array_join(F.transform(tokens, kind), "")
        found = let(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), lambda tokens: let(shape(tokens), lambda kinds: date_of(tokens, kinds)))
        return F.when(~low.isin(*NO_DATE), found)

    return F.when(text.isNotNull(), let(F.lower(F.trim(text, F.lit(BLANKS))), read))
