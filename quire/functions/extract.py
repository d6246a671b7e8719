"""Extraction of contact details, amounts, dates and class fields from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.dims import ORDINAL_WORDS
from quire.functions.text import NON_WS, let, strip_ws

# --- fixed values: patterns and word lists ------------------------------------
# Patterns are tried at every place of a text, so each tells first, at the cost of one character, where it cannot begin. An address
# begins only at the head of its run of letters, or where the last match ended: from a later place it would from there too.
EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?U)(?=[+(\d])(?:\+?\d{1,3}[\s.-]?)?\(?\d{3,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
URL = r"(?U)https?://[^\s<>\"]+"
MONEY = r"(?iU)(?=[UEGI$€£₹])(?:USD|EUR|GBP|INR|\$|€|£|₹)\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d{1,2})?"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_ORD = "(?:st|nd|rd|th)?"
DATE = (
    r"(?iU)(?=[\dJFMASOND])\b(?:"
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\d{4}[/-]\d{1,2}[/-]\d{1,2}"
    rf"|\d{{1,2}}{_ORD}\s+{_MON},?\s+\d{{2,4}}"
    rf"|{_MON}\s+\d{{1,2}}{_ORD},?\s+\d{{2,4}}"
    r")\b"
)
IDENTIFIER = r"(?iU)(?=[IPRN#])\b(?:INV|PO|REF|ID|NO|#)[\s:#-]*([A-Z0-9-]{4,})\b"
YEAR = r"(?U)(?=[12])\b(?:19|20)\d{2}\b"
KEYWORD = r"(?U)(?=[A-Z])\b[A-Z][a-zA-Z]{3,}\b"
ASSEMBLY_DIGIT = r"(?iU)(?=\d)\b(\d{1,3})(?:st|nd|rd|th)?\s+(?:Legislative\s+)?Assembly\b"
SESSION_DIGIT = r"(?iU)(?=[S\d])(?:\bSession[-\s]*(\d{1,3})\b|\b(\d{1,3})(?:st|nd|rd|th)?\s+Session\b)"
# A phrase that fails from the head of its run of letters fails from every later place in it. So these begin only at the head of a
# run, or where the last match ended: what they find is the same as without that, but a run is read once and not from each place.
ASSEMBLY_WORDS = r"(?iU)(?:\G|(?<![A-Za-z\- ]))(?>[A-Za-z\- ]*?\b)([A-Za-z\- ]+?)\s+(?:Legislative\s+)?Assembly\b"
SESSION_WORDS = r"(?iU)(?:\G|(?<![A-Za-z\- ])|(?=\()|(?= *[\s&&[^ ]]))\(?\s*([A-Za-z\- ]+?)\s+Session\s*\)?"
ASSEMBLY_FILLER = r"(?iU)\b(the|hon\.?ble|honourable|honorable|of|state|mizoram|legislative)\b"
SESSION_FILLER = r"(?iU)\b(the|of|hon\.?ble|honourable|honorable)\b"
PART = r"(?iU)(?=P)\bPart\s*-?\s*(I{1,3}|IV|V|1|2|3)\b"
PART_ROMAN = {"1": "I", "2": "II", "3": "III"}
SELECT_ROMAN = ["i", "ii", "iii"]
HEAD_CHARS = 8000
TOP_KEYWORDS = 8
# --- end of fixed values -------------------------------------------------------

# Two-digit years lie within 50 years of this one, so results do not change over time.
PIVOT_YEAR = 2025


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def distinct_matches(c: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches in sorted order."""
    return F.sort_array(F.array_distinct(_all(c, pattern, group)))


def emails(c: Column) -> Column:
    return distinct_matches(c, EMAIL)


def phones(c: Column) -> Column:
    return distinct_matches(c, PHONE)


def urls(c: Column) -> Column:
    return distinct_matches(c, URL)


def amounts(c: Column) -> Column:
    return distinct_matches(c, MONEY)


def identifiers(c: Column) -> Column:
    return distinct_matches(c, IDENTIFIER, 1)


def date_strings(c: Column) -> Column:
    return distinct_matches(c, DATE)


def keyword_tokens(c: Column) -> Column:
    return _all(c, KEYWORD)


def normalize_date(raw: Column, pivot_year: int = PIVOT_YEAR) -> Column:
    """ISO date of one matched date string, null when it names no real day.

    Numeric dates are month first, swapped when the first number cannot be a month;
    a first number over 31 is a year.
    """
    triple = r"^(\d{1,4})[/-](\d{1,2})[/-](\d{1,4})$"
    day_month = r"^(\d{1,2})\s+([a-z]+),?\s+(\d{2,4})$"
    month_day = r"^([a-z]+)\s+(\d{1,2}),?\s+(\d{2,4})$"
    months = F.create_map(
        *[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)],
        *[F.lit(x) for i, m in enumerate(MONTH_NAMES) if m not in MONTHS for x in (m, i + 1)],
        F.lit("sept"), F.lit(9),
    )

    def number(c: Column) -> Column:
        return c.try_cast("int")

    def groups(plain: Column, pattern: str, *names: str) -> Column:
        return F.when(
            plain.rlike(pattern), F.struct(*[F.regexp_extract(plain, pattern, i + 1).alias(n) for i, n in enumerate(names)])
        )

    def numeric(t: Column) -> Column:
        """First number leads as a year, else is the month, unless it cannot be one."""
        year_led = (F.length(t["a"]) > 2) | (number(t["a"]) > 31)
        swapped = number(t["a"]) > 12
        return F.struct(
            F.when(year_led, t["a"]).otherwise(t["c"]).alias("y"),
            F.when(year_led | swapped, number(t["b"])).otherwise(number(t["a"])).alias("m"),
            F.when(year_led, number(t["c"])).when(swapped, number(t["a"])).otherwise(number(t["b"])).alias("d"),
        )

    def named(t: Column) -> Column:
        flipped = (number(t["d"]) > 31) & (F.length(t["y"]) == 2)
        return F.struct(
            F.when(flipped, t["d"]).otherwise(t["y"]).alias("y"),
            F.try_element_at(months, t["m"]).alias("m"),
            number(F.when(flipped, t["y"]).otherwise(t["d"])).alias("d"),
        )

    def full_year(ymd: Column) -> Column:
        year = number(ymd["y"])
        near = year + 2000
        close = F.when(near >= pivot_year + 50, near - 100).when(near < pivot_year - 50, near + 100).otherwise(near)
        return F.when(F.length(ymd["y"]) <= 2, close).otherwise(year)

    def iso(ymd: Column) -> Column:
        year = full_year(ymd)
        text = F.concat(
            F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(ymd["m"].cast("string"), 2, "0"), F.lit("-"),
            F.lpad(ymd["d"].cast("string"), 2, "0"),
        )
        return let(F.when(year > 0, text), lambda t: F.when(t.try_cast("date").isNotNull(), t))

    def parse(plain: Column) -> Column:
        by_name = F.coalesce(groups(plain, day_month, "d", "m", "y"), F.when(
            plain.rlike(month_day),
            F.struct(*[F.regexp_extract(plain, month_day, i).alias(n) for n, i in (("d", 2), ("m", 1), ("y", 3))]),
        ))
        ymd = F.coalesce(let(groups(plain, triple, "a", "b", "c"), lambda t: F.when(t.isNotNull(), numeric(t))),
                         let(by_name, lambda t: F.when(t.isNotNull(), named(t))))
        return let(ymd, iso)

    return let(F.regexp_replace(F.lower(strip_ws(raw)), r"(\d)(st|nd|rd|th)\b", "$1"), parse)


def dates(c: Column, pivot_year: int = PIVOT_YEAR) -> Column:
    """Distinct date strings with their ISO form."""
    return F.transform(
        date_strings(c), lambda r: F.struct(r.alias("raw"), normalize_date(r, pivot_year).alias("iso"))
    )


def coerce_date(value: Column, pivot_year: int = PIVOT_YEAR) -> Column:
    """A whole value that is a date, or the first date inside it."""
    return F.get(
        F.filter(
            F.transform(F.array(value, _first(value, DATE)), lambda v: normalize_date(v, pivot_year)), lambda d: d.isNotNull()
        ),
        F.lit(0),
    )


def coerce_year(value: Column) -> Column:
    return _first(value, YEAR)


def _ordinal(phrase: Column) -> Column:
    """Number of an ordinal phrase: the whole phrase, else its last word."""
    words = F.create_map(*[F.lit(x) for item in ORDINAL_WORDS.items() for x in item])
    return let(
        F.lower(strip_ws(phrase)),
        lambda t: F.coalesce(F.try_element_at(words, t), F.try_element_at(words, F.regexp_extract(t, rf"({NON_WS}+)\z", 1))),
    )


def _numbered(head: Column, word: str, digit: Column, words_pattern: str, filler: str) -> Column:
    spelled = F.filter(
        F.transform(_all(head, words_pattern, 1), lambda p: _ordinal(F.regexp_replace(strip_ws(p), filler, " "))),
        lambda n: n.isNotNull(),
    )
    # The lazy word pattern is costly on text that never names the thing.
    named = F.contains(F.lower(head), F.lit(word))
    return F.when(named, F.coalesce(digit.try_cast("int"), F.get(spelled, F.lit(0))))


def assembly_number(head: Column) -> Column:
    return _numbered(head, "assembly", _first(head, ASSEMBLY_DIGIT, 1), ASSEMBLY_WORDS, ASSEMBLY_FILLER)


def session_number(head: Column) -> Column:
    digit = F.coalesce(_first(head, SESSION_DIGIT, 1), _first(head, SESSION_DIGIT, 2))
    return _numbered(head, "session", digit, SESSION_WORDS, SESSION_FILLER)


def bulletin_part(head: Column) -> Column:
    token = F.upper(_first(head, PART, 1))
    roman = F.create_map(*[F.lit(x) for item in PART_ROMAN.items() for x in item])
    return F.concat(F.lit("Bulletin Part "), F.coalesce(F.try_element_at(roman, token), token))


def select_match(value: Column, options: Column, strict: bool = False) -> Column:
    """Option a free value stands for.

    Equal but for case; else equal digits; else, after dropping "part" and edge
    dashes, contained in an option. The published behaviour gives the *first* option
    for any other non-empty value; ``strict`` gives null there.
    """

    def digits_of(c: Column) -> Column:
        return F.regexp_replace(c, r"[^\p{Nd}]", "")

    def match(v: Column) -> Column:
        s, digits, low = v["s"], v["digits"], v["low"]
        roman = low.isin(SELECT_ROMAN)
        by_case = F.get(F.filter(options, lambda o: F.lower(o) == F.lower(s)), F.lit(0))
        by_digits = F.get(F.filter(options, lambda o: (digits != "") & (digits_of(o) == digits)), F.lit(0))
        contained = F.get(
            F.filter(
                options,
                lambda o: F.contains(F.lower(o), low)
                | (roman & F.contains(F.replace(F.lower(o), F.lit("bulletin part "), F.lit("")), low))
                | (F.lit(not strict) & ~roman),
            ),
            F.lit(0),
        )
        return F.when(s != "", F.coalesce(by_case, by_digits, F.when(low != "", contained)))

    def prepare(s: Column) -> Column:
        low = F.regexp_replace(strip_ws(F.replace(F.lower(s), F.lit("part"), F.lit(""))), "^[- ]+|[- ]+$", "")
        return F.struct(s.alias("s"), digits_of(s).alias("digits"), low.alias("low"))

    return let(let(strip_ws(value), prepare), match)


def coerce_field(value: Column, kind: Column, options: Column, strict: bool = False) -> Column:
    """A model's value brought to the field's type; null when it does not fit."""
    return (
        F.when(kind == "select", select_match(value, options, strict))
        .when(kind == "date", coerce_date(value))
        .when(kind == "year", coerce_year(value))
        .otherwise(F.nullif(strip_ws(value), F.lit("")))
    )


def heuristic_field(name: str, head: Column) -> Column | None:
    """Pattern-only value of the schema fields that have one."""
    makers = {
        "Date": lambda: normalize_date(_first(head, DATE)),
        "Year": lambda: _first(head, YEAR),
        "Assembly": lambda: assembly_number(head).cast("string"),
        "Session": lambda: F.concat(F.lit("Session "), session_number(head).cast("string")),
        "Bulletin Parts": lambda: bulletin_part(head),
    }
    return makers[name]() if name in makers else None
