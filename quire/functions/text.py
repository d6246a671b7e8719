"""Column functions over plain and page-marked text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode-aware string trimming sees it: ASCII blanks, the four
# information separators, NEL and every separator category (no-break space too).
WS_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
WS = f"[{WS_CLASS}]"
NON_WS = f"[^{WS_CLASS}]"

# Fixed value: the page marker line, with the 1-based page number as group 1.
PAGE_MARKER = rf"(?md)^=== PAGE (\d+) ==={WS}*$"

ENTRY_ARRAY = "array<struct<page_index:int,body:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Column expressions are trees: an intermediate used five times is otherwise
    evaluated (and compiled) five times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(c: Column) -> Column:
    # The lookbehind makes the trailing branch start only at the head of a blank
    # run, so long inner runs are not rescanned from every position.
    return F.regexp_replace(c, rf"^{WS}+|(?<!{WS}){WS}++\z", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(c.rlike(NON_WS), F.lit(False))


def non_empty(c: Column) -> Column:
    """The value, or null when it is the empty string (blanks count as a value)."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor empty; null when there is none."""
    return F.coalesce(*[non_empty(c) for c in columns])


def stripped_or_null(c: Column) -> Column:
    return non_empty(strip_ws(c))


def squash_ws(c: Column) -> Column:
    """Trim, fold each whitespace run to one blank, lower-case."""
    # A run that is one blank already is not written again.
    return F.lower(F.regexp_replace(strip_ws(c), f"{WS}{{2,}}|[{WS_CLASS}&&[^ ]]", " "))


def head_tail(c: Column, limit: int, separator: str) -> Column:
    """Keep text of at most ``limit`` characters; longer text keeps its two outer halves."""
    half = limit // 2
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(half)), F.lit(separator), F.right(c, F.lit(half)))).otherwise(c)


def has_page_markers(c: Column) -> Column:
    return F.coalesce(c.rlike(PAGE_MARKER), F.lit(False))


def marked_entries(c: Column) -> Column:
    """Split page-marked text into ``array<struct<page_index, body>>``, ordered by page.

    Text before the first marker is dropped and a repeated page number keeps its
    last body. Unmarked text is page 0; blank text gives no entry. All in the row:
    no shuffle, whatever the length of the text.
    """

    def numbered(bodies: Column) -> Column:
        return F.zip_with(
            F.regexp_extract_all(c, F.lit(PAGE_MARKER), F.lit(1)),
            F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))),
            lambda n, b: F.struct((n.try_cast("int") - 1).alias("page_index"), strip_ws(b).alias("body")),
        )

    def in_page_order(entries: Column) -> Column:
        placed = F.transform(entries, lambda e, i: F.struct(e["page_index"].alias("page_index"), i.alias("pos"), e["body"].alias("body")))
        return F.array_sort(F.filter(placed, lambda e: e["page_index"].isNotNull()))

    def last_of_page(ordered: Column) -> Column:
        # Neighbours in page order: an entry stays when the next one is another page.
        marked = F.zip_with(
            ordered,
            F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1))),
            lambda e, nxt: F.when(
                nxt.isNull() | (nxt["page_index"] != e["page_index"]),
                F.struct(e["page_index"].alias("page_index"), e["body"].alias("body")),
            ),
        )
        return F.filter(marked, lambda e: e.isNotNull())

    split_up = let(in_page_order(let(F.split(c, PAGE_MARKER, -1), numbered)), last_of_page)
    whole = F.array(F.struct(F.lit(0).alias("page_index"), strip_ws(c).alias("body")))
    return (
        F.when(is_blank(c), F.array().cast(ENTRY_ARRAY))
        .when(~has_page_markers(c), whole.cast(ENTRY_ARRAY))
        .otherwise(split_up.cast(ENTRY_ARRAY))
    )


def marked_block(page_index: Column, body: Column) -> Column:
    """One page in marked form: marker line, newline, trimmed body."""
    return F.concat(
        F.lit("=== PAGE "), (page_index + 1).cast("string"), F.lit(" ===\n"), strip_ws(F.coalesce(body, F.lit("")))
    )


def pad_pages(entries: Column, n_pages: Column) -> Column:
    """Array of ``n_pages`` bodies; a page without an entry is the empty string.

    ``entries`` is ordered by page and unique, so a map look-up serves each slot.
    """
    by_page = F.map_from_entries(entries)
    slots = F.when(n_pages > 0, F.sequence(F.lit(0), n_pages - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(slots, lambda i: strip_ws(F.coalesce(F.try_element_at(by_page, i), F.lit(""))))


def sentence_count(c: Column) -> Column:
    pieces = F.split(F.coalesce(c, F.lit("")), r"[.!?]+")
    return F.size(F.filter(pieces, lambda p: p.rlike(NON_WS)))


def char_count(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def first_sentences(c: Column, n: int = 3) -> Column:
    """Plain fallback summary: the first ``n`` full-stop pieces."""
    pieces = F.filter(
        F.transform(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), r"\.", -1), strip_ws), lambda p: p != ""
    )
    return let(pieces, lambda p: F.concat(F.array_join(F.slice(p, 1, n), ". "), F.when(F.size(p) > 0, ".").otherwise("")))


def fixed_decimals(c: Column, digits: int) -> Column:
    """Number with exactly ``digits`` decimals, as text."""
    return F.round(c, digits).cast(f"decimal(38,{digits})").cast("string")


def format_qs(c: Column) -> Column:
    """Two decimals, or a dash for a missing score."""
    return F.when(c.isNull() | F.isnan(c), F.lit("—")).otherwise(fixed_decimals(c, 2))


def page_prefix(page_index: Column, page_total: Column) -> Column:
    shown = F.concat(F.lit("Page "), page_index.cast("string"), F.lit("/"), page_total.cast("string"), F.lit(" · "))
    return F.coalesce(F.when(page_total > 1, shown), F.lit(""))


def verdict_label(c: Column) -> Column:
    prefix = "escalation:"
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(F.replace(c, F.lit("_"), F.lit(" ")))


def sorted_runs(ordered: Column) -> Column:
    """Run-length count of a sorted string array: ``array<struct<term, tf>>``, linear in its length."""

    def starts_of(s: Column) -> Column:
        n = F.size(s)
        first_of_run = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(n > 0, first_of_run).otherwise(F.array().cast("array<int>"))

    def runs(s: Column, starts: Column) -> Column:
        following = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
        ends = F.when(F.size(starts) > 0, F.concat(following, F.array(F.size(s)))).otherwise(starts)
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("tf")))

    return let(ordered, lambda s: let(starts_of(s), lambda starts: runs(s, starts)))
