"""Text extraction: HTML, cells of budget tables, report blocks, scanned pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HTML_LIMIT = 12_000
# Column positions of the budget table, dashes, patterns of the reports.
BUDGET_COLUMNS = {
    "cost_estimate_last_year": 6, "cost_estimate_aktuell": 7, "verausgabt_bis": 11, "bewilligt": 12, "ausgabereste_transferred": 13,
    "veranschlagt": 14, "vorhalten_future": 15,
}
NAME_COLUMN = 3
DASHES = "‐‑‒–—-"
TITLE_LINE = r"(?iu)Kap\.\s*(\d+)[^,\n]*(?:,\s*|\s+)Titel\s+([\d ]+)"
# No letter, digit or underscore before or after, whatever the script.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PLANNING = ("Planung", "planfestgestellt", "Planfeststellungsverfahren", "Entwurfsplanung", "offen")
BUILDING = ("Bau", "Baubeginn", r"im\s+Bau", "Bauarbeiten", "Baumaßnahmen")
COMPLETED = (
    "abgeschlossen", r"in\s+Betrieb", "fertiggestellt", r"in\s+Betrieb\s+genommen", r"Inbetriebnahme\s+erfolgte", r"wurde\s+in\s+Betrieb",
    r"Vorhaben\s+ist\s+abgeschlossen", r"Inbetriebnahme:\s*\d", r"Inbetriebnahme\s+\d{2}/\d{4}",
)
CATEGORIES = {"B.4.1": "laufend", "B.4.2": "neu", "B.4.3": "potentiell"}


def some(c: Column) -> Column:
    return F.when(c != "", c)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def html_to_text(html: Column, limit: int = HTML_LIMIT) -> Column:
    """Visible text: scripts and styles go, tags become blanks, five entities are resolved,
    blanks collapse, three or more line breaks become two; trimmed and cut to ``limit``."""
    text = F.regexp_replace(html, r"(?isu)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n")
    return F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, limit)


def parse_int(value: Column) -> Column:
    """Whole number after dropping points, commas and blanks ("1,5" reads 15); else null."""
    return F.translate(value, "., ", "").try_cast("int")


def parse_float(value: Column) -> Column:
    """Comma as decimal sign, percent sign dropped; a thousands point makes it unreadable."""
    return strip(F.replace(F.translate(value, "%", ""), F.lit(","), F.lit("."))).try_cast("double")


def parse_float_de(value: Column) -> Column:
    """Thousands points dropped, comma as decimal sign."""
    return strip(F.replace(F.translate(value, ".", ""), F.lit(","), F.lit("."))).try_cast("double")


def lines(cell: Column) -> Column:
    """Trimmed non-empty lines of a cell; none for null."""
    out = F.filter(F.transform(F.split(cell, "\n"), strip), lambda x: x != "")
    return F.coalesce(out, F.array().cast("array<string>"))


def nth_line(cell: Column, n: Column | int) -> Column:
    return F.get(lines(cell), F.lit(n) if isinstance(n, int) else n)


def cell(cells: Column, i: int) -> Column:
    return strip(F.get(cells, i))


def joined(cells: Column) -> Column:
    return F.array_join(F.filter(cells, lambda c: c.isNotNull() & (c != "")), " ")


def measures(cells: Column, line: Column) -> list[Column]:
    """The seven amounts of a title row, taken from one line of each multi-line cell."""
    return [parse_int(nth_line(cell(cells, i), line)).alias(name) for name, i in BUDGET_COLUMNS.items()]


def combined_id(text: Column) -> Column:
    """Struct (lfd_nr, finve_nr, plan_nr) of a first cell that may hold all three."""
    t = strip(text)
    # How the source document writes these.
    full = r"^(B\d+|YYY)\s+(\d+)\s+(.+)$"
    plan = strip(F.regexp_extract(t, full, 3))
    plan = F.when(~plan.isin(*DASHES), plan)
    none = F.lit(None).cast("string")
    triple = lambda a, b, c: F.struct(a.alias("lfd_nr"), b.try_cast("int").alias("finve_nr"), c.alias("plan_nr"))
    return (
        F.when(t.rlike(full), triple(F.regexp_extract(t, full, 1), F.regexp_extract(t, full, 2), plan))
        .when(t.rlike(r"^B\d+$"), triple(t, none, none))
        .when(t.rlike(r"^YYY\s+\d+$"), triple(F.lit("YYY"), F.regexp_extract(t, r"^YYY\s+(\d+)$", 1), none))
        .when(t.rlike(r"^B\d+\s+.+$"), triple(F.regexp_extract(t, r"^(B\d+)\s+(.+)$", 1), none, strip(F.regexp_extract(t, r"^(B\d+)\s+(.+)$", 2))))
        .otherwise(triple(none, none, none))
    )


def row_kind(cells: Column) -> Column:
    """Class of a budget table row: header, empty, numbers, main, unnumbered, explanation,
    memo, title, continuation or other; the first that applies."""
    blank = F.lit("")
    seen = F.struct(
        joined(cells).alias("text"),
        F.coalesce(cell(cells, NAME_COLUMN), blank).alias("name"),
        F.coalesce(cell(cells, 0), blank).alias("first"),
        F.translate(F.coalesce(cell(cells, 1), blank), ".", "").try_cast("int").alias("second"),
        combined_id(F.coalesce(cell(cells, 0), blank)).alias("ids"),
    )

    def kind(s: Column) -> Column:
        text, ids = s["text"], s["ids"]
        bullet = F.exists(lines(s["name"]), lambda x: F.substring(x, 1, 1).isin(*DASHES))
        return (
            F.when(text.contains("FinVe") & text.contains("Nr."), "header")
            .when(text == "", "empty")
            .when(ids["lfd_nr"].isNull() & F.translate(s["first"], ".", "").rlike(r"^\d+$"), "numbers")
            .when(ids["finve_nr"].isNotNull() | s["second"].isNotNull(), "main")
            .when(ids["lfd_nr"].isNotNull(), "unnumbered")
            .when(F.lower(s["name"]).startswith("erläuterung:"), "explanation")
            .when(F.lower(text).contains("nachrichtlich:"), "memo")
            .when(text.contains("Kap.") & text.contains("Titel"), "title")
            .when(bullet, "continuation")
            .otherwise("other")
        )

    # The struct is bound once by the lambda; the tests on it do not compute it again.
    return F.transform(F.array(seen), kind)[0]


def project_name(name_cell: Column) -> Column:
    """Name lines joined: section heading dropped, cut before "davon:" and before the note."""
    text = F.regexp_replace(F.coalesce(name_cell, F.lit("")), r"(?iu)^SAMMELVEREINBARUNGEN\s*\n?", "")
    text = F.regexp_replace(text, r"(?isu)\ndavon\s*:.*$", "")
    text = F.regexp_replace(text, r"(?isu)\nUnterlagen\s+entsprechend.*", "")
    return F.array_join(lines(text), " ")


def bullet_items(text: Column) -> Column:
    """Bulleted entries with their continuation lines joined; entries of up to three letters
    and text before the first bullet are dropped."""
    body = F.regexp_replace(text, r"(?iu)^Erläuterung:\s*\n?", "")
    empty = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        starts = F.substring(line, 1, 1).isin(*DASHES)
        rest = strip(F.substr(line, F.lit(2)))
        head, tail = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.element_at(acc, -1)
        grown = F.when(F.size(acc) > 0, F.concat(head, F.array(F.trim(F.concat(tail, F.lit(" "), line))))).otherwise(acc)
        return F.when(starts, F.concat(acc, F.array(rest))).otherwise(grown)

    items = F.aggregate(lines(body), empty, step)
    return F.filter(items, lambda x: F.length(x) > 3)


def inline_titles(cells: Column) -> Column:
    """Title lines after "davon:" as structs; amounts come from the line one further down."""
    name = F.coalesce(cell(cells, NAME_COLUMN), F.lit(""))
    after = F.when(name.rlike(r"(?iu)davon\s*:"), F.regexp_replace(name, r"(?isu)^.*?davon\s*:", "")).otherwise("")
    hits = F.filter(F.split(after, "\n"), lambda x: x.rlike(TITLE_LINE))

    def entry(x: Column, i: Column) -> Column:
        chapter, number = F.regexp_extract(x, TITLE_LINE, 1), F.trim(F.regexp_extract(x, TITLE_LINE, 2))
        return F.struct(
            F.replace(number, F.lit(" "), F.lit("_")).alias("titel_key"),
            chapter.alias("kapitel"),
            number.alias("titel_nr"),
            F.concat(F.lit("Kap. "), chapter, F.lit(", Titel "), number).alias("label"),
            F.lit(False).alias("is_nachrichtlich"),
            *measures(cells, i + 1),
        )

    return F.transform(hits, entry)


def memo_titles(cells: Column) -> Column:
    """Memo lines as structs; amounts come from the same line of each cell."""
    name = F.coalesce(cell(cells, NAME_COLUMN), F.lit(""))
    labels = F.filter(lines(name), lambda x: F.lower(x).startswith("nachrichtlich:"))
    labels = F.when(F.size(labels) > 0, labels).when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))

    def entry(x: Column, i: Column) -> Column:
        return F.struct(
            F.substring(x, 1, 50).alias("titel_key"), F.lit("").alias("kapitel"), F.lit("").alias("titel_nr"), x.alias("label"),
            F.lit(True).alias("is_nachrichtlich"), *measures(cells, i),
        )

    return F.transform(labels, entry)


def title_row(cells: Column) -> Column:
    """A title row of the old layout; the number greedily takes the digits that follow."""
    text = joined(cells)
    pair = r"Titel\s+(\d+)\s+(\d+)"
    key = F.when(text.rlike(pair), F.concat(F.regexp_extract(text, pair, 1), F.lit("_"), F.regexp_extract(text, pair, 2))).otherwise(F.substring(text, 1, 50))
    return F.struct(
        key.alias("titel_key"),
        F.regexp_extract(text, r"Kap\.\s*(\d+)", 1).alias("kapitel"),
        F.trim(F.regexp_extract(text, r"Titel\s+([\d ]+)", 1)).alias("titel_nr"),
        F.coalesce(some(cell(cells, NAME_COLUMN)), F.substring(text, 1, 200)).alias("label"),
        F.lit(False).alias("is_nachrichtlich"),
        *measures(cells, F.lit(0)),
    )


def orphan_names(page_text: Column) -> Column:
    """Structs (name, finve_nr) of the numbered pooled agreements in raw page text."""
    # How the source document writes these.
    pattern = r"(?m)^YYY\s+(\d+)\s+(.+?)\s+20\d\d\b"
    whole = F.regexp_extract_all(page_text, F.lit(pattern), 0)

    def pair(x: Column) -> Column:
        name = F.regexp_replace(F.trim(F.regexp_extract(x, pattern, 2)), r"(?iu)^SAMMELVEREINBARUNGEN\s*\n?", "")
        return F.struct(F.lower(F.trim(name)).alias("name"), F.regexp_extract(x, pattern, 1).try_cast("int").alias("finve_nr"))

    return F.transform(whole, pair)


def status_flags(text: Column) -> list[Column]:
    """Three independent flags: planning, building, completed."""
    safe = F.coalesce(text, F.lit(""))
    low = F.lower(safe)

    def says(starts: tuple[str, ...], wordings: tuple[str, ...]) -> Column:
        # A plain search goes ahead of the pattern, by letters that have no other form than upper and lower case.
        met = reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in starts])
        first = "".join(sorted({w[0] for w in wordings}))
        return met & safe.rlike(f"(?iu)(?=[{first}])" + WORD_START + "(?:" + "|".join(wordings) + ")" + WORD_END)

    return [
        says(("planu", "planf", "offen"), PLANNING).alias("status_planung"), says(("bau",), BUILDING).alias("status_bau"),
        says(("abge", "betr", "fert"), COMPLETED).alias("status_abgeschlossen"),
    ]


def body_lines(text: Column) -> Column:
    """Lines that are no entries of a table of contents (those have spaced dots)."""
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"\.\s\."))


def contents_entry(line: Column) -> Column:
    """Struct (section, name) of a contents line, null otherwise."""
    # How the source document writes these.
    pattern = r"^(B[\s.]4\.[123]\.\d+)\s+(.+)"
    name = F.regexp_replace(F.regexp_extract(line, pattern, 2), r"\s*\.[\.\s]+(\d+)\s*$", "")
    name = F.trim(F.regexp_replace(name, WORD_START + r"L\s+fd\.", "Lfd."))
    section = F.replace(F.regexp_extract(line, pattern, 1), F.lit(" "), F.lit("."))
    return F.when(line.rlike(pattern) & (name != ""), F.struct(section.alias("section"), name.alias("name")))


def section_category(section: Column) -> Column:
    parent = F.substring_index(section, ".", 3)
    out = F.lit("abgeschlossen")
    for k, v in CATEGORIES.items():
        out = F.when(parent == k, v).otherwise(out)
    return out


def section_number(section: Column) -> Column:
    return F.element_at(F.split(section, r"\."), -1)


def tidy_none(text: Column) -> Column:
    """"Keine" surrounded by dashes, blanks or commas becomes just that."""
    return F.when(text.rlike(r"(?iu)^[\s\-–,\.]*Keine[\s\-–,\.]*$"), F.lit("Keine")).otherwise(text)


def key_figures(text: Column) -> list[Column]:
    """Length in km, speed, cost in millions."""
    grab = lambda p: some(F.regexp_extract(text, p, 1))
    # Wordings of the report.
    return [
        parse_float_de(grab(r"(?iu)Streckenl[äa]nge.*?(\d[\d,.]*)\s*km")).alias("strecklaenge"),
        grab(r"(?iu)Geschwindigkeit.*?(\d+(?:[/\-–]\d+)?)\s*km/h").alias("geschwindigkeit"),
        parse_float_de(grab(r"(?iu)Gesamtkosten.*?(\d[\d,.]*)\s*Mio")).alias("gesamtkosten"),
    ]


def paper_number(text: Column) -> Column:
    return some(F.regexp_extract(F.substring(text, 1, 8000), r"(?iu)Drucksache\s+([\d/]+)", 1))


def report_date(text: Column) -> Column:
    """First day.month.year in the first 8000 characters as ISO text."""
    head, pattern = F.substring(text, 1, 8000), r"(\d{2})[.\-/](\d{2})[.\-/](\d{4})"
    part = lambda g: F.regexp_extract(head, pattern, g)
    return F.when(head.rlike(pattern), F.concat_ws("-", part(3), part(2), part(1)))


def two_columns(x0s: Column, boundary: float = 260.0, share: float = 0.15) -> Column:
    """Whether enough words of a page start right of the boundary."""
    right = F.size(F.filter(x0s, lambda x: x > boundary))
    return F.coalesce((F.size(x0s) > 0) & (right >= F.size(x0s) * F.lit(share)), F.lit(False))


def reading_order(words: Column, boundary: float = 260.0, tolerance: float = 3.0) -> Column:
    """Text of a page from ``words``, an array of structs (x0, top, text): lines from top to bottom,
    words from left to right; on a page of two columns the left one comes first.

    Words stand in one line when their tops, in units of the tolerance, round to one even-rounded
    number; a word at the boundary belongs to the left. Equal places keep the order of the array.
    A page whose words all stand right begins with a line break; no words, and null, are empty text.
    """
    two = two_columns(F.transform(words, lambda w: w["x0"]), boundary)

    def placed(w: Column, i: Column) -> Column:
        column = F.when(two & (w["x0"] > boundary), 1).otherwise(0)
        return F.struct(column.alias("column"), F.bround(w["top"] / tolerance, 0).alias("line"), w["x0"].alias("x0"), i.alias("i"), w["text"].alias("text"))

    def joined_words(rows: Column) -> Column:
        def with_gap(w: Column, i: Column) -> Column:
            last = F.get(rows, i - 1)
            same = (last["column"] == w["column"]) & (last["line"] == w["line"])
            gap = F.when(i == 0, F.when(w["column"] == 1, "\n").otherwise("")).when(same, " ").otherwise("\n")
            return F.concat(gap, F.coalesce(w["text"], F.lit("")))

        return F.array_join(F.transform(rows, with_gap), "")

    # The sorted words are bound once by the lambda.
    return F.coalesce(F.transform(F.array(F.array_sort(F.transform(words, placed))), joined_words)[0], F.lit(""))


def page_to_text(markdown: Column, tables: Column, header: Column | None = None, footer: Column | None = None) -> Column:
    """Page text with table placeholders replaced by their contents and images dropped.

    ``tables`` is an array of (id, content)."""
    text = F.aggregate(tables, F.coalesce(markdown, F.lit("")), lambda acc, t: F.replace(acc, F.concat(F.lit("["), t["id"], F.lit("]("), t["id"], F.lit(")")), t["content"]))
    text = F.trim(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""))
    parts = [some(F.trim(p)) for p in (header, text, footer) if p is not None]
    return F.concat_ws("\n\n", *parts)


def merge_value(new: Column, old: Column) -> Column:
    """A value from the extraction model replaces the stored one unless it is null."""
    return F.coalesce(new, old)


def merge_openings(new: Column, old: Column) -> Column:
    """As ``merge_value``, for the partial openings: a bulleted "Keine" says that there are none."""
    # Fixed value: how the answers write it.
    return F.when(new.isNull(), old).when(~new.rlike(r"^\s*[-–]\s*[Kk]eine\.?\s*$"), new)


def python_truth(text: Column) -> Column:
    """Truth of a JSON scalar by the rules of the source: only empty, zero and false-like
    literals are false; the word "false" in quotes is true."""
    return F.when(text.isNull(), None).otherwise(~text.isin("", "0", "0.0", "false", "null", '""', "[]", "{}"))
