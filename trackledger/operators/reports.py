"""Progress reports: from the whole text of a report to one typed row per project entry.

A report stays in its row until its blocks are known; one explode then gives a row per entry,
so nothing is shuffled and a report of any length is worked on by one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.functions import text as T
from trackledger.functions.tables import LABELS, let, remaining_text, section_table, strip

# How the report writes its headings and labels, and how much of a block it keeps.
RAW_LIMIT = 30_000
BODY_FROM = r"(?iu)^\s*B\s+Schienenwege"
BODY_TO = r"(?iu)^\s*C\s+Bundesfernstra"
CONTENTS_FROM = r"B\s+Schienenwege"
SPACED_DOTS = r"\.\s\."
HEADING = r"^(?:#+\s*)?(B[\s.]4\.[123]\.\d+)(?![\p{L}\p{N}_])(.*)$"
GOALS, DONE_AND_PLANNED, DONE, TO_DO, WORKS, OPENINGS, STATE, DATES, FIGURES = LABELS[:9]
TABLE_HEAD = r"Nr\s*\.\s*PFA(?s:.{0,60})[Öö]rtlichkeit"
BLOCKS = {
    "verkehrliche_zielsetzung": GOALS,
    "durchgefuehrte_massnahmen": f"{DONE_AND_PLANNED}|{DONE}",
    "noch_umzusetzende_massnahmen": TO_DO,
    "bauaktivitaeten": WORKS,
    "teilinbetriebnahmen": OPENINGS,
    "planungsstand": STATE,
    "termine": DATES,
    "projektkenndaten": FIGURES,
    "pfa": TABLE_HEAD,
}
#: Letters of each that have no other form than upper and lower case: a plain search goes ahead of the pattern.
SIGNS = {
    "verkehrliche_zielsetzung": "etzung", "durchgefuehrte_massnahmen": "durchgef", "noch_umzusetzende_massnahmen": "umzu", "bauaktivitaeten": "baua",
    "teilinbetriebnahmen": "betr", "planungsstand": "planung", "termine": "term", "projektkenndaten": "enndaten", "pfa": "pfa",
}
NAME_ENDS = (GOALS, FIGURES, TO_DO, DONE_AND_PLANNED, DONE, WORKS, OPENINGS, "Projektstand")
TEXTS = ("verkehrliche_zielsetzung", "durchgefuehrte_massnahmen", "noch_umzusetzende_massnahmen", "bauaktivitaeten", "teilinbetriebnahmen")


def first_line(lines: Column, pattern: str, contents: bool = True) -> Column:
    """Place of the first line with the pattern, from 0; with ``contents`` false, lines of the
    table of contents (those with spaced dots) don't count. Null without one."""
    fits = lambda x: x.rlike(pattern) if contents else x.rlike(pattern) & ~x.rlike(SPACED_DOTS)
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(fits(x), i)), lambda i: i.isNotNull()))


def blocks_of(body: Column, followed: Column) -> Column:
    """Array of (seq, block): each heading owns the lines up to the next one."""
    heads = F.filter(F.transform(body, lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull())

    def cut_blocks(at: Column) -> Column:
        def block(h: Column, k: Column) -> Column:
            after = F.get(at, k + 1)
            own = F.slice(body, h + 1, F.coalesce(after, F.size(body)) - h)
            tail = F.when(after.isNotNull() | followed, F.lit("\n")).otherwise("")
            return F.struct(k.alias("seq"), F.concat(F.array_join(own, "\n"), tail).alias("block"))

        return F.transform(at, block)

    return let(heads, cut_blocks)


def label_slices(block: Column) -> Column:
    """Array of (key, text) in the order of the text: what stands between the line of a label's
    first occurrence and the next label; empty slices are left out."""

    def hit(key: str, pattern: str, low: Column, plain: Column) -> Column:
        # One search, whose place counts characters beyond the basic plane twice; where there are any, what stands before is measured.
        before = F.length(F.regexp_extract(block, rf"(?isu)^(.*?)(?-s:{pattern})", 1))
        at = let(F.regexp_instr(block, F.lit(f"(?iu){pattern}")), lambda i: F.when((i == 0) | plain, i).otherwise(before + 1))
        return F.when(F.contains(low, F.lit(SIGNS[key])), let(at, lambda i: F.when(i > 0, F.struct(i.alias("at"), F.lit(key).alias("key")))))

    found_in = lambda x: F.array_sort(F.filter(F.array(*[hit(k, p, x["low"], x["plain"]) for k, p in BLOCKS.items()]), lambda h: h.isNotNull()))
    hits = let(F.struct(F.lower(block).alias("low"), (~block.rlike(r"[\x{10000}-\x{10FFFF}]")).alias("plain")), found_in)

    def cut_slices(found: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            line_end = F.position(F.lit("\n"), block, h["at"])
            begin = F.when(line_end > 0, line_end + 1).otherwise(h["at"])
            end = F.coalesce(F.get(found, i + 1)["at"], F.length(block) + 1)
            return F.struct(h["key"].alias("key"), strip(F.substr(block, begin, F.greatest(end - begin, F.lit(0)))).alias("text"))

        return F.filter(F.transform(found, one), lambda s: s["text"] != "")

    return let(hits, cut_slices)


def largest_pipe_table(text: Column) -> Column:
    """The longest run of lines that begin with a pipe, the first of equals; null without one."""
    gap = "\u0000"
    marked = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(r"^\|."), x).otherwise(gap))
    runs = F.transform(F.split(F.array_join(marked, "\n"), gap), lambda r: F.regexp_replace(r, r"^\n", ""))
    sized = F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("first"), r.alias("run")))
    return let(strip(F.array_max(F.filter(sized, lambda s: s["run"].startswith("|")))["run"]), T.some)


def heading_name(line: Column) -> Column:
    """Project name on a heading line, without what the right column left on it."""
    ends = "|".join(NAME_ENDS)
    return strip(F.regexp_replace(strip(F.regexp_extract(line, HEADING, 2)), rf"(?isu)\s+(?:{ends}).*$", ""))


def report_entries(reports: DataFrame, whole_text: bool = False) -> DataFrame:
    """One row per project entry of ``reports(report_id, text)``.

    The rail part runs from its first heading outside the table of contents to that of the next
    part; without such a heading, or with ``whole_text``, the whole text counts. Names come from
    the table of contents (the later of equal sections), else from the heading. A block gives its
    labelled texts, key figures, status flags, section table, the longest pipe table as it
    stands and what remains. Entries that are only completed gather all texts in one field;
    completed ones with other states add the planning state to it. A null or empty text, and one
    without entries, gives no rows; further columns of ``reports`` are not used.
    """
    lines = reports.select("report_id", F.split("text", "\n").alias("lines"))
    none = F.lit(None).cast("int")
    stop = none if whole_text else first_line(F.col("lines"), BODY_TO, contents=False)
    bounds = lines.select("*", first_line(F.col("lines"), CONTENTS_FROM).alias("listed"), first_line(F.col("lines"), BODY_FROM, contents=False).alias("content"), stop.alias("stop"))
    bounds = bounds.withColumn("start", none if whole_text else F.col("content"))
    stop = F.when(F.col("start").isNotNull(), F.col("stop"))
    size = F.coalesce(stop, F.size("lines")) - F.coalesce("start", F.lit(0))
    toc = F.slice("lines", F.coalesce("listed", F.lit(0)) + 1, F.coalesce(F.greatest(F.col("content") - F.col("listed"), F.lit(0)), F.lit(0)))
    parts = bounds.select(
        "report_id",
        F.filter(F.transform(toc, T.contents_entry), lambda e: e.isNotNull()).alias("contents"),
        F.slice("lines", F.coalesce("start", F.lit(0)) + 1, F.greatest(size, F.lit(0))).alias("body"),
        stop.isNotNull().alias("followed"),
    )
    blocks = parts.select("report_id", "contents", F.inline(blocks_of(F.col("body"), F.col("followed"))))
    head = F.substring_index("block", "\n", 1)
    section = F.regexp_replace(F.regexp_extract(head, HEADING, 1), r"\s", ".")
    sliced = blocks.select(
        "report_id", "seq", "contents", "block", section.alias("vib_section"), head.alias("head"), label_slices(F.col("block")).alias("slices"), F.substring("block", 1, RAW_LIMIT).alias("raw_text")
    )
    listed = let(F.filter("contents", lambda e: e["section"] == F.col("vib_section")), lambda x: F.get(x, F.size(x) - 1)["name"])
    by_key = F.map_from_entries("slices")
    named = sliced.select(
        "report_id", "seq", "vib_section", "raw_text", F.coalesce(listed, heading_name(F.col("head"))).alias("vib_name_raw"),
        remaining_text(F.col("block"), F.transform("slices", lambda s: s["text"])).alias("sonstiges"), by_key.alias("m"),
    )
    parsed = named.select(
        "report_id", "seq", "vib_section", "vib_name_raw", "raw_text", "sonstiges",
        T.section_number(F.col("vib_section")).alias("vib_lfd_nr"), T.section_category(F.col("vib_section")).alias("category"),
        *[T.tidy_none(F.col("m")[k]).alias(k) for k in TEXTS], F.col("m")["planungsstand"].alias("planungsstand"),
        *T.key_figures(F.col("m")["projektkenndaten"]), *T.status_flags(F.col("raw_text")),
        section_table(F.col("m")["pfa"]).alias("pfa_entries"), largest_pipe_table(F.col("m")["pfa"]).alias("pfa_raw_markdown"),
    )
    return folded(parsed)


def folded(entries: DataFrame) -> DataFrame:
    """Completed entries: texts gathered, or the planning state added to what was done."""
    opened = F.forall("pfa_entries", lambda e: F.coalesce(e["inbetriebnahme"], F.lit("")) != "")
    done = F.col("status_abgeschlossen") | ((F.size("pfa_entries") > 0) & opened)
    flagged = entries.withColumn("status_abgeschlossen", done)
    only = F.col("status_abgeschlossen") & ~F.col("status_planung") & ~F.col("status_bau")
    was = F.col("durchgefuehrte_massnahmen")
    every = T.some(F.concat_ws("\n\n", *TEXTS, "planungsstand", "sonstiges"))
    more = F.concat_ws("\n\n", was, "planungsstand")
    merged = F.when(only, every).when(F.col("status_abgeschlossen") & F.col("planungsstand").isNotNull(), more).otherwise(was)
    cleared = {c: F.when(~only, F.col(c)) for c in (*TEXTS, "sonstiges") if c != "durchgefuehrte_massnahmen"}
    return flagged.withColumns({"durchgefuehrte_massnahmen": merged, **cleared})
