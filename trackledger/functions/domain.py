"""Ordered enums and confidence: the vocabulary of the observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enum members in order, trust per source, tuning constants.
MAIN_PHASES = ("NICHT_GESTARTET", "VORPLANUNG", "GENEHMIGUNGSPLANUNG", "BAU", "IN_BETRIEB")
PARALLEL_STATES = ("OFFEN", "LAEUFT", "ABGESCHLOSSEN")
TRUST = {"MANUELL": 0.9, "BAUPORTAL": 0.8, "FINVE": 0.7, "FULDA_RUNDE": 0.7, "VIB": 0.6, "MEDIEN": 0.4}
OTHER_TRUST = 0.5
HALF_LIFE_DAYS = 365
RECENCY_FLOOR = 0.3
NO_DATE_RECENCY = 0.6
CREDIBLE = 0.15
POOLED_CONFIDENCE = 0.35
CATEGORY_PHASE = {
    "IN_LPH_1_2": "VORPLANUNG",
    "IN_LPH_3_4": "GENEHMIGUNGSPLANUNG",
    "COMPLETED_LPH_1_2": "GENEHMIGUNGSPLANUNG",
    "COMPLETED_LPH_3_4": "BAU",
    "HAS_BAUFINVE": "BAU",
}


def one_of(value: Column, pairs: dict, default=None) -> Column:
    """Lookup in a small literal table; null for keys it lacks."""
    out = F.lit(default)
    for k, v in reversed(list(pairs.items())):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def phase_order(phase: Column) -> Column:
    return one_of(phase, {p: i for i, p in enumerate(MAIN_PHASES)})


def phase_name(order: Column) -> Column:
    return one_of(order, dict(enumerate(MAIN_PHASES)))


def state_order(state: Column) -> Column:
    return one_of(state, {p: i for i, p in enumerate(PARALLEL_STATES)})


def state_name(order: Column) -> Column:
    return one_of(order, dict(enumerate(PARALLEL_STATES)))


def recency_decay(observed: Column, today: Column) -> Column:
    """1 for today or later, halved per 365 days down to the floor; flat without a date."""
    age = F.datediff(today, observed)
    decay = F.greatest(F.lit(RECENCY_FLOOR), F.pow(F.lit(0.5), age / F.lit(float(HALF_LIFE_DAYS))))
    return F.when(observed.isNull(), F.lit(NO_DATE_RECENCY)).when(age <= 0, F.lit(1.0)).otherwise(decay)


def effective_confidence(confidence: Column, source: Column, observed: Column, today: Column) -> Column:
    """The explicit confidence (zero counts), else trust of the source times recency."""
    return F.coalesce(confidence, one_of(source, TRUST, OTHER_TRUST) * recency_decay(observed, today))


def pooled_phase(name: Column) -> Column:
    """Phase of a pooled agreement, from the work-phase marker in its name only."""
    low = F.lower(name)
    tight = F.regexp_replace(low, r"\s*/\s*", "/")
    return F.when(
        low.contains("lph"),
        F.when(tight.contains("1/2"), "VORPLANUNG").when(tight.contains("3/4"), "GENEHMIGUNGSPLANUNG"),
    )


def portal_phase(status: Column) -> Column:
    """Phase of a portal record; mixed and umbrella entries have none."""
    low = F.lower(status)
    return (
        F.when(low.contains("gemischt") | low.contains("gesamtprojekt"), None)
        .when(low.contains("bauphase"), "BAU")
        .when(low.contains("planungsphase"), "VORPLANUNG")
    )


def category_phase(category: Column) -> Column:
    return one_of(F.upper(F.trim(category)), CATEGORY_PHASE)


def known_phase(value: Column) -> Column:
    """The value if it is a main phase exactly, else null."""
    return F.when(value.isin(*MAIN_PHASES), value)


def tidy_phase(value: Column) -> Column:
    """Trimmed and upper-cased main phase, null when it is none."""
    return known_phase(F.upper(F.trim(value)))


def strongest_phase(planning: Column, building: Column, completed: Column) -> Column:
    return F.when(completed, "IN_BETRIEB").when(building, "BAU").when(planning, "VORPLANUNG")


def media_note(publication: Column, quote: Column, url: Column) -> Column:
    """``Medien: <publication> — <quote> — <url>`` without the empty parts."""
    some = lambda c: F.when(c != "", c)
    head = F.concat_ws(": ", F.lit("Medien"), some(publication))
    return F.concat_ws(" — ", head, some(quote), some(url))


def remaining_text(end: Column, today: Column) -> Column:
    """Wording of the time to the end of the current phase."""
    days = F.datediff(end, today)
    months, years = days / F.lit(30.4), days / F.lit(365.25)
    return (
        F.when(end.isNull(), None)
        .when(days < 0, "Termin voraussichtlich überschritten")
        .when(days < 45, "Abschluss der aktuellen Phase steht unmittelbar bevor")
        .when(months < 18, F.concat(F.lit("noch ca. "), F.bround(months).cast("int").cast("string"), F.lit(" Monate in der aktuellen Phase")))
        .otherwise(F.concat(F.lit("noch ca. "), F.bround(years).cast("int").cast("string"), F.lit(" Jahre in der aktuellen Phase")))
    )


def years_to_days(years: Column) -> Column:
    """Days of a number of years, ties to even."""
    return F.bround(years * F.lit(365.25)).cast("int")
