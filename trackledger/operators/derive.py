"""From observations to the state of every project: ranking, tracks, forecast.

All functions treat all projects at once; ``today`` is a parameter. Windows and groups are
keyed by project, whose observation count is bounded by what sources say about one project.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.functions import domain as D
from trackledger.functions.dates import parse_flexible_date


def weigh(observations: DataFrame, today: Column) -> DataFrame:
    """Unexpected observations with ``raw_conf``, its rounding ``conf`` and ``phase_ord``.

    Rows with an unknown source, track or state stay; unknown states have no order.
    """
    raw = D.effective_confidence(F.col("confidence"), F.col("source_type"), F.col("observed_date"), today)
    kept = observations.where(~F.coalesce("is_expected", F.lit(False)))
    return kept.withColumn("raw_conf", raw).withColumn("conf", F.round("raw_conf", 4)).withColumn("phase_ord", D.phase_order(F.col("asserted_state")))


def contributions(observations: DataFrame, today: Column) -> DataFrame:
    """Every observation with its weight and whether it decides the headline.

    Credible main observations are ranked by rounded confidence, then by phase; all rows
    tied on both decide. Rows below the threshold are echoed with ``was_decisive`` false.
    """
    rows = weigh(observations, today)
    credible = (F.col("track") == "MAIN") & (F.col("conf") >= D.CREDIBLE) & F.col("phase_ord").isNotNull()
    by = Window.partitionBy("project_id", "in_race").orderBy(F.desc("conf"), F.desc("phase_ord"))
    rows = rows.withColumn("in_race", F.coalesce(credible, F.lit(False)))
    return rows.withColumn("was_decisive", F.col("in_race") & (F.rank().over(by) == 1)).drop("in_race")


def headline(observations: DataFrame, today: Column) -> DataFrame:
    """Phase, confidence and number of deciding observations per project with a credible one.

    An aggregate, not a window: the maximum of (confidence, order) is combined map-side.
    """
    rows = weigh(observations, today).where(
        (F.col("track") == "MAIN") & (F.col("conf") >= D.CREDIBLE) & F.col("phase_ord").isNotNull()
    )
    counted = rows.groupBy("project_id", "conf", "phase_ord").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("project_id").agg(F.max(F.struct("conf", "phase_ord", "n")).alias("m"))
    return best.select(
        "project_id",
        D.phase_name(F.col("m.phase_ord")).alias("computed_phase"),
        F.col("m.conf").alias("computed_confidence"),
        F.col("m.n").alias("n_decisive"),
    )


def parallel_state(observations: DataFrame, track: str, today: Column) -> DataFrame:
    """Highest credible state per project on a parallel track; credibility is not rounded."""
    rows = weigh(observations, today).where(F.col("track") == track)
    credible = F.when(F.col("raw_conf") >= D.CREDIBLE, D.state_order(F.col("asserted_state")))
    return rows.groupBy("project_id").agg(D.state_name(F.coalesce(F.max(credible), F.lit(0))).alias("state"))


def state_of_projects(projects: DataFrame, observations: DataFrame, today: Column) -> DataFrame:
    """Full derivation for ``projects(project_id, has_pf, parl_relevant, phase_override,
    pf_override, parl_override, lifecycle)``.

    Overrides win; the tracks exist only where their flag is set; a project without
    credible observations is NICHT_GESTARTET at confidence 0 and unknown unless overridden.
    """
    head = headline(observations, today)
    pf = parallel_state(observations, "PF", today).withColumnRenamed("state", "pf_found")
    parl = parallel_state(observations, "PARL", today).withColumnRenamed("state", "parl_found")
    rows = projects.join(head, "project_id", "left").join(pf, "project_id", "left").join(parl, "project_id", "left")
    return rows.select(
        "project_id",
        F.coalesce("computed_phase", F.lit("NICHT_GESTARTET")).alias("computed_phase"),
        F.coalesce("computed_confidence", F.lit(0.0)).alias("computed_confidence"),
        F.coalesce("phase_override", "computed_phase", F.lit("NICHT_GESTARTET")).alias("effective_phase"),
        F.col("phase_override").isNotNull().alias("is_overridden"),
        F.coalesce("lifecycle", F.lit("AKTIV")).alias("lifecycle"),
        F.when(F.col("has_pf"), F.coalesce("pf_override", "pf_found", F.lit("OFFEN"))).alias("pf_state"),
        F.when(F.col("parl_relevant"), F.coalesce("parl_override", "parl_found", F.lit("OFFEN"))).alias("parl_state"),
        (F.col("computed_phase").isNotNull() | F.col("phase_override").isNotNull()).alias("is_known"),
    )


def parl_relevant(projects: DataFrame, groups: DataFrame, prefix: str = "BSWAG") -> DataFrame:
    """``project_id, parl_relevant``: the override, else any group short name with the prefix."""
    any_group = groups.groupBy("project_id").agg(F.bool_or(F.upper("short_name").startswith(prefix)).alias("by_group"))
    joined = projects.join(any_group, "project_id", "left")
    return joined.select("project_id", F.coalesce("override", "by_group", F.lit(False)).alias("parl_relevant"))


# -- observations from the six kinds of sources ------------------------------------------

SPEC = ("project_id", "source_type", "track", "asserted_state", "observed_date", "confidence", "note", "origin_id")


def spec(rows: DataFrame, source: str, track: str, state: Column, observed: Column, note: Column, origin: Column, confidence: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return rows.select(
        "project_id",
        F.lit(source).alias("source_type"),
        F.lit(track).alias("track"),
        state.alias("asserted_state"),
        observed.cast("date").alias("observed_date"),
        (none if confidence is None else confidence).alias("confidence"),
        note.alias("note"),
        origin.cast("long").alias("origin_id"),
    ).where(F.col("asserted_state").isNotNull())


def some(c: Column) -> Column:
    """The text, null when empty."""
    return F.when(c != "", c)


def section_label() -> Column:
    return F.coalesce(some(F.col("nr_pfa")), some(F.col("abschnitt_label")), F.lit("PFA"))


def approval_specs(sections: DataFrame, observed: Column) -> DataFrame:
    """Planning-approval spec per section: completed once its decision date can be read."""
    done = parse_flexible_date(F.col("datum_pfb")).isNotNull()
    state = F.when(done, "ABGESCHLOSSEN").otherwise("LAEUFT")
    note = F.concat(section_label(), F.when(done, F.concat(F.lit(": PFB "), F.col("datum_pfb"))).otherwise(": Planfeststellung läuft"))
    return spec(sections, "VIB", "PF", state, observed, note, F.col("pfa_id"))


def report_specs(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """Specs of report entries linked to projects.

    ``entries(entry_id, project_id, report_year, status_planung, status_bau,
    status_abgeschlossen)``, ``sections(pfa_id, entry_id, leaf_project_id, nr_pfa,
    abschnitt_label, datum_pfb, ...)``. The main spec is left out once any section of the
    entry is assigned to another project; unassigned sections give approval specs.
    """
    year_end = F.make_date("report_year", F.lit(12), F.lit(31))
    split_up = sections.where("leaf_project_id is not null").select("entry_id").distinct()
    main = entries.join(split_up, "entry_id", "left_anti")
    phase = D.strongest_phase(F.col("status_planung"), F.col("status_bau"), F.col("status_abgeschlossen"))
    main = spec(main, "VIB", "MAIN", phase, year_end, F.lit("aus VIB-Statusangaben"), F.col("entry_id"))
    open_ = sections.where("leaf_project_id is null").join(entries.select("entry_id", "project_id", "report_year"), "entry_id")
    return main.unionByName(approval_specs(open_, year_end))


def section_specs(sections: DataFrame) -> DataFrame:
    """Specs of sections assigned to a leaf: phase and date of the furthest milestone that
    can be read, plus the approval spec; the year end stands in for a missing date."""
    rows = sections.where("leaf_project_id is not null").withColumn("project_id", F.col("leaf_project_id"))
    opening, start, decision = (parse_flexible_date(F.col(c)) for c in ("inbetriebnahme", "baubeginn", "datum_pfb"))
    phase = F.when(opening.isNotNull(), "IN_BETRIEB").when(start.isNotNull(), "BAU").when(decision.isNotNull(), "GENEHMIGUNGSPLANUNG")
    year_end = F.make_date("report_year", F.lit(12), F.lit(31))
    note = F.concat(section_label(), F.lit(": aus PFA-Terminen"))
    main = spec(rows, "VIB", "MAIN", phase, F.coalesce(opening, start, decision, year_end), note, F.col("pfa_id"))
    return main.unionByName(approval_specs(rows, year_end))


def agreement_specs(agreements: DataFrame) -> DataFrame:
    """``(finve_id, project_id, name, is_pooled, starting_year, manual_phase)`` to specs."""
    label = F.concat(F.lit("FinVe "), F.col("finve_id").cast("string"), F.coalesce(F.concat(F.lit(" · "), some(F.col("name"))), F.lit("")))
    phase = F.when(~F.col("is_pooled"), "BAU").otherwise(F.coalesce("manual_phase", D.pooled_phase(F.col("name"))))
    note = F.concat(F.when(F.col("is_pooled"), "Sammel-FinVe (").otherwise("Finanzierungsvereinbarung ("), label, F.lit(")"))
    year = F.when(F.col("starting_year") != 0, F.col("starting_year"))
    confidence = F.when(F.col("is_pooled"), F.lit(D.POOLED_CONFIDENCE))
    return spec(agreements, "FINVE", "MAIN", phase, F.make_date(year, F.lit(1), F.lit(1)), note, F.col("finve_id"), confidence)


def portal_specs(records: DataFrame) -> DataFrame:
    """Confirmed portal records ``(record_id, project_id, status, projecttime, fetched, confirmed)``."""
    note = F.concat(F.lit("DB-Bauportal"), F.coalesce(F.concat(F.lit(": "), some(F.col("projecttime"))), F.lit("")))
    return spec(records.where("confirmed"), "BAUPORTAL", "MAIN", D.portal_phase(F.col("status")), F.col("fetched"), note, F.col("record_id"))


def media_specs(reports: DataFrame) -> DataFrame:
    """Confirmed media reports; the date is the observed one or that of publication."""
    note = D.media_note(F.col("publication"), F.col("quote"), F.col("url"))
    observed = F.coalesce("observed", "published")
    return spec(reports.where("confirmed"), "MEDIEN", "MAIN", D.known_phase(F.col("asserted_phase")), observed, note, F.col("report_id"))


def announcement_specs(rows: DataFrame) -> DataFrame:
    """Confirmed announcements: the editor's phase, else that of the category; the expected,
    the document's, or the first day of the year."""
    phase = F.coalesce(D.known_phase(F.col("announced_phase")), D.category_phase(F.col("category")))
    observed = F.coalesce("expected", "document_date", F.make_date("announcement_year", F.lit(1), F.lit(1)))
    note = F.concat(F.lit("Fulda-Runde"), F.coalesce(F.concat(F.lit(" ("), some(F.col("label")), F.lit(")")), F.lit("")))
    return spec(rows.where("confirmed"), "FULDA_RUNDE", "MAIN", phase, observed, note, F.col("announcement_id"))


def union_specs(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resync(current: DataFrame, regenerated: DataFrame, project_ids: DataFrame) -> DataFrame:
    """Observations after a resync of ``project_ids``: their derived rows are replaced, rows
    entered by hand and those of other projects survive."""
    kept = current.where("not is_derived").unionByName(current.where("is_derived").join(project_ids, "project_id", "left_anti"))
    fresh = regenerated.join(project_ids, "project_id", "left_semi").withColumn("is_derived", F.lit(True))
    return kept.unionByName(fresh, allowMissingColumns=True)


def approval_evidence(sections: DataFrame) -> DataFrame:
    """``project_id, has_evidence``: any section with a number, a label or a decision date."""
    seen = F.coalesce(F.col("nr_pfa") != "", F.lit(False)) | F.coalesce(F.col("abschnitt_label") != "", F.lit(False))
    seen = seen | parse_flexible_date(F.col("datum_pfb")).isNotNull()
    return sections.groupBy("project_id").agg(F.bool_or(seen).alias("has_evidence"))


def enable_approval_flag(projects: DataFrame, evidence: DataFrame) -> DataFrame:
    """Turns ``has_pf`` on where there is evidence, never off."""
    joined = projects.join(evidence, "project_id", "left")
    return joined.withColumn("has_pf", F.coalesce("has_pf", F.lit(False)) | F.coalesce("has_evidence", F.lit(False))).drop("has_evidence")


def stale(cached: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Cached rows never computed or computed longer ago than the window."""
    return cached.where(F.col("computed_at").isNull() | (F.col("computed_at") < now - F.expr(f"interval {hours} hours")))


# -- forecast -------------------------------------------------------------------------------

FORECAST_PHASES = ("VORPLANUNG", "GENEHMIGUNGSPLANUNG", "BAU", "IN_BETRIEB")


def milestones(sections: DataFrame, announced: DataFrame, manual: DataFrame) -> DataFrame:
    """Concrete date and source per project and phase.

    Sections give the earliest decision and start and the latest opening; an announcement
    replaces a later date or fills a gap (the earliest counts, ties keep the section); a
    manual date always wins (of several that with the highest ``seq``).
    """
    agg = sections.groupBy("project_id").agg(F.min("datum_pfb").alias("pfb"), F.min("baubeginn").alias("start"), F.max("inbetriebnahme").alias("opening"))
    pairs = F.array(
        *[
            F.struct(F.lit(p).alias("phase"), F.col(c).alias("date"))
            for p, c in (("GENEHMIGUNGSPLANUNG", "pfb"), ("BAU", "start"), ("IN_BETRIEB", "opening"))
        ]
    )
    base = agg.select("project_id", F.explode(pairs).alias("m")).select("project_id", "m.phase", "m.date").where("date is not null")
    rows = (
        base.withColumn("kind", F.lit("VIB-PFA")).withColumn("seq", F.lit(0).cast("long"))
        .unionByName(announced.select("project_id", "phase", "date").withColumn("kind", F.lit("Fulda-Runde")).withColumn("seq", F.lit(0).cast("long")))
        .unionByName(manual.select("project_id", "phase", "date", F.col("seq").cast("long").alias("seq")).withColumn("kind", F.lit("Manuell")))
    )
    by_hand = F.when(F.col("kind") == "Manuell", F.struct("seq", "date"))
    found = F.when(F.col("kind") != "Manuell", F.struct(F.col("date"), (F.col("kind") != "VIB-PFA").cast("int").alias("late"), F.col("kind")))
    best = rows.groupBy("project_id", "phase").agg(F.max(by_hand).alias("h"), F.min(found).alias("f"))
    return best.select("project_id", "phase", F.coalesce("h.date", "f.date").alias("date"), F.when(F.col("h").isNotNull(), "Manuell").otherwise(F.col("f.kind")).alias("source"))


def forecast(projects: DataFrame, concrete: DataFrame, today: Column) -> DataFrame:
    """Upcoming steps of ``projects(project_id, effective_phase, planning_years, build_years)``.

    One row per project and phase after the current one: a concrete date, else an estimate
    from the appraisal durations, else none; ``step`` counts from 1. ``remaining`` words the
    time to the first step.
    """
    by_phase = concrete.groupBy("project_id").pivot("phase", list(FORECAST_PHASES)).agg(F.first(F.struct("date", "source")))
    rows = projects.join(by_phase, "project_id", "left")
    bau = F.date_add(today, D.years_to_days(F.col("planning_years")))
    anchor = F.coalesce(F.col("BAU.date"), bau, today)
    opening = F.when(F.col("build_years").isNotNull(), F.date_add(anchor, D.years_to_days(F.col("build_years"))))
    estimate = {"BAU": bau, "IN_BETRIEB": opening}
    none = F.lit(None).cast("date")
    steps = F.array(
        *[
            F.struct(
                F.lit(D.MAIN_PHASES.index(p)).alias("ord"),
                F.lit(p).alias("phase"),
                F.coalesce(F.col(f"{p}.date"), estimate.get(p, none)).alias("expected_date"),
                F.coalesce(F.col(f"{p}.source"), F.when(estimate.get(p, none).isNotNull(), "BVWP"), F.lit("Schätzung")).alias("source"),
            )
            for p in FORECAST_PHASES
        ]
    )
    current = D.phase_order(F.col("effective_phase"))
    ahead = rows.select("project_id", current.alias("now"), F.filter(steps, lambda s: s["ord"] > current).alias("steps"))
    remaining = D.remaining_text(F.col("steps")[0]["expected_date"], today)
    ahead = ahead.where(F.size("steps") > 0).withColumn("remaining", remaining)
    out = ahead.select("project_id", "remaining", F.posexplode("steps").alias("pos", "s"))
    return out.select("project_id", (F.col("pos") + 1).alias("step"), "s.phase", "s.expected_date", "s.source", "remaining")
