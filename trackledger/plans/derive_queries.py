"""Queries over observations, the project tree and the forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackledger.functions import dates
from trackledger.functions import domain as D
from trackledger.operators import derive, tree
from trackledger.plans import domain as P
from trackledger.plans.registry import query

T = f"DATE '{P.TODAY}'"
HEAD = f"WITH {P.OBS}, {P.HEADLINE}"


@query(
    "f02_recency",
    f"WITH {P.OBS} SELECT id, round({P.DECAY_SQL}, 4) AS decay FROM obs",
)
def f02_recency(spark, sf_dir):
    o = P.observations(spark, sf_dir)
    return o.select("id", F.round(D.recency_decay(F.col("observed_date"), P.today()), 4).alias("decay"))


@query("f03_confidence", f"WITH {P.OBS} SELECT id, round({P.CONF_SQL}, 4) AS conf, {P.CONF_SQL} >= 0.15 AS credible_raw, round({P.CONF_SQL}, 4) >= 0.15 AS credible FROM obs")
def f03_confidence(spark, sf_dir):
    o = P.observations(spark, sf_dir)
    raw = D.effective_confidence(F.col("confidence"), F.col("source_type"), F.col("observed_date"), P.today())
    return o.select("id", F.round(raw, 4).alias("conf"), (raw >= D.CREDIBLE).alias("credible_raw"), (F.round(raw, 4) >= D.CREDIBLE).alias("credible"))


@query("f05_phase_order", f"WITH {P.OBS} SELECT id, {P.ORDER_SQL} AS phase_ord, {P.STATE_ORDER_SQL} AS state_ord FROM obs")
def f05_phase_order(spark, sf_dir):
    o = P.observations(spark, sf_dir)
    return o.select("id", D.phase_order(F.col("asserted_state")).alias("phase_ord"), D.state_order(F.col("asserted_state")).alias("state_ord"))


@query(
    "a05_headline_argmax",
    f"{HEAD} SELECT project_id, {P.phase_name_sql('ord')} AS computed_phase, conf AS computed_confidence, n_decisive FROM headline",
)
def a05_headline_argmax(spark, sf_dir):
    return derive.headline(P.observations(spark, sf_dir), P.today())


def state_inputs(spark, sf_dir):
    """Projects with flags and overrides set by id, so that every gate occurs."""
    c = P.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("project_id"),
        (k % 2 == 0).alias("has_pf"),
        (k % 3 == 0).alias("parl_relevant"),
        F.when(k % 19 == 0, "BAU").alias("phase_override"),
        F.when(k % 23 == 0, "ABGESCHLOSSEN").alias("pf_override"),
        F.when(k % 29 == 0, "LAEUFT").alias("parl_override"),
        F.when(k % 31 == 0, "PAUSIERT").alias("lifecycle"),
    )


STATE_SQL = f"""{HEAD},
tracks AS (SELECT project_id, track, coalesce(max(CASE WHEN raw_conf >= 0.15 THEN {P.STATE_ORDER_SQL} END), 0) AS ord
  FROM weighed WHERE track <> 'MAIN' GROUP BY 1, 2),
state AS (SELECT c_custkey AS project_id, c_nationkey,
  coalesce({P.phase_name_sql("h.ord")}, 'NICHT_GESTARTET') AS computed_phase, coalesce(h.conf, 0.0::DOUBLE) AS computed_confidence,
  coalesce(CASE WHEN c_custkey % 19 = 0 THEN 'BAU' END, {P.phase_name_sql("h.ord")}, 'NICHT_GESTARTET') AS effective_phase,
  c_custkey % 19 = 0 AS is_overridden, CASE WHEN c_custkey % 31 = 0 THEN 'PAUSIERT' ELSE 'AKTIV' END AS lifecycle,
  CASE WHEN c_custkey % 2 = 0 THEN coalesce(CASE WHEN c_custkey % 23 = 0 THEN 'ABGESCHLOSSEN' END, {P.state_name_sql("f.ord")}, 'OFFEN') END AS pf_state,
  CASE WHEN c_custkey % 3 = 0 THEN coalesce(CASE WHEN c_custkey % 29 = 0 THEN 'LAEUFT' END, {P.state_name_sql("p.ord")}, 'OFFEN') END AS parl_state,
  h.ord IS NOT NULL OR c_custkey % 19 = 0 AS is_known
  FROM customer LEFT JOIN headline h ON h.project_id = c_custkey
  LEFT JOIN tracks f ON f.project_id = c_custkey AND f.track = 'PF' LEFT JOIN tracks p ON p.project_id = c_custkey AND p.track = 'PARL')"""


@query("d10_headline", f"{STATE_SQL} SELECT * EXCLUDE (c_nationkey) FROM state")
def d10_headline(spark, sf_dir):
    return derive.state_of_projects(state_inputs(spark, sf_dir), P.observations(spark, sf_dir), P.today())


@query(
    "a06_parallel_track",
    f"""{HEAD} SELECT project_id, track, {P.state_name_sql("ord")} AS state FROM (
      SELECT project_id, track, coalesce(max(CASE WHEN raw_conf >= 0.15 THEN {P.STATE_ORDER_SQL} END), 0) AS ord
      FROM weighed WHERE track <> 'MAIN' GROUP BY 1, 2) x""",
)
def a06_parallel_track(spark, sf_dir):
    o = P.observations(spark, sf_dir)
    parts = [derive.parallel_state(o, t, P.today()).select("project_id", F.lit(t).alias("track"), "state") for t in ("PF", "PARL")]
    return parts[0].union(parts[1])


@query(
    "a07_phase_span",
    f"""{STATE_SQL} SELECT c_nationkey, {P.phase_name_sql("lo")} AS span_low, {P.phase_name_sql("hi")} AS span_high FROM (
      SELECT c_nationkey, min(o) AS lo, max(o) AS hi FROM (
        SELECT c_nationkey, {P.case("effective_phase", {p: i for i, p in enumerate(D.MAIN_PHASES)})} AS o FROM state WHERE is_known) y GROUP BY 1) x""",
)
def a07_phase_span(spark, sf_dir):
    s = d10_headline(spark, sf_dir).where("is_known")
    nation = P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), "c_nationkey")
    o = D.phase_order(F.col("effective_phase"))
    g = s.join(nation, "project_id").groupBy("c_nationkey").agg(F.min(o).alias("lo"), F.max(o).alias("hi"))
    return g.select("c_nationkey", D.phase_name(F.col("lo")).alias("span_low"), D.phase_name(F.col("hi")).alias("span_high"))


@query(
    "a08_parl_relevant",
    """SELECT c_custkey AS project_id, coalesce(CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 2 = 0 END, g.found, false) AS parl_relevant
       FROM customer LEFT JOIN (SELECT o_custkey, bool_or(starts_with(upper(CASE WHEN o_orderkey % 40 = 0 THEN 'bswag-' ELSE 'x' END || o_orderpriority), 'BSWAG')) AS found
         FROM orders GROUP BY 1) g ON g.o_custkey = c_custkey""",
)
def a08_parl_relevant(spark, sf_dir):
    k = F.col("c_custkey")
    projects = P.read(spark, sf_dir, "customer").select(k.alias("project_id"), F.when(k % 11 == 0, k % 2 == 0).alias("override"))
    name = F.concat(F.when(F.col("o_orderkey") % 40 == 0, "bswag-").otherwise("x"), F.col("o_orderpriority"))
    groups = P.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), name.alias("short_name"))
    return derive.parl_relevant(projects, groups)


DECISIVE_SQL = f"""{HEAD} SELECT w.id, w.project_id, w.source_type, w.track, w.asserted_state, w.observed_date, w.conf AS effective_confidence,
  coalesce(r.r = 1, false) AS was_decisive FROM weighed w LEFT JOIN ranked r ON r.id = w.id"""


@query("d11_contributions", DECISIVE_SQL)
def d11_contributions(spark, sf_dir):
    rows = derive.contributions(P.observations(spark, sf_dir), P.today())
    return rows.select("id", "project_id", "source_type", "track", "asserted_state", "observed_date", F.col("conf").alias("effective_confidence"), "was_decisive")


def leaf_phases(spark, sf_dir):
    return derive.headline(P.observations(spark, sf_dir), P.today()).select("project_id", F.col("computed_phase").alias("phase"))


ROLLUP_SQL = f"""WITH RECURSIVE {P.OBS}, {P.HEADLINE}, {P.PROJECTS},
inner_nodes AS (SELECT DISTINCT superior_id AS project_id FROM projects WHERE superior_id IS NOT NULL),
marked AS (SELECT p.*, i.project_id IS NOT NULL AS inn, i.project_id IS NOT NULL AND p.pin IS NOT NULL AS held
  FROM projects p LEFT JOIN inner_nodes i ON i.project_id = p.project_id),
below AS (SELECT project_id AS root_id, project_id AS node_id, held AS halt FROM marked
  UNION ALL SELECT b.root_id, m.project_id, m.held FROM below b JOIN marked m ON m.superior_id = b.node_id WHERE NOT b.halt),
node_state AS (SELECT m.project_id, CASE WHEN held THEN {P.case("pin", {p: i for i, p in enumerate(D.MAIN_PHASES)})}
   WHEN NOT inn THEN coalesce({P.case("pin", {p: i for i, p in enumerate(D.MAIN_PHASES)})}, h.ord) END AS ord
  FROM marked m LEFT JOIN headline h ON h.project_id = m.project_id),
spans AS (SELECT root_id, min(ord) AS lo, max(ord) AS hi, count(ord) AS n_phases FROM below JOIN node_state ON node_id = project_id GROUP BY root_id),
rolled AS (SELECT project_id, inn AS is_superior, n_phases > 0 AS is_known, n_phases,
  CASE WHEN inn AND NOT held AND n_phases > 0 THEN {P.phase_name_sql("lo")} END AS span_low,
  CASE WHEN inn AND NOT held AND n_phases > 0 THEN {P.phase_name_sql("hi")} END AS span_high,
  coalesce({P.phase_name_sql("hi")}, 'NICHT_GESTARTET') AS display_phase FROM marked JOIN spans ON root_id = project_id)"""


@query("a09_rollup", f"{ROLLUP_SQL} SELECT * FROM rolled")
def a09_rollup(spark, sf_dir):
    return tree.rollup(P.projects(spark, sf_dir), leaf_phases(spark, sf_dir))


@query("d12_children", f"{ROLLUP_SQL} SELECT p.superior_id, p.name, r.* FROM projects p JOIN rolled r USING (project_id) WHERE p.superior_id IS NOT NULL")
def d12_children(spark, sf_dir):
    nodes = P.projects(spark, sf_dir)
    return tree.children_of(nodes, a09_rollup(spark, sf_dir))


@query(
    "j10_closure",
    f"""WITH RECURSIVE {P.PROJECTS}, c AS (SELECT project_id AS root_id, project_id AS node_id, 0 AS depth FROM projects
      UNION ALL SELECT c.root_id, p.project_id, c.depth + 1 FROM c JOIN projects p ON p.superior_id = c.node_id) SELECT root_id, node_id, depth FROM c""",
)
def j10_closure(spark, sf_dir):
    return tree.closure(P.projects(spark, sf_dir))


@query(
    "j11_ancestors",
    f"""WITH RECURSIVE {P.PROJECTS}, c AS (SELECT project_id AS node_id, project_id AS ancestor_id, 0 AS distance FROM projects
      UNION ALL SELECT c.node_id, p.superior_id, c.distance + 1 FROM c JOIN projects p ON p.project_id = c.ancestor_id WHERE p.superior_id IS NOT NULL)
      SELECT node_id, ancestor_id, distance FROM c""",
)
def j11_ancestors(spark, sf_dir):
    return tree.ancestors(P.projects(spark, sf_dir))


@query("j09_parent_child", f"WITH {P.PROJECTS} SELECT c.project_id, c.name, p.name AS superior_name FROM projects c JOIN projects p ON p.project_id = c.superior_id")
def j09_parent_child(spark, sf_dir):
    nodes = P.projects(spark, sf_dir)
    up = nodes.select(F.col("project_id").alias("superior_id"), F.col("name").alias("superior_name"))
    return nodes.join(up, "superior_id").select("project_id", "name", "superior_name")


@query(
    "a17_merged_features",
    f"""WITH {P.PROJECTS} SELECT n.superior_id AS project_id, count(*) AS n_features,
        string_agg('"' || c.name || '"', ',' ORDER BY c.project_id) AS features FROM projects c JOIN projects n ON n.project_id = c.superior_id
        WHERE c.project_id < {P.REGION_BASE} AND n.superior_id IS NOT NULL GROUP BY 1
      UNION ALL SELECT c.superior_id, count(*), string_agg('"' || c.name || '"', ',' ORDER BY c.project_id) FROM projects c WHERE c.project_id < {P.REGION_BASE} GROUP BY 1""",
)
def a17_merged_features(spark, sf_dir):
    nodes = P.projects(spark, sf_dir)
    own = nodes.where(F.col("project_id") < P.REGION_BASE).select("project_id", F.array(F.concat(F.lit('"'), F.col("name"), F.lit('"'))).alias("features"))
    out = tree.merged_features(nodes, own)
    return out.select("project_id", F.size("features").cast("long").alias("n_features"), F.array_join("features", ",").alias("features"))


# -- forecast ---------------------------------------------------------------------------------


def ship_sections(spark, sf_dir):
    li = P.read(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("d"), "l_linenumber")
    o = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("project_id"))
    rows = li.join(o, "l_orderkey")
    n = F.col("l_linenumber")
    return rows.select(
        "project_id",
        F.when(n % 3 == 1, F.date_add("d", 8000)).alias("datum_pfb"),
        F.when(n % 3 == 2, F.date_add("d", 9000)).alias("baubeginn"),
        F.when((n % 3 == 0) & (F.col("project_id") % 4 != 0), F.date_add("d", 10_000)).alias("inbetriebnahme"),
    )


SECTIONS_SQL = """sections AS (SELECT o_custkey AS project_id,
  CASE WHEN l_linenumber % 3 = 1 THEN l_shipdate::DATE + 8000 END AS datum_pfb,
  CASE WHEN l_linenumber % 3 = 2 THEN l_shipdate::DATE + 9000 END AS baubeginn,
  CASE WHEN l_linenumber % 3 = 0 AND o_custkey % 4 <> 0 THEN l_shipdate::DATE + 10000 END AS inbetriebnahme
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(
    "a10_milestones",
    f"WITH {SECTIONS_SQL} SELECT project_id, min(datum_pfb) AS pfb, min(baubeginn) AS bau, max(inbetriebnahme) AS opening FROM sections GROUP BY 1",
)
def a10_milestones(spark, sf_dir):
    s = ship_sections(spark, sf_dir)
    return s.groupBy("project_id").agg(F.min("datum_pfb").alias("pfb"), F.min("baubeginn").alias("bau"), F.max("inbetriebnahme").alias("opening"))


def announced(spark, sf_dir):
    o = P.read(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    return o.select(
        F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "BAU").otherwise("IN_BETRIEB").alias("phase"),
        F.date_add(F.to_date("o_orderdate"), 9000).alias("date"),
    )


def manual(spark, sf_dir):
    o = P.read(spark, sf_dir, "orders").where("o_orderkey % 97 = 0")
    return o.select(F.col("o_custkey").alias("project_id"), F.lit("BAU").alias("phase"), F.date_add(F.to_date("o_orderdate"), 9500).alias("date"), F.col("o_orderkey").alias("seq"))


CONCRETE_SQL = f"""{SECTIONS_SQL},
base AS (
  SELECT project_id, 'GENEHMIGUNGSPLANUNG' AS phase, min(datum_pfb) AS d, 0 AS late FROM sections GROUP BY 1
  UNION ALL SELECT project_id, 'BAU', min(baubeginn), 0 FROM sections GROUP BY 1
  UNION ALL SELECT project_id, 'IN_BETRIEB', max(inbetriebnahme), 0 FROM sections GROUP BY 1
  UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'BAU' ELSE 'IN_BETRIEB' END, o_orderdate::DATE + 9000, 1 FROM orders WHERE o_orderkey % 7 = 0),
firsts AS (SELECT project_id, phase, d, late FROM (SELECT *, row_number() OVER (PARTITION BY project_id, phase ORDER BY d, late) AS rn FROM base WHERE d IS NOT NULL) x WHERE rn = 1),
by_hand AS (SELECT o_custkey AS project_id, 'BAU' AS phase, arg_max(o_orderdate::DATE + 9500, o_orderkey) AS d FROM orders WHERE o_orderkey % 97 = 0 GROUP BY 1),
concrete AS (SELECT coalesce(f.project_id, h.project_id) AS project_id, coalesce(f.phase, h.phase) AS phase, coalesce(h.d, f.d) AS date,
  CASE WHEN h.d IS NOT NULL THEN 'Manuell' WHEN f.late = 1 THEN 'Fulda-Runde' ELSE 'VIB-PFA' END AS source
  FROM firsts f FULL JOIN by_hand h ON h.project_id = f.project_id AND h.phase = f.phase)"""


@query("a11_overlay", f"WITH {CONCRETE_SQL} SELECT project_id, phase, date, source FROM concrete")
def a11_overlay(spark, sf_dir):
    return derive.milestones(ship_sections(spark, sf_dir), announced(spark, sf_dir), manual(spark, sf_dir))


@query(
    "d13_forecast",
    f"""WITH {P.OBS}, {P.HEADLINE}, {CONCRETE_SQL},
    proj AS (SELECT c_custkey AS project_id, coalesce(h.ord, 0) AS now,
      CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 50) / 10.0::DOUBLE END AS planning, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 70) / 10.0::DOUBLE END AS build
      FROM customer LEFT JOIN headline h ON h.project_id = c_custkey),
    grid AS (SELECT p.*, ord, phase FROM proj p, (VALUES (1, 'VORPLANUNG'), (2, 'GENEHMIGUNGSPLANUNG'), (3, 'BAU'), (4, 'IN_BETRIEB')) v(ord, phase) WHERE ord > now),
    est AS (SELECT g.project_id, g.ord, g.phase, c.date, c.source,
      CASE WHEN g.phase = 'BAU' THEN {T} + round_even(planning * 365.25, 0)::INTEGER
           WHEN g.phase = 'IN_BETRIEB' THEN coalesce(b.date, {T} + round_even(planning * 365.25, 0)::INTEGER, {T}) + round_even(build * 365.25, 0)::INTEGER END AS guess
      FROM grid g LEFT JOIN concrete c ON c.project_id = g.project_id AND c.phase = g.phase
      LEFT JOIN concrete b ON b.project_id = g.project_id AND b.phase = 'BAU'),
    steps AS (SELECT project_id, (row_number() OVER (PARTITION BY project_id ORDER BY ord))::INTEGER AS step, phase, coalesce(date, guess) AS expected_date,
      coalesce(source, CASE WHEN guess IS NOT NULL THEN 'BVWP' END, 'Schätzung') AS source FROM est),
    ends AS (SELECT project_id, date_diff('day', {T}, expected_date) AS days FROM steps WHERE step = 1)
    SELECT s.project_id, step, phase, expected_date, source, CASE WHEN days IS NULL THEN NULL WHEN days < 0 THEN 'Termin voraussichtlich überschritten'
      WHEN days < 45 THEN 'Abschluss der aktuellen Phase steht unmittelbar bevor'
      WHEN days / 30.4::DOUBLE < 18 THEN 'noch ca. ' || round_even(days / 30.4::DOUBLE, 0)::INTEGER || ' Monate in der aktuellen Phase'
      ELSE 'noch ca. ' || round_even(days / 365.25::DOUBLE, 0)::INTEGER || ' Jahre in der aktuellen Phase' END AS remaining
    FROM steps s JOIN ends e ON e.project_id = s.project_id""",
)
def d13_forecast(spark, sf_dir):
    k = F.col("c_custkey")
    head = leaf_phases(spark, sf_dir).withColumnRenamed("project_id", "pid")
    projects = P.read(spark, sf_dir, "customer").join(head, k == F.col("pid"), "left").select(
        k.alias("project_id"),
        F.coalesce("phase", F.lit("NICHT_GESTARTET")).alias("effective_phase"),
        F.when(k % 3 != 0, (k % 50) / F.lit(10.0)).alias("planning_years"),
        F.when(k % 5 != 0, (k % 70) / F.lit(10.0)).alias("build_years"),
    )
    return derive.forecast(projects, a11_overlay(spark, sf_dir), P.today())


@query(
    "d14_forecast_inputs",
    f"""WITH {P.OBS} SELECT project_id, 'announcement' AS kind, asserted_state AS phase, observed_date AS date FROM obs
        WHERE source_type = 'FINVE' AND track = 'MAIN' AND observed_date IS NOT NULL
      UNION ALL SELECT project_id, 'manual', asserted_state, observed_date FROM obs
        WHERE source_type = 'MANUELL' AND is_expected AND track = 'MAIN' AND observed_date IS NOT NULL""",
)
def d14_forecast_inputs(spark, sf_dir):
    o = P.observations(spark, sf_dir).where("track = 'MAIN' and observed_date is not null")
    pick = lambda df, kind: df.select("project_id", F.lit(kind).alias("kind"), F.col("asserted_state").alias("phase"), F.col("observed_date").alias("date"))
    return pick(o.where("source_type = 'FINVE'"), "announcement").union(pick(o.where("source_type = 'MANUELL' and is_expected"), "manual"))


# -- materialisation ----------------------------------------------------------------------------

DATE_FORMS = ("yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "MM/yyyy", "MM.yyyy")


def date_text(date, key):
    """The order date in one of thirteen written forms."""
    q = F.quarter(date).cast("string")
    y = F.year(date).cast("string")
    roman = F.element_at(F.array(*[F.lit(r) for r in ("I", "II", "III", "IV")]), F.quarter(date))
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_WORDS]), F.month(date))
    forms = [
        *[F.date_format(date, f) for f in DATE_FORMS], F.concat(F.lit("Q"), q, F.lit(" "), y), F.concat(q, F.lit(". Quartal "), y),
        F.concat(roman, F.lit("/"), y), F.concat(month, F.lit(" "), y), F.concat(F.lit("Mitte "), y), F.concat(F.lit("voraussichtlich "), y),
        F.concat(F.lit("31.02."), y), F.lit("offen"),
    ]
    out = forms[-1]
    for i, f in enumerate(forms[:-1]):
        out = F.when(key % 13 == i, f).otherwise(out)
    return out


MONTH_WORDS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
_WORDS = "[" + ", ".join(f"'{m}'" for m in MONTH_WORDS) + "]"


def date_sql(date: str, key: str) -> str:
    """The date that each written form stands for."""
    mid = f"make_date(year({date}), (quarter({date}) * 3 - 1)::BIGINT, 15)"
    month = f"make_date(year({date}), month({date}), 15)"
    return (
        f"CASE WHEN {key} % 13 < 3 THEN {date} WHEN {key} % 13 < 5 THEN {month} WHEN {key} % 13 < 8 THEN {mid} WHEN {key} % 13 = 8 THEN {month} "
        f"WHEN {key} % 13 = 9 THEN make_date(year({date}), 7, 15) WHEN {key} % 13 = 10 THEN make_date(year({date}), 7, 1) END"
    )


def text_sql(date: str, key: str) -> str:
    y = f"year({date})::VARCHAR"
    q = f"quarter({date})::VARCHAR"
    forms = [
        f"strftime({date}, '%Y-%m-%d')", f"strftime({date}, '%d.%m.%Y')", f"day({date})::VARCHAR || '.' || month({date})::VARCHAR || '.' || {y}",
        f"strftime({date}, '%m/%Y')", f"strftime({date}, '%m.%Y')", f"'Q' || {q} || ' ' || {y}", f"{q} || '. Quartal ' || {y}",
        f"['I', 'II', 'III', 'IV'][quarter({date})] || '/' || {y}", f"{_WORDS}[month({date})] || ' ' || {y}", f"'Mitte ' || {y}",
        f"'voraussichtlich ' || {y}", f"'31.02.' || {y}", "'offen'",
    ]
    return "CASE " + " ".join(f"WHEN {key} % 13 = {i} THEN {f}" for i, f in enumerate(forms)) + " END"


@query("f01_dates", f"SELECT o_orderkey, {text_sql('o_orderdate::DATE', 'o_orderkey')} AS text, {date_sql('o_orderdate::DATE', 'o_orderkey')} AS parsed FROM orders")
def f01_dates(spark, sf_dir):
    o = P.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    o = o.select("o_orderkey", date_text(F.col("d"), F.col("o_orderkey")).alias("text"))
    return o.withColumn("parsed", dates.parse_flexible_date(F.col("text")))


def report_entries(spark, sf_dir):
    """Parts stand for report entries, orders for their sections."""
    p = F.col("p_partkey")
    return P.read(spark, sf_dir, "part").select(
        p.alias("entry_id"), (p % 100).alias("project_id"), (F.lit(2000) + p % 25).cast("int").alias("report_year"),
        (p % 2 == 0).alias("status_planung"), (p % 5 == 0).alias("status_bau"), (p % 7 == 0).alias("status_abgeschlossen"),
    )


def report_sections(spark, sf_dir):
    o, p = F.col("o_orderkey"), F.col("o_custkey")
    rows = P.read(spark, sf_dir, "orders")
    text = lambda shift: date_text(F.to_date("o_orderdate"), o + shift)
    return rows.select(
        o.alias("pfa_id"), (p * 3 % 2000).alias("entry_id"), F.when(o % 4 == 0, p % 50).alias("leaf_project_id"), F.year("o_orderdate").alias("report_year"),
        F.when(o % 3 != 0, (o % 9).cast("string")).alias("nr_pfa"), F.when(o % 2 == 0, F.col("o_orderpriority")).alias("abschnitt_label"),
        text(0).alias("datum_pfb"), text(5).alias("baubeginn"), F.when(o % 2 == 0, text(9)).alias("inbetriebnahme"),
    )


_D = "o_orderdate::DATE"
REPORT_SQL = f"""entries AS (SELECT p_partkey AS entry_id, p_partkey % 100 AS project_id, (2000 + p_partkey % 25)::INTEGER AS report_year,
  p_partkey % 2 = 0 AS sp, p_partkey % 5 = 0 AS sb, p_partkey % 7 = 0 AS sc FROM part),
sections AS (SELECT o_orderkey AS pfa_id, o_custkey * 3 % 2000 AS entry_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 50 END AS leaf,
  year(o_orderdate)::INTEGER AS report_year, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 9)::VARCHAR END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'PFA') AS label,
  {text_sql(_D, "o_orderkey")} AS pfb_text, {date_sql(_D, "o_orderkey")} AS pfb, {date_sql(_D, "(o_orderkey + 5)")} AS bau,
  CASE WHEN o_orderkey % 2 = 0 THEN {date_sql(_D, "(o_orderkey + 9)")} END AS opening FROM orders)"""
PF_COLS = "CASE WHEN pfb IS NOT NULL THEN 'ABGESCHLOSSEN' ELSE 'LAEUFT' END AS asserted_state"
PF_NOTE = "label || CASE WHEN pfb IS NOT NULL THEN ': PFB ' || pfb_text ELSE ': Planfeststellung läuft' END AS note"


@query(
    "d01_report_specs",
    f"""WITH {REPORT_SQL} SELECT project_id, 'VIB' AS source_type, 'MAIN' AS track, CASE WHEN sc THEN 'IN_BETRIEB' WHEN sb THEN 'BAU' ELSE 'VORPLANUNG' END AS asserted_state,
      make_date(report_year, 12, 31) AS observed_date, NULL::DOUBLE AS confidence, 'aus VIB-Statusangaben' AS note, entry_id AS origin_id
      FROM entries e WHERE (sc OR sb OR sp) AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.entry_id = e.entry_id AND leaf IS NOT NULL)
    UNION ALL SELECT project_id, 'VIB', 'PF', {PF_COLS}, make_date(e.report_year, 12, 31), NULL, {PF_NOTE}, pfa_id
      FROM sections s JOIN entries e ON e.entry_id = s.entry_id WHERE leaf IS NULL""",
)
def d01_report_specs(spark, sf_dir):
    return derive.report_specs(report_entries(spark, sf_dir), report_sections(spark, sf_dir).drop("report_year"))


@query(
    "d02_section_specs",
    f"""WITH {REPORT_SQL} SELECT leaf AS project_id, 'VIB' AS source_type, 'MAIN' AS track,
      CASE WHEN opening IS NOT NULL THEN 'IN_BETRIEB' WHEN bau IS NOT NULL THEN 'BAU' ELSE 'GENEHMIGUNGSPLANUNG' END AS asserted_state,
      coalesce(opening, bau, pfb) AS observed_date, NULL::DOUBLE AS confidence, label || ': aus PFA-Terminen' AS note, pfa_id AS origin_id
      FROM sections WHERE leaf IS NOT NULL AND coalesce(opening, bau, pfb) IS NOT NULL
    UNION ALL SELECT leaf, 'VIB', 'PF', {PF_COLS}, make_date(report_year, 12, 31), NULL, {PF_NOTE}, pfa_id FROM sections WHERE leaf IS NOT NULL""",
)
def d02_section_specs(spark, sf_dir):
    return derive.section_specs(report_sections(spark, sf_dir))


@query("d03_approval_specs", f"""WITH {REPORT_SQL} SELECT coalesce(leaf, -1) AS project_id, 'VIB' AS source_type, 'PF' AS track, {PF_COLS},
  make_date(report_year, 12, 31) AS observed_date, NULL::DOUBLE AS confidence, {PF_NOTE}, pfa_id AS origin_id FROM sections""")
def d03_approval_specs(spark, sf_dir):
    s = report_sections(spark, sf_dir).withColumn("project_id", F.coalesce("leaf_project_id", F.lit(-1).cast("long")))
    return derive.approval_specs(s, F.make_date("report_year", F.lit(12), F.lit(31)))


@query(
    "a12_approval_evidence",
    f"WITH {REPORT_SQL} SELECT leaf AS project_id, bool_or(label <> 'PFA' OR pfb IS NOT NULL) AS has_evidence FROM sections WHERE leaf IS NOT NULL GROUP BY 1",
)
def a12_approval_evidence(spark, sf_dir):
    s = report_sections(spark, sf_dir).where("leaf_project_id is not null")
    return derive.approval_evidence(s.withColumn("project_id", F.col("leaf_project_id")))


@query(
    "d09_approval_flag",
    f"""WITH {REPORT_SQL}, ev AS (SELECT leaf, bool_or(label <> 'PFA' OR pfb IS NOT NULL) AS e FROM sections WHERE leaf IS NOT NULL GROUP BY 1)
    SELECT c_custkey AS project_id, c_custkey % 10 = 0 OR coalesce(e, false) AS has_pf FROM customer LEFT JOIN ev ON leaf = c_custkey""",
)
def d09_approval_flag(spark, sf_dir):
    projects = P.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 10 == 0).alias("has_pf"))
    return derive.enable_approval_flag(projects, a12_approval_evidence(spark, sf_dir))


def agreements(spark, sf_dir):
    s = F.col("s_suppkey")
    name = F.concat(F.when(s % 3 == 0, "SV Lph. 1/ 2 ").when(s % 3 == 1, "SV LPH 3 /4 ").otherwise("SV 3/2010 "), F.col("s_name"))
    return P.read(spark, sf_dir, "supplier").select(
        s.alias("finve_id"), (s % 40).alias("project_id"), F.when(s % 11 != 0, name).alias("name"), (s % 4 == 0).alias("is_pooled"),
        F.when(s % 7 != 0, (F.lit(2000) + s % 20).cast("int")).otherwise(0).alias("starting_year"), F.when(s % 13 == 0, "BAU").alias("manual_phase"),
    )


AGREEMENT_SQL = """agreements AS (SELECT s_suppkey AS finve_id, s_suppkey % 40 AS project_id,
  CASE WHEN s_suppkey % 11 <> 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 'SV Lph. 1/ 2 ' WHEN 1 THEN 'SV LPH 3 /4 ' ELSE 'SV 3/2010 ' END || s_name END AS name, s_suppkey % 4 = 0 AS is_pooled,
  CASE WHEN s_suppkey % 7 <> 0 THEN 2000 + s_suppkey % 20 END AS starting_year, CASE WHEN s_suppkey % 13 = 0 THEN 'BAU' END AS manual_phase,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'VORPLANUNG' WHEN s_suppkey % 3 = 1 THEN 'GENEHMIGUNGSPLANUNG' END AS by_name FROM supplier)"""


@query("f06_pooled_phase", f"WITH {AGREEMENT_SQL} SELECT finve_id, by_name AS phase FROM agreements")
def f06_pooled_phase(spark, sf_dir):
    return agreements(spark, sf_dir).select("finve_id", D.pooled_phase(F.col("name")).alias("phase"))


@query(
    "d04_agreement_specs",
    f"""WITH {AGREEMENT_SQL} SELECT project_id, 'FINVE' AS source_type, 'MAIN' AS track, CASE WHEN NOT is_pooled THEN 'BAU' ELSE coalesce(manual_phase, by_name) END AS asserted_state,
      make_date(starting_year, 1, 1) AS observed_date, CASE WHEN is_pooled THEN 0.35::DOUBLE END AS confidence,
      CASE WHEN is_pooled THEN 'Sammel-FinVe (' ELSE 'Finanzierungsvereinbarung (' END || 'FinVe ' || finve_id || coalesce(' · ' || name, '') || ')' AS note, finve_id AS origin_id
      FROM agreements WHERE NOT is_pooled OR coalesce(manual_phase, by_name) IS NOT NULL""",
)
def d04_agreement_specs(spark, sf_dir):
    return derive.agreement_specs(agreements(spark, sf_dir))


STATUS = ("Symbol Bauphase", "Symbol Planungsphase", "gemischter Projektphase Bauphase", "Gesamtprojekt in Bauphase", "", "unbekannt")
_STATUS_SQL = "[" + ", ".join(f"'{s}'" for s in STATUS) + "][(event_id % 6 + 1)::BIGINT]"
_PORTAL_SQL = "CASE event_id % 6 WHEN 0 THEN 'BAU' WHEN 1 THEN 'VORPLANUNG' END"


def portal(spark, sf_dir):
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, STATUS)), (i % 6 + 1).cast("int"))
    return P.read(spark, sf_dir, "events").select(
        i.alias("record_id"), F.col("user_id").alias("project_id"), status.alias("status"), F.when(i % 4 == 0, F.col("event_type")).alias("projecttime"),
        F.to_date("ts").alias("fetched"), (i % 3 != 0).alias("confirmed"),
    )


@query("f07_portal_phase", f"SELECT event_id AS record_id, {_STATUS_SQL} AS status, {_PORTAL_SQL} AS phase FROM events")
def f07_portal_phase(spark, sf_dir):
    return portal(spark, sf_dir).select("record_id", "status", D.portal_phase(F.col("status")).alias("phase"))


@query(
    "d05_portal_specs",
    f"""SELECT user_id AS project_id, 'BAUPORTAL' AS source_type, 'MAIN' AS track, {_PORTAL_SQL} AS asserted_state, ts::DATE AS observed_date, NULL::DOUBLE AS confidence,
      'DB-Bauportal' || CASE WHEN event_id % 4 = 0 THEN ': ' || event_type ELSE '' END AS note, event_id AS origin_id FROM events WHERE event_id % 3 <> 0 AND event_id % 6 < 2""",
)
def d05_portal_specs(spark, sf_dir):
    return derive.portal_specs(portal(spark, sf_dir))


PHASE_WORDS = (*D.MAIN_PHASES, "bau", "UNKNOWN")


def media(spark, sf_dir):
    i = F.col("event_id")
    return P.read(spark, sf_dir, "events").select(
        i.alias("report_id"), F.col("user_id").alias("project_id"), F.element_at(F.array(*map(F.lit, PHASE_WORDS)), (i % 7 + 1).cast("int")).alias("asserted_phase"),
        F.when(i % 2 == 0, F.col("event_type")).alias("publication"), F.when(i % 3 == 0, F.lit("Zitat")).otherwise("").alias("quote"),
        F.when(i % 5 == 0, F.lit("https://x.example/")).alias("url"), F.when(i % 4 == 0, F.to_date("ts")).alias("observed"), F.date_add(F.to_date("ts"), -3).alias("published"),
        (i % 2 == 0).alias("confirmed"),
    )


@query(
    "d06_media_specs",
    """SELECT user_id AS project_id, 'MEDIEN' AS source_type, 'MAIN' AS track,
      ['NICHT_GESTARTET', 'VORPLANUNG', 'GENEHMIGUNGSPLANUNG', 'BAU', 'IN_BETRIEB'][(event_id % 7 + 1)::BIGINT] AS asserted_state,
      CASE WHEN event_id % 4 = 0 THEN ts::DATE ELSE ts::DATE - 3 END AS observed_date, NULL::DOUBLE AS confidence,
      'Medien: ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' — Zitat' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ' — https://x.example/' ELSE '' END AS note, event_id AS origin_id
      FROM events WHERE event_id % 2 = 0 AND event_id % 7 < 5""",
)
def d06_media_specs(spark, sf_dir):
    return derive.media_specs(media(spark, sf_dir))


@query("f41_phase_whitelist", f"SELECT event_id, CASE WHEN event_id % 7 = 5 THEN 'BAU' ELSE ['NICHT_GESTARTET', 'VORPLANUNG', 'GENEHMIGUNGSPLANUNG', 'BAU', 'IN_BETRIEB'][(event_id % 7 + 1)::BIGINT] END AS phase FROM events")
def f41_phase_whitelist(spark, sf_dir):
    i = F.col("event_id")
    word = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, PHASE_WORDS)), (i % 7 + 1).cast("int")))
    return P.read(spark, sf_dir, "events").select("event_id", D.tidy_phase(word).alias("phase"))


CATEGORY_WORDS = ("IN_LPH_1_2", " in_lph_3_4", "COMPLETED_LPH_1_2", "COMPLETED_LPH_3_4 ", "HAS_BAUFINVE", "OTHER", "")
_CATEGORY_SQL = P.case("(o_orderkey % 7)", {0: "VORPLANUNG", 1: "GENEHMIGUNGSPLANUNG", 2: "GENEHMIGUNGSPLANUNG", 3: "BAU", 4: "BAU"})


def announcements(spark, sf_dir):
    o = F.col("o_orderkey")
    return P.read(spark, sf_dir, "orders").select(
        o.alias("announcement_id"), F.col("o_custkey").alias("project_id"), F.year("o_orderdate").alias("announcement_year"),
        F.element_at(F.array(*map(F.lit, CATEGORY_WORDS)), (o % 7 + 1).cast("int")).alias("category"), F.when(o % 9 == 0, "IN_BETRIEB").alias("announced_phase"),
        F.when(o % 4 == 0, F.to_date("o_orderdate")).alias("expected"), F.when(o % 6 == 0, F.date_add(F.to_date("o_orderdate"), 1)).alias("document_date"),
        F.when(o % 2 == 0, F.col("o_orderpriority")).alias("label"), (F.col("o_orderstatus") == "F").alias("confirmed"),
    )


@query("f08_category_phase", f"SELECT o_orderkey AS announcement_id, {_CATEGORY_SQL} AS phase FROM orders")
def f08_category_phase(spark, sf_dir):
    return announcements(spark, sf_dir).select("announcement_id", D.category_phase(F.col("category")).alias("phase"))


@query(
    "d07_announcement_specs",
    f"""SELECT o_custkey AS project_id, 'FULDA_RUNDE' AS source_type, 'MAIN' AS track, CASE WHEN o_orderkey % 9 = 0 THEN 'IN_BETRIEB' ELSE {_CATEGORY_SQL} END AS asserted_state,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE WHEN o_orderkey % 6 = 0 THEN o_orderdate::DATE + 1 ELSE make_date(year(o_orderdate), 1, 1) END AS observed_date,
      NULL::DOUBLE AS confidence, 'Fulda-Runde' || CASE WHEN o_orderkey % 2 = 0 THEN ' (' || o_orderpriority || ')' ELSE '' END AS note, o_orderkey AS origin_id
      FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 9 = 0 OR o_orderkey % 7 < 5)""",
)
def d07_announcement_specs(spark, sf_dir):
    return derive.announcement_specs(announcements(spark, sf_dir))


_ALL_SPECS = (d01_report_specs, d02_section_specs, d04_agreement_specs, d05_portal_specs, d06_media_specs, d07_announcement_specs)


def all_specs(spark, sf_dir):
    return derive.union_specs(*[f(spark, sf_dir) for f in _ALL_SPECS])


def _count_sql() -> str:
    from trackledger.plans.registry import ORACLES

    names = ("d01_report_specs", "d02_section_specs", "d04_agreement_specs", "d05_portal_specs", "d06_media_specs", "d07_announcement_specs")
    parts = " UNION ALL ".join(f"SELECT source_type, track, asserted_state FROM ({ORACLES[n]}) t{i}" for i, n in enumerate(names))
    return f"SELECT source_type, track, asserted_state, count(*) AS n FROM ({parts}) x GROUP BY 1, 2, 3"


@query("u03_union_sources", _count_sql())
def u03_union_sources(spark, sf_dir):
    return all_specs(spark, sf_dir).groupBy("source_type", "track", "asserted_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d08_resync",
    f"""WITH {P.OBS} SELECT project_id, source_type, asserted_state, false AS is_derived, id AS origin_id FROM obs WHERE source_type = 'MANUELL'
      UNION ALL SELECT project_id, source_type, asserted_state, true, id FROM obs WHERE source_type <> 'MANUELL' AND project_id % 10 <> 0
      UNION ALL SELECT user_id, 'BAUPORTAL', {_PORTAL_SQL}, true, event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 6 < 2 AND user_id % 10 = 0""",
)
def d08_resync(spark, sf_dir):
    now = P.observations(spark, sf_dir).select(
        "project_id", "source_type", "asserted_state", (F.col("source_type") != "MANUELL").alias("is_derived"), F.col("id").alias("origin_id")
    )
    ids = now.select("project_id").distinct().where("project_id % 10 = 0")
    new = d05_portal_specs(spark, sf_dir).select("project_id", "source_type", "asserted_state", "origin_id")
    return derive.resync(now, new, ids)


@query("d15_stale", "SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0 OR o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 24 HOURS")
def d15_stale(spark, sf_dir):
    cached = P.read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("computed_at"))
    return derive.stale(cached, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).select("o_orderkey")


@query(
    "f42_years_to_days",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 10.0::DOUBLE * 365.25::DOUBLE, 0)::INTEGER AS days FROM lineitem",
)
def f42_years_to_days(spark, sf_dir):
    li = P.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.years_to_days(F.col("l_quantity") / F.lit(10.0)).alias("days"))


@query("f09_strongest_status", f"WITH {REPORT_SQL} SELECT entry_id, CASE WHEN sc THEN 'IN_BETRIEB' WHEN sb THEN 'BAU' WHEN sp THEN 'VORPLANUNG' END AS phase FROM entries")
def f09_strongest_status(spark, sf_dir):
    return report_entries(spark, sf_dir).select("entry_id", D.strongest_phase(F.col("status_planung"), F.col("status_bau"), F.col("status_abgeschlossen")).alias("phase"))
