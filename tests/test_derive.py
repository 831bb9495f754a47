"""Rules of the derivation, one small frame per case; ``today`` is injected."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trackledger.functions import dates
from trackledger.functions import domain as D
from trackledger.operators import derive, tree

TODAY = dt.date(2026, 6, 18)
OBS = "id long, project_id long, source_type string, track string, asserted_state string, observed_date date, confidence double, is_expected boolean"
PROJECT = "project_id long, has_pf boolean, parl_relevant boolean, phase_override string, pf_override string, parl_override string, lifecycle string"


def obs(i, state, *, source="MANUELL", track="MAIN", day=TODAY, conf=None, expected=False, project=1):
    return (i, project, source, track, state, day, conf, expected)


def derived(spark, rows, **flags):
    one = dict(project_id=1, has_pf=True, parl_relevant=True, phase_override=None, pf_override=None, parl_override=None, lifecycle=None) | flags
    projects = spark.createDataFrame([tuple(one.values())], PROJECT)
    return derive.state_of_projects(projects, spark.createDataFrame(rows, OBS), F.lit(TODAY)).first()


@pytest.mark.parametrize(
    "rows, phase, confidence",
    [
        ([], "NICHT_GESTARTET", 0.0),
        ([obs(1, "BAU", source="MEDIEN"), obs(2, "VORPLANUNG")], "VORPLANUNG", 0.9),
        ([obs(1, "BAU", conf=0.5), obs(2, "IN_BETRIEB", conf=0.5), obs(3, "VORPLANUNG", conf=0.4)], "IN_BETRIEB", 0.5),
        ([obs(1, "BAU", conf=0.0)], "NICHT_GESTARTET", 0.0),
        ([obs(1, "BAU", source="VIB", day=dt.date(1990, 1, 1))], "BAU", 0.18),
        ([obs(1, "BAU", source="MEDIEN", day=dt.date(1990, 1, 1))], "NICHT_GESTARTET", 0.0),
        ([obs(1, "BAU", source="OTHER", day=None)], "BAU", 0.3),
        ([obs(1, "BAU", day=TODAY - dt.timedelta(365))], "BAU", 0.45),
        ([obs(1, "BAU", day=TODAY + dt.timedelta(99))], "BAU", 0.9),
        ([obs(1, "FLUG", conf=1.0), obs(2, "BAU", conf=0.2)], "BAU", 0.2),
        ([obs(1, "IN_BETRIEB", expected=True), obs(2, "BAU", conf=0.2)], "BAU", 0.2),
        ([obs(1, "BAU", conf=0.14996)], "BAU", 0.15),
    ],
)
def test_headline(spark, rows, phase, confidence):
    got = derived(spark, rows)
    assert (got["computed_phase"], got["computed_confidence"]) == (phase, confidence)
    assert got["is_known"] == (confidence > 0)


def test_gates_overrides_and_tracks(spark):
    rows = [obs(1, "LAEUFT", track="PF"), obs(2, "ABGESCHLOSSEN", track="PF", conf=0.14996), obs(3, "ABGESCHLOSSEN", track="PARL")]
    got = derived(spark, rows)
    assert (got["pf_state"], got["parl_state"], got["is_known"]) == ("LAEUFT", "ABGESCHLOSSEN", False)
    got = derived(spark, rows, has_pf=False, parl_override="OFFEN", phase_override="BAU", lifecycle="PAUSIERT")
    assert (got["pf_state"], got["parl_state"], got["effective_phase"], got["computed_phase"]) == (None, "OFFEN", "BAU", "NICHT_GESTARTET")
    assert got["is_overridden"] and got["is_known"] and got["lifecycle"] == "PAUSIERT"
    assert derived(spark, [])["pf_state"] == "OFFEN"


def test_contributions_mark_all_tied_rows(spark):
    rows = [obs(1, "BAU", conf=0.5), obs(2, "BAU", conf=0.50001), obs(3, "VORPLANUNG", conf=0.5), obs(4, "BAU", conf=0.1), obs(5, "LAEUFT", track="PF", conf=0.9)]
    got = derive.contributions(spark.createDataFrame(rows, OBS), F.lit(TODAY)).collect()
    assert {r["id"] for r in got if r["was_decisive"]} == {1, 2} and len(got) == 5


def test_headline_does_not_depend_on_order(spark):
    rng = random.Random(4)
    rows = [obs(i, rng.choice(D.MAIN_PHASES), source=rng.choice(list(D.TRUST)), conf=rng.choice([None, 0.2, 0.4]), project=i % 5) for i in range(60)]
    want = None
    for _ in range(3):
        rng.shuffle(rows)
        got = sorted(map(tuple, derive.headline(spark.createDataFrame(rows, OBS), F.lit(TODAY)).collect()))
        want = want or got
        assert got == want


DATES = {
    "2024-03-15": (2024, 3, 15), "01.03.2024": (2024, 3, 1), "1.3.2024": (2024, 3, 1), "Q2 2025": (2025, 5, 15), "2. Quartal 2025": (2025, 5, 15), "II/2025": (2025, 5, 15),
    "IV / 2026": (2026, 11, 15), "12/2024": (2024, 12, 15), "03.2024": (2024, 3, 15), "März 2024": (2024, 3, 15), "Mitte 2026": (2026, 7, 15), "Ende 2027": (2027, 12, 15),
    "voraussichtlich 2025": (2025, 7, 1), "2024-2026": (2024, 7, 1), ">2024": (2024, 7, 1), "Frühjahr 2030": (2030, 4, 15), "im Sept 2021": (2021, 9, 15), "iiv/2025": (2025, 7, 1),
    "13/2024": (2024, 7, 1), "31.02.2024": None, "": None, "-": None, "–": None, "offen": None, "k.A.": None, "n/a": None, "text": None, "1850": None, "Mai 1850": None,
    "Mai 0007 2024": None, None: None,
    "13/2024 und 05/2025": (2024, 7, 1), "13/2024, Mai": (2024, 5, 15), "1Quartal\t2024": (2024, 2, 15), "3 . Quartal, etwa 20251": (2025, 8, 15), "Q4\n2024": (2024, 7, 1),
    "2024-05-01T10:00": (2024, 7, 1), "am 2024-5-1.": (2024, 5, 1), "2024-13-01 01.01.2024": None, "x01.02.2024": (2024, 2, 15), "1.2.20245": None, "29.02.2023": None,
    "29.02.2024": (2024, 2, 29), "Jahresende 2027": (2027, 12, 15), "Mai_x 2024": (2024, 7, 1), "Dez. oder Mai 2024": (2024, 5, 15), "Winter, Anfang 2024": (2024, 2, 15),
    "IIV/2025, II/2026": (2025, 7, 1), "XII/2025": (2025, 7, 1), "iii /2025": (2025, 8, 15), "\toffen\n": None, "0/2024": (2024, 7, 1), "2101": None, "99.99.9999": None,
}


def test_free_text_dates(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", dates.parse_flexible_date(F.col("t")).alias("d")).collect()}
    assert got == {t: dt.date(*v) if v else None for t, v in DATES.items()}


def test_forecast_cases(spark):
    today = dt.date(2026, 1, 1)
    day = lambda n: today + dt.timedelta(n)
    sections = spark.createDataFrame(
        [(1, day(10), day(100), day(900)), (1, day(5), day(50), day(1000)), (2, None, None, None)], "project_id long, datum_pfb date, baubeginn date, inbetriebnahme date"
    )
    pair = "project_id long, phase string, date date"
    announced = spark.createDataFrame([(1, "BAU", day(50)), (1, "IN_BETRIEB", day(700)), (3, "BAU", day(-4))], pair)
    manual = spark.createDataFrame([(1, "GENEHMIGUNGSPLANUNG", day(40), 1), (1, "GENEHMIGUNGSPLANUNG", day(60), 2)], pair + ", seq long")
    concrete = derive.milestones(sections, announced, manual)
    got = {(r["project_id"], r["phase"]): (r["date"], r["source"]) for r in concrete.collect()}
    assert got[(1, "BAU")] == (day(50), "VIB-PFA") and got[(1, "IN_BETRIEB")] == (day(700), "Fulda-Runde")
    assert got[(1, "GENEHMIGUNGSPLANUNG")] == (day(60), "Manuell")
    projects = spark.createDataFrame(
        [(1, "VORPLANUNG", 1.0, 2.0), (2, "GENEHMIGUNGSPLANUNG", 1.0, 2.0), (3, "GENEHMIGUNGSPLANUNG", None, 1.0), (4, "IN_BETRIEB", 1.0, 1.0), (5, "BAU", None, 1.0)],
        "project_id long, effective_phase string, planning_years double, build_years double",
    )
    rows = {(r["project_id"], r["step"]): r for r in derive.forecast(projects, concrete, F.lit(today)).collect()}
    assert rows[(1, 1)]["expected_date"] == day(60) and rows[(1, 1)]["remaining"] == "noch ca. 2 Monate in der aktuellen Phase"
    assert (rows[(2, 1)]["expected_date"], rows[(2, 1)]["source"]) == (day(365), "BVWP") and rows[(2, 2)]["expected_date"] == day(365 + 730)
    assert rows[(3, 1)]["remaining"] == "Termin voraussichtlich überschritten" and rows[(3, 2)]["expected_date"] == day(-4 + 365)
    assert (4, 1) not in rows and rows[(5, 1)]["expected_date"] == day(365)


def slow_rollup(children, pins, phases, node):
    if not children.get(node):
        return [p for p in [pins.get(node) or phases.get(node)] if p]
    if pins.get(node):
        return [pins[node]]
    return [p for c in children[node] for p in slow_rollup(children, pins, phases, c)]


def test_rollup_equals_recursion_on_random_trees(spark):
    rng = random.Random(9)
    nodes, children = [(0, None)], {}
    for i in range(1, 60):
        up = rng.randrange(max(0, i - 12), i)
        if i % 20 == 0:
            up = None
        nodes.append((i, up))
        children.setdefault(up, []).append(i)
    pins = {i: rng.choice(D.MAIN_PHASES) for i, _ in nodes if rng.random() < 0.1}
    phases = {i: rng.choice(D.MAIN_PHASES) for i, _ in nodes if rng.random() < 0.6}
    df = spark.createDataFrame([(i, u, f"n{i}", pins.get(i)) for i, u in nodes], "project_id long, superior_id long, name string, pin string")
    leaf = spark.createDataFrame(list(phases.items()), "project_id long, phase string")
    for r in tree.rollup(df, leaf).collect():
        want = slow_rollup(children, pins, phases, r["project_id"])
        top = max(map(D.MAIN_PHASES.index, want)) if want else 0
        assert (r["is_known"], r["n_phases"], r["display_phase"]) == (bool(want), len(want), D.MAIN_PHASES[top])
        spans = bool(children.get(r["project_id"])) and not pins.get(r["project_id"]) and bool(want)
        assert (r["span_high"] is not None) == spans


def test_cycles_raise(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "project_id long, superior_id long, name string")
    with pytest.raises(Exception, match="cyclic"):
        tree.closure(df).collect()


def test_notes_and_small_maps(spark):
    rows = spark.createDataFrame([("Blatt", "Zitat", "u"), (None, "", None), ("Blatt", None, "u")], "p string, q string, u string")
    got = [r[0] for r in rows.select(D.media_note(F.col("p"), F.col("q"), F.col("u"))).collect()]
    assert got == ["Medien: Blatt — Zitat — u", "Medien", "Medien: Blatt — u"]
    names = spark.createDataFrame([("SV Lph. 1/2 A",), ("SV Lph. 3/ 4",), ("SV 3/2010 (EKrG)",), (None,), ("lph 5",)], "n string")
    assert [r[0] for r in names.select(D.pooled_phase(F.col("n"))).collect()] == ["VORPLANUNG", "GENEHMIGUNGSPLANUNG", None, None, None]


def test_cycles_raise_in_a_roll_up(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "project_id long, superior_id long").withColumn("pin", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="cyclic"):
        tree.rollup(df, spark.createDataFrame([], "project_id long, phase string")).collect()


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    real = tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: rounds.append(1) or real(df))
    chain = spark.range(n).select(F.col("id").alias("project_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("superior_id"))
    values = spark.range(n).select(F.col("id").alias("node_id"), (F.col("id") % 977).cast("int").alias("ord"))
    got = {r["node_id"]: (r["lo"], r["hi"], r["n"]) for r in tree.folded(chain, values).collect()}
    lo, hi = 10**9, -1
    for i in range(n - 1, -1, -1):
        lo, hi = min(lo, i % 977), max(hi, i % 977)
        assert got[i] == (lo, hi, n - i)
    assert len(rounds) <= 14


def test_closure_of_a_forest_with_halts_and_lost_superiors(spark):
    rng = random.Random(5)
    up = {i: rng.choice([None, 999, *range(max(0, i - 6), i)]) if i else None for i in range(60)}
    halt = {i: rng.random() < 0.15 for i in up}
    df = spark.createDataFrame([(i, p, halt[i]) for i, p in up.items()], "project_id long, superior_id long, h boolean")
    for stop in (None, "h"):
        want = set()
        for i in up:
            at, d = i, 0
            while at in up:
                want.add((at, i, d))
                at, d = up[at], d + 1
                if stop and halt.get(at):
                    break
        got = [tuple(r) for r in tree.closure(df, stop).collect()]
        assert len(got) == len(set(got)) and set(got) == want
