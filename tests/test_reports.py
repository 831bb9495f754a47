"""Whole progress reports to entries; lists of project names to projects."""

import pytest
from pyspark.sql import functions as F

from trackledger.operators import linkage, reports

REPORT = """Deutscher Bundestag – Drucksache 20/9
B Schienenwege . . . . . 43
B 4.1.1 L fd. Vorhaben Nr. 2 – ABS Lübeck (VDE Nr. 1) . . . 56
B.4.1.1 ABS Lübeck–Rostock ....... 57
B.4.1.8 Knoten
C Bundesfernstraßen . . . 90
Text vor dem Teil
B Schienenwege
B.4.1 Laufende Vorhaben
# B.4.1.1 ABS X Verkehrliche Zielsetzung
Mehr Kapazität 𝔸
Durchgeführte und geplante Maßnahmen
– Keine, .
Projektkenndaten
Streckenlänge 1.020,5 km
Geschwindigkeit 160/200 km/h
Nr. PFA | Örtlichkeit | Stand
|---|---|
| 1 | Ort A | offen |||| 2030 |
Zwischenzeile
| 2 | B | ||| | 2031 |
| 3 | C | ||| | 2031 |
B 4.3.12 NBS Y   Bauaktivitäten [2023]
frei
Bauaktivitäten [2024]
Baumaßnahmen laufen
Termine
B.4.2.77
C Bundesfernstraßen
B.4.1.9 Straße
"""


def entries(spark, *texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "report_id long, text string").withColumn("block", F.lit("x"))
    return reports.report_entries(frame, **how).orderBy("report_id", "seq").collect()


def test_report(spark):
    first, second, third = entries(spark, REPORT)
    assert (first["vib_section"], first["vib_name_raw"], first["category"]) == ("B.4.1.1", "ABS Lübeck–Rostock", "laufend")
    assert (first["verkehrliche_zielsetzung"], first["sonstiges"]) == ("Mehr Kapazität 𝔸", None)
    assert (first["durchgefuehrte_massnahmen"], first["strecklaenge"], first["geschwindigkeit"]) == ("Keine", 1020.5, "160/200")
    assert [(p["nr_pfa"], p["inbetriebnahme"]) for p in first["pfa_entries"]] == [("1", "2030"), ("2", "2031"), ("3", "2031")]
    assert first["pfa_raw_markdown"].startswith("| 2 |") and first["pfa_raw_markdown"].endswith("2031 |")
    assert (first["status_planung"], first["status_bau"], first["status_abgeschlossen"]) == (True, False, True)
    assert first["raw_text"].startswith("# B.4.1.1") and first["raw_text"].endswith("2031 |\n")
    assert (second["vib_section"], second["vib_lfd_nr"], second["category"], second["vib_name_raw"]) == ("B.4.3.12", "12", "potentiell", "NBS Y")
    # The label on the heading line is the first occurrence.
    assert second["bauaktivitaeten"] == "frei\nBauaktivitäten [2024]\nBaumaßnahmen laufen"
    assert (third["vib_section"], third["vib_name_raw"], third["category"], third["pfa_entries"]) == ("B.4.2.77", "", "neu", [])


def test_only_completed_entries_gather_their_texts(spark):
    text = "B.4.1.2 A\nFußnote\nVerkehrliche Zielsetzung\nmehr Züge\nPlanungsstand\nVorhaben ist abgeschlossen\n"
    (only,) = entries(spark, text)
    assert only["durchgefuehrte_massnahmen"] == "mehr Züge\n\nVorhaben ist abgeschlossen\n\nFußnote"
    assert (only["verkehrliche_zielsetzung"], only["sonstiges"], only["planungsstand"]) == (None, None, "Vorhaben ist abgeschlossen")
    (both,) = entries(spark, text + "Bauaktivitäten\nim Bau\n")
    assert (both["durchgefuehrte_massnahmen"], both["verkehrliche_zielsetzung"]) == ("Vorhaben ist abgeschlossen", "mehr Züge")


def test_bounds_of_a_report(spark):
    assert entries(spark, None, "", "ohne Vorhaben", "B Schienenwege\nnichts\nC Bundesfernstraßen\nB.4.1.1 A") == []
    assert [e["vib_section"] for e in entries(spark, REPORT, whole_text=True)] == ["B.4.1.1", "B.4.1.1", "B.4.1.8", "B.4.1.1", "B.4.3.12", "B.4.2.77", "B.4.1.9"]
    # The next part before the rail part leaves nothing.
    assert entries(spark, "C Bundesfernstraßen\nB Schienenwege\nB.4.1.1 A") == []
    long = "B.4.1.1 A\n" + "Fußnote mit Text\n" * 20_000 + "Planungsstand\nneu begonnen"
    (entry,) = entries(spark, long)
    assert len(entry["raw_text"]) == reports.RAW_LIMIT and entry["planungsstand"] == "neu begonnen" and len(entry["sonstiges"]) == 17 * 20_000 - 1


def test_listed_names(spark):
    lists = spark.createDataFrame([(1, ["Hamburg Kiel", "Nirgendwo", "ABS Hamburg–Kiel"]), (2, ["", None, "München Augsburg"]), (3, []), (4, None)], "list_id int, names array<string>")
    projects = spark.createDataFrame([(7, "Hamburg Kiel"), (3, "München Augsburg"), (9, "Hamburg Kiel"), (1, ""), (2, None)], "id long, name string")
    found = linkage.listed_matches(lists, projects)
    assert [(r["list_id"], r["pos"], r["project_id"]) for r in found.orderBy("list_id", "pos").collect()] == [(1, 0, 7), (1, 1, None), (1, 2, 7), (2, 0, None), (2, 1, None), (2, 2, 3)]
    assert sorted(map(tuple, linkage.listed_projects(found).collect())) == [(1, 7, 0), (2, 3, 2)]


def test_composed_and_decomposed_names_are_one(spark):
    left = spark.createDataFrame([(1, "Mülheim Nord")], "id long, name string")
    right = spark.createDataFrame([(2, "Mülheim Nord")], "id long, name string")
    assert linkage.matches(left, right, 0.45).first()["score"] == pytest.approx(1.0)
