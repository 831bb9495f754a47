"""The report importer: assembly of table rows, recovery, confirmation and its guard."""

import pytest
from pyspark.sql import functions as F

from trackledger.operators import imports, upsert
from trackledger.plans import other_queries

HEADER = ["FinVe", "Nr."]


def cells(*first, name="", amount=""):
    row = [*first, *[""] * (3 - len(first)), name, "2012", amount]
    return [*row, *[amount] * (16 - len(row))]


def report(spark):
    rows = [
        cells("B1 7 N1", name="vor dem Kopf"), HEADER, ["1", "2", "3"], ["", None],
        cells("B2 8 N2", name="ABS A\ndavon:\nKap. 1202, Titel 891 01", amount="1.000\n400"), cells("", name="nachrichtlich: Dritte", amount="5"),
        HEADER, cells("YYY 9", name="SV Lph. 1/2"), cells("", name="Erläuterung:\n– Strecke A\nweiter"), cells("", name="– Strecke B"),
        cells("", name="SV verloren\ndavon:\nKap. 1202, Titel 891 02", amount="7\n6"), cells("", name="– Strecke C"), cells("B3 L 06", name="ohne Nummer"),
        cells("", name="Kap. 1202 Titel 891 03"), cells("", name="SV unbekannt\ndavon:\nKap. 1 Titel 2 3"), cells("B4", "1.200", "N 9", name="NBS B"), cells("", name="– kein Sammelposten"),
    ]
    return spark.createDataFrame([("f", i, c) for i, c in enumerate(rows)], "path string, row_no long, cells array<string>")


def test_assembly_and_recovery(spark):
    pages = spark.createDataFrame([("f", "x\nYYY 44 SV verloren 2012 4"), ("f", "YYY 45 SV verloren 2013 5")], "path string, text string")
    entries, titles, unmatched = imports.assemble_report(report(spark), pages.limit(1))
    got = {r["finve_nr"]: r for r in entries.collect()}
    assert set(got) == {8, 9, 44, 1200}
    assert (got[8]["lfd_nr"], got[8]["plan_nr"], got[8]["name"], got[8]["cost_estimate_original"]) == ("B2", "N2", "ABS A", 1000)
    assert got[9]["items"] == ["Strecke A weiter", "Strecke B"] and got[9]["pooled"]
    assert (got[44]["lfd_nr"], got[44]["items"], got[44]["year_planned"]) == ("YYY", ["Strecke C"], 7)
    assert (got[1200]["lfd_nr"], got[1200]["plan_nr"], got[1200]["items"]) == ("B4", "N 9", [])
    assert [(r["lfd_nr"], r["plan_nr"], r["name"]) for r in unmatched.collect()] == [("B3", "L 06", "ohne Nummer")]
    keys = sorted((r["finve_nr"], r["titel_key"], r["veranschlagt"]) for r in titles.collect())
    assert keys == [(8, "891_01", 400), (8, "nachrichtlich: Dritte", 5), (44, "891_02", 6)]
    lost, _, _ = imports.assemble_report(report(spark))
    assert {r["finve_nr"] for r in lost.collect()} == {8, 9, 1200}


def test_second_import_is_refused_and_repeat_is_silent(spark, sf_dir):
    c = other_queries.confirmed(spark, sf_dir)
    done = c.receipt.first()["confirmed_at"]
    assert done is not None
    entries, titles, unmatched = imports.assemble_report(report(spark))
    wanted = spark.createDataFrame([(8, 1)], "finve_id int, project_id int")
    tables = dict(finves=c.finves, budgets=c.budgets, titles=c.titles, facts=c.facts, links=c.links, now=F.current_date())
    with pytest.raises(Exception, match="already imported"):
        imports.confirm_import(2026, c.receipt, entries, titles, wanted, unmatched, **tables).finves.collect()
    fresh = spark.createDataFrame([(2, None)], "parse_id int, confirmed_at date")
    once = imports.confirm_import(2027, fresh, entries, titles, wanted, unmatched, **tables)
    again = tables | dict(finves=once.finves, budgets=once.budgets, titles=once.titles, facts=once.facts, links=once.links)
    twice = imports.confirm_import(2027, fresh, entries, titles, wanted, unmatched, **again)
    assert once.budget_audit.where("action = 'CREATE'").select("fin_ve").distinct().count() == 3
    assert twice.finve_audit.count() == 0 and twice.budget_audit.count() == 0
    assert sorted(map(tuple, twice.links.collect()), key=str) == sorted(map(tuple, once.links.collect()), key=str)
    assert twice.facts.count() == once.facts.count()


def test_resolving_only_marks(spark):
    q = spark.createDataFrame([(1, "a", False), (2, "b", False)], "row_id int, name string, resolved boolean")
    got = imports.resolve_unmatched(q, spark.createDataFrame([(2,)], "row_id int"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", False), (2, "b", True)]
    assert upsert.BUDGET_FIELDS and len(upsert.FINVE_FIELDS) == 4
