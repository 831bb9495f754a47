"""Readers, writers and the streaming extension."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trackledger.operators import derive, search, upsert, views
from trackledger.plans import domain as P
from trackledger.sources import readers, versions
from trackledger.streaming import live

XML = """<RINF><OperationalPoint ValidityDateStart="2015-01-01" ValidityDateEnd="2099-12-31"><OPName Value="Aachen"/><UniqueOPID Value="DE1"/>
<OPType Value="10" OptionalValue="station"/><OPGeographicLocation Latitude="50,7" Longitude="6,1"/></OperationalPoint>
<SectionOfLine ValidityDateEnd="2099-12-31"><SOLOPStart Value="DE1"/><SOLOPEnd Value="DE2"/><SOLLength Value="1.25"/>
<SOLTrack><SOLTrackIdentification Value="1"/><SOLTrackParameter ID="p1" Value="x"/><SOLTrackParameter ID="p2" Value="y"/></SOLTrack></SectionOfLine></RINF>"""


def test_register(spark, tmp_path):
    path = tmp_path / "r.xml"
    path.write_text(XML)
    op = readers.operational_points(spark, str(path)).first()
    assert (op["op_id"], op["type"], op["latitude"], op["validity_date_end"]) == ("DE1", "station", 50.7, dt.date(2099, 12, 31))
    sol = readers.sections_of_line(spark, str(path)).first()
    assert sol["sol_length"] == 1.25 and [(p["id"], p["value"]) for p in sol["tracks"][0]["parameters"]] == [("p1", "x"), ("p2", "y")]


def test_feed(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[{"id": 1, "shorttitle": "A", "lat": 1.5}, {"id": 2}]')
    (tmp_path / "bad.json").write_text('{"id": 1}')
    rows = readers.json_feed(spark, str(tmp_path / "ok.json")).orderBy("id").collect()
    assert [(r["id"], r["shorttitle"], r["lat"]) for r in rows] == [(1, "A", 1.5), (2, None, None)]
    with pytest.raises(Exception, match="not a JSON array"):
        readers.json_feed(spark, str(tmp_path / "bad.json")).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,flag,name,drop\n1,True,x,y\n2.0,maybe, ,y\nz,,n,y\n")
    rows = readers.csv_coerced(spark, str(tmp_path / "a.csv"), {"id": ("key", "int"), "flag": ("on", "boolean"), "name": ("name", "string")})
    assert [tuple(r) for r in rows.collect()] == [(1, True, "x"), (2, False, None), (None, False, "n")]
    (tmp_path / "b.csv").write_text("id,name\n1,a\nx,b\n,c\n")
    good, bad = readers.csv_checked(spark, str(tmp_path / "b.csv"), "id int, name string", ["id"])
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert sorted(r["reason"] for r in bad.collect()) == ["id is missing", "unreadable"]


def test_attachments_and_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"hello")
    got = {r["name"]: (r["mime"], r["verdict"]) for r in readers.attachments(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("application/pdf", "ok"), "b.txt": (None, "kind not allowed")}
    files = spark.read.format("binaryFile").load(str(tmp_path))

    def extract(content):
        if content.startswith(b"%PDF"):
            return [(1, [["a", None], ["b", "c"]]), (2, [["d"]])]
        raise ValueError("no document")

    rows = readers.page_rows(files, extract).orderBy("path", "row_no").collect()
    assert [(r["page"], r["row_no"], r["cells"]) for r in rows] == [(1, 0, ["a", None]), (1, 1, ["b", "c"]), (2, 2, ["d"]), (0, 0, None)]

    def remote(content):
        if content.startswith(b"%PDF"):
            raise OSError("down")
        return "remote"

    status = {r["path"].rsplit("/")[-1]: r["status"] for r in readers.page_text(files, remote, lambda b: "local").collect()}
    assert status == {"a.pdf": "fallback", "b.txt": "done"}


def test_model_answers_degrade(spark):
    df = spark.createDataFrame([("x",), (None,), ("boom",)], "t string")
    assert [r["answer"] for r in readers.extracted(df, "t", None).collect()] == [None] * 3

    def call(t):
        if t == "boom":
            raise RuntimeError
        return "{}"

    assert [r["answer"] for r in readers.extracted(df, "t", call).collect()] == ["{}", None, None]


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    readers.reload(df, str(tmp_path / "t"))
    readers.reload(spark.range(3), str(tmp_path / "t"))
    assert versions.read(spark, str(tmp_path / "t")).count() == 3
    readers.dump_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5


def test_versions_are_whole_and_pinned(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.record(spark, path) is None
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path)
    first = versions.publish(spark.range(1000).withColumn("x", F.lit(None).cast("string")), path, bucket=F.col("id") % 7)
    held = versions.read(spark, path)

    @F.udf("long")
    def fails(i):
        if i == 990:
            raise RuntimeError("no")
        return i

    with pytest.raises(Exception, match="no"):
        versions.publish(spark.range(1000).withColumn("id", fails("id")), path)
    assert versions.record(spark, path)["version"] == first and versions.read(spark, path).count() == 1000
    second = versions.publish(held.where("id < 10"), path, tag="b")
    assert versions.publish(held, path, tag="b") == second
    assert held.count() == 1000 and versions.read(spark, path).count() == 10
    assert versions.read(spark, path, first).agg(F.sum("id")).first()[0] == 499500
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, second, {})
    assert versions.read(spark, path).columns == ["id", "x"]
    versions.publish(held.limit(0), path)
    assert versions.read(spark, path).count() == 0 and versions.read(spark, path).columns == ["id", "x"]
    versions.vacuum(spark, path, keep=1)
    assert versions._numbers(spark, path) == [3]
    with pytest.raises(ValueError, match="no version 1"):
        versions.read(spark, path, 1)


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "u")
    rows = spark.range(1000).select("id", (F.col("id") * 2).alias("a"), F.lit("old").alias("b"))
    block = F.floor(F.col("id") / 10).cast("int")
    versions.publish(rows, path, bucket=block)
    before = versions.record(spark, path)["folders"]
    staged = spark.createDataFrame([(i, i, "new") for i in range(500, 509)] + [(1000, 1, None), (None, 5, "x")], "id long, a long, b string")
    number, audit = versions.upsert(staged, path, ["id"], ["a", "b"], bucket=block)
    after = versions.record(spark, path)["folders"]
    assert {b for b in after if after[b] != before.get(b)} == {"50", "100", "-1"} and len(before) == 100
    want = {r["id"]: (r["a"], r["b"]) for r in rows.collect()} | {r["id"]: (r["a"], r["b"]) for r in staged.collect()}
    assert {r["id"]: (r["a"], r["b"]) for r in versions.read(spark, path, number).collect()} == want
    plain = upsert.upsert(rows, staged, ["id"], ["a", "b"])[1]
    assert sorted(map(str, audit.collect())) == sorted(map(str, plain.collect()))
    again, none = versions.upsert(staged, path, ["id"], ["a", "b"], bucket=block)
    assert none.count() == 0 and versions.read(spark, path, again).count() == 1002
    fresh = str(tmp_path / "w")
    assert versions.upsert(staged, fresh, ["id"], ["a", "b"], bucket=versions.hashed(["id"], 4))[0] == 1
    assert versions.read(spark, fresh).count() == 11


def test_search_reads_the_buckets_of_its_term(spark, tmp_path):
    words = ["Berlin", "Dresden", "Hof", "Ausbau", "ÄÖÜ", "a_b%c", "", "re", "greife", "x\\y"]
    texts = [f"{words[i % 10]} {words[i * 7 % 10]}{words[i * 3 % 9]}" for i in range(300)]
    rows = spark.createDataFrame([(i, t, None if i % 4 else t[::-1]) for i, t in enumerate(texts)] + [(900, None, None), (901, "", "be")], "id long, a string, b string")
    path = str(tmp_path / "i")
    with pytest.raises(ValueError, match="no index"):
        search.contains(rows, path, "id", "Berlin", "a", "b")
    search.build(rows, path, "id", "a", "b", buckets=64)
    same = lambda x, y: sorted(r["id"] for r in x.select("id").collect()) == sorted(r["id"] for r in y.select("id").collect())
    for term in ("berlin", "äöü", "re", "", "hofdres", "nichts", "nilre", "a_b%", "BERLIN H"):
        assert same(search.contains(rows, path, "id", term, "a", "b", buckets=64), rows.where(views.contains(term, "a", "b")))
    for term in ("ber_in", "berlin%hof", "%", "a\\_b", "", "x_y", "dresden%ausbau%"):
        assert same(search.like_search(rows, path, "id", term, "a", "b", buckets=64), rows.where(views.like_search(term, "a", "b")))
    only = str(tmp_path / "o")
    search.build(rows, only, "id", "a", buckets=64)
    for query in ("Berlin hof", "re", "", "aus BER"):
        assert same(search.all_tokens(rows, only, "id", query, "a", buckets=64), rows.where(views.all_tokens(query, "a")))
    whole = len(versions.read(spark, path).inputFiles())
    one, two = (len(search.postings(spark, path, g, 64).inputFiles()) for g in (["ber"], ["ber", "erl", "rli", "lin"]))
    assert one == 1 and two <= 4 and whole > 20


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = P.observations(spark, sf_dir)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.write_headlines(stream, P.today(), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    batch = derive.headline(rows, P.today()).select("project_id", "computed_phase", "computed_confidence")
    out = versions.read(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_fall_out_of_the_window(spark, sf_dir):
    e = P.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source_type"))
    assert live.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()
