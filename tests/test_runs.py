"""Sinks, whole runs, command line, stream."""

import json
import os
import re
import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest

from lodestrata import cli
from lodestrata.operators import shred
from lodestrata.plans.entities import ENTITIES, get
from lodestrata.run import Config, run
from lodestrata.sinks import JsonLinesSink, OutputExists, ParquetSink, get_sink
from lodestrata.sinks.postgres import PostgresSink, jdbc_target
from lodestrata.sinks.sqlite import SqliteSink
from lodestrata.sources.dumps import DecompressError, EmptyDump, Job, MalformedDump


def go(spark, path, entity, sink, tmp_path, **how):
    return run(spark, Config(Job(path, entity), sink, str(tmp_path / "stage"), **how))


@pytest.mark.parametrize("codec", ["zstd", "snappy", "gzip", "none"])
def test_parquet(spark, dump, tmp_path, codec):
    got = go(spark, dump("labels", gz=codec == "gzip"), "labels", ParquetSink(str(tmp_path / "o"), codec), tmp_path, strict=True)
    assert (got.records, got.skipped, got.unknown) == (2, 0, []) and set(got.tables) == {"labels", "label_sublabels"} and not os.path.exists(tmp_path / "stage" / "labels")
    assert spark.read.parquet(str(tmp_path / "o/labels/labels.parquet")).count() == 2
    with pytest.raises(OutputExists):
        go(spark, dump("labels"), "labels", ParquetSink(str(tmp_path / "o")), tmp_path)
    go(spark, dump("labels"), "labels", ParquetSink(str(tmp_path / "o"), overwrite=True), tmp_path)
    assert spark.read.parquet(str(tmp_path / "o/labels/labels.parquet")).count() == 2


@pytest.mark.parametrize("codec, suffix", [("none", ".jsonl"), ("gzip", ".jsonl.gz"), ("bzip2", ".jsonl.bz2")])
def test_jsonl(spark, dump, tmp_path, codec, suffix):
    go(spark, dump("masters"), "masters", JsonLinesSink(str(tmp_path / "o"), codec), tmp_path)
    got = spark.read.text(str(tmp_path / f"o/masters/masters{suffix}")).collect()
    row = next(x for x in (json.loads(r.value) for r in got) if x["id"] == 102)
    assert row == {"id": 102, "data_quality": "Poor", "genres": [], "main_release": None, "notes": "", "styles": [], "title": "U", "year": None}


def test_an_empty_table_keeps_its_schema(spark, dump, tmp_path):
    go(spark, dump("artists", "<artist><id>1</id><name>x</name></artist>\n"), "artists", ParquetSink(str(tmp_path / "o")), tmp_path)
    got = spark.read.parquet(str(tmp_path / "o/artists/artist_members.parquet"))
    assert got.columns == ["artist_id", "member_id", "name"] and got.count() == 0


@pytest.mark.parametrize("entity", sorted(ENTITIES))
def test_sqlite_loads_all_entities(spark, dump, tmp_path, entity):
    path = str(tmp_path / "x.db")
    go(spark, dump(entity), entity, get_sink(path, fk=True), tmp_path)
    with sqlite3.connect(path) as db:
        assert db.execute(f'SELECT count(*) FROM "{entity}"').fetchone() == (2,)
        names = {r[0] for r in db.execute("SELECT name FROM sqlite_master")}
        assert not any(n.startswith("_stage") for n in names) and all(f"{t.name}_{get(entity).fk}_idx" in names for t in get(entity).tables[1:])
        if entity == "masters":
            assert db.execute("SELECT genres FROM masters WHERE id = 101").fetchone() == ('["Rock"]',)
            assert db.execute('SELECT "join" FROM master_artists WHERE artist_id = 11').fetchone() == ("&",)
    with pytest.raises(OutputExists):
        go(spark, dump(entity), entity, get_sink(path), tmp_path)


def test_sqlite_reads_back_and_reports_orphans(spark, tmp_path):
    spec, path = get("masters"), str(tmp_path / "x.db")
    sink = SqliteSink(path, fk=True)
    sink.prepare(spark, spec)
    videos = spark.createDataFrame([(5, "é", None, True, "s", "t")], spec.table("master_videos").schema)
    sink.write("master_videos", videos, spec)
    assert sink.finalize(spark, spec) == ["master_videos: 1 rows refer to no masters"]
    back = spark.read.format("lodestrata_sqlite").schema(spec.table("master_videos").schema).option("path", path).option("dbtable", "master_videos").load()
    assert [tuple(r) for r in back.collect()] == [(5, "é", None, True, "s", "t")]


def test_sqlite_memory_does_not_grow_with_the_table(tmp_path):
    """Commit and indexes of four million rows in a process of their own."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from lodestrata.plans.entities import MASTERS
from lodestrata.sinks import sqlite as s
path, own, schema = {str(tmp_path / "x.db")!r}, "_stage_master_artists_" + "a" * 32, MASTERS.table("master_artists").schema
used = lambda what: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(what)) // 1024
first = used("VmRSS")
db = s.connect(path)
for statement in [*s.ddl.sqlite_entity(MASTERS), s.ddl.sqlite_table(own, schema)]:
    db.execute(statement)
db.execute(f"INSERT INTO {{own}} WITH RECURSIVE c(x) AS (SELECT 0 UNION ALL SELECT x + 1 FROM c WHERE x < 3999999) SELECT (x * 7919) % 1000003, x, '', '', '' FROM c")
db.commit()
db.close()
s._Writer(path, "master_artists", schema).commit([s.Staged(own, 4_000_000)])
s.SqliteSink(path).finalize(None, MASTERS)
with s.contextlib.closing(s.connect(path)) as db:
    print(db.execute("SELECT count(*) FROM master_artists").fetchone()[0], used("VmHWM") - first)
"""
    rows, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert rows == 4_000_000 and grown < 180


def test_sqlite_many_batches_keep_types(spark, tmp_path):
    """Lists, flags and nulls over more rows than a batch holds."""
    spec, path = get("releases"), str(tmp_path / "x.db")
    schema = spec.table("releases").schema
    df = spark.range(25_000).selectExpr("cast(id AS int) AS id", "'' AS country", "'é' AS data_quality", "IF(id % 3 = 0, array(), array('\"', cast(id AS string))) AS genres", "IF(id % 3 = 1, NULL, id % 3 = 0) AS is_main_release", "cast(IF(id % 2 = 0, NULL, id) AS int) AS master_id", "'' AS notes", "'' AS released", "'' AS status", "array('a') AS styles", "'t' AS title").select(*schema.names)
    sink = SqliteSink(path)
    sink.prepare(spark, spec)
    sink.write("releases", df, spec)
    back = spark.read.format("lodestrata_sqlite").schema(schema).option("path", path).option("dbtable", "releases").load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("dsn, kind", [("postgresql://u:p@h:1/d", PostgresSink), ("sqlite:///x", SqliteSink), ("x.db", SqliteSink), ("x.sqlite", SqliteSink), ("x.sqlite3", SqliteSink)])
def test_get_sink(dsn, kind):
    assert isinstance(get_sink(dsn), kind)


@pytest.mark.parametrize("dsn", ["postgres://h/d", "mysql://h/d", "out.parquet", ""])
def test_get_sink_unsupported(dsn):
    with pytest.raises(ValueError):
        get_sink(dsn)


def test_jdbc_target():
    assert jdbc_target("postgresql://u:p%40@h:1/d") == ("jdbc:postgresql://h:1/d", {"driver": "org.postgresql.Driver", "reWriteBatchedInserts": "true", "stringtype": "unspecified", "user": "u", "password": "p@"})


def test_codecs_are_checked():
    with pytest.raises(ValueError):
        ParquetSink("o", "bzip2")
    with pytest.raises(ValueError):
        JsonLinesSink("o", "zstd")


def test_empty_and_truncated_dumps(spark, dump, tmp_path):
    with pytest.raises(EmptyDump):
        go(spark, dump("labels", ""), "labels", ParquetSink(str(tmp_path / "a")), tmp_path)
    with pytest.raises(MalformedDump):
        go(spark, dump("labels", "<label><id>1</id></label>\n<label><id>2</id>", frame=False), "labels", ParquetSink(str(tmp_path / "b")), tmp_path)


@pytest.mark.parametrize("harm", [lambda b: b[:-12], lambda b: b"no gzip at all" + b])
def test_damaged_gzip_names_the_file(spark, dump, tmp_path, harm):
    path = dump("labels", gz=True)
    with open(path, "rb") as f:
        data = harm(f.read())
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(DecompressError, match="labels.xml.gz"):
        go(spark, path, "labels", ParquetSink(str(tmp_path / "o")), tmp_path)


def test_cli(spark, dump, tmp_path, capsys):
    dump("labels"), dump("artists", gz=True)
    assert cli.main(["convert", str(tmp_path), "--output", str(tmp_path / "o"), "--profile", "--strict", "--no-progress"], spark=spark) == 0
    out = capsys.readouterr().out
    assert "2 artists converted" in out and "2 labels converted" in out and "artist_members" in out and re.search(r"Input +\d+ B", out)
    assert cli.main(["convert", str(tmp_path), "--output", str(tmp_path / "o")], spark=spark) == 1
    assert cli.main(["convert", str(tmp_path / "none.xml")], spark=spark) == 1
    assert cli.main(["load", str(tmp_path), "--dsn", "mysql://x"], spark=spark) == 1
    err = capsys.readouterr().err
    assert err.count("Error: ") == 3 and "Traceback" not in err
    assert cli.main(["load", str(tmp_path), "--dsn", str(tmp_path / "l.db")], spark=spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_cli_leaves_other_folders_alone(spark, dump, tmp_path):
    shared = tmp_path / "shared" / "lodestrata-of-others"
    shared.mkdir(parents=True)
    (shared / "keep.txt").write_text("x")
    path = dump("labels", gz=True)
    assert cli.main(["convert", path, "--output", str(tmp_path / "o"), "--stage-dir", str(tmp_path / "shared"), "--parse-workers", "2"], spark=spark) == 0
    assert [p.name for p in (tmp_path / "shared").iterdir()] == ["lodestrata-of-others"] and (shared / "keep.txt").exists()
    assert not os.path.exists(path.removesuffix(".gz"))
    assert cli.main(["convert", path, "--output", str(tmp_path / "p"), "--stage-dir", str(tmp_path / "shared"), "--keep-xml", "--keep-stage"], spark=spark) == 0
    assert os.path.exists(path.removesuffix(".gz")) and len(list((tmp_path / "shared").iterdir())) == 2


def test_cli_stages_where_all_tasks_reach_it(spark, dump, tmp_path, monkeypatch):
    from types import SimpleNamespace

    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    out = str(tmp_path / "o")
    convert, load = cli.parser().parse_args(["convert", "x.xml", "--output", out]), cli.parser().parse_args(["load", "x.xml", "--dsn", "x.db"])
    assert cli.scratch_dir(bare("spark://h:1"), convert).startswith(f"{out}/_lodestrata/lodestrata-")
    assert cli.scratch_dir(bare("local[2]"), load) and cli.scratch_dir(spark, load).startswith(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(ValueError):
        cli.scratch_dir(bare("spark://h:1"), load)
    monkeypatch.setattr(cli, "scratch_dir", lambda *_: f"{out}/_lodestrata/lodestrata-1")
    assert cli.main(["convert", dump("labels", gz=True), "--output", out], spark=spark) == 0
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["labels"]


def test_interrupt(spark, monkeypatch, tmp_path):
    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr("lodestrata.sources.dumps.resolve_jobs", stop)
    assert cli.main(["convert", str(tmp_path)], spark=spark) == 130


def test_landing_stream(spark, tmp_path):
    from lodestrata.streaming.landing import shred_stream

    land, out, log = (str(tmp_path / n) for n in ("land", "out", "log"))
    os.makedirs(land)
    for i in (1, 2):
        (tmp_path / "land" / f"{i}.txt").write_text(f"<label><id>{i}</id><name>n</name><sublabels><label id='9'>s</label></sublabels></label>\n")
        shred_stream(spark, land, get("labels"), out, log).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/labels").collect()) == [1, 2]
    assert spark.read.parquet(f"{out}/label_sublabels").count() == 2


def test_own_entity(spark):
    from lodestrata.plans.entities import EntitySpec, TableSpec, _record, columns, register

    register(EntitySpec("songs", "song", False, _record("_id STRING"), (TableSpec("songs", columns("id int!"), 1),), "song_id"))
    try:
        shred.STAGED["songs"], shred.ROOTS["songs"] = {}, {}
        df = spark.createDataFrame([('<song id="3"/>',)], "xml string")
        assert [tuple(r) for r in shred.shred_table(df, get("songs"), "songs").collect()] == [(3,)]
    finally:
        for d in (ENTITIES, shred.STAGED, shred.ROOTS):
            d.pop("songs", None)


def test_progress_tells_rate_and_time_left(spark):
    import io
    from types import SimpleNamespace

    from lodestrata.console import Progress

    out = io.StringIO()
    p = Progress(spark, "labels", every=0.01, stream=out)
    p.tracker = SimpleNamespace(getActiveStageIds=lambda: [1, 2], getStageInfo=lambda i: SimpleNamespace(numCompletedTasks=5 * i, numTasks=30) if i == 2 else None)
    assert p.line(20) == "labels: 10/30 tasks, 0.5/s, 20s, about 40s left"
    with p:
        p.over.wait(0.1)
    assert "labels: 10/30 tasks" in out.getvalue()


def test_a_server_that_hangs_is_not_waited_for(monkeypatch):
    import threading

    from lodestrata.sinks import postgres

    monkeypatch.setattr(postgres, "CLOSE_SECONDS", 0.05)
    sink, stop = PostgresSink("postgresql://h/d"), threading.Event()
    sink._tuned, sink._spark, sink._execute = ["ALTER SYSTEM RESET x"], object(), lambda _: stop.wait(20)
    with pytest.warns(UserWarning, match="ALTER SYSTEM RESET x"):
        sink.close()
    stop.set()
    sink.close()
