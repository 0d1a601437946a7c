"""Registry, DDL, small formats."""

import pytest
from pyspark.sql import types as T

from lodestrata import console
from lodestrata.plans import ddl
from lodestrata.plans.entities import ENTITIES, columns, detect_entity, get, table_groups


def test_registry():
    assert {e: len(s.tables) for e, s in ENTITIES.items()} == {"artists": 4, "labels": 2, "masters": 3, "releases": 12}
    assert [ENTITIES[e].fk for e in ("artists", "labels", "masters", "releases")] == ["artist_id", "label_id", "master_id", "release_id"]
    with pytest.raises(KeyError):
        get("songs")


@pytest.mark.parametrize("name, kind", [("d_20260301_artists.xml.gz", "artists"), ("d_labels.xml", "labels"), ("/x/y_masters.xml.gz", "masters"), ("releases.xml", "releases")])
def test_detect(name, kind):
    assert detect_entity(name) == kind


def test_detect_unknown():
    with pytest.raises(ValueError):
        detect_entity("d_20260301_songs.xml.gz")


def test_groups_are_balanced_and_whole():
    spec = get("releases")
    groups = table_groups(3, spec)
    assert sorted(t for g in groups for t in g) == sorted(spec.table_names)
    weights = [sum(spec.table(t).weight for t in g) for g in groups]
    assert max(weights) - min(weights) < 5 and groups[0][0] == "release_tracks"
    assert len(table_groups(50, get("labels"))) == 2 and table_groups(0, get("labels")) == [["labels", "label_sublabels"]]


def test_postgres_ddl():
    s = T.StructType([*columns("id int!, name text!, n int!, flag bool!, tags list!, maybe int").fields, T.StructField("big", T.LongType())])
    text = ddl.postgres_table("t", s)
    assert text.splitlines()[0] == 'CREATE TABLE "t" (' and '"id" INTEGER NOT NULL,' in text and "\"name\" TEXT NOT NULL DEFAULT ''" in text
    assert '"n" INTEGER NOT NULL DEFAULT 0' in text and '"flag" BOOLEAN NOT NULL DEFAULT false' in text and "\"tags\" TEXT[] NOT NULL DEFAULT '{}'" in text and '"maybe" INTEGER,' in text and '"big" BIGINT' in text
    assert ddl.postgres_table("t", s, unlogged=True).startswith("CREATE UNLOGGED TABLE")


def test_sqlite_ddl():
    s = columns("id int!, parent_id int!, join text!, tags list!, flag bool")
    text = ddl.sqlite_table("t", s, pk="id", fk="parent_id", fk_table="p")
    assert '"id" INTEGER PRIMARY KEY,' in text and '"parent_id" INTEGER NOT NULL DEFAULT 0 REFERENCES "p"("id")' in text and "\"join\" TEXT NOT NULL DEFAULT ''" in text and "\"tags\" TEXT NOT NULL DEFAULT '[]'" in text and '"flag" INTEGER' in text


@pytest.mark.parametrize("make", [ddl.postgres_table, ddl.sqlite_table])
def test_unsupported_type(make):
    with pytest.raises(ValueError, match="Unsupported type"):
        make("t", T.StructType([T.StructField("ts", T.TimestampType())]))


def test_unsupported_list_type():
    with pytest.raises(ValueError, match="Unsupported list value type"):
        ddl.postgres_table("t", T.StructType([T.StructField("ts", T.ArrayType(T.TimestampType()))]))


def test_postgres_statements():
    p = ddl.PostgresStatements(get("labels"), unlogged=True, fk=True, tune=True)
    assert p.drop() == ['DROP TABLE IF EXISTS "label_sublabels" CASCADE', 'DROP TABLE IF EXISTS "labels" CASCADE']
    assert p.primary_key() == ['ALTER TABLE "labels" ADD PRIMARY KEY ("id")'] and p.indexes() == ['CREATE INDEX ON "label_sublabels" ("label_id")']
    assert p.foreign_keys() == ['ALTER TABLE "label_sublabels" ADD FOREIGN KEY ("label_id") REFERENCES "labels"("id")']
    assert len(p.reset_keys()) == 3 and len(p.tuning()) == 3 and len(p.untuning()) == 3 and all("UNLOGGED" in x for x in p.create())
    plain = ddl.PostgresStatements(get("labels"))
    assert plain.foreign_keys() == plain.tuning() == []


@pytest.mark.parametrize("s, text", [(0, "0s"), (59.9, "59s"), (60, "1:00"), (125, "2:05"), (3600, "60:00")])
def test_short_time(s, text):
    assert console.short_time(s) == text


def test_sizes_and_wall_times():
    assert [console.file_size(n) for n in (10, 2048, 3 << 20, 5 << 40)] == ["10 B", "2.0 KB", "3.0 MB", "5.0 TB"]
    assert [console.wall_seconds(t) for t in ("1:02:03", "2:03.5", "7")] == [3723, 123.5, 7]
    with pytest.raises(ValueError):
        console.wall_seconds("soon")


def test_run_stats():
    got = console.run_stats([3.0, None, 1.0, 2.0])
    assert (got["runs"], got["failed"], got["median"], got["min"], got["max"], got["stdev"]) == (3, 1, 2.0, 1.0, 3.0, 1.0)
    assert console.run_stats([None]) == {"runs": 0, "failed": 1} and console.run_stats([5.0])["stdev"] == 0.0
    assert console.system_info()["cpus"] > 0
