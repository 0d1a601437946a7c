"""Field rules, unnesting and numbering, one fixture per entity."""

import pytest

from lodestrata.operators import audit, shred
from lodestrata.plans.entities import ENTITIES, get
from lodestrata.sources.dumps import read_records


def records(spark, *xml):
    return spark.createDataFrame([(x,) for x in xml], "xml string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tables(spark, entity, body):
    spec = get(entity)
    return shred.shred(shred.stage(records(spark, *body), spec), spec)


@pytest.fixture(scope="module")
def all_tables(spark, tmp_path_factory):
    from tests.conftest import DUMPS

    out = {}
    for name, body in DUMPS.items():
        path = tmp_path_factory.mktemp("d") / f"x_{name}.xml"
        path.write_text(f"<{name}>\n{body}</{name}>\n")
        spec = get(name)
        staged = shred.stage(read_records(spark, str(path), spec).select("xml"), spec)
        out |= {k: (v.schema, rows(v)) for k, v in shred.shred(staged, spec).items()}
    return out


def test_21_tables_with_declared_schemas(all_tables):
    declared = {t.name: t.schema for e in ENTITIES.values() for t in e.tables}
    assert len(declared) == 21 and set(all_tables) == set(declared)
    for name, (schema, _) in all_tables.items():
        assert [(f.name, f.dataType.simpleString()) for f in schema.fields] == [(f.name, f.dataType.simpleString()) for f in declared[name].fields]


def test_artists(all_tables):
    assert all_tables["artists"][1] == [
        (11, "Fine", "Ada & Co", ["A.", "  "], "first\nsecond", " Ada B ", ["http://a"]),
        (12, "Poor", "Bo", [], "", "", []),
    ]
    assert all_tables["artist_aliases"][1] == [(11, 21, "Al")]
    assert all_tables["artist_groups"][1] == [(11, 31, "Gr")]
    assert all_tables["artist_members"][1] == [(11, 41, "M1"), (11, 42, "M2")]


def test_labels_with_pretty_printed_sublabels(all_tables):
    assert all_tables["labels"][1] == [(5, "street", "Fine", "Big", 4, "Huge", "p", ["u1", "u2"]), (9, "", "Poor", "Solo", None, "", "", [])]
    assert all_tables["label_sublabels"][1] == [(5, 6, "Small"), (5, 7, "Tiny")]


def test_masters_keep_empty_names_and_null_rules(all_tables):
    assert all_tables["masters"][1] == [(101, "Fine", ["Rock"], 7, "n", ["Punk"], "T", 1999), (102, "Poor", [], None, "", [], "U", None)]
    assert all_tables["master_artists"][1] == [(101, 11, "A", "&", "Ada"), (101, 12, "", "", "")]
    assert all_tables["master_videos"][1] == [(101, "", None, None, "s2", "w"), (101, "d", 60, True, "s1", "v")]


def test_releases(all_tables):
    assert all_tables["releases"][1] == [
        (1001, "DE", "Fine", ["Rock"], True, 101, "n", "2001-00-00", "Accepted", ["Punk"], "R"),
        (1002, "", "Poor", [], None, None, "", "", "Draft", [], "S"),
    ]
    assert all_tables["release_artists"][1] == [(1001, 11, "", ",", "Ada")]
    assert all_tables["release_extraartists"][1] == [(1001, 14, "E", "Eve", "Mix", "1 to 2")]
    assert all_tables["release_labels"][1] == [(1001, 5, "C1", "Big")]
    assert all_tables["release_series"][1] == [(1001, 8, "2", "Ser")]
    assert all_tables["release_formats"][1] == [(1001, ["Album"], "CD", "1", "t")]
    assert all_tables["release_identifiers"][1] == [(1001, "x", "Barcode", "123")]
    assert all_tables["release_videos"][1] == [(1001, "", 0, False, "z", "w"), (1001, "d", 0, True, "s", "v")]
    assert all_tables["release_companies"][1] == [(1001, 77, "c", "Pressed By", "4", "Plant")]


def test_tracks_are_numbered_in_pre_order_one_level_deep(all_tables):
    assert all_tables["release_tracks"][1] == [(1001, 0, None, "3:00", "A", "One"), (1001, 1, 0, "", "A1", "Sub"), (1001, 2, 0, "", "A2", "Sub2"), (1001, 3, None, "", "B", "Two")]
    assert all_tables["release_track_artists"][1] == [(1001, 0, 11, "", "", "Ada"), (1001, 2, 12, "", "", "Bo")]
    assert all_tables["release_track_extraartists"][1] == [(1001, 0, 14, "", "Eve", "Mix")]


def test_numbering_restarts_in_a_second_tracklist(spark):
    got = tables(spark, "releases", ['<release id="1"><tracklist><track><title>a</title></track><track><title>b</title></track></tracklist><tracklist><track><title>c</title></track></tracklist></release>'])
    assert rows(got["release_tracks"]) == [(1, 0, None, "", "", "a"), (1, 0, None, "", "", "c"), (1, 1, None, "", "", "b")]


@pytest.mark.parametrize("entity, xml", [("artists", "<artist><name>x</name><members><name id='1'>m</name></members></artist>"), ("labels", "<label><id></id><name>x</name></label>"), ("masters", "<master><title>x</title></master>"), ("releases", "<release id=''><title>x</title><labels><label id='1'/></labels></release>")])
def test_records_without_id_are_skipped_with_their_children(spark, entity, xml):
    spec = get(entity)
    staged = shred.stage(records(spark, xml), spec)
    assert all(df.count() == 0 for df in shred.shred(staged, spec).values())
    counted, seen = audit.observed(staged)
    counted.collect()
    assert seen.get == {"records": 0, "skipped": 1}


def test_first_id_child_counts_and_other_repeats_are_last_wins_or_add_up(spark):
    got = tables(spark, "artists", ["<artist><id>1</id><id>2</id><name>a</name><name>b</name><urls><url>x</url></urls><urls><url>y</url></urls><aliases><name id='1'>p</name></aliases><aliases><name id='2'>q</name></aliases></artist>"])
    assert [(r.id, r.name, r.urls) for r in got["artists"].collect()] == [(1, "b", ["y"])]
    assert rows(got["artist_aliases"]) == [(1, 1, "p"), (1, 2, "q")]


def test_is_main_release_present_but_empty_is_false(spark):
    got = tables(spark, "releases", ['<release id="1"><master_id is_main_release="">3</master_id></release>'])["releases"].collect()[0]
    assert got.is_main_release is False and got.master_id == 3


@pytest.mark.parametrize("xml", ['<master id="x1"/>', '<master id="1"><year>MCM</year></master>', '<master id="99999999999"/>', '<master id="1"><title>x</master>', '<master id="1"><videos><video duration="no"/></videos></master>'])
def test_bad_numbers_and_malformed_xml_fail(spark, xml):
    with pytest.raises(Exception):  # noqa: B017
        for df in tables(spark, "masters", [xml]).values():
            df.collect()


def test_unknown_siblings_are_ignored_and_reported_by_the_strict_audit(spark):
    xml = '<release id="1" x="y"><odd/><artists><foo/><artist><id>1</id><name>n</name><bar/></artist></artists><tracklist><track><title>t</title><baz><deep/></baz></track></tracklist></release>'
    assert rows(tables(spark, "releases", [xml])["release_artists"]) == [(1, 1, "", "", "n")]
    assert audit.unknown_paths(records(spark, xml), get("releases")) == ["_x", "artists/artist/bar", "artists/foo", "odd", "tracklist/track/baz"]


def test_tag_names_are_case_sensitive_in_the_audit(spark):
    assert audit.unknown_paths(records(spark, "<label><id>1</id><parentlabel/></label>"), get("labels")) == ["parentlabel"]


def test_duplicate_child_rows_are_kept(spark):
    got = tables(spark, "releases", ['<release id="1"><labels><label id="1" name="a"/><label id="1" name="a"/></labels></release>'])
    assert got["release_labels"].count() == 2


def test_key_audits(spark):
    got = tables(spark, "masters", ['<master id="1"/>', '<master id="1"/>', '<master id="2"><artists><artist><id>1</id></artist></artists></master>'])
    assert rows(audit.duplicate_keys(got["masters"])) == [(1, 2)]
    orphaned = {**got, "masters": got["masters"].where("id = 1")}
    assert rows(audit.orphan_counts(orphaned, get("masters"))) == [("master_artists", 1)]
    assert audit.orphan_counts(got, get("masters")).count() == 0


def test_only_the_columns_of_a_table_are_read_from_the_stage(spark, tmp_path):
    from tests.conftest import RELEASES

    spec = get("releases")
    shred.stage(records(spark, *RELEASES.strip().split("\n")), spec).write.parquet(str(tmp_path / "s"))
    plan = shred.project(spark.read.parquet(str(tmp_path / "s")), spec, "release_series")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1]
    assert "series" in schema and "videos" not in schema and "tracks" not in schema and "Exchange" not in plan


@pytest.mark.parametrize("entity, table", [("masters", "masters"), ("releases", "release_labels"), ("releases", "release_tracks")])
def test_a_record_is_parsed_once(spark, entity, table):
    df = shred.shred_table(records(spark, "<a/>"), get(entity), table)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
