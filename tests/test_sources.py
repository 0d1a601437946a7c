"""Finding dumps and cutting them into records."""

import pytest

from lodestrata.plans.entities import get
from lodestrata.sources import dumps


def read(spark, path, entity, **how):
    return sorted(r.xml for r in dumps.read_records(spark, path, get(entity), **how).collect())


@pytest.mark.parametrize("entity", ["artists", "labels", "masters", "releases"])
@pytest.mark.parametrize("frame", [True, False])
@pytest.mark.parametrize("gz", [True, False])
def test_records_come_out_whole(spark, dump, entity, frame, gz):
    got = read(spark, dump(entity, frame=frame, gz=gz), entity)
    tag = get(entity).row_tag
    assert len(got) == 2 and all(x.startswith(f"<{tag}") and x.endswith(f"</{tag}>") for x in got)


@pytest.mark.parametrize("entity, record", [("labels", "<label><id>{i}</id><name>é{i}</name><sublabels>\n<label id='1'>a</label>\n<label id='2'>b</label>\n</sublabels></label>\n"), ("masters", '<master id="{i}"><title>ü{i}</title></master>\n'), ("releases", '<release id="{i}"><released>2000</released></release>\n')])
def test_splits_do_not_change_the_records(spark, dump, entity, record):
    path = dump(entity, "".join(record.format(i=i) for i in range(4000)))
    whole = read(spark, path, entity)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        many = dumps.read_records(spark, path, get(entity))
        assert many.rdd.getNumPartitions() > 4
        assert sorted(r.xml for r in many.collect()) == whole and len(whole) == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("between", ["\r\n", "\n    ", "", "\n\n"])
def test_other_white_space_between_records(spark, dump, between):
    path = dump("masters", between.join(f'<master id="{i}"><title>t</title></master>' for i in range(50)) + "\n")
    assert len(read(spark, path, "masters")) == 50


def test_mixed_white_space_between_records(spark, dump):
    body = '<master id="1"><title>t</title></master>\n<master id="2"><title>t</title></master>\r\n  <master id="3"><title>t</title></master>\n'
    assert len(read(spark, dump("masters", body), "masters")) == 3


def test_jobs(spark, dump, tmp_path):
    dump("artists", gz=True), dump("labels")
    (tmp_path / "notes.txt").write_text("x")
    assert [(j.path.rsplit("/", 1)[1], j.entity) for j in dumps.resolve_jobs(spark, [str(tmp_path)])] == [("dump_20260101_artists.xml.gz", "artists"), ("dump_20260101_labels.xml", "labels")]
    assert dumps.resolve_jobs(spark, [str(tmp_path / "notes.txt")]) == []
    with pytest.raises(FileNotFoundError):
        dumps.resolve_jobs(spark, [str(tmp_path / "missing.xml")])
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        dumps.resolve_jobs(spark, [str(tmp_path / "empty")])
    with pytest.raises(ValueError):
        dumps.resolve_jobs(spark, [dump("artists", name="other_things.xml")])


def test_gzip_files_are_written_out_plain_at_once(spark, dump, tmp_path):
    jobs = [dumps.Job(dump(e, gz=True), e) for e in ("labels", "artists")] + [dumps.Job(dump("masters"), "masters")]
    got = dumps.inflate(spark, jobs, str(tmp_path / "xml"))
    assert [j.entity for j in got] == ["labels", "artists", "masters"] and got[2] == jobs[2]
    assert sorted(p.name for p in (tmp_path / "xml").iterdir()) == ["dump_20260101_artists.xml", "dump_20260101_labels.xml"]
    for a, b in zip(jobs, got, strict=True):
        assert read(spark, a.path, a.entity) == read(spark, b.path, b.entity)


def test_a_plain_file_that_is_there_is_used(spark, dump, tmp_path):
    path = dump("labels", gz=True)
    (tmp_path / "dump_20260101_labels.xml").write_text("<labels>\n<label><id>77</id></label>\n</labels>\n")
    (job,) = dumps.inflate(spark, [dumps.Job(path, "labels")])
    assert job.path == path.removesuffix(".gz") and read(spark, job.path, "labels") == ["<label><id>77</id></label>"]


@pytest.mark.parametrize("harm", [lambda b: b[:-12], lambda b: b"no gzip at all" + b])
def test_a_damaged_file_is_named_and_leaves_nothing(spark, dump, tmp_path, harm):
    good, path = dump("artists", gz=True), dump("labels", gz=True)
    with open(path, "rb") as f:
        data = harm(f.read())
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(dumps.DecompressError, match="labels.xml.gz"):
        dumps.inflate(spark, [dumps.Job(good, "artists"), dumps.Job(path, "labels")], str(tmp_path / "xml"))
    assert not [p for p in (tmp_path / "xml").iterdir() if "labels" in p.name]


def test_partitions_bound_the_tasks_that_parse(spark, dump):
    path = dump("masters", "".join(f'<master id="{i}"><title>t</title></master>\n' for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        assert dumps.read_records(spark, path, get("masters")).rdd.getNumPartitions() > 3
        few = dumps.read_records(spark, path, get("masters"), partitions=3)
        assert few.rdd.getNumPartitions() == 3 and few.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
