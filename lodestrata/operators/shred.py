"""Records to tables.

A record's XML is parsed once against the entity's schema into a staged table with one level of
arrays; every output table is a projection of it. Child rows carry the record's id, so nothing is
shuffled. Spark does not prune columns inside from_xml, hence the stage: written once, each table
reads only its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import flag, flag_or_false, flag_or_null, int_or_zero, joined, named, present, strict_int, text, text_list
from ..plans.entities import EntitySpec

PARSE_OPTIONS = {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false", "attributePrefix": "_", "valueTag": "_VALUE"}


#: Staged columns whose field in the record has another name.
FIELDS = {"parent_id": "parentLabel", "parent_name": "parentLabel", "status": "_status", "is_main_release": "master_id", "tracks": "tracklist", "track_artists": "tracklist", "track_extraartists": "tracklist"}


def record_schema(spec: EntitySpec, only: list[str] | None = None) -> T.StructType:
    """The record's schema, or the part of it that some staged columns need: from_xml builds all it is told of."""
    if only is None:
        return spec.record
    wanted = {spec.id_field, *(FIELDS.get(n, n) for n in only)}
    return T.StructType([f for f in spec.record.fields if f.name in wanted])


def parse(records: DataFrame, spec: EntitySpec, column: str = "xml", only: list[str] | None = None, *keep: str) -> DataFrame:
    """The records as a struct column `r`; malformed XML fails the query.

    The struct comes out of an explode of one item: filters on its fields cannot be pushed below a generator, so a
    record is parsed once, not once more for each filter.
    """
    return records.select(*keep, F.explode(F.array(F.from_xml(F.col(column), record_schema(spec, only).toDDL(), PARSE_OPTIONS))).alias("r"))


def record_id(spec: EntitySpec) -> Column:
    c = F.col(f"r.{spec.id_field}")
    return F.get(c, F.lit(0)) if spec.id_field == "id" else c


def _numbered(tracklist: Column, credits: str | None) -> Column:
    """Tracks of one tracklist in pre-order with their numbers: a track, then its sub-tracks. With `credits`, (track_idx, credit) pairs instead."""
    tracks = F.coalesce(tracklist["track"], F.array().cast(_TRACKS))
    sizes = F.transform(tracks, lambda t: F.coalesce(F.size(t["sub_tracks"]["track"]), F.lit(0)))
    sizes = F.transform(sizes, lambda n: F.greatest(n, F.lit(0)))

    def number(i: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n)
        return i + before

    def entry(t: Column, idx: Column, parent: Column) -> Column:
        if credits:
            own = named(F.coalesce(t[credits]["artist"], F.array().cast(_CREDIT[credits])))
            return F.transform(own, lambda a: F.struct(idx.alias("track_idx"), a.alias("credit")))
        return F.array(F.struct(idx.alias("track_idx"), parent.alias("parent_idx"), t["position"].alias("position"), t["title"].alias("title"), t["duration"].alias("duration")))

    def one(t: Column, i: Column) -> Column:
        at = number(i)
        subs = F.coalesce(t["sub_tracks"]["track"], F.array().cast(_SUB_TRACKS))
        below = F.flatten(F.transform(subs, lambda s, j: entry(s, at + j + F.lit(1), at)))
        return F.concat(entry(t, at, F.lit(None).cast("int")), below)

    return F.flatten(F.transform(tracks, one))


_CREDIT = {
    "artists": "array<struct<id:string,name:string,anv:string,join:string>>",
    "extraartists": "array<struct<id:string,name:string,anv:string,role:string,tracks:string>>",
}
_TRACK_FIELDS = f"position:string,title:string,duration:string,artists:struct<artist:{_CREDIT['artists']}>,extraartists:struct<artist:{_CREDIT['extraartists']}>"
_SUB_TRACKS = f"array<struct<{_TRACK_FIELDS}>>"
_TRACKS = f"array<struct<{_TRACK_FIELDS},sub_tracks:struct<track:{_SUB_TRACKS}>>>"


def _tracklists(credits: str | None) -> Column:
    """The count starts anew in every tracklist."""
    return F.flatten(F.transform(F.filter(F.col("r.tracklist"), lambda t: t.isNotNull()), lambda t: _numbered(t, credits)))


#: Columns of the staged table besides the record id: name -> expression over `r`. Arrays have one level.
STAGED: dict[str, dict[str, Callable[[], Column]]] = {
    "artists": {
        **{n: (lambda n=n: F.col(f"r.{n}")) for n in ("data_quality", "name", "profile", "realname")},
        "namevariations": lambda: F.col("r.namevariations.name"),
        "urls": lambda: F.col("r.urls.url"),
        **{n: (lambda n=n: joined(F.col(f"r.{n}"), "name")) for n in ("aliases", "groups", "members")},
    },
    "labels": {
        **{n: (lambda n=n: F.col(f"r.{n}")) for n in ("contactinfo", "data_quality", "name", "profile")},
        "parent_id": lambda: F.col("r.parentLabel._id"),
        "parent_name": lambda: F.col("r.parentLabel._VALUE"),
        "urls": lambda: F.col("r.urls.url"),
        "sublabels": lambda: joined(F.col("r.sublabels"), "label"),
    },
    "masters": {
        **{n: (lambda n=n: F.col(f"r.{n}")) for n in ("data_quality", "main_release", "notes", "title", "year")},
        "genres": lambda: F.col("r.genres.genre"),
        "styles": lambda: F.col("r.styles.style"),
        "artists": lambda: joined(F.col("r.artists"), "artist"),
        "videos": lambda: joined(F.col("r.videos"), "video"),
    },
    "releases": {
        **{n: (lambda n=n: F.col(f"r.{n}")) for n in ("country", "data_quality", "notes", "released", "title")},
        "status": lambda: F.col("r._status"),
        "is_main_release": lambda: F.col("r.master_id._is_main_release"),
        "master_id": lambda: F.col("r.master_id._VALUE"),
        "genres": lambda: F.col("r.genres.genre"),
        "styles": lambda: F.col("r.styles.style"),
        "artists": lambda: named(F.col("r.artists.artist")),
        "extraartists": lambda: named(F.col("r.extraartists.artist")),
        **{n: (lambda n=n, i=i: joined(F.col(f"r.{n}"), i)) for n, i in (("labels", "label"), ("series", "series"), ("formats", "format"), ("identifiers", "identifier"), ("videos", "video"), ("companies", "company"))},
        "tracks": lambda: _tracklists(None),
        "track_artists": lambda: _tracklists("artists"),
        "track_extraartists": lambda: _tracklists("extraartists"),
    },
}


def stage(records: DataFrame, spec: EntitySpec, column: str = "xml", only: list[str] | None = None, *keep: str) -> DataFrame:
    """The staged table: record_id as text and the columns above, or only some; other columns to keep first. Records without id are still in it, so that they can be counted."""
    wanted = STAGED[spec.name]
    return parse(records, spec, column, only, *keep).select(*keep, record_id(spec).alias("record_id"), *[f().alias(n) for n, f in wanted.items() if only is None or n in only])


def _id() -> Column:
    return F.col("record_id").cast("int")


def _child(staged: DataFrame, array: str, fk: str, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    x = F.col("x")
    return staged.select(_id().alias(fk), F.explode(array).alias("x")).select(fk, *[f(x).alias(n) for n, f in fields.items()])


def _ref(id_name: str):
    return {id_name: lambda x: strict_int(x["_id"]), "name": lambda x: text(x["_VALUE"])}


def _t(name: str):
    return lambda x: text(x[name])


_CREDIT_FIELDS = {"artist_id": lambda x: strict_int(x["id"]), "anv": _t("anv"), "join": _t("join"), "name": _t("name")}

#: Child tables: (array of the staged table, column -> expression over an item).
CHILDREN: dict[str, tuple[str, dict[str, Callable[[Column], Column]]]] = {
    "artist_aliases": ("aliases", _ref("alias_id")),
    "artist_groups": ("groups", _ref("group_id")),
    "artist_members": ("members", _ref("member_id")),
    "label_sublabels": ("sublabels", _ref("sublabel_id")),
    "master_artists": ("artists", _CREDIT_FIELDS),
    "master_videos": ("videos", {"description": _t("description"), "duration": lambda x: strict_int(x["_duration"]), "embed": lambda x: flag_or_null(x["_embed"]), "src": _t("_src"), "title": _t("title")}),
    "release_artists": ("artists", _CREDIT_FIELDS),
    "release_extraartists": ("extraartists", {"artist_id": lambda x: strict_int(x["id"]), "anv": _t("anv"), "name": _t("name"), "role": _t("role"), "tracks": _t("tracks")}),
    "release_labels": ("labels", {"label_id": lambda x: strict_int(x["_id"]), "catno": _t("_catno"), "name": _t("_name")}),
    "release_series": ("series", {"series_id": lambda x: strict_int(x["_id"]), "catno": _t("_catno"), "name": _t("_name")}),
    "release_formats": ("formats", {"descriptions": lambda x: text_list(x["descriptions"]["description"]), "name": _t("_name"), "qty": _t("_qty"), "text": _t("_text")}),
    "release_identifiers": ("identifiers", {"description": _t("_description"), "type": _t("_type"), "value": _t("_value")}),
    "release_videos": ("videos", {"description": _t("description"), "duration": lambda x: int_or_zero(x["_duration"]), "embed": lambda x: flag_or_false(x["_embed"]), "src": _t("_src"), "title": _t("title")}),
    "release_companies": ("companies", {"company_id": lambda x: strict_int(x["id"]), "catno": _t("catno"), "entity_type_name": _t("entity_type_name"), "entity_type": _t("entity_type"), "name": _t("name")}),
    "release_tracks": ("tracks", {"track_idx": lambda x: x["track_idx"], "parent_idx": lambda x: x["parent_idx"], "duration": _t("duration"), "position": _t("position"), "title": _t("title")}),
    "release_track_artists": ("track_artists", {"track_idx": lambda x: x["track_idx"], **{n: (lambda x, f=f: f(x["credit"])) for n, f in _CREDIT_FIELDS.items()}}),
    "release_track_extraartists": ("track_extraartists", {"track_idx": lambda x: x["track_idx"], "artist_id": lambda x: strict_int(x["credit"]["id"]), "anv": lambda x: text(x["credit"]["anv"]), "name": lambda x: text(x["credit"]["name"]), "role": lambda x: text(x["credit"]["role"])}),
}

#: Root tables: column -> expression over the staged table.
ROOTS: dict[str, dict[str, Callable[[], Column]]] = {
    "artists": {"data_quality": lambda: text(F.col("data_quality")), "name": lambda: text(F.col("name")), "namevariations": lambda: text_list(F.col("namevariations")), "profile": lambda: text(F.col("profile")), "realname": lambda: text(F.col("realname")), "urls": lambda: text_list(F.col("urls"))},
    "labels": {"contactinfo": lambda: text(F.col("contactinfo")), "data_quality": lambda: text(F.col("data_quality")), "name": lambda: text(F.col("name")), "parent_label_id": lambda: strict_int(F.col("parent_id")), "parent_label_name": lambda: text(F.col("parent_name")), "profile": lambda: text(F.col("profile")), "urls": lambda: text_list(F.col("urls"))},
    "masters": {"data_quality": lambda: text(F.col("data_quality")), "genres": lambda: text_list(F.col("genres")), "main_release": lambda: strict_int(F.col("main_release")), "notes": lambda: text(F.col("notes")), "styles": lambda: text_list(F.col("styles")), "title": lambda: text(F.col("title")), "year": lambda: strict_int(F.col("year"))},
    "releases": {"country": lambda: text(F.col("country")), "data_quality": lambda: text(F.col("data_quality")), "genres": lambda: text_list(F.col("genres")), "is_main_release": lambda: flag(F.col("is_main_release")), "master_id": lambda: strict_int(F.col("master_id")), "notes": lambda: text(F.col("notes")), "released": lambda: text(F.col("released")), "status": lambda: text(F.col("status")), "styles": lambda: text_list(F.col("styles")), "title": lambda: text(F.col("title"))},
}


def project(staged: DataFrame, spec: EntitySpec, name: str) -> DataFrame:
    """One output table of a staged table. Records without id give no rows in any table."""
    own = staged.where(present(F.col("record_id")))
    if name == spec.root.name:
        out = own.select(_id().alias(spec.pk), *[f().alias(n) for n, f in ROOTS[spec.name].items()])
    else:
        array, fields = CHILDREN[name]
        out = _child(own, array, spec.fk, fields)
    return out.select(*[F.col(f"`{f.name}`") for f in spec.table(name).schema.fields])


def shred(staged: DataFrame, spec: EntitySpec) -> dict[str, DataFrame]:
    """All tables, in order."""
    return {t.name: project(staged, spec, t.name) for t in spec.tables}


def shred_table(records: DataFrame, spec: EntitySpec, name: str, column: str = "xml") -> DataFrame:
    """One table straight from records, without a stage: only its own columns are built."""
    wanted = list(STAGED[spec.name])
    if name != spec.root.name:
        wanted = [CHILDREN[name][0]]
    return project(stage(records, spec, column, wanted), spec, name)


def empty_table(spark: SparkSession, spec: EntitySpec, name: str) -> DataFrame:
    return spark.createDataFrame([], spec.table(name).schema)
