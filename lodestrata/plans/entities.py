"""The four kinds of dump: record schema, tables in order, keys.

Table schemas are fixed and the single source of column names, types, nullability and DDL. The first
table of an entity is its root, keyed by `pk`; all others carry `fk`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType(), "bool": T.BooleanType(), "text": T.StringType(), "list": T.ArrayType(T.StringType(), containsNull=False)}


def columns(spec: str) -> T.StructType:
    """'id int!, name text!': a '!' marks a column that is never null."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _KINDS[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    #: Share of the write time; the heaviest table is submitted first.
    weight: float


@dataclass(frozen=True)
class EntitySpec:
    name: str
    row_tag: str
    #: How a record opens: with a bare tag, or with a tag and attributes.
    bare: bool
    record: T.StructType
    tables: tuple[TableSpec, ...]
    fk: str
    pk: str = "id"
    #: Field of the record that holds the id: an attribute, or a list of child elements of which the first counts.
    id_field: str = "_id"

    @property
    def opening(self) -> str:
        return f"<{self.row_tag}>" if self.bare else f"<{self.row_tag} "

    @property
    def table_names(self) -> list[str]:
        return [t.name for t in self.tables]

    @property
    def root(self) -> TableSpec:
        return self.tables[0]

    def table(self, name: str) -> TableSpec:
        return next(t for t in self.tables if t.name == name)


def _record(ddl: str) -> T.StructType:
    """A struct of strings, arrays and structs from its DDL, without a running session."""
    tokens = re.findall(r"\w+|[<>:,]", ddl)

    def kind(at: int) -> tuple[T.DataType, int]:
        if tokens[at] == "ARRAY":
            inner, at = kind(at + 2)
            return T.ArrayType(inner), at + 1
        if tokens[at] == "STRUCT":
            inner, at = fields(at + 2)
            return inner, at + 1
        return T.StringType(), at + 1

    def fields(at: int) -> tuple[T.StructType, int]:
        out = []
        while at < len(tokens) and tokens[at] != ">":
            name = tokens[at]
            at += 1 + (tokens[at + 1] == ":")
            inner, at = kind(at)
            out.append(T.StructField(name, inner))
            at += at < len(tokens) and tokens[at] == ","
        return T.StructType(out), at

    return fields(0)[0]


_REF = "ARRAY<STRUCT<_id: STRING, _VALUE: STRING>>"

ARTISTS = EntitySpec(
    "artists", "artist", True,
    _record(f"id ARRAY<STRING>, name STRING, realname STRING, profile STRING, data_quality STRING, namevariations STRUCT<name: ARRAY<STRING>>, urls STRUCT<url: ARRAY<STRING>>, aliases ARRAY<STRUCT<name: {_REF}>>, groups ARRAY<STRUCT<name: {_REF}>>, members ARRAY<STRUCT<name: {_REF}>>"),
    (
        TableSpec("artists", columns("id int!, data_quality text!, name text!, namevariations list!, profile text!, realname text!, urls list!"), 4),
        TableSpec("artist_aliases", columns("artist_id int!, alias_id int, name text!"), 1),
        TableSpec("artist_groups", columns("artist_id int!, group_id int, name text!"), 1),
        TableSpec("artist_members", columns("artist_id int!, member_id int, name text!"), 1),
    ),
    "artist_id", id_field="id",
)

LABELS = EntitySpec(
    "labels", "label", True,
    _record(f"id ARRAY<STRING>, name STRING, contactinfo STRING, data_quality STRING, profile STRING, parentLabel STRUCT<_id: STRING, _VALUE: STRING>, urls STRUCT<url: ARRAY<STRING>>, sublabels ARRAY<STRUCT<label: {_REF}>>"),
    (
        TableSpec("labels", columns("id int!, contactinfo text!, data_quality text!, name text!, parent_label_id int, parent_label_name text!, profile text!, urls list!"), 3),
        TableSpec("label_sublabels", columns("label_id int!, sublabel_id int, name text!"), 1),
    ),
    "label_id", id_field="id",
)

MASTERS = EntitySpec(
    "masters", "master", False,
    _record("_id STRING, data_quality STRING, main_release STRING, notes STRING, title STRING, year STRING, genres STRUCT<genre: ARRAY<STRING>>, styles STRUCT<style: ARRAY<STRING>>, artists ARRAY<STRUCT<artist: ARRAY<STRUCT<id: STRING, anv: STRING, join: STRING, name: STRING>>>>, videos ARRAY<STRUCT<video: ARRAY<STRUCT<_src: STRING, _duration: STRING, _embed: STRING, description: STRING, title: STRING>>>>"),
    (
        TableSpec("masters", columns("id int!, data_quality text!, genres list!, main_release int, notes text!, styles list!, title text!, year int"), 3),
        TableSpec("master_artists", columns("master_id int!, artist_id int, anv text!, join text!, name text!"), 2),
        TableSpec("master_videos", columns("master_id int!, description text!, duration int, embed bool, src text!, title text!"), 2),
    ),
    "master_id",
)

_CREDITS = "STRUCT<artist: ARRAY<STRUCT<id: STRING, name: STRING, anv: STRING, join: STRING>>>"
_EXTRA = "STRUCT<artist: ARRAY<STRUCT<id: STRING, name: STRING, anv: STRING, role: STRING, tracks: STRING>>>"
_TRACK = f"position: STRING, title: STRING, duration: STRING, artists: {_CREDITS}, extraartists: {_EXTRA}"

RELEASES = EntitySpec(
    "releases", "release", False,
    _record(
        "_id STRING, _status STRING, title STRING, country STRING, released STRING, notes STRING, data_quality STRING, master_id STRUCT<_is_main_release: STRING, _VALUE: STRING>, "
        f"genres STRUCT<genre: ARRAY<STRING>>, styles STRUCT<style: ARRAY<STRING>>, artists {_CREDITS}, extraartists {_EXTRA}, "
        "labels ARRAY<STRUCT<label: ARRAY<STRUCT<_id: STRING, _name: STRING, _catno: STRING>>>>, series ARRAY<STRUCT<series: ARRAY<STRUCT<_id: STRING, _name: STRING, _catno: STRING>>>>, "
        "formats ARRAY<STRUCT<format: ARRAY<STRUCT<_name: STRING, _qty: STRING, _text: STRING, descriptions: STRUCT<description: ARRAY<STRING>>>>>>, "
        "identifiers ARRAY<STRUCT<identifier: ARRAY<STRUCT<_type: STRING, _description: STRING, _value: STRING>>>>, "
        "videos ARRAY<STRUCT<video: ARRAY<STRUCT<_src: STRING, _duration: STRING, _embed: STRING, title: STRING, description: STRING>>>>, "
        "companies ARRAY<STRUCT<company: ARRAY<STRUCT<id: STRING, name: STRING, catno: STRING, entity_type: STRING, entity_type_name: STRING>>>>, "
        f"tracklist ARRAY<STRUCT<track: ARRAY<STRUCT<{_TRACK}, sub_tracks: STRUCT<track: ARRAY<STRUCT<{_TRACK}>>>>>>>"
    ),
    # Weights in percent of the measured write time.
    (
        TableSpec("releases", columns("id int!, country text!, data_quality text!, genres list!, is_main_release bool, master_id int, notes text!, released text!, status text!, styles list!, title text!"), 13.1),
        TableSpec("release_artists", columns("release_id int!, artist_id int, anv text!, join text!, name text!"), 5.2),
        TableSpec("release_extraartists", columns("release_id int!, artist_id int, anv text!, name text!, role text!, tracks text!"), 15.0),
        TableSpec("release_labels", columns("release_id int!, label_id int, catno text!, name text!"), 3.7),
        TableSpec("release_series", columns("release_id int!, series_id int, catno text!, name text!"), 0.5),
        TableSpec("release_formats", columns("release_id int!, descriptions list!, name text!, qty text!, text text!"), 4.6),
        TableSpec("release_identifiers", columns("release_id int!, description text!, type text!, value text!"), 4.6),
        TableSpec("release_videos", columns("release_id int!, description text!, duration int!, embed bool!, src text!, title text!"), 4.1),
        TableSpec("release_companies", columns("release_id int!, company_id int, catno text!, entity_type_name text!, entity_type text!, name text!"), 6.0),
        TableSpec("release_tracks", columns("release_id int!, track_idx int!, parent_idx int, duration text!, position text!, title text!"), 22.3),
        TableSpec("release_track_artists", columns("release_id int!, track_idx int!, artist_id int, anv text!, join text!, name text!"), 7.3),
        TableSpec("release_track_extraartists", columns("release_id int!, track_idx int!, artist_id int, anv text!, name text!, role text!"), 13.5),
    ),
    "release_id",
)

ENTITIES: dict[str, EntitySpec] = {e.name: e for e in (ARTISTS, LABELS, MASTERS, RELEASES)}


def get(name: str) -> EntitySpec:
    """The entity of that name; KeyError for any other."""
    return ENTITIES[name]


def register(spec: EntitySpec) -> None:
    """Add an entity of one's own."""
    names = spec.table_names
    if not names or len(set(names)) != len(names):
        raise ValueError(f"{spec.name}: tables must be named, each once")
    ENTITIES[spec.name] = spec


def detect_entity(filename: str) -> str:
    """The entity that a dump's file name ends in, before .xml and .gz: ..._artists.xml.gz."""
    stem = PurePosixPath(filename).name.removesuffix(".gz").removesuffix(".xml")
    kind = stem.rpartition("_")[2]
    if kind not in ENTITIES:
        raise ValueError(f"Cannot tell the entity of {filename!r}: the name must end in one of {', '.join(sorted(ENTITIES))}")
    return kind


def table_groups(n: int, spec: EntitySpec) -> list[list[str]]:
    """At most n groups of tables of about equal weight: the heaviest table first, each to the lightest group so far."""
    groups: list[tuple[float, list[str]]] = [(0.0, []) for _ in range(max(1, min(n, len(spec.tables))))]
    for t in sorted(spec.tables, key=lambda t: -t.weight):
        k = min(range(len(groups)), key=lambda i: groups[i][0])
        groups[k] = (groups[k][0] + t.weight, [*groups[k][1], t.name])
    return [names for _, names in groups]
