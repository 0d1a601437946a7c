"""Queries over the driver's tables: rows are written as XML records in the plan, then shredded by the
same code that shreds dumps. Each has an independent SQL oracle over the flat tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fields import json_strings
from .operators import audit, shred
from .plans import ddl
from .plans.entities import ARTISTS, ENTITIES, LABELS, MASTERS, RELEASES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _xml(df: DataFrame, tag: str, *fields: Column) -> DataFrame:
    return df.select(F.to_xml(F.struct(*fields), {"rowTag": tag, "indent": "", "attributePrefix": "_", "valueTag": "_VALUE"}).alias("xml"))


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _items(*fields: Column, order: list[str]) -> Column:
    """All rows of a group as an array of structs, in order of the given columns."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("v")))), lambda x: x["v"])


def _orders_lines(spark: SparkSession, sf_dir: str, *fields: Column) -> DataFrame:
    """(o_orderkey, items): the lines of every order, an empty list where it has none."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_items(*fields, order=["l_linenumber", "l_partkey"]).alias("items"))
    return _t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


# ---------------------------------------------------------------- root tables


@query("SELECT o_orderkey::INTEGER AS id, o_orderstatus AS title, o_custkey::INTEGER AS main_release, o_orderpriority AS notes FROM orders")
def q_root_shred(spark, sf_dir):
    """Root projection, id in an attribute."""
    xml = _xml(_t(spark, sf_dir, "orders"), "master", _s("o_orderkey").alias("_id"), _s("o_orderstatus").alias("title"), _s("o_custkey").alias("main_release"), _s("o_orderpriority").alias("notes"))
    return shred.shred_table(xml, MASTERS, "masters").select("id", "title", "main_release", "notes")


@query("SELECT c_custkey::INTEGER AS id, c_name AS name, c_mktsegment AS profile FROM customer")
def q_root_child_id(spark, sf_dir):
    """Root projection, id in a child element."""
    xml = _xml(_t(spark, sf_dir, "customer"), "artist", _s("c_custkey").alias("id"), _s("c_name").alias("name"), _s("c_mktsegment").alias("profile"))
    return shred.shred_table(xml, ARTISTS, "artists").select("id", "name", "profile")


@query("SELECT doc_id::INTEGER AS id, text AS profile FROM documents")
def q_text_fidelity(spark, sf_dir):
    """Text of any shape comes through unchanged."""
    xml = _xml(_t(spark, sf_dir, "documents"), "artist", _s("doc_id").alias("id"), _s("text").alias("profile"))
    return shred.shred_table(xml, ARTISTS, "artists").select("id", "profile")


@query("SELECT o_orderkey::INTEGER AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS notes, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_custkey END::INTEGER AS main_release FROM orders")
def q_null_defaults(spark, sf_dir):
    """Missing and empty text is '', a missing or empty number NULL."""
    orders = _t(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 1, F.lit("")).otherwise(_s("o_custkey"))
    note = F.when(F.col("o_orderkey") % 6 == 0, F.lit("")).when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    xml = _xml(orders, "master", _s("o_orderkey").alias("_id"), note.alias("notes"), number.alias("main_release"))
    return shred.shred_table(xml, MASTERS, "masters").select("id", "notes", "main_release")


@query("SELECT o_orderkey::INTEGER AS id FROM orders WHERE o_orderkey % 4 > 1")
def q_skip_missing_id(spark, sf_dir):
    """Records with a missing or empty id are skipped."""
    key = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).when(F.col("o_orderkey") % 4 > 1, _s("o_orderkey"))
    xml = _xml(_t(spark, sf_dir, "orders"), "master", key.alias("_id"), _s("o_orderstatus").alias("title"))
    return shred.shred_table(xml, MASTERS, "masters").select("id")


@query("SELECT l_orderkey::INTEGER AS release_id, l_partkey::INTEGER AS label_id, l_linenumber::VARCHAR AS catno FROM lineitem WHERE l_orderkey % 4 > 0")
def q_skip_missing_id_children(spark, sf_dir):
    """A skipped record has no children either."""
    rows = _orders_lines(spark, sf_dir, _s("l_partkey").alias("_id"), _s("l_linenumber").alias("_catno"))
    key = F.when(F.col("o_orderkey") % 4 > 0, _s("o_orderkey"))
    xml = _xml(rows, "release", key.alias("_id"), F.struct(F.col("items").alias("label")).alias("labels"))
    return shred.shred_table(xml, RELEASES, "release_labels").select("release_id", "label_id", "catno")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS parent_label_id, r_name AS parent_label_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_parent_ref(spark, sf_dir):
    """A parent's id in an attribute and its name in the text of one element."""
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    xml = _xml(rows, "label", _s("n_nationkey").alias("id"), _s("n_name").alias("name"), F.struct(_s("n_regionkey").alias("_id"), F.col("r_name").alias("_VALUE")).alias("parentLabel"))
    return shred.shred_table(xml, LABELS, "labels").select("id", "name", "parent_label_id", "parent_label_name")


_LISTS = "SELECT o_custkey::INTEGER AS id, list_sort(list(DISTINCT o_orderpriority)) AS genres FROM orders GROUP BY o_custkey"


def _genre_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("g"))
    return _xml(rows, "master", _s("o_custkey").alias("_id"), F.struct(F.concat(F.array(F.lit("")), F.col("g"), F.array(F.lit(""))).alias("genre")).alias("genres"))


@query("SELECT id, array_to_string(genres, '|') AS genres FROM (" + _LISTS + ")")
def q_list_column(spark, sf_dir):
    """A list column; empty items go."""
    return shred.shred_table(_genre_records(spark, sf_dir), MASTERS, "masters").select("id", F.concat_ws("|", "genres").alias("genres"))


@query("SELECT c_custkey::INTEGER AS id, 0 AS n_urls, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_namevariations FROM customer")
def q_list_empty(spark, sf_dir):
    """A missing list and one of empty items are []; blank items stay."""
    names = F.when(F.col("c_custkey") % 2 == 0, F.struct(F.array(F.lit(""), F.lit("  ")).alias("name")))
    xml = _xml(_t(spark, sf_dir, "customer"), "artist", _s("c_custkey").alias("id"), names.alias("namevariations"), F.struct(F.array(F.lit(""), F.lit("")).alias("url")).alias("urls"))
    return shred.shred_table(xml, ARTISTS, "artists").select("id", F.size("urls").alias("n_urls"), F.size("namevariations").alias("n_namevariations"))


@query("SELECT DISTINCT o_custkey::INTEGER AS id, o_orderpriority AS genre FROM orders")
def q_list_explode(spark, sf_dir):
    """A list kept as a JSON text, as in SQLite, and queried item by item."""
    rows = shred.shred_table(_genre_records(spark, sf_dir), MASTERS, "masters").select("id", F.to_json("genres").alias("genres"))
    return rows.select("id", json_strings("genres").alias("genre"))


# ---------------------------------------------------------------- child tables


@query("SELECT l_orderkey::INTEGER AS release_id, l_partkey::INTEGER AS label_id, l_linenumber::VARCHAR AS catno, l_returnflag AS name FROM lineitem")
def q_child_attr_rows(spark, sf_dir):
    """Child rows from attributes."""
    rows = _orders_lines(spark, sf_dir, _s("l_partkey").alias("_id"), _s("l_linenumber").alias("_catno"), F.col("l_returnflag").alias("_name"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("label")).alias("labels"))
    return shred.shred_table(xml, RELEASES, "release_labels")


@query("SELECT l_orderkey::INTEGER AS release_id, l_suppkey::INTEGER AS company_id, l_linenumber::VARCHAR AS catno, l_linestatus AS entity_type_name, l_returnflag AS entity_type, l_partkey::VARCHAR AS name FROM lineitem")
def q_child_elem_rows(spark, sf_dir):
    """Child rows from elements."""
    rows = _orders_lines(spark, sf_dir, _s("l_suppkey").alias("id"), _s("l_partkey").alias("name"), _s("l_linenumber").alias("catno"), F.col("l_returnflag").alias("entity_type"), F.col("l_linestatus").alias("entity_type_name"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("company")).alias("companies"))
    return shred.shred_table(xml, RELEASES, "release_companies")


@query("SELECT l_orderkey::INTEGER AS release_id, l_partkey::VARCHAR AS description, l_returnflag AS type, l_linenumber::VARCHAR AS value FROM lineitem")
def q_child_identifiers(spark, sf_dir):
    """Identifier rows: three attributes, two of them named as SQL keywords."""
    rows = _orders_lines(spark, sf_dir, F.col("l_returnflag").alias("_type"), _s("l_partkey").alias("_description"), _s("l_linenumber").alias("_value"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("identifier")).alias("identifiers"))
    return shred.shred_table(xml, RELEASES, "release_identifiers")


@query("SELECT l_orderkey::INTEGER AS release_id, l_returnflag || '|' || l_linestatus AS descriptions, l_partkey::VARCHAR AS name, l_linenumber::VARCHAR AS qty, '' AS text FROM lineitem")
def q_child_formats(spark, sf_dir):
    """Format rows: attributes and a list inside each row."""
    rows = _orders_lines(spark, sf_dir, _s("l_partkey").alias("_name"), _s("l_linenumber").alias("_qty"), F.struct(F.array("l_returnflag", F.lit(""), "l_linestatus").alias("description")).alias("descriptions"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("format")).alias("formats"))
    return shred.shred_table(xml, RELEASES, "release_formats").withColumn("descriptions", F.concat_ws("|", "descriptions"))


@query("SELECT r_regionkey AS label_id, n_nationkey AS sublabel_id, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
def q_nested_same_tag(spark, sf_dir):
    """Children whose tag is the record's own."""
    nations = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(_items(_s("n_nationkey").alias("_id"), F.col("n_name").alias("_VALUE"), order=["n_nationkey"]).alias("items"))
    rows = _t(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    xml = _xml(rows, "label", _s("r_regionkey").alias("id"), _s("r_name").alias("name"), F.struct(F.col("items").alias("label")).alias("sublabels"))
    return shred.shred_table(xml, LABELS, "label_sublabels")


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations that are numbers, words, empty or missing; flags that are true, false, empty or missing."""
    k = F.col("l_linenumber") % 4
    duration = F.when(k == 0, _s("l_partkey")).when(k == 1, F.lit("unknown")).when(k == 2, F.lit(""))
    embed = F.when(k == 0, F.lit("true")).when(k == 1, F.lit("false")).when(k == 2, F.lit(""))
    rows = _orders_lines(spark, sf_dir, _s("l_suppkey").alias("_src"), duration.alias("_duration"), embed.alias("_embed"), _s("l_linenumber").alias("title"))
    return _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("video")).alias("videos"))


@query("SELECT l_orderkey::INTEGER AS release_id, l_suppkey::VARCHAR AS src, CASE WHEN l_linenumber % 4 = 0 THEN l_partkey ELSE 0 END::INTEGER AS duration FROM lineitem")
def q_int_tolerant(spark, sf_dir):
    """A release video's duration is 0 unless it is a number."""
    return shred.shred_table(_videos(spark, sf_dir), RELEASES, "release_videos").select("release_id", "src", "duration")


@query(
    """SELECT 'release' AS kind, l_orderkey::INTEGER AS id, l_linenumber::VARCHAR AS title, l_linenumber % 4 = 0 AS flag FROM lineitem
UNION ALL SELECT 'master', l_orderkey::INTEGER, l_linenumber::VARCHAR, CASE l_linenumber % 4 WHEN 0 THEN true WHEN 1 THEN false END FROM lineitem
UNION ALL SELECT 'main', o_orderkey::INTEGER, '', CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END FROM orders"""
)
def q_bool_three_ways(spark, sf_dir):
    """Three rules for flags: missing is false; missing or empty is NULL; missing is NULL but empty false."""
    release = shred.shred_table(_videos(spark, sf_dir), RELEASES, "release_videos").select(F.lit("release").alias("kind"), F.col("release_id").alias("id"), "title", F.col("embed").alias("flag"))
    k = F.col("l_linenumber") % 4
    embed = F.when(k == 0, F.lit("true")).when(k == 1, F.lit("false")).when(k == 2, F.lit(""))
    rows = _orders_lines(spark, sf_dir, embed.alias("_embed"), _s("l_linenumber").alias("title"))
    videos = _xml(rows, "master", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("video")).alias("videos"))
    master = shred.shred_table(videos, MASTERS, "master_videos").select(F.lit("master").alias("kind"), F.col("master_id").alias("id"), "title", F.col("embed").alias("flag"))
    k = F.col("o_orderkey") % 4
    is_main = F.when(k == 0, F.lit("true")).when(k == 1, F.lit("false")).when(k == 2, F.lit(""))
    mains = _xml(_t(spark, sf_dir, "orders"), "release", _s("o_orderkey").alias("_id"), F.struct(is_main.alias("_is_main_release"), _s("o_custkey").alias("_VALUE")).alias("master_id"))
    main = shred.shred_table(mains, RELEASES, "releases").select(F.lit("main").alias("kind"), "id", F.lit("").alias("title"), F.col("is_main_release").alias("flag"))
    return release.unionByName(master).unionByName(main)


def _credits(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag"))
    rows = _orders_lines(spark, sf_dir, _s("l_suppkey").alias("id"), name.alias("name"), _s("l_linenumber").alias("anv"))
    return _xml(rows, tag, _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("artist")).alias("artists"))


@query("SELECT l_orderkey::INTEGER AS release_id, l_suppkey::INTEGER AS artist_id, l_linenumber::VARCHAR AS anv, '' AS \"join\", l_returnflag AS name FROM lineitem WHERE l_linenumber % 3 = 1")
def q_drop_empty_name(spark, sf_dir):
    """Release credits without a name are dropped."""
    return shred.shred_table(_credits(spark, sf_dir, "release"), RELEASES, "release_artists")


@query("SELECT l_orderkey::INTEGER AS master_id, l_suppkey::INTEGER AS artist_id, l_linenumber::VARCHAR AS anv, '' AS \"join\", CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE '' END AS name FROM lineitem")
def q_keep_empty_name(spark, sf_dir):
    """Master credits without a name are kept."""
    return shred.shred_table(_credits(spark, sf_dir, "master"), MASTERS, "master_artists")


@query("SELECT l_orderkey::INTEGER AS release_id, l_suppkey::INTEGER AS artist_id, '' AS anv, l_returnflag AS name, l_linestatus AS role, l_linenumber::VARCHAR AS tracks FROM lineitem")
def q_extra_credits(spark, sf_dir):
    """Further credits with role and tracks."""
    rows = _orders_lines(spark, sf_dir, _s("l_suppkey").alias("id"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("role"), _s("l_linenumber").alias("tracks"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("artist")).alias("extraartists"))
    return shred.shred_table(xml, RELEASES, "release_extraartists")


@query("SELECT l_orderkey::INTEGER AS release_id, l_partkey::INTEGER AS series_id, l_linenumber::VARCHAR AS catno, l_returnflag AS name FROM lineitem")
def q_ignore_unknown_tags(spark, sf_dir):
    """Unknown elements beside and around known ones are ignored."""
    rows = _orders_lines(spark, sf_dir, _s("l_partkey").alias("_id"), _s("l_linenumber").alias("_catno"), F.col("l_returnflag").alias("_name"), F.lit("x").alias("odd"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.lit("y").alias("bogus"), F.col("items").alias("series")).alias("series"), F.lit("z").alias("stray"))
    return shred.shred_table(xml, RELEASES, "release_series")


@query("SELECT c_custkey::INTEGER AS id, c_mktsegment AS name, c_name AS urls FROM customer")
def q_last_wins(spark, sf_dir):
    """Of repeated scalars and list containers the last counts."""
    pair = lambda a, b: F.concat(F.lit(f"<{a}>"), b, F.lit(f"</{a}>"))
    rows = _t(spark, sf_dir, "customer").select(F.concat(F.lit("<artist>"), pair("id", _s("c_custkey")), pair("name", F.col("c_name")), pair("name", F.col("c_mktsegment")), pair("urls", pair("url", F.lit("first"))), pair("urls", pair("url", F.col("c_name"))), F.lit("</artist>")).alias("xml"))
    return shred.shred_table(rows, ARTISTS, "artists").select("id", "name", F.concat_ws("|", "urls").alias("urls"))


@query("SELECT c_custkey::INTEGER AS artist_id, unnest([c_nationkey, 7]) AS alias_id, unnest([c_name, c_mktsegment]) AS name FROM customer")
def q_accumulate(spark, sf_dir):
    """Rows of repeated containers add up."""
    rows = _t(spark, sf_dir, "customer").select(F.concat(F.lit("<artist><id>"), _s("c_custkey"), F.lit('</id><aliases><name id="'), _s("c_nationkey"), F.lit('">'), F.col("c_name"), F.lit('</name></aliases><aliases><name id="7">'), F.col("c_mktsegment"), F.lit("</name></aliases></artist>")).alias("xml"))
    return shred.shred_table(rows, ARTISTS, "artist_aliases")


# ---------------------------------------------------------------- tracks

_NUMBERED = """
numbered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
         sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS g
  FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS track_idx FROM numbered),
parents AS (SELECT conv_id, g, min(track_idx) AS head FROM placed GROUP BY conv_id, g)
"""


def _tracklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a release: its first turn and every user's turn is a track, the turns up to the next user's its sub-tracks."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _t(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(own)).withColumn("g", F.sum((F.col("role") == "user").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    credit = F.struct(F.array(F.struct(_s("turn").alias("id"), F.col("role").alias("name"))).alias("artist"))
    extra = F.struct(F.array(F.struct(_s("turn").alias("id"), F.col("role").alias("name"), F.lit("writer").alias("role"), F.lit("all").alias("tracks"))).alias("artist"))
    track = F.struct(_s("turn").alias("position"), F.col("text").alias("title"), credit.alias("artists"), extra.alias("extraartists"))
    groups = rows.groupBy("conv_id", "g").agg(F.sort_array(F.collect_list(F.struct("i", track.alias("t")))).alias("all"))
    head = F.col("all")[0]["t"]
    subs = F.transform(F.expr("slice(all, 2, size(all))"), lambda x: x["t"])
    tracks = groups.select("conv_id", "g", F.struct(head["position"].alias("position"), head["title"].alias("title"), head["artists"].alias("artists"), head["extraartists"].alias("extraartists"), F.struct(subs.alias("track")).alias("sub_tracks")).alias("t"))
    lists = tracks.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "t"))), lambda x: x["t"]).alias("tracks"))
    return _xml(lists, "release", _s("conv_id").alias("_id"), F.struct(F.col("tracks").alias("track")).alias("tracklist"))


@query("WITH " + _NUMBERED + "SELECT conv_id::INTEGER AS release_id, track_idx::INTEGER AS track_idx, CASE WHEN track_idx = head THEN NULL ELSE head END::INTEGER AS parent_idx, '' AS duration, turn::VARCHAR AS position, text AS title FROM placed JOIN parents USING (conv_id, g)")
def q_track_index(spark, sf_dir):
    """Tracks and sub-tracks numbered in pre-order, sub-tracks with their parent's number."""
    return shred.shred_table(_tracklists(spark, sf_dir), RELEASES, "release_tracks")


@query("WITH " + _NUMBERED + "SELECT conv_id::INTEGER AS release_id, track_idx::INTEGER AS track_idx, turn::INTEGER AS artist_id, '' AS anv, '' AS \"join\", role AS name FROM placed")
def q_track_credits(spark, sf_dir):
    """Credits of tracks and sub-tracks."""
    return shred.shred_table(_tracklists(spark, sf_dir), RELEASES, "release_track_artists")


@query("WITH " + _NUMBERED + "SELECT conv_id::INTEGER AS release_id, track_idx::INTEGER AS track_idx, turn::INTEGER AS artist_id, '' AS anv, role AS name, 'writer' AS role FROM placed")
def q_track_extra_credits(spark, sf_dir):
    """Further credits of tracks, without their tracks text."""
    return shred.shred_table(_tracklists(spark, sf_dir), RELEASES, "release_track_extraartists")


# ---------------------------------------------------------------- audits


@query("SELECT count(*)::BIGINT AS malformed FROM pages")
def q_malformed_count(spark, sf_dir):
    """Records that are no XML, counted: raw web pages are none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = _t(spark, sf_dir, "pages").select(F.from_xml("html", "x STRING, _bad STRING", options).alias("r"))
    return parsed.where("r._bad IS NOT NULL").agg(F.count("*").alias("malformed"))


@query("SELECT 'release_labels' AS table_name, count(*)::BIGINT AS orphans FROM lineitem WHERE l_orderkey % 10 = 0 HAVING count(*) > 0")
def q_fk_orphans(spark, sf_dir):
    """Child rows without their root, by table."""
    rows = _orders_lines(spark, sf_dir, _s("l_partkey").alias("_id"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.struct(F.col("items").alias("label")).alias("labels"))
    tables = {t.name: shred.shred_table(xml, RELEASES, t.name) for t in RELEASES.tables if t.name in ("releases", "release_labels")}
    tables["releases"] = tables["releases"].where("id % 10 <> 0")
    return audit.orphans(tables["release_labels"], tables["releases"], "release_id").agg(F.count("*").alias("orphans")).where("orphans > 0").select(F.lit("release_labels").alias("table_name"), "orphans")


@query("SELECT o_custkey::INTEGER AS key, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def q_pk_duplicates(spark, sf_dir):
    """Keys that more than one record has."""
    xml = _xml(_t(spark, sf_dir, "orders"), "master", _s("o_custkey").alias("_id"), _s("o_orderstatus").alias("title"))
    return audit.duplicate_keys(shred.shred_table(xml, MASTERS, "masters"))


@query("SELECT * FROM (VALUES ('odd'), ('series/bogus'), ('series/series/_extra')) AS t(path)")
def q_strict_unknown(spark, sf_dir):
    """Elements and attributes that the entity does not declare."""
    rows = _orders_lines(spark, sf_dir, _s("l_partkey").alias("_id"), _s("l_linenumber").alias("_extra"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), F.lit("x").alias("odd"), F.struct(F.lit("y").alias("bogus"), F.col("items").alias("series")).alias("series"))
    return spark.createDataFrame([(p,) for p in audit.unknown_paths(xml, RELEASES)], "path string")


# ---------------------------------------------------------------- sinks


def _scratch(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestrata-")
    return f"{top.rstrip('/')}/lodestrata/{uuid.uuid4().hex}"


def _masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = _xml(_t(spark, sf_dir, "orders"), "master", _s("o_orderkey").alias("_id"), _s("o_orderstatus").alias("title"), _s("o_custkey").alias("main_release"), F.struct(F.array("o_orderpriority").alias("genre")).alias("genres"))
    return shred.shred_table(xml, MASTERS, "masters")


_MASTERS_SQL = "SELECT o_orderkey::INTEGER AS id, '' AS data_quality, o_orderpriority AS genres, o_custkey::INTEGER AS main_release, '' AS notes, '' AS styles, o_orderstatus AS title, NULL::INTEGER AS year FROM orders"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("genres", F.concat_ws("|", "genres")).withColumn("styles", F.concat_ws("|", "styles"))


@query(_MASTERS_SQL)
def q_parquet_rt(spark, sf_dir):
    """Written as Parquet and read back."""
    from .sinks import ParquetSink

    sink = ParquetSink(_scratch(spark))
    sink.prepare(spark, MASTERS)
    sink.write("masters", _masters(spark, sf_dir), MASTERS)
    return _flat(spark.read.parquet(sink.path(MASTERS, "masters")))


@query(_MASTERS_SQL)
def q_jsonl_rt(spark, sf_dir):
    """Written as compressed JSON Lines and read back."""
    from .sinks import JsonLinesSink

    sink = JsonLinesSink(_scratch(spark), "gzip")
    sink.prepare(spark, MASTERS)
    sink.write("masters", _masters(spark, sf_dir), MASTERS)
    return _flat(spark.read.schema(MASTERS.root.schema).json(sink.path(MASTERS, "masters")))


@query("SELECT l_orderkey::INTEGER AS master_id, l_suppkey::INTEGER AS artist_id, l_linenumber::VARCHAR AS anv, '' AS \"join\", CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE '' END AS name FROM lineitem")
def q_sqlite_rt(spark, sf_dir):
    """Loaded into SQLite, a column named join included, and read back."""
    from .sinks import get_sink

    folder = _scratch(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "rt.db")
    sink = get_sink(path)
    sink.prepare(spark, MASTERS)
    sink.write("master_artists", shred.shred_table(_credits(spark, sf_dir, "master"), MASTERS, "master_artists"), MASTERS)
    sink.finalize(spark, MASTERS)
    return spark.read.format("lodestrata_sqlite").schema(MASTERS.table("master_artists").schema).option("path", path).option("dbtable", "master_artists").load()


#: The columns of the output tables; i whole number, s text, l list of texts, b flag, ? nullable.
_COLUMNS = """
  ('artists', 'artists', 'id:i data_quality:s name:s namevariations:l profile:s realname:s urls:l'),
  ('artists', 'artist_aliases', 'artist_id:i alias_id:i? name:s'),
  ('artists', 'artist_groups', 'artist_id:i group_id:i? name:s'),
  ('artists', 'artist_members', 'artist_id:i member_id:i? name:s'),
  ('labels', 'labels', 'id:i contactinfo:s data_quality:s name:s parent_label_id:i? parent_label_name:s profile:s urls:l'),
  ('labels', 'label_sublabels', 'label_id:i sublabel_id:i? name:s'),
  ('masters', 'masters', 'id:i data_quality:s genres:l main_release:i? notes:s styles:l title:s year:i?'),
  ('masters', 'master_artists', 'master_id:i artist_id:i? anv:s join:s name:s'),
  ('masters', 'master_videos', 'master_id:i description:s duration:i? embed:b? src:s title:s'),
  ('releases', 'releases', 'id:i country:s data_quality:s genres:l is_main_release:b? master_id:i? notes:s released:s status:s styles:l title:s'),
  ('releases', 'release_artists', 'release_id:i artist_id:i? anv:s join:s name:s'),
  ('releases', 'release_extraartists', 'release_id:i artist_id:i? anv:s name:s role:s tracks:s'),
  ('releases', 'release_labels', 'release_id:i label_id:i? catno:s name:s'),
  ('releases', 'release_series', 'release_id:i series_id:i? catno:s name:s'),
  ('releases', 'release_formats', 'release_id:i descriptions:l name:s qty:s text:s'),
  ('releases', 'release_identifiers', 'release_id:i description:s type:s value:s'),
  ('releases', 'release_videos', 'release_id:i description:s duration:i embed:b src:s title:s'),
  ('releases', 'release_companies', 'release_id:i company_id:i? catno:s entity_type_name:s entity_type:s name:s'),
  ('releases', 'release_tracks', 'release_id:i track_idx:i parent_idx:i? duration:s position:s title:s'),
  ('releases', 'release_track_artists', 'release_id:i track_idx:i artist_id:i? anv:s join:s name:s'),
  ('releases', 'release_track_extraartists', 'release_id:i track_idx:i artist_id:i? anv:s name:s role:s')
"""


@query(
    "WITH tables(entity, table_name, spec) AS (VALUES" + _COLUMNS + """),
listed AS (SELECT entity, table_name, string_split(spec, ' ') AS names FROM tables),
each_one AS (SELECT entity, table_name, unnest(names) AS c, generate_subscripts(names, 1) AS nth FROM listed),
typed AS (
  SELECT entity, table_name, nth, split_part(c, ':', 1) AS name, substr(split_part(c, ':', 2), 1, 1) AS kind, c LIKE '%?' AS nullable,
         nth = 1 AND table_name = entity AS is_key FROM each_one),
lines AS (
  SELECT *, '    "' || name || '" ' || CASE kind WHEN 'i' THEN 'INTEGER' WHEN 's' THEN 'TEXT' WHEN 'l' THEN 'TEXT[]' ELSE 'BOOLEAN' END
              || CASE WHEN nullable THEN '' WHEN is_key THEN ' NOT NULL'
                      ELSE ' NOT NULL DEFAULT ' || CASE kind WHEN 'i' THEN '0' WHEN 's' THEN '''''' WHEN 'l' THEN '''{}''' ELSE 'false' END END AS of_postgres,
         '    "' || name || '" ' || CASE WHEN kind IN ('i', 'b') THEN 'INTEGER' ELSE 'TEXT' END
              || CASE WHEN is_key THEN ' PRIMARY KEY' WHEN nullable THEN ''
                      ELSE ' NOT NULL DEFAULT ' || CASE kind WHEN 's' THEN '''''' WHEN 'l' THEN '''[]''' ELSE '0' END END AS of_sqlite
  FROM typed)
SELECT entity, table_name, 'CREATE TABLE "' || table_name || '" (' || chr(10) || string_agg(of_postgres, ',' || chr(10) ORDER BY nth) || chr(10) || ')' AS postgres,
       'CREATE TABLE "' || table_name || '" (' || chr(10) || string_agg(of_sqlite, ',' || chr(10) ORDER BY nth) || chr(10) || ')' AS sqlite
FROM lines GROUP BY entity, table_name"""
)
def q_ddl_text(spark, sf_dir):
    """CREATE TABLE of all 21 tables in two dialects."""
    rows = [(e.name, t.name, ddl.postgres_table(t.name, t.schema), ddl.sqlite_table(t.name, t.schema, pk=e.pk if t is e.root else None)) for e in ENTITIES.values() for t in e.tables]
    return spark.createDataFrame(rows, "entity string, table_name string, postgres string, sqlite string")


@query("SELECT 1::INTEGER AS artist_id, 1::INTEGER AS member_id, '' AS name WHERE false")
def q_empty_table(spark, sf_dir):
    """A child table without rows keeps its schema."""
    xml = _xml(_t(spark, sf_dir, "customer"), "artist", _s("c_custkey").alias("id"), _s("c_name").alias("name"))
    return shred.shred_table(xml, ARTISTS, "artist_members")


# ---------------------------------------------------------------- source


@query("SELECT o_orderkey::INTEGER AS id, o_orderstatus AS title FROM orders")
def q_dump_split(spark, sf_dir):
    """A dump file written record by record, split by many tasks, read back whole."""
    from .sources.dumps import read_records

    path = _scratch(spark)
    xml = _xml(_t(spark, sf_dir, "orders"), "master", _s("o_orderkey").alias("_id"), _s("o_orderstatus").alias("title"))
    # One file with an XML frame: header, a record a line, footer.
    rows = xml.select(F.rtrim(F.col("xml"), F.lit("\n")).alias("value"))
    ends = spark.createDataFrame([(0, "<?xml version='1.0'?>\n<masters>"), (2, "</masters>")], "o int, value string")
    whole = rows.select(F.lit(1).alias("o"), "value").unionByName(ends)
    whole.repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return shred.shred_table(read_records(spark, path, MASTERS).select("xml"), MASTERS, "masters").select("id", "title")


# ---------------------------------------------------------------- analytics


@query(
    """SELECT o_orderstatus AS status, o_orderpriority AS country, count(*)::BIGINT AS n_lines, count(DISTINCT l_orderkey)::BIGINT AS n_orders,
       sum(l_linenumber)::BIGINT AS sum_lines, max(l_partkey)::INTEGER AS top_part
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus, o_orderpriority"""
)
def q_star_join_agg(spark, sf_dir):
    """Flagship: records shredded once to a staged table, then root and child joined and aggregated."""
    rows = _orders_lines(spark, sf_dir, _s("l_partkey").alias("_id"), _s("l_linenumber").alias("_catno"))
    xml = _xml(rows, "release", _s("o_orderkey").alias("_id"), _s("o_orderstatus").alias("_status"), _s("o_orderpriority").alias("country"), F.struct(F.col("items").alias("label")).alias("labels"))
    path = _scratch(spark)
    shred.stage(xml, RELEASES, only=["status", "country", "labels"]).write.parquet(path)
    staged = spark.read.parquet(path)
    root = staged.select(F.col("record_id").cast("int").alias("id"), "status", "country")
    child = shred.project(staged, RELEASES, "release_labels")
    joined = child.join(root, child["release_id"] == root["id"])
    return joined.groupBy("status", "country").agg(F.count("*").alias("n_lines"), F.countDistinct("release_id").alias("n_orders"), F.sum(F.col("catno").cast("long")).alias("sum_lines"), F.max("label_id").alias("top_part"))
