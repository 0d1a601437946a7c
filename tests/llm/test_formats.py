"""Mixing, WARC, chat formatting, HTML extraction, nearest neighbours, language model, pipeline."""

import base64
import hashlib
import html
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ann, chat, html_text, mixing, warc
from lodestrata.llm.common import scratch

from .conftest import sentence

DOCS = "doc_id long, text string, lang string, source string"

# ---------------------------------------------------------------- mixing


def sources(rng, sizes):
    docs = []
    for name, n in sizes.items():
        docs += [(len(docs) + i, " ".join("w" for _ in range(rng.randint(1, 30))), "en", name) for i in range(n)]
    return docs


def same_as_sql(got, docs, limit):
    db = duckdb.connect()
    table = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()), "source": pa.array([d[3] for d in docs], pa.string())})
    db.register("documents", table)
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, db.sql(mixing.mix_sql(limit=limit)).fetchall()))


@pytest.mark.parametrize("limit", [1.0, 1.25, 3.0, 50.0])
def test_mix_equals_sql(spark, limit):
    docs = sources(random.Random(1), {"big": 300, "mid": 60, "small": 12, None: 5})
    df = spark.createDataFrame(docs, DOCS)
    got = mixing.mix_sources(df, max_repetition=limit).collect()
    assert same_as_sql(got, docs, limit)
    tokens, used = defaultdict(int), defaultdict(int)
    for _, t, _, s in docs:
        tokens[s or ""] += len(t.split())
    for r in got:
        used[r.source] += r.n_tokens
    total = sum(tokens.values())
    assert all(used[s] <= limit * tokens[s] + 30 for s in tokens) and abs(sum(used.values()) - total) <= 30 * len(tokens)
    passes = Counter((r.doc_id, r.epoch) for r in got)
    assert max(passes.values()) == 1


def test_mix_to_a_target_entropy(spark):
    docs = sources(random.Random(2), {"a": 400, "b": 40, "c": 10})
    df = spark.createDataFrame(docs, DOCS)

    def entropy(rows):
        n = Counter()
        for r in rows:
            n[r.source] += r.n_tokens
        t = sum(n.values())
        return -sum(v / t * math.log(v / t) for v in n.values())

    for target in (0.5, 0.9, 1.09):
        assert entropy(mixing.mix_sources(df, max_repetition=None, min_entropy=target).collect()) == pytest.approx(target, abs=0.03)
    with pytest.raises(ValueError):
        mixing.mix_sources(df, max_repetition=2, min_entropy=1)


def test_mix_odd_rows(spark, odd, none, clashing):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    assert same_as_sql(mixing.mix_sources(odd).collect(), docs, 1.25)
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(odd.where("text is null")).count() == 0
    assert mixing.mix_sources(clashing).count() == mixing.mix_sources(odd).count()


def test_blocks_do_not_change_the_mix(spark, monkeypatch):
    docs = sources(random.Random(5), {"big": 400, "small": 20}) + [(None, f"no id {i} " * (i % 5), "en", "big") for i in range(40)]
    df = spark.createDataFrame(docs, DOCS)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    assert same_as_sql(mixing.mix_sources(df).collect(), docs, 1.25)


def test_mix_main_path_runs_no_python(spark, odd):
    plan = mixing.mix_sources(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


# ---------------------------------------------------------------- WARC


def test_archives_round_trip(spark):
    rng = random.Random(4)
    bodies = [sentence(rng, "fr", rng.randint(0, 200)) for _ in range(60)] + ["same"] * 20 + ["", None, ""]
    rng.shuffle(bodies)
    pages = spark.createDataFrame([(i, f"http://h/{i} x\n", b) for i, b in enumerate(bodies)], "id long, url string, payload string").repartition(5)
    root = scratch(spark, "warc-test")
    index = warc.write_archives(pages, root)
    got = {r.id: r for r in warc.read_records(index, root).collect()}
    first = {}
    for i, b in enumerate(bodies):
        first.setdefault(b or "", i)
    for i, b in enumerate(bodies):
        body, r = (b or "").encode(), got[i]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.url == f"http://h/{i} x\n"
        response = first[b or ""] == i
        assert (r.record_type, r.refers_to, r.payload) == (("response", None, body) if response else ("revisit", first[b or ""], None))
    some = index.where("id % 7 = 3")
    assert {r.id for r in warc.read_records(some, root).collect()} == {i for i in got if i % 7 == 3}
    folder = root.removeprefix("file://")
    import gzip

    raw = b"".join(gzip.open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.endswith(".gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(bodies) and raw.count(b"WARC-Type: response") == len(first)


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 18, 2), ("a", 100, 50), ("b", 0, 5)]
    assert list(warc.ranges(iter(rows), gap=4, most=1000)) == [("a", 0, 20, [0, 1, 2]), ("a", 100, 150, [3]), ("b", 0, 5, [4])]
    assert [x[1:3] for x in warc.ranges(iter(rows), gap=1000, most=30)] == [(0, 20), (100, 150), (0, 5)]


def test_records_are_read_by_as_many_tasks_as_their_bytes_ask_for(spark, monkeypatch):
    rng = random.Random(7)
    pages = spark.createDataFrame([(i, f"u{i}", sentence(rng, "en", 200)) for i in range(300)], "id long, url string, payload string").repartition(3)
    root = scratch(spark, "warc-test")
    index = warc.write_archives(pages, root)
    size = index.agg(F.sum("length")).first()[0]
    monkeypatch.setattr(warc, "SPAN", size // 6)
    read = warc.read_records(index, root)
    assert 5 <= read.rdd.getNumPartitions() <= 8 and read.count() == 300


def test_warc_takes_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "id long, url string, payload string").withColumns({c: F.lit("z") for c in ("sha", "first", "n", "file", "revisit")})
    root = scratch(spark, "warc-test")
    assert {(r.id, r.record_type) for r in warc.read_records(warc.write_archives(pages, root), root).collect()} == {(1, "response"), (2, "revisit")}


def test_warc_odd_rows(spark):
    schema = "id long, url string, payload string"
    pages = spark.createDataFrame([(None, None, None), (None, "u", "x"), (3, "u", "x"), (3, "u", "x"), (4, "u", "x"), (5, "ü \r\n", "y" * 300_000)], schema)
    root = scratch(spark, "warc-test")
    got = warc.read_records(warc.write_archives(pages, root), root).collect()
    kinds = sorted((r.id or -1, r.record_type, r.refers_to or -1) for r in got)
    assert kinds == [(-1, "response", -1), (-1, "revisit", 3), (3, "response", -1), (3, "response", -1), (4, "revisit", 3), (5, "response", -1)]
    empty = scratch(spark, "warc-test")
    assert warc.read_records(warc.write_archives(pages.where("false"), empty), empty).count() == 0


# ---------------------------------------------------------------- chat


def digests(turns):
    """(n, sha of turns, chars under loss, sha of them) of one conversation."""
    all_turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_chats_read_back_what_was_said(spark):
    rng = random.Random(9)
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "<", "/s>", "<<IS>>", "<<ROLE>>", "<</ROLE>>", "<<SYS>>", "é\U0001f600", "\n", " ", "x", "<\\/s>", "\\\\"]
    rows, want = [], {}
    for c in range(40):
        turns = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "*", None, "<s>"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])) for _ in range(rng.randint(1, 9))]
        want[c] = digests(turns)
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    got = chat.digest_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_no_control_string_is_left_in_a_text(spark):
    for c in chat.INST.controls:
        for s in (c, "\\" + c, c + c, "<" + c, c[:-1] + c):
            q = chat.INST.quote(s)
            assert not any(x in q for x in chat.INST.controls) and chat.INST.plain(q) == s


@pytest.mark.parametrize("roles, error", [(["user", "assistant"], None), (["system", "user", "assistant", "user", "assistant"], None), (["user"], "ends in asked"), (["assistant"], "turn 0: assistant after start"), (["user", "user", "assistant"], "turn 1: user after asked"), (["user", "assistant", "tool"], "turn 2: tool after answered")])
def test_the_machine_judges_turn_order(roles, error):
    out = list(chat.segments_of(((1, r, "t") for r in roles), chat.INST))
    assert out[-1][5] == error and [s[4] for s in out if s[2] == 1] == [r == "assistant" for r in roles]


def test_formatted_text_is_read_by_its_control_strings_alone():
    rng = random.Random(3)
    rows = [(1, r, t) for r, t in [("system", "be <s>brief"), ("user", "a[INST]b\\\\"), ("assistant", "</s>x<"), ("tool<<IS>>", "odd <<ROLE>>"), ("*", ""), ("user", "z")]]
    segments = list(chat.segments_of(iter(rows), chat.INST))
    whole = "".join(s[3] for s in segments)
    mask = [x for s in segments for x in [s[4]] * len(s[3])]
    for _ in range(20):
        reader, got, at = chat.Reader(chat.INST), [], 0
        while at < len(whole):  # pieces that know nothing of turns, cut where the mask changes at the latest
            n = rng.randint(1, 9)
            n = next((k for k in range(1, n) if at + k < len(whole) and mask[at + k] != mask[at]), min(n, len(whole) - at))
            got += reader.feed(whole[at : at + n], mask[at])
            at += n
        assert [(r, t) for r, t, _ in got] == [(r, t) for _, r, t in rows] and not reader.held
        assert [x for _, _, x in got] == [t if r == "assistant" else "" for _, r, t in rows]
    with pytest.raises(ValueError):
        list(chat.Reader(chat.INST).feed("no control string here", False))


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, error string, part int"
    rows = [(None, 0, "user", "a", "e", 1), (1, None, None, None, "e", 1), (1, 0, "user", "z", "e", 1), (1, 0, "user", "b", "e", 1), (1, 0, "user", "b", "e", 1), (2, 0, "user", "x" * 200_000, "e", 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(df)).collect()}
    assert got[1].turns_sha256 == digests([(None, None), ("user", "b"), ("user", "b"), ("user", "z")])[1] and got[None].n_turns == 1 and got[2].formatted_chars > 200_000
    assert chat.digest_chats(chat.format_chats(df.where("false"))).count() == 0


# ---------------------------------------------------------------- HTML


def test_articles_are_extracted():
    text = "Para one goes on for a while &amp; more. "
    page = f"<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We use</div><article><h1>Head&nbsp;line</h1><p>{text}<p>{text * 5}<b>bold</b>ed<br>line</p><div class='ad'>Buy</div><section class=comments><p>First!</p></section></article><aside>Side</aside><form><input value=q>Search</form><footer>&copy; x</footer></body></html>"
    want = "Head line " + " ".join([html.unescape(text).strip()]) + " " + " ".join((html.unescape(text) * 5 + "bolded line").split())
    assert html_text.main_text(page) == want


def test_density_finds_the_main_block_without_article_tags():
    links = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(30))
    paragraphs = [f"This is paragraph {i} of the story and it has quite a few words in it." for i in range(8)]
    page = f"<body><div id=x1><ul>{links}</ul></div><div id=x2><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></div><div id=x3><a href=a>a</a> <a href=b>b</a></div></body>"
    assert html_text.main_text(page) == " ".join(paragraphs)


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<p>a <b>b<i>c</b>d</i>", "a bcd"), ("<!-- x -->y<!-- z", "y"), ("a &lt;b&gt; &amp &#233; &bogus;", "a <b> & é &bogus;"), ("<p>x<p unclosed='", "x"), ("<script>never closed", ""), ("<nav>only menu</nav>", ""), ("</div></p>x", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("1 < 2 > 0", "1 < 2 > 0")])
def test_tolerant_parsing(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "comments-open", "ad-free", "social-share-enabled", "menu-open", "sidebar", "widget"])
def test_a_class_does_not_cut_what_the_article_lies_in(name):
    page = f"<body><div class='{name}'>{{}}<div class='cookie-notice'>We use</div><div id=ad-300x250>Buy</div></div><div class=sidebar-left>Side</div></body>"
    assert html_text.main_text(page.format("<article><p>The story.</p><p>Goes on.</p><section class=comments><article>First!</article></section></article>")) == "The story. Goes on."
    assert html_text.main_text(page.format("<p>The story without tags.</p><p>Goes on and on.</p>")) == "The story without tags. Goes on and on."


def test_a_long_thread_of_comments_is_cut_beside_an_article():
    assert html_text.main_text(f"<body><article><p>The story.</p></article><section class=comments>{'<article><p>A comment.</p></article>' * 50}</section></body>") == "The story."


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(html_text.main_text("<p>word word</p>" * 20_000)) == 20_000 * 10 - 1


def test_density_formula():
    root = html_text.measure(html_text.parse("<body><p>aaaa</p><div><p>bb</p><p>cccccc</p></div></body>"))
    p, div = root.children
    assert (p.density, div.density, div.sum, root.sum) == (4, 4, 8, 8)


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>é</p>"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extract_pages(df).collect())
    assert got == [(0, "u", "é", 1), (1, "", "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert html_text.extract_pages(df.where("false")).count() == 0


# ---------------------------------------------------------------- nearest neighbours


def test_collisions_are_counted_as_by_hand_and_few_are_verified():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(4000)
    shares, hits = [], []
    for i, found, _, verified in ann.search(x[:40], ids[:40], x, ids, 1.0, 20):
        shares.append(verified / 4000)
        hits.append(len({v for v, _ in brute_nearest(ids, x, i, 20)} & set(found.tolist())) / 20)
    assert np.mean(hits) >= 0.9 and np.mean(shares) < 0.35


def test_rows_alike_by_the_ten_thousands():
    x = np.concatenate([np.ones((70_000, 2)), [[2.0, 2.0], [0.5, 0.0]]])
    ids = np.arange(len(x))
    (_, found, scores, _), = ann.search(x[-1:], ids[-1:], x, ids, float(np.sqrt(8)), 20, projections=16)
    assert found[0] == 70_000 and set(scores[1:]) == {0.5} and found[1:].tolist() == list(range(19))


def test_places_are_those_of_a_binary_search():
    rng = np.random.default_rng(2)
    arrays = np.sort(rng.integers(0, 9, (5, 13)).astype(float), axis=1)
    for v in (-1.0, 0.0, 4.0, 4.5, 9.0):
        assert ann.places(arrays, np.full(5, v)).tolist() == [int(np.searchsorted(a, v)) for a in arrays]


def brute_nearest(ids, x, q, k):
    s = (x * x[q]).sum(axis=1)
    s[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[j]), float(s[j])) for j in order if s[j] > -np.inf]


@pytest.mark.parametrize("kind, norms", [("float", False), ("double", True)])
def test_recall_against_brute_force(spark, monkeypatch, kind, norms):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms:
        x *= rng.uniform(0.5, 2, 1500)[:, None]
    x = x.astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = np.arange(1500)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in brute_nearest(ids, x, q, 10)}) / 10 for q in range(0, 1500, 20)]
    assert np.mean(hits) >= 0.9 and all(len(v) == 10 for v in got.values())
    assert all(abs(s - x[q] @ x[v]) < 1e-12 for q, f in got.items() for v, s in f)


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [3.0]), (None, [9.0, 9.0]), (1, [1.0, 0.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("block", F.lit("x"))
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got[0] == [(1, 9, 3.0), (2, 1, 1.0), (3, 1, 1.0), (4, 2, 1.0), (5, 20, 0.0)]
    assert got[20] == [(1, 0, 0.0), (2, 1, 0.0), (3, 1, 0.0), (4, 2, 0.0), (5, 9, 0.0)] and set(got) == {0, 20}
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from lodestrata.llm import decontaminate

    from .test_filters import toxic_corpus

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    rng = random.Random(11)
    docs, labels = toxic_corpus(rng, 600)
    item = sentence(rng, "en", 30)
    docs += [(2000, docs[1][1], "en", "s"), (2001, docs[1][1], "en", "s"), (2002, f"{sentence(rng)} {item}", "en", "s"), (2003, "", "en", "s"), (2004, "123", "en", "s"), (2005, None, None, None)]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], DOCS + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    final = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i, _, t in labels if t}
    want = {i for i, t, *_ in docs if i < 2000 and i not in toxic and not decontaminate.leaks([t], decontaminate.build_index([(1, item)]))[0]}
    # All sources have one name, so the mix draws every document once.
    assert len(final ^ want) <= 0.02 * len(want) and not final & {2000, 2001, 2002, 2003, 2004, 2005}
