"""Every query of the subpackage, whole, on the driver's smallest tables, against SQL or brute force."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from lodestrata.llm import langid, lm, toxicity
from lodestrata.llm.queries import ORACLE_SQL, QUERIES

from .test_filters import brute_leaks
from .test_html import naive_text
from .test_lm import tokens
from .test_neardup import brute_classes

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


def rows(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").df()


def left(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = db.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    flat = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notnull(), None).values.tolist()))
    assert columns == sorted(want.columns) and len(got) and flat(got) == flat(want)


def test_op1(spark):
    got = QUERIES["op1_factorization_machine"](spark, MORE).toPandas()
    docs, labels = rows("documents", MORE).set_index("doc_id"), rows("labels", MORE)
    h = toxicity.Hasher()
    keyed = spark.createDataFrame(labels[["doc_id"]]).selectExpr("doc_id", "xxhash64(doc_id, 'toxic') AS draw").toPandas().set_index("doc_id").draw
    sample = sorted((int(keyed[i]) % (1 << 30), str(i), int(t), np.sort(h.cells(docs.text[i])).astype("<i4").tobytes()) for i, t in zip(labels.doc_id, labels.toxic, strict=True) if i in docs.index and left(i))
    machine = toxicity.fit([(t, np.frombuffer(c, "<i4")) for _, _, t, c in sample])
    assert sorted(got.doc_id) == sorted(docs.index) and (got.held_out == [left(i) == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()
    assert got.score.tolist() == pytest.approx([1 / (1 + np.exp(-np.clip(machine.logit(h.cells(docs.text[i])), -30, 30))) for i in got.doc_id], abs=1e-4)
    truth = labels.set_index("doc_id").toxic
    held = got[got.held_out & got.doc_id.isin(truth.index)]
    assert (held.predicted == truth[held.doc_id].values).mean() > 0.9


def test_op2(spark):
    got = QUERIES["op2_spaced_seeds"](spark, SF).toPandas()
    items = list(rows("benchmark")[["item_id", "text"]].itertuples(index=False, name=None))
    want = {(d, i) for d, t in rows("documents")[["doc_id", "text"]].itertuples(index=False, name=None) for i in brute_leaks(t, items)}
    assert set(zip(got.doc_id, got.item_id, strict=True)) == want


def test_op4(spark):
    got = QUERIES["op4_warc_archive"](spark, SF).toPandas().set_index("page_id")
    pages = rows("pages").sort_values("page_id")
    first = {}
    for i, h in zip(pages.page_id, pages.html, strict=True):
        body, r = (h or "").encode(), got.loc[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.record_type == ("revisit" if body in first else "response") and (body not in first or r.refers_to == first[body])
        first.setdefault(body, i)
    assert len(got) == len(pages)


def test_op5(spark):
    got = QUERIES["op5_chat_format"](spark, SF).toPandas().set_index("conv_id")
    says = rows("conversations")
    says = [*says[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    talks = {}
    for c, _, r, t in sorted(says, key=lambda x: (x[0], x[1])):
        talks.setdefault(c, []).append((r, t or ""))
    assert set(got.index) == set(talks)
    for c, turns in talks.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got.loc[c, ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]]) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got.loc[-1].formatted_chars > 42


def test_op6(spark):
    got = QUERIES["op6_cross_parsing"](spark, MORE).toPandas().set_index("doc_id")
    docs = rows("documents", MORE)
    samples = langid.labelled_sample(spark.read.parquet(f"{MORE}/documents.parquet"))
    parser = langid.build(samples)
    look = parser.lookup()
    known = []
    for name in parser.langs:
        parts = [p for t in samples[name] if len(p := langid.fold(t, look))]
        known.append(b"".join(bytes(p) + b"\0" for p in parts)[: min(langid.TRAIN, langid.TABLE_BYTES // (len(parser.langs) * 8 * parser.alphabet))])

    def phrases(text, where):
        n, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in where:
                end += 1
            at, n = end, n + 1
        return n

    short = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if t and 20 < len(t) < 400][:60]
    for i, t in short:
        s = bytes(langid.fold(t, look))
        bits = [sum(phrases(s[b : b + langid.BLOCK], k) for b in range(0, len(s), langid.BLOCK)) * np.log2(len(k) + 1) for k in known]
        assert got.lang_pred[i] == parser.langs[int(np.argmin(bits))]
    assert len(short) > 30 and len(got) == len(docs) and (got.held_out == [left(i) == 0 for i in got.index]).all()
    truth = docs.set_index("doc_id").lang
    held = [i for i in got.index if got.held_out[i] and truth[i] and got.lang_pred[i] != "und"]
    assert np.mean([got.lang_pred[i] == truth[i] for i in held]) > 0.97


def test_op7(spark):
    got = QUERIES["op7_composite_text_density"](spark, SF).toPandas().set_index("page_id")
    pages = rows("pages")
    assert len(got) == len(pages) and (got.n_chars == got.text.str.len()).all()
    for i, u, h in pages[["page_id", "url", "html"]].itertuples(index=False, name=None):
        assert "".join(got.text[i].split()) == naive_text(h or "") and got.url[i] == u


def test_op8(spark):
    got = QUERIES["op8_weighted_minhash"](spark, SF).toPandas().set_index("doc_id")
    docs = rows("documents").sort_values("doc_id")
    ids = docs.doc_id.tolist()
    want = [ids[k] for k in brute_classes(docs.text.tolist())]
    assert len(got) == len(ids) and np.mean([got.class_id[i] == w for i, w in zip(ids, want, strict=True)]) >= 0.99


def test_op9(spark):
    got = QUERIES["op9_collision_counting"](spark, MORE).toPandas()
    table = rows("embeddings", MORE)
    ids, x = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float64)
    hits = []
    assert sorted(set(got.query_id)) == sorted(i for i in ids if i % 20 == 0)
    for q, own in got.groupby("query_id"):
        scores = (x * x[ids == q][0]).sum(axis=1)
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        hits.append(len(set(best) & set(own.vec_id)) / 20)
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.tolist() == [scores[ids == v][0] for v in own.vec_id]
        assert [(-s, v) for s, v in zip(own.score, own.vec_id, strict=True)] == sorted((-s, v) for s, v in zip(own.score, own.vec_id, strict=True))
    assert np.mean(hits) >= 0.9


def test_op10(spark):
    got = QUERIES["op10_context_mixing"](spark, SF).toPandas().set_index("doc_id")
    docs = rows("documents").set_index("doc_id").text
    training = [w for i, t in docs.items() if left(i) != 1 for w in tokens(t)]
    known, total = set(training), len(training)
    for i, t in docs.items():
        w, r = tokens(t), got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (left(i) == 1, len(w), sum(x in known for x in w), total)
        assert -8 * (len(lm.fold(t)) + 1) < r.score / np.log10(2) < 0
