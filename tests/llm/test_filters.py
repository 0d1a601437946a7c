"""Toxicity, language ID and decontamination."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, langid, toxicity
from lodestrata.llm.common import remainder

from .conftest import ODD, sentence, words

DOCS = "doc_id long, text string, lang string, source string"


def test_remainder_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", remainder(F.col("id")).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# ---------------------------------------------------------------- toxicity


def toxic_corpus(rng, n=900):
    docs, labels = [], []
    for i in range(n):
        t = words(rng, "en", rng.randint(5, 60))
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(["vilewort", "Scurvy!", "zzbad"]))
        docs.append((i, " ".join(t), "en", "s"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_machine_learns_and_holds_out(spark):
    docs, labels = toxic_corpus(random.Random(3))
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(d, lab).collect()}
    assert kept == {i for i in got if got[i].predicted == 0}


def test_held_out_labels_change_nothing(spark):
    docs, labels = toxic_corpus(random.Random(4), 300)
    d = spark.createDataFrame(docs, DOCS)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned))
    assert a == b


def test_the_sample_is_bounded_whatever_is_repeated(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] * 2, "doc_id long, text string").withColumn("draw", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] * 5, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    a, b = (toxicity.labelled_sample(d, labels, max_rows=60) for d in (docs.coalesce(1), docs.repartition(5)))
    assert len(a) <= 60 and [(t, c.tolist()) for t, c in a] == [(t, c.tolist()) for t, c in b]
    assert 0 < len(toxicity.score_documents(docs, labels).collect()) == 80


def test_pairwise_interactions_are_learned():
    """Neither term alone is toxic, both together are: an additive score cannot tell."""
    rng = np.random.default_rng(0)
    samples = []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        cells = sorted({*([1] if a else []), *([2] if b else []), *(rng.integers(10, 40, 3).tolist())})
        samples.append((int(a == b), np.array(cells, np.int32)))
    m = toxicity.fit(samples, bits=6, epochs=60)
    right = np.mean([(m.logit(c) >= 0) == bool(y) for y, c in samples])
    assert right > 0.9


def test_the_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, rng.normal(size=64), rng.normal(size=(64, 4)))
    cells = np.array([3, 9, 20, 41])
    want = 0.3 + m.w[cells].sum() + sum(m.v[i] @ m.v[j] for k, i in enumerate(cells) for j in cells[k + 1 :])
    assert abs(m.logit(cells) - want) < 1e-9


@pytest.mark.parametrize("labels", [[], [(1, 1, None)], [(6, 1, 1), (10, 1, 1)], [(6, 1, 1), (4, 1, 0), (None, 1, 1), (77, 1, 1)]])
def test_toxicity_odd_rows(spark, odd, none, clashing, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(odd, lab).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.score_documents(none, lab).count() == 0
    kept = toxicity.drop_toxic(clashing, lab)
    assert kept.columns == clashing.columns and kept.count() <= len(ODD)


# ---------------------------------------------------------------- language ID


def phrases(text, known):
    """Greedy longest phrases that occur in `known`, by brute force."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_phrase_counts_equal_brute_force():
    rng = random.Random(2)
    known = "".join(rng.choice("abc ") for _ in range(200))
    code = {c: i for i, c in enumerate(" ?abc")}
    symbols = lambda s: np.array([code[c] for c in s], np.uint8)
    go = langid.suffix_automaton(symbols(known), 5)
    p = langid.Parser(["x"], {}, [langid.parsing_table(go)], [1.0], 5)
    texts = ["".join(rng.choice("abc ?") for _ in range(n)) for n in (1, 2, 17, 300, langid.BLOCK, langid.BLOCK + 1, 3 * langid.BLOCK + 7)]
    got = langid.phrase_counts([symbols(t) for t in texts], p)[:, 0]
    want = [sum(phrases(t[s : s + langid.BLOCK], known) for s in range(0, len(t), langid.BLOCK)) for t in texts]
    assert got.tolist() == want


def test_fold():
    p = langid.Parser([], {"a": (2,), "b": (3,)}, [], [], 4)
    assert langid.fold("  A1b, \n céa", p.lookup()).tolist() == [2, 0, 3, 0, 1, 1, 2]
    assert langid.fold("123", p.lookup()).tolist() == []


def test_every_letter_has_a_code_and_none_begins_another():
    letters = {chr(0x4E00 + i): {f"l{i % 3}": 1 + i % 50} for i in range(9000)}
    found = langid.codes(letters)
    assert len(set(found.values())) == 9000 and max(map(max, found.values())) < langid.SYMBOLS + 2 and min(map(min, found.values())) >= 2
    whole = set(found.values())
    assert not any(c[:k] in whole for c in whole for k in range(1, len(c))) and {len(c) for c in whole} == {1, 2, 3}
    p = langid.Parser([], found, [], [], 64)
    text = "".join(list(letters)[:200]) + " " + list(letters)[8999]
    assert langid.fold(f"  {text}!", p.lookup()).tolist() == [s for ch in text for s in (found.get(ch) or (langid.BLANK,))]
    assert langid.codes({c: {"x": 1} for c in "cab"}) == {"a": (2,), "b": (3,), "c": (4,)}


def test_large_scripts_that_share_no_letter_are_told_apart(spark):
    rng = random.Random(4)
    scripts = {"one": range(0x4E00, 0x4E00 + 3000), "two": range(0x7000, 0x7000 + 3000)}
    docs = [(i, "".join(chr(rng.choice(scripts[lang])) + (" " if rng.random() < 0.2 else "") for _ in range(rng.randint(40, 400))), lang, "s") for i, lang in enumerate(["one", "two"] * 150)]
    got = langid.identify_documents(spark.createDataFrame(docs, DOCS)).collect()
    truth = {i: lang for i, _, lang, _ in docs}
    assert all(r.lang_pred == truth[r.doc_id] for r in got)


def test_the_sample_depends_on_the_rows_alone(spark):
    rng = random.Random(5)
    docs = [(i, sentence(rng, lang, 30), lang, "s") for i, lang in enumerate(["en", "de"] * 60)] + [(7, "over and over again", "en", "s")] * 300 + [(10_000 + i, "the same text", "en", "s") for i in range(200)]
    df = spark.createDataFrame(docs, DOCS)
    a, b = (langid.labelled_sample(d, sample_docs=20) for d in (df.coalesce(1), df.repartition(7)))
    assert a == b and all(len(x) == 20 and len(set(x)) == 20 for x in a.values())


def test_languages_are_told_apart(spark):
    rng = random.Random(8)
    docs = [(i, sentence(rng, lang, rng.randint(8, 80)), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 100)]
    got = langid.identify_documents(spark.createDataFrame(docs, DOCS)).collect()
    truth = {i: lang for i, _, lang, _ in docs}
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(odd, none, clashing):
    got = langid.identify_documents(odd).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert len(got) == len(ODD) and und == {1, 2, 3, 5} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.identify_documents(none).count() == 0
    assert {r.lang_pred for r in langid.identify_documents(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.drop_unknown(clashing)
    assert kept.columns == clashing.columns and not {1, 2, 3, 5} & {r.doc_id for r in kept.collect()}


def test_text_in_no_language_goes(spark):
    rng = random.Random(9)
    docs = [(i, sentence(rng, "en", 50), "en", "s") for i in range(60)] + [(1000, "".join(rng.choice("ЖЩЫЮЯДЛПФЭ") for _ in range(400)), "en", "s")]
    kept = {r.doc_id for r in langid.drop_unknown(spark.createDataFrame(docs, DOCS)).collect()}
    assert kept == set(range(60))


# ---------------------------------------------------------------- decontamination


def brute_leaks(text, items):
    """All diagonals of all items, without seeds."""
    doc = decontaminate.WORD.findall((text or "").lower())
    out = set()
    for k, item in items:
        w = decontaminate.WORD.findall((item or "").lower())
        if len(w) < 5:
            continue
        for shift in range(-len(w) + 1, len(doc)):
            lo, hi = max(0, -shift), min(len(w), len(doc) - shift)
            matched, _, _ = decontaminate.best_segment(np.array([doc[i + shift] == w[i] for i in range(lo, hi)], bool))
            if matched >= decontaminate.needed(len(w)):
                out.add(k)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(k, sentence(rng, "en", rng.randint(3, 40))) for k in range(30)] + [(30, None), (31, ""), (32, "two words")]
    docs = []
    for i in range(120):
        t = words(rng, "en", rng.randint(0, 80))
        if i % 2:
            w = items[rng.randrange(30)][1].split()
            part = w if i % 4 == 1 else w[: max(1, len(w) // 2)]
            part = [x if rng.random() > 0.08 else "changed" for x in part]
            at = rng.randint(0, len(t))
            t[at:at] = part
        docs.append((i, " ".join(t)))
    got = {}
    for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
        assert decontaminate.needed(r.item_words) <= r.n_matched <= r.n_aligned <= r.item_words
    want = {i: brute_leaks(t, items) for i, t in docs}
    assert got == {i: s for i, s in want.items() if s} and got


def test_substitutions_and_parts_are_found_and_clean_texts_are_not():
    rng = random.Random(7)
    items = [(k, sentence(rng, "en", 30)) for k in range(20)]
    index = decontaminate.build_index(items)
    hit = []
    for _, t in items:
        w = [x if rng.random() > 0.1 else "zz" for x in t.split()]
        hit.append(bool(decontaminate.leaks([" ".join(words(rng, "en", 20) + w + words(rng, "en", 20))], index)[0]))
    assert np.mean(hit) >= 0.95
    assert not any(decontaminate.leaks([sentence(rng, "en", 300) for _ in range(20)], index))


def test_words_over_and_over_take_bounded_memory():
    import tracemalloc

    item, text = "la " * 2000, "so it goes " + "la " * 20_000 + "and on"
    index = decontaminate.build_index([(1, item)])
    tracemalloc.start()
    (found,) = decontaminate.leaks([text], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {0: (2000, 2000, 3)} and peak < 600 << 20


def test_hits_in_slices_find_the_same(monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(5, 12)))) for k in range(6)]
    index = decontaminate.build_index(items)
    for _ in range(10):
        text = " ".join(rng.choice("abcd") for _ in range(30))
        found = []
        for hits in (1 << 21, 7, 1):
            monkeypatch.setattr(decontaminate, "HITS", hits)
            found.append(decontaminate.leaks([text, "", text], index))
        assert found[0] == found[1] == found[2] and found[0][2] == found[0][0] and not found[0][1]
        assert {items[k][0] for k in found[0][0]} <= brute_leaks(text, items)


def test_items_given_twice_are_one_item(spark):
    rng = random.Random(3)
    t = sentence(rng, "en", 20)
    bench = spark.createDataFrame([(1, t), (1, t), (2, t)], "item_id long, text string")
    docs = spark.createDataFrame([(5, t), (5, t)], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()) == [(5, 1), (5, 1), (5, 2), (5, 2)]


def test_a_benchmark_in_parts_finds_the_same(spark, monkeypatch):
    rng = random.Random(1)
    items = [(k, sentence(rng, "en", 20)) for k in range(40)]
    docs = spark.createDataFrame([(k, f"{sentence(rng)} {t}") for k, t in items[:10]] + [(99, sentence(rng))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.find_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate.index_parts, "__defaults__", (100,))
    assert len(decontaminate.index_parts(bench)) > 3
    assert sorted(decontaminate.find_leaks(docs, bench).collect()) == whole and len(whole) == 10
    assert [r.doc_id for r in decontaminate.drop_leaking(docs, bench).collect()] == [99]


def test_decontamination_odd_rows(spark, odd, none, clashing):
    bench = spark.createDataFrame([(1, "The red cat; sat on the red mat"), (None, None), (2, ""), (3, "x")], "item_id long, text string")
    assert sorted((r.doc_id or 0) for r in decontaminate.find_leaks(odd, bench).collect()) == [0, 6, 10]
    kept = decontaminate.drop_leaking(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == len(ODD) - 3
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.drop_leaking(odd, bench.where("false")).count() == len(ODD)
