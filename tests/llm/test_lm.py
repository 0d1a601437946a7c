"""The language model against brute force."""

import math
import random
import re
import tracemalloc
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import lm

from .conftest import ODD, sentence

DOCS = "doc_id long, text string, lang string, source string"


def tokens(t):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), b""]


def corpus(rng, n=150):
    docs = [(i, " ".join(rng.choice(["The", "a", "Of", "é", "x y"]) if rng.random() < 0.6 else sentence(rng, "en", 1) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", "\x0b tail"]), "en", "s") for i in range(n)]
    return [*docs, (500, None, "en", "s"), (501, "x" * 200 + " The", "en", "s")]


def test_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 30)
    docs = corpus(random.Random(3))
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(docs, DOCS)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in docs}
    c = Counter(w for i, t, _, _ in docs if not out[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, _, _ in docs:
        w, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-9)


def hand_contexts(before):
    """The context of each predictor: the last bytes, and the word begun with what stands before it up to three bytes."""
    word = 0
    while word < lm.REACH and before[-1 - word] not in b" \t\n\x0b\x0c\r\0":
        word += 1
    return [before[-n:] for n in lm.LENGTHS] + [before[-max(word, 3) :]]


def decisions(text):
    """(contexts, node, bit) of every decision of a text, byte by byte."""
    data = bytes(lm.REACH) + lm.fold(text) + b"\xff"
    for p in range(lm.REACH, len(data)):
        where = hand_contexts(data[p - lm.REACH : p])
        yield [(where, (1 << d) | (data[p] >> (8 - d)), (data[p] >> (7 - d)) & 1) for d in range(8)]


def level(n, *bounds):
    return sum(n >= b for b in bounds)


def hand_score(text, ones, every, mixer):
    """Log2 probability of a text by the definition: dictionaries, one decision at a time."""
    total = 0.0
    for byte in decisions(text):
        bits = 0.0
        for where, node, bit in byte:
            cells = [(i, c, node) for i, c in enumerate(where)]
            n = [every[c] for c in cells]
            x = [min(8, max(-8, math.log((ones[c] + 0.4) / (every[c] - ones[c] + 0.4)))) for c in cells] + [0.3]
            known = sum(v > 0 for v in n[: len(lm.LENGTHS)])
            top = level(n[5], 1, 2, 3, 6)
            gates = node * lm.KNOWN + known, (top * lm.LEVELS + level(n[3], 1, 2, 4, 16)) * lm.LEVELS + level(n[1], 1, 16, 256, 4096), node * lm.LEVELS + top
            z = min(7.999, max(-7.999, (np.dot(x, mixer.by_node[gates[0]]) + np.dot(x, mixer.by_counts[gates[1]])) / 2))
            at = z * 2 + lm.KNOTS // 2
            low = math.floor(at)
            refined = mixer.refine[gates[2], low] * (1 - at + low) + mixer.refine[gates[2], low + 1] * (at - low)
            p = min(1 - 2**-14, max(2**-14, (1 / (1 + math.exp(-z)) + 3 * refined) / 4))
            bits += math.log2(p if bit else 1 - p)
        total += round(bits * lm.STEPS_PER_BIT) / lm.STEPS_PER_BIT
    return total


def local(docs, out):
    """(runs, counts, contexts of one and two bytes) of the training texts, added up in one place."""
    kind = lambda i: np.uint64(2 if out[i] else 0)
    keys = np.concatenate([(lm.run_keys([lm.fold(t)]) << np.uint64(2)) | kind(i) for i, t, _, _ in docs])
    keys, counts = lm.tally(keys)
    return keys, counts[0], lm.Low.of(((keys >> np.uint64(40) << np.uint64(8)) | (keys & np.uint64(255))).astype(np.int64), counts[0])


def test_probabilities_equal_brute_force(monkeypatch):
    """Cells so many that hardly two contexts meet in one: two texts may hold a meeting."""
    monkeypatch.setattr(lm, "FILL", 1 << 12)
    docs = corpus(random.Random(5), 30)
    out = {i: i % 5 == 1 for i, *_ in docs}
    keys, counts, low = local(docs, out)
    rng = np.random.default_rng(3)
    mixer = lm.Mixer.fresh()
    mixer = mixer.with_weights(mixer.weights() * rng.uniform(0.8, 1.1, len(mixer.weights())))
    bits = dict(zip(keys.tolist(), lm.run_bits(keys, counts, low, mixer).tolist(), strict=True))
    ones, every = Counter(), Counter()
    for i, t, _, _ in docs:
        if not out[i]:
            for where, node, bit in (x for byte in decisions(t) for x in byte):
                for cell in ((k, c, node) for k, c in enumerate(where)):
                    every[cell] += 1
                    ones[cell] += bit
    wrong = 0
    for _, t, _, _ in docs:
        got, want = -sum(bits[k] for k in lm.run_keys([lm.fold(t)]).tolist()) / lm.STEPS_PER_BIT, hand_score(t, ones, every, mixer)
        assert got == pytest.approx(want, abs=3)
        wrong += got != pytest.approx(want, abs=0.01 + 0.001 * len(lm.fold(t)))
    assert wrong <= 2


@pytest.mark.parametrize("settings", [{}, {"BLOCK_BYTES": 700, "GROUP": 2, "LEARNER_RUNS": 300}])
def test_buckets_answer_as_one_place_would(spark, monkeypatch, settings):
    """The second time with many blocks, groups and learners."""
    monkeypatch.setattr(lm, "LEARN_FROM", 4)
    for k, v in settings.items():
        monkeypatch.setattr(lm, k, v)
    seen, rate = [], lm.rate_runs
    monkeypatch.setattr(lm, "rate_runs", lambda known, low, mixer: seen.append(mixer) or rate(known, low, mixer))
    docs = corpus(random.Random(5))
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert (seen[0].weights() != lm.Mixer.fresh().weights()).any()
    keys, counts, low = local(docs, {i: r.held_out for i, r in got.items()})
    bits, bucket = np.zeros(len(keys), np.uint16), lm.bucket_of(keys)
    for b in np.unique(bucket):
        bits[bucket == b] = lm.run_bits(keys[bucket == b], counts[bucket == b], low, seen[0])
    for i, t, _, _ in docs:
        want = -int(bits[np.searchsorted(keys, lm.run_keys([lm.fold(t)]))].sum(dtype=np.int64)) / lm.STEPS_PER_BIT
        assert got[i].score == pytest.approx(want * math.log10(2), abs=1e-9)


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus(random.Random(8)), DOCS)
    a, b = ({r.doc_id: (r.score, r.base_score) for r in lm.score_documents(d).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_model_prefers_text_like_its_own(spark):
    rng = random.Random(6)
    docs = [(i, sentence(rng, "en", 60), "en", "s") for i in range(200)] + [(1000 + i, sentence(rng, "fr", 60), "fr", "s") for i in range(3)]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(docs, DOCS)).collect()}
    seen, other = [got[i].bits_per_byte for i in range(200)], [r.bits_per_byte for i, r in got.items() if i >= 1000 and r.held_out]
    assert np.mean(seen) < 4.2 and all(r.score < 0 for r in got.values())
    assert not other or min(other) > np.mean(seen)


def test_every_training_text_is_counted_whole(spark):
    rng = random.Random(8)
    docs = [(i, sentence(rng, "en", 600), "en", "s") for i in range(80)]
    got = lm.score_documents(spark.createDataFrame(docs, DOCS)).collect()
    assert max(r.bits_per_byte for r in got if not r.held_out) < min(r.bits_per_byte for r in got if r.held_out)


def test_every_training_text_teaches_the_weights(spark, monkeypatch):
    """Each text has a byte of its own, and so the last decision of that byte: it is learned for the training texts, and only for them."""
    seen, rate = [], lm.rate_runs
    monkeypatch.setattr(lm, "rate_runs", lambda known, low, mixer: seen.append(mixer) or rate(known, low, mixer))
    own = {i: b for i, b in enumerate(b for b in range(0x22, 0x7F, 2) if not 0x40 <= b <= 0x5B)}
    got = lm.score_documents(spark.createDataFrame([(i, (chr(b) + " ") * 20, "en", "s") for i, b in own.items()], DOCS)).collect()
    moved = (seen[0].by_node != lm.Mixer.fresh().by_node).any(axis=1).reshape(256, lm.KNOWN).any(axis=1)
    assert {r.doc_id: bool(moved[128 | own[r.doc_id] >> 1]) for r in got} == {r.doc_id: not r.held_out for r in got}


def test_probabilities_of_a_byte_add_up_to_one():
    rng = random.Random(1)
    keys, counts = lm.tally(lm.run_keys([lm.fold(sentence(rng, "en", 40)) for _ in range(30)]) << np.uint64(2))
    low = lm.Low.of(((keys >> np.uint64(40) << np.uint64(8)) | (keys & np.uint64(255))).astype(np.int64), counts[0])
    mixer, used = lm.Mixer.fresh(), lm.Mixer.fresh().with_weights(np.zeros_like(lm.Mixer.fresh().weights()))
    before = mixer.bits(lm.inputs_of(keys, counts[0], low)) @ counts[0]
    mixer.study(lm.inputs_of(keys, counts[0], low), counts[0], used)
    assert mixer.bits(lm.inputs_of(keys, counts[0], low)) @ counts[0] > before
    every = (keys[100] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    new = every[~np.isin(every, keys)]
    both = np.concatenate([keys, new])
    bits = mixer.bits(lm.inputs_of(both, np.concatenate([counts[0], np.zeros(len(new), np.int64)]), low))
    assert np.exp2(bits[np.isin(both, every)]).sum() == pytest.approx(1, abs=1e-6)


def test_runs_contexts_and_counts():
    texts = [b"ab c", b"", b"thing\xc3\xa9!"]
    want = []
    for t in texts:
        data = bytes(lm.REACH) + t + b"\xff"
        want += [(data[p - lm.REACH : p], data[p]) for p in range(lm.REACH, len(data))]
    keys = lm.run_keys(texts)
    assert [int(k) for k in keys] == [int.from_bytes(before[::-1], "big") << 8 | byte for before, byte in want]
    for k, (before, _) in enumerate(want):
        assert [int(c[k]) for c in lm.contexts(keys)][:-1] == [int.from_bytes(before[-n:][::-1], "big") for n in lm.LENGTHS]
        assert int(lm.contexts(keys)[-1][k]) == int.from_bytes(hand_contexts(before)[-1][::-1].ljust(lm.REACH, b"\0"), "big")
    assert lm.run_keys([]).tolist() == []
    kinds = np.arange(len(keys), dtype=np.uint64) % 3
    found, counts = lm.tally((np.tile(keys, 2) << np.uint64(2)) | np.tile(kinds, 2))
    want = Counter(zip(keys.tolist(), kinds.tolist(), strict=True))
    assert {(k, i): c for k, row in zip(found.tolist(), counts.T.tolist(), strict=True) for i, c in enumerate(row) if c} == {k: 2 * n for k, n in want.items() if k[1] < 2}


class Rows:
    """Stands in for a table: hands back what would run on its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_a_block_is_counted_in_little_memory(monkeypatch):
    """A block of 16 MiB has as many runs, of eight bytes each; the last text is longer than what is counted at once."""
    monkeypatch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(2)
    own = np.array([bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode() for n in rng.integers(2, 9, 300)])
    texts = [" ".join(own[rng.integers(0, len(own), n)]) for n in [*[4000] * 500, 720_000]]
    out, second = rng.random(len(texts)) < 0.3, rng.random(len(texts)) < 0.5
    batches = [pa.record_batch({"doc_id": pa.array([i]), "held_out": pa.array([bool(out[i])]), "second": pa.array([bool(second[i])]), "text": pa.array([t])}) for i, t in enumerate(texts)]
    assert 0.75 * lm.BLOCK_BYTES < sum(map(len, texts)) < lm.BLOCK_BYTES and len(texts[-1]) > 1 << 22
    got, run = [], lm.read_texts(Rows())
    tracemalloc.start()
    try:
        for b in run(iter(batches)):
            got += [r for r in b.select(["block", "bucket", "n", "keys", "counts"]).to_pylist() if r["keys"] is not None]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    kinds = np.where(out, 2, second).astype(np.uint64)
    keys, counts = lm.tally(np.concatenate([(lm.run_keys([lm.fold(t)]) << np.uint64(2)) | k for t, k in zip(texts, kinds, strict=True)]))
    bucket = lm.bucket_of(keys)
    assert [(r["block"], r["bucket"]) for r in got] == [(0, b) for b in np.unique(bucket)]
    for r in got:
        at = bucket == r["bucket"]
        assert (lm.unpack(r["keys"], r["n"], np.uint64) == keys[at]).all() and (lm.unpack(r["counts"], 2 * r["n"], np.uint32).reshape(2, -1) == counts[:, at]).all()
    assert peak < 150e6, peak


def test_sums_and_packing():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 56, 5000, dtype=np.uint64)
    table, values = np.sort(np.unique(keys)), rng.integers(0, 1 << 16, len(np.unique(keys))).astype(np.uint16)
    sizes = np.array([0, 1, 999, 0, 4000])
    at = dict(zip(table.tolist(), values.tolist(), strict=True))
    ends = np.cumsum(sizes)
    assert lm.sums_of(keys, sizes, table, values).tolist() == [sum(at[k] for k in keys[e - n : e].tolist()) for n, e in zip(sizes, ends, strict=True)]
    for x in (keys, values, np.zeros(0, np.uint64)):
        assert (lm.unpack(lm.pack(x), len(x), x.dtype) == x).all()


def test_tokens():
    texts = ["", None, " a  B\tc\x0b", "x", "\u00a0é\u2003 Z\x1c"]
    words, starts = lm.tokens_of(pa.array(texts, pa.string()))
    words = words.to_pylist()
    assert [words[s:e] for s, e in zip(starts, starts[1:], strict=False)] == [tokens(t) for t in texts]


def test_model_odd_rows(odd, none, clashing):
    got = lm.score_documents(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score_documents(none).count() == 0 and lm.score_documents(clashing).count() == len(ODD)
