"""Benchmark decontamination by spaced-seed hashing.

Fixed masks mark the token positions of a window that are hashed; the others are ignored, so a window
hits although words at ignored places were replaced. Hashes of test items are indexed, windows of
training texts are looked up, and around each hit the item and the text are compared word by word on
the hit's diagonal: the best segment (a match counts +1, a substitution -PENALTY) must hold at least
min(MIN_WORDS, MIN_SHARE of the item's words) matching words.

The index is broadcast in parts of at most about PART_WORDS item words each; a larger benchmark is
scanned in several parts, so nothing broadcast grows with it. Training texts are never shuffled. Hits are
expanded HITS at a time and kept as one entry for each diagonal of a text and an item, so texts and items
of few words repeated over and over take memory by their lengths, not by the product of them.

Defined cases: null and empty texts and items have no words; an item shorter than the lightest mask
is never found (too short to tell a leak from chance), nor is a segment without five matches under a mask; items alike in text are each reported, rows alike
in item_id and text are one item; of equal best segments the first in the text counts; repeated rows are reported each; a null doc_id or item_id is
reported as null; an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, small_batches
from .words import WORD, mix

#: Fixed masks, weight 5: contiguous, and three with gaps.
MASKS = ("11111", "1101011", "11001101", "101000111")
MIN_WORDS = 12
MIN_SHARE = 0.8
PENALTY = 2
PART_WORDS = 400_000
FILTER_BITS = 20
#: Pairs of a text's place and an item's place that are looked at together.
HITS = 1 << 21
PAIRS = "doc_id long, item_id long, n_matched int, n_aligned int, item_words int, first_word int"

_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_PLACE = np.array([(0x9E3779B97F4A7C15 * (2 * k + 3)) % (1 << 64) | 1 for k in range(8)], np.uint64)


@dataclass
class Index:
    """A part of the benchmark: word numbers (from 1), items one after another, and sorted seeds."""

    vocabulary: dict[str, int]
    ids: list
    words: np.ndarray
    starts: np.ndarray
    seeds: np.ndarray
    places: np.ndarray
    maybe: np.ndarray


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the mask's window at every start; 0 where a marked word is unknown (0)."""
    offsets = _OFFSETS[mask]
    n = len(words) - int(offsets[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(mask + 1), np.uint64)
    known = np.ones(n, bool)
    for k, o in enumerate(offsets):
        w = words[o : o + n]
        known &= w > 0
        out += w.astype(np.uint64) * _PLACE[k]
    out = mix(out)
    out[~known] = 0
    return out


def build_index(items: list[tuple]) -> Index:
    vocabulary: dict[str, int] = {}
    split = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall((t or "").lower())] for _, t in items]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    words = np.array([w for x in split for w in x], np.int32)
    seeds, places = [], []
    for m in range(len(MASKS)):
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            h = seed_hashes(words[s:e], m)
            seeds.append(h)
            places.append(np.arange(s, s + len(h)))
    h = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(vocabulary, [i for i, _ in items], words, starts, h, at.astype(np.int64), maybe)


def best_segment(same: np.ndarray) -> tuple[int, int, int]:
    """(matches, start, end) of the segment with the largest score; the first of equals."""
    run = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    low = np.minimum.accumulate(run)
    end = int(np.argmax(run - low))
    start = int(np.argmin(run[: end + 1]))
    return int(same[start:end].sum()), start, end


def different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def needed(n: int) -> int:
    return min(MIN_WORDS, math.ceil(MIN_SHARE * n))


def leaks(texts: list[str | None], index: Index) -> list[dict[int, tuple[int, int, int]]]:
    """For each text: item number -> (matched, aligned, first word) of its best segment, for items that leak into it."""
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    if not len(index.seeds):
        return out
    gap = np.zeros(max(len(m) for m in MASKS), np.int32)
    parts, starts, at = [], [], 0
    number = index.vocabulary.get
    for t in texts:
        w = WORD.findall(t.lower()) if t else []
        starts.append(at)
        parts += [np.fromiter((number(x, 0) for x in w), np.int32, len(w)), gap]
        at += len(w) + len(gap)
    words, starts = np.concatenate(parts), np.array([*starts, at], np.int64)
    found = np.zeros(0, np.int64)  # text, item and shift in one number each
    span = len(words) + len(index.words) + 1
    for m in range(len(MASKS)):
        h = seed_hashes(words, m)
        pos = np.flatnonzero(index.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & (h != 0))
        low = np.searchsorted(index.seeds, h[pos], "left")
        n = np.searchsorted(index.seeds, h[pos], "right") - low
        pos, low, n = pos[n > 0], low[n > 0], n[n > 0]
        ends = np.cumsum(n)
        s = 0
        while s < len(pos):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + HITS, "right")))
            times = n[s:e]
            which = np.repeat(low[s:e] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            place, where = index.places[which], np.repeat(pos[s:e], times)
            text = np.searchsorted(starts, where, "right") - 1
            item = np.searchsorted(index.starts, place, "right") - 1
            found = different(np.concatenate([found, (text * len(index.ids) + item) * span + (where - place + len(index.words))]))
            s = e
    pairs, shifts = np.divmod(found, span)
    hits = zip((pairs // len(index.ids)).tolist(), (pairs % len(index.ids)).tolist(), (shifts - len(index.words)).tolist(), strict=True)
    for text, item, shift in hits:
        s, e = index.starts[item], index.starts[item + 1]
        lo, hi = max(s, starts[text] - shift), min(e, starts[text + 1] - len(gap) - shift)
        same = words[lo + shift : hi + shift] == index.words[lo:hi]
        matched, a, b = best_segment(same)
        if matched >= needed(int(e - s)):
            first = int(lo + shift + a - starts[text])
            old = out[text].get(int(item))
            if old is None or (-matched, first) < (-old[0], old[2]):
                out[text][int(item)] = (matched, b - a, first)
    return out


def index_parts(benchmark: DataFrame, part_words: int = PART_WORDS) -> list[Index]:
    """Indexes of at most about part_words words each; one large item is a part of its own at worst."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, math.ceil(total / 4 / part_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [build_index(sorted(((r["item_id"], r["text"]) for r in items.where(part == i).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))) for i in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that leaks into it: words matched and aligned, the item's words, the first word's place in the document."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_matched", pa.int32()), ("n_aligned", pa.int32()), ("item_words", pa.int32()), ("first_word", pa.int32())])
    out = None
    for index in index_parts(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            ix = shared.value
            sizes = np.diff(ix.starts)
            for b in batches:
                found = [(i, ix.ids[k], m, n, int(sizes[k]), f) for i, x in zip(b.column("doc_id").to_pylist(), leaks(b.column("text").to_pylist(), ix), strict=True) for k, (m, n, f) in sorted(x.items())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, into which no test item leaks."""
    for index in index_parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = kept_rows(docs, lambda shared=shared: lambda texts: [not x for x in leaks(texts, shared.value)])
    return docs
