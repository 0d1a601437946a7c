"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the
longest phrases that occur in a language's labelled text; the fewer phrases, the better the language
describes it. Phrase counts are normalised by the logarithm of the automaton's text length (the bits
that name a phrase), which makes them an estimate of the cross entropy; the smallest wins, ties go to
the smaller language name.

Texts are folded to letters and single blanks. Every letter that labelled text holds has a code of its
own: one symbol each while there are few; else the commonest have one symbol, and the rarer two, three
or four, by what language uses them most, so that a table stays narrow whatever the scripts. A parse
runs in blocks of BLOCK symbols, each starting
a new phrase; that is part of the measure and lets one step of numpy advance all blocks of a batch of
documents at once, with a transition table per language whose size is a parameter.

The labelled sample is bounded: SAMPLE_DOCS different texts a language, one excerpt of EXCERPT characters
each, taken at a hashed place; an automaton holds at most TRAIN symbols of it, fewer where the tables of
all languages would not fit TABLE_BYTES. Prediction reads whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0; without any labelled row
everything is `und`; letters that no labelled text holds belong to no phrase in any language; null
languages and null texts are not learned from; a null doc_id counts as '' in the held-out rule;
repeated rows are predicted each.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import kept_rows, remainder, small_batches

SAMPLE_DOCS = 96
EXCERPT = 512
#: Symbols of labelled text in an automaton, and the bytes of all tables together.
TRAIN = 40_000
TABLE_BYTES = 160 << 20
#: Symbols besides BLANK and STRANGE; where letters are more: letters of one symbol, and symbols that begin a code of two, three and four.
SYMBOLS, SINGLES, LEADS = 62, 36, (12, 13, 1)
BLOCK = 1024
#: Symbols parsed at once.
LANES = 4 << 20
#: Bits by which a language's estimate, times this, weighs in the score.
SHARPNESS = 6.0
#: Bits by which a text must speak against every language to be dropped as in none.
EVIDENCE = 64.0

BLANK, STRANGE = 0, 1


def suffix_automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions (states x alphabet, -1: none) of the automaton of all substrings; state 0 is the start."""
    n = len(symbols)
    link, length = [-1] * (2 * n + 2), [0] * (2 * n + 2)
    rows = [[-1] * alphabet]
    last, used = 0, 1
    for c in symbols.tolist():
        cur, used = used, used + 1
        rows.append([-1] * alphabet)
        length[cur] = length[last] + 1
        p = last
        while p != -1 and rows[p][c] == -1:
            rows[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, used = used, used + 1
                rows.append(rows[q].copy())
                length[clone], link[clone] = length[p] + 1, link[q]
                while p != -1 and rows[p][c] == q:
                    rows[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array(rows, np.int32)


def parsing_table(go: np.ndarray) -> np.ndarray:
    """Flat table over (state * alphabet + symbol) of (next state * alphabet) * 2 + 1 where a phrase ends before the symbol.

    Two states are added: after a symbol that occurs nowhere, which is a phrase of its own, and, last, before the first symbol.
    """
    n, alphabet = go.shape
    fresh = np.where(go[0] < 0, n, go[0])  # where a phrase begins with the symbol
    ends = go < 0
    nxt = np.concatenate([np.where(ends, fresh[None, :], go), fresh[None, :], fresh[None, :]])
    ends = np.concatenate([ends, np.ones((1, alphabet), bool), np.zeros((1, alphabet), bool)])
    return ((nxt.astype(np.int32) * alphabet) * 2 + ends).ravel().astype(np.int32)


@dataclass
class Parser:
    langs: list[str]
    #: Symbols of each letter, by the folded letter.
    symbols: dict[str, tuple[int, ...]]
    tables: list[np.ndarray]
    bits: list[float]
    alphabet: int

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of every code point and how many there are; letters without a code are STRANGE, all else is BLANK."""
        width = max([1, *map(len, self.symbols.values())])
        out, sizes = np.zeros((sys.maxunicode + 1, width), np.uint8), np.ones(sys.maxunicode + 1, np.uint8)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalpha():
                code = self.symbols.get(ch.lower()[0], (STRANGE,))
            elif unicodedata.category(ch) == "Mn" and ch in self.symbols:
                code = self.symbols[ch]
            else:
                continue
            out[cp, : len(code)], sizes[cp] = code, len(code)
        return out, sizes


def codes(letters: dict[str, dict[str, int]]) -> dict[str, tuple[int, ...]]:
    """A code for each letter, from its counts by language. No code begins another."""
    total = {c: sum(n.values()) for c, n in letters.items()}
    common = sorted(letters, key=lambda c: (-total[c], c))
    if len(common) <= SYMBOLS:
        return {c: (i + 2,) for i, c in enumerate(common)}
    out = {c: (i + 2,) for i, c in enumerate(common[:SINGLES])}
    most = {c: min(n, key=lambda lang: (-n[lang], lang)) for c, n in letters.items()}
    rest, lead = sorted(common[SINGLES:], key=lambda c: (most[c], -total[c], c)), SINGLES + 2
    for more, leads in enumerate(LEADS, 1):
        size = leads * SYMBOLS**more
        for i, c in enumerate(rest[:size]):
            tail = [i // SYMBOLS**k % SYMBOLS + 2 for k in range(more - 1, -1, -1)]
            out[c] = (lead + i // SYMBOLS**more, *tail)
        rest, lead = rest[size:], lead + leads
    return out


def fold(text: str, look: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Symbols of a text: runs of what is not a letter become one blank, none at the ends."""
    table, sizes = look
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = table[:, 0][cp]
    if table.shape[1] > 1 and len(cp):
        n = sizes[cp]
        if n.max() > 1:
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
            s = table[np.repeat(cp, n), at]
    blank = s == BLANK
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    s = s[keep]
    if len(s) and s[0] == BLANK:
        s = s[1:]
    return s[:-1] if len(s) and s[-1] == BLANK else s


def phrase_counts(texts: list[np.ndarray], parser: Parser) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    out = np.zeros((len(texts), len(parser.langs)), np.int64)
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= LANES):
            total += len(texts[end])
            end += 1
        group = texts[at:end]
        sizes = np.array([len(t) for t in group])
        n_blocks = -(-sizes // BLOCK)
        if n_blocks.sum():
            owner = np.repeat(np.arange(len(group)), n_blocks)
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            number = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
            begin = first[owner] + number * BLOCK
            length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
            order = np.argsort(-length, kind="stable")
            owner, begin, length = owner[order], begin[order], length[order]
            flat = np.concatenate(group)
            steps = int(length[0])
            live = np.searchsorted(-length, -np.arange(steps), side="left")  # lanes longer than t
            lanes = np.zeros((steps, len(owner)), np.uint8)
            for t in range(steps):
                lanes[t, : live[t]] = flat[begin[: live[t]] + t]
            for k, table in enumerate(parser.tables):
                state = np.full(len(owner), len(table) - parser.alphabet, np.int32)
                ends = np.ones(len(owner), np.int32)
                for t in range(steps):
                    m = live[t]
                    v = table.take(state[:m] + lanes[t, :m])
                    ends[:m] += v & 1
                    np.right_shift(v, 1, out=state[:m])
                out[at:end, k] = np.bincount(owner, weights=ends, minlength=len(group)).astype(np.int64)
        at = end
    return out


def build(samples: dict[str, list[str]]) -> Parser:
    langs = sorted(samples)
    letters: dict[str, dict[str, int]] = {}
    for name in langs:
        for t in samples[name]:
            for ch in t.lower():
                if ch.isalpha():
                    of = letters.setdefault(ch, {})
                    of[name] = of.get(name, 0) + 1
    symbols = codes(letters)
    alphabet = max([1, *(x for code in symbols.values() for x in code)]) + 1
    parser = Parser(langs, symbols, [], [], alphabet)
    if not langs:
        return parser
    look = parser.lookup()
    # An automaton has under two states a symbol; every language gets an equal share of the bytes.
    most = min(TRAIN, TABLE_BYTES // (len(langs) * 2 * 4 * alphabet))
    for name in langs:
        parts = [fold(t, look) for t in samples[name]]
        parts = [np.append(p, np.uint8(BLANK)) for p in parts if len(p)]
        text = (np.concatenate(parts) if parts else np.zeros(1, np.uint8))[:most]
        parser.tables.append(parsing_table(suffix_automaton(text, alphabet)))
        parser.bits.append(math.log2(len(text) + 1))
    return parser


def labelled_sample(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Excerpts of at most sample_docs documents a language, outside the held-out fifth: of different texts those with the smallest keyed hash."""
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 0)).withColumn("draw", F.pmod(F.xxhash64("text", F.lit("lang")), F.lit(1 << 30)))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).where("n > 0").collect()}
    if not counts:
        return {}
    # Twice the texts needed are expected below the bound; equal texts share a draw and count once.
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * 2 * sample_docs / n) + 1))])
    start = F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int")
    drawn = own.where((F.col("draw") < bound[F.col("lang")]) & F.col("text").rlike(r"\p{L}")).select("lang", "draw", F.md5("text").alias("key"), F.substring("text", F.lit(1) + start, F.lit(EXCERPT)).alias("part"))
    different = drawn.groupBy("lang", "key").agg(F.min("draw").alias("draw"), F.first("part").alias("part"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key"))
    out: dict[str, list[str]] = {}
    for r in different.withColumn("nth", nth).where(F.col("nth") <= sample_docs).orderBy("lang", "nth").collect():
        out.setdefault(r["lang"], []).append(r["part"])
    return out


def learn(docs: DataFrame) -> Parser:
    return build(labelled_sample(docs))


def judge(texts: list[str | None], p: Parser, look: np.ndarray) -> list[tuple[str, float, float | None, int]]:
    """(language, score, bits a symbol, symbols) of each text."""
    folded = [fold(x, look) if x else np.zeros(0, np.uint8) for x in texts]
    out = []
    for t, row in zip(folded, phrase_counts(folded, p), strict=True):
        if not len(t) or not p.langs:
            out.append(("und", 0.0, None, len(t)))
            continue
        h = [float(c) * w / len(t) for c, w in zip(row, p.bits, strict=True)]
        best = min(range(len(h)), key=lambda i: (h[i], p.langs[i]))
        out.append((p.langs[best], 1.0 / sum(math.exp(-SHARPNESS * (x - h[best])) for x in h), h[best], len(t)))
    return out


def predict(docs: DataFrame, parser: Parser) -> DataFrame:
    """The input's columns with lang_pred, lang_score (0 to 1), lang_bits, the winner's estimate in bits a symbol, and lang_symbols."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(parser)
    docs = docs.drop("lang_pred", "lang_score", "lang_bits", "lang_symbols")
    keep = docs.columns
    fields = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_bits", T.DoubleType()), T.StructField("lang_symbols", T.LongType())])

    def run(batches):
        p = shared.value
        look = p.lookup()
        for b in batches:
            found = judge(b.column("text").to_pylist(), p, look)
            names, scores, bits, sizes = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(sizes, pa.int64())], names=[*keep, "lang_pred", "lang_score", "lang_bits", "lang_symbols"])

    return docs.mapInArrow(run, fields)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def drop_unknown(docs: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """The documents, all columns, that some learned language describes: those without letters go, and those that letters drawn evenly from the alphabet describe better than every language, by `evidence` bits over the whole text."""
    parser = learn(docs)
    even = math.log2(max(2, parser.alphabet))
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def keep():
        p = shared.value
        look = p.lookup()
        return lambda texts: [name != "und" and (bits - even) * n < evidence for name, _, bits, n in judge(texts, p, look)]

    return kept_rows(docs, keep)
