"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set of shingles of five words; a shingle's weight is its count in the text times
its inverse document frequency, the mean of its words'. Document frequencies are counted over all
documents in CELLS hashed cells, so the table that is broadcast has a fixed size. Each of SAMPLES
consistent weighted samples of two sets agrees with probability equal to their weighted Jaccard
similarity (sum of minima over sum of maxima); BANDS of ROWS samples make bucket keys.

Equal texts are put together first; all that follows is between different texts. In every bucket
each member is verified against the smallest; both sides of that join lie in tables, so that a hot bucket
can be split. Where the other members of a bucket still belong to several classes, they are compared
block against block, blocks having a bounded size: pairs across classes are verified, most agreeing
samples first, if their samples agree often enough that a pair at the threshold would be missed with
probability under 1e-4. Samples alone meet first; texts travel only to the meetings in which a pair
across classes agrees, and only those of the members that do. A pair found alike joins its classes at
once, so a block yields the links of a spanning forest, not all pairs. Pairs are verified by the
weighted Jaccard similarity of the whole texts. Classes are the connected components; no bucket,
group or partner list is capped.

The inverse document frequency is the mean over a shingle's words rather than the shingle's own: a
shingle's own frequency falls to one in exactly the shingles in which near copies differ, and rises
with the size of the group of copies, so that the similarity of two copies would sink as more copies
come along. By words, weighted and plain similarity of copies stay close.

Defined cases: null text equals empty text; texts without words are alike only if equal; a text of
fewer than five words is one shingle; a null doc_id is larger than any other; repeated rows are equal
texts; a class is named by its smallest doc_id (null if it has none); an empty table has no classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import done, fresh, small_batches, staged
from .words import SHINGLE, WordHashes, mix, shingles

THRESHOLD = 0.8
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
#: Samples that must agree before a pair across classes is verified block against block.
AGREE = 22
CELLS = 1 << 18
CELL_BLOCK = 1 << 12
#: Members of a bucket, and characters of their texts, that are a block when members are compared with each other.
BLOCK_MEMBERS, BLOCK_CHARS = 512, 2 << 20

# ---------------------------------------------------------------- document frequencies


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents per cell of words)."""
    spark = docs.sparkSession
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        words, n = WordHashes(), np.zeros(CELLS, np.int64)
        for b in batches:
            for x in b.column("text"):
                n[np.unique(cells(words.of(x.as_py())))] += 1
        for k in range(CELLS // CELL_BLOCK):
            part = n[k * CELL_BLOCK : (k + 1) * CELL_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], schema=schema)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                c = np.frombuffer(c, "<i8")
                held[k] = held[k] + c if k in held else c
        for k, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c.astype("<i8").tobytes()], pa.binary())], schema=schema)

    small_batches(spark)
    partial = docs.select("text").mapInArrow(count, "block int, counts binary")
    # Two rounds of sums, so that no task reads the tables of all others.
    spread = partial.repartition(F.col("block")).mapInArrow(add, "block int, counts binary")
    total = np.zeros(CELLS, np.int64)
    for r in spread.collect():
        total[r["block"] * CELL_BLOCK : (r["block"] + 1) * CELL_BLOCK] += np.frombuffer(bytes(r["counts"]), "<i8")
    return docs.count(), total


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def idf_table(n: int, df: np.ndarray) -> np.ndarray:
    return (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)


# ---------------------------------------------------------------- weighted sets and samples


def weighted_set(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their weights."""
    s = shingles(hashes)
    if not len(s):
        return s, np.zeros(0)
    k = min(SHINGLE, len(hashes))
    w = idf[cells(hashes)].astype(np.float64)
    run = np.concatenate([[0.0], np.cumsum(w)])
    mean = np.round((run[k:] - run[:-k]) / k, 6)  # rounded: equal shingles get equal weights wherever they stand
    found, first, times = np.unique(s, return_index=True, return_counts=True)
    return found, mean[first] * times


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    least = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def _gamma2(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, 1 - (1 + x) exp(-x), at (i + 1/2) / n."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_R = _gamma2(1 << 16).astype(np.float32)
_LOG_C = np.log(_gamma2(1 << 16)).astype(np.float32)
_SALTS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
_MUL, _MUL2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def samples(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES hashes of (shingle, level): the shingle whose draw c / (y exp(r)) is smallest, by its logarithm."""
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    every = np.arange(SAMPLES)
    for s in range(0, len(found), 2048):
        h = found[s : s + 2048, None]
        log_w = np.log(weights[s : s + 2048]).astype(np.float32)[:, None]
        x = (h ^ _SALTS) * _MUL
        x ^= x >> np.uint64(32)
        x *= _MUL2
        r = _R[(x >> np.uint64(48)).astype(np.int64)]
        a = _LOG_C[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = ((x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_w / r + beta)
        a -= r * (t - beta)
        a -= r
        least = a.argmin(axis=0)
        value = a[least, every]
        better = value < best
        level = t[least, every].astype(np.int64).astype(np.uint64)
        out[better] = mix(h[least, 0] ^ (level * np.uint64(0x9E3779B97F4A7C15)))[better]
        best[better] = value[better]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(ROWS):
        x = mix(x ^ sig.reshape(BANDS, ROWS)[:, k])
    return x.view(np.int64)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, text_key, sig, bands); text_key is the MD5 digest of the text. Texts without words have no bands."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        table, words = idf.value, WordHashes()
        for b in batches:
            sigs, bands = [], []
            for x in b.column("text"):
                found, w = weighted_set(words.of(x.as_py()), table)
                if len(found):
                    s = samples(found, w)
                    sigs.append((s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                    bands.append(band_keys(s))
                else:
                    sigs.append(b"")
                    bands.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return own.mapInArrow(run, "doc_id long, text_key binary, sig binary, bands array<bigint>")


def text_key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


# ---------------------------------------------------------------- candidates and verification


def involved_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted text keys. A bit table of a bounded size lets most other documents go before the join."""
    n = wanted.count()
    bits = 1 << min(24, max(10, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("text_key"), F.lit(bits))
    table = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    own = docs.select(text_key(F.col("text")).alias("text_key"), "text").withColumn("p", place)
    # At most 2**18 cells, whatever the corpus.
    near = own.join(F.broadcast(table), F.shiftright("p", 6) == F.col("cell")).where(F.expr("shiftright(bits, cast(p % 64 as int)) & 1 = 1"))
    return near.join(wanted, "text_key").groupBy("text_key").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose weighted Jaccard similarity reaches the threshold."""
    left = texts.select(F.col("text_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("text_key").alias("b"), F.col("text").alias("text_b"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        table, words = idf.value, WordHashes()
        last: dict[bytes, tuple] = {}
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b")), strict=True):
                if a not in last:
                    if len(last) >= 64:
                        last.clear()
                    last[a] = weighted_set(words.of(x), table)
                if weighted_jaccard(last[a], weighted_set(words.of(y), table)) >= threshold:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.binary()), pa.array([p[1] for p in found], pa.binary())], schema=schema)

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest."""
    lead = staged(members.groupBy("bucket").agg(F.min("text_key").alias("a")), "dup-leads")
    return members.join(lead, "bucket").where("text_key <> a").select("a", F.col("text_key").alias("b")).distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, text_key, label): members besides the smallest, in buckets where these belong to several classes."""
    rows = members.join(labels, "text_key")
    of = staged(rows.groupBy("bucket").agg(F.min("text_key").alias("lead"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low <> high"), "dup-mixed")
    rest = staged(rows.join(of.select("bucket", "lead"), "bucket").where("text_key <> lead").select("bucket", "text_key", "label"), "dup-rest")
    mixed = staged(rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "dup-mixed")
    return rest.join(mixed, "bucket")


def block_links(rows: DataFrame, texts: DataFrame, sigs: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b): links that join the classes found alike within a bucket, block against block."""
    sized = rows.join(texts.select("text_key", F.length("text").alias("chars")), "text_key").join(sigs, "text_key")
    sizes = staged(sized.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("chars") / F.lit(BLOCK_CHARS)), F.lit(1)).cast("int").alias("blocks")), "dup-blocks")
    placed = sized.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    # A member's samples go to every pair of blocks that its own block is in.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    place = ["bucket", "x", "y"]

    def agreeing(sig: np.ndarray, cls: np.ndarray, left: np.ndarray, right: np.ndarray):
        """For each of the left the right ones of other classes whose samples agree often enough, most agreeing first."""
        for i in left:
            agree = (sig[right] == sig[i]).sum(axis=1)
            near = right[np.argsort(-agree, kind="stable")][: int((agree >= AGREE).sum())]
            yield i, near[cls[near] != cls[i]]

    def laid_out(group: pa.Table):
        keys, labels, block = group.column("text_key").to_pylist(), group.column("label").to_pylist(), np.array(group.column("block"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(len(keys), SAMPLES)
        code = {k: i for i, k in enumerate(dict.fromkeys(labels))}
        return keys, sig, np.array([code[k] for k in labels]), np.flatnonzero(block == group.column("x")[0].as_py()), np.flatnonzero(block == group.column("y")[0].as_py())

    def meet(group: pa.Table) -> pa.Table:
        _, sig, cls, left, right = laid_out(group)
        some = np.zeros(len(sig), bool)
        for i, near in agreeing(sig, cls, left, right):
            some[near] = True
            some[i] |= len(near) > 0
        return group.select(["bucket", "x", "y", "block", "text_key", "label", "sig"]).filter(pa.array(some))

    def compare(group: pa.Table) -> pa.Table:
        keys, sig, cls, left, right = laid_out(group)  # classes are joined as links are found
        bodies, table, words, sets, found = group.column("text").to_pylist(), idf.value, WordHashes(), {}, []

        def weighted(i: int):
            if i not in sets:
                sets[i] = weighted_set(words.of(bodies[i]), table)
            return sets[i]

        for i, near in agreeing(sig, cls, left, right):
            while len(near):
                j = int(near[0])
                near = near[1:]
                if weighted_jaccard(weighted(i), weighted(j)) >= threshold:
                    found.append((keys[i], keys[j]))
                    cls[cls == cls[j]] = cls[i]
                    near = near[cls[near] != cls[i]]
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    meetings = placed.select(*place, "block", "text_key", "label", "sig").groupBy(*place).applyInArrow(meet, "bucket bigint, x int, y int, block int, text_key binary, label binary, sig binary")
    near = staged(meetings, "dup-near").join(texts, "text_key")
    return near.select(*place, "block", "text_key", "label", "sig", "text").groupBy(*place).applyInArrow(compare, "a binary, b binary").distinct()


# ---------------------------------------------------------------- classes


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after joining the classes that edges link: the smallest label spreads along edges, then along its own links, until nothing changes."""
    links = staged(edges.join(labels.select(F.col("text_key").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("text_key").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").select("la", "lb").distinct(), "dup-links")
    both = links.select(F.col("la").alias("u"), F.col("lb").alias("v")).union(links.select("lb", "la"))
    top = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("top")), "dup-top")
    if not top.take(1):
        return labels
    while True:
        near = both.join(top.select(F.col("u").alias("v"), F.col("top").alias("t")), "v").groupBy("u").agg(F.min("t").alias("t"))
        spread = top.join(near, "u").select("u", F.least("top", "t").alias("top"))
        jump = spread.select(F.col("u").alias("w"), F.col("top").alias("tt"))
        new = staged(spread.join(jump, spread["top"] == jump["w"], "left").select("u", F.least("top", F.coalesce("tt", "top")).alias("top")), "dup-top")
        changed = new.join(top.withColumnRenamed("top", "was"), "u").where("top <> was").limit(1).count()
        top = new
        if not changed:
            break
    named = labels.join(top.withColumnRenamed("u", "label"), "label", "left")
    return staged(named.select("text_key", F.coalesce("top", "label").alias("label")), "dup-labels")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents as (doc_id, text_key), classes as (text_key, label) of the texts that share a bucket with another)."""
    spark: SparkSession = docs.sparkSession
    n, df = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(n, df))
    signed = staged(signatures(docs, idf), "dup-signed")
    rows = signed.select("doc_id", "text_key")
    # From here on a text is one row, however many documents have it.
    distinct = staged(signed.groupBy("text_key").agg(F.first(F.struct("sig", "bands")).alias("s")).select("text_key", "s.sig", "s.bands"), "dup-distinct")
    banded = distinct.select("text_key", F.explode("bands").alias("bucket"))
    shared = staged(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "dup-shared")
    members = staged(banded.join(shared, "bucket"), "dup-members")
    wanted = staged(members.select("text_key").distinct(), "dup-wanted")
    texts = staged(involved_texts(docs, wanted), "dup-texts")
    sigs = distinct.select("text_key", "sig").join(wanted, "text_key")
    labels = wanted.withColumn("label", F.col("text_key"))
    labels = merge(labels, verify(star_pairs(members), texts, idf, threshold))
    opened = staged(open_members(members, labels), "dup-open")
    labels = merge(labels, block_links(opened, texts, sigs, idf, threshold))
    done(members, texts, opened, distinct, shared)
    return rows, labels


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, class_key): the class of every row. class_key tells classes apart that have no doc_id."""
    rows, labels = text_classes(docs, threshold)
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(labels, "text_key", "left").withColumn("label", F.coalesce("label", "text_key"))
    named = texts.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    # In a table of its own, so that a text which many documents have can be split in the join.
    classed = staged(texts.select("text_key", "label").join(named, "label").withColumnRenamed("label", "class_key"), "dup-classes")
    return rows.join(classed, "text_key")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size, kept."""
    return classes(docs, threshold).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, all columns: that with the smallest doc_id; of rows alike in id and text, one."""
    found = classes(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min(F.struct("text_key")).alias("k"), F.first("doc_id").alias("doc_id"))
    columns, own_key, own_id, nth = docs.columns, fresh(docs, "own_key"), fresh(docs, "own_id"), fresh(docs, "nth")
    wanted = found.select(F.col("k.text_key").alias(own_key), F.col("doc_id").alias(own_id))
    keyed = docs.withColumn(own_key, text_key(F.col("text"))).withColumn(own_id, F.col("doc_id").cast("long"))
    left, right = keyed.alias("l"), wanted.alias("r")
    kept = left.join(right, F.col(f"l.{own_key}").eqNullSafe(F.col(f"r.{own_key}")) & F.col(f"l.{own_id}").eqNullSafe(F.col(f"r.{own_id}")), "left_semi")
    # Of rows alike in id and text that stays which is smallest in all its columns.
    one = Window.partitionBy(own_key, own_id).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))
    return kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*[f"`{c}`" for c in columns])
