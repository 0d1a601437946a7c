"""Language-model scores: a unigram base and online logistic context mixing.

Text is folded (A-Z lowered) and read as UTF-8 bytes followed by one END byte that UTF-8 never holds.
Each byte is eight binary decisions. For each of the last 1 to 6 bytes, and for those of them in the
word begun, the hash of that context and of the byte's leading bits names a cell, whose counts of zeros
and ones in the training texts give a predictor's bit probability. The predictors are combined in the
logistic domain by two sets of weights that gates choose (the decision node and the longest context
known; how much was counted in three of them), and the mean of both is refined by an adaptive
probability map. Weights and map are learned online from the byte runs of all training texts: these are
dealt into two parts, and each part teaches over the counts of the other. Learners in parallel start
alike, and their weights are averaged by how often each was used. The log probabilities of all bits add
up to the text's score.

The cell counts that score come from all training texts. As the model is fixed while it
scores, a byte's probability depends on its run only: the byte and the REACH before it. So no table of
the corpus is broadcast. Texts are read in blocks; each block sends its different runs, with their
counts, to the bucket that owns the last three bytes before them. A bucket adds up the counts of all
blocks, builds the cells of its contexts of three bytes and more, computes every run's probability
once, and answers the blocks, which add up their texts. Only the contexts of one and two bytes (at most
65,792 of them), the weights and the map are broadcast. What is gathered grows with the corpus, what one
task holds does not: a block is bounded by BLOCK_BYTES or one text, a bucket works on its runs in pieces
of about PIECE runs, and the blocks that ask a bucket are dealt in groups.

Base score: counts of all training tokens are exact. The HEAD most frequent tokens of at most
HEAD_BYTES bytes are broadcast and added up where the text is read; only the other tokens travel to a
join with the table of counts, so no token is hot there.

Defined cases: null text is empty, one end token; without training texts N and V are 0 (every token is
unknown) and the predictors know nothing; a null doc_id counts as '' in the rule; repeated rows are
scored each; texts are compared by bytes, so nothing but A-Z is folded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, done, remainder, small_batches, staged, trim

HEAD, HEAD_BYTES = 1 << 17, 64
#: Bytes before the predicted one in a run; the lengths of the byte contexts; predictors, the word's last.
#: It is six for the layout of a run: seven bytes, and eight bits free.
REACH = 6
LENGTHS = (1, 2, 3, 4, 5, 6)
PREDICTORS = len(LENGTHS) + 1
#: Context lengths whose counts are broadcast; longer contexts share the last three bytes that name a bucket.
LOW = 2
BUCKETS = 512
#: Cells of a predictor in a piece, for each (run, bit) counted there, at least.
FILL = 2
#: Runs whose cells are built together, about; blocks that a bucket answers in one task; bytes of text in a block.
PIECE, GROUP, BLOCK_BYTES = 1 << 14, 256, 16 << 20
#: Bytes whose runs are looked at together; runs that are counted together in a block, and slices of the buckets in which its counts are added up.
STEP, PART, SLICES = 1 << 19, 1 << 22, 16
END = 0xFF
END_TOKEN = b""
#: One training text in LEARN_FROM is in the second of the two parts; runs that a learner holds, about, and how many times as many it learns from;
#: most runs in one online step; most times that a run is repeated.
LEARN_FROM, LEARNER_RUNS, LEARNER_TURNS, LANES, REPEATS = 2, 1 << 16, 4, 512, 8
#: Slices in which learned weights are summed.
WEIGHT_BLOCK = 1 << 13
#: A run's log2 probability travels as a whole number of these steps.
STEPS_PER_BIT = 512
#: Rows of a batch where a row is a packed table.
TABLE_ROWS = 32

_ORDER_MUL = np.array([0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xA24BAED4963EE407, 0x94D049BB133111EB], np.uint64)
_NODE_MUL = np.uint64(0x2545F4914F6CDD1D)


# ---------------------------------------------------------------- runs


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def run_keys(folded: list[bytes]) -> np.ndarray:
    """The run of every byte of every text, END included: the byte lowest, above it the REACH bytes before it (0 before the start), the nearest highest."""
    if not folded:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"\0" * 7 + (b"\xff" + bytes(REACH)).join(folded) + b"\xff", np.uint8)
    # The eight bytes that end at each place are a whole number, the byte itself highest.
    key = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).view("<u8")[:, 0].astype(np.uint64)
    key &= np.uint64((1 << 56) - 256)
    key |= data[7:]
    if len(folded) == 1:
        return key
    # What stands between two texts is not a place of either.
    sizes = np.array([len(t) + 1 for t in folded])
    keep = np.ones(len(key), bool)
    gap = np.cumsum(sizes)[:-1] + REACH * np.arange(len(sizes) - 1)
    keep[(gap[:, None] + np.arange(REACH)).ravel()] = False
    return key[keep]


def contexts(keys: np.ndarray) -> list[np.ndarray]:
    """The number of each predictor's context, from runs. The word begun is taken with what stands before it up to three bytes."""
    out = [keys >> np.uint64(8 * (REACH + 1 - n)) for n in LENGTHS]
    word = keys >> np.uint64(8)
    for k in range(REACH):  # from the last byte back: what stands before a blank is not in the word
        byte = (keys >> np.uint64(8 * (REACH - k))) & np.uint64(255)
        blank = (byte == 32) | ((byte >= 9) & (byte <= 13)) | (byte == 0)
        kept = max(k, LOW + 1)
        word[blank] &= np.uint64(((1 << 8 * kept) - 1) << 8 * (REACH - kept))
    return [*out, word]


def owner(keys: np.ndarray) -> np.ndarray:
    """64 bits of the last three bytes before each run's byte; the highest name its bucket, the next its piece."""
    x = (keys >> np.uint64(8 * (REACH - LOW))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (owner(keys) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.uint16)


def tally(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and how often each occurs with kind 0 and kind 1, of keys that carry a kind of 0 to 2 in two bits below; sorts in place."""
    return by_kind(*counted(both))


def counted(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, sorted, and how often each occurs; sorts in place, and needs further memory for the different ones only."""
    both.sort()
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return both[first], np.diff(first, append=len(both)).astype(np.uint32)


def by_kind(both: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What tally gives, of sorted keys with kinds that occur so many times; one may stand there several times."""
    keys, kinds = both >> np.uint64(2), both.astype(np.uint8) & 3
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = [np.where(kinds == k, times, 0).astype(np.int64) for k in (0, 1)]
    return keys[first], np.stack([np.add.reduceat(c, first) if len(first) else c for c in counts])


@dataclass
class BlockRuns:
    """The runs of a block's texts, with their kinds. They are counted PART at a time, and what the parts hold is added up a slice of the
    buckets at a time: never are all runs of the block, or a copy of all different ones, in memory."""

    room: np.ndarray
    size: int
    parts: list[list[tuple[np.ndarray, np.ndarray]]]

    @classmethod
    def empty(cls) -> BlockRuns:
        return cls(np.empty(PART, np.uint64), 0, [])

    def add(self, group: list[bytes], kinds: list[int]) -> None:
        both = run_keys(group)
        both <<= np.uint64(2)
        both |= np.repeat(np.array(kinds, np.uint8), [len(t) + 1 for t in group])
        if self.size + len(both) > len(self.room):
            self.count()
        if len(both) > len(self.room):  # a text that is longer is a part of its own
            self._keep(both)
        else:
            self.room[self.size : self.size + len(both)] = both
            self.size += len(both)

    def count(self) -> None:
        if self.size:
            self._keep(self.room[: self.size])
            self.size = 0

    def _keep(self, both: np.ndarray) -> None:
        both, times = counted(both)
        of = (bucket_of(both >> np.uint64(2)) // (BUCKETS // SLICES)).astype(np.uint8)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(1, SLICES))
        self.parts.append(list(zip(np.split(both[order], cuts), np.split(times[order], cuts), strict=True)))

    def merged(self):
        """(keys, counts) of every slice that has runs, as tally gives them; the block is empty then."""
        self.count()
        parts, self.parts = self.parts, []
        for slices in zip(*parts, strict=True):
            both, times = (np.concatenate(x) for x in zip(*slices, strict=True))
            if len(both):
                order = np.argsort(both, kind="stable")  # fast, as each part is sorted
                yield by_kind(both[order], times[order])


def merge_runs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (keys, counts) of several; counts are (2, n): in the texts of either part."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
    counts = np.concatenate([np.zeros((2, 0), np.int64), *(c for _, c in parts)], axis=1)
    if len(parts) < 2:
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.stack([np.add.reduceat(c[order], first) if len(first) else c for c in counts])


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    values = np.ascontiguousarray(values)
    return _ZIP.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T))


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(_UNZIP.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n)


def pack_rows(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def sums_of(keys: np.ndarray, sizes: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's keys; the table is sorted and holds every key. At most 256 texts."""
    both = (keys << np.uint64(8)) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    both.sort()
    keys = both >> np.uint64(8)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    each = values[np.searchsorted(table, keys[first])].astype(np.float64)
    return np.bincount((both & np.uint64(255)).astype(np.int64), weights=np.repeat(each, np.diff(np.append(first, len(keys)))), minlength=len(sizes))


def groups_of(texts: list[bytes], most: int = STEP):
    """Slices of at most 256 texts of about `most` bytes; a longer text is a slice of its own."""
    held, size = [], 0
    for t in texts:
        if held and (size + len(t) > most or len(held) == 256):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, where each text's begin) of a batch: words between white space, then the end, which is the empty token."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, starts = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    full = np.asarray(pc.not_equal(pc.binary_length(words), 0))
    kept = np.concatenate([[0], np.cumsum(full)])[starts]
    words = words.filter(pa.array(full)).cast(pa.large_binary())
    # The end goes behind each text's words.
    n = np.diff(kept)
    take = np.full(len(words) + len(n), len(words), np.int64)
    at = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
    take[at] = np.arange(len(words))
    return pa.concat_arrays([words, pa.array([END_TOKEN], pa.large_binary())]).take(pa.array(take)), kept + np.arange(len(n) + 1)


# ---------------------------------------------------------------- mixing


def squash(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -12, 12)))


#: Levels of what was counted, of the longest context known, and knots of the map.
LEVELS, KNOWN, KNOTS = 5, len(LENGTHS) + 1, 33


@dataclass
class Mixer:
    by_node: np.ndarray
    by_counts: np.ndarray
    refine: np.ndarray

    @classmethod
    def fresh(cls) -> Mixer:
        knots = squash((np.arange(KNOTS) - KNOTS // 2) * 0.5).astype(np.float32)
        return cls(np.full((256 * KNOWN, PREDICTORS + 1), 0.3, np.float32), np.full((LEVELS**3, PREDICTORS + 1), 0.3, np.float32), np.tile(knots, (256 * LEVELS, 1)))

    def predict(self, x, gates):
        """(probability of a one, of either mixer, of the map's neighbours)."""
        z1, z2 = np.einsum("ij,ij->i", x, self.by_node[gates[0]]), np.einsum("ij,ij->i", x, self.by_counts[gates[1]])
        z = np.clip((z1 + z2) / 2, -7.999, 7.999)
        at = z * 2 + KNOTS // 2
        low = np.floor(at).astype(np.int64)
        part = at - low
        refined = self.refine[gates[2], low] * (1 - part) + self.refine[gates[2], low + 1] * part
        return np.clip((squash(z) + 3 * refined) / 4, 2.0**-14, 1 - 2.0**-14), z1, z2, low, part

    def learn(self, x, gates, ones, weight, rate: float, used: Mixer) -> None:
        """One online step of bits that count `weight` times; used adds up how much each knot and set took part."""
        _, z1, z2, low, part = self.predict(x, gates)
        # Bits that step together and share a set share its step.
        for sets, own, gate, z in ((self.by_node, used.by_node, gates[0], z1), (self.by_counts, used.by_counts, gates[1], z2)):
            n = np.bincount(gate, weights=weight)
            at = (gate[:, None] * (PREDICTORS + 1) + np.arange(PREDICTORS + 1)).ravel()
            step = ((4 * rate / (3 + n[gate]) * weight * (ones - squash(z)))[:, None] * x).ravel()
            flat = sets.reshape(-1)
            flat += np.bincount(at, weights=step, minlength=len(flat)).astype(np.float32)
            own[: len(n)] += n[:, None]
        knots, where = np.unique(gates[2] * KNOTS + np.where(part < 0.5, low, low + 1), return_inverse=True)
        n = np.bincount(where, weights=weight)
        refine = self.refine.reshape(-1)
        step = 0.08 / (3 + n) * (np.bincount(where, weights=weight * ones) - n * refine[knots])
        refine[knots] = np.clip(refine[knots] + step, 1e-4, 1 - 1e-4)
        used.refine.reshape(-1)[knots] += n

    def study(self, inputs: tuple, times: np.ndarray, used: Mixer) -> None:
        """Learn weights and map online from runs that occur `times` in the texts of a part: each is taken up to REPEATS times, in an order without regard to its place."""
        x, gates, ones = inputs
        repeats = np.minimum(times, REPEATS)
        order = np.repeat(np.arange(len(times)), repeats)
        weight = (times / np.maximum(repeats, 1))[order]
        order_of = np.random.default_rng(len(order)).permutation(len(order))
        order, weight = order[order_of], weight[order_of]
        lanes = min(LANES, max(8, len(order) // 256))
        for s in range(0, len(order), lanes):
            at = order[s : s + lanes]
            rate = 0.02 * (1 - s / len(order)) + 0.002
            self.learn(x[:, at].reshape(-1, PREDICTORS + 1), [g[:, at].ravel() for g in gates], ones[:, at].ravel().astype(np.float64), np.tile(weight[s : s + lanes], 8), rate, used)

    def weights(self) -> np.ndarray:
        return np.concatenate([self.by_node.ravel(), self.by_counts.ravel(), self.refine.ravel()])

    def with_weights(self, flat: np.ndarray) -> Mixer:
        a, b = self.by_node.size, self.by_node.size + self.by_counts.size
        return Mixer(*[x.astype(np.float32).reshape(own.shape) for x, own in zip((flat[:a], flat[a:b], flat[b:]), (self.by_node, self.by_counts, self.refine), strict=True)])

    def bits(self, inputs: tuple) -> np.ndarray:
        """Log2 probability of each run's byte after the bytes before it."""
        x, gates, ones = inputs
        total = np.zeros(x.shape[1])
        for d in range(8):
            p = self.predict(x[d], [g[d] for g in gates])[0]
            total += np.log2(np.where(ones[d], p, 1 - p))
        return total


# ---------------------------------------------------------------- predictors


@dataclass
class Low:
    """Counts in contexts of one and two bytes: a row of each context's decision nodes, leaves last; row 0 is of no context."""

    rows: list[np.ndarray]
    trees: list[np.ndarray]

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Low:
        """keys: a byte lowest, and above it the two before it, the nearest highest."""
        out = cls([], [])
        for n in range(1, LOW + 1):
            context = keys >> 8 * (LOW + 1 - n)
            ids, where = np.unique(context, return_inverse=True)
            rows = np.zeros(1 << 8 * n, np.int32)
            rows[ids] = np.arange(1, len(ids) + 1)
            tree = np.zeros((len(ids) + 1, 512))
            tree[:, 256:] = np.bincount((where + 1) * 256 + (keys & 255), weights=counts, minlength=256 * (len(ids) + 1)).reshape(-1, 256)
            for d in range(7, -1, -1):
                level = tree[:, 2 << d : 4 << d]
                tree[:, 1 << d : 2 << d] = level[:, ::2] + level[:, 1::2]
            out.rows.append(rows)
            out.trees.append(tree.astype(np.float32))
        return out


def pieces(keys: np.ndarray) -> list[np.ndarray]:
    """Places of runs that are worked on together: all that share their last three bytes are in one."""
    n = -(-len(keys) // PIECE)
    if n < 2:
        return [np.arange(len(keys))] if len(keys) else []
    piece = (owner(keys) >> np.uint64(24)) % np.uint64(n)
    order = np.argsort(piece, kind="stable")
    return [x for x in np.split(order, np.searchsorted(piece[order], np.arange(1, n, dtype=np.uint64))) if len(x)]


def _level(n: np.ndarray, *bounds: int) -> np.ndarray:
    out = np.zeros(n.shape, np.int64)
    for b in bounds:
        out += n >= b
    return out


def inputs_of(keys: np.ndarray, counts: np.ndarray, low: Low, wanted: np.ndarray | None = None) -> tuple:
    """(logits, gates, bits) of all eight decisions of the runs, or of those at the wanted places: cells are counted from all of them."""
    of = slice(None) if wanted is None else wanted
    byte = (keys & np.uint64(255)).astype(np.int64)
    nodes = np.stack([(1 << d) | (byte >> (8 - d)) for d in range(8)])
    ones = np.stack([(byte >> (7 - d)) & 1 for d in range(8)])
    context = contexts(keys)
    some, bits = nodes[:, of], ones[:, of]
    x = np.empty((8, some.shape[1], PREDICTORS + 1), np.float32)
    seen = []
    size = max(4, math.ceil(math.log2(max(1, FILL * 8 * len(keys)))))
    times = np.tile(counts.astype(np.float64), 8)
    for i in range(PREDICTORS):
        if i < LOW:
            tree, row = low.trees[i], low.rows[i][context[i][of].astype(np.int64)][None, :]
            n, n1 = tree[row, some], tree[row, 2 * some + 1]
        else:
            h = context[i] * _ORDER_MUL[i] + nodes.astype(np.uint64) * _NODE_MUL
            h ^= h >> np.uint64(31)
            at = ((h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - size)).astype(np.int64)
            n = np.bincount(at.ravel(), weights=times, minlength=1 << size).astype(np.float32)[at[:, of]]
            n1 = np.bincount(at.ravel(), weights=times * ones.ravel(), minlength=1 << size).astype(np.float32)[at[:, of]]
        x[:, :, i] = np.clip(np.log((n1 + np.float32(0.4)) / (n - n1 + np.float32(0.4))), -8, 8)
        seen.append(n)
    x[:, :, -1] = 0.3
    known = sum((seen[i] > 0).astype(np.int64) for i in range(len(LENGTHS)))
    top = _level(seen[len(LENGTHS) - 1], 1, 2, 3, 6)
    gates = [some * KNOWN + known, (top * LEVELS + _level(seen[3], 1, 2, 4, 16)) * LEVELS + _level(seen[1], 1, 16, 256, 4096), some * LEVELS + top]
    return x, gates, bits


def run_bits(keys: np.ndarray, counts: np.ndarray, low: Low, mixer: Mixer) -> np.ndarray:
    """Log2 probability of every run, in steps, given the counts of a whole bucket."""
    out = np.zeros(len(keys), np.uint16)
    for at in pieces(keys):
        out[at] = np.minimum(65535, np.round(-STEPS_PER_BIT * mixer.bits(inputs_of(keys[at], counts[at], low)))).astype(np.uint16)
    return out


# ---------------------------------------------------------------- Spark side

READ = "kind int, block long, bucket int, n int, keys binary, counts binary, texts binary"
_READ = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])
#: Kinds of its rows.
TEXTS, RUNS = 0, 1
PACKED = "bucket int, n int, keys binary, counts binary, n_lessons long"


def _filled(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _READ], schema=_READ)


def _bucket_rows(block: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    bucket = bucket_of(keys)
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[:, order].astype(np.uint32), bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    cuts = list(zip(first, [*first[1:], len(keys)], strict=True))
    return _filled(kind=[RUNS] * len(cuts), block=[block] * len(cuts), bucket=bucket[first].astype(np.int32), n=[e - s for s, e in cuts], keys=[pack(keys[s:e]) for s, e in cuts], counts=[pack(counts[:, s:e].ravel()) for s, e in cuts])


def read_texts(own: DataFrame) -> DataFrame:
    """One pass over the texts: the texts, packed, with the block each is in, and each block's runs by bucket."""

    def run(batches):
        trim()
        top, number, size, runs = TaskContext.get().partitionId() << 32, 0, 0, BlockRuns.empty()
        for b in batches:
            kinds = [2 if out else int(second) for out, second in zip(b.column("held_out").to_pylist(), b.column("second").to_pylist(), strict=True)]
            packed, at = b.select(["doc_id", "held_out", "text"]), 0
            for group in groups_of([fold(x.as_py()) for x in b.column("text")]):
                held = sum(len(t) + 1 for t in group)
                if size and size + held > BLOCK_BYTES:
                    yield from (_bucket_rows(top + number, *m) for m in runs.merged())
                    number, size = number + 1, 0
                runs.add(group, kinds[at : at + len(group)])
                yield _filled(kind=[TEXTS], block=[top + number], texts=[pack_rows(packed.slice(at, len(group)))])
                size, at = size + held, at + len(group)
        yield from (_bucket_rows(top + number, *m) for m in runs.merged())

    return own.select("doc_id", "held_out", "second", "text").mapInArrow(run, READ)


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts; the end of a text is the empty token."""

    def run(batches):
        counted, tokens = [], 0

        def add_up():
            every = pa.concat_arrays([c[0] for c in counted]).dictionary_encode()
            return every.dictionary, np.bincount(np.asarray(every.indices), weights=np.concatenate([c[1] for c in counted]), minlength=len(every.dictionary))

        for b in batches:
            words = tokens_of(b.column("text"))[0].dictionary_encode()
            counted.append((words.dictionary, np.bincount(np.asarray(words.indices), minlength=len(words.dictionary)).astype(np.float64)))
            tokens += len(words.dictionary)
            if tokens > 400_000:
                counted = [add_up()]
                tokens = len(counted[0][0])
                if tokens > 200_000:
                    yield pa.RecordBatch.from_arrays([counted[0][0].cast(pa.binary()), pa.array(counted[0][1].astype(np.int64))], names=["token", "n"])
                    counted, tokens = [], 0
        if counted:
            words, times = add_up()
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(times.astype(np.int64))], names=["token", "n"])

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def add_runs(runs: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """(PACKED) the runs of each group added up, a group's rows one after another."""
    names = [c for c in by if c != "bucket"]

    def run(batches):
        own, parts, size = None, [], 0

        def flush():
            keys, counts = merge_runs(parts)
            counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([pack(keys)], pa.binary()), pa.array([pack(counts.ravel())], pa.binary()), pa.array([int((counts > 0).sum())], pa.int64())], names=["bucket", "n", "keys", "counts", "n_lessons"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", *names, "n", "keys", "counts")), strict=True):
                if own != row[: 1 + len(names)]:
                    if own is not None:
                        yield from flush()
                    own, parts, size = row[: 1 + len(names)], [], 0
                n, keys, counts = row[-3:]
                parts.append((unpack(keys, n, np.uint64), unpack(counts, 2 * n, np.uint32).reshape(2, n).astype(np.int64)))
                size += n
                if size > 1 << 22:
                    parts = [merge_runs(parts)]
                    size = len(parts[0][0])
        if own is not None:
            yield from flush()

    return runs.repartition(tasks, *by).sortWithinPartitions(*by).select("bucket", *names, "n", "keys", "counts").mapInArrow(run, PACKED)


def _unpacked(batches):
    """(bucket, keys, counts) of PACKED rows."""
    for b in batches:
        for bucket, n, keys, counts in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "keys", "counts")), strict=True):
            yield bucket, unpack(keys, n, np.uint64), unpack(counts, 2 * n, np.uint32).reshape(2, n).astype(np.int64)


def low_counts(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of runs cut to contexts of two bytes, as Low.of takes them; counts are (2, n), in the texts of either part."""

    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros((2, 0))
        for _, k, c in _unpacked(batches):
            near = (k >> np.uint64(8 * (REACH - LOW + 1)) << np.uint64(8)) | (k & np.uint64(255))
            ids, where = np.unique(np.concatenate([keys, near.astype(np.int64)]), return_inverse=True)
            both = np.concatenate([counts, c.astype(np.float64)], axis=1)
            keys, counts = ids, np.stack([np.bincount(where, weights=x, minlength=len(ids)) for x in both])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts[0]), pa.array(counts[1])], names=["key", "first", "second"])

    # At most 2^24 keys, whatever the corpus.
    got = known.mapInArrow(run, "key long, first double, second double").groupBy("key").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).where("first + second > 0").toArrow()
    return np.asarray(got.column("key"), dtype=np.int64), np.stack([np.asarray(got.column(c), dtype=np.float64) for c in ("first", "second")])


def learn_weights(known: DataFrame, keys: np.ndarray, counts: np.ndarray) -> Mixer:
    """Weights and map learned from the runs of all training texts, those of each part over the counts of the other: a learner has some buckets, and learners are averaged by use."""
    spark = known.sparkSession
    start = Mixer.fresh()
    n_runs = known.agg(F.sum("n_lessons")).first()[0] or 0
    if not n_runs:
        return start
    shared = spark.sparkContext.broadcast([Low.of(keys, c) for c in counts])

    def study(batches):
        mixer, used, held, size = start.with_weights(start.weights()), start.with_weights(np.zeros_like(start.weights())), [], 0

        def flush():
            parts = [h[0] for h in held]
            inputs = np.concatenate([p[0] for p in parts], axis=1), [np.concatenate([p[1][g] for p in parts], axis=1) for g in range(3)], np.concatenate([p[2] for p in parts], axis=1)
            mixer.study(inputs, np.concatenate([h[1] for h in held]), used)

        for _, keys, counts in _unpacked(batches):
            for at in pieces(keys):
                for part in range(2):
                    taught = np.flatnonzero(counts[part, at])
                    if len(taught):
                        x, gates, ones = inputs_of(keys[at], counts[1 - part, at], shared.value[1 - part], taught)
                        held.append(((x, [g.astype(np.int32) for g in gates], ones.astype(np.uint8)), counts[part, at][taught]))
                        size += len(taught)
                        if size > LEARNER_RUNS:
                            flush()
                            held, size = [], 0
        if held:
            flush()
        flat, times = mixer.weights(), used.weights()
        for k, s in enumerate(range(0, len(flat) if times.any() else 0, WEIGHT_BLOCK)):
            w, n = flat[s : s + WEIGHT_BLOCK], times[s : s + WEIGHT_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([n.astype("<f4").tobytes()], pa.binary())], names=["block", "learner", "w", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, w, n in zip(*(b.column(c).to_pylist() for c in ("block", "w", "n")), strict=True):
                n = np.frombuffer(n, "<f4").astype(np.float64)
                sums[k] = sums.get(k, 0) + np.stack([np.frombuffer(w, "<f4") * n, n])
        for k, t in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([t[0].tobytes()], pa.binary()), pa.array([t[1].tobytes()], pa.binary())], names=["block", "w", "n"])

    learners = min(BUCKETS, -(-n_runs // (LEARNER_TURNS * LEARNER_RUNS)))
    dealt = known.select("bucket", "n", "keys", "counts").repartition(learners, "bucket").sortWithinPartitions("bucket")
    learned = dealt.mapInArrow(study, "block int, learner int, w binary, n binary").repartition("block").sortWithinPartitions("block", "learner")
    flat = start.weights().astype(np.float64)
    for r in learned.mapInArrow(add, "block int, w binary, n binary").collect():  # of fixed size
        w, n = np.frombuffer(bytes(r["w"])), np.frombuffer(bytes(r["n"]))
        part = flat[r["block"] * WEIGHT_BLOCK :][: len(w)]
        part[n > 0] = w[n > 0] / n[n > 0]
    shared.destroy()
    return start.with_weights(flat)


def rate_runs(known: DataFrame, low: Low, mixer: Mixer) -> DataFrame:
    """(bucket, n, keys, bits): the probability of every run."""
    shared = known.sparkSession.sparkContext.broadcast((low, mixer))

    def run(batches):
        for bucket, keys, counts in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([pack(keys)], pa.binary()), pa.array([pack(run_bits(keys, counts.sum(axis=0), *shared.value))], pa.binary())], names=["bucket", "n", "keys", "bits"])

    return known.select("bucket", "n", "keys", "counts").mapInArrow(run, "bucket int, n int, keys binary, bits binary")


def answer(rated: DataFrame, runs: DataFrame, groups: int, tasks: int) -> DataFrame:
    """(block, n, keys, bits): what each block asked of each bucket. A bucket's table goes to every group of blocks that ask it."""
    tables = rated.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(None).cast("long").alias("block"), "n", "keys", "bits")
    asked = runs.select("bucket", "group", "block", "n", "keys", F.lit(None).cast("binary").alias("bits"))
    both = tables.unionByName(asked).repartition(tasks, "bucket", "group").sortWithinPartitions("bucket", "group", F.col("block").asc_nulls_first())

    def run(batches):
        table, bits = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        for b in batches:
            found = []
            for block, n, keys, own in zip(*(b.column(c).to_pylist() for c in ("block", "n", "keys", "bits")), strict=True):
                if own is not None:
                    table, bits = unpack(keys, n, np.uint64), unpack(own, n, np.uint16)
                else:
                    found.append((block, n, keys, pack(bits[np.searchsorted(table, unpack(keys, n, np.uint64))])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "keys", "bits"])

    return both.select("block", "n", "keys", "bits").mapInArrow(run, "block long, n int, keys binary, bits binary")


SUMS = "row long, doc_id long, held_out boolean, n_tokens long, known long, head double, bits double, n_bytes long, rare array<binary>"
_SUMS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("head", pa.float64()), ("bits", pa.float64()), ("n_bytes", pa.int64()), ("rare", pa.list_(pa.binary()))])


def sum_texts(texts: DataFrame, answers: DataFrame, head: dict[bytes, float], blocks: int) -> DataFrame:
    """(SUMS) of every text: its block's answers come first, then its texts. rare holds the tokens that are not in the head, each as often as it occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(head)
    blank = F.lit(None).cast("binary")
    own = texts.select("block", F.lit(1).alias("kind"), F.lit(0).alias("n"), blank.alias("keys"), blank.alias("bits"), "texts")
    got = answers.select("block", F.lit(0).alias("kind"), "n", "keys", "bits", blank.alias("texts"))
    both = got.unionByName(own).repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def scored(b: pa.RecordBatch, found: tuple[np.ndarray, np.ndarray], number: int) -> pa.RecordBatch:
        folded = [fold(x.as_py()) for x in b.column("text")]
        total = []
        for group in groups_of(folded):
            total += sums_of(run_keys(group), np.array([len(t) + 1 for t in group]), *found).tolist()
        tokens, starts = tokens_of(b.column("text"))
        words = tokens.dictionary_encode()
        logs = shared.value
        value = np.array([logs.get(w, np.nan) for w in words.dictionary.to_pylist()], np.float64)[np.asarray(words.indices)]
        rare = np.isnan(value)
        sums = np.add.reduceat(np.where(rare, 0.0, value), starts[:-1])
        n_rare = np.add.reduceat(rare.astype(np.int64), starts[:-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), tokens.filter(pa.array(rare)).cast(pa.binary()))
        n = np.diff(starts)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(n))), b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(n - n_rare), pa.array(sums), pa.array(-np.array(total) / STEPS_PER_BIT), pa.array([len(t) + 1 for t in folded], pa.int64()), lists], schema=_SUMS)

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        current, parts, found = None, [], None
        for b in batches:
            for block, n, keys, bits, packed in zip(*(b.column(c).to_pylist() for c in ("block", "n", "keys", "bits", "texts")), strict=True):
                if block != current:
                    current, parts, found = block, [], None
                if packed is None:
                    parts.append((unpack(keys, n, np.uint64), unpack(bits, n, np.uint16)))
                    continue
                if found is None:
                    table, values = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
                    order = np.argsort(table)
                    found, parts = (table[order], values[order]), []
                rows = unpack_rows(packed)
                yield scored(rows, found, number)
                number += len(rows)

    return both.mapInArrow(run, SUMS)


def score_documents(docs: DataFrame, held_out: int = 1, fold_of=remainder) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of(F.col("doc_id")) == held_out).alias("held_out"))
    counts = staged(token_counts(own.where(~F.col("held_out"))), "lm-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    top = counts.where(F.length("token") <= HEAD_BYTES).orderBy(F.desc("n"), "token").limit(HEAD).toArrow()
    head = {t: math.log10(n + 0.5) for t, n in zip(top.column("token").to_pylist(), top.column("n").to_pylist(), strict=True)}
    read = staged(read_texts(own.withColumn("second", F.pmod(F.xxhash64("doc_id", "text", F.lit("tune")), F.lit(LEARN_FROM)) == 0)), "lm-read")
    texts = read.where(F.col("kind") == TEXTS).select("block", "texts")
    blocks = max(1, texts.select("block").distinct().count())
    groups = -(-blocks // GROUP)
    tasks = max(8, min(BUCKETS * groups, 2 * blocks))
    runs = read.where(F.col("kind") == RUNS).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    with batches_of(spark, TABLE_ROWS):
        each = add_runs(runs, ["bucket", "group"], tasks)
        known = staged(each if groups == 1 else add_runs(each, ["bucket"], min(tasks, BUCKETS)), "lm-known")
        low = low_counts(known)
        mixer = learn_weights(known, *low)
        rated = staged(rate_runs(known, Low.of(low[0], low[1].sum(axis=0)), mixer), "lm-rated")
        done(known)
        sums = staged(sum_texts(texts, answer(rated, runs, groups, tasks), head, blocks), "lm-sums")
    done(read, rated)
    rare = sums.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    added = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail"), F.count("n").alias("tail_known"))
    below = math.log10(total + 0.5 * (distinct + 1))
    return sums.drop("rare").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("bits") * F.lit(math.log10(2.0))).alias("score"), (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
