"""Language-model scoring by online logistic context mixing.

Bytes (A-Z lower-cased, UTF-8, then one end byte) are predicted bit by bit. Bit predictors are held by
context: the last two, four and six bytes, and the word so far. The logits that they give a bit are
mixed with weights by the bit's place in its byte, and a gate that knows how often the word so far was seen opens
or shuts each predictor. A second step rescales the mix. Weights and scales start alike for every text and are
refined on it as its bytes become known, block by block, so a score depends on the text and the training counts alone. The sum of
-log2 of the bits' probabilities gives the bits of the text.

What is counted over all training texts:

* Contexts of bytes, by 20 bits of the hash of the context and, for the second half of a byte, its first half: three
  tables whose size does not depend on the input (50 MB together), broadcast.
* Words, and from them every beginning of a word (up to ``DEPTH`` bytes) with the bytes that follow it, by
  64 bits of their hash. This table grows with the input and is never broadcast or collected: a batch of documents
  asks for each of its different word beginnings once and gets their counts by a join. The words' counts,
  of which the base score is made, come with it. A beginning that was seen once predicts nothing.

A batch is some ``BATCH_MB`` of text; a document is never split.

Defined results: null and empty texts hold only the end; without training texts, N and V are 0 and every
base term is log10(0.5 / 0.5); repeated rows give repeated results; null ids stay null; extra columns are
not read. A very long text is scored whole, by itself if it is longer than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches_of, crc_mod, cut, table

END = 0xFF
ORDERS = (2, 4, 6)
#: log2 of the slots of a table of byte contexts; a slot holds the 15 nodes of half a byte.
SLOT_BITS = 20
#: The longest beginning of a word that is a context.
DEPTH = 20
#: Predictors: one an order, and the word so far.
CONTEXTS = len(ORDERS) + 1
#: Gate of a byte: the word so far is new to the model, was seen less than COMMON times, or more.
GATES, COMMON = 3, 24
#: Weights at the start of a text, by predictor, and the share of them that each gate lets through.
START_WEIGHTS = np.array([0.25, 0.41, 0.27, 0.25], dtype=np.float32)
GATE = np.array([[2.4, 1.2, 0.3, 0.0], [1.5, 0.9, 0.6, 1.9], [0.8, 1.0, 1.15, 0.8]], dtype=np.float32)
#: Bytes between two updates of a text's weights.
BLOCK = 64
RATE, SCALE_RATE = 0.005, 0.004
#: Added to the counts of both bits; a node of n counts keeps n / (n + TRUST) of its logit.
DELTA, TRUST = 0.1, 0.5
#: Of the 8-bit logits, a unit.
LEVELS = 15.0
#: Steps of an 8-bit count, a doubling.
STEPS = 8
BATCH_MB = 16
#: Bytes that are held in arrays at once.
CHUNK = 1 << 20
#: Bytes of words, or rows of logits, that are worked on at once, and bytes whose contexts are looked up at once.
SLICE, STRETCH = 1 << 17, 1 << 16
#: Text of a task that counts, text of which it holds the words before it passes them on, and words of a task that counts their beginnings.
TASK_MB, HELD_BYTES, TASK_WORDS = 128, 8 << 20, 400_000
#: Answers that a task packs at once.
HELD_ROWS = 1 << 19
#: Bytes of a batch that a counting task is handed.
ARROW_BYTES = 4 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32, END]] = True
_U = np.arange(16, dtype=np.uint64)
_LEAD = np.array([8 - x.bit_length() for x in range(256)], dtype=np.int64)
_POWER = np.multiply.accumulate(np.full(DEPTH + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _lowered(column: pa.Array) -> Iterator[bytes]:
    """``text_bytes`` of an Arrow column, one at a time and without strings between."""
    for x in column:
        yield x.as_buffer().to_pybytes().lower() if x.is_valid else b""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The key of the empty beginning.
_EMPTY = _mix(np.zeros(1, dtype=np.uint64))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text with its end byte, and the length of each with it."""
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), dtype=np.uint8)
    return data, np.array([len(t) + 1 for t in texts], dtype=np.int64)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``_joined``, but each text has as many end bytes as fill its last block; the length counts one."""
    data = np.frombuffer(b"".join(t + b"\xff" * (BLOCK - len(t) % BLOCK) for t in texts), dtype=np.uint8)
    return data, np.array([len(t) + 1 for t in texts], dtype=np.int64)


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


# Contexts of bytes: tables of one size


def byte_slots(data: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order, the slots of the first and of the second half of each byte; nothing is before a text."""
    begins = np.cumsum(n) - n
    half = ((data >> 4).astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    h = np.zeros(len(data), dtype=np.uint32)
    last = data.astype(np.uint32) + np.uint32(1)
    shift = np.uint32(32 - SLOT_BITS)
    for order in range(1, max(ORDERS) + 1):
        last = np.concatenate([np.zeros(1, dtype=np.uint32), last[:-1]])
        last[begins] = 0
        h = (h + last) * np.uint32(0x9E3779B1)
        if order in ORDERS:
            own = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            yield (own >> shift).astype(np.int32), ((own ^ half) * np.uint32(0x9E3779B1) >> shift).astype(np.int32)


def stretches(data: np.ndarray, n: np.ndarray) -> Iterator[tuple[slice, list[tuple[np.ndarray, np.ndarray]]]]:
    """``byte_slots`` of all orders, for as many bytes at once as a core's cache holds."""
    begins = np.cumsum(n) - n
    for at in range(0, len(data), STRETCH):
        lo, hi = max(0, at - max(ORDERS)), min(len(data), at + STRETCH)  # contexts reach back
        inside = begins[np.searchsorted(begins, lo, side="right") : np.searchsorted(begins, hi)]
        slots = byte_slots(data[lo:hi], np.diff(np.concatenate([[lo], inside, [hi]])))
        yield slice(at, hi), [(first[at - lo :], second[at - lo :]) for first, second in slots]


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, part, counts) of a task's texts: by order and part of 4,096 slots, how often each half byte followed; kind -1 has the bytes."""
    counts = [np.zeros(16 << SLOT_BITS, dtype=np.int32) for _ in ORDERS]
    alone = np.zeros(256, dtype=np.int64)
    one = np.int32(1)
    for batch in batches:
        for own in _chunks(_lowered(batch.column(0))):
            data, n = _joined(own)
            alone += np.bincount(data, minlength=256)
            for some, slots in stretches(data, n):
                high, low = data[some] >> 4, data[some] & 15
                for c, (first, second) in zip(counts, slots, strict=True):
                    np.add.at(c, first * 16 + high, one)
                    np.add.at(c, second * 16 + low, one)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    yield _packed([-1], [0], [squeeze(alone.tobytes())])
    for kind, c in enumerate(counts):
        parts = c.reshape(-1, 1 << 16)
        some = np.flatnonzero(parts.any(axis=1))
        yield _packed([kind] * len(some), some.tolist(), [squeeze(parts[i].tobytes()) for i in some])


def _packed(kind: list[int], part: list[int], value: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, type=pa.int32()), pa.array(part, type=pa.int32()), pa.array(value, type=pa.binary())], names=["kind", "part", "value"])


def node_logits(counts: np.ndarray) -> np.ndarray:
    """(slots, 16) 8-bit logits of the nodes (node 1 is the first bit) from the counts of the half bytes that follow."""
    out = np.zeros((len(counts), 16))
    level = counts.astype(np.float64)
    for width in (8, 4, 2, 1):
        level = level.reshape(len(counts), width, 2)
        out[:, width : 2 * width] = _logit(level[:, :, 1], level[:, :, 0])
        level = level.sum(axis=2)
    return _rounded(out)


def _logit(right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    n = right + wrong
    return np.log((right + DELTA) / (wrong + DELTA)) * (n / (n + TRUST))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * LEVELS), -127, 127).astype(np.int8)


def _sum_parts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The logits of one part, from the counts of all tasks; the bytes' counts as they are."""
    kind, part = (x.as_py() for x in key)
    total = np.zeros(256 if kind < 0 else 1 << 16, dtype=np.int64)
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for value in batch.column("value").to_pylist():
            total += np.frombuffer(expand(value), dtype=np.int64 if kind < 0 else np.int32)
    yield _packed([kind], [part], [total.tobytes() if kind < 0 else node_logits(total.reshape(-1, 16)).tobytes()])


class ByteTables:
    """The logits of all slots by order, and the shares of the bytes that end words."""

    def __init__(self, nodes: list[np.ndarray], ends_as: np.ndarray):
        self.nodes, self.ends_as = nodes, ends_as

    def logits(self, data: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """By order, the logits (8, bytes) towards the bits of each byte of texts of ``n`` bytes.

        The 16 nodes of a slot are read at once, as two numbers of eight bytes, of which each bit's node is shifted out.
        """
        out = [np.empty((8, len(data)), dtype=np.int8) for _ in self.nodes]
        for some, slots in stretches(data, n):
            byte = data[some].astype(np.uint64)
            zero = [((data[some] >> np.uint8(7 - j)) & np.uint8(1)).view(np.int8) - np.int8(1) for j in range(8)]  # -1 where the bit is 0
            for h, v in enumerate((byte >> _U[4], byte & _U[15])):
                # The nodes are 1, then 2 and 3, 4 to 7, and 8 to 15, which are 0 to 7 of the second number.
                shifts = [(v >> _U[3] | _U[2]) << _U[3], (v >> _U[2] | _U[4]) << _U[3], v >> _U[1] << _U[3]]
                for nodes, slot, planes in zip(self.nodes, slots, out, strict=True):
                    both = nodes.view(np.complex128).take(slot[h]).view(np.uint64)
                    low = both[::2].copy()
                    for j, x in enumerate((low >> _U[8], low >> shifts[0], low >> shifts[1], both[1::2] >> shifts[2]), 4 * h):
                        logit = x.astype(np.int8)
                        logit ^= zero[j]
                        np.subtract(logit, zero[j], out=planes[j, some])
        return out


def byte_tables(texts: DataFrame) -> ByteTables:
    """Counted over all texts; of one size, whatever the input."""
    schema = "kind int, part int, value binary"
    out = [np.zeros(16 << SLOT_BITS, dtype=np.int8) for _ in ORDERS]
    alone = np.zeros(256)
    for x in texts.mapInArrow(_count_bytes, schema).groupBy("kind", "part").applyInArrow(_sum_parts, schema).collect():
        if x.kind < 0:
            alone = np.where(_WHITE, np.frombuffer(x.value, dtype=np.int64), 0)
        else:
            out[x.kind][x.part << 16 : (x.part + 1) << 16] = np.frombuffer(x.value, dtype=np.int8)
    return ByteTables(out, alone / max(1.0, alone.sum()))


# Words and their beginnings: a table that grows with the input


def _words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and how many each text has."""
    data, n = _joined(texts)
    letter = ~_WHITE[data]
    start = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    stop = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1  # the last byte ends a text
    offsets = np.concatenate([[0], np.cumsum(stop - start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
    return words, np.diff(np.searchsorted(start, np.append(0, np.cumsum(n))))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(texts: list[bytes]) -> pa.RecordBatch:
        found = _words_of(texts)[0].value_counts()
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

    held, size = [], 0
    for batch in batches:
        for t in _lowered(batch.column(0)):
            held.append(t)
            size += len(t) + 1
            if size >= HELD_BYTES:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _long_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, 1)


class Words:
    """Bytes and beginnings of a list of words."""

    def __init__(self, words: list[bytes] | pa.Array):
        words = pa.array(words, type=pa.large_binary()) if isinstance(words, list) else words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1] or bytes(8), dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        self.data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.n = np.diff(offsets)
        self.start = np.cumsum(self.n) - self.n
        self.at = np.arange(len(self.data), dtype=np.int32)  # the place of each byte in its word
        self.at -= np.repeat(self.start.astype(np.int32), self.n)
        self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        for lo in range(0, len(self.data), SLICE):
            at = self.at[lo : lo + SLICE]
            code = (self.data[lo : lo + SLICE].astype(np.uint64) + np.uint64(1)) * _POWER[np.minimum(at, DEPTH)]
            code[at >= DEPTH] = 0
            np.add(np.cumsum(code, dtype=np.uint64), self.sums[lo], out=self.sums[lo + 1 : lo + 1 + len(at)])

    def before(self, i: np.ndarray) -> np.ndarray:
        """Hashes of the word's bytes before each byte ``i``, at most DEPTH places into it."""
        d = self.at[i]
        return _mix(self.sums[i] - self.sums[i - d] + d.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def whole(self, w: np.ndarray) -> np.ndarray:
        """Hashes of the words ``w``, of at most DEPTH bytes, as beginnings."""
        return _mix(self.sums[self.start[w] + self.n[w]] - self.sums[self.start[w]] + self.n[w].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_keys(words: list[bytes] | pa.Array, own: Words) -> np.ndarray:
    """The key of each word: its hash as a beginning, or one of the whole word if it is longer than DEPTH."""
    keys = np.zeros(len(words), dtype=np.uint64)
    short = own.n <= DEPTH
    keys[short] = own.whole(np.flatnonzero(short))
    for i in np.flatnonzero(~short):
        keys[i] = _long_hash(words[i] if isinstance(words, list) else words[i].as_py())
    return keys


def _code(n: np.ndarray) -> np.ndarray:
    """8-bit logarithm of a count."""
    return np.minimum(np.rint(STEPS * np.log2(n)), 255).astype(np.uint8)


def _beginnings(words: list[bytes] | pa.Array, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each depth: (key, ends, first, symbol, count) of different sorted ``words``, counted ``n`` times.

    key and ends (how often a word ends there) by beginning, first where its followers start in symbol and count.
    """
    own = Words(words)
    for d in range(DEPTH + 1):
        w = np.flatnonzero(own.n >= d)
        if not len(w):
            return
        more = own.n[w] > d
        key = np.zeros(len(w), dtype=np.uint64)
        key[more] = own.before(own.start[w[more]] + d)
        key[~more] = own.whole(w[~more])
        symbol = np.full(len(w), -1, dtype=np.int64)
        symbol[more] = own.data[own.start[w[more]] + d]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (symbol[1:] != symbol[:-1])
        at = np.flatnonzero(new)
        count, key, symbol = np.add.reduceat(n[w], at), key[at], symbol[at]
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(head)
        ends = np.where(symbol[begins] < 0, count[begins], 0)  # the word that ends comes first
        follows = symbol >= 0
        first = np.concatenate([[0], np.cumsum(follows)])[begins]
        yield key[begins], ends, first, symbol[follows], count[follows]


def _beginning_rows(edges: bool):
    """A task of sorted words gives (h, ends, next): ``next`` holds the symbols that follow and their counts.

    Other tasks can have the beginnings of the first and the last word too: those come with exact counts if
    ``edges``, and the others, with 8-bit ones, if not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        words = pa.concat_arrays([b.column(0).cast(pa.large_binary()) for b in held])
        counts = np.concatenate([b.column(1).to_numpy() for b in held])
        ends_of = Words([words[i].as_py()[: DEPTH + 1] for i in (0, len(words) - 1)])
        open_keys = np.concatenate([ends_of.before(np.flatnonzero(ends_of.at <= DEPTH)), ends_of.whole(np.flatnonzero(ends_of.n <= DEPTH))])
        for key, ends, first, symbol, count in _beginnings(words, counts):
            open_ = np.isin(key, open_keys)
            size = np.diff(np.append(first, len(symbol)))
            seen = np.bincount(np.repeat(np.arange(len(size)), size), count, len(size))
            chosen = open_ if edges else ~open_ & ((seen > 1) | (ends > 0))
            pick = np.flatnonzero(chosen)
            if edges:
                value = [np.stack([symbol[first[i] : first[i] + size[i]], count[first[i] : first[i] + size[i]]]).astype(np.int64).tobytes() for i in pick]
                packed = pa.array(value, type=pa.binary())
            else:
                keep = np.repeat(chosen, size)
                pairs = np.stack([symbol[keep].astype(np.uint8), _code(count[keep])], axis=1)
                offsets = np.concatenate([[0], np.cumsum(2 * size[pick])]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array(ends[pick].astype(np.int64)), packed], names=["h", "ends", "next"])
        if not edges:
            long = np.flatnonzero(pc.binary_length(words).to_numpy() > DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_long_hash(words[i].as_py()) for i in long], dtype=np.uint64).view(np.int64)), pa.array(counts[long].astype(np.int64)), pa.array([b""] * len(long), type=pa.binary())], names=["h", "ends", "next"])

    return run


def _merge_edges(group: pa.Table) -> pa.Table:
    """One beginning whose followers were counted in several tasks."""
    total = np.zeros(256, dtype=np.int64)
    for value in group.column("next").to_pylist():
        symbol, count = np.frombuffer(value, dtype=np.int64).reshape(2, -1)
        np.add.at(total, symbol, count)
    symbol = np.flatnonzero(total)
    pairs = np.stack([symbol.astype(np.uint8), _code(total[symbol])], axis=1) if len(symbol) else np.zeros((0, 2), dtype=np.uint8)
    ends = sum(group.column("ends").to_pylist())
    out = pa.table({"h": group.column("h").slice(0, 1), "ends": pa.array([ends], type=pa.int64()), "next": pa.array([pairs.tobytes()], type=pa.binary())})
    return out if ends or total.sum() > 1 else out.slice(0, 0)


def word_beginnings(counts: DataFrame, n_words: int) -> DataFrame:
    """(h, ends, next) of every beginning of a word of ``counts`` (word, n): sorted words, so that most are whole in a task."""
    schema = "h long, ends long, next binary"
    dealt = counts.repartitionByRange(max(1, -(-n_words // TASK_WORDS)), "word").sortWithinPartitions("word")
    edges = dealt.mapInArrow(_beginning_rows(True), schema).groupBy("h").applyInArrow(_merge_edges, schema)
    return dealt.mapInArrow(_beginning_rows(False), schema).unionByName(edges)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, rows): the answers (batch, h, ends, next) of a task, some ``HELD_ROWS`` at a time, a value a batch of texts."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        batch, h = rows.column("batch").to_numpy(), rows.column("h").to_numpy()
        order = np.lexsort((h, batch))
        batch, h, ends = batch[order], h[order], rows.column("ends").to_numpy()[order]
        nexts = rows.column("next").combine_chunks().take(pa.array(order))
        at = np.frombuffer(nexts.buffers()[1], dtype=np.int32, count=len(nexts) + 1)
        pairs = np.frombuffer(nexts.buffers()[2] or b"", dtype=np.uint8)
        begin = np.flatnonzero(np.append(True, batch[1:] != batch[:-1]))
        out = []
        for lo, hi in zip(begin, np.append(begin[1:], len(batch)), strict=True):
            # Sorted, the first bytes of the differences are alike: numbers lie byte by byte.
            steps = np.diff(h[lo:hi].view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
            counts = ends[lo:hi].view(np.uint8).reshape(-1, 8).T
            sizes = np.diff(at[lo : hi + 1]).astype(np.uint16)
            out.append(squeeze(b"".join([np.int64(hi - lo).tobytes(), steps.tobytes(), counts.tobytes(), sizes.tobytes(), pairs[at[lo] : at[hi]].tobytes()])))
        return pa.RecordBatch.from_arrays([pa.array(batch[begin]), pa.array(out, type=pa.binary())], names=["batch", "rows"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= HELD_ROWS:
            yield flush()
            size = 0
    if held:
        yield flush()


def _unpack(values: Iterable[bytes]) -> pa.Table:
    """The rows (h, ends, next) of values of ``_pack``."""
    expand = zstandard.ZstdDecompressor().decompress
    empty = {"h": pa.array([], type=pa.int64()), "ends": pa.array([], type=pa.int64()), "next": pa.array([], type=pa.binary())}
    parts = [pa.table(empty)]
    for value in values:
        data = expand(value)
        n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
        numbers = np.frombuffer(data, dtype=np.uint8, count=16 * n, offset=8).reshape(2, 8, n)
        steps, ends = (np.ascontiguousarray(x.T).reshape(-1) for x in numbers)
        sizes = np.frombuffer(data, dtype=np.uint16, count=n, offset=8 + 16 * n)
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        nexts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[8 + 18 * n :])])
        h = np.cumsum(steps.view(np.uint64), dtype=np.uint64).view(np.int64)
        parts.append(pa.table({"h": pa.array(h), "ends": pa.array(ends.view(np.int64)), "next": nexts}))
    return pa.concat_tables(parts)


class Known:
    """The rows (h, ends, next) that a batch got, in order of h."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        h = rows.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.ends = h[order], rows.column("ends").to_numpy()[order]
        chunk = rows.column("next").chunk(0) if len(rows) else pa.array([], type=pa.binary())
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(h) + 1] if len(h) else np.zeros(1, dtype=np.int32)
        self.pairs = np.frombuffer(chunk.buffers()[2], dtype=np.uint8) if len(h) and chunk.buffers()[2] else np.zeros(0, dtype=np.uint8)
        self.first, self.size = offsets[:-1][order].astype(np.int64), (np.diff(offsets)[order] // 2).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for none."""
        if not len(self.h):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.h, keys), len(self.h) - 1)
        return np.where(self.h[at] == keys, at, -1)


def edge_logits(known: Known, row: np.ndarray, byte: np.ndarray, ends_as: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit logits (n, 8) of the bits of ``byte`` after the beginnings ``row``, towards the bits, and the times seen.

    ``ends_as``: the shares of the bytes (white space, end) with which words end.
    """
    size = known.size[row]
    i = np.repeat(np.arange(len(row)), size)
    at = np.repeat(known.first[row] - 2 * (np.cumsum(size) - size), size) + 2 * np.arange(len(i))
    weight = np.exp2(known.pairs[at + 1] / STEPS)
    shared = np.bincount(i * 9 + _LEAD[known.pairs[at] ^ byte[i]], weight, 9 * len(row)).reshape(-1, 9)
    ends, begin = known.ends[row], 9 * np.arange(len(row))
    for symbol in np.flatnonzero(ends_as):
        shared.reshape(-1)[begin + _LEAD[byte ^ np.uint8(symbol)]] += ends * ends_as[symbol]
    agree = np.cumsum(shared[:, ::-1], axis=1)[:, ::-1]  # counts that share at least so many first bits
    return _rounded(_logit(agree[:, 1:], agree[:, :-1] - agree[:, 1:])), agree[:, 0]


# Mixing


def mix_bits(x: list[np.ndarray], gate: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of texts of ``n`` bytes, longest first; ``x``: of each predictor, the 8-bit logits (8, bytes) towards the bits that came.

    The bytes are those of ``_padded``.
    """
    first = np.cumsum(-(-n // BLOCK)) - -(-n // BLOCK)
    x = [v.reshape(8, -1, BLOCK) for v in x]
    gate = gate.reshape(-1, BLOCK)
    lanes = len(n)
    w = np.broadcast_to(START_WEIGHTS[:, None, None], (len(x), 8, lanes)).astype(np.float32)
    scale = np.ones((8, lanes), dtype=np.float32)
    cost = np.zeros(lanes)
    open_ = np.ascontiguousarray(GATE.T / np.float32(LEVELS))
    one, most = np.float32(1), np.float32(10)
    at = 0
    while at < n[0]:
        size = BLOCK if at < 32 * BLOCK else 4 * BLOCK if at < 128 * BLOCK else 16 * BLOCK
        on = int(np.searchsorted(-n, -at, side="left"))
        # Where a text ends in its block, what is beyond is of any bytes.
        place = np.minimum((first[:on] + at // BLOCK)[:, None] + np.arange(size // BLOCK), len(gate) - 1).reshape(-1)
        own = []  # by bit, text and byte
        g = gate.take(place, axis=0).astype(np.intp)
        for c, v in enumerate(x):
            own.append(np.multiply(v.take(place, axis=1), open_[c].take(g)).reshape(8, on, size))
        y = np.empty_like(own[0])
        part = np.empty_like(y)
        np.multiply(own[0], w[0, :, :on, None], out=y)
        for c in range(1, len(x)):
            np.multiply(own[c], w[c, :, :on, None], out=part)
            y += part
        q = np.multiply(y, -scale[:, :on, None], out=part)
        np.clip(q, -most, most, out=q)
        np.exp(q, out=q)
        d = q + one
        left = n[:on] - at
        live = (np.arange(size) < left[:, None]).astype(np.float32)
        cost[:on] += np.einsum("lb,lb->l", np.log(np.multiply.reduce(d, axis=0)), live, dtype=np.float64)
        q /= d  # the probability of the other bit
        ending = int(np.searchsorted(-left, -size, side="right"))
        q[:, ending:] *= live[ending:]
        slower = np.float32((BLOCK / size) ** 0.5)
        scale[:, :on] += np.float32(SCALE_RATE) * slower * np.einsum("jlb,jlb->jl", q, y)
        np.clip(scale, 0.5, 2.0, out=scale)
        for c, v in enumerate(own):
            w[c, :, :on] += np.float32(RATE) * slower * np.einsum("jlb,jlb->jl", q, v)
        at += size
    return cost / np.log(2.0)


def _different(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, sorted, so that those that begin alike are in one slice; the place there of each word of the texts; words by text."""
    words, n = _words_of(texts)
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), dtype=np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(order), place[coded.indices.to_numpy()], n


def asked(texts: list[bytes]) -> np.ndarray:
    """The keys of all words and beginnings of the texts, the empty one too."""
    listed = _words_of(texts)[0].unique()
    listed = listed.take(pc.array_sort_indices(listed))
    own = Words(listed)
    keys = [_EMPTY, word_keys(listed, own)]
    for lo in range(0, len(own.data), SLICE):
        at = own.at[lo : lo + SLICE]
        keys.append(pd.unique(own.before(lo + np.flatnonzero((at <= DEPTH) & (at > 0)))))
    return pd.unique(np.concatenate(keys))


def score_batch(texts: list[bytes], tables: ByteTables, known: Known) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bits of each text, how often each different word was seen in training, and the words of each text."""
    words, ids, n = _different(texts)
    tokens = np.split(ids, np.cumsum(n)[:-1])
    own, n_words = Words(words), len(words)
    # A row of logits for each byte of each different word, then for each different word and byte that ends it.
    found = known.find(word_keys(words, own))
    seen = np.where(found >= 0, known.ends[np.maximum(found, 0)], 0) if len(known.h) else np.zeros(n_words, dtype=np.int64)
    after = np.append(np.where(own.n <= DEPTH, found, -1), known.find(_EMPTY))  # the empty word is the last
    enders = np.array([i for i in np.flatnonzero(_WHITE) if i == END or any(bytes([i]) in t for t in texts)])
    logits = np.zeros((len(own.data) + (n_words + 1) * len(enders), 8), dtype=np.int8)
    gate = np.zeros(len(logits), dtype=np.int8)

    def fill(place: np.ndarray, row: np.ndarray, byte: np.ndarray) -> None:
        """The logits and gates at ``place``: of ``byte`` after the beginning ``row``, -1 for none."""
        i = np.flatnonzero(row >= 0)
        if not len(i):
            return
        back, edge = pd.factorize(row[i].astype(np.int64) * 256 + byte[i])
        made, times = edge_logits(known, edge >> 8, (edge & 255).astype(np.uint8), tables.ends_as)
        logits[place[i]] = (made * (times > 1.5)[:, None])[back]
        gate[place[i]] = np.where(times < 1.5, 0, np.where(times < COMMON, 1, 2))[back]

    for lo in range(0, len(own.data), SLICE):
        place = lo + np.flatnonzero(own.at[lo : lo + SLICE] <= DEPTH)
        back, different = pd.factorize(own.before(place))
        fill(place, known.find(different)[back], own.data[place])
    step = SLICE // len(enders)
    for lo in range(0, n_words + 1, step):
        some = after[lo : lo + step]
        place = len(own.data) + lo * len(enders) + np.arange(len(some) * len(enders))
        fill(place, np.repeat(some, len(enders)), np.tile(enders, len(some)))
    letters_end = len(own.data)
    start = own.start
    del own, known, found, after
    ender = np.zeros(256, dtype=np.int64)
    ender[enders] = np.arange(len(enders))
    parts = []
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        size, upto = 0, at
        while upto < len(order) and (size == 0 or size + len(texts[order[upto]]) < CHUNK):
            size += len(texts[order[upto]]) + 1
            upto += 1
        parts.append(order[at:upto])
        at = upto

    def places(some: list[int], data: np.ndarray) -> np.ndarray:
        """The row of each byte."""
        run_word = np.concatenate([tokens[i] for i in some]) if some else np.zeros(0, dtype=np.int32)
        white = _WHITE[data]
        begin = ~white
        begin[1:] &= white[:-1]
        run = np.cumsum(begin) - 1
        first = np.flatnonzero(begin)
        out = np.empty(len(data), dtype=np.int64)
        letters = np.flatnonzero(~white)
        out[letters] = start[run_word[run[letters]]] + letters - first[run[letters]]
        ends = np.flatnonzero(white)
        after_word = np.zeros(len(ends), dtype=bool)
        after_word[ends > 0] = ~white[ends[ends > 0] - 1]
        word = np.full(len(ends), n_words)
        word[after_word] = run_word[run[ends[after_word]]]
        out[ends] = letters_end + word * len(enders) + ender[data[ends]]
        return out

    packed = logits.view(np.uint64).reshape(-1)
    bits = np.zeros(len(texts))
    for some in parts:
        data, n = _padded([texts[i] for i in some])
        place = places(some, data)
        word = np.ascontiguousarray(packed.take(place).view(np.int8).reshape(-1, 8).T)
        bits[some] = mix_bits([*tables.logits(data, -(-n // BLOCK) * BLOCK), word], gate.take(place), n)
    return bits, seen, tokens


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, lower-cased, for the shuffle."""
    c = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        text = pa.array([c.compress(t) for t in _lowered(batch.column(3))], type=pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], text], names=["batch", "id", "held_out", "text"])


def _texts(group: pa.Table) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in group.column("text").to_pylist()]


def _ask(group: pa.Table) -> pa.Table:
    keys = asked(_texts(group))
    return pa.table({"batch": pa.array(np.full(len(keys), group.column("batch")[0].as_py(), dtype=np.int32)), "h": pa.array(keys.view(np.int64))})


_RESULT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", batch_mb: float = BATCH_MB) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), held_out.alias("held_out"))
    training = rows.where("not held_out").select("text")
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("training"), F.sum(F.when(~F.col("held_out"), F.octet_length("text"))).alias("training_bytes")).first()
    n_batches = int(max(1, (sizes.bytes or 0) // (batch_mb * (1 << 20)) + 1))
    training = training.coalesce(int((sizes.training_bytes or 0) // (TASK_MB << 20) + 1))
    with arrow_batches_of(spark, ARROW_BYTES):
        counts = cut(training.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
        tables = byte_tables(training)
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = sizes.training or 0
    total, different = (sums.n or 0) + ends, sums.v + (ends > 0)
    shared = spark.sparkContext.broadcast(tables)

    # Rows without an id are told apart by where they stand, so that none of their batches is crowded.
    where = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    side = rows.select(F.pmod(F.xxhash64("id", "text", where), F.lit(n_batches)).cast("int").alias("batch"), "id", "held_out", "text").mapInArrow(_squeeze, "batch int, id long, held_out boolean, text binary")
    asked = side.groupBy("batch").applyInArrow(_ask, "batch int, h long")
    known = asked.join(word_beginnings(counts, sums.v), "h").select("batch", "h", "ends", "next").mapInArrow(_pack, "batch int, rows binary")
    log_total = float(np.log10(total + 0.5 * (different + 1)))
    log_end = float(np.log10(ends + 0.5)) - log_total

    def tell(group: pa.Table, known: pa.Table) -> pa.Table:
        texts = _texts(group)
        bits, seen, tokens = score_batch(texts, shared.value, Known(_unpack(x.as_py() for x in known.column("rows"))))
        log = np.log10(seen + 0.5) - log_total
        n = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        own = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(tokens)), n)
        base = np.bincount(doc, log[own], len(tokens)) + log_end
        n_known = np.bincount(doc, seen[own] > 0, len(tokens)).astype(np.int64) + (ends > 0)
        return pa.table({
            "id": group.column("id"), "held_out": group.column("held_out"), "n_tokens": n + 1, "n_known": n_known, "train_tokens": np.full(len(n), total, dtype=np.int64),
            "base_score": base, "score": -bits * np.log10(2.0), "bits_per_byte": bits / np.array([len(t) + 1 for t in texts]),
        })

    return side.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(tell, _RESULT).withColumnRenamed("id", key)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, crc_mod("doc_id", 5) == 1)
