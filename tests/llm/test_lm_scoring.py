"""Language-model scoring against a mixer in plain Python, and its odd rows."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.llm import lm_scoring as lm
from evalloom.llm.common import crc_mod


def beginnings(texts):
    """{word beginning: (ends, {next byte: count})} by brute force."""
    found = {}
    for t in texts:
        for w in t.split():
            for d in range(min(len(w), lm.DEPTH) + 1):
                ends, after = found.setdefault(w[:d], [0, collections.Counter()])
                if d == len(w):
                    found[w[:d]][0] += 1
                else:
                    after[w[d]] += 1
    return found


def local_model(texts):
    counts = []
    for _ in lm.ORDERS:
        counts.append(np.zeros(16 << lm.SLOT_BITS, dtype=np.int32))
    data, n = lm._joined(texts)
    for c, (first, second) in zip(counts, lm.byte_slots(data, n), strict=True):
        np.add.at(c, first * 16 + (data >> 4), 1)
        np.add.at(c, second * 16 + (data & 15), 1)
    words = collections.Counter(w for t in texts for w in t.split())
    rows = []
    for key, ends, first, symbol, count in lm._beginnings(sorted(words), np.array([words[w] for w in sorted(words)])):
        size = np.diff(np.append(first, len(symbol)))
        code = lm._code(count)
        rows += [(int(k.view(np.int64)), int(e), np.stack([symbol[f : f + s].astype(np.uint8), code[f : f + s]], axis=1).tobytes()) for k, e, f, s in zip(key, ends, first, size, strict=True)]
    known = lm.Known(pa.table({"h": pa.array([r[0] for r in rows], type=pa.int64()), "ends": pa.array([r[1] for r in rows], type=pa.int64()), "next": pa.array([r[2] for r in rows], type=pa.binary())}))
    shares = np.zeros(256)
    for x in (32, 10, lm.END):
        shares[x] = (data == x).sum()
    return lm.ByteTables([lm.node_logits(c.reshape(-1, 16)).reshape(-1) for c in counts], shares / shares.sum()), known, counts


def plain_bits(text, counts, training, shares):
    """One text, byte by byte and bit by bit, in Python floats; weights change after every block."""

    def logit(right, wrong):
        n = right + wrong
        x = math.log((right + lm.DELTA) / (wrong + lm.DELTA)) * (n / (n + lm.TRUST))
        return max(-127, min(127, round(x * lm.LEVELS)))

    found = beginnings(training)
    data = np.frombuffer(text + b"\xff", dtype=np.uint8)
    slots = list(lm.byte_slots(data, np.array([len(data)])))
    w = [[float(lm.START_WEIGHTS[c]) for c in range(lm.CONTEXTS)] for _ in range(8)]
    scale, cost = [1.0] * 8, 0.0
    assert len(data) <= 32 * lm.BLOCK
    for at in range(0, len(data), lm.BLOCK):
        changes, scales = collections.Counter(), collections.Counter()
        for i in range(at, min(at + lm.BLOCK, len(data))):
            byte = int(data[i])
            j = i
            while j > 0 and text[j - 1 : j] not in (b" ", b"\n"):
                j -= 1
            ends, after = found.get(text[j:i], (0, {})) if i - j <= lm.DEPTH else (0, {})
            next_ = collections.Counter({k: 2 ** (round(lm.STEPS * math.log2(v)) / lm.STEPS) for k, v in after.items()})
            for k in range(256):
                if shares[k]:
                    next_[k] += ends * shares[k]
            seen = sum(next_.values())
            known = seen > 1.5 and i - j <= lm.DEPTH
            g = 0 if not known else 1 if seen < lm.COMMON else 2
            for b in range(8):
                x = []
                for c, halves in zip(counts, slots, strict=True):
                    cells = c[int(halves[b // 4][i]) * 16 : int(halves[b // 4][i]) * 16 + 16]
                    nibble = byte >> 4 if b < 4 else byte & 15
                    k = 4 - b % 4
                    x.append(logit(int(sum(cells[v] for v in range(16) if v >> (k - 1) == nibble >> (k - 1))), int(sum(cells[v] for v in range(16) if v >> k == nibble >> k and v >> (k - 1) != nibble >> (k - 1)))))
                same = sum(v for k, v in next_.items() if k >> (8 - b) == byte >> (8 - b))
                right = sum(v for k, v in next_.items() if k >> (7 - b) == byte >> (7 - b))
                x.append(logit(right, same - right) if known else 0)
                x = [v * float(lm.GATE[g, c]) / lm.LEVELS for c, v in enumerate(x)]
                y = sum(u * v for u, v in zip(w[b], x, strict=True))
                p = 1 / (1 + math.exp(-max(-10, min(10, y * scale[b]))))
                cost -= math.log2(p)
                scales[b] += (1 - p) * y
                for c, v in enumerate(x):
                    changes[b, c] += (1 - p) * v
        for (b, c), v in changes.items():
            w[b][c] += lm.RATE * v
        scale = [min(2.0, max(0.5, scale[b] + lm.SCALE_RATE * scales[b])) for b in range(8)]
    return cost


def training(seed=1, n=40):
    rnd = random.Random(seed)
    words = ["the", "then", "there", "cat", "sat", "satin", "x" * 30, "x" * 20, "x" * 21]
    return [" ".join(rnd.choice(words) for _ in range(60)).encode() for _ in range(n)] + [b"onceonly thermos zz"]


def test_bits_equal_those_of_a_plain_mixer():
    texts = training()
    tables, known, counts = local_model(texts)
    new = [b"the cat sat there\nthen the thermos satin " * 4, b"", b"zebra " + b"x" * 40 + b"  the", b"cat"]
    got, _, _ = lm.score_batch(new, tables, known)
    assert got == pytest.approx([plain_bits(t, counts, texts, tables.ends_as) for t in new], rel=1e-3)
    alone = [lm.score_batch([t], tables, known)[0][0] for t in new]
    assert got == pytest.approx(alone, rel=1e-5)


def test_probabilities_sum_to_at_most_one():
    tables, known, _ = local_model(training())
    p = 2.0 ** -lm.score_batch([b"", *[bytes([x]) for x in range(255)]], tables, known)[0]
    assert 0 < p.sum() <= 1 + 1e-5


@pytest.mark.parametrize("task_words", [3, 1000])
def test_beginnings_are_those_of_all_words(spark, monkeypatch, task_words):
    """Counted in one task or in many, whose first and last words share beginnings; as many rows as there are beginnings."""
    monkeypatch.setattr(lm, "TASK_WORDS", task_words)
    texts = training(2)
    words = collections.Counter(w for t in texts for w in t.split())
    df = spark.createDataFrame([(bytearray(w), n) for w, n in words.items()], "word binary, n long")
    got = lm.word_beginnings(df, len(words)).collect()
    want = {w: x for w, x in beginnings(texts).items() if x[0] or sum(x[1].values()) > 1}
    long = {w: n for w, n in words.items() if len(w) > lm.DEPTH}
    assert len(got) == len({r.h for r in got}) == len(want) + len(long)
    key = lambda w: int(lm.word_keys([w], lm.Words([w]))[0].view(np.int64)) if w else int(lm._mix(np.zeros(1, dtype=np.uint64))[0].view(np.int64))
    by = {r.h: r for r in got}
    for w, (ends, after) in want.items():
        r = by[key(w)]
        pairs = np.frombuffer(r.next, dtype=np.uint8).reshape(-1, 2)
        assert r.ends == ends and dict(pairs.tolist()) == {k: int(lm._code(np.array([v]))[0]) for k, v in after.items()}
    assert all(by[key(w)].ends == n for w, n in long.items())


def test_odd_rows(spark):
    """Null and large ids, repeated rows, clashing columns, a long text, in one batch and in many."""
    big = 1152921504606846977
    rnd = random.Random(5)
    long = " ".join(f"w{rnd.randrange(900)}" for _ in range(60_000))
    rows = [(big, "the cat sat", "c"), (None, "the cat sat", "c"), (None, "the cat sat", None), (None, None, None), (big + 2, long, "c"), (7, "", "c"), (7, "", "c")] + [(i, f"the cat sat on w{i}", "c") for i in range(20, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string").withColumns({c: F.lit("x") for c in ("id", "h", "word", "held_out", "score", "next", "ends")})
    one, many = ([tuple(r) for r in lm.score(df, crc_mod("doc_id", 5) == 1, batch_mb=mb).collect()] for mb in (32, 0.05))
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted((r[0] for r in one), key=str) == sorted((r[0] for r in rows), key=str)
    for a, b in zip(sorted(one, key=order), sorted(many, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)
    by = collections.defaultdict(set)
    for r in one:
        by[r[0], r[2]].add(round(r[6], 6))
    assert len(by[None, 4]) == 1 and len(by[7, 1]) == 1


def test_learns(spark):
    """Texts like those of the training rows take fewer bits than others."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(100))) for i in range(60)] + [(100 + i, "".join(rnd.choice("qrstuvwxyz ") for _ in range(600))) for i in range(4)]
    got = {r.doc_id: r.bits_per_byte for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 50).collect()}
    assert max(v for k, v in got.items() if 50 <= k < 60) < 1.6 < min(v for k, v in got.items() if k >= 100)


@pytest.mark.parametrize("held", [1, 50, 10_000])
def test_answers_are_unpacked_as_they_were(monkeypatch, held):
    """Any 64-bit keys, ends and followers of any length, none too; each answer comes back once."""
    monkeypatch.setattr(lm, "HELD_ROWS", held)
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63 - 1, 300)
    h[:4] = [-(2**63), 2**63 - 1, 0, -1]
    batch, ends = rng.integers(0, 5, 300).astype(np.int32), rng.integers(0, 2**40, 300)
    nexts = [rng.bytes(2 * int(rng.integers(0, 257))) if i % 7 else b"" for i in range(300)]
    parts = [pa.RecordBatch.from_arrays([pa.array(batch[i : i + 60]), pa.array(h[i : i + 60]), pa.array(ends[i : i + 60]), pa.array(nexts[i : i + 60], type=pa.binary())], names=["batch", "h", "ends", "next"]) for i in range(0, 300, 60)]
    packed = [(b, v) for x in lm._pack(iter(parts)) for b, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    got = sorted((b, *row.values()) for b in range(5) for row in lm._unpack(v for k, v in packed if k == b).to_pylist())
    assert got == sorted(zip(batch.tolist(), h.tolist(), ends.tolist(), nexts, strict=True))
    assert lm._unpack([]).num_rows == 0
    assert not list(lm._pack(iter([])))


def test_contexts_of_stretches_are_those_of_the_whole(monkeypatch):
    """Contexts reach back over the border of a stretch, but not over the begin of a text."""
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"abc ") for _ in range(size)) for size in (0, 1, 40, 3, 0, 90, 7, 6)]
    data, n = lm._joined(texts)
    whole = list(lm.byte_slots(data, n))
    for size in (1, 5, 7, 64):
        monkeypatch.setattr(lm, "STRETCH", size)
        some, slots = zip(*lm.stretches(data, n), strict=True)
        assert [(s.start, s.stop) for s in some] == [(at, min(at + size, len(data))) for at in range(0, len(data), size)]
        for order, halves in enumerate(whole):
            for half, want in enumerate(halves):
                assert np.concatenate([s[order][half] for s in slots]).tolist() == want.tolist()


def test_mixing_of_long_and_short_texts_together(monkeypatch):
    """Texts of all sizes of blocks, in padded blocks and small stretches, give the bits that each gives alone."""
    tables, known, _ = local_model(training())
    rnd = random.Random(6)
    sizes = (0, 1, 62, 63, 64, 65, 127, 2047, 2048, 2500, 9000, 20000)
    new = [bytes(rnd.choice(b"the cat sat\n") for _ in range(size)) for size in sizes]
    got, _, _ = lm.score_batch(new, tables, known)
    alone = [lm.score_batch([t], tables, known)[0][0] for t in new]
    assert got == pytest.approx(alone, rel=1e-5)
    monkeypatch.setattr(lm, "STRETCH", 50)
    assert lm.score_batch(new, tables, known)[0] == pytest.approx(got, rel=1e-12)


def test_words_are_taken_from_a_slice_of_a_column():
    words = [b"", b"there", b"x" * 30, b"cat", b"satin"]
    own, want = lm.Words(pa.array(words, type=pa.binary())[1:4]), lm.Words(words[1:4])
    assert own.n.tolist() == want.n.tolist() and own.data.tobytes() == want.data.tobytes()
    assert lm.word_keys(pa.array(words, type=pa.binary())[1:4], own).tolist() == lm.word_keys(words[1:4], want).tolist()
    assert lm.Words([]).n.tolist() == lm.Words(pa.array([], type=pa.large_binary())).n.tolist() == []
