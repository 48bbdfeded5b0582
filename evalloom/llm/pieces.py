"""SentencePiece encoding and decoding through a table of distinct chunks.

In the models meant here no piece crosses from a letter to the white-space marker after it, so a text falls into chunks,
each a run of markers and the word behind it, that are segmented independently. Spark counts the distinct chunks of all
texts; the most frequent, at most ``known`` of them (a stated bound, as the table is sent to every task), are segmented
once. A batch of texts is then taken apart into its own distinct chunks; what the table lacks is segmented once there,
and the ids are joined back by position. A chunk outside the table stands for at most one in ``known`` of all chunks.

Only chunks and their counts are shuffled, after counting in the tasks; texts stay where they are read, and a lost task
is done again from its input alone.

Odd rows: null and empty texts have no ids, and no ids decode to the empty text; a text of any length is taken whole;
repeated rows and null keys are rows of their own; an empty table gives an empty one; all columns are kept, but for
those named as the added ones. A marker character in a text counts as a space, as in the library, and decodes to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Bytes of text that are taken apart together.
BATCH = 4 << 20
#: Rows of the table of chunks, and bytes of a chunk that may enter it: what is sent to a task stays below 70 MB.
KNOWN, WIDEST = 200_000, 64
_PROBE = " ﬁ a  b\t①\n" + MARK + "x\x00 "


@dataclass
class Vocabulary:
    """A byte-pair model with byte fallback: the model file, what each id decodes to, and which ids are bytes or controls."""

    model: bytes = field(repr=False)
    shown: list[bytes]
    byte: np.ndarray = field(repr=False)
    control: np.ndarray = field(repr=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file. Raises if the model rewrites texts, lacks byte pieces, or has pieces that cross markers."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in n]
        byte = np.array([sp.is_byte(i) for i in n])
        control = np.array([sp.is_control(i) for i in n])
        plain = [i for i in n if not (byte[i] or control[i] or sp.is_unknown(i) or sp.is_unused(i))]
        if byte.sum() != 256 or any(sp.is_unused(i) for i in n):
            raise ValueError("the model must have all 256 byte pieces and no unused pieces")
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("the model has pieces that cross white-space markers")
        if sp.decode(sp.encode(_PROBE)) != _PROBE.replace(MARK, " "):
            raise ValueError("the model rewrites texts before it cuts them")
        shown = [b"" if control[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in n]
        return cls(sp.serialized_model_proto(), shown, byte, control)

    def segmenter(self):
        """A function from chunks (without their first marker) to the ids of each."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        alone = sp.encode(" ")[:0] + [sp.piece_to_id(MARK)]

        def segment(chunks: list[str]) -> pa.ListArray:
            # The library puts the first marker before a chunk; it leaves the empty text empty.
            ids = sp.encode(chunks, num_threads=1) if chunks else []
            return pa.array([i if c else alone for c, i in zip(chunks, ids, strict=True)], type=pa.list_(pa.int32()))

        return segment


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks_of(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text, without their first marker; none for null and empty texts."""
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)))
    if not pc.any(odd).as_py():
        return pc.split_pattern(texts, " ")
    # Runs of markers belong to the chunk behind them.
    odd = odd.to_numpy(zero_copy_only=False)
    own = [[c[1:] for c in _CHUNK.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    both = pa.concat_arrays([pc.split_pattern(texts.filter(pa.array(~odd)), " "), pa.array(own, type=pa.list_(texts.type))])
    return both.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))))


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` together, in order."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def _bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunk_table(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", known: int = KNOWN, widest: int = WIDEST, batch: int = BATCH) -> pa.Table:
    """(chunk, ids) of the ``known`` most frequent distinct chunks of all texts, ties by the chunk; each is segmented once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(0)
            for a, b in _parts(_bytes(texts), batch):
                found = pc.value_counts(chunks_of(texts.slice(a, b - a)).flatten())
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["chunk", "n"])

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = vocabulary.segmenter()
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), segment(rows.column(0).to_pylist())], names=["chunk", "ids"])

    counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "chunk string, n long").where(F.octet_length("chunk") <= widest).groupBy("chunk").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "chunk").limit(known).select("chunk").mapInArrow(segmented, "chunk string, ids array<int>").toArrow()


def encode(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids", known: int = KNOWN, batch: int = BATCH) -> DataFrame:
    """Adds ``ids``: those of every text, without begin and end ids."""
    vocabulary = Vocabulary.load(model or default_model())
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != ids])
    sink = pa.BufferOutputStream()
    common = chunk_table(kept, vocabulary, text, known, batch=batch)
    with pa.ipc.new_stream(sink, common.schema) as out:
        out.write_table(common)
    sent = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())  # at most KNOWN rows of bounded width
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = vocabulary.segmenter()
        told = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        names, answers = (told.column(c).combine_chunks() for c in ("chunk", "ids"))
        for rows in batches:
            texts = _column(rows, text)
            for a, b in _parts(_bytes(texts), batch):
                whole = _placed(chunks_of(texts.slice(a, b - a)), names, answers, segment)
                yield pa.RecordBatch.from_arrays([*rows.slice(a, b - a).columns, whole], names=[*rows.schema.names, ids])

    return kept.mapInArrow(run, f"{kinds}, `{ids}` array<int>")


def _placed(chunks: pa.ListArray, names: pa.Array, answers: pa.ListArray, segment) -> pa.ListArray:
    """The ids of each list of chunks: distinct chunks find theirs in the table or are segmented here, then all take them by position."""
    coded = chunks.flatten().dictionary_encode()
    own = coded.dictionary
    at = pc.index_in(own, value_set=names).to_numpy(zero_copy_only=False) if len(names) else np.full(len(own), np.nan)
    new = np.isnan(at.astype(np.float64))
    at = np.where(new, len(names) + np.cumsum(new) - 1, np.nan_to_num(at.astype(np.float64))).astype(np.int64)
    known = pa.concat_arrays([answers, segment(own.filter(pa.array(new)).to_pylist())])
    codes = coded.indices.to_numpy(zero_copy_only=False)
    laid = known.take(pa.array(at[codes]))
    sizes = np.concatenate([[0], np.cumsum(laid.value_lengths().to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(sizes[ends].astype(np.int32)), laid.flatten())


def decode(tokens: DataFrame, model: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds ``text``: what the ids stand for. Null ids are no ids; bytes that form no character become U+FFFD each."""
    vocabulary = Vocabulary.load(model or default_model())
    rest = [c for c in tokens.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*[F.col(f"`{c}`") for c in rest]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = pa.array(vocabulary.shown, type=pa.large_binary())
        for rows in batches:
            lists = pc.fill_null(_column(rows, ids), pa.scalar([], type=pa.list_(pa.int32())))
            for at, to in _parts(lists.value_lengths().to_numpy(zero_copy_only=False), 1 << 20):
                part = lists.slice(at, to - at)
                flat = part.flatten()
                spans = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)), shown.take(flat))
                joined = pc.binary_join(spans, pa.scalar(b"", type=pa.large_binary()))
                firsts = [_first(vocabulary, x) for x in part]
                texts = [_text(vocabulary, own, x, first) for own, x, first in zip(joined, part, firsts, strict=True)]
                some = rows.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, type=pa.string())], names=[*some.schema.names, text])

    return tokens.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{kinds}, `{text}` string")


def _first(vocabulary: Vocabulary, ids: pa.Scalar) -> int:
    """1 if the text begins with the marker that encoding put there, else 0."""
    for i in ids.values.to_numpy():
        if not vocabulary.control[i]:
            return int(not vocabulary.byte[i] and vocabulary.shown[i].startswith(b" ") and vocabulary.shown[i] != " ⁇ ".encode())
    return 0


def _text(vocabulary: Vocabulary, joined: pa.Scalar, ids: pa.Scalar, first: int) -> str:
    given = ids.values.to_numpy()
    if not vocabulary.control[given].any():  # they show nothing, but part the bytes beside them
        try:
            return joined.as_py()[first:].decode()
        except UnicodeDecodeError:
            pass
    # Bytes that form no character: each run of byte pieces is read on its own.
    out, run = [], b""
    for i in given:
        if vocabulary.byte[i]:
            run += vocabulary.shown[i]
            continue
        out.append(_lossy(run))
        out.append(vocabulary.shown[i].decode())
        run = b""
    return ("".join(out) + _lossy(run))[first:]


def _lossy(run: bytes) -> str:
    """Characters of a run of bytes; a byte that begins none is U+FFFD."""
    out = []
    while run:
        for n in (1, 2, 3, 4):
            try:
                out.append(run[:n].decode())
                run = run[n:]
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            run = run[1:]
    return "".join(out)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    texts = decode(encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
