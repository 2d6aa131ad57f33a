"""Token ids in binary segments with Elias-Fano encoded document boundaries.

Rows are dealt to tasks by ranges of ``doc_id`` and sorted there. Each task
encodes its texts and packs runs of documents into segments: one array of all
ids, and the running document ends as an Elias-Fano sequence (low bits packed,
high bits in unary, and the bit positions of every 256th end so that ``select``
starts nearby). A segment is a byte string that stands alone; segments are kept
as rows of a Parquet table, so any store that Spark writes to can hold them and
each row knows its task and the ids before it there.

Segment layout, little-endian: magic ``QTS1``, u32 documents, u64 ids, u8 bytes
an id, u8 low bits, u16 zero, u32 bytes of high bits, u32 bytes of low bits, then
high bits, low bits, u32 select samples, ids.

Defined results: a null or empty text is the end id alone. Null ids come first,
equal ids next to each other. A document longer than a segment's usual size has
a segment of its own. An empty table gives no segment and an empty result.
"""

from __future__ import annotations

import array
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaver.llm.common import new_path, partitions

MAGIC = b"QTS1"
HEAD = struct.Struct("<4sIQBBHII")
#: A segment is closed at this many ids or documents.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 14
#: Every so many documents have their place in the high bits on record.
SAMPLE = 256
SEGMENTS = "task int, seq int, ids_before long, n_ids long, doc_ids array<long>, segment binary"


def pack(ends: np.ndarray, ids: np.ndarray, wide: bool = False) -> bytes:
    """A segment of documents that end before ``ends`` in ``ids``."""
    n, total = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (total // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    high = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    bits[high] = 1
    high_bytes = np.packbits(bits, bitorder="little").tobytes()
    lows = (ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    low_bytes = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes()
    head = HEAD.pack(MAGIC, n, total, 4 if wide else 2, low_bits, 0, len(high_bytes), len(low_bytes))
    return head + high_bytes + low_bytes + high[::SAMPLE].astype("<u4").tobytes() + ids.astype("<u4" if wide else "<u2").tobytes()


class Segment:
    """A packed segment: ``ids``, and where documents stand in them by ``select`` on the encoded ends."""

    def __init__(self, data: bytes):
        magic, self.n, self.total, width, self.low_bits, _, high, low = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        self.high = np.frombuffer(data, np.uint8, high, at)
        self.low = np.frombuffer(data, np.uint8, low, at + high)
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", samples, at + high + low)
        self.ids = np.frombuffer(data, f"<u{width}", self.total, at + high + low + 4 * samples)

    def select(self, wanted: np.ndarray) -> np.ndarray:
        """The ends of documents by rank, ascending: of each sampled stretch that holds one, its set high bits are found and
        the wanted ones taken, and their low bits are read from where they are packed. Nothing else is decoded."""
        wanted = np.asarray(wanted, np.int64)
        out = np.empty(len(wanted), np.int64)
        stretches, starts = np.unique(wanted // SAMPLE, return_index=True)
        for g, first, last in zip(stretches, starts, [*starts[1:], len(wanted)]):
            begin = int(self.samples[g])
            end = int(self.samples[g + 1]) if g + 1 < len(self.samples) else len(self.high) * 8
            byte = begin // 8
            bits = np.flatnonzero(np.unpackbits(self.high[byte : (end + 7) // 8], bitorder="little")[begin - byte * 8 :])
            out[first:last] = begin + bits[wanted[first:last] - g * SAMPLE]
        return (out - wanted << self.low_bits) + self._lows(wanted)

    def _lows(self, wanted: np.ndarray) -> np.ndarray:
        places = wanted[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = self.low[places >> 3] >> (places & 7).astype(np.uint8) & 1
        return (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def spans(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents ``first`` to ``last - 1`` begin and end."""
        ends = self.select(np.arange(max(first - 1, 0), last))
        return (ends[:-1], ends[1:]) if first else (np.r_[0, ends[:-1]].astype(np.int64), ends)

    def span(self, i: int) -> tuple[int, int]:
        starts, ends = self.spans(i, i + 1)
        return int(starts[0]), int(ends[0])


#: What the byte-level tokenizer cuts texts into before it merges, a fixed value.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone are cut here; all libraries agree on their classes.
PLAIN = re.compile(r"[\t\n\r !-~\u00a1-\u024f]*")


def _plain_pretokens() -> re.Pattern:
    """``PRETOKENS`` with the letters and numbers among the plain characters spelt out."""
    plain = [c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)]
    of = {kind: "".join(re.escape(c) for c in plain if unicodedata.category(c).startswith(kind)) for kind in "LN"}
    return re.compile(PRETOKENS.replace("{L}", of["L"]).replace("{N}", of["N"]))


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Numbers(dict):
    """Numbers of pre-tokens; one that is not there yet is learnt."""

    def __init__(self, learn: Callable[[str], int]):
        super().__init__()
        self.learn = learn

    def __missing__(self, token: str) -> int:
        return self.learn(token)


class CachedEncoder:
    """A byte-level BPE tokenizer behind a cache of its pre-tokens.

    Texts of plain characters are cut into pre-tokens here, and only those not seen
    before go through the merges. Texts with other characters, or with a special
    token, are encoded whole; so are all texts where the tokenizer's file asks for
    anything but the cut that is known here. After ``limit`` additions a new cache begins, which
    takes what it needs from the one before.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.pretokens, self.letters = self.tokenizer.model, _plain_pretokens(), _byte_letters()
        #: Whether the file cuts as PRETOKENS does, and changes no text before.
        parts = json.loads(self.tokenizer.to_str())
        cut, model = parts["pre_tokenizer"] or {}, parts["model"]
        self.known = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
            and not parts["normalizer"] and not parts.get("truncation") and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.kind, self.dtype = ("I", np.uint32) if self.tokenizer.get_vocab_size() > 1 << 16 else ("H", np.uint16)
        self.turn()
        self.turn()

    def turn(self) -> None:
        self.old = getattr(self, "now", None)
        #: Pre-token to number; by number, where its ids start and how many there are.
        self.now = (_Numbers(self._learn), array.array(self.kind), array.array("q"), array.array("I"))

    def _learn(self, token: str) -> int:
        index, flat, starts, lengths = self.now
        old, old_flat, old_starts, old_lengths = self.old
        start = len(flat)
        if (at := old.get(token)) is not None:
            flat.extend(old_flat[old_starts[at] : old_starts[at] + old_lengths[at]])
        else:
            letters = token.encode().decode("latin-1").translate(self.letters)
            flat.extend([t.id for t in self.model.tokenize(letters)])
        index[token] = number = len(starts)
        starts.append(start)
        lengths.append(len(flat) - start)
        return number

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.now[0]) > self.limit:
            self.turn()
        index = self.now[0]
        plain = [self.known and PLAIN.fullmatch(t) is not None and self.special.search(t) is None for t in texts]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        codes = []
        for text, p in zip(texts, plain):
            tokens = self.pretokens.findall(text) if p else []
            codes.append(np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)))
        flat, starts, lengths = (np.frombuffer(a, d) if len(a) else np.zeros(0, d) for a, d in zip(self.now[1:], (self.dtype, np.int64, np.uint32)))
        out = []
        for at, p in zip(codes, plain):
            if not p:
                out.append(np.array(next(whole).ids, self.dtype))
                continue
            sizes = lengths[at].astype(np.int64)
            ends = np.cumsum(sizes)
            out.append(flat[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def slices(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def segments(docs: DataFrame, tokenizer_path: str, end_id: int = 0, text: str = "text") -> DataFrame:
    """Encode ``docs`` (``doc_id``, a text) into rows of ``SEGMENTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = CachedEncoder(tokenizer_path)
        encoder, task = _ENCODERS[tokenizer_path], TaskContext.get().partitionId()
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        schema = pa.schema([("task", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("segment", pa.binary())])
        seq = before = held = 0
        names: list = []
        arrays: list = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held, names, arrays
            ids = np.concatenate(arrays)
            ends = np.cumsum([len(a) for a in arrays])
            row = [[task], [seq], [before], [len(ids)], [names], [pack(ends, ids, wide)]]
            seq, before, held, names, arrays = seq + 1, before + len(ids), 0, [], []
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            doc_ids = batch.column(0).to_pylist()
            for a, b in slices(texts):
                for name, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b])):
                    names.append(name)
                    arrays.append(np.append(ids, encoder.dtype(end_id)))
                    held += len(ids) + 1
                    if held >= SEGMENT_IDS or len(names) >= SEGMENT_DOCS:
                        yield close()
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return rows.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, text: str = "text") -> None:
    segments(docs, tokenizer_path, end_id, text).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids``-digest rows from a store."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    tasks = rows.groupBy("task").agg(F.sum("n_ids").alias("n"))
    # One row a task of the writing job.
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("task_start"))
    rows = rows.join(F.broadcast(tasks), "task").select((F.col("task_start") + F.col("ids_before")).alias("start"), "doc_ids", "segment")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start, doc_ids, data in zip(frame["start"], frame["doc_ids"], frame["segment"]):
                segment = Segment(data)
                starts, ends = segment.spans(0, segment.n)
                ids = segment.ids.astype("<u4")
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if x is None or x != x else int(x) for x in doc_ids], "Int64"),
                        "start": starts + start,
                        "n_tokens": ends - starts,
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)],
                    }
                )

    return rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path)
