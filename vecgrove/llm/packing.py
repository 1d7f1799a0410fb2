"""Packing token sequences by best-fit decreasing.

Each whole text is tokenised (ids plus an end id) and cut into full windows and a remainder. Windows
fill a sequence each. Remainders, longest first, go into the open sequence with the tightest fitting
capacity, found by a segment tree over remaining capacities. Packing is done in shards of about
``SHARD`` pieces, dealt by hash of id, start and tokens, so that no task's work grows with the corpus; a
shard that repeated rows make more than four times as large is dealt again by the rows' places in the
written table of pieces. A shard is a fixed function of its rows, so a lost task is redone with the same
result.

A sequence is padded to ``capacity`` except at a length that is a power of two (``padding``).

The vocabulary drops white space and never joins across it, so a text's ids are those of its words in
turn; each worker remembers the ids of words it has seen.

Defined results: null text counts as empty and gives one piece with the end id only; bytes that are no
UTF-8 are replacement characters. Repeated rows
are packed each by itself. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import batched, kept, lower_bytes, sendable, stored, table

CAPACITY = 2048
END_ID = 1
#: Pieces per shard.
SHARD = 4096
#: Words whose ids a worker remembers, and the longest such word in bytes.
_CACHE_WORDS, _CACHE_LENGTH = 600_000, 64
VOCABULARY = "word_bpe_49k.json"


#: Parts the new words of a text that go to the tokenizer at once; a special token never joins with a word.
_PART = "<|startoftext|>"


class Ids:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    Ids are looked up by word. The tokenizer lower-cases, so A-Z are lowered first - not where a text has
    combining marks (which compose with letters of one case only) or may have special tokens. A comma or
    stop after a letter is a token of its own.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.part = self.tokenizer.token_to_id(_PART)
        self.stops = {c: self._encode(c.encode()) for c in ",."}
        self.stops = {ord(c): v for c, v in self.stops.items()}

    def _encode(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, stops, after = self.known, self.stops, []
        plain = set()
        for w in new:
            if w[-1] in stops and len(w) > 1 and 97 <= w[-2] <= 122:
                after.append(w)
                w = w[:-1]
                if w in known:
                    continue
            plain.add(w)
        words = [w for w in plain if b"<|" not in w] if self.part is not None else []
        for w in plain.difference(words):
            known[w] = self._encode(w)
        if words:
            text = f" {_PART} ".join([w.decode("utf-8", "replace") for w in words])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.part)
            if len(cuts) != len(words) - 1:
                raise AssertionError("words and ids do not match")
            raw, start = ids.tobytes(), 0
            for w, stop in zip(words, [*(4 * cuts).tolist(), len(raw)], strict=True):
                known[w] = raw[start:stop]
                start = stop + 4
        for w in after:
            known[w] = known[w[:-1]] + stops[w[-1]]

    def __call__(self, text: bytes | None, end_id: int | None = END_ID) -> bytes:
        text, known = text or b"", self.known
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = lower_bytes(text)
        words = text.split()
        new = set(words).difference(known)
        if new:
            if len(known) > _CACHE_WORDS:  # frequent words came first: the later half goes
                for w in list(known)[_CACHE_WORDS // 2 :]:
                    del known[w]
                new = set(words).difference(known)
            self._learn(new)
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > _CACHE_LENGTH:
                known.pop(w, None)  # may have gone with a longer word
                known.pop(w[:-1], None)
        return out if end_id is None else out + int(end_id).to_bytes(4, "little")


class Capacities:
    """Segment tree over remaining capacities 0..size-1: how many open sequences have each."""

    def __init__(self, size: int):
        self.half = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.half)

    def add(self, capacity: int, change: int) -> None:
        at = capacity + self.half
        while at:
            self.count[at] += change
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least ``least`` that an open sequence has."""
        count, at = self.count, least + self.half
        if count[at]:
            return least
        while at > 1:  # up until a right sibling has something, then down to its leftmost
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.half:
                    at *= 2
                    if not count[at]:
                        at += 1
                return at - self.half
            at >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces of equal length in the order given."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, stacks, made = Capacities(capacity + 1), [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.tightest(n)
        if room is None:
            s, room = made, capacity
            made += 1
        else:
            s = stacks[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = s, capacity - room
        if room > n:
            stacks[room - n].append(s)
            tree.add(room - n, 1)
    return sequence, offset


def padding(length: int, capacity: int = CAPACITY) -> int:
    return 0 if length & (length - 1) == 0 else capacity - length


_PIECE = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Full windows and the remainder of each document; with ``with_ids`` also their ids."""
    schema = _PIECE + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = kept(f"packing {tokenizer}", lambda: Ids(tokenizer))  # what it remembers outlives a task
        for b in batches:
            rows: list[list] = [[] for _ in schema.split(",")]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tokens_of(text.as_py())
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    row = [doc, start, len(part) // 4, crc32(part), n] + ([np.frombuffer(part, "<u4").tolist()] if with_ids else [])
                    for column, v in zip(rows, row, strict=True):
                        column.append(v)
            arrays = [pa.array(c, pa.int64()) for c in rows[:5]] + [pa.array(c, pa.list_(pa.int64())) for c in rows[5:]]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return batched(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("binary").alias("text"))).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = stored(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces")
    shards = max(1, -(-cut.count() // SHARD))

    def fill(t: pa.Table) -> pa.Table:
        order = np.lexsort([t.column(c).to_numpy() for c in ("ids_crc32", "start", "length")] + [t.column("id").fill_null(-1).to_numpy()])
        t = t.take(pa.array(order))
        sequence, offset = best_fit_decreasing(t.column("length").to_numpy(), capacity)
        base = t.column("shard")[0].as_py() << 32
        t = t.drop_columns(["shard"])
        return t.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(shards)))
    large = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("parts")).where("parts > 4")
    if large.limit(1).count():
        again = dealt.withColumn("place", F.monotonically_increasing_id()).join(sendable(stored(large, "large-shards")), "shard", "left")
        part = 1 + F.pmod(F.xxhash64("place"), F.col("parts"))
        dealt = again.withColumn("shard", F.col("shard") + shards * F.coalesce(part, F.lit(0))).select(*cut.columns, "shard")
    return dealt.groupBy("shard").applyInArrow(fill, schema)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
