"""Near copies: groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash with similarity as the measure. Texts with the same words are one *node*, with the 64-bit
fingerprint of its five-word shingles. Fingerprints within ``MAX_BITS`` bits, found by the generalised
pigeonhole search of ``simhash``, make candidate links, and every candidate is verified by the Jaccard
similarity of the whole shingle sets.

Most pairs of similarity 0.8 differ in more bits than such a search can allow (their mean is near ten of
64, and masks for so many would keep too few bits to tell texts apart), so a node's shingle hashes also
give ``BANDS`` keys of ``ROWS`` MinHash values each, and nodes that share a key are candidates too. Two
nodes of similarity s share no key with probability (1 - s ** ROWS) ** BANDS, that is 2e-6 at 0.8 and
less above; nothing else is left out.

Nodes under a key meet in one task, which has their shingle sets as rows of a bit matrix, compares them by
counting common bits, and emits a spanning set of the links found, not all of them; so rows grow with the
nodes, not with their pairs. A key that a passage common to many texts gives to more than ``GROUP`` nodes
is dealt again by a further key that its nodes share, as often as ``DEEPER`` times, which keeps similar
texts together (two of similarity 0.8 share no second key with probability 4e-5, no third with 3e-4; this
counts only under keys that are so common) and parts those that have little but the passage in common; what
is still larger is cut into blocks, and each pair of blocks meets in a task. Shingle sets are made for
candidates only, of 32 bits of each shingle's hash: two shingles of a text agree in them once in 4e9.

Defined results: words and lower-casing as for fingerprints; a text of fewer than five words is one
shingle; texts without words are one node. Repeated rows are members of the same component. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm.common import batched, kept, lower_bytes, row_hash, sendable, stored
from vecgrove.llm.simhash import components, links, majority

WORDS = 5
#: Bits in which fingerprints of candidates may differ.
MAX_BITS = 4
#: 1 - (1 - 0.8 ** ROWS) ** BANDS of the pairs of similarity 0.8 share a key.
ROWS, BANDS = 4, 25
#: Nodes that one task compares, and times that larger groups are dealt by a further key.
GROUP, DEEPER = 4096, 2
#: Bits of a matrix that is made by way of bytes.
_BYTES = 1 << 25
_RNG = np.random.default_rng(5)
_TURN = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64)
_JOIN = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> tuple[int, np.ndarray]:
    """Hash of the words, and the distinct hashes of the shingles."""
    words = lower_bytes(text or b"").split()
    joined = b" ".join(words)
    node = xxhash.xxh64_intdigest(joined, 1)
    if len(words) <= WORDS:
        return node, np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    one = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist(), strict=True)
    return node, np.unique(np.fromiter((one(joined[a:b], 42) for a, b in spans), np.uint64))


def keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, none where there are no shingles."""
    if not len(hashes):
        return hashes
    least = np.full(len(_TURN), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):  # bounded memory on very long texts
        np.minimum(least, ((hashes[at : at + 1024] * _TURN) ^ _FLIP).min(1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _JOIN).sum(1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(31))) * _JOIN[:, 0]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row (hash of the text), node, n (shingles), fp (fingerprint), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near copies")
        for b in batches:
            nodes, sizes, prints, found = [], [], [], []
            for t in b.column(2):
                node, h = shingles(t.as_py())
                nodes.append(node)
                sizes.append(len(h))
                prints.append(majority(h))
                found.append(keys(h).view(np.int64))
            at = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:2],
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                ],
                ["id", "row", "node", "n", "fp", "keys"],
            )

    picked = docs.select(docs[id_col].cast("bigint").alias("id"), row_hash(docs[text_col]).alias("row"), docs[text_col].cast("binary").alias("text"))
    return batched(picked).mapInArrow(run, "id bigint, row bigint, node bigint, n bigint, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, hashes of ``rows(id, row)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near copies")
        for b in batches:
            for t in b.column(0):
                node, h = shingles(t.as_py())
                node = pa.array(np.array([node], np.uint64).view(np.int64))
                short = pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), short)], ["node", "hashes"])

    wanted = sendable(rows.toDF("_vg_id", "_vg_row"))
    same = docs[id_col].cast("bigint").eqNullSafe(F.col("_vg_id")) & (row_hash(docs[text_col]) == F.col("_vg_row"))
    texts = docs.join(wanted, same, "left_semi").select(docs[text_col].cast("binary").alias("text"))
    return batched(texts).mapInArrow(run, "node bigint, hashes array<int>").dropDuplicates(["node"])


# -- the comparison ---------------------------------------------------------------------------


def bit_rows(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, a column per value that two or more sets have."""
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    pick = shared[column]
    row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[pick], number[column[pick]]
    words = max(1, -(-int(shared.sum()) // 64))
    if len(sets) * words * 64 <= _BYTES:
        whole = np.zeros((len(sets), words * 64), bool)
        whole[row, at] = True
        return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)
    out = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(out, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def spanning(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links from the first node of each component to its others."""
    sizes = np.array([len(x) for x in sets])
    bits, left = bit_rows(sets), np.arange(len(nodes))
    a, b = [], []
    while len(left) > 1:
        start, left = left[0], left[1:]
        edge = [start]
        while edge and len(left):  # breadth first, over what is not reached yet
            x = edge.pop()
            common = np.bitwise_count(bits[left] & bits[x]).sum(1, dtype=np.int64)
            hit = 5 * common >= 4 * (sizes[left] + sizes[x] - common)
            if hit.any():
                got, left = left[hit], left[~hit]
                a += [int(nodes[start])] * len(got)
                b += nodes[got].tolist()
                edge += got.tolist()
    return a, b


def _compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) among the nodes of each unit of ``rows(group, unit, node, hashes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near copies")
        last, nodes, sets = None, [], []
        for b in batches:
            units = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for unit, node, values in zip(units, b.column(2).to_pylist(), b.column(3), strict=True):
                if unit != last:
                    if len(nodes) > 1:
                        yield _links(*spanning(np.array(nodes), sets))
                    last, nodes, sets = unit, [], []
                nodes.append(node)
                sets.append(values.values.to_numpy(zero_copy_only=False))
        if len(nodes) > 1:
            yield _links(*spanning(np.array(nodes), sets))

    # a unit's rows come one after the other, and small tables of links are made larger again
    dealt = rows.repartition("group", "unit").sortWithinPartitions("group", "unit", "node")
    return batched(dealt.select("group", "unit", "node", "hashes")).mapInArrow(run, "a bigint, b bigint")


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# -- candidates -------------------------------------------------------------------------------


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(group, node): nodes of the same fingerprint, and the first nodes of two fingerprints that link."""
    same = nodes.select(F.xxhash64("fp", F.lit("same")).alias("group"), "node")
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-prints")
    near = stored(links(first.select("fp"), MAX_BITS).where("a <> b").distinct(), "near-fingerprints")
    ends = near.select(F.xxhash64("a", "b").alias("group"), F.explode(F.array("a", "b")).alias("fp"))
    return same.unionByName(ends.join(first, "fp").select("group", "node"))


def _members(nodes: DataFrame) -> DataFrame:
    """(group, unit, node) for all groups of two or more nodes; large ones dealt again, then in blocks."""
    keyed = nodes.select(F.explode("keys").alias("group"), "node").unionByName(_by_fingerprint(nodes))
    counted = stored(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-groups")
    members = stored(keyed.join(sendable(counted), "group"), "near-members")
    out, large = [members.where(F.col("c") <= GROUP)], members.where(F.col("c") > GROUP)
    for _ in range(DEEPER):
        if not large.limit(1).count():
            break
        each = large.select("group", "node").join(nodes.select("node", F.explode("keys").alias("key")), "node")
        again = each.where("key <> group").select(F.xxhash64("group", "key").alias("group"), "node").distinct()
        counted = stored(again.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-groups")
        members = stored(again.join(sendable(counted), "group"), "near-members")
        out.append(members.where(F.col("c") <= GROUP))
        large = members.where(F.col("c") > GROUP)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    whole = whole.select("group", F.lit(0).cast("bigint").alias("unit"), "node")
    if not large.limit(1).count():
        return whole
    blocks = F.ceil(2 * F.col("c") / GROUP)
    own = F.pmod(F.xxhash64("node"), blocks)
    units = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda j: 1 + F.least(own, j) * blocks + F.greatest(own, j))
    return whole.unionByName(large.select("group", F.explode(units).alias("unit"), "node"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (hash of the text), component per row."""
    signed = stored(signatures(docs, id_col, text_col), "near-signatures")
    one = [F.first(c).alias(c) for c in ("fp", "keys")]
    nodes = stored(signed.groupBy("node").agg(F.min(F.struct("id", "row")).alias("r"), *one), "near-nodes")
    members = stored(_members(nodes), "near-units")
    wanted = stored(nodes.join(sendable(members.select("node").distinct()), "node", "left_semi").select("r.id", "r.row"), "near-rows")
    sets = stored(_sets(docs, wanted, id_col, text_col), "near-sets")
    labels = stored(components(stored(_compared(members.join(sets, "node")), "near-links")), "near-labels")
    return signed.join(sendable(labels), "node", "left").select("id", "row", F.coalesce("label", "node").alias("component"))
