"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints (64 bits) that differ in at most ``max_bits`` bits link. Bits are grouped into
partitions, correlated ones together; thresholds t_i of the partitions with sum(t_i) = max_bits -
parts + 1 are chosen by dynamic programming on candidate counts that a bounded sample estimates
(a partition with t_i = -1 is skipped). Any linked pair differs in at most t_i bits of some
partition i, so it agrees on the partition with some t_i bits left out: each such choice is a *mask*,
and rows that agree under a mask are compared (popcount) and verified. The result is exact; the
sample only steers cost.

Distribution: documents collapse to distinct fingerprints first. Under each mask, fingerprints are
dealt by (mask, masked value), and all masked values are counted. A hot value is refined: the bits that
its mask leaves out are grouped once more, and of max_bits + 1 groups linked rows agree on one, so its
rows are dealt anew under max_bits + 1 longer masks, again if need be. What stays hot after
``REFINE`` rounds, or is a little too large only, is cut into blocks and each pair of blocks is a unit of
its own, so that no unit holds much more than two blocks. A unit emits no pairs beyond a spanning set: for a run of more than ``SMALL_RUN`` rows, each row links to the smallest
one of its component. Components come from label propagation with pointer jumping over the links only;
every round is a written table.

Defined results: null or empty text has the fingerprint 0, linked like any other. Repeated rows are
members of the same component. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.common import batched, forget, hash_sample, join_counted, lower_bytes, sendable, stored, table

#: Distinct fingerprints that steer masks; the result does not depend on it.
SAMPLE = 16_384
#: Fingerprints of a masked value per block; blocks beyond which it is refined, and rounds of that.
BLOCK, MAX_BLOCKS, REFINE = 8192, 4, 4
SMALL_RUN = 48
#: Bits of partitions: cost of one emitted row against one compared pair.
ROW_COST, PAIR_COST = 1.0, 0.02


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _packed(over_half: np.ndarray) -> int:
    return int(np.packbits(over_half, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory on very long texts
        counts += _ones(hashes[at : at + 65536])
    return _packed(2 * counts > len(hashes))


def fingerprint(text: bytes | None, words_per: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles."""
    words = lower_bytes(text or b"").split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - words_per + 1
    one = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        upto = min(at + 65536, n)
        spans = zip(starts[at:upto].tolist(), ends[at + words_per - 1 : upto + words_per - 1].tolist(), strict=True)
        counts += _ones(np.fromiter((one(joined[a:b], seed) for a, b in spans), np.uint64, upto - at))
    return _packed(2 * counts > n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 4) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words_per) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    picked = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("binary").alias("text"))
    return batched(picked).mapInArrow(run, "id bigint, fp bigint")


# -- masks ------------------------------------------------------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partition_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into ``parts`` groups of about equal width, correlated bits together."""
    if len(sample) > 2:
        x = _bits(sample).astype(np.float64)
        x -= x.mean(0)
        scale = np.sqrt((x * x).sum(0))
        scale[scale == 0] = 1
        c = np.abs(x.T @ x / np.outer(scale, scale))
    else:
        c = np.zeros((64, 64))
    free, groups = set(range(64)), []
    for g in range(parts):
        width = len(free) // (parts - g)
        # start from the bit with the strongest ties to what is left
        group = [max(sorted(free), key=lambda b: c[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: c[b, group].mean())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _value(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _choices(group: list[int], threshold: int) -> list[int]:
    """Masks that keep all but ``threshold`` bits of the group."""
    whole = _value(group)
    return [whole & ~_value(list(x)) for x in combinations(group, threshold)] if threshold >= 0 else []


def _pairs(sample: np.ndarray, mask: int) -> int:
    """Pairs of the sample that agree under the mask."""
    counts = np.unique(sample & np.uint64(mask), return_counts=True)[1].astype(np.int64)
    return int((counts * (counts - 1) // 2).sum())


def allocate(sample: np.ndarray, groups: list[list[int]], max_bits: int, n: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with sum max_bits - parts + 1, by dynamic programming over the partitions."""
    grow = (n / max(1, len(sample))) ** 2
    cost = []
    for group in groups:
        row = {-1: 0.0}
        for t in range(min(2, max_bits) + 1):
            masks = _choices(group, t)
            some = masks[:: max(1, len(masks) // 8)]  # masks of one partition and threshold are alike
            pairs = sum(_pairs(sample, m) for m in some) / len(some) * len(masks)
            row[t] = ROW_COST * n * len(masks) + PAIR_COST * pairs * grow
        cost.append(row)
    best = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, extra in row.items():
                if total + t not in new or c + extra < new[total + t][0]:
                    new[total + t] = (c + extra, [*chosen, t])
        best = new
    return best.get(max_bits - len(groups) + 1, (float("inf"), []))


def masks_for(sample: np.ndarray, max_bits: int, n: int) -> list[int]:
    """Masks of the cheapest of 2 to max_bits + 1 partitions; any linked pair agrees under one."""
    if max_bits == 0:
        return [(1 << 64) - 1]
    plans = []
    for parts in range(2, max_bits + 2):
        groups = partition_bits(sample, parts)
        cost, chosen = allocate(sample, groups, max_bits, n)
        if chosen:
            plans.append((cost, parts, [m for g, t in zip(groups, chosen, strict=True) for m in _choices(g, t)]))
    return min(plans)[2]


def refined(mask: int, max_bits: int) -> list[int]:
    """Longer masks, under one of which any two rows that agree under ``mask`` and link agree as well; none if it leaves too few bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= max_bits:
        return []
    return [mask | _value(free[i :: max_bits + 1]) for i in range(max_bits + 1)]


# -- links ------------------------------------------------------------------------------------


def _small(v: np.ndarray, run: np.ndarray, size: int, earlier: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within runs of at most ``size`` rows of sorted values, but for those that agree under an earlier mask."""
    a, b = [], []
    for d in range(1, size):
        same = run[:-d] == run[d:]
        x, y = v[:-d][same], v[d:][same]
        near = np.bitwise_count(x ^ y) <= max_bits
        a.append(x[near])
        b.append(y[near])
    x, y = (np.concatenate(k) if k else np.zeros(0, np.uint64) for k in (a, b))
    if len(x) and len(earlier):
        first = ~((((x ^ y)[:, None] & earlier[None, :]) == 0).any(1))
        x, y = x[first], y[first]
    return x, y


def _spanning(v: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each row to the smallest of its component within one long run of sorted distinct values."""
    label, todo, n = np.full(len(v), -1, np.int64), np.ones(len(v), bool), len(v)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start], todo[start] = start, False
        edge = v[start : start + 1]
        while len(edge):  # breadth first, over what has no label yet
            left = np.flatnonzero(todo)
            hit = np.zeros(len(left), bool)
            rest = v[left]
            for x in edge:
                hit |= np.bitwise_count(rest ^ x) <= max_bits
                if hit.all():
                    break
            got = left[hit]
            label[got], todo[got] = start, False
            edge = v[got]
    other = label != np.arange(n)
    return v[label[other]], v[other]


def link_runs(slots: np.ndarray, units: np.ndarray, values: np.ndarray, masks: np.ndarray, max_bits: int, origins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (slot, unit, value under the mask, value); a refined mask's origin is the slot that it refines."""
    if not len(values):
        return values, values
    key = values & masks[slots]
    new = np.concatenate(([True], (slots[1:] != slots[:-1]) | (units[1:] != units[:-1]) | (key[1:] != key[:-1])))
    run = np.cumsum(new) - 1
    sizes = np.bincount(run)
    a, b = [], []
    for slot in np.unique(slots):
        for least, most in ((2, 8), (9, SMALL_RUN)):
            pick = (slots == slot) & (sizes[run] >= least) & (sizes[run] <= most)
            if pick.any():
                x, y = _small(values[pick], run[pick], int(sizes[run[pick]].max()), masks[: slot if origins is None else origins[slot]], max_bits)
                a.append(x)
                b.append(y)
    for r in np.flatnonzero(sizes > SMALL_RUN):
        lo = int(np.searchsorted(run, r))
        x, y = _spanning(np.unique(values[lo : lo + sizes[r]]), max_bits)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hot_values(dealt: DataFrame) -> DataFrame:
    """slot, key, blocks of every masked value that more than ``BLOCK`` fingerprints have, by an exact count."""
    counted = dealt.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    return stored(counted.select("slot", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot-values")


def deal(distinct: DataFrame, masks: list[int], origins: list[int], max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(slot, key, fp) under each mask, and the hot values of it. Refined masks are added to ``masks`` and ``origins``."""
    masked = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = distinct.select("fp", F.inline(masked)).select("slot", "key", "fp")
    hot = hot_values(dealt)
    for _ in range(REFINE):
        large = hot.where(F.col("blocks") > MAX_BLOCKS)
        rows = []
        for r in large.select("slot").distinct().orderBy("slot").collect():  # as many as masks at most
            for m in refined(masks[r["slot"]], max_bits):
                rows.append((r["slot"], len(masks), _signed(m)))
                masks.append(m)
                origins.append(origins[r["slot"]])
        if not rows:
            break
        longer = distinct.sparkSession.createDataFrame(rows, "slot int, longer int, mask bigint")
        large = stored(large.join(F.broadcast(longer.select("slot").distinct()), "slot", "left_semi").select("slot", "key"), "refined-values")
        again = dealt.join(sendable(large), ["slot", "key"], "left_semi").join(F.broadcast(longer), "slot")
        again = stored(again.select(F.col("longer").alias("slot"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), "refined")
        dealt = dealt.join(sendable(large), ["slot", "key"], "left_anti").unionByName(again)
        hot = stored(hot.join(sendable(large), ["slot", "key"], "left_anti").unionByName(hot_values(again)), "hot-values")
    return dealt, hot


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct(fp)`` within ``max_bits``."""
    n = distinct.count()
    rows = hash_sample(distinct, "fp", SAMPLE).select("fp").collect()
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    masks = masks_for(sample, max_bits, n)
    origins = list(range(len(masks)))
    dealt, hot = deal(distinct, masks, origins, max_bits)
    held, first = np.array(masks, np.uint64), np.array(origins, np.int64)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    with_blocks = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)
    )
    units = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(with_blocks)
    dealt = dealt.join(sendable(hot), ["slot", "key"], "left").select("slot", "key", F.explode(units).alias("unit"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        last = False
        source = iter(batches)
        while not last:
            b = next(source, None)
            last = b is None
            if b is not None:
                kept = [np.concatenate((k, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, k in enumerate(kept)]
            slots, units, values = kept[0], kept[1], kept[2].view(np.uint64)
            cut = len(values)
            if not last and cut:  # the last run may go on
                same = (slots == slots[-1]) & (units == units[-1]) & ((values & held[slots]) == (values[-1] & held[slots[-1]]))
                cut = int(np.argmax(same))
            x, y = link_runs(slots[:cut], units[:cut], values[:cut], held, max_bits, first)
            kept = [k[cut:] for k in kept]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return (
        dealt.repartition("slot", "key", "unit")
        .sortWithinPartitions("slot", "unit", "key", "fp")
        .select("slot", "unit", "fp")
        .mapInArrow(run, "a bigint, b bigint")
    )


# -- components -------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node that has a link: the smallest node reachable.

    Rounds of large-star and small-star rewrite the links until each node links to its smallest one.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours go to the smallest one around
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        # small star: the node and its smaller neighbours go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        done, edges = edges, stored(small, "small-star")
        forget(done)
        forget(large)
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = mark


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 4, max_bits: int = 4) -> DataFrame:
    """id, fp (signed long), component_id (smallest id reachable) per document."""
    prints = stored(fingerprints(docs, id_col, text_col, words_per), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    labels = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", "rows", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "labelled-fingerprints")
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    named = join_counted(named, stored(smallest, "component-ids"), "label", "prints").select("fp", "rows", "component_id")
    return join_counted(prints, stored(named, "named-fingerprints"), "fp", "rows").select("id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
