r"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that list them). Token capacity
is routed from patterns to source quotas: a pattern offers its size up to ``max_repeat`` times, each
repetition at a higher cost (convex), so nothing is repeated while unused text would do. Within a
pattern, whole documents are then selected by seeded hash: a histogram over 4096 hash ranges finds the
range in which the quota runs out, and the hashes in that range give the last one that is taken. A
document's copies follow from its hash and its pattern's row of the plan alone.

A pattern of one source whose source no other pattern shares has one path only; its flow is its quota.
So the network holds overlapping patterns and what touches their sources, and the other sources, however
many, are dealt with by DataFrame functions. Of overlapping patterns the ``max_patterns`` largest (with
``MAX_ARCS`` memberships at most) are in the network; documents of any further ones count as of their
first source alone: they can still be taken and the quotas are filled as far as text allows, but by a flow
that may not be the cheapest.

Quotas: sources in code-point order get ``weights``, repeating, and share the size of all documents; a
target stops at ``max_repeat`` times its source's size and the excess is reshared by weight. The common
level of target by weight is found by Newton's method, one small aggregate a round.

Defined results: size is the number of words, null or empty text has size 0 and nothing taken. A
null source, or an empty list, is a source of its own, last in order. Rows alike in id and text share a
hash and are taken together. Reruns agree, as only ids, texts and the seed decide. Empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecgrove.llm.common import WORD, sendable, stored, table
from vecgrove.sources.shared import numbered

#: Overlapping patterns, and memberships of theirs, that the flow network may have.
MAX_PATTERNS, MAX_ARCS = 20_000, 400_000
HASH_BITS = 12


class Flow:
    """Cheapest largest flow where only the arcs that leave node 0 have costs; node 1 is the sink.

    As no path turns back through node 0, its arcs are opened in the order of cost, and each time the flow
    is raised as far as it goes (by blocking flows on levels).
    """

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.later: dict[int, list[tuple[int, int]]] = {}

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        at = len(self.to)
        if cost:
            self.later.setdefault(cost, []).append((at, cap))
        self.out[a].append(at)
        self.out[b].append(at + 1)
        self.to += [b, a]
        self.cap += [0 if cost else cap, 0]
        return at

    def run(self) -> None:
        self._raise()
        for cost in sorted(self.later):
            for at, cap in self.later[cost]:
                self.cap[at] = cap
            self._raise()

    def _raise(self) -> None:
        to, cap, out = self.to, self.cap, self.out
        while True:
            level = [-1] * len(out)
            level[0], queue = 0, deque([0])
            while queue:
                a = queue.popleft()
                for e in out[a]:
                    if cap[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[1] < 0:
                return
            turn, path, at = [0] * len(out), [], 0
            while True:
                if at == 1:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    back = next(i for i, e in enumerate(path) if not cap[e])
                    at = to[path[back] ^ 1]
                    del path[back:]
                    continue
                arcs = out[at]
                while turn[at] < len(arcs) and not (cap[arcs[turn[at]]] and level[to[arcs[turn[at]]]] == level[at] + 1):
                    turn[at] += 1
                if turn[at] < len(arcs):
                    path.append(arcs[turn[at]])
                    at = to[path[-1]]
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break


def route(pattern_sizes: dict[str, int], members: dict[str, list[str]], quotas: dict[str, int], max_repeat: int = 3) -> dict[str, int]:
    """Tokens that each pattern gives in the cheapest flow that fills the quotas as far as possible."""
    names, sources = sorted(pattern_sizes), sorted(quotas)
    node = {("p", p): 2 + i for i, p in enumerate(names)} | {("s", s): 2 + len(names) + i for i, s in enumerate(sources)}
    flow, tiers = Flow(2 + len(node)), {}
    for p in names:
        tiers[p] = [flow.arc(0, node["p", p], pattern_sizes[p], cost) for cost in range(max_repeat)]
        for s in members[p]:
            flow.arc(node["p", p], node["s", s], max_repeat * pattern_sizes[p])
    for s in sources:
        flow.arc(node["s", s], 1, quotas[s])
    flow.run()
    return {p: sum(flow.cap[e ^ 1] for e in tiers[p]) for p in names}


def _source_key(source: Column) -> Column:
    """Text that orders by code point with null last, and tells null from empty."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _keys(docs: DataFrame, source_col: str) -> Column:
    """The sources that list a document, as an array of keys in order."""
    if docs.schema[source_col].dataType.typeName() != "array":
        return F.array(_source_key(docs[source_col]))
    none = F.array(F.lit(None).cast("string"))
    listed = F.when(F.size(docs[source_col]) > 0, docs[source_col]).otherwise(none)
    return F.array_sort(F.array_distinct(F.transform(listed, _source_key)))


def _pattern(keys: Column) -> Column:
    """One text per set of sources; lengths keep any characters of theirs apart."""
    return F.array_join(F.transform(keys, lambda s: F.concat(F.length(s).cast("string"), F.lit(":"), s)), "")


def _hash(docs: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), docs[id_col].cast("bigint"), docs[text_col])


def with_targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """``sources(source, source_size)`` with the target that each gets of the sum of all sizes."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights)).cast("int") + 1)
    limit = F.col("source_size") * float(max_repeat)
    rows = stored(numbered(sources, "no", "source").withColumn("weight", weight).withColumn("limit", limit), "mix-sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        over = F.col("weight") * level >= F.col("limit")
        full, open_ = rows.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not open_:
            break
        level, before = max(level, (total - full) / open_), level
    return rows.select("source", "source_size", F.least(F.col("weight") * level, "limit").alias("target") if level else F.lit(0.0).alias("target"))


def _in_network(patterns: DataFrame, max_patterns: int) -> list[str]:
    """The largest overlapping patterns, within both bounds."""
    kept, arcs = [], 0
    for r in patterns.select("pattern", "size", F.size("sources").alias("arcs")).orderBy(F.desc("size"), "pattern").limit(max_patterns).collect():
        arcs += r["arcs"]
        if arcs > MAX_ARCS:
            break
        kept.append(r["pattern"])
    return kept


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        docs[id_col].cast("bigint").alias("id"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _keys(docs, source_col).alias("sources"),
        _hash(docs, id_col, text_col, seed).alias("h"),
    ).withColumn("pattern", _pattern(F.col("sources")))


def mix_plan(sized: DataFrame, weights: tuple[float, ...], max_repeat: int, max_patterns: int) -> DataFrame:
    """A row per pattern: source_size and target of its first source, base copies, cut: up to this hash one copy more."""
    spark = sized.sparkSession
    patterns = stored(sized.groupBy("pattern", "sources").agg(F.sum("size").alias("size")), "mix-patterns")
    sources = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = with_targets(sources, weights, max_repeat)
    over = patterns.where(F.size("sources") > 1)
    if over.limit(1).count():
        # sources share the size of all documents, each counted once, in proportion to what lists them
        total, listed = patterns.agg(F.sum("size"), F.sum(F.size("sources") * F.col("size"))).first()
        goals = goals.withColumn("target", F.col("target") * (total / listed if listed else 0.0))
    goals = stored(goals, "mix-targets")
    first = goals.withColumnRenamed("source", "first")
    # ``group``: patterns routed as one; those outside the network go with their first source
    single = _pattern(F.array(F.col("first")))
    grouped = patterns.withColumn("first", F.element_at("sources", 1)).withColumn("group", single)
    grouped = grouped.join(sendable(first), "first")
    if over.limit(1).count():
        kept = spark.createDataFrame([(p, 1) for p in _in_network(over, max_patterns)], "pattern string, inside int")
        grouped = grouped.join(F.broadcast(kept), "pattern", "left").withColumn("group", F.when(F.col("inside") == 1, F.col("pattern")).otherwise(F.col("group"))).drop("inside")
    grouped = stored(grouped, "mix-groups")
    groups = grouped.groupBy("group").agg(F.sum("size").alias("size"), F.max("target").alias("target"))
    given = F.least(F.round("target").cast("bigint"), F.col("size") * max_repeat)
    groups = groups.withColumn("given", given)
    inside = grouped.where((F.col("group") == F.col("pattern")) & (F.size("sources") > 1))
    touched = stored(inside.select(F.explode("sources").alias("source")).distinct(), "mix-touched")
    if touched.limit(1).count():
        alone = groups.join(F.broadcast(touched.withColumn("group", _pattern(F.array("source")))), "group")
        rows = alone.select("group", F.array("source").alias("sources"), "size").unionByName(inside.select("group", "sources", "size")).collect()  # within both bounds
        quotas = {r["source"]: round(r["target"]) for r in goals.join(F.broadcast(touched), "source").collect()}
        routed = route({r["group"]: r["size"] for r in rows}, {r["group"]: list(r["sources"]) for r in rows}, quotas, max_repeat)
        flow = spark.createDataFrame(list(routed.items()), "group string, routed bigint")
        groups = groups.join(F.broadcast(flow), "group", "left").withColumn("given", F.coalesce("routed", "given")).drop("routed")
    # rest: words that a further copy of some documents has to give
    base, rest = F.expr("if(size > 0, given div size, 0L)"), F.expr("if(size > 0, given % size, 0L)")
    groups = stored(groups.select("group", base.alias("base"), rest.alias("rest")), "mix-given")
    named = stored(grouped.select("pattern", "group", "source_size", "target").join(sendable(groups), "group"), "mix-named")
    member = sized.select("pattern", "h", "size").join(sendable(named.select("pattern", "group", "rest")), "pattern")
    bucket = F.shiftrightunsigned("h", 64 - HASH_BITS)
    filled = member.groupBy("group", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    upto = W.partitionBy("group").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = (
        filled.withColumn("before", F.sum("size").over(upto) - F.col("size"))
        .where("before <= rest AND rest < before + size")
        .groupBy("group")
        .agg(F.min("bucket").alias("edge"), F.min("before").alias("before"))
    )
    edge = stored(edge, "mix-edge")
    within = member.join(sendable(edge), "group").where(bucket == F.col("edge")).groupBy("group", "h", "rest", "edge", "before").agg(F.sum("size").alias("size"))
    order = W.partitionBy("group").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    taken = within.withColumn("middle", F.col("before") + F.sum("size").over(order) - F.col("size") / 2).where("middle <= rest")
    last = taken.groupBy("group").agg(F.max("h").alias("last"))
    # hashes are compared as unsigned numbers: flipped in their highest bit, as signed ones
    lowest = F.shiftleft(F.col("edge").cast("bigint"), 64 - HASH_BITS).bitwiseXOR(F.lit(-(1 << 63)))
    cut = F.coalesce(_unsigned(F.col("last")), lowest - 1)
    cuts = stored(edge.join(sendable(stored(last, "mix-last")), "group", "left").where((F.col("edge") > 0) | F.col("last").isNotNull()).select("group", cut.alias("cut")), "mix-cuts")
    return stored(named.join(sendable(cuts), "group", "left").select("pattern", "source_size", "target", "base", "cut"), "mix-plan")


def _unsigned(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def _copies(has_words: Column, h: str, base: str, cut: str) -> Column:
    more = F.coalesce((_unsigned(F.col(h)) <= F.col(cut)).cast("bigint"), F.lit(0))
    return F.when(has_words, F.col(base) + more).otherwise(0)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 17,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """id, size, sources (keys), source_size, target, copies, taken per document.

    ``source_col`` is a string, or an array of strings for overlapping sources; source_size and
    target are then those of the document's first source.
    """
    sized = stored(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    joined = sized.join(sendable(mix_plan(sized, weights, max_repeat, max_patterns)), "pattern")
    mixed = joined.withColumn("copies", _copies(F.col("size") > 0, "h", "base", "cut")).withColumn("taken", F.col("size") * F.col("copies"))
    return mixed.select("id", "size", "sources", "source_size", "target", "copies", "taken")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 17,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; texts stay where they are read."""
    sized = stored(_sized(docs, id_col, text_col, source_col, seed).drop("id"), "mix-sizes")
    plan = mix_plan(sized, weights, max_repeat, max_patterns).select(F.col("pattern").alias("_vg_pattern"), "base", "cut")
    plan = plan.withColumnsRenamed({"base": "_vg_base", "cut": "_vg_cut"})
    asked = docs.withColumn("_vg_pattern", _pattern(_keys(docs, source_col))).withColumn("_vg_h", _hash(docs, id_col, text_col, seed))
    copies = _copies(F.coalesce(docs[text_col].rlike(WORD), F.lit(False)), "_vg_h", "_vg_base", "_vg_cut")
    taken = asked.join(sendable(plan), "_vg_pattern").withColumn("_vg_copies", copies).where("_vg_copies > 0")
    each = taken.withColumn("_vg_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_vg_copies")))
    return each.drop("_vg_pattern", "_vg_h", "_vg_base", "_vg_cut", "_vg_copies", "_vg_copy")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
