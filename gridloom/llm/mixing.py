"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them).
Token capacity then flows from patterns to the quotas of their sources; each further
repetition of a pattern costs more than the one before, so the flow repeats text
only where a quota can't be met otherwise. The flow's network has one node a pattern and
one a source, whatever the number of documents.

The documents of a pattern lie on a line in the order of a seeded hash, and a flow is a
stretch of that line. Where a stretch ends is found as a hash value by a radix search:
each round sums sizes under the next digit of the hash, so the choice needs no global
sort and reduces to comparing a row's hash with a few thresholds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import local, map_arrow, materialise, release, table
from .textbytes import Texts, chunks

MOST_REPEATS = 3
#: Cost of a word's first, second and third use.
REPEAT_COSTS = (0, 1, 3)
SEED = 20240607
DIGIT_BITS = 12
#: Patterns and sources live on the driver up to this number. More sources without overlap are mixed by DataFrame plans instead;
#: only more patterns of overlapping sources are refused.
MOST_PATTERNS = 20_000


def weighted_targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of the total by weight; a share stops at ``most`` times its source's size and the excess is shared again."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...] = REPEAT_COSTS) -> list[dict[int, int]]:
    """For each pattern (member sources, words) the words that it sends to each source.

    Each source takes at most its quota, each pattern gives at most len(costs) times its words, at the least total
    cost. Patterns that no chain of shared sources joins are networks of their own.
    """
    parts, root = {}, list(range(len(quotas)))

    def find(s: int) -> int:
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    for p, (members, _) in enumerate(patterns):
        parts.setdefault(find(members[0]), []).append(p)
    out: list[dict[int, int]] = [{}] * len(patterns)
    for part in parts.values():
        sources = sorted({s for p in part for s in patterns[p][0]})
        at = {s: i for i, s in enumerate(sources)}
        found = _flow([(tuple(at[s] for s in patterns[p][0]), patterns[p][1]) for p in part], [quotas[s] for s in sources], costs)
        for p, flow in zip(part, found, strict=True):
            out[p] = {sources[i]: words for i, words in flow.items()}
    return out


def _flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...]) -> list[dict[int, int]]:
    """A network's flow by successive shortest paths with potentials."""
    n_p = len(patterns)
    source, sink = 0, 1 + n_p + len(quotas)
    graph: list[list[list[int]]] = [[] for _ in range(sink + 1)]  # each arc: to, capacity, cost, index of its reverse

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (members, words) in enumerate(patterns):
        for cost in costs:
            arc(source, 1 + p, words, cost)
        for s in members:
            arc(1 + p, 1 + n_p + s, len(costs) * words, 0)
    for s, quota in enumerate(quotas):
        arc(1 + n_p + s, sink, quota, 0)
    potential = [0] * (sink + 1)
    while True:
        far, into, queue = [None] * (sink + 1), [None] * (sink + 1), [(0, source)]
        far[source] = 0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, capacity, cost, _) in enumerate(graph[a]):
                reach = d + cost + potential[a] - potential[b]
                if capacity and (far[b] is None or reach < far[b]):
                    far[b], into[b] = reach, (a, k)
                    heapq.heappush(queue, (reach, b))
        if far[sink] is None:
            break
        for v, d in enumerate(far):
            potential[v] += far[sink] if d is None else min(d, far[sink])
        path, at = [], sink
        while at != source:
            a, k = into[at]
            path.append((a, k))
            at = a
        step = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            graph[a][k][1] -= step
            graph[graph[a][k][0]][graph[a][k][3]][1] += step
    return [{b - 1 - n_p: graph[b][back][1] for b, _, _, back in graph[1 + p] if b > n_p and graph[b][back][1]} for p in range(n_p)]


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``words``: the number of words of the whole text, 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, 1 << 24):
                starts, _, firsts = Texts.arrow(part.column(text)).words()
                counts = pa.array(firsts[1:] - firsts[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts], [*part.schema.names, "words"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("words", T.LongType())]))


def line(seed: int, doc_id: str, text: str) -> Column:
    """A document's place on its pattern's line: a seeded hash of its id and text. Rows that repeat both share a place."""
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))


@dataclass
class Mix:
    """What was decided for a corpus: rows for each pattern, and how many uses a document at a place gets from each stretch."""

    sources: list
    sizes: list[int]
    targets: list[Fraction]
    patterns: list[tuple]  # source positions
    words: list[int]
    flows: list[dict[int, int]]
    cuts: list[list[tuple[int, int, int]]]  # of each pattern: (repetition, first place that is past the cut, source before it)


def _frame(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A small table of the driver's, a column for each kind."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return local(spark, {name: pa.array(list(x), kind) for (name, kind), x in zip(kinds.items(), columns, strict=True)})


def _unsigned(place: Column) -> Column:
    """Flip the sign bit: the order of these is the order of the places as signed integers."""
    return place.bitwiseXOR(F.lit(-(1 << 63)))


def _thresholds(slim: DataFrame, wanted: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """For each (pattern, cut) the first place whose documents end past it, to the nearest document.

    ``slim`` has pattern, place (digits from the top: flipped sign) and words.
    """
    spark = slim.sparkSession
    found: dict[tuple[int, int], int] = {}
    state = {key: (0, 0, cut) for key, cut in wanted.items()}  # prefix of the place, its bits, words still to pass within it
    while state:
        rows = [(p, k, prefix, bits) for (p, k), (prefix, bits, _) in state.items()]
        bits = rows[0][3]
        take = min(DIGIT_BITS, 64 - bits)
        now = _frame(spark, rows, pattern=pa.int32(), cut=pa.int32(), prefix=pa.int64(), bits=pa.int32())  # a row for each cut
        digit = F.shiftrightunsigned(F.shiftleft("place", bits), 64 - take)
        above = F.shiftrightunsigned("place", 64 - bits) if bits else F.lit(0).cast("bigint")
        sums = slim.withColumn("prefix", above).join(F.broadcast(now), ["pattern", "prefix"]).groupBy("pattern", "cut", digit.alias("digit"))
        sums = sums.agg(F.sum("words").alias("words"))
        order = Window.partitionBy("pattern", "cut").orderBy("digit")  # at most 2 ** DIGIT_BITS rows each
        sums = sums.select("pattern", "cut", "digit", "words", (F.sum("words").over(order) - F.col("words")).alias("before"))
        cuts = _frame(spark, [(p, k, left) for (p, k), (_, _, left) in state.items()], pattern=pa.int32(), cut=pa.int32(), left=pa.int64())
        hit = sums.join(F.broadcast(cuts), ["pattern", "cut"]).where("before <= left and left < before + words").collect()
        passed = {(r.pattern, r.cut): r for r in hit}
        new = {}
        for key, (prefix, _, left) in state.items():
            if key not in passed:
                found[key] = 1 << 64  # all of them lie before the cut
                continue
            r = passed[key]
            at = (prefix << take) | r.digit
            if bits + take == 64:
                found[key] = at + (2 * (left - r.before) >= r.words)
            else:
                new[key] = (at if at < 1 << 63 else at - (1 << 64), bits + take, left - r.before)
        state = new
    return found


def decide(slim: DataFrame, weights: list[int] | None = None) -> Mix:
    """Solve the mix for rows (members: array of sources, place, words).

    Sources in the order of their code points, null last, weigh 1, 2, 3 and so on
    again unless ``weights`` are given in that order.
    """
    spark = slim.sparkSession
    sums = slim.groupBy("members").agg(F.sum("words").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    sources = sorted({s for r in sums for s in r.members}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(sources)}
    sums = sorted((tuple(sorted(index[s] for s in r.members)), r.words) for r in sums)
    patterns, words = [p for p, _ in sums], [w for _, w in sums]
    sizes = [sum(w for p, w in sums if i in p) for i in range(len(sources))]
    weights = weights or [1 + i % 3 for i in range(len(sources))]
    total = sum(words)
    targets = weighted_targets(sizes, weights) if len(patterns) == len(sources) and total == sum(sizes) else _scaled(sizes, weights, total)
    flows = min_cost_flow(sums, [round(t) for t in targets])
    wanted, plan = {}, []
    for p, flow in enumerate(flows):
        at, cuts = 0, []
        for s in sorted(flow):
            at += flow[s]
            cuts.append((min(at // words[p], MOST_REPEATS), at - words[p] * min(at // words[p], MOST_REPEATS), s))
        for k, (_, rest, _) in enumerate(cuts):
            if rest:
                wanted[p, k] = rest
        plan.append(cuts)
    found = {}
    if wanted:
        keys = _frame(spark, [([sources[i] for i in p], n) for n, p in enumerate(patterns)], members=pa.list_(pa.string()), pattern=pa.int32())
        placed = slim.join(F.broadcast(keys.select(F.to_json("members").alias("key"), "pattern")), F.to_json(slim.members) == F.col("key"))
        found = _thresholds(placed.where("words > 0").select("pattern", _unsigned(F.col("place")).alias("place"), "words"), wanted)
    cuts = [[(e, found.get((p, k), 0), s) for k, (e, _, s) in enumerate(c)] for p, c in enumerate(plan)]
    return Mix(sources, sizes, targets, patterns, words, flows, cuts)


def _scaled(sizes: list[int], weights: list[int], total: int) -> list[Fraction]:
    """Targets of overlapping sources: 100 % of the distinct words, by weight, none above the limit."""
    share = weighted_targets(sizes, weights)
    whole = sum(share)
    return [t * total / whole if whole else t for t in share]


def uses(mix: Mix, rows: DataFrame) -> DataFrame:
    """``rows`` (members, place and any more columns) with ``taken``: array of (source position, times)."""
    spark = rows.sparkSession
    plan = []
    for p, members in enumerate(mix.patterns):
        stretches = []
        for e, past, s in mix.cuts[p]:
            stretches.append((e, past - (1 << 63) if past < 1 << 64 else None, s))
        plan.append(([mix.sources[i] for i in members], stretches))
    stretch = pa.list_(pa.struct([("e", pa.int32()), ("past", pa.int64()), ("source", pa.int32())]))
    plan = [(members, [dict(zip(("e", "past", "source"), x, strict=True)) for x in stretches]) for members, stretches in plan]
    plan = _frame(spark, plan, members=pa.list_(pa.string()), stretches=stretch).select(F.to_json("members").alias("key"), "stretches")
    # A document's use number e lies before a cut if e < cut.e, or e == cut.e and its place is before cut.past.
    before = "(x.e > e or (x.e = e and (x.past is null or place < x.past)))"
    use = f"transform(sequence(0, {MOST_REPEATS - 1}), e -> element_at(filter(stretches, x -> {before}).source, 1))"
    joined = rows.join(F.broadcast(plan), F.to_json(rows.members) == F.col("key"), "left")
    used = F.filter(F.expr(use.replace("element_at(", "get(").replace(", 1))", ", 0))")), lambda s: s.isNotNull())
    return joined.withColumn("used", F.coalesce(used, F.array().cast("array<int>"))).drop("key", "stretches")


@dataclass
class ManyMix:
    """The mix of more sources than the driver should hold, none of which overlap: ``about`` has a row a source."""

    about: DataFrame  # source, words, weight, target, quota
    written: list[DataFrame] = field(default_factory=list)


def decide_many(slim: DataFrame) -> ManyMix:
    """``decide`` for rows of one source each, as DataFrames throughout: exact, whatever the number of sources."""
    spark = slim.sparkSession
    sums = slim.groupBy(F.col("members")[0].alias("source")).agg(F.sum("words").alias("words"))
    # In the order of code points, null last: a sort by ranges, then each range's rows before it.
    sorted_ = sums.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranked = materialise(sorted_.withColumn("id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("id", 33).cast("int")
    counts = sorted((r.part, r.n) for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    before = [(p, sum(n for q, n in counts if q < p)) for p, _ in counts]
    offsets = _frame(spark, before, part=pa.int32(), before=pa.int64())
    rank = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sources = ranked.withColumn("part", part).join(F.broadcast(offsets), "part").select("source", "words", (1 + F.pmod(rank, F.lit(3))).cast("bigint").alias("weight"))
    sources = materialise(sources, "weights")
    # A share stops at MOST_REPEATS times its source: a round takes out those that the present unit passes.
    all_words, all_weights = sources.agg(F.sum("words"), F.sum("weight")).first()
    left, weights = all_words, all_weights
    unit = "cast(weight as decimal(38,0)) * {left} > cast(words as decimal(38,0)) * {most} * {weights}"
    while weights:
        over = F.expr(unit.format(left=left, weights=weights, most=MOST_REPEATS))
        full = sources.where(over).agg(F.sum("words"), F.sum("weight")).first()
        before_, (left, weights) = (left, weights), (all_words - MOST_REPEATS * (full[0] or 0), all_weights - (full[1] or 0))
        if (left, weights) == before_:
            break
    over = F.expr(unit.format(left=left, weights=max(weights, 1), most=MOST_REPEATS)) if weights else F.lit(True)
    share = F.col("weight").cast("double") * left / max(weights, 1)
    whole = F.expr(f"cast((2 * cast(weight as decimal(38,0)) * {left} + {max(weights, 1)}) div (2 * {max(weights, 1)}) as bigint)")
    target = F.when(over, (MOST_REPEATS * F.col("words")).cast("double")).otherwise(share)
    quota = F.when(over, MOST_REPEATS * F.col("words")).otherwise(whole)
    about = materialise(sources.select("source", "words", "weight", target.alias("target"), quota.alias("quota")), "targets")
    return ManyMix(about, [ranked, sources, about])


def uses_many(mix: ManyMix, rows: DataFrame) -> DataFrame:
    """``rows`` (members, place, words and any more columns) with ``times``, ``source_size`` and ``target``.

    A large source's cut is found by the radix search like any other; there are at most MOST_PATTERNS of those, and
    each of the others has a smaller part of all rows than 1 / MOST_PATTERNS, so a window a source is bounded by that part.
    """
    spark = rows.sparkSession
    about = mix.about.select("source", F.col("words").alias("source_size"), "target", F.when(F.col("words") > 0, F.expr("quota div words")).otherwise(F.lit(0)).cast("int").alias("e"), F.when(F.col("words") > 0, F.col("quota") % F.col("words")).otherwise(F.lit(0)).alias("rest"))
    sizes = rows.groupBy(F.col("members")[0].alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    told = about.withColumnRenamed("source", "of")
    large = sizes.orderBy(F.desc("rows"), "source").limit(MOST_PATTERNS).join(told, F.col("source").eqNullSafe(F.col("of"))).select("source", "e", "rest").collect()  # at most MOST_PATTERNS rows
    pattern = _frame(spark, [(r.source, n) for n, r in enumerate(large)], source=pa.string(), pattern=pa.int32())
    keyed = rows.withColumn("source", F.col("members")[0])
    placed = keyed.join(F.broadcast(pattern.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).where("words > 0").select("pattern", _unsigned(F.col("place")).alias("place"), "words")
    found = _thresholds(placed, {(n, 0): r.rest for n, r in enumerate(large) if r.rest})
    cuts = [(r.source, None if found.get((n, 0), 0) >= 1 << 64 else found.get((n, 0), 0) - (1 << 63)) for n, r in enumerate(large)]
    cuts = _frame(spark, cuts, of=pa.string(), past=pa.int64()).withColumn("is_large", F.lit(True))
    joined = keyed.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    joined = joined.join(told, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    big, small = joined.where(F.col("is_large")), joined.where(F.col("is_large").isNull())
    big = big.withColumn("times", F.col("e") + ((F.col("rest") > 0) & (F.col("past").isNull() | (F.col("place") < F.col("past")))).cast("int"))
    order = Window.partitionBy("source").orderBy("place")
    up_to = F.sum("words").over(order.rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum("words").over(Window.partitionBy("source", "place"))
    inside = (F.col("up_to") <= F.col("rest")) | ((F.col("up_to") - F.col("same") <= F.col("rest")) & (2 * (F.col("rest") - F.col("up_to") + F.col("same")) >= F.col("same")))
    small = small.withColumns({"up_to": up_to, "same": same}).withColumn("times", F.col("e") + ((F.col("rest") > 0) & inside).cast("int")).drop("up_to", "same")
    return big.unionByName(small).drop("is_large", "past", "e", "rest", "source")


def _are_many(slim: DataFrame) -> bool:
    """Whether there are more than MOST_PATTERNS patterns, none of them of two sources or more."""
    if slim.select("members").distinct().limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS:
        return False
    return slim.where(F.size("members") > 1).isEmpty()


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("members"), line(SEED, "doc_id", "text").alias("place"))
    slim = materialise(sized(docs).drop("text"), "sizes")
    if _are_many(slim):
        rows = uses_many(decide_many(slim), slim)
        return rows.select("doc_id", F.col("words").alias("size"), "source_size", "target", (F.col("words") * F.col("times")).alias("taken"))
    mix = decide(slim)
    about = [(mix.sources[i], mix.sizes[i], float(mix.targets[i])) for i in range(len(mix.sources))]
    about = _frame(spark, about, source=pa.string(), source_size=pa.int64(), target=pa.float64()).select(F.to_json(F.array("source")).alias("of"), "source_size", "target")
    rows = uses(mix, slim)
    rows = rows.join(F.broadcast(about), F.to_json("members") == F.col("of"))
    return rows.select("doc_id", F.col("words").alias("size"), "source_size", "target", (F.col("words") * F.size("used")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix uses it.

    A null text has no words and isn't used unless its source is; a null source is a source of its own, the last. Rows that repeat
    doc_id and text share a place on the line and so their uses. An empty table gives no rows.
    """
    placed = docs.select(F.struct(*docs.columns).alias("doc"), F.array(F.col(source).cast("string")).alias("members"), line(SEED, doc_id, text).alias("place"))
    slim = materialise(sized(placed.select(F.col(f"doc.{text}").alias("text"), "members", "place")).drop("text"), "sizes")
    if slim.isEmpty():
        return docs
    if _are_many(slim):
        rows = sized(placed.withColumn("text", F.col(f"doc.{text}"))).drop("text")
        return uses_many(decide_many(slim), rows).where("times > 0").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc.*")
    return uses(decide(slim), placed).select("doc", F.explode("used")).select("doc.*")
