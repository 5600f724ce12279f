"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint of 64 bits is a ring of ``SEGMENTS`` segments. If two fingerprints
differ in at most t bits, some start on the ring has, for every length l, at most
l * t / SEGMENTS differing bits in the chain of l segments from there. The first
budgets are below one bit, so those segments agree exactly and key a bucket; the
budgets of the longer chains prune pairs before the full Hamming check.

Buckets of up to ``MOST_PAIRED`` fingerprints compare their members. In larger ones
a pair is found by the fingerprint that lies between the two: each member names
itself and all that differ from it in one of the open bits, and members that name
the same are within two bits. That is linear in the bucket's size and spreads it over
as many tasks as wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, may_be_in, release, table
from .components import connected
from .textbytes import IS_SPACE, Texts, chunks, mix, shingles

SEED = 42
SEGMENTS = 16
BITS = 64 // SEGMENTS
MOST_PAIRED = 64
#: Shingles that are hashed and counted at once, so a text of any length takes bounded memory.
BLOCK = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _joined(text: bytes) -> np.ndarray:
    """The bytes of a text in lower case, with one space between words and none at the ends."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    space = IS_SPACE[data]
    data[space] = 0x20
    space[1:] &= space[:-1]  # the first space after a word stays
    data = data[~space]
    return data[:-1] if len(data) and data[-1] == 0x20 else data


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text: words parted by ASCII white space, A-Z in lower case, shingles of ``width`` words, repeats counted."""
    data = _joined(text)
    if not len(data):
        return 0
    gaps = np.flatnonzero(data == 0x20)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    if len(starts) >= width:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, joined = np.zeros(64, np.int64), memoryview(data)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts[at : at + BLOCK]))
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit integer; a text without words, or null, has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, fp bigint")


def _turn(x: Column, by: Column) -> Column:
    """Turn 64 bits to the left."""
    return F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftrightunsigned", x, (F.lit(64) - by) % 64))


def budgets(most: int) -> list[tuple[int, int]]:
    """(bits, budget): chains whose first ``bits`` bits may differ in ``budget`` bits; of equal budgets only the longest chain."""
    longest = {}
    for chain in range(1, SEGMENTS + 1):
        longest[chain * most // SEGMENTS] = chain * BITS
    return sorted((bits, budget) for budget, bits in longest.items())


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): edges between the distinct fingerprints ``fp``, enough to join all that differ in at most ``most`` (1 or 2) bits, and no others."""
    if most not in (1, 2):
        raise ValueError("links() takes 1 or 2 differing bits")
    (exact, _), *wider = budgets(most)
    open_bits = 64 - exact
    starts = F.array(*[F.lit(i * BITS) for i in range(SEGMENTS)])
    turned = distinct.select("fp", F.explode(starts).alias("start")).select("start", _turn(F.col("fp"), F.col("start")).alias("ring"))
    turned = turned.withColumn("key", F.shiftrightunsigned("ring", open_bits).bitwiseOR(F.shiftleft(F.col("start").cast("bigint"), 48)))
    sizes = turned.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Most buckets have one member; what is left is small beside the input.
    met = materialise(turned.join(sizes, "key"), "buckets", small=True)

    few = met.where(F.col("n") <= MOST_PAIRED).groupBy("start", "key").agg(F.collect_list("ring").alias("rings"))
    within = " and ".join(f"bit_count(shiftrightunsigned(x ^ y, {64 - bits})) <= {budget}" for bits, budget in wider)
    close = f"transform(rings, x -> named_struct('x', x, 'ys', filter(rings, y -> y > x and {within or 'true'})))"
    few = few.select("start", F.inline(F.expr(close))).where("size(ys) > 0").select("start", "x", F.explode("ys").alias("y"))

    variants = F.array(F.col("ring"), *[F.col("ring").bitwiseXOR(F.lit(1 << b)) for b in range(open_bits)])
    many = met.where(F.col("n") > MOST_PAIRED).select("start", "ring", F.explode(variants).alias("between"))
    # At most open_bits + 1 fingerprints name the same one.
    many = many.groupBy("start", "between").agg(F.min("ring").alias("x"), F.collect_list("ring").alias("ys")).where("size(ys) > 1")
    many = many.select("start", "x", F.explode("ys").alias("y")).where("x <> y").distinct()
    if most == 1:
        many = many.where("bit_count(x ^ y) <= 1")

    back = (F.lit(64) - F.col("start")) % 64
    return few.unionByName(many).select(_turn(F.col("x"), back).alias("a"), _turn(F.col("y"), back).alias("b"))


def mark(prints: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of a fingerprint table.

    component_id is the smallest doc_id that links reach. Equal fingerprints are one
    node however many rows have them. Null ids count only if a component has no other.
    """
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", small=True)
    roots = connected(links(nodes.select("fp"), most))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialise(joined, "roots", small=True)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def query(spark, sf_dir: str) -> DataFrame:
    prints = materialise(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return mark(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by Jaccard similarity. Texts whose SimHashes reach each other through pigeonring links, as in
# ``mark``, meet in a bucket, and shingle sets decide on every pair in it. Most copies that share 0.8 of their shingles
# differ in 5 to 16 of 64 bits, where no segment need agree, and a repeated line moves the SimHash at will;
# for those there are buckets of MinHash bands as well, in which sketches prune pairs before the sets decide.
# Members of large buckets of either kind are compared by the rarest of their shingles instead, which finds every link among them.

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Members of a bucket that are compared with each other; those of larger ones meet by their rarest shingles.
MOST_MET = 16
BAND_BINS = 128
#: Pairs whose sketches estimate a similarity this far below SIMILARITY, four standard deviations, are dropped unseen.
SLACK = 0.15


def _shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    texts = Texts(_LOWER[texts.data], texts.offsets)
    starts, ends, firsts = texts.words()
    return shingles(texts.hashes(starts, ends), firsts, WIDTH)


def _bands(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text a row of BANDS bucket keys, and four bits of each bin, two bins a byte; of no use for texts without shingles."""
    values = np.full(n * BAND_BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(values, owner * BAND_BINS + (hashes >> np.uint64(57)).astype(np.int64), hashes & np.uint64((1 << 57) - 1))
    values = values.reshape(n, BAND_BINS)
    empty = values == np.uint64(0xFFFFFFFFFFFFFFFF)
    own, row, bin_, attempt = values.copy(), *np.nonzero(empty & ~empty.all(axis=1)[:, None]), 0
    while len(row):
        attempt += 1
        drawn = mix(np.arange(BAND_BINS, dtype=np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt)) % np.uint64(BAND_BINS)
        values[row, bin_] = own[row, drawn[bin_].astype(np.int64)]
        left = empty[row, drawn[bin_].astype(np.int64)]
        row, bin_ = row[left], bin_[left]
    keys = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, np.uint64(b + 1))
        for r in range(ROWS):
            key = mix(key + values[:, b * ROWS + r])
        keys[:, b] = key
    low = (mix(values ^ (np.arange(BAND_BINS, dtype=np.uint64) << np.uint64(57))) & np.uint64(15)).astype(np.uint8)
    return keys, (low[:, 0::2] << 4) | low[:, 1::2]


def _node(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def _check(doc_id: str, text: str) -> Column:
    """A second hash of the same. Groups hold and drop only rows that have the checks of the texts that were compared."""
    return F.xxhash64(F.lit("check"), F.col(text), F.col(doc_id))


def _reached(prints: DataFrame) -> DataFrame:
    """(node, key): the component of SimHash links that each node of (node, fp) is in."""
    return mark(prints.select(F.col("node").alias("doc_id"), "fp")).select(F.col("doc_id").alias("node"), F.col("component_id").alias("key"))


def _shared(rows: DataFrame) -> DataFrame:
    """(key, node, n): the rows of (node, key) whose bucket has n members, two or more."""
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key").select("key", "node", "n")


def _close(met: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of a bucket of up to MOST_MET members."""
    few = met.where(F.col("n") <= MOST_MET).groupBy("key").agg(F.collect_list("node").alias("all"))
    pairs = "transform(all, x -> named_struct('a', x, 'bs', filter(all, y -> y > x)))"
    return few.select(F.inline(F.expr(pairs))).where("size(bs) > 0").select("a", F.explode("bs").alias("b")).distinct()


def _rarest(shingles_: DataFrame) -> DataFrame:
    """(token, node, size, place): of each set, put in order of how many sets hold a shingle, those first places that decide.

    Two sets of SIMILARITY or more share one of their first size - ceil(SIMILARITY * size) + 1. Shingles of one set alone count as
    places but meet nothing. A copy whose own changes fill these places has no row left, so a large
    group of loose copies is not compared within itself.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "shingles", 1 << 20):
                sizes = pc.binary_length(part.column("shingles")).to_numpy() // 8
                nodes = np.repeat(part.column("node").to_numpy(), sizes)
                tokens = np.frombuffer(b"".join(part.column("shingles").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.repeat(sizes, sizes), pa.int32()), pa.array(tokens)], ["node", "size", "token"])

    tokens = map_arrow(shingles_, unpack, "node bigint, size int, token bigint")
    holders = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy("node").orderBy("holders", "token")
    placed = tokens.join(holders, "token").withColumn("place", F.row_number().over(order) - 1)
    first = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1
    return placed.where((F.col("place") < first) & (F.col("holders") > 1)).select("token", "node", "size", "place")


def _within_reach(x: str, y: str) -> Column:
    """Whether two sets that share a shingle can still reach SIMILARITY: at the first they share, all that they share comes from there on."""
    left = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
    return left * (1 + SIMILARITY) >= (F.col(f"{x}.size") + F.col(f"{y}.size")) * SIMILARITY - 1e-9


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _hub_pairs(rarest: DataFrame) -> DataFrame:
    """(a, b): of each shingle the member that has it at the first place, like to be what the others were copied from, with the others."""
    hubs = rarest.groupBy("token").agg(F.min(F.struct("place", "node", "size")).alias("hub")).select("token", "hub.*")
    met = rarest.alias("x").join(hubs.alias("y"), "token").where((F.col("x.node") != F.col("y.node")) & _within_reach("x", "y"))
    return met.select(_ordered("x", "y")).distinct()


def _open_pairs(rarest: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): all pairs that share a shingle of ``rarest``, may reach SIMILARITY and have different roots so far; and the tables it reads.

    Those of a shingle's most frequent root meet the others only, never each other.
    """
    known = rarest.join(roots, "node", "left").select("token", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    known = materialise(known, "known", small=True)
    by_root = known.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    most = by_root.groupBy("token").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
    open_ = materialise(known.join(most.select("token", F.col("most.root").alias("most")), "token"), "open", small=True)
    rest = open_.where("root <> most")
    new = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.most")) | (F.col("x.node") < F.col("y.node")))
    met = rest.alias("x").join(open_.alias("y"), (F.col("x.token") == F.col("y.token")) & new & _within_reach("x", "y"))
    return met.select(_ordered("x", "y")).distinct(), [known, open_]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The groups (node, check, doc_id, component_id, first) of two documents or more whose links reach each other, and the nodes of repeated rows.

    A link is a pair that meets in a component of SimHash links or a bucket of bands and whose sets of five-word shingles, A-Z in
    lower case, have a Jaccard similarity of SIMILARITY or more. node and check are hashes of doc_id and text, so rows that repeat both are one document; the second
    table has (node, check) of those with more than one row. component_id is the smallest doc_id of the group, null if all are null;
    ``first`` marks the one document with it, of equal ids that with the least node. Texts without words have no links.
    """
    base = docs.select(_node(doc_id, text).alias("node"), _check(doc_id, text).alias("check"), F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n = part.num_rows
                hashes, owner = _shingle_sets(Texts.arrow(part.column("text")))
                some = np.bincount(owner, minlength=n) > 0
                keys, low = _bands(hashes, owner, n)
                prints = [fingerprint(x.as_buffer().to_pybytes(), 3) for x in part.column("text").cast(pa.binary())]
                columns = [part.column("node"), part.column("check"), pa.array(prints, pa.int64()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary())]
                out = pa.RecordBatch.from_arrays(columns, ["node", "check", "fp", "keys", "low"])
                yield out.filter(pa.array(some))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BAND_BINS // 2) for c in ("x", "y"))
            differ = x ^ y
            alike = ((differ & 15) == 0).mean(axis=1) / 2 + ((differ >> 4) == 0).mean(axis=1) / 2
            yield batch.filter(pa.array((alike - 1 / 16) / (1 - 1 / 16) >= SIMILARITY - SLACK)).select(["a", "b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, owner = _shingle_sets(Texts.arrow(part.column("text")))
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                found = [np.unique(hashes[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("node", "check", "doc_id")], pa.array(found, pa.binary())], ["node", "check", "doc_id", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)) else 0
                alike.append(both >= SIMILARITY * (len(x) + len(y) - both))
            yield batch.filter(pa.array(alike, pa.bool_())).select(["a", "b"])

    prints = materialise(map_arrow(base, sketch, "node bigint, check bigint, fp bigint, keys array<bigint>, low binary"), "sketches")
    twins = materialise(prints.groupBy("node", "check").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node", "check"), "twins", small=True)
    one = prints.dropDuplicates(["node"]) if not twins.isEmpty() else prints
    reached = materialise(_shared(_reached(one)), "reached", small=True)
    low = one.select("node", "low")
    rows = one.select("node", F.explode("keys").alias("key"))
    met = materialise(_shared(rows), "bands", small=True)
    many = met.unionByName(reached).where(F.col("n") > MOST_MET).select("node").distinct()
    close = _close(met).join(low.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
    pairs = materialise(map_arrow(close, likely, "a bigint, b bigint").unionByName(_close(reached)).distinct(), "pairs", small=True)
    release(prints)
    nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(many).distinct(), "nodes", small=True)
    # Only texts that the bitmap hits are shingled and shuffled.
    wanted = base.where(may_be_in(nodes)(F.col("node")))
    found = map_arrow(wanted, sets, "node bigint, check bigint, doc_id bigint, shingles binary").join(nodes, "node", "left_semi")
    found = materialise(found.dropDuplicates(["node"]), "shingles", small=True)

    def linked(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        return map_arrow(joined, verify, "a bigint, b bigint")

    rarest = materialise(_rarest(found.join(many, "node", "left_semi")), "rarest", small=True)
    release(met, reached, nodes)
    roots = materialise(connected(linked(pairs.unionByName(_hub_pairs(rarest)).distinct())), "roots", small=True)
    open_pairs, read = _open_pairs(rarest, roots)
    more = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked(open_pairs)))
    named = materialise(more.join(found.select("node", "check", "doc_id"), "node"), "named", small=True)
    release(pairs, rarest, roots, found, *read)
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"))
    found = named.join(least, "root").select("node", "check", "doc_id", F.col("least.doc_id").alias("component_id"), (F.col("node") == F.col("least.node")).alias("first"))
    return found, twins


def _unused(docs: DataFrame, name: str) -> str:
    return name if name not in docs.columns else _unused(docs, name + "_")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of near copies.

    The document with the smallest doc_id stays, a null id counts as larger than any other, and of equal ids
    one stays too. Of rows that repeat both doc_id and text one stays. Null and empty texts, and those without words, have no
    near copies and all stay; an empty table gives no rows. Rows that the losers' bitmap doesn't hit stay without a shuffle.
    """
    found, twins = near_duplicates(docs, doc_id, text)
    losers = materialise(found.where(~F.col("first")).select("node", "check").distinct(), "losers", small=True)
    node, check = _unused(docs, "__node"), _unused(docs, "__check")
    of = lambda d: d.select(F.col("node").alias(node), F.col("check").alias(check))
    gone = may_be_in(losers.unionByName(twins))
    keyed = docs.withColumns({node: _node(doc_id, text), check: _check(doc_id, text)})
    clear, doubtful = keyed.where(~gone(F.col(node))), keyed.where(gone(F.col(node)))
    left = doubtful.join(of(losers), [node, check], "left_anti")
    if not twins.isEmpty():
        repeated = left.join(of(twins), [node, check], "left_semi").groupBy(node, check).agg(F.first(F.struct(*docs.columns)).alias("row"))
        left = left.join(of(twins), [node, check], "left_anti").unionByName(repeated.select(node, check, "row.*"))
    return clear.unionByName(left).drop(node, check)
