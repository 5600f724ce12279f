"""WARC archives and the external merge of their capture index.

Pages are written as WARC 1.1 records, each a gzip member of its own, with equal payloads
after the first kept as revisit records. Reading an archive back gives a capture
run: its records' index entries, sorted by URL key, timestamp and record. Runs are cut at
the bounds of index ranges, and the segments of a range are merged by a loser tree,
so the ranges in turn are the globally ordered capture histories. A range is bounded by the whole
sort key, so one URL may span many of them.

The merge is external: a segment comes to it in blocks, and a range's blocks come in the order of
their first keys, which Spark sorts. A block names the first key of its run's next one, so the tree
knows every head before it is read and asks for a block only when its turn has come: then
it is the next to arrive. What a task holds is a key a run and at most one block of each.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local, map_arrow, materialise, may_be_in, new_path, shuffle_partitions, table

#: An archive is closed when it has so many records or bytes, so that it is read whole in bounded memory; a longer record has one of its own.
MOST_IN_FILE, MOST_BYTES = 4096, 16 << 20
#: Captures in a range of the index, about, and keys for each range that the ranges are drawn from.
IN_RANGE, SAMPLED = 1 << 18, 50
#: Captures in a block of a run.
IN_BLOCK = 256
#: Captures that leave the merge together.
IN_OUT = 4096
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CHUNK = 1 << 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The URL's host, its parts reversed, then its path and query, in lower case; no scheme, www or standard port."""
    rest = (url or "").strip().partition("#")[0]
    rest = rest.partition("://")[2] or rest
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path.lower()


def stamp(page_id: int | None) -> str:
    """The capture time of a page, which the table lacks: EPOCH and a second for each id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record as gzip members. The last byte is always 0."""
    http = _HTTP % len(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {stamp(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    member = _gzip("\r\n".join(lines).encode() + block + b"\r\n\r\n")
    # A member ends with its length's high byte; an empty member has 0 there.
    return member if member[-1] == 0 else member + _gzip(b"")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records(archive: memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        start, parts, unpack = at, [], zlib.decompressobj(31)
        while not unpack.eof:
            piece = archive[at : at + _CHUNK]
            if not len(piece):
                raise ValueError(f"the archive ends within the record at {start}")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        data = b"".join(parts)
        if not data:
            continue  # the empty member after a long record
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield start, headers, rest[: int(headers["Content-Length"])]


def write(pages: DataFrame, to: str, least: int = 0) -> None:
    """Write a record per row (page_id, url, html) to archives under ``to``.

    Of records whose payloads are equal and have ``least`` bytes or more, that with the
    largest page_id is a response and the others revisit it; smaller ones are all responses.
    A null html is an empty payload. Rows that tie for the largest id are all
    responses; a null id is smaller than any other.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("same", F.unhex(F.sha2("payload", 256)))
    # Only pages whose payload repeats are shuffled: digests alone tell which may be.
    repeats = base.groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("same", "first")
    repeats = materialise(repeats.withColumn("node", F.xxhash64("same")), "repeats", small=True)
    may_repeat = may_be_in(repeats)
    hit = base.where(may_repeat(F.xxhash64("same"))).join(repeats.select("same", "first"), "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("payload") >= least)
    columns = ["page_id", "url", "payload", "first", "revisit"]
    alone = base.where(~may_repeat(F.xxhash64("same"))).withColumns({"first": F.col("page_id"), "revisit": F.lit(False)})
    joined = hit.withColumn("revisit", revisit).select(columns).unionByName(alone.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(made)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
                one = record(*row)
                if made and (size + len(one) > MOST_BYTES or len(made) == MOST_IN_FILE):
                    yield archive()
                    made, size = [], 0
                made.append(one)
                size += len(one)
        if made:
            yield archive()

    # Spark's own writer makes the files, so any store it knows will do: a row is an archive, the separator its last byte.
    rows = map_arrow(joined, run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(to)


FIELDS = ("urlkey", "timestamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset")
_KINDS = ("string", "string", "bigint", "bigint", "string", "string", "bigint", "string", "bigint")
_ARROW = {"string": pa.string(), "bigint": pa.int64()}
Key = tuple[str, str, int]


def _page(uri: str) -> int | None:
    said = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if said == "None" else int(said)


def capture(file: str, offset: int, headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"{file}: the payload of the record at {offset} isn't what was written")
    when = headers["WARC-Date"].translate({ord(c): None for c in "-:TZ"})
    return url_key(headers.get("WARC-Target-URI")), when, _page(headers["WARC-Record-ID"]), size, said, headers["WARC-Type"], _page(headers["WARC-Refers-To"]) if revisit else None, file, offset


def order(row: tuple) -> Key:
    """URL key, timestamp, record, then place in the archives."""
    return (row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8])


class Run:
    """A sorted run in memory."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows
        self.row = next(rows, None)

    @property
    def key(self) -> Key | None:
        """The head's key, None at the end."""
        return None if self.row is None else order(self.row)

    def take(self) -> tuple:
        row, self.row = self.row, next(self.rows, None)
        return row


class BlockRun:
    """A sorted run whose blocks are read when their first row is taken; ``fetch(run)`` gives a block's rows and the next one's first key."""

    def __init__(self, key: Key, fetch: Callable):
        self.key: Key | None = key
        self.fetch, self.rows, self.at, self.then = fetch, [], 0, key

    def take(self) -> tuple:
        if self.at == len(self.rows):
            (self.rows, self.then), self.at = self.fetch(self), 0
        row = self.rows[self.at]
        self.at += 1
        self.key = order(self.rows[self.at]) if self.at < len(self.rows) else self.then
        return row


class LoserTree:
    """Merge sorted runs. Inner nodes hold the losers of their matches, so a step replays one leaf's path: log2(k) comparisons."""

    def __init__(self, runs: list[Run | BlockRun]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.keys = [r.key for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._play()

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self) -> int:
        """Play all matches, from the leaves up; leaf i is node k + i."""
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winners[1] if self.k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.keys[self.winner] is not None:
            now = self.winner
            yield self.runs[now].take()
            self.keys[now] = self.runs[now].key
            node = (now + self.k) // 2
            while node:
                if self._beats(self.losers[node], now):
                    self.losers[node], now = now, self.losers[node]
                node //= 2
            self.winner = now


def _bounds(pages: DataFrame, ranges: int) -> list[Key]:
    """Keys that cut the index to ``ranges`` about equal ranges, from a sample of SAMPLED a range."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(SAMPLED * ranges).collect()
    keys = sorted((url_key(r.url), stamp(r.page_id).translate({ord(c): None for c in "-:TZ"}), -1 if r.page_id is None else r.page_id, "", 0) for r in rows)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def ranges_of(pages: DataFrame) -> int:
    """As many ranges as IN_RANGE captures each call for, and one for each shuffle partition at least."""
    return max(shuffle_partitions(pages.sparkSession), -(-pages.count() // IN_RANGE))


_KEY = ("string", "string", "bigint", "string", "bigint")


def _blocks(number: int, rows: list[tuple]) -> list[tuple]:
    """A segment's rows for the merge: (range, kind, first key, next key, captures). First one of kind 0, which announces the run; then its blocks, of kind 1."""
    firsts = [order(rows[k]) for k in range(0, len(rows), IN_BLOCK)] + [None]
    out = [(number, 0, *firsts[0], *firsts[0], [])]
    for k, (first, then) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        out.append((number, 1, *first, *(then or (None,) * 5), rows[k * IN_BLOCK : (k + 1) * IN_BLOCK]))
    return out


def index(spark: SparkSession, archives: str, bounds: list[Key]) -> DataFrame:
    """Every capture of the archives with ``position`` in the global order and ``visit`` in its URL's history, both from 0.

    Captures that tie in URL key, timestamp and record are in the order of their places in the archives. No archives give no rows.
    """
    from bisect import bisect_left

    firsts, thens = [f"first{k}" for k in range(5)], [f"then{k}" for k in range(5)]
    kinds = dict(zip([*firsts, *thens], _KEY * 2, strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run = [capture(file, *r) for r in records(memoryview(content.as_buffer()))]
                run.sort(key=order)
                keys = [order(r) for r in run]
                cuts = [0, *(bisect_left(keys, b) for b in bounds), len(run)]
                rows = [row for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b for row in _blocks(n, run[a:b])]
                columns = list(zip(*rows, strict=True)) or [()] * 13
                found = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32())]
                found += [pa.array(column, _ARROW[kind]) for column, kind in zip(columns[2:12], kinds.values(), strict=True)]
                found += [pa.array([[r[k] for r in part] for part in columns[12]], pa.list_(_ARROW[kind])) for k, kind in enumerate(_KINDS)]
                yield pa.RecordBatch.from_arrays(found, ["range", "kind", *kinds, *FIELDS])

    segments = ", ".join(f"{name} array<{kind}>" for name, kind in zip(FIELDS, _KINDS, strict=True))
    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    keyed = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    runs = map_arrow(files, cut, f"range int, kind int, {keyed}, {segments}")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                for k in range(0, batch.num_rows, 16):
                    yield from zip(*(batch.column(c).slice(k, 16).to_pylist() for c in range(batch.num_columns)), strict=True)

        rows = stream()
        waiting = next(rows, None)  # the next row that no run has taken

        def fetch(run: BlockRun) -> tuple[list[tuple], Key | None]:
            nonlocal waiting
            if waiting is None or waiting[1] != 1 or waiting[2:7] != run.then:
                raise ValueError("a block is missing or out of order")
            block, waiting = waiting, next(rows, None)
            return list(zip(*block[12:], strict=True)), None if block[7] is None else block[7:12]

        while waiting is not None:
            number, heads = waiting[0], []
            while waiting is not None and waiting[:2] == (number, 0):
                heads.append(BlockRun(waiting[2:7], fetch))
                waiting = next(rows, None)
            place, visit, last, out = 0, -1, None, []
            for row in LoserTree(heads):
                visit = visit + 1 if row[0] == last else 0
                last = row[0]
                out.append((number, place, visit, *row))
                place += 1
                if len(out) == IN_OUT:
                    yield sorted_batch(out)
                    out = []
            if out:
                yield sorted_batch(out)

    def sorted_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), *(_ARROW[kind] for kind in _KINDS)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in columns], ["range", "place", "visit", *FIELDS])

    plain = ", ".join(f"{name} {kind}" for name, kind in zip(FIELDS, _KINDS, strict=True))
    dealt = runs.repartition(max(1, min(len(bounds) + 1, shuffle_partitions(spark))), "range").sortWithinPartitions("range", "kind", *firsts)
    found = materialise(map_arrow(dealt, merge, f"range int, place bigint, visit bigint, {plain}"), "captures")

    ends = found.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min_by("urlkey", "place").alias("first"), F.max_by(F.struct("urlkey", "visit"), "place").alias("last"))
    before, carried, last, plan = 0, 0, None, []
    for r in sorted(ends.collect(), key=lambda r: r.range):  # a row a range
        carried = carried if r.first == last else 0
        plan.append((r.range, before, r.first, carried))
        before += r.n
        carried = r.last.visit + 1 + (carried if r.last.urlkey == r.first else 0)
        last = r.last.urlkey
    columns = list(zip(*plan, strict=True)) or [()] * 4
    names = {"range": pa.int32(), "before": pa.int64(), "first": pa.string(), "carried": pa.int64()}
    plan = F.broadcast(local(spark, {name: pa.array(column, kind) for (name, kind), column in zip(names.items(), columns, strict=True)}))
    more = F.when(F.col("urlkey") == F.col("first"), F.col("carried")).otherwise(0)
    return found.join(plan, "range").select(*FIELDS, (F.col("before") + F.col("place")).alias("position"), (F.col("visit") + more).alias("visit"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = new_path(spark, "archives")
    write(pages, archives)
    found = index(spark, archives, _bounds(pages, ranges_of(pages)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "position", "visit")
