import base64
import gzip
import hashlib
import itertools
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, warc

from .conftest import ODD

PAGES = [(i, f"http://www.Site{i % 5}.org:80/p/{i % 3}?q=A", f"<p>{i % 7}é</p>" if i % 4 else "") for i in range(60)] + [
    (70, None, None), (71, "https://x.org", "<p>3é</p>"), (71, "https://x.org", "<p>3é</p>"), (None, "ftp://y", "<b>\x00</b>"), (72, "u\r\nInjected: 1", "WARC/1.1\r\n\r\n" * 400),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"same": F.lit(1), "first": F.lit("x"), "payload": F.lit("y")})


def test_archives_round_trip(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_IN_FILE", 10)
    folder = f"file://{tmp_path}/warc"
    warc.write(pages, folder)
    found = warc.index(spark, folder, warc._bounds(pages, 7)).collect()
    groups = defaultdict(list)
    for i, _, html in PAGES:
        groups[(html or "").encode()].append(i)
    last = {p: max((i for i in ids if i is not None), default=None) for p, ids in groups.items()}
    by_digest = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for p in groups}
    assert len(found) == len(PAGES)
    for r in found:
        p = by_digest[r.payload_digest]
        assert r.payload_bytes == len(p) and r.page_id in groups[p]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last[p] else ("revisit", last[p]))
    rows = sorted(found, key=lambda r: r.position)
    keys = [(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys) and [r.position for r in rows] == list(range(len(rows)))
    for _, visits in itertools.groupby(rows, key=lambda r: r.urlkey):
        assert [r.visit for r in visits] == list(range(sum(1 for r in rows if r.urlkey == _)))
    # Any reader of gzip members can read the files.
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "warc").glob("part-*")))
    assert whole.count(b"WARC-Record-ID:") == len(PAGES) and b"\r\nInjected" not in whole


def test_merge_reads_blocks_in_turn(monkeypatch):
    """Blocks arrive in the order of their first keys; the tree takes each just then, and one of each run is held at a time."""
    monkeypatch.setattr(warc, "IN_BLOCK", 3)
    rng = np.random.default_rng(7)
    runs = [sorted(((f"u{rng.integers(9)}", "", int(rng.integers(99)), 0, "", "", None, f"f{r}", n) for n in range(int(rng.integers(1, 30)))), key=warc.order) for r in range(9)]
    rows = sorted((row for run in runs for row in warc._blocks(0, run)), key=lambda row: row[1:7])
    heads, stream = [row for row in rows if row[1] == 0], iter(row for row in rows if row[1] == 1)

    def fetch(run):
        block = next(stream)
        assert block[2:7] == run.then
        return block[12], None if block[7] is None else block[7:12]

    merged = list(warc.LoserTree([warc.BlockRun(row[2:7], fetch) for row in heads]))
    assert merged == sorted(itertools.chain(*runs), key=warc.order) and next(stream, None) is None


def test_archives_are_bounded_by_bytes(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 2000)
    monkeypatch.setattr(warc, "IN_BLOCK", 2)
    folder = f"file://{tmp_path}/warc"
    warc.write(pages.coalesce(1), folder)
    sizes = [p.stat().st_size for p in (tmp_path / "warc").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) <= 2000
    rows = sorted(warc.index(spark, folder, []).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(PAGES)))
    keys = [(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id, r.file, r.offset) for r in rows]
    assert keys == sorted(keys)


def test_least_payload(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    warc.write(pages, folder, least=1)
    found = warc.index(spark, folder, []).collect()
    assert {r.record_type for r in found if r.payload_bytes == 0} == {"response"}


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    warc.write(none, folder)
    assert warc.index(spark, folder, warc._bounds(none, 4)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    rows = [[(f"u{rng.integers(9)}", str(rng.integers(5)), int(rng.integers(99)), 0, "", "", None, f"f{r}", n) for n in range(int(rng.integers(0, 20)))] for r in range(k)]
    runs = [sorted(r, key=warc.order) for r in rows]
    assert list(warc.LoserTree([warc.Run(iter(r)) for r in runs])) == sorted(itertools.chain(*rows), key=warc.order)
    assert list(warc.LoserTree([])) == []


def test_long_record_ends_with_zero():
    body = np.random.default_rng(0).bytes(17 << 20)
    made = warc.record(1, "u", body, None, False)
    assert made[-1] == 0
    ((_, headers, block),) = warc.records(memoryview(made))
    assert block.endswith(body) and headers["WARC-Type"] == "response"


def test_url_keys():
    assert warc.url_key("HTTPS://user@www.A.Example.com:443/Path?B=1#frag") == "com,example,a)/path?b=1"
    assert warc.url_key(None) == ")"


def test_targets_share_and_stop():
    assert mixing.weighted_targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    found = mixing.weighted_targets([1000, 10, 10], [1, 2, 3])
    assert found == [960, 30, 30]
    assert mixing.weighted_targets([0, 5], [1, 2]) == [0, 5] and mixing.weighted_targets([], []) == []
    for _ in range(20):
        rng = np.random.default_rng(_)
        sizes = rng.integers(0, 1000, 7).tolist()
        t = mixing.weighted_targets(sizes, [1, 2, 3, 1, 2, 3, 1])
        assert sum(t) == sum(sizes) and all(x <= 3 * s for x, s in zip(t, sizes, strict=True))


def test_flow_costs_least():
    patterns = [((0,), 10), ((1,), 10), ((0, 1), 10)]
    flow = mixing.min_cost_flow(patterns, [25, 15])
    assert sum(f.get(0, 0) for f in flow) == 25 and sum(f.get(1, 0) for f in flow) == 15
    # Thirty first uses and ten second ones are the cheapest forty.
    cost = lambda w: sum(min(max(w - 10 * e, 0), 10) * c for e, c in enumerate(mixing.REPEAT_COSTS))
    assert sum(cost(sum(f.values())) for f in flow) == 10
    assert mixing.min_cost_flow([((0,), 4)], [100]) == [{0: 12}]


def test_mix_of_odd_rows(odd, empty):
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns
    assert mixing.mixed(empty).count() == 0
    assert sorted(map(str, kept.collect())) == sorted(map(str, mixing.mixed(odd.repartition(3)).collect()))


def test_query_meets_targets(spark):
    folder = "/root/testdata/sf0.01"
    rows = mixing.query(spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    import re

    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in docs.items()}
    assert len(rows) == len(docs) and all(r.size == words[r.doc_id] for r in rows)
    names = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words[d] for d, r in docs.items() if r.source == s) for s in names]
    targets = dict(zip(names, mixing.weighted_targets(sizes, [1 + i % 3 for i in range(len(names))]), strict=True))
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.target == float(targets[s]) and r.source_size == sizes[names.index(s)] and r.taken <= 3 * r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    for s in names:
        assert abs(taken[s] - targets[s]) <= Fraction(most[s], 2) + 1
    again = mixing.query(spark, folder).collect()
    assert sorted(again) == sorted(rows)


@pytest.mark.parametrize("most", [0, 1, 3])
def test_many_sources_are_mixed_alike(spark, monkeypatch, most):
    """The plan for more sources than the driver holds gives what the flow gives."""
    folder = "/root/testdata/sf0.001"
    wanted = sorted(mixing.query(spark, folder).collect())
    monkeypatch.setattr(mixing, "MOST_PATTERNS", most)
    assert sorted(mixing.query(spark, folder).collect()) == wanted


def test_many_odd_sources(spark, odd, monkeypatch):
    wanted = sorted(map(str, mixing.mixed(odd).collect()))
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    found = mixing.mixed(odd)
    assert found.columns == odd.columns and sorted(map(str, found.collect())) == wanted


def test_overlapping_sources(spark):
    """Documents of two sources serve both quotas, and each use is routed to one."""
    rng = np.random.default_rng(2)
    rows = [(i, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"], int(rng.integers(1, 50))) for i in range(3000)]
    slim = spark.createDataFrame(rows, "doc_id long, members array<string>, words long").withColumn("place", F.xxhash64("doc_id")).cache()
    mix = mixing.decide(slim, [1, 3])
    used = mixing.uses(mix, slim).select("words", F.explode("used").alias("source")).groupBy("source").agg(F.sum("words").alias("w")).collect()
    total = sum(r[2] for r in rows)
    found = {r.source: r.w for r in used}
    assert found[0] == pytest.approx(total / 4, abs=60) and found[1] == pytest.approx(total * 3 / 4, abs=60)
    assert ODD
