"""Every query on a table of odd rows and on empty tables, and long words."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, quality, simhash
from gridloom.llm.queries import QUERIES
from gridloom.llm.textbytes import Texts

from .conftest import ODD

PAGES = [(1, "http://a.example/x", "<p>a</p>"), (1, "http://a.example/x", "<p>a</p>"), (2, None, None), (None, "b", ""), (3, "http://a.example/x", "é" * 300_000), (4, "c", "<p>a</p>")]


@pytest.fixture(scope="module")
def folders(spark, odd, empty, tmp_path_factory):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 0, 0), (7, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = {}
    for name, docs, few in (("odd", odd, labels), ("empty", empty, labels.limit(0))):
        out[name] = f"file://{tmp_path_factory.mktemp(name)}"
        docs.write.parquet(f"{out[name]}/documents.parquet")
        few.write.parquet(f"{out[name]}/labels.parquet")
        (pages if name == "odd" else pages.limit(0)).write.parquet(f"{out[name]}/pages.parquet")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, folders, name):
    rows = QUERIES[name](spark, folders["odd"]).collect()
    if name == "op1_warc":
        assert len(rows) == len(PAGES) and {r.page_id: r.payload_bytes for r in rows} == {1: 8, 2: 0, None: 0, 3: 600_000, 4: 8}
        # The two rows that repeat page 1 both revisit page 4; a null id is smaller than any other.
        assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [("1", "revisit", 4), ("1", "revisit", 4), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("None", "revisit", 2)]
    elif name == "op9_packing":
        assert {r.doc_id for r in rows} == {r[0] for r in ODD} and max(r.offset + r.length for r in rows) <= 2048
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    if name == "op10_mixing":
        assert all(0 <= r.taken <= 3 * r.size and r.source_size >= r.size for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() == 0


def test_simhash_query_matches_brute_force(spark, sf_dir):
    """Links of two differing bits at most, by all pairs of fingerprints."""
    rows = simhash.query(spark, sf_dir).collect()
    values = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    root = {d: d for d in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(values)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (values[a] ^ values[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in rows} == {d: find(d) for d in ids}


def test_exact_dedup_hashes(spark, odd):
    """Texts are grouped by hash aggregation, without a sort of texts."""
    rows = odd.select(exact_dedup.sha256(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("row"), "doc_id")
    plan = exact_dedup._combine(rows, [], "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_long_words_take_bounded_memory():
    texts = Texts.of([b"x" * (8 << 20), b"a b"])
    starts, ends, _ = texts.words()
    Texts.of([b"a"]).hashes(np.array([0]), np.array([1]))  # the tables of powers
    tracemalloc.start()
    found = texts.hashes(starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and len(set(found.tolist())) == 3
    assert np.isfinite(quality.statistics(texts)).all()
