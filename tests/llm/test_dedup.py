import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, simhash
from gridloom.llm.components import connected

from .conftest import ODD


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1] or ""].append(r[0])
    return out


def check_marks(found, rows):
    wanted = groups(rows)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in wanted.items()}
    assert len(found) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in wanted}
    kept = defaultdict(int)
    for r in found:
        t = by_digest[r.sha]
        assert r.keep_id == keep[t] and r.group_size == len(wanted[t])
        assert not r.kept or r.doc_id == keep[t]
        kept[t] += r.kept
    assert set(kept.values()) == {1}


def marked(df, **options):
    return exact_dedup.mark(df, **options).withColumn("sha", F.lower(F.hex("digest")) if not options else F.lit("")).collect()


def test_exact_marks_odd_rows(odd):
    check_marks(marked(odd), ODD)


def test_exact_marks_hot_groups(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}", "", "", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    check_marks(marked(df), rows)
    assert exact_dedup.keep_one(df).count() == 1001


def test_clashing_digests_compare_texts(spark):
    """With a digest of the length alone, texts still decide."""
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "c", "c", "dddd", "bb", "aa"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.mark(df, digest=lambda t: F.length(t).cast("string").cast("binary")).collect()
    wanted = groups(rows)
    text = dict(rows)
    for r in found:
        ids = wanted[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
    assert len(found) == len(rows)


def test_exact_keeps_columns(odd, empty):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert {(r.digest, r.row, r.n, r.bucket, r.key) for r in kept.collect()} == {("x", 1, 2, 3, "k")}
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups(ODD))
    assert exact_dedup.keep_one(empty).count() == 0 and exact_dedup.mark(empty).count() == 0


def brute_fingerprint(text, width):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in split(text)]
    if not words:
        return 0
    spans = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_fingerprints_match_brute_force(odd, documents):
    for r in simhash.fingerprints(odd).collect():
        texts = [x[1] or "" for x in ODD if x[0] == r.doc_id]
        assert any(r.fp % (1 << 64) == brute_fingerprint(t, 3) for t in texts)
    for t in list(documents.values())[:40]:
        assert simhash.fingerprint(t.encode(), 3) % (1 << 64) == brute_fingerprint(t, 3)


def brute_components(values, most):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("paired", [3, 64])
def test_links_lose_none(spark, monkeypatch, most, paired):
    monkeypatch.setattr(simhash, "MOST_PAIRED", paired)
    rng = np.random.default_rng(most)
    values = []
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            v = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                v ^= 1 << b
            values.append(v)
    values += [0, 0, 1, 3, (1 << 64) - 1]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.mark(df, most).collect()}
    roots = brute_components(values, most)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert found == {i: least[r] for i, r in enumerate(roots)}


def test_pigeonring_budgets():
    assert simhash.budgets(2) == [(28, 0), (60, 1), (64, 2)]


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (200, 201), (201, 200)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30)) and found[201] == 200
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_empty_table(empty):
    assert simhash.mark(simhash.fingerprints(empty)).count() == 0
    assert simhash.keep_one(empty).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = split(t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


@pytest.mark.parametrize("paired", [2, 64])
def test_near_duplicates_match_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "MOST_MET", paired)
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(8):
        base = rng.choice(vocabulary, 120).tolist()
        for copy in range(4):
            words = list(base)
            for at in rng.integers(0, 120, [0, 1, 2, 8][copy] if group % 2 else copy * 6).tolist():
                words[at] = rng.choice(vocabulary)
            rows.append((group * 10 + copy, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert kept == {i for i, _ in rows if find(i) == i}


@pytest.mark.parametrize("repeats", [10, 50])
def test_near_copies_with_a_repeated_line_are_linked(spark, repeats):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(40):
        base = " ".join(f"g{group}w{n}" for n in rng.integers(0, 10_000, 200).tolist())
        line = " ".join(f"g{group}line{n}" for n in range(10))
        rows += [(group * 2, base), (group * 2 + 1, base + f" {line}" * repeats)]
    assert min(jaccard(rows[n][1], rows[n + 1][1]) for n in range(0, len(rows), 2)) > 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(0, 80, 2))


@pytest.mark.parametrize("met", [1, 16])
def test_simhash_links_near_copies_that_no_band_holds(spark, monkeypatch, met):
    """Pairs whose bands have no key in common, and a pair of equal fingerprints whose shingle sets differ."""
    monkeypatch.setattr(simhash, "MOST_MET", met)
    texts = []
    for s in (289, 1229, 2644):
        words, line = [f"p{s}w{n}" for n in range(66)], " ".join(f"p{s}line{n}" for n in range(11))
        texts += [" ".join(words[:51]) + f" {line}" * 200, " ".join(words[:51]) + f" {line}" * 200 + " " + " ".join(words[51:])]
    keys, _ = simhash._bands(*simhash._shingle_sets(simhash.Texts.of([t.encode() for t in texts])), len(texts))
    assert not (keys[0::2] == keys[1::2]).any()
    assert all(jaccard(*texts[n : n + 2]) >= 0.8 for n in (0, 2, 4))
    texts += ["again " * 3, "again " * 9]
    assert simhash.fingerprint(texts[6].encode(), 3) == simhash.fingerprint(texts[7].encode(), 3)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 4, 6, 7]


def test_near_duplicate_stage_keeps_odd_rows(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # Only the row that differs in case alone is a near copy; equal texts are linked too.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-4, 1, 3, 4, 5, 6, 7, 8, 10]


def test_near_copies_of_equal_or_null_ids(spark):
    rng = np.random.default_rng(3)
    a, b, c, d = (" ".join(f"w{n}" for n in rng.integers(0, 9000, 60).tolist()) for _ in range(4))
    rows = [(None, a), (None, a + " more"), (5, b), (5, b + " more"), (7, c), (7, c), (7, c), (9, d), (None, d), (3, d + " more"), (4, "one"), (4, ""), (4, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = [sorted((r.doc_id is None, r.doc_id or 0) for r in kept if r.text.startswith(x)) for x in (a, b, c, d)]
    assert groups == [[(True, 0)], [(False, 5)], [(False, 7)], [(False, 3)]]
    assert sorted(r.text for r in kept if len(r.text) < 9) == ["", "", "one"]


def test_fingerprint_of_long_texts():
    text = b"Many  words\tand more\n" * 20_000
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text, 3) % (1 << 64) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
