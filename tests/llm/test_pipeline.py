import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import mixing, packing, quality, simhash, tokens
from gridloom.llm.textbytes import Texts

from .conftest import ODD
from .test_tokens import check_packing, ids_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts):
    """{doc_id: least doc_id that links of Jaccard 0.8 or more reach}, from all pairs that share a shingle; and the links."""
    sets, holders, shared, links = {d: shingles_of(t) for d, t in texts.items()}, defaultdict(list), Counter(), []
    for d in sorted(sets):
        for x in sets[d]:
            shared.update((e, d) for e in holders[x])
            holders[x].append(d)
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links.append((a, b))
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in texts}, links


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.learn(quality.measured(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        found = docs.collect()
        if name == "quality":
            good = {d for d, r in rows.items() if model.score(quality.statistics(Texts.of([(r.text or "").encode()])))[0] >= 0.3}
            wanted = Counter(rows[d] for d in good)
            assert 0 < len(good) < len(rows)
        elif name == "exact_dedup":
            last = {}
            for d in sorted(good):
                last[rows[d].text or ""] = d
            wanted = Counter(rows[d] for d in last.values())
        elif name == "near_dedup":
            groups, _ = near_groups({d: rows[d].text or "" for d in last.values()})
            kept = {d for d, least in groups.items() if d == least}
            wanted = Counter(rows[d] for d in kept)
            assert len(kept) < len(groups)
        elif name == "mixing":
            sizes, used, most = defaultdict(int), defaultdict(int), defaultdict(int)
            times = Counter(r.doc_id for r in found)
            for d in kept:
                size = len(WORD.findall(rows[d].text or ""))
                sizes[rows[d].source] += size
                used[rows[d].source] += size * times[d]
                most[rows[d].source] = max(most[rows[d].source], size)
            names = sorted(sizes, key=lambda s: (s is None, s or ""))
            targets = mixing.weighted_targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])
            assert all(abs(used[s] - t) <= most[s] / 2 + 1 for s, t in zip(names, targets, strict=True))
            assert set(times) <= kept and max(times.values()) <= 3
            wanted = Counter({rows[d]: n for d, n in times.items()})
        else:
            ids = ids_of(Tokenizer.from_file(tokens.default_path()), [(d, rows[d].text) for d, n in times.items() for _ in range(n)])
            windows = check_packing(found, ids, packing.WINDOW)
            assert windows <= -(-sum(len(x) for copies in ids.values() for x in copies) // packing.WINDOW) + 2
            break
        assert docs.columns == columns and Counter(found) == wanted


def test_near_duplicates_are_found(spark):
    """Recall of links against all pairs of the test table: linked documents share a group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    groups, links = near_groups(texts)
    found, _ = simhash.near_duplicates(docs)
    mine = {r.doc_id: r.component_id for r in found.collect()}
    hit = sum(mine.get(a, a) == mine.get(b, b) for a, b in links)
    print(f"links {len(links)}, found {hit}")
    assert len(links) > 20 and hit >= 0.99 * len(links)
    # And nothing else is joined.
    assert all(groups[d] == groups[c] for d, c in mine.items())


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/odd"
    odd.write.parquet(f"{folder}/documents.parquet")
    labels_of(spark).write.parquet(f"{folder}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.columns, name
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() > 0 and {r.doc_id for r in whole.select("doc_id").collect()} <= {r[0] for r in ODD}


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    folder = f"file://{tmp_path}/empty"
    empty.write.parquet(f"{folder}/documents.parquet")
    labels_of(spark).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_and_names(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and found.count() > 0
