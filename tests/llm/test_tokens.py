import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import minhash, packing, token_scan, tokens
from gridloom.llm.textbytes import Texts

from .conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def test_encoder_matches_tokenizer(tokenizer, documents):
    texts = [r[1] or "" for r in ODD] + list(documents.values())[:60] + ["it's don't we'll I'm", "A.B,C!!\t--é́ İstanbul ΑΣ ΑΣ. ½ ₂ x​y", "<|startoftext|>a<|endoftext|>"]
    ids, offsets = tokens.Encoder(tokens.default_path()).encode(Texts.of([t.encode() for t in texts]))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_UNITS", 4)
    monkeypatch.setattr(tokens, "BLOCK", 2)
    e = tokens.Encoder(tokens.default_path())
    for t in ("alpha beta gamma", "delta alpha a" + "b" * 40, "gamma beta " + "c" * 50):
        assert e.encode(Texts.of([t.encode()]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_words_with_equal_hashes_are_told_apart(tokenizer):
    """The word of Thue and Morse and its complement collide under every polynomial hash of 64 bits."""
    one = "".join("ab"[n.bit_count() % 2] for n in range(1024))
    for words in ([one, one.translate(str.maketrans("ab", "ba"))], ["abababababababab", "babababababababa"]):
        ids, offsets = tokens.Encoder(tokens.default_path()).encode(Texts.of([w.encode() for w in words]))
        for i, w in enumerate(words):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(w, add_special_tokens=False).ids


def test_units_of_odd_characters(tokenizer):
    rng = np.random.default_rng(0)
    alphabet = list("abcXYZ019.,!?'-_<|>éÉß×÷ñ İΣς ​\x00\x1c\x85\x7f²½日😀sdtmvrel") + ["e\u0301", "<|endoftext|>", " ", "\n"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 120)))) for _ in range(800)]
    ids, offsets = tokens.Encoder(tokens.default_path()).encode(Texts.of([t.encode() for t in texts]))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check_packing(rows, ids, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, found in pieces.items():
        at, copies = Counter(), Counter(r.start for r in found)
        for r in found:
            assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(x) for x in ids[doc])
            at[doc] += r.length
        assert at[doc] == sum(map(len, ids[doc])) and max(copies.values()) <= len(ids[doc])
    assert sorted(sequences) == list(range(len(sequences)))
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(sequences)


def ids_of(tokenizer, rows):
    out = defaultdict(list)
    for doc, text in rows:
        out[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    return out


def test_packing_holds_every_id_once(odd, empty, tokenizer):
    found = packing.pack(odd).collect()
    check_packing(found, ids_of(tokenizer, [r[:2] for r in ODD]), packing.WINDOW)
    assert packing.pack(empty).count() == 0


def test_packing_wastes_little(spark, sf_dir, tokenizer, documents):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = ids_of(tokenizer, documents.items())
    n = check_packing(packing.pack(df).collect(), ids, packing.WINDOW)
    total = sum(len(x[0]) for x in ids.values())
    assert n <= -(-total // packing.WINDOW) + 1


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_best(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(5, 60, 6)}
    capacity = int(rng.integers(40, 120))
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1)}
    chosen = packing.fill(counts, capacity)
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)
    assert all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_every_piece():
    histogram = {2048: 5, 1000: 7, 1048: 3, 24: 9, 1: 50, 700: 4}
    used = Counter()
    for times, chosen in packing.plan(histogram):
        assert sum(k * n for k, n in chosen.items()) <= 2048
        used.update({k: n * times for k, n in chosen.items()})
    assert used == Counter(histogram)


def test_scan_of_written_files(spark, odd, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_scan.write(odd, folder)
    found = token_scan.scan(spark, folder, token_scan.HEADER, block=64).collect()
    wanted = sorted(((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD), key=str)
    assert sorted(((token_scan.unspell(r.head), r.tokens) for r in found), key=str) == wanted


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_are_stitched(block):
    ids = np.array([5, 6, 0, 0, 7, 8, 9, 1, 2, 0, 3], np.uint16)
    number, start, length, ends = token_scan.fragments(ids, block)
    number, start, length = token_scan.stitch(number, start, length)
    assert list(zip(number.tolist(), start.tolist(), length.tolist(), strict=True)) == [(0, 0, 2), (1, 3, 0), (2, 4, 5), (3, 10, 1)] and ends == 3


def test_documents_run_on_over_files(spark, tmp_path):
    for n, ids in enumerate(([1, 2], [3, 0, 4], [5], [6, 0, 0, 7])):
        (tmp_path / f"f{n}").write_bytes(np.array(ids, "<u2").tobytes())
    found = sorted((r.document, r.tokens, r.start) for r in token_scan.scan(spark, f"file://{tmp_path}", joined=True).collect())
    assert found == [(0, 3, 0), (1, 3, 2), (2, 0, 2), (3, 1, 3)]
    assert token_scan.unspell(token_scan.spell(-5)) == -5 and token_scan.unspell(token_scan.spell(None)) is None


def brute_scan(files, joined):
    """(file, document, start, tokens) by a plain loop over ids."""
    out, number, opened = [], 0, None
    for name, content in files:
        ids = np.frombuffer(content[: len(content) // 2 * 2], "<u2").tolist()
        if not joined:
            number, opened = 0, None
        for at, x in enumerate(ids):
            opened = opened or [name, number, at, 0]
            if x == token_scan.END:
                out.append(tuple(opened))
                number, opened = number + 1, None
            else:
                opened[3] += 1
        if opened and not joined:
            out.append(tuple(opened))
    return out + ([tuple(opened)] if opened and joined else [])


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("split", [31, 1 << 20])
def test_files_larger_than_a_split(spark, tmp_path, split, joined):
    """Files of many splits, ids with a zero byte in either half, empty documents, a byte order mark, odd ends, no ends."""
    rng = np.random.default_rng(split)
    files = [("a", b"\xef\xbb\xbf\x01\x00\x00\x05\x00"), ("b", b""), ("c", b"\x00\x00" * 9), ("d", b"\xef\xbb\xbf\x07"), ("e", b"\x05"), ("f", b"\x00\x01\x00\x00\x00")]
    files += [(f"g{n}", rng.choice([0, 0, 1, 256, 512, 300, 65535, 40000], int(rng.integers(1, 80))).astype("<u2").tobytes()) for n in range(3)]
    for name, content in files:
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = token_scan.scan(spark, f"file://{tmp_path}", joined=joined, block=5).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = sorted((r.file.rpartition("/")[2], r.document, r.start, r.tokens) for r in rows)
    assert found == sorted(brute_scan(files, joined))


def test_heads_across_splits(spark, odd, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_scan.write(odd.where("n_chars < 100 or n_chars is null").coalesce(1), folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        found = token_scan.scan(spark, folder, token_scan.HEADER).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = sorted(((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD if (r[4] or 0) < 100), key=str)
    assert sorted(((token_scan.unspell(r.head), r.tokens) for r in found), key=str) == wanted


def test_no_token_files(spark, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_scan.write(empty, folder)
    assert token_scan.scan(spark, folder, token_scan.HEADER).count() == 0


def test_minhash_edits(odd, spark, sf_dir, documents):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    wanted = []
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        wanted.append((rows[i][0], len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    found = minhash.edited(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(wanted, key=str)
    same = defaultdict(set)
    for r in found:
        for t in [x[1] or "" for x in ODD if x[0] == r.doc_id]:
            same[t].add(r.fingerprint)
    assert len(same["the same words stand here and there and here again"]) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_minhash_likeness_is_close(spark, sf_dir, documents):
    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids = sorted(documents)
    errors = []
    for r in minhash.edited(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        at = ids.index(r.doc_id)
        t, after = documents[r.doc_id], documents[ids[(at + 1) % len(ids)]]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        for estimate, other in ((r.near_edited, changed), (r.near_next, after)):
            a, b = sets(t), sets(other)
            errors.append(estimate - (len(a & b) / max(1, len(a | b))))
    assert np.abs(errors).max() < 0.12 and abs(np.mean(errors)) < 0.005


def test_minhash_small_tables(spark, empty):
    assert minhash.edited(empty).count() == 0
    one = spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")
    r = minhash.edited(one).first()
    assert r.near_next == 1 and r.n_chars == 9
    assert minhash.fingerprints(one).first().fingerprint is not None
