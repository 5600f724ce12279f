import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import pii, quality, toxicity
from gridloom.llm.textbytes import Texts


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = label.sum()
    return (order[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


@pytest.mark.parametrize(("module", "column", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, module, column, least):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in module.query(spark, folder).collect()}
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows.values())
    held = [d for d in labels if rows[d].held_out]
    assert auc(np.array([rows[d].score for d in held]), np.array([labels[d] for d in held])) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_missing_labels(spark, odd, empty, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    if module is quality:
        scored = quality.judge(quality.measured(odd), quality.learn(quality.measured(odd), none))
        assert quality.measured(empty).count() == 0
        kept = quality.keep(odd, quality.learn(quality.measured(odd), none))
        assert kept.count() == odd.count() and kept.columns == odd.columns
    else:
        scored = toxicity.judge(odd, toxicity.learn(odd, none))
        assert toxicity.judge(empty, toxicity.learn(empty, none)).count() == 0
    assert scored.count() == odd.count() and scored.where("score is null or isnan(score)").count() == 0


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.measured(docs).cache()
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.judge(rows, quality.learn(rows, labels)).collect()}
    b = {r.doc_id: r.score for r in quality.judge(rows, quality.learn(rows, flipped)).collect()}
    assert all(np.isclose(a[d], b[d]) for d in a)


@pytest.fixture(scope="module")
def language(spark):
    words = ["the idiot met a loser and a moron near the pathetic clown", "worthless trash is stupid scum", "letters and winter follow summer in silence"] * 40
    return toxicity.trigrams(spark.createDataFrame([(w,) for w in words], "text string"))


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("l0s3r", "loser"), ("idiooooot", "idiot"), ("tr@sh", "trash"), ("summer", "summer"), ("letters", "letters")])
def test_viterbi_restores(language, written, meant):
    assert toxicity.decode(written, language) == meant


def test_restore_finds_units(language):
    texts = [b"You i d i o t and l0s3r! Fine 2024 words.", b"", "é stuuuupid $cum".encode(), b"a b c"]
    found = toxicity.restore(Texts.of(texts), language)
    out = [found.data[a:b].tobytes().decode() for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
    assert out == ["you idiot and loser! fine 2024 words.", "", "é stupid scum", "a b c"]


def brute_decode(unit, model, gaps=None):
    """All paths of the channel, by recursion: the cheapest source."""
    best = [np.inf, None]
    letters = [i for i, c in enumerate(unit) if "a" <= c <= "z"]
    symbol = lambda c: ord(c) - 97 if "a" <= c <= "z" else toxicity.EDGE if c == " " else toxicity.SYMBOLS - 1

    def price(source):
        s = [toxicity.EDGE, toxicity.EDGE, *map(symbol, source), toxicity.EDGE]
        return sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:], strict=False))

    def walk(i, source, last, cost):
        if not gaps and letters and i > letters[-1]:
            tail = unit[i:]
            left = sum(toxicity.LEFT_AGAIN if x == y else toxicity.LEFT for x, y in zip(tail, tail[1:], strict=False)) + (toxicity.LEFT if tail else 0)
            if cost + price(source) + left < best[0]:
                best[:] = cost + price(source) + left, source + tail
        if i == len(unit):
            if cost + price(source) < best[0]:
                best[:] = cost + price(source), source
            return
        c = unit[i]
        for x, p in [*((x, toxicity.SWAPPED) for x in toxicity.STANDS_FOR.get(c, "")), (c, 0.0 if "a" <= c <= "z" else toxicity.KEPT_SIGN)]:
            walk(i + 1, source + x, c, cost + p)
            if gaps and i:
                walk(i + 1, source + " " + x, c, cost + p + (0.0 if gaps[i] else toxicity.BOUNDARY))
        if i and unit[i - 1] == c and last == c:
            long = (i >= 2 and unit[i - 2] == c) or (i + 1 < len(unit) and unit[i + 1] == c)
            walk(i + 1, source, c, cost + (toxicity.REPEATED if long else toxicity.DOUBLED))

    walk(0, "", "", 0.0)
    return best[1]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_matches_all_paths(seed):
    rng = np.random.default_rng(seed)
    model = rng.exponential(2.0, (toxicity.SYMBOLS,) * 3)
    for _ in range(25):
        unit = "".join(rng.choice(list("aabbill1103$!"), int(rng.integers(2, 7))))
        assert toxicity.decode(unit, model) == brute_decode(unit, model)
        gaps = [False, *(rng.random(len(unit) - 1) < 0.3).tolist()]
        assert toxicity.decode(unit, model, gaps) == brute_decode(unit, model, gaps)


def test_spaced_letters_of_any_length_and_endings(language):
    texts = ["a  i d i o t   m e t  a  l o s e r", "1d107", "id1ot" + "x" * 60, "i d i o t " * 60, "loser$$$ yes!"]
    found = toxicity.restore(Texts.of([t.encode() for t in texts]), language)
    out = [found.data[a:b].tobytes().decode() for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
    assert out[0] == "a idiot met a loser" and out[1] == "idiot" and "1" not in out[2]
    assert out[3].count("idiot") >= 55 and out[4].startswith("loser") and out[4].endswith(" yes!")


def test_a_second_model_in_one_process(language):
    other = language.copy()
    other[:, :, ord("l") - 97] = other[:, ord("l") - 97] = 0.01
    text = Texts.of([b"1diot"])
    first, second = toxicity.restore(text, language), toxicity.restore(text, other)
    assert first.data.tobytes() == b"idiot" and second.data.tobytes().decode() == toxicity.decode("1diot", other) != "idiot"


def test_toxicity_scores_from_counts(spark):
    """The lexicon and the scores, counted in plain Python over restored texts."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sample = toxicity._sample(labels).collect()
    restored = lambda t: toxicity.restore(Texts.of([t.encode()]), model.language).data.tobytes().decode()
    body = re.compile(r"[a-zA-Z\u0080-\U0010ffff](?:.*[a-zA-Z\u0080-\U0010ffff])?", re.S)

    def entries(word):
        held = body.search(word)
        held = held.group().encode() if held else b""
        return [(k, held[:k]) for k in toxicity.PREFIXES if len(held) >= k] + ([(0, held)] if len(held) >= 2 else [])

    count, size = {}, {0: 0, 1: 0}
    for r in sample:
        if r.half == 0 and r.doc_id in texts:
            size[r.label] += 1
            for e in {e for w in re.findall(r"[^\x20\x09-\x0D]+", restored(texts[r.doc_id])) for e in entries(w)}:
                count.setdefault(e, [0, 0])[r.label] += 1
    weight = {e: np.log((bad + 0.5) / (size[1] + 1)) - np.log((good + 0.5) / (size[0] + 1)) for e, (good, bad) in count.items() if bad >= toxicity.LEAST_DOCUMENTS}
    weight = {e: w for e, w in weight.items() if w >= toxicity.LEAST_WEIGHT}
    assert len(model.keys) == len(weight) and np.allclose(np.sort(model.weights), np.sort(list(weight.values())))
    for t in list(texts.values())[:150]:
        words = re.findall(r"[^\x20\x09-\x0D]+", restored(t))
        best = [max([0.0, *(weight.get(e, 0.0) for e in entries(w))]) for w in words]
        x = np.array([max([0.0, *best]), np.log1p(sum(b >= toxicity.STRONG for b in best)), np.log1p(len(words)), 1.0])
        assert model.score(Texts.of([t.encode()]))[0] == pytest.approx(1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30))), abs=1e-9)


def test_quality_matches_dense_discriminant(spark):
    """Covariances, shrinkage and log densities over all learnt rows at once, by plain inverses and determinants."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.measured(docs).cache()
    model = quality.learn(rows, labels)
    x = {r.doc_id: np.array(r.x) for r in rows.collect()}
    known = [(x[r.doc_id], r.quality) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5]
    data, label = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    scaled = (data - data.mean(axis=0)) / data.std(axis=0)
    covs = [np.cov(scaled[label == c].T, bias=True) for c in (0, 1)]
    pooled = sum((label == c).mean() * covs[c] for c in (0, 1))
    raw, every = [], np.array(list(x.values()))
    z = (every - data.mean(axis=0)) / data.std(axis=0)
    for c in (0, 1):
        cov = (1 - quality.POOLED_SHARE - quality.DIAGONAL_SHARE) * covs[c] + quality.POOLED_SHARE * pooled + quality.DIAGONAL_SHARE * np.diag(np.diag(pooled)) + quality.FLOOR * np.eye(quality.D)
        off = z - scaled[label == c].mean(axis=0)
        raw.append(-0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off) - 0.5 * np.log(np.linalg.det(cov)))
    wanted = np.clip(raw[1] - raw[0], -quality.MOST_RAW, quality.MOST_RAW)
    assert np.allclose(model.raw(every), wanted, atol=1e-4, rtol=1e-5)
    score = 1 / (1 + np.exp(-(model.curve[0] * wanted + model.curve[1])))
    found = {r.doc_id: r.score for r in quality.judge(rows, model).collect()}
    assert np.allclose([found[d] for d in x], score, atol=1e-5)


def test_quality_statistics_of_a_text():
    text = "One two, two!\nThree 33 é"
    (x,) = quality.statistics(Texts.of([text.encode()]))
    found, words, size = dict(zip(quality.NAMES, x, strict=True)), text.split(), len(text.encode())
    share = lambda n: np.log(n / size + 1e-3)
    wanted = {
        "words": np.log1p(6), "word_bytes": np.log1p(sum(len(w.encode()) for w in words) / 6), "upper": share(2), "digits": share(2), "marks": share(1),
        "symbols": share(0), "bangs": share(1), "pipes": share(0), "wide": share(2), "distinct": np.log(7 / 7**0.8), "repeats": np.log(1e-3), "lines": np.log(1 / 6 + 1e-3), "longest": np.log1p(5),
    }
    assert all(found[k] == pytest.approx(v) for k, v in wanted.items())
    assert set(wanted) == set(quality.NAMES)


TEXT = "call +1 (555) 123-4567 now. later 1 555 123 4567 or 15551234567. mail a.b@c.de and a.b@c.de. see 4111 1111 1111 1111 and 4111111111111112 and 10.0.0.1 or 999.0.0.1"


def test_base_spans():
    found = [(pii.KINDS[k], TEXT[a:b]) for a, k, b in pii.base_spans(TEXT)]
    assert found == [("phone", "+1 (555) 123-4567"), ("email", "a.b@c.de"), ("email", "a.b@c.de"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")]
    assert pii.base_spans("x@y x@@y.z 1.2.3.4.5 ٣٣٣٣٣٣٣٣٣٣٣٣") == [(11, 1, 18)]


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(pii.EMAIL, text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(pii.IP, text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(pii.CARD, text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


def test_base_spans_match_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("0123456789011..@a-+ (%é"), int(rng.integers(0, 60)))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)


def test_pii_query_matches_brute_force(spark):
    """Base columns of every document, by the patterns alone; all spans hold the base ones."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in pii.query(spark, folder).collect():
        base = brute_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()
        assert set(filter(None, pii.spell(base).split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", ["a" * 400_000 + "@b", "1" * 400_000, "1 " * 200_000, "a@" * 200_000, "1." * 200_000, "+1-" * 150_000, "(" * 400_000, "1" + "-" * 400_000, "+1 555 123 4567 " + "15551234567 " * 20_000])
def test_adversarial_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.Field(np.zeros((pii.SHAPES, pii.LABELS)), np.eye(pii.LABELS), np.eye(pii.LABELS)).spans(text, pii.base_spans(text))
    assert time.perf_counter() - began < 20


@pytest.fixture(scope="module")
def trained(spark):
    """In this corpus a phone follows an address, and other numbers of eleven digits follow each other."""
    rng = np.random.default_rng(4)
    number = lambda: "".join(map(str, rng.integers(0, 10, 11)))
    texts = []
    for n in range(300):
        mine = "+" + number()
        texts += [f"mail user{n}@site.example {mine}" + f" and {mine}" * (n % 4 == 0), " ".join(number() for _ in range(4)), f"call {mine} then {number()} or {mine}"]
    return pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_both_kinds_of_edges_are_learnt_and_count(trained):
    without = {name: pii.Field(trained.weights, *(np.zeros_like(m) if name == n else m for n, m in (("chain", trained.chain), ("skip", trained.skip)))) for name in ("chain", "skip")}
    assert np.abs(trained.chain).max() > 0.3 and np.abs(trained.skip).max() > 0.3
    follows = "mail someone@site.example 15550001111"
    far = "call +15550002222 then 98765432101 or 15550002222"
    added = lambda field, text: [text[a:b] for a, k, b in field.spans(text, pii.base_spans(text)) if (a, k, b) not in pii.base_spans(text)]
    assert added(trained, follows) == ["15550001111"] and added(without["chain"], follows) == []
    assert "15550002222" in added(trained, far) and "15550002222" not in added(without["skip"], far)


def test_pseudo_likelihood_has_no_slope_at_the_fit():
    """A small step in any weight makes the penalised pseudo-likelihood no larger."""
    rng = np.random.default_rng(5)
    rows = np.hstack([rng.integers(0, 2, (40, pii.SHAPES)), rng.integers(0, pii.LABELS + 1, (40, 2)), rng.integers(0, 3, (40, pii.LABELS)), rng.integers(0, pii.LABELS, (40, 1))])
    n = rng.integers(1, 5, 40).astype(float)
    field = pii.fit(rows, n, steps=5000)

    def likelihood(w, c, s):
        total = -0.5 * ((w**2).sum() + (c**2).sum() + (s**2).sum())
        for row, k in zip(rows.tolist(), n, strict=True):
            score = np.array(row[: pii.SHAPES]) @ w + np.array(row[pii.SHAPES + 2 : -1]) @ s
            before, after = row[pii.SHAPES : pii.SHAPES + 2]
            score = score + (c[before] if before < pii.LABELS else 0) + (c[:, after] if after < pii.LABELS else 0)
            total += k * (score[row[-1]] - np.log(np.exp(score).sum()))
        return total

    at = [field.weights, field.chain, field.skip]
    best = likelihood(*at)
    for _ in range(30):
        moved = [m + 1e-3 * rng.normal(size=m.shape) for m in at]
        moved[2] = (moved[2] + moved[2].T) / 2
        assert likelihood(*moved) < best + 1e-4


def test_field_adds_repeated_tokens(spark, odd, empty):
    field = pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    base = pii.base_spans(TEXT)
    spans = field.spans(TEXT, base)
    assert set(base) <= set(spans)
    assert [TEXT[a:b] for a, _, b in spans if (a, _, b) not in base] == ["1 555 123 4567", "15551234567"]
    assert field.spans("order 4111111111111112 by @someone at x@", []) == []
    assert pii.find(odd, pii.learn(odd)).count() == odd.count() and pii.find(empty, pii.learn(empty)).count() == 0


def test_skip_edges_grow_with_the_nodes():
    said = ["5551234567", "15551234567", "1234567", "x", "5551234567", "999"]
    edges = pii.similar(said, [3, 4, 4, 4, 4, 4])
    assert {(0, 4), (0, 1)} <= set(edges) and {2, 0} <= {i for edge in edges for i in edge} and not {3, 5} & {i for edge in edges for i in edge}
    many = [str(10**9 + n) for n in range(5000)] + ["1" * k for k in range(7, 300)]
    assert len(pii.similar(many, [4] * len(many))) < 5 * len(many)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    unary = rng.normal(size=(3, pii.LABELS))
    edges = [(np.array([k]), np.array([k + 1]), rng.normal(size=(pii.LABELS, pii.LABELS))) for k in (0, 1)]
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + edges[0][2][:, :, None] + edges[1][2][None, :, :])
    joint /= joint.sum()
    found = pii.marginals(unary, edges)
    for n, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        assert np.allclose(found[n], joint.sum(axis=axes), atol=1e-3)
