"""Whitening, periodic runs and the quality network beside brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import quality_net, queries, whitening, word_runs

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, runs string, score string, pooled string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "en", "x", "y", "z") for r in rows], DOCS)


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<double>, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)


def whitened_by_hand(points, count):
    """n, deviations, whitened rows and explained shares from the eigenvectors of the covariance."""
    x = np.floor(64 * points).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    white = (x - sums / n) @ columns[:, :count] / np.sqrt(values[:count])
    return n, [int(v) for v in ((n * x.astype(object) - sums) ** 2).sum(axis=1)], white, values / values.sum()


@pytest.mark.parametrize("dimension", [5, 24])
def test_whitening_equals_eigenvectors(spark, dimension):
    rng = np.random.default_rng(dimension)
    points = rng.normal(size=(300, dimension)) * np.geomspace(300, 0.5, dimension)
    points[100:200] = points[7]  # one vector fills a third of the table
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    bad = [(900, None), (901, []), (902, [1.0] * (dimension - 1) + [None]), (903, [float("nan")] + [1.0] * (dimension - 1))]
    bad += [(904, [float("-inf")] * dimension), (905, [1e300] * dimension), (906, [1.0] * (dimension + 1))]
    found = whitening.whiten(vectors(spark, [*rows, *bad, rows[3]]).repartition(5)).toPandas()
    n, deviations, white, explained = whitened_by_hand(points, 16)
    count = min(16, dimension)
    assert sorted(set(found["vec_id"])) == list(range(300)) and len(found) == 301 * count
    assert set(found["n"]) == {n} and (found["identity_error"] < 1e-9).all()
    once = found.drop_duplicates(["vec_id", "component"])
    table = once.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    table *= np.sign((table * white).sum(axis=0))
    assert np.abs(table - white).max() < 1e-8
    one = once[once["component"] == 1].sort_values("vec_id")
    assert [int(v) for v in one["deviation"]] == deviations
    shares = once[once["vec_id"] == 0].sort_values("component")["explained"]
    assert shares.to_numpy() == pytest.approx(explained[:count], rel=1e-9)


def test_whitening_of_ill_conditioned_rows_takes_more_passes(spark):
    rng = np.random.default_rng(3)
    points = np.outer(rng.normal(size=400), np.ones(4)) * 1e8 + rng.normal(size=(400, 4)) * 0.05
    model_rows = whitening.on_grid(vectors(spark, [(k, p.tolist()) for k, p in enumerate(points)]), "embedding", whitening.WhitenSettings())
    model = whitening.fit_whitening(model_rows.select("_x").distinct(), 4, whitening.WhitenSettings())
    x = np.unique(np.floor(64 * points).astype(np.int64) + 1_000_000, axis=0)
    centred = x - x.sum(axis=0) / len(x)
    _, singular, _ = np.linalg.svd(centred, full_matrices=False)
    assert model.passes > 2  # the Gram matrix alone has lost the small components
    assert model.variance == pytest.approx(singular**2 / len(x), rel=1e-4)


def test_whitening_without_variance(spark):
    few = vectors(spark, [(1, [1.0, 5.0, 2.0]), (2, [3.0, 5.0, 2.0]), (None, [4.0, 5.0, 2.5])])
    found = whitening.whiten(few).orderBy("component", "vec_id").collect()
    assert len(found) == 9 and {r["vec_id"] for r in found} == {None, 1, 2}
    assert [r["whitened"] is None for r in found] == [False] * 6 + [True] * 3
    assert all(r["identity_error"] < 1e-9 for r in found)
    same = whitening.whiten(vectors(spark, [(1, [1.0, 5.0]), (2, [1.0, 5.0])])).collect()
    assert len(same) == 4 and {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in same} == {
        (1, 0, None, None, None)
    }
    assert whitening.whiten(few.limit(0)).count() == 0
    assert whitening.whiten(few.where("vec_id = 1").select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_deviations_beyond_64_bits_stay_exact():
    x = np.array([[1 << 45, 5], [3, 1 << 44]], dtype=np.int64)
    sums = tuple(int(v) for v in x.sum(axis=0))
    want = [str(sum((10**6 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    assert whitening._deviations(x, 10**6, sums) == want


# ---------------------------------------------------------------- runs


def runs_by_hand(words, least=24, powers=3):
    """Every period in turn: maximal stretches of equal words at that distance, without multiples of a smaller one."""
    n, out = len(words), []
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, powers * q) and not any(
                all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)
            ):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for k in range(600):
        words = [b"%d" % rng.randint(1, rng.choice((1, 2, 3, 50))) for _ in range(rng.randint(0, 70))]
        if k % 2 and words:
            words += words[-rng.randint(1, len(words)) :] * rng.randint(1, 4)
        least, powers = rng.choice(((24, 3), (6, 3), (9, 2), (2, 2)))
        found = word_runs.document_runs(words, word_runs.RunSettings(least, powers))
        assert found == runs_by_hand(words, least, powers)


def test_runs_of_odd_documents(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "a " * 24),
        (5, "a " * 23),
        (6, "x " + "a b c d " * 12 + "y"),
        (7, "A a " * 30),
        (None, "z " * 40),
        (4, "a " * 24),
        (8, " ".join(f"w{k % 50_000}" for k in range(300_000))),  # 1.9 MB, one run of six periods
    ]
    found = word_runs.with_longest(word_runs.find_runs(documents(spark, rows).repartition(3)))
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), hash(r["collapsed"])) for r in found.collect()}
    assert found.count() == 10
    assert got == {
        (1, 0, (), hash("")),
        (2, 0, (), hash("")),
        (3, 0, (), hash("")),
        (4, 24, ((0, 24, 1),), hash("a")),
        (5, 23, (), hash("a " * 22 + "a")),
        (6, 38, ((1, 36, 3),), hash("x a b c d y")),
        (7, 60, ((0, 60, 2),), hash("A a")),
        (None, 40, ((0, 40, 1),), hash("z")),
        (8, 300_000, ((0, 300_000, 50_000),), hash(" ".join(f"w{k}" for k in range(50_000)))),
    }
    assert word_runs.find_runs(documents(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        word_runs.RunSettings(min_powers=1)


def test_run_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {}
    for d in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (d["text"] or "").encode())
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        # the table's other texts repeat only one word; every period is too slow in plain loops for all of them
        runs = runs_by_hand(words) if h % 10 == 0 or n < 400 else word_runs.document_runs(words, word_runs.RunSettings())
        keep = [True] * n
        for start, length, q in runs:
            keep[start + q : start + length] = [False] * (length - q)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        want[d["doc_id"]] = (
            len(runs),
            *best,
            1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for w, k in zip(words, keep, strict=True) if k)).hexdigest(),
        )
    got = {r[0]: tuple(r)[1:] for r in queries.op12_word_runs(spark, SMALL).collect()}
    assert got == want and sum(r[0] > 0 for r in want.values()) > 10


# ---------------------------------------------------------------- quality

TINY = quality_net.QualitySettings(buckets=64, size=8)


def test_contexts_equal_plain_loops():
    texts = [b"The cat THE cat!! sat 42", b"", b"one", b"\xc3\xa9t\xc3\xa9 cat cat cat | on"]
    found = quality_net.units(texts, TINY)
    index = quality_net.index_vectors(TINY)
    assert set(np.abs(index).sum(axis=1)) <= {0, 2}
    total = np.zeros((quality_net.KINDS * 64, 8), dtype=np.int64)
    quality_net.add_contexts(total, found, index, TINY)
    want = np.zeros_like(total)
    for a, b in zip(found.first, found.first[1:], strict=False):
        for i in range(a, b):
            for kind in range(3):
                for j in range(max(a, i - 2), min(b, i + 3)):
                    for other in range(2):
                        if i != j or other != kind:
                            want[found.buckets[i, kind]] += np.roll(index[found.buckets[j, other]], j - i)
    assert (total == want).all()
    assert found.repeats.tolist() == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0]
    shapes = found.buckets[:, 1]
    assert shapes[0] != shapes[2] and shapes[1] == shapes[8] and shapes[7] == shapes[9]
    pooled = quality_net.pooled(texts, total.astype(np.float32), TINY)
    assert not pooled[1].any() and pooled[0, :8] == pytest.approx(total[found.buckets[:6, 0]].mean(axis=0))


def test_gradients_and_temperature():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 6)), (rng.random(40) < 0.4).astype(float)
    layers = [rng.normal(size=(6, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]

    def loss():
        z = quality_net.logits(x, layers)
        return np.mean(np.logaddexp(0, z) - y * z) + 0.05 * (np.square(layers[0]).sum() + np.square(layers[2]).sum())

    for w, g in zip(layers, quality_net.gradients(x, y, layers, 0.1), strict=True):
        for k in np.ndindex(w.shape):
            kept = w[k]
            w[k] = kept + 1e-6
            up = loss()
            w[k] = kept - 1e-6
            assert (up - loss()) / 2e-6 == pytest.approx(g[k], abs=1e-6)
            w[k] = kept
    z = rng.normal(size=20_000) * 2
    drawn = (rng.random(20_000) < quality_net.sigmoid(z)).astype(float)
    assert quality_net.fit_temperature(3 * z, drawn) == pytest.approx(3, rel=0.1)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op13_quality_net(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = found.join(labels, "doc_id").where("held_out").toPandas()
    assert len(held) > 100 and (held["predicted"] == held["quality"]).mean() >= 0.97
    assert found.count() == 1000 and found.where("score is null or score < 0 or score > 1").count() == 0


def test_quality_without_labels_and_of_odd_texts(spark):
    rows = [(k, ("calm words flow here and there " if k % 2 else "x9 ### !! x9 ### ") * (1 + k % 3)) for k in range(60)]
    rows += [(90, None), (91, ""), (92, " \n"), (None, "calm words"), (1, rows[1][1]), (93, "w " * 200_000)]
    docs = documents(spark, rows)
    some = [(k, k % 2, "z") for k in range(60)] + [(1, 1, "z"), (3, None, "z"), (5, 7, "z"), (None, 1, "z"), (777, 0, "z")]
    labels = spark.createDataFrame(some, "doc_id long, quality int, text string")
    model = quality_net.fit(docs, docs, labels, settings=TINY)
    scored = quality_net.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    by_id = {r["doc_id"]: r["score"] for r in scored}
    assert all((by_id[k] > 0.5) == (k % 2 == 1) for k in range(60))
    again = quality_net.fit(docs.repartition(7), docs.repartition(5), labels.repartition(3), settings=TINY)
    assert (again.vectors == model.vectors).all() and again.temperature == pytest.approx(model.temperature)
    for part, base in ((labels.limit(0), 0.5), (labels.where("quality = 1 and doc_id < 60"), 1.0)):
        flat = quality_net.score(docs, quality_net.fit(docs, docs, part, settings=TINY)).collect()
        assert {r["score"] for r in flat} == {base}
    none = docs.limit(0)
    assert quality_net.score(none, quality_net.fit(none, none, labels, settings=TINY)).count() == 0
