"""Vector models, splits and validation against plain computations."""

from __future__ import annotations

import json
import random
from datetime import date, timedelta

import numpy as np

from tapeline.functions.splits import add_months, month_splits
from tapeline.operators import study, vectors


def _vectors(spark, n=80, d=7, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(i, int(i % 3), [float(v) for v in x[i]], "z") for i in range(n)]
    return x, spark.createDataFrame([*rows, (900, 1, None, "z")], "vec_id bigint, label bigint, embedding array<double>, place string")


def test_similarities_use_every_dimension(spark):
    x, frame = _vectors(spark)
    cov = np.cov(x.T)
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0)))
    got = {r.vec_id: r.sim for r in vectors.mahalanobis_similarity(frame.repartition(5), "embedding").collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + d)) and got[900] is None
    mixed = {r.vec_id: r.sim for r in vectors.mixture_similarity(frame.repartition(5), "embedding", "label").collect()}
    for label in range(3):
        own = x[label::3]
        form = np.linalg.inv(np.cov(own.T, bias=True) + 1e-6 * np.eye(x.shape[1]))
        d2 = np.einsum("ij,jk,ik->i", own - own.mean(0), form, own - own.mean(0))
        assert np.allclose([mixed[i] for i in range(label, len(x), 3)], len(own) / len(x) * np.exp(-d2 / 2))
    assert vectors.mahalanobis_similarity(frame.where("1 = 0"), "embedding").count() == 0
    assert vectors.mixture_similarity(frame.where("1 = 0"), "embedding", "label").count() == 0


def test_adjusted_rand():
    assert vectors.adjusted_rand({(0, 1): 5, (1, 0): 7}) == 1.0
    assert abs(vectors.adjusted_rand({(0, 0): 2, (0, 1): 1, (1, 1): 3}) - 0.324) < 0.001  # from the definition: (4 - 2.8) / (6.5 - 2.8)


def test_archetypes_find_what_is_there(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, size=(40, 3)) for m in ((0, 0, 0), (6, 6, 0))])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, v array<double>")
    ledger = vectors.archetypes(frame, "k", "v", vectors.Archetypes(counts=(2,), fits=2))
    good = [r for r in ledger if r["status"] == "accepted"]
    assert len(good) == 4 and {r["n"] for r in good} == {40} and all(r["silhouette"] > 0.8 and 2 not in r["top"][:2] for r in good)
    (document,) = study.payloads(ledger, ["week", "quarter"])
    assert len(json.loads(document)["archetypes"]) == 4 and json.loads(document)["days"] == 5
    assert vectors.archetypes(frame.where("k < 9"), "k", "v") == [{"model": "", "k": 0, "cluster": -1, "status": "insufficient_samples", "n": 9}]
    tiny = vectors.archetypes(frame.where("k < 45"), "k", "v", vectors.Archetypes(counts=(2,), models=("kmeans",)))
    assert [r["status"] for r in tiny] == ["tiny_cluster"] and tiny[0]["n"] == 5


def test_month_splits():
    assert add_months(date(2024, 1, 31), 1) == date(2024, 2, 29) and add_months(date(2024, 11, 30), 3) == date(2025, 2, 28)
    days = [d for k in range(200) if (d := date(2024, 1, 1) + timedelta(k)).weekday() < 5]
    splits = month_splits(days[::-1] + days[:3], 2, 1, 1, 5)
    assert [s["validation"][0] for s in splits] == [date(2024, 3, 1), date(2024, 4, 1), date(2024, 5, 1), date(2024, 6, 3)]
    for s in splits:
        assert len(s["purge"]) == len(s["embargo"]) == 5 and max(s["train"]) < min(s["purge"]) < max(s["purge"]) < min(s["validation"]) and max(s["validation"]) < min(s["embargo"])
    assert month_splits([], 2, 1, 1, 5) == []


def test_validation_against_plain_sums(spark):
    rng = random.Random(2)
    start = date(2024, 1, 1)
    rows = [(f"c{c:02d}", start + timedelta(d), rng.randrange(-50_000, 60_000), rng.randrange(-300, 300), -rng.randrange(90_000), rng.randrange(1, 9_000), rng.random() < 0.3, rng.random() < 0.4, float(rng.randrange(20)), d // 4) for c in range(9) for d in range(12)]
    frame = spark.createDataFrame(rows, "code string, d date, r int, mex int, dd int, amt int, pos boolean, signal boolean, score double, split int")
    got = {m.metric: m.value for m in study.validation(frame.repartition(4), cost_bps=10).collect()}
    picked = sorted((r for r in rows if r[7]), key=lambda r: (r[1], r[0]))
    run = longest = 0
    for r in picked:
        run = run + 1 if r[2] <= 0 else 0
        longest = max(longest, run)
    sets = [{r[0] for r in rows if r[1] == start + timedelta(d) and r[7]} for d in range(12)]
    change = [1.0 if sets[0] else 0.0] + [1 - len(a & b) / len(a | b) if a | b else 0.0 for a, b in zip(sets, sets[1:])]
    turnover = sum(change) / 12
    assert got["max_losing_streak"] == longest and abs(got["turnover"] - turnover) < 1e-12
    assert abs(got["cost_adjusted_return"] - (sum(r[2] for r in picked) / len(picked) / 1e6 - turnover / 1000)) < 1e-12
    best = sorted(rows, key=lambda r: (-r[8], r[1], r[0]))[:10]
    assert abs(got["precision_at_10"] - sum(r[6] for r in best) / 10) < 1e-12
    low, high = min(r[8] for r in rows), max(r[8] for r in rows)
    bins = {}
    for r in rows:
        p = (r[8] - low) / (high - low)
        bins.setdefault(min(4, int(p * 5)), []).append((p, r[6]))
    assert abs(got["calibration_error"] - sum(abs(sum(p for p, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(rows)) < 1e-12
    assert got["top_stock_contribution"] == max(sum(r[0] == c for r in picked) for c in {r[0] for r in picked}) / len(picked)
    assert study.validation(frame.where("1 = 0")).count() == 0


def test_losing_runs_across_dates():
    assert study.longest_losing_run([(3, 2, 0, 2), (4, 4, 4, 4), (5, 2, 1, 2), (2, 1, 1, 0)]) == 7
    assert study.longest_losing_run([]) == 0
