"""Drift kernels: golden behaviour on a two-segment stream; HST = online HST."""

import numpy as np
import pytest

from ordo.operators import anomaly as A
from ordo.operators import drift as D
from ordo.operators.anomaly import hst_leaves, hst_score_window, hst_trees


def _mean_shift():
    np.random.seed(12345)
    return np.concatenate((np.random.randint(2, size=1000), np.random.randint(8, size=1000))).astype(float)


def _error_rates():
    np.random.seed(12345)
    return np.concatenate([np.random.binomial(1, 0.2, 1000), np.random.binomial(1, 0.8, 1000)]).astype(float)


def _abrupt():
    np.random.seed(12345)
    return np.concatenate([np.random.normal(m, 0.1, 500) > 0 for m in (0.0, 0.25, 0.0, 0.25)]).astype(float)


# fixed values: published drift positions on these three streams
GOLDEN = [
    ("adwin", {}, _mean_shift, [1055, 1087, 1215]),
    ("ddm", {}, _error_rates, [1049]),
    ("eddm", {}, _error_rates, [681, 848, 983, 1042, 1089]),
    ("hddm_a", {}, _error_rates, [1047]),
    ("hddm_a", {"two_sided_test": True}, _abrupt, [531, 1015, 1545]),
    ("hddm_w", {}, _error_rates, [1018]),
    ("hddm_w", {"two_sided_test": True}, _abrupt, [507, 1508]),
    ("kswin", {"alpha": 0.0001, "window_size": 200, "stat_size": 100}, _mean_shift, [1043, 1143]),
    ("page_hinkley", {}, _mean_shift, [1020, 1991]),
]


@pytest.mark.parametrize("name, params, stream, expected", GOLDEN)
def test_drift_positions(name, params, stream, expected):
    assert np.flatnonzero(D.DETECTORS[name](**params).scan(stream())[0]).tolist() == expected


@pytest.mark.parametrize("name", D.DETECTORS)
def test_scan_does_not_depend_on_batches(name):
    xs = _mean_shift() if name in ("adwin", "kswin", "page_hinkley") else _abrupt()
    whole, det = D.DETECTORS[name]().scan(xs), D.DETECTORS[name]()
    parts = [np.concatenate(p) for p in zip(*[det.scan(xs[i : i + 7]) for i in range(0, len(xs), 7)], strict=True)]
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert np.allclose(whole[2], parts[2], equal_nan=True)


def test_detect_drift_by_key_with_nulls_and_stream(spark, tmp_path):
    from ordo.streaming.drift import detect_drift_stream

    xs = _mean_shift()
    rows = [(k, i, None if k == "b" and i % 10 == 0 else float(x)) for k in ("a", "b", None) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    got = D.detect_drift(df, "x", "k", "i", detector="page_hinkley").toPandas()
    assert len(got) == len(rows)
    for key in ("a", None):
        mine = got[got.k.isna() if key is None else got.k == key].sort_values("i")
        assert mine[mine.drift].i.tolist() == [1020, 1991]
    b = got[got.k == "b"].sort_values("i")
    expected = D.PageHinkley().scan(np.array([np.nan if i % 10 == 0 else x for i, x in enumerate(xs)]))
    assert b.drift.tolist() == expected[0].tolist()
    assert b.estimate.isna().tolist() == [i % 10 == 0 for i in range(len(xs))]

    for part in range(4):  # four files, so state is carried over triggers
        df.filter(f"k = 'a' and i >= {part * 500} and i < {part * 500 + 500}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (detect_drift_stream(sdf, "x", "k", "i", detector="page_hinkley").writeStream.format("parquet")
           .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    run.awaitTermination()
    flags = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("i")
    assert flags[flags.drift].i.tolist() == [1020, 1991]


def test_hst_window_scores_equal_online_algorithm():
    rng = np.random.default_rng(1)
    X = rng.random((600, 3))
    h, n_trees, W = 5, 4, 50
    feat, thr = hst_trees(["a", "b", "c"], n_trees, h, seed=3)
    L = hst_leaves(X, feat, thr, h)
    l_mass = [np.zeros(2 ** (h + 1)) for _ in range(n_trees)]
    r_mass = [np.zeros(2 ** (h + 1)) for _ in range(n_trees)]
    first, cnt, expected = True, 0, []
    for i in range(len(X)):
        if first:
            expected.append(0.0)
        else:
            s = 0.0
            for t in range(n_trees):
                node = 1
                for d in range(h + 1):
                    s += r_mass[t][node] * 2 ** d
                    if r_mass[t][node] < 0.1 * W:
                        break
                    if d < h:
                        node = 2 * node + int(X[i, feat[t, node]] >= thr[t, node])
            expected.append(1 - s / (n_trees * W * (2 ** (h + 1) - 1)))
        for t in range(n_trees):
            node = 1
            for d in range(h + 1):
                l_mass[t][node] += 1
                if d < h:
                    node = 2 * node + int(X[i, feat[t, node]] >= thr[t, node])
        cnt += 1
        if cnt == W:
            r_mass, l_mass = l_mass, [np.zeros(2 ** (h + 1)) for _ in range(n_trees)]
            first, cnt = False, 0
    got = []
    for w in range(len(X) // W):
        rows = L[w * W:(w + 1) * W]
        got += [0.0] * W if w == 0 else list(hst_score_window(rows, L[(w - 1) * W:w * W], n_trees, h, W))
    assert np.allclose(got, expected, atol=1e-12)


def test_hst_scores_of_many_windows_in_one_go(monkeypatch):
    """Equal to window after window, first windows and halves of windows included, without a call for each."""
    rng = np.random.default_rng(5)
    for n_trees, h, W, n, own, first in [(4, 6, 20, 210, 20, 3), (4, 6, 20, 207, 0, 0), (3, 5, 4, 33, 4, 1), (2, 1, 7, 7, 0, 5)]:
        X = rng.random((n, 3))
        X[: n // 2, 1] = 0.0
        L = A.hst_leaves(X, *hst_trees("abc", n_trees, h, seed=2), h)
        windows = first + np.arange(n) // W
        want = np.zeros(n)
        for w in range(max(1, first), windows[-1] + 1):
            want[windows == w] = hst_score_window(L[windows == w], L[windows == w - 1], n_trees, h, W)
        with monkeypatch.context() as m:
            m.delattr(A, "hst_score_window")
            assert (A.hst_scores(L, windows, own, n_trees, h, W) == want[own:]).all()
