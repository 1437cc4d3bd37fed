import math
from statistics import NormalDist

from ordo.operators import distributions as D


def test_difference_weights_multiply():
    assert D.difference_weights(((1, 1),)) == {0: 1, 1: -1}
    assert D.difference_weights(((2, 1),)) == {0: 1, 1: -2, 2: 1}
    assert D.difference_weights(((1, 1), (1, 12))) == {0: 1, 1: -1, 12: -1, 13: 1}


def test_difference_skips_what_is_before_the_start(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, 5, 4, 8])], "k string, t int, y double")
    got = [r.d for r in D.difference(rows, "y", "k", "t", ((2, 1),), "d").orderBy("t").collect()]
    assert got == [3.0, 5.0 - 6.0, 4.0 - 10.0 + 3.0, 8.0 - 8.0 + 5.0]


def test_density_and_degenerate_keys(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 7.0), ("c", 5.0), ("c", 5.0), ("a", None)]
    got = D.gaussian_density(spark.createDataFrame(rows, "k string, x double"), "x", "k").collect()
    fit = NormalDist.from_samples([1.0, 2.0, 4.0])
    for r in got:
        if r.x is None:
            assert r.pdf is None
        else:
            assert math.isclose(r.pdf, fit.pdf(r.x) if r.k == "a" else 0.0, rel_tol=1e-12)


def test_gaussian_nb_matches_plain_version(spark):
    rows = [("p", 1.0, 2.0), ("p", 2.0, 1.0), ("p", 1.5, 2.5), ("q", 8.0, 9.0), ("q", 9.0, 7.5), ("r", 4.0, 4.0)]
    df = spark.createDataFrame(rows, "y string, u double, v double")
    asked = spark.createDataFrame([(1.2, 2.0), (8.5, 8.0), (4.0, None)], "u double, v double")
    got = {r.u: (r.y_pred, r.score) for r in D.gaussian_nb_predict(asked, D.gaussian_nb_fit(df, ["u", "v"], "y"), ["u", "v"], "y").collect()}

    def score(label, u, v):
        own = [r for r in rows if r[0] == label]
        out = math.log(len(own) / len(rows))
        for i, x in ((1, u), (2, v)):
            if x is not None:
                values = [r[i] for r in own]
                out += math.log(1e-9 + (NormalDist.from_samples(values).pdf(x) if len(values) > 1 else 0.0))
        return out

    for u, v in ((1.2, 2.0), (8.5, 8.0), (4.0, None)):
        want = max((score(label, u, v), label) for label in "pqr")
        assert got[u][0] == want[1] and math.isclose(got[u][1], want[0], rel_tol=1e-9)


def test_gaussian_nb_of_other_folds(spark):
    """A fold's model equals one fitted on the other rows."""
    rows = [("p" if i % 3 else "q", 1e4 + (i * 7 % 11), float(i % 5) if i % 4 else None, i % 3 + i % 2) for i in range(60)] + [(None, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "y string, u double, v double, fold int")
    model = {(r.fold, r.y): r for r in D.gaussian_nb_fit(df, ["u", "v"], "y", "fold").collect()}
    for fold in range(4):
        plain = {r.y: r for r in D.gaussian_nb_fit(df.filter(f"fold <> {fold}"), ["u", "v"], "y").collect()}
        for y, want in plain.items():
            got = model[fold, y]
            assert got.n == want.n
            for f in "uv":
                assert math.isclose(got[f].mu, want[f].mu) and math.isclose(got[f].sigma2, want[f].sigma2, rel_tol=1e-9)
    out = D.gaussian_nb_predict(df, D.gaussian_nb_fit(df, ["u", "v"], "y", "fold"), ["u", "v"], "y", "fold")
    assert out.count() == 61 and out.filter("y_pred IS NULL").count() == 0


def test_pmf_and_label_combinations(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, None, 1), (4, 1, 0)], "i int, a int, b int")
    coded, codes = D.label_powerset(df, ["a", "b"])
    assert {r.i: r.combination for r in coded.collect()} == {1: 1, 2: 2, 3: 0, 4: 2}
    assert codes.count() == 3
    assert {r.a: r.pmf for r in D.multinomial_pmf(df, "a").collect()} == {0: 1 / 3, 1: 2 / 3}
    assert D.multinomial_pmf(df.limit(0), "a").count() == 0
