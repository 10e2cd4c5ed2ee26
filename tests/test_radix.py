"""Order statistics from bit histograms against sorting."""

import tracemalloc

import numpy as np
import pytest

from gradeflow.operators import experiment as X
from gradeflow.operators import numeric as NU
from gradeflow.plans import radix


def test_bits_order_like_the_numbers():
    v = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, np.inf])
    s = radix.sortable(v)
    assert (np.diff(s) > 0).all()
    assert (radix.double_of(s) == v).all()


@pytest.mark.parametrize("held", [1 << 20, 64])
def test_percentiles_match_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(radix, "HELD_ROWS", held)
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=300), 1), "c": np.full(9, 7.25), "d": np.array([-3.0]),
              "e": np.r_[np.full(400, 1.0), np.nextafter(1.0, 2.0), 1e308, -1e308]}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {(r["k"], r["p_idx"]): (r["value"], r["n"]) for r in NU.exact_percentiles(df, "x", [0.0, 0.25, 0.5, 1.0], by="k").collect()}
    assert len(got) == 4 * len(groups)
    for g, v in groups.items():
        for i, p in enumerate([0.0, 0.25, 0.5, 1.0]):
            assert got[(g, i)] == (pytest.approx(np.quantile(v, p), rel=1e-12), len(v))
    grid = {(r["k"], r["p_idx"]): r["value"] for r in NU.exact_percentiles(df, "x", by="k", grid=50).collect()}
    for g, v in groups.items():
        q = min(50, len(v))
        want = np.quantile(v, np.linspace(0, 1, q)) if q > 1 else v
        assert np.allclose([grid[(g, i)] for i in range(q)], want, rtol=1e-12)
    whole = NU.exact_percentiles(df.filter("k = 'a'"), "x", [0.5]).collect()
    assert [r["value"] for r in whole] == [pytest.approx(np.median(groups["a"]))]
    assert NU.exact_percentiles(df.limit(0), "x", [0.5], by="k").count() == 0


def test_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (2, 5.0)], "k int, x double")
    got = {r["k"]: r["value"] for r in NU.exact_percentiles(df, "x", [0.5], by="k").collect()}
    assert got == {2: 5.0, None: 2.0}


def test_imputation_of_several_columns(spark):
    rows = [("t", 1.0, None), ("t", None, 2), ("t", 3.0, 4), ("v", None, None), (None, None, 1)]
    df = spark.createDataFrame(rows, "split string, a double, b int")
    got = [tuple(r) for r in NU.impute_median(df, ["a", "b"]).collect()]
    want = [("t", 1.0, 3.0), ("t", 2.0, 2.0), ("t", 3.0, 4.0), ("v", None, None), (None, None, 1.0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = NU.impute_median(df, ["a"], by=None).collect()
    assert all(r["a"] is not None for r in whole)


def test_groups_share_the_columns_of_a_pass(spark):
    """What a pass brings to the driver is held once, not once for each group."""
    values = spark.createDataFrame([(str(i % 40), float(i)) for i in range(4000)], "g string, v double")
    found = radix._pass(values, 0, radix.FIRST_BITS, None)
    for k in range(1, 5):
        held = {id(row[k].base): row[k].base.nbytes for row in found}
        assert len(held) == 1 and sum(held.values()) == sum(row[k].nbytes for row in found)


@pytest.mark.parametrize("held", [1 << 20, 64])
def test_references_reach_the_driver_as_arrays(spark, monkeypatch, held):
    """A thousand references of a fold and column are one array, not a thousand rows."""
    monkeypatch.setattr(radix, "HELD_ROWS", held)
    rng = np.random.default_rng(1)
    cols = [f"c{i}" for i in range(8)]
    x = rng.normal(size=(2400, len(cols)))
    x[::50, 0] = np.nan
    rows = [(["f", "g"][i % 2], "dev" if i % 20 == 2 else "train", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"fold string, split string, {', '.join(c + ' double' for c in cols)}")
    names = np.array([[r[0], r[1]] for r in rows])
    tracemalloc.start()
    fitted = X.prepare(df, cols)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(fitted.medians) == 3 * len(cols) and len(fitted.references) == 2 * len(cols)
    for fold in ("f", "g"):
        mine = (names[:, 0] == fold) & (names[:, 1] == "train")
        for i, c in enumerate(cols):
            want = np.where(np.isnan(x[mine, i]), np.nanmedian(x[mine, i]), x[mine, i])
            assert fitted.medians[f"{fold}\x1ftrain\x1f{c}"] == pytest.approx(np.nanmedian(x[mine, i]), rel=1e-12)
            probs, values = fitted.references[f"{fold}\x1f{c}"]
            assert len(values) == 1000 and np.allclose(values, np.quantile(want, probs), rtol=1e-12)
    assert most < 3 << 20
    nothing = X.prepare(df.limit(0), cols)
    assert nothing.medians == {} and nothing.references == {}
