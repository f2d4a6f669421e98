"""Property tests (hypothesis): the split rolling operator equals pandas rolling
for random series, gaps, missing values and block sizes."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wattlane.operators.rolling import RollingSpec, rolling

SPECS = [RollingSpec("m", "mean", 48, 4), RollingSpec("s", "std", 48, 4),
         RollingSpec("q", "quantile", 168, 24, q=0.1),
         RollingSpec("qn", "quantile", 168, 24, q=0.1, interpolation="nearest"),
         RollingSpec("tm", "mean", 7, 2, center=False)]


def _pandas(pdf):
    pdf = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    g = pdf.groupby("k")["v"]
    for s in SPECS:
        r = g.rolling(s.window, min_periods=s.min_periods, center=s.center)
        if s.stat == "mean":
            v = r.mean()
        elif s.stat == "std":
            v = r.std()
        else:
            v = r.quantile(s.q, interpolation=s.interpolation)
        pdf[s.name] = v.reset_index(level=0, drop=True)
    return pdf


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), n=st.integers(1, 700), keys=st.integers(1, 3),
       block=st.integers(170, 400), chunk_days=st.integers(1, 40), nan_every=st.integers(2, 50))
def test_rolling_equals_pandas(spark, seed, n, keys, block, chunk_days, nan_every):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        t = dt.datetime(2024, 1, 1)
        for i in range(n):
            t += dt.timedelta(hours=int(rng.choice([1, 1, 1, 2, 5])))
            v = float(rng.normal(10, 3)) if i % nan_every else float("nan")
            rows.append((f"k{k}", t, v))
    pdf = pd.DataFrame(rows, columns=["k", "ts", "v"])
    sdf = spark.createDataFrame(pdf, "k string, ts timestamp_ntz, v double")
    from wattlane.sources.tables import nan_to_null
    got = (rolling(nan_to_null(sdf), "v", SPECS, keys=["k"], order="ts", block_rows=block,
                   chunk_days=chunk_days).toPandas().sort_values(["k", "ts"]).reset_index(drop=True))
    want = _pandas(pdf)
    assert len(got) == len(want)
    for s in SPECS:
        np.testing.assert_allclose(got[s.name].astype(float), want[s.name], rtol=1e-9, atol=1e-9,
                                   equal_nan=True, err_msg=s.name)


def _rect(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


rect = st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 6), st.integers(1, 6)).map(
    lambda t: (t[0], t[1], t[0] + t[2], t[1] + t[3]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cases=st.lists(st.tuples(rect, rect, st.booleans()), min_size=20, max_size=40))
def test_within_rectangles_exact(spark, cases):
    """Rectangles on an integer grid (many collinear contacts): building within
    (outer minus hole) <=> inside the outer rectangle and no interior overlap with the hole."""
    from wattlane.functions.geometry import within
    outer = (2, 2, 16, 16)
    rows, want = [], []
    for i, (b, h, use_hole) in enumerate(cases):
        hole = (max(h[0], 3), max(h[1], 3), min(max(h[2], max(h[0], 3) + 1), 15), min(max(h[3], max(h[1], 3) + 1), 15))
        holes = [_rect(*hole)] if use_hole else []
        rows.append((i, _rect(*b), _rect(*outer), holes))
        inside = outer[0] <= b[0] and b[2] <= outer[2] and outer[1] <= b[1] and b[3] <= outer[3]
        overlap = use_hole and b[0] < hole[2] and hole[0] < b[2] and b[1] < hole[3] and hole[1] < b[3]
        want.append(inside and not overlap)
    df = spark.createDataFrame(rows, "i int, b array<struct<x:double,y:double>>, "
                                     "e array<struct<x:double,y:double>>, "
                                     "h array<array<struct<x:double,y:double>>>")
    got = {r.i: r.w for r in df.select("i", within("b", "e", "h").alias("w")).collect()}
    assert [got[i] for i in range(len(cases))] == want


def test_within_notch_and_shared_hole_edge(spark):
    from wattlane.functions.geometry import within
    u = [(0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (25.0, 10.0), (25.0, 4.0), (15.0, 4.0), (15.0, 10.0), (0.0, 10.0)]
    rows = [("fills_notch", _rect(15, 4, 25, 10), u, []),
            ("under_notch", _rect(10, 2, 30, 4), u, []),
            ("hole_on_edge", _rect(0, 0, 10, 10), _rect(0, 0, 40, 10), [_rect(2, 0.0001, 8, 5)]),
            ("hole_shares_edge", _rect(0, 1, 10, 10), _rect(0, 0, 40, 10), [_rect(2, 1, 8, 5)])]
    df = spark.createDataFrame(rows, "n string, b array<struct<x:double,y:double>>, "
                                     "e array<struct<x:double,y:double>>, "
                                     "h array<array<struct<x:double,y:double>>>")
    got = {r.n: r.w for r in df.select("n", within("b", "e", "h").alias("w")).collect()}
    assert got == {"fills_notch": False, "under_notch": True, "hole_on_edge": False, "hole_shares_edge": False}
