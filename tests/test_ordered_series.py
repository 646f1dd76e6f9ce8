import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import functionals as fn
from kohorta.operators import ordered
from kohorta.operators import perturbation as pt
from kohorta.operators.ordered import mid_rank, over_series, quantiles, row_index


@pytest.fixture(scope="module")
def skewed(spark):
    """Group `big` holds most rows, with many ties; `one` holds a single row."""
    rng = np.random.default_rng(0)
    rows = [("big", float(np.round(v, 1))) for v in rng.normal(size=3000)] + [("big", 0.0)] * 1500
    rows += [("small", float(v)) for v in rng.normal(size=40)] + [("one", 7.0)]
    return spark.createDataFrame(rows, "k string, v double")


def _ranks(values):
    values = np.sort(np.array(values))
    return {v: (np.searchsorted(values, v, "left") + 1 + np.searchsorted(values, v, "right")) / 2 for v in values}


@pytest.mark.parametrize("rows_per_bucket", [None, 100])
def test_mid_rank(skewed, rows_per_bucket):
    got = mid_rank(skewed, ["k"], "v", rows_per_bucket=rows_per_bucket).collect()
    local = skewed.toPandas()
    for k, part in local.groupby("k"):
        want = _ranks(part["v"])
        assert {r["v"]: r["mid_rank"] for r in got if r["k"] == k} == pytest.approx(want)


@pytest.mark.parametrize("rows_per_bucket", [None, 70])
def test_row_index_and_quantiles(skewed, rows_per_bucket):
    numbered = skewed.withColumn("id", F.monotonically_increasing_id())
    pos = row_index(numbered, ["k"], ["v", "id"], "t", rows_per_bucket).toPandas()
    for _, part in pos.groupby("k"):
        assert sorted(part["t"]) == list(range(1, len(part) + 1))
        assert part.sort_values("t")["v"].is_monotonic_increasing
    q = quantiles(skewed, ["k"], "v", {"a": 0.25, "b": 0.9}, rows_per_bucket).toPandas().set_index("k")
    for k, part in skewed.toPandas().groupby("k"):
        assert q.loc[k, "a"] == pytest.approx(np.quantile(part["v"], 0.25))
        assert q.loc[k, "b"] == pytest.approx(np.quantile(part["v"], 0.9))
    whole = quantiles(skewed, [], "v", {"m": 0.5}, rows_per_bucket).first()["m"]
    assert whole == pytest.approx(np.quantile(skewed.toPandas()["v"], 0.5))


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    rows = []
    for rec, n in (("a", 200), ("b", 9), ("c", 5), ("d", 1), ("e", 33)):
        rows += [(rec, "s", t, float(v)) for t, v in enumerate(rng.uniform(1, 2, size=n))]
    return spark.createDataFrame(rows, "Record string, series string, t int, value double")


def _series(frames):
    return {k: p.sort_values("t")["value"].to_numpy() for k, p in frames.toPandas().groupby("Record")}


@pytest.mark.parametrize("chunk", [None, 17])
def test_deltas_and_savitzky_golay(frames, chunk):
    series = _series(frames)
    d = fn.deltas(frames, chunk_rows=chunk).toPandas()
    sg = fn.savitzky_golay(frames, chunk_rows=chunk).toPandas()
    for rec, v in series.items():
        part = d[d.Record == rec].sort_values("t")
        np.testing.assert_allclose(part["delta1"].to_numpy()[1:], v[1:] - v[:-1])
        np.testing.assert_allclose(part["delta2"].to_numpy()[2:], v[2:] - v[:-2])
        got = sg[sg.Record == rec].sort_values("t")
        if len(v) < 9:
            assert got["slope"].isna().all()
            continue
        for i in range(len(v)):
            c = min(max(i, 4), len(v) - 5)
            fit = np.polyfit(np.arange(-4, 5), v[c - 4:c + 5], 2)
            assert got["slope"].iloc[i] == pytest.approx(fit[1])
            assert got["curve"].iloc[i] == pytest.approx(2 * fit[0])


def test_functionals(frames):
    series = _series(frames)
    for r in fn.functionals(frames).collect():
        v = series[r["Record"]]
        assert r["mean"] == pytest.approx(v.mean())
        if len(v) > 1:
            z = (v - v.mean()) / v.std()
            assert r["stdev"] == pytest.approx(v.std(ddof=1))
            assert r["skew"] == pytest.approx((z ** 3).mean()) and r["kurtosis"] == pytest.approx((z ** 4).mean() - 3)
    stats = {r["Record"]: r for r in fn.delta_stats(frames.filter("t < 2 OR Record <> 'c'")).collect()}
    assert stats["c"]["Delta1_stdev"] == 0.0 and stats["d"]["Delta1_mean"] is None


@pytest.mark.parametrize("chunk", [None, 23])
def test_perturbation(frames, chunk):
    j = {r["Record"]: r for r in pt.jitter(frames, 0.0, 10.0, 1.5, chunk_rows=chunk).collect()}
    s = {r["Record"]: r for r in pt.shimmer(frames, 1.6, chunk_rows=chunk).collect()}
    for rec, v in _series(frames).items():
        def spans(half, factor):
            out = []
            for i in range(half, len(v) - half):
                w = v[i - half:i + half + 1]
                if all(max(a, b) / min(a, b) <= factor for a, b in zip(w, w[1:])):
                    out.append(abs(v[i] - w.mean()))
            return np.mean(out) if out else None
        pairs = [abs(a - b) for a, b in zip(v, v[1:]) if max(a, b) / min(a, b) <= 1.5]
        if pairs:
            assert j[rec]["Local_jitter"] == pytest.approx(np.mean(pairs) / v.mean())
        for half, got in ((1, j[rec]["RAP_jitter"]), (2, j[rec]["PPQ5_jitter"])):
            want = spans(half, 1.5)
            assert got == (pytest.approx(want / v.mean()) if want is not None else None)
        if j[rec]["RAP_jitter"] is not None:
            assert j[rec]["DDP_jitter"] == pytest.approx(3 * j[rec]["RAP_jitter"])
            assert s[rec]["DDA_shimmer"] == pytest.approx(3 * s[rec]["APQ3_shimmer"])
        want = spans(5, 1.6)
        assert s[rec]["APQ11_shimmer"] == (pytest.approx(want / v.mean()) if want is not None else None)


def test_halo_must_fit(frames):
    with pytest.raises(ValueError):
        over_series(frames, 8, lambda w: {}, chunk_rows=8)


def test_reindex(frames):
    kept = frames.filter("value > 1.5")
    again = fn.reindex(kept, rows_per_bucket=20).toPandas()
    for rec, part in again.groupby("Record"):
        assert sorted(part["t"]) == list(range(1, len(part) + 1))


def test_text_order(spark):
    """Texts are cut by their first bytes; long shared beginnings end up in one range, still in order."""
    df = spark.range(500).select(F.concat(F.lit("o:"), F.format_string("%04d", F.col("id") * 7 % 500)).alias("rid"))
    got = row_index(df, [], ["rid"], "t", rows_per_bucket=60).orderBy("t").toPandas()
    assert list(got["rid"]) == sorted(got["rid"]) and list(got["t"]) == list(range(1, 501))


def test_split_and_whole_groups_agree_on_null_keys_ties_and_long_prefixes(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 3}", float(i % 50), f"/data/patients/session/record_{i:05d}") for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double, id string")
    probs = {"q": 0.5, "hi": 0.9}
    whole = {r.g: (r.q, r.hi) for r in ordered.quantiles(df, ["g"], "v", probs).collect()}
    cut = {r.g: (r.q, r.hi) for r in ordered.quantiles(df, ["g"], "v", probs, rows_per_bucket=40).collect()}
    assert whole == cut and cut[None] is not None and None not in cut[None]
    a = {r.id: r.t for r in ordered.row_index(df, [], ["id"]).collect()}
    b = {r.id: r.t for r in ordered.row_index(df, [], ["id"], rows_per_bucket=60).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 1501))
    points = ordered._split_points(df, [], "id", 60).first()["_fine"]
    assert len(points) > 10  # ids that share a long prefix are cut into ranges all the same
    totals = ordered.running(df.groupBy("g", "v").count(), ["g"], ["v"], {"c": F.col("count")}, sizing=df, rows_per_bucket=40,
                             totals=True)
    assert {(r.g, r.c_total) for r in totals.collect()} == {(None, 500), ("g1", 500), ("g2", 500)}


def test_split_points_are_bounded(spark):
    """A group of any size has few split points; the sums are those of every row."""
    df = spark.range(20000).select(F.lit("a").alias("g"), (F.col("id") * 7 % 20011).cast("double").alias("x"))
    points = ordered._split_points(df, ["g"], "x", 2).first()["_fine"]
    assert 1000 < len(points) <= ordered._FAN ** 2
    got = ordered.running(df, ["g"], ["x"], {"n": F.lit(1)}, rows_per_bucket=2).select("x", "n").orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(1, 20001))
