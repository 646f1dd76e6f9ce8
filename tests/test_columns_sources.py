import pytest
from pyspark.sql import functions as F

from kohorta.functions import columns as C
from kohorta.functions import formulas as fm
from kohorta.operators import assemble, quality
from kohorta.session import shared_dir
from kohorta.sources import tables as IO


def test_labels_and_columns(spark, cohort):
    assert C.feature_columns(cohort) == ["good", "copy", "noise", "constant", "tiny"]
    with pytest.raises(ValueError):
        C.assign_label(cohort, 2)
    codes = spark.createDataFrame([(0,), (1,), (7,)], "c int").select(C.label_name(F.col("c")).alias("n")).collect()
    assert [r["n"] for r in codes] == ["Control", "Pathological", "Unknown"]
    assert C.reorder_columns(cohort.select("noise", "Diagnosed", "Record")).columns == ["Record", "Diagnosed", "noise"]
    assert len(C.MARKERS) == 22 and C.marker_dimension(spark).filter("significant").count() == 5


def test_paths(spark):
    df = spark.createDataFrame([("/x/test1.wav",), ("/x/.hidden.wav",), ("/x/a.b.MP3",), ("/x/plain",)], "path string")
    p = F.col("path")
    got = df.select(C.file_stem(p).alias("s"), C.file_extension(p).alias("e"), C.is_hidden(p).alias("h")).collect()
    assert [tuple(r) for r in got] == [("test1", ".wav", False), (".hidden", ".wav", True), ("a.b", ".mp3", False),
                                       ("plain", "", False)]


def test_recordings_on_disk(spark, tmp_path):
    for name in ("test1.wav", "test2.wav", "test3.mp3", ".hidden.wav", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "empty.ogg").write_bytes(b"")
    files = IO.scan_files(spark, str(tmp_path))
    names = sorted(r["n"] for r in IO.list_recordings(files).select(C.file_name(F.col("path")).alias("n")).collect())
    assert names == ["test1.wav", "test2.wav", "test3.mp3"]
    assert IO.pick_recordings(files, ["test1", "test3.mp3", "absent"]).count() == 2
    report = {r["path"].split("/")[-1]: r["severity"] for r in IO.validate_folder(spark, str(tmp_path)).collect()}
    assert report["empty.ogg"] == "error" and report["test1.wav"] == "success"
    assert IO.validate_folder(spark, str(tmp_path / "nope")).first()["severity"] == "error"


def test_csv_round_trip(spark, cohort):
    root = shared_dir(spark) + "/roundtrip"
    IO.write_result(cohort, root, "dataset", "d.csv")
    back = IO.read_result(spark, root, "dataset", "d.csv")
    assert back.columns == cohort.columns and back.count() == 50
    a = {r["Record"]: r["good"] for r in cohort.collect()}
    assert all(abs(a[r["Record"]] - r["good"]) <= 5.1e-5 for r in back.collect())
    with pytest.raises(FileNotFoundError):
        IO.read_dataset(spark, "missing.csv", [root])


def test_validation(spark, cohort):
    assert quality.is_valid(quality.validate_dataset(cohort))
    bad = spark.createDataFrame(
        [("a", "Control", 1.0), ("a", "Invalid", float("inf")), (None, "Control", float("nan"))],
        "Record string, Diagnosed string, f double")
    got = {(r["check"], r["detail"]): (r["severity"], r["n"]) for r in quality.validate_dataset(bad).collect()}
    assert got["labels", "Invalid"] == ("error", 1)
    assert got["duplicates", "Record"] == ("warning", 1)
    assert got["infinite_values", "f"] == ("warning", 1)
    assert got["missing_values", "Record"] == ("warning", 1) and got["missing_values", "f"] == ("warning", 1)
    no_label = quality.validate_dataset(bad.drop("Diagnosed"))
    assert not quality.is_valid(no_label)
    lines = [r["line"] for r in quality.validation_text(no_label).collect()]
    assert lines[0].startswith("ERROR")


def test_pca_conditions(spark):
    def ok(rows):
        return quality.pca_conditions(spark.createDataFrame(rows, "a double, b double")).first()["ok"]
    assert ok([(1.0, 2.0), (3.0, 5.0)])
    assert not ok([(1.0, None), (3.0, 5.0)])
    assert not ok([(1.0, 2.0)] * 3)
    assert not ok([(1.0, 1.0), (3.0, 5.0)])


def test_merge(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "Record string, f double")
    b = spark.createDataFrame([("x", 3.0), ("z", 4.0)], "Record string, f double")
    with pytest.raises(ValueError):
        assemble.merge_on_record(a, b)
    assert assemble.merge_on_record(a, b, "outer", ("_x", "_y")).count() == 3
    assert assemble.merge_features(a, b.withColumnRenamed("f", "g"), "Control").first()["Diagnosed"] == "Control"
    groups = assemble.build_cohort([(a, b.withColumnRenamed("f", "g"), "Control"), (a, b.withColumnRenamed("f", "g"), "Pathological")])
    assert groups.columns == ["Record", "Diagnosed", "f", "g"] and groups.count() == 2


def test_formulas(spark):
    import math
    df = spark.createDataFrame([(float(i) / 4, i) for i in range(1, 40)], "x double, n int")
    rows = df.select("x", "n", fm.erfc(F.col("x")).alias("e"), fm.digamma(F.col("n")).alias("d"),
                     fm.kolmogorov_tail(F.lit(0.3), F.lit(50.0), F.lit(60.0)).alias("k")).collect()
    for r in rows:
        if r["x"] < 5:
            assert abs(r["e"] / math.erfc(r["x"]) - 1) < 1e-12
        harmonic = sum(1 / j for j in range(1, r["n"])) - 0.5772156649015329
        assert abs(r["d"] - harmonic) < 1e-10
    assert abs(fm.student_tail(2.306004135, 8) - 0.05) < 1e-8
    assert abs(fm.student_tail(0.0, 8) - 1) < 1e-12
