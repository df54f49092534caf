"""The data source for classic MATLAB files, and the search for string payloads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.sources import mat5, recordings
from test_matlab import part, write


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.RandomState(0)
    signals = [rng.randn(n).astype(np.float32) for n in (25, 40)]
    for name, compress, x in (("b.mat", False, signals[0]), ("a.mat", True, signals[1])):
        write(tmp_path / name, compress, **part(0, len(x), EEG=x, EMG=-x.astype(np.float64), FrameTrigger=np.arange(len(x))))
    mat5.register(spark)
    return tmp_path, signals


def read(spark, folder, schema=None, **options):
    r = spark.read.format("mat5").options(**options)
    return (r.schema(schema) if schema else r).load(str(folder))


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_parts_are_numbered_through_and_sliced(spark, folder, prefix, monkeypatch):
    path, (b, a) = folder
    df = read(spark, f"{prefix}{path}", "sample long, part int, EEG float, EMG double, FrameTrigger long, Fs double", parts="b.mat,a.mat", slice="10")
    assert df.rdd.getNumPartitions() == 4  # three slices, and one file that is compressed
    got = df.orderBy("sample").toPandas()
    x = np.concatenate([b, a])
    assert got["sample"].tolist() == list(range(65)) and got["part"].tolist() == [0] * 25 + [1] * 40
    assert np.array_equal(got["EEG"], x) and np.array_equal(got["EMG"], -x.astype(float)) and set(got["Fs"]) == {100.0}
    assert got["FrameTrigger"].tolist() == [*range(25), *range(40)]


def test_compressed_variables_are_streamed(folder, monkeypatch):
    path, (_, a) = folder
    monkeypatch.setattr(mat5, "SLICE", 7)
    with open(path / "a.mat", "rb") as file:
        v = mat5.variables(file)["EEG"]
        got = list(mat5._numbers(file, v, 3, 39))
    assert v.packed and [len(x) for x in got] == [7] * 5 + [1] and np.array_equal(np.concatenate(got), a[3:39])


def test_default_schema_one_file_and_globs(spark, folder):
    path, (b, _) = folder
    one = read(spark, path / "b.mat")
    assert one.columns == ["path", "part", "sample", "Fs", "EEG", "EMG", "FrameTrigger"] and one.count() == 25
    assert dict(one.dtypes)["EEG"] == "float" and dict(one.dtypes)["FrameTrigger"] == "bigint"
    assert read(spark, path, "sample long", pathGlobFilter="a*").count() == 40
    assert read(spark, path, "sample long", pathGlobFilter="none*").count() == 0


def test_what_is_missing_is_told(spark, folder):
    path, _ = folder
    with pytest.raises(Exception, match="c.mat, d.mat"):
        read(spark, path, "EEG float", parts="c.mat,a.mat,d.mat").count()
    with pytest.raises(Exception, match="lacks ECG"):
        read(spark, path, "ECG float").count()
    write(path / "z.mat", **part(0, 5, EEG=np.zeros(3, np.float32)))
    with pytest.raises(Exception, match="EEG has 3"):
        read(spark, path, "EEG float, EMG float", parts="z.mat").count()
    (path / "y.mat").write_bytes(b"nothing")
    with pytest.raises(Exception, match="level 5"):
        read(spark, path, "EEG float", parts="y.mat").count()


def payload(strings):
    units = b"".join(s.encode("utf-16-le") for s in strings)
    units += b"\0" * (-len(units) % 8)
    return [1, 2, len(strings), 1, *[len(s.encode("utf-16-le")) // 2 for s in strings], *np.frombuffer(units, "<i8").tolist()]


def test_the_one_payload_of_strings_is_found(spark):
    right = payload(["V1", "", "S1BF ￮￮￮"])
    rows = [("a", "x", [3, 3, 3]), ("a", "y", right), ("a", "z", None), ("a", "w", [1, 2, 1, 1, -1]), ("b", "y", payload(["M2"])), ("b", "x", [1, 2, 9, 1])]
    df = spark.createDataFrame(rows, "container string, name string, words array<long>")
    got = {r["container"]: (r["name"], r["strings"]) for r in recordings.locate_strings(df).collect()}
    assert got == {"a": ("y", ["V1", "", "S1BF ￮￮￮"]), "b": ("y", ["M2"])}
    for odd, n in (([("c", "x", [7])], 0), ([("c", "x", right), ("c", "y", right)], 2)):
        with pytest.raises(Exception, match=f"c has {n} payloads"):
            recordings.locate_strings(df.union(spark.createDataFrame(odd, df.schema))).select(F.explode("strings")).collect()
    assert recordings.locate_strings(df.limit(0)).count() == 0
