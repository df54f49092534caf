"""Physiology parts from small files written here."""

import struct
import zlib

import numpy as np
import pytest

from popgraph.sources import matlab


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, value):
    if isinstance(value, list):
        kind, dims, body = 1, (1, len(value)), b"".join(array("", v) for v in value)
    elif isinstance(value, str):
        kind, dims, body = 4, (1, len(value)), element(17, value.encode("utf-16-le"))
    else:
        value = np.atleast_1d(value)
        kind, dims, body = 7, (1, value.size), element({"f": 7, "d": 9, "q": 12}[value.dtype.char] if value.dtype.char in "fdq" else 12, value.tobytes())
    return element(14, element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack("<ii", *dims)) + element(1, name.encode()) + body)


def write(path, compress=False, **variables):
    own = [array(k, v) for k, v in variables.items()]
    if compress:
        own = [struct.pack("<II", 15, len(z := zlib.compress(x))) + z for x in own]
    path.write_bytes(b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(own))


def part(value, n, **other):
    x = np.full(n, value, np.float32)
    return {"Fs": np.int64(100), "EEG": x, "EMG": x, "FrameTrigger": x, "ChannelNames": ["FrameTrigger", "EEG", "EMG"], "ChannelUnits": ["V", "mV", "mV"]} | other


def test_two_parts_follow_each_other(spark, tmp_path):
    write(tmp_path / "mouse06_ane_physiological_data_awake.mat", **part(1, 6))
    write(tmp_path / "mouse06_ane_physiological_data_ane.mat", True, **part(2, 4))
    samples, boundaries, fs = matlab.load_physiology(spark, str(tmp_path), "mouse06_ane")
    got = samples.orderBy("sample").collect()
    assert [r["eeg"] for r in got] == [1.0] * 6 + [2.0] * 4 and [r["sample"] for r in got] == list(range(10))
    assert [r["sample"] for r in boundaries.collect()] == [6] and fs == 100
    with pytest.raises(FileNotFoundError, match="mouse01"):
        matlab.load_physiology(spark, str(tmp_path), "mouse01_sleep")


@pytest.mark.parametrize(
    ("other", "told"),
    [({"EMG": None}, "EMG"), ({"Fs": np.float64(-1)}, "Fs"), ({"EEG": np.zeros(3, np.float32)}, "length"), ({"EEG": np.full(6, np.nan, np.float32)}, "finite"), ({"ChannelUnits": ["V", "uV", "mV"]}, "uV"), ({"ChannelNames": ["a", "EEG", "EMG"]}, "FrameTrigger")],
)
def test_bad_parts_are_told(tmp_path, other, told):
    write(tmp_path / "x.mat", **{k: v for k, v in part(1, 6, **other).items() if v is not None})
    with pytest.raises(ValueError, match=told):
        matlab.check_part("x.mat", matlab.read_variables((tmp_path / "x.mat").read_bytes()))


def test_only_wanted_variables_are_decoded(tmp_path):
    write(tmp_path / "x.mat", Fs=np.float64(5), other=np.zeros(9))
    assert list(matlab.read_variables((tmp_path / "x.mat").read_bytes(), ("Fs",))) == ["Fs"]
    with pytest.raises(ValueError):
        matlab.read_variables(b"nothing")
