"""Physiology parts from classic MATLAB files (level 5): named variables only, checked, as a table of samples.

A file is one row of Spark's binaryFile source and is read by one task; parts and recordings are read side by
side. Level 7.3 files are HDF5 and are converted to Parquet elsewhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recordings import concat_parts

#: Element types of the format, its array classes, and the variables and units of a part.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
_MATRIX, _COMPRESSED, _CELL, _CHAR = 14, 15, 1, 4
VARIABLES = ("Fs", "ChannelNames", "ChannelUnits", "EEG", "EMG", "FrameTrigger")
UNITS = {"FrameTrigger": "v", "EEG": "mv", "EMG": "mv"}


def part_names(recording: str) -> list[str]:
    """File names of a recording's parts in order of time: two for the one that was stored in two."""
    parts = ["_awake", "_ane"] if recording == "mouse06_ane" else [""]
    return [f"{recording}_physiological_data{p}.mat" for p in parts]


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: its size and data share the word
            size, kind = kind >> 16, kind & 0xFFFF
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)


def _matrix(data: bytes, order: str, wanted=None):
    """(name, value) of an array: numbers in file order, text, or a list of these; value None if it is not wanted."""
    parts = list(_elements(data, order))
    kind = struct.unpack(order + "I", parts[0][1][:4])[0] & 0xFF
    name = parts[2][1].decode("latin-1")
    if wanted is not None and name not in wanted:
        return name, None
    if kind == _CELL:
        return name, [_matrix(d, order)[1] for k, d in parts[3:] if k == _MATRIX]
    values = np.frombuffer(parts[3][1], np.dtype(order + _TYPES[parts[3][0]])) if len(parts) > 3 else np.zeros(0)
    return name, "".join(map(chr, values.tolist())) if kind == _CHAR else values


def read_variables(data: bytes, wanted: tuple[str, ...] = VARIABLES) -> dict:
    """The wanted variables of a level 5 file."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 MATLAB file")
    order, out = ("<" if data[126:128] == b"IM" else ">"), {}
    for kind, body in _elements(data[128:], order):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == _MATRIX:
            name, value = _matrix(body, order, wanted)
            if value is not None:
                out[name] = value
    return out


def check_part(name: str, raw: dict) -> tuple[float, dict[str, np.ndarray]]:
    """(rate, signals) of a part's variables; ValueError for what is missing, uneven, not finite or in other units."""
    if missing := sorted(set(VARIABLES) - set(raw)):
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    rate = np.ravel(raw["Fs"])
    if len(rate) != 1 or not np.isfinite(rate[0]) or rate[0] <= 0:
        raise ValueError(f"{name}: Fs must be one finite positive number")
    signals = {c: np.ravel(raw[c]).astype(np.float32) for c in UNITS}
    if len({len(x) for x in signals.values()}) != 1 or not len(signals["EEG"]):
        raise ValueError(f"{name}: the signals differ in length or are empty")
    if bad := [c for c, x in signals.items() if not np.isfinite(x).all()]:
        raise ValueError(f"{name}: {', '.join(bad)} has samples that are not finite")
    text = lambda v: [str(x).strip() for x in (v if isinstance(v, list) else [v])]
    names, units = text(raw["ChannelNames"]), text(raw["ChannelUnits"])
    if len(names) != len(units):
        raise ValueError(f"{name}: channels and units differ in number")
    unit = dict(zip(names, units, strict=True))
    for channel, wanted in UNITS.items():
        if channel not in unit:
            raise ValueError(f"{name}: no channel {channel}")
        if unit[channel].lower() != wanted:
            raise ValueError(f"{name}: {channel} is in {unit[channel]}, not {wanted}")
    return float(rate[0]), signals


def load_physiology(spark: SparkSession, folder: str, recording: str) -> tuple[DataFrame, DataFrame, float]:
    """(samples, boundaries, fs) of a recording: its parts one after another, and the first sample of each but the first.

    samples is (recording, part, sample, eeg, emg, trig), numbered through. Parts must have the same rate.
    """
    names = part_names(recording)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{recording}_physiological_data*.mat").load(folder)
    found = {r["name"] for r in files.select(F.substring_index("path", "/", -1).alias("name")).collect()}  # two at most
    if missing := [n for n in names if n not in found]:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.substring_index("path", "/", -1)) - 1

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, path, content in zip(pdf["part"], pdf["path"], pdf["content"], strict=True):
                rate, x = check_part(path.rpartition("/")[2], read_variables(content))
                for lo in range(0, len(x["EEG"]), 1_000_000):
                    own = slice(lo, lo + 1_000_000)
                    n = len(x["EEG"][own])
                    yield pd.DataFrame({"recording": recording, "part": part, "sample": np.arange(lo, lo + n), "eeg": x["EEG"][own], "emg": x["EMG"][own], "trig": x["FrameTrigger"][own], "fs": rate})

    parts = files.withColumn("part", order.cast("int")).where("part >= 0").select("part", "path", "content")
    rows = parts.mapInPandas(read, "recording string, part int, sample long, eeg float, emg float, trig float, fs double")
    rates = [r[0] for r in rows.groupBy("part").agg(F.first("fs")).select("first(fs)").collect()]
    if any(abs(r - rates[0]) > 1e-8 + 1e-5 * abs(rates[0]) for r in rates):
        raise ValueError(f"{recording}: parts have different rates")
    samples = concat_parts(rows.drop("fs"))
    boundaries = samples.groupBy("part").agg(F.min("sample").alias("sample")).where("part > 0").select("sample")
    return samples, boundaries, rates[0]
