"""Fixed dimensions: state codes, cortical regions, recordings' trigger manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: State codes of the two kinds of recording. Code 1 differs between them.
STATE_CODES = {
    "sleep": {"awake": 0.0, "quiet_awake": 0.5, "nrem": 1.0, "rem": 2.0},
    "ane": {"awake": 0.0, "anesthesia": 1.0},
}

#: Cortical areas in anatomical order, with their full names.
REGIONS = {
    "MOs": "Secondary motor area",
    "MOp": "Primary motor area",
    "SSp-ll": "Primary somatosensory area, lower limb",
    "SSp-ul": "Primary somatosensory area, upper limb",
    "SSp-un": "Primary somatosensory area, unassigned",
    "SSp-bfd": "Primary somatosensory area, barrel field",
    "SSp-tr": "Primary somatosensory area, trunk",
    "SSp-m": "Primary somatosensory area, mouth",
    "SSp-n": "Primary somatosensory area, nose",
    "RSPagl": "Retrosplenial area, lateral agranular part",
    "RSPd": "Retrosplenial area, dorsal part",
    "VISa": "Anterior visual area",
    "VISam": "Anteromedial visual area",
    "VISp": "Primary visual area",
    "VISpm": "Posteromedial visual area",
    "VISrl": "Rostrolateral visual area",
}
#: Categories for labels outside REGIONS, and the texts that mean a missing label.
OTHER_REGIONS = ("Unassigned", "Other", "Unknown")
MISSING_LABELS = ("", "nan", "none", "unknown", "unassigned", "na", "n/a")

#: Trigger bouts of the released recordings, as (bout, which end of it to keep) for each segment.
TRIGGER_SELECTIONS = {
    "mouse01_sleep": ((1, "end"),),
    "mouse02_sleep": ((1, "end"), (2, "end")),
    "mouse03_sleep": ((1, "end"), (2, "end")),
    "mouse04_day1_sleep": ((1, "end"), (2, "end")),
    "mouse04_day2_sleep": ((1, "end"), (2, "end"), (3, "end")),
    "mouse05_sleep": ((1, "end"), (2, "end")),
    "mouse03_ane": ((0, "start"), (1, "start")),
    "mouse05_ane": ((0, "start"), (1, "start"), (2, "end")),
    "mouse06_ane": ((0, "start"), (1, "start"), (2, "start")),
    "mouse07_ane": ((0, "start"), (2, "start")),
}
#: Bout sizes of the same recordings as released.
TRIGGER_GROUP_SIZES = {
    "mouse01_sleep": (100, 9500),
    "mouse02_sleep": (100, 9500, 9500),
    "mouse03_sleep": (100, 9500, 9501),
    "mouse04_day1_sleep": (100, 9500, 9501),
    "mouse04_day2_sleep": (100, 9500, 9500, 5001),
    "mouse05_sleep": (100, 9500, 9501),
    "mouse03_ane": (9500, 9500),
    "mouse05_ane": (9500, 9500, 9500),
    "mouse06_ane": (9500, 9500, 6164),
    "mouse07_ane": (9500, 9500, 9500),
}


def state_codes(kind: str) -> dict[str, float]:
    if kind not in STATE_CODES:
        raise ValueError(f"kind of recording must be one of {sorted(STATE_CODES)}, not {kind!r}")
    return dict(STATE_CODES[kind])


def state_dim(spark: SparkSession) -> DataFrame:
    """(data_info, state, state_code): a handful of rows."""
    return spark.createDataFrame([(k, s, c) for k, own in STATE_CODES.items() for s, c in own.items()], "data_info string, state string, state_code double")


def state_name(code: Column, kind: str) -> Column:
    """Label of a state code; null for a code that the kind of recording doesn't have."""
    out = F
    for name, value in state_codes(kind).items():
        out = out.when(code == value, name)
    return out


def region_category(label: Column) -> Column:
    """Displayed cortical area of an atlas label."""
    text = F.trim(label)
    area = F.regexp_replace(text, "2/3$", "")
    return (
        F.when(label.isNull(), "Unknown")
        .when(text.isin(*OTHER_REGIONS), text)
        .when(F.lower(text).isin(*MISSING_LABELS), "Unknown")
        .when(F.lower(area) == "root", "Unassigned")
        .when(area.isin(*REGIONS), area)
        .otherwise("Other")
    )


def region_dim(spark: SparkSession) -> DataFrame:
    """(ord, region, full_name) in legend order."""
    names = {**REGIONS, "Unassigned": "Atlas root (no specific cortical-area assignment)", "Other": "Other valid atlas area", "Unknown": "Missing atlas label"}
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(names.items())], "ord int, region string, full_name string")


def trigger_manifest(spark: SparkSession) -> DataFrame:
    """(recording, segment, bout, anchor) of the released recordings."""
    rows = [(r, i, b, a) for r, own in TRIGGER_SELECTIONS.items() for i, (b, a) in enumerate(own)]
    return spark.createDataFrame(rows, "recording string, segment int, bout int, anchor string")


#: The released files of each kind, as name: (id, bytes).
RELEASED_FILES = {
    "calcium": {
        "mouse01_sleep.mat": ("1f786027-c4b2-4ac9-8449-24c0cfb434db", 658474258),
        "mouse02_sleep.mat": ("b266f5ee-cc1d-4a47-9d41-29655a7c3967", 1093789677),
        "mouse03_sleep.mat": ("3191b169-1d10-4807-9284-edfd96f6c44e", 1197235306),
        "mouse03_ane.mat": ("1616a6b6-edec-4637-bea9-bca9c0a95848", 1123058079),
        "mouse04_day1_sleep.mat": ("8d84d7ac-b4c8-4208-9e5c-c3a4605d3e31", 1625754526),
        "mouse04_day2_sleep.mat": ("105e2c10-8a9a-4cd2-9c76-411cf673ec28", 2254368168),
        "mouse05_sleep.mat": ("ed06e6f2-7485-493e-8d32-d01e0d13aec9", 1263665343),
        "mouse05_ane.mat": ("5b5f67db-2bd0-43ae-8b4f-eb50138e6057", 1079340853),
        "mouse06_ane.mat": ("e1dd0560-3486-45e6-a086-e2c1bfb2bb6e", 563929318),
        "mouse07_ane.mat": ("ffdc68e6-fbb4-43f5-81e2-a8271a50819a", 363189208),
    },
    "physiology": {
        "README_EEG_EMG.md": ("62efc349-d2ac-4aec-89d5-d747af61a20c", 2969),
        "mouse01_sleep_physiological_data.mat": ("ba79f124-a00e-4f71-ae60-729ee9b8dbcc", 180001112),
        "mouse02_sleep_physiological_data.mat": ("b60cfc5d-c6f5-499f-bb8b-e93564e07360", 360001112),
        "mouse03_sleep_physiological_data.mat": ("1b58e659-c2d9-406d-94dd-41d25c856f78", 360001112),
        "mouse04_day1_sleep_physiological_data.mat": ("6cf82a55-0e08-4a07-8716-9aed78b50430", 360001112),
        "mouse04_day2_sleep_physiological_data.mat": ("25761808-4bbd-471f-b249-4f48d0cb33d4", 432001112),
        "mouse05_sleep_physiological_data.mat": ("3c6a3b7b-3dfb-4631-a670-5edbf8ebf81c", 360001112),
        "mouse03_ane_physiological_data.mat": ("0bf7785e-612a-41cd-9f52-33261659be30", 362601312),
        "mouse05_ane_physiological_data.mat": ("48f04ef2-dcd8-48fc-8d16-26f079cfb314", 546001312),
        "mouse06_ane_physiological_data_awake.mat": ("e80affb3-91a2-4a7c-bafc-5cfe352b3fca", 179201296),
        "mouse06_ane_physiological_data_ane.mat": ("b5548e9c-76a4-4b7a-8a11-b58fc48a332f", 299601296),
        "mouse07_ane_physiological_data.mat": ("4a57ad37-a7e9-4948-acc9-708926eb1b4f", 619201496),
    },
}


def released_files(spark: SparkSession) -> DataFrame:
    """(kind, name, file_id, bytes) of the released files: a handful of rows."""
    rows = [(kind, name, file_id, size) for kind, own in RELEASED_FILES.items() for name, (file_id, size) in own.items()]
    return spark.createDataFrame(rows, "kind string, name string, file_id string, bytes long")


def bout_sizes(spark: SparkSession) -> DataFrame:
    """(recording, sizes) of the released recordings' bouts."""
    return spark.createDataFrame([(r, list(n)) for r, n in TRIGGER_GROUP_SIZES.items()], "recording string, sizes array<long>")
