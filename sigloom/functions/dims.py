"""Constant dimensions of the domain, as small frames. All lists here are fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: condition codes
CONDITIONS = {1: "old/correct", 2: "new/correct", 101: "old/incorrect", 102: "new/incorrect", 201: "old/null", 202: "new/null"}
# fixed values: centre frequencies (Hz) and their bandwidths
FREQS = [0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 17, 19, 21, 24, 27, 30, 35, 40, 45, 50, 55, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 180]
BANDWIDTHS = [0.5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 5, 5, 5, 5, 5, 5, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10, 20]
# fixed values: bands and their member frequencies; edges belong to two bands
BANDS = {
    "delta": [0.5, 1, 2, 3, 4],
    "theta": [4, 5, 6, 7, 8],
    "alpha": [8, 9, 10, 11, 12, 13],
    "low_beta": [13, 15, 17, 19],
    "high_beta": [21, 24, 27, 30],
    "low_gamma": [30, 35, 40, 45, 50, 55],
    "high_gamma": [55, 60, 70, 80, 90, 100],
}
# fixed values: regions in order of priority and their areas; an area goes to the first region that lists it
REGIONS = {
    "parietal": ["IPS", "IP", "SP", "SPL", "AG", "SMG", "TPJ"],
    "premotor": ["SFG", "SFS", "MFG", "FEF", "SMA"],
    "DLPFC": ["MFG", "FEF", "SFS", "IFS"],
    "M1": ["preCG", "M1", "PreCG"],
    "S1": ["postCG", "PostCG"],
    "INS": ["INS"],
    "VLPFC": ["IFG", "FOP", "IFS"],
    "MTL": ["HPC", "EC", "MEC", "PRH", "PHG", "PHC", "LEC"],
    "A1": ["A1"],
    "MTG": ["MTG"],
    "AMY": ["AMY"],
    "PCC": ["PCC"],
    "ACC": ["ACC", "MCC"],
    "HPC": ["HPC"],
    "PHC": ["PHC", "PHG"],
    "STG": ["STG"],
    "STS": ["STS"],
    "TP": ["TP"],
    "OFC": ["OFC"],
    "VS": ["LG", "FUG", "ITG", "ITS"],
    "THAL": ["THAL"],
}
# fixed values: electrode labels that make a channel bad, and those of white matter
BAD_LABELS, WHITE_LABELS = ["OOB", "LSN"], ["WM", "VENT"]
# fixed values: key codes
KEY_OLD, KEY_NEW, KEY_NULL = 49, 50, 48


def conditions(spark: SparkSession) -> DataFrame:
    """dim_condition (code, condition_name, item, outcome)."""
    return spark.createDataFrame([(c, n, c % 100, c // 100) for c, n in CONDITIONS.items()], "code int, condition_name string, item int, outcome int")


def frequencies(spark: SparkSession) -> DataFrame:
    """dim_freq (freq_idx, freq, bwidth, n_cycles)."""
    return spark.createDataFrame([(i, float(f), float(b), f * 2.0 / b) for i, (f, b) in enumerate(zip(FREQS, BANDWIDTHS))], "freq_idx int, freq double, bwidth double, n_cycles double")


def band_members(spark: SparkSession, members: dict[str, list[float]] | None = None) -> DataFrame:
    """dim_band_member (band_idx, band, freq): many to many."""
    rows = [(i, b, float(f)) for i, (b, fs) in enumerate((members or BANDS).items()) for f in fs]
    return spark.createDataFrame(rows, "band_idx int, band string, freq double")


def regions(spark: SparkSession, listed: dict[str, list[str]] | None = None) -> DataFrame:
    """dim_region (priority, region, area)."""
    rows = [(i, r, a) for i, (r, areas) in enumerate((listed or REGIONS).items()) for a in areas]
    return spark.createDataFrame(rows, "priority int, region string, area string")
