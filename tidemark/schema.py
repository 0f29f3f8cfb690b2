"""Column conventions and fixed tables of the data model.

Signals and features are long tables: ``subject_id``, a series key (``modality`` or
``feature``), a position (``idx`` for samples, ``w`` for windows) and a ``value``.
Missing is NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLES = T.StructType([
    T.StructField("subject_id", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("fs", T.IntegerType()),
    T.StructField("idx", T.LongType()), T.StructField("value", T.DoubleType()),
])
EVENTS = T.StructType([T.StructField("subject_id", T.StringType()), T.StructField("t", T.DoubleType()), T.StructField("name", T.StringType())])
FEATURES = "subject_id string, w long, t double, feature string, modality string, raw double, norm double"

#: The nineteen features, in order, and their modality.
FEATURE_MODALITY = {
    "SDNN": "ECG", "RMSSD": "ECG", "HF Power": "ECG", "LF/HF": "ECG", "SampEn": "ECG", "pNN50": "ECG", "Inst HR": "ECG",
    "Pulse Rate": "PPG", "PAV": "PPG", "PTT": "PPG", "Breath Rate": "Resp", "RVT": "Resp", "Inst Breath Rate": "Resp",
    "SCL": "EDA", "SCR Freq": "EDA", "Phasic Amp": "EDA", "SCR Rise Time": "EDA", "Skin Temp": "Temp", "dSkin Temp": "Temp",
}
#: Working rate in Hz and channel of a 2 kHz recording for each modality.
MODALITY_RATE = {"ECG": 200, "PPG": 200, "Resp": 100, "EDA": 4, "Temp": 4}
MODALITY_CHANNEL = {"PPG": 1, "ECG": 2, "EDA": 3, "Resp": 4, "Temp": 5}
#: How far beyond the quartiles a modality is clipped, in interquartile ranges.
CLIP_RANGES = {"ECG": 6.0, "PPG": 5.0, "Resp": 5.0, "EDA": 4.0, "Temp": 4.0}
#: Default affective events.
AFFECTIVE = ("Crash", "Barrel", "Brake")
#: Event names that stand for one event.
EVENT_ALIASES = {**{f"Brake {n}": "Brake" for n in range(1, 6)}, "Single Slow Car": "Slow Car", "Double Slow Car": "Slow Car"}
