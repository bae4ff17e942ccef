"""Cloud types from cloud-top pressure and optical thickness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.functions.columns import cut

#: Right-closed intervals, and the names of their combinations (fixed values).
LEVELS = [50, 440, 680, 1000], ["Cirro", "Alto", "Low"]
THICKNESS = [0, 3.6, 23, 379], ["Thin", "Medium", "Thick"]
TYPES = [
    ("Alto", "Medium", "Altostratus"),
    ("Alto", "Thick", "Nimbostratus"),
    ("Alto", "Thin", "Altocumulus"),
    ("Cirro", "Medium", "Cirrostratus"),
    ("Cirro", "Thick", "Deep convection"),
    ("Cirro", "Thin", "Cirrus"),
    ("Low", "Medium", "Stratocumulus"),
    ("Low", "Thick", "Stratus"),
    ("Low", "Thin", "Cumulus"),
]


def classify_type(clouds: DataFrame, ctp: str = "avg_ctp", cot: str = "avg_cot") -> DataFrame:
    """Add ``level``, ``thickness`` and ``cloud_type``, null where either is."""
    names = clouds.sparkSession.createDataFrame(TYPES, "level string, thickness string, cloud_type string")
    out = clouds.withColumn("level", cut(F.col(ctp), *LEVELS)).withColumn("thickness", cut(F.col(cot), *THICKNESS))
    return out.join(F.broadcast(names), ["level", "thickness"], "left")  # nine names
