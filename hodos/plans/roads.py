"""Road dimension: the latest known road of every device, with one spelling per road."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hodos.operators.dedup import keep_first
from hodos.schemas import ROADS

# Spellings of road names and the name they stand for, fixed values.
ROAD_ALIASES = {
    "Β. ΣΟΦΙΑΣ": "ΒΑΣ. ΣΟΦΙΑΣ",
    "Π. ΡΑΛΛΗ": "ΠΕΤΡΟΥ ΡΑΛΛΗ",
    "Β. ΑΛΕΞΑΝΔΡΟΥ": "ΒΑΣ. ΑΛΕΞΑΝΔΡΟΥ",
    "ΕΘΝ. ΑΝΤΙΣΤΑΣΕΩΣ (ΟΛΓΑΣ)": "ΕΘΝ. ΑΝΤΙΣΤΑΣΕΩΣ",
    "Λ. ΑΘΗΝΩΝ": "ΑΘΗΝΩΝ",
    "Λ. ΑΘΗΝΩΝ (ΠΑΡΑΛΛΗΛΟΣ)": "ΑΘΗΝΩΝ (ΠΑΡΑΛΛΗΛΟΣ)",
    "Λ. ΑΛΕΞΑΝΔΡΑΣ": "ΑΛΕΞΑΝΔΡΑΣ",
    "Λ. ΑΜΑΛΙΑΣ": "ΑΜΑΛΙΑΣ",
    "Λ. ΒΟΥΛΙΑΓΜΕΝΗΣ": "ΒΟΥΛΙΑΓΜΕΝΗΣ",
    "Λ. ΔΗΜΟΚΡΑΤΙΑΣ": "ΔΗΜΟΚΡΑΤΙΑΣ",
    "Λ. ΚΑΡΑΜΑΝΛΗ ΚΩΝ.": "ΚΑΡΑΜΑΝΛΗ ΚΩΝ.",
    "Λ. ΚΗΦΙΣΙΑΣ": "ΚΗΦΙΣΙΑΣ",
    "Λ. ΚΗΦΙΣΟΥ": "ΚΗΦΙΣΟΥ",
    "Λ. ΚΩΝΣΤΑΝΤΙΝΟΥΠΟΛΕΩΣ": "ΚΩΝΣΤΑΝΤΙΝΟΥΠΟΛΕΩΣ",
    "Λ. ΜΕΣΟΓΕΙΩΝ": "ΜΕΣΟΓΕΙΩΝ",
    "Λ. ΟΜΟΡΦΟΚΚΛΗΣΙΑΣ/ΒΕΪΚΟΥ": "ΟΜΟΡΦΟΚΚΛΗΣΙΑΣ/ΒΕΪΚΟΥ",
    "Λ. ΣΥΓΓΡΟΥ": "ΣΥΓΓΡΟΥ",
}

KEY = ["device_id"]


def normalise_roads(df: DataFrame, column: str = "road_name") -> DataFrame:
    """Replace known spellings, leave every other name alone."""
    return df.replace(ROAD_ALIASES, subset=[column])


def road_order() -> list[Column]:
    """Which description of a device counts: the latest ingested, then the latest reading.

    A device has one staged reading per moment, so this decides; the names only settle
    rows that were never staged.
    """
    return [
        F.col("ingested_at").desc_nulls_last(),
        F.col("described_at").desc_nulls_last(),
        F.col("road_name").asc_nulls_last(),
        F.col("road_info").asc_nulls_last(),
    ]


def latest_roads(staged: DataFrame) -> DataFrame:
    """The most recently ingested road of each device.

    A device repeats the same road hour after hour, so a hash aggregation first shrinks
    the readings to one row per device, delivery and road; only those are sorted.
    """
    described = staged.groupBy("device_id", "ingested_at", "road_name", "road_info").agg(
        F.max("processed_at").alias("described_at")
    )
    latest = normalise_roads(keep_first(described, KEY, road_order()))
    return latest.select(*[F.col(f.name) for f in ROADS.fields])
