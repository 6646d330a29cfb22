"""Laboratory dimension: item → group → minutes.

The lists below are fixed values that must equal the published lab grouping
for results to match. They are written in their natural order. An item listed
in two groups belongs to the group listed last (later entries win), so
glucose, potassium and sodium belong to BLOOD_GAS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: lab group -> item ids (natural order, duplicates kept) ---
LAB_GROUP_ITEMS: dict[str, list[int]] = {
    "CBC": [51221, 51300, 51222, 51279, 51250, 51248, 51249, 51277, 51265,
            51146, 51200, 51244, 51254, 51256, 51143, 51252],
    "CHEM": [51006, 50912, 50983, 50902, 50882, 50931, 50971, 50868, 50893],
    "COAG": [51274, 51237, 51275],
    "UA": [51094, 51109, 51464, 51508, 51487, 51466, 51478, 51506, 51491, 51486],
    "LACTATE": [50813],
    "LFTS": [50861, 50878, 50861, 50885, 50862],
    "LIPASE": [50956],
    "LYTES": [50960, 50970],
    "CARDIO": [50963, 51002],
    "BLOOD_GAS": [50821, 50818, 50820, 50804, 50802, 50931, 50983, 50971],
    "TOX": [50386],
    "INFLAM": [50910, 50889],
}

# --- fixed values: lab group -> turnaround minutes ---
GROUP_MINUTES: dict[str, int] = {
    "CBC": 30, "CHEM": 60, "COAG": 48, "UA": 40, "LACTATE": 4, "LFTS": 104,
    "LIPASE": 100, "LYTES": 89, "CARDIO": 122, "BLOOD_GAS": 12, "TOX": 70,
    "INFLAM": 178,
}

# --- fixed values: groups used by the sequence builder (no TOX), in order ---
SEQUENCE_GROUPS: list[str] = ["CBC", "CHEM", "COAG", "UA", "LACTATE", "LFTS",
                              "LIPASE", "LYTES", "CARDIO", "BLOOD_GAS", "INFLAM"]

# --- fixed values: group -> class id for the lab label vector ---
GROUP_CLASS_ID: dict[str, int] = {
    "CBC": 0, "CHEM": 1, "COAG": 2, "UA": 3, "LACTATE": 4, "LFTS": 5,
    "LIPASE": 6, "LYTES": 7, "BLOOD_GAS": 8, "CARDIO": 9, "TOX": 10, "INFLAM": 11,
}

# Groups in declaration order; this order drives the wide column layout.
LAB_GROUPS: list[str] = list(LAB_GROUP_ITEMS)


def item_to_group() -> dict[int, str]:
    """Reverse map with later groups winning for items listed twice."""
    out: dict[int, str] = {}
    for group, items in LAB_GROUP_ITEMS.items():
        for item in items:
            out[item] = group
    return out


def relevant_itemids() -> list[int]:
    return sorted(item_to_group())


LAB_DIM_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("itemid", T.IntegerType(), False),
    T.StructField("lab_group", T.StringType(), False),
    T.StructField("group_minutes", T.IntegerType(), False),
])


def lab_dim(spark: SparkSession) -> DataFrame:
    """The 56-row item dimension, ``pos`` = rank in ascending item order.

    Its size is fixed by the constants above, so broadcasting it is safe at
    any data scale.
    """
    groups = item_to_group()
    rows = [(i, item, groups[item], GROUP_MINUTES[groups[item]])
            for i, item in enumerate(sorted(groups))]
    return spark.createDataFrame(rows, LAB_DIM_SCHEMA)
