"""Class lists, roles, difficulty and shot configurations as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: they have to equal those in use, or results differ. ---
ALL_CLASSES = [
    "aircraft_carrier", "bitumen", "bulk_carrier", "catamaran_yacht", "chemical_tanker", "container_ship",
    "crude_oil_tanker", "cruise", "destroyer", "firefighting", "fishing_boat", "frigate", "fso",
    "general_cargo_ship", "heavy_load_carrier", "kayak", "LNG_tanker", "LPG_tanker", "monohull_sailboat",
    "monohull_yacht", "oil_products_tanker", "passenger_cargo_ship", "passenger_ro-ro_ship", "passenger_ship",
    "reefer", "sailing_catamaran", "sailing_trimaran", "submarine", "tugboat", "vehicles_carrier",
]
SCHEMES = {
    "destroyer_id": {
        "id": [
            "bulk_carrier", "container_ship", "general_cargo_ship", "passenger_cargo_ship", "fishing_boat",
            "sailing_trimaran", "chemical_tanker", "crude_oil_tanker", "oil_products_tanker", "LNG_tanker",
            "LPG_tanker", "kayak", "heavy_load_carrier", "destroyer",
        ],
        "ood_train": [
            "aircraft_carrier", "frigate", "submarine", "firefighting", "tugboat", "reefer", "vehicles_carrier",
            "passenger_ro-ro_ship", "fso", "cruise",
        ],
        "ood_reserved": [
            "bitumen", "passenger_ship", "catamaran_yacht", "monohull_yacht", "monohull_sailboat",
            "sailing_catamaran",
        ],
    },
    "tugboat_id": {
        "id": [
            "bulk_carrier", "container_ship", "general_cargo_ship", "passenger_cargo_ship", "fishing_boat",
            "sailing_trimaran", "chemical_tanker", "crude_oil_tanker", "oil_products_tanker", "LNG_tanker",
            "LPG_tanker", "kayak", "heavy_load_carrier", "tugboat",
        ],
        "ood_train": [
            "destroyer", "aircraft_carrier", "frigate", "submarine", "firefighting", "reefer", "vehicles_carrier",
            "passenger_ro-ro_ship", "fso", "cruise",
        ],
        "ood_reserved": [
            "bitumen", "passenger_ship", "catamaran_yacht", "monohull_yacht", "monohull_sailboat",
            "sailing_catamaran",
        ],
    },
    "osr_near": {
        "id": [
            "bulk_carrier", "container_ship", "general_cargo_ship", "passenger_cargo_ship", "fishing_boat",
            "sailing_trimaran", "chemical_tanker", "crude_oil_tanker", "oil_products_tanker", "LNG_tanker",
            "LPG_tanker", "kayak", "heavy_load_carrier", "destroyer",
        ],
        "ood_train": [
            "bitumen", "cruise", "passenger_ship", "reefer", "submarine", "aircraft_carrier",
        ],
        "ood_fallback": [
            "cruise", "fso", "passenger_ship", "monohull_yacht", "submarine",
        ],
    },
    "pseudo_ood": {
        "id": [
            "aircraft_carrier", "bitumen", "bulk_carrier", "chemical_tanker", "cruise", "destroyer", "fishing_ships",
            "fso", "kayak", "LNG_tanker", "passenger_cargo_ship", "sailing_trimaran", "submarine",
            "vehicles_carrier",
        ],
        "pseudo_ood": [
            "container_ship", "crude_oil_tanker", "tugboat", "frigate", "general_cargo_ship", "reefer",
            "passenger_ship", "LPG_tanker", "catamaran_yacht", "heavy_load_carrier", "firefighting",
            "monohull_sailboat", "monohull_yacht", "oil_products_tanker", "passenger_ro-ro_ship",
            "sailing_catamaran",
        ],
    },
    "all30": {"id": ALL_CLASSES},
}
ALIASES = {"fishing_ships": "fishing_boat"}
DIFFICULTY = {
    "Easy": [
        "aircraft_carrier", "frigate", "submarine", "firefighting", "tugboat",
    ],
    "Medium": [
        "reefer", "vehicles_carrier", "passenger_ro-ro_ship",
    ],
    "Hard": [
        "fso", "cruise",
    ],
}
#: Unknown classes that look most like known ones; they get the bonus of the highest similarity band.
HARD_OOD = [
    "bitumen", "cruise", "fso", "passenger_ship", "reefer",
]
SHORT_NAMES = {  # in the order of scheme tugboat_id
    "id": [
        "bulk", "container", "cargo", "pass_cargo", "fishing", "trimaran", "chem_tnk", "crude_tnk", "oil_tnk", "LNG",
        "LPG", "kayak", "heavy", "tug",
    ],
    "ood_train": [
        "destroyer", "carrier", "frigate", "submarine", "fire", "reefer", "vehicles", "ro-ro", "fso", "cruise",
    ],
    "ood_reserved": [
        "bitumen", "pass_ship", "cat_yacht", "mono_yacht", "mono_sail", "sail_cat",
    ],
}
#: shots: (share of OOD rows, least OOD rows, least share of OOD classes)
SHOT_CONFIGS = {
    1: (0.25, 5, 0.5),
    2: (0.25, 9, 0.7),
    4: (0.40, 30, 1.0),
    5: (0.38, 35, 1.0),
    8: (0.35, 40, 1.0),
    10: (0.32, 50, 1.0),
    16: (0.30, 68, 1.0),
}
DEFAULT_SHOT_CONFIG = (0.20, 20, 1.0)
#: (most shots, multiplier); beyond the last: 0.6
OSR_MULTIPLIERS = [(2, 1.5), (4, 1.0), (8, 0.75)]
OSR_MULTIPLIER_ELSE = 0.6
# --- End of fixed values. ---


def taxonomy(spark: SparkSession) -> DataFrame:
    """``(scheme, category, role, ordinal, difficulty, short_name)``, one row for each class of each scheme.

    ``osr_near`` keeps what remains of the sixteen other classes as ``ood_reserved``.
    """
    hard = {c: level for level, names in DIFFICULTY.items() for c in names}
    rows = []
    for scheme, roles in SCHEMES.items():
        full = dict(roles)
        if scheme == "osr_near":
            taken = {*roles["id"], *roles["ood_train"]}
            full["ood_reserved"] = [c for c in ALL_CLASSES if c not in taken]
        for role, names in full.items():
            for k, c in enumerate(names):
                short = SHORT_NAMES[role][k] if scheme == "tugboat_id" else None
                level = hard.get(c) if scheme == "destroyer_id" and role == "ood_train" else None
                rows.append((scheme, c, role, k, level, short))
    return spark.createDataFrame(rows, "scheme string, category string, role string, ordinal int, difficulty string, short_name string")


def shot_configs(spark: SparkSession) -> DataFrame:
    """``(k, ood_ratio, min_ood, coverage)``."""
    return spark.createDataFrame([(k, *v) for k, v in SHOT_CONFIGS.items()], "k int, ood_ratio double, min_ood int, coverage double")


def check_scheme(scheme: dict[str, list[str]], expected: list[str]) -> None:
    """Raise unless the roles are disjoint and cover ``expected``."""
    names = [c for role, own in scheme.items() if role != "ood_fallback" for c in own]
    if len(names) != len(set(names)):
        raise ValueError("roles overlap")
    if set(names) != set(expected):
        raise ValueError("roles do not cover the classes")


def osr_multiplier(k: int) -> float:
    return next((m for most, m in OSR_MULTIPLIERS if k <= most), OSR_MULTIPLIER_ELSE)
