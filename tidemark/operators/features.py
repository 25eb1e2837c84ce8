"""Named feature sets (M11): the model variants as parameters.

A variant takes every numeric column of the table at hand but the ones it
drops; one variant names its columns instead.  It also says whether the
sediment class is added one-hot, how the columns are scaled, and the options
of the sparse GP.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns of the point panel.
ID = "OBJECTID"
SEDIMENT_CODE = "FID"
SEDIMENT_CLASS = "STRATCODE"
INDEX_COLUMNS = tuple(f"NDVI_{y}{t}" for t in "HL" for y in range(2016, 2024))
BASE_WAVE_COLUMNS = tuple(f"{w}{y}" for y in range(2013, 2024)
                          for w in ("WaveHeight", "WavePeriod", "WavePower", "SeaTemp"))


@dataclass(frozen=True)
class Variant:
    drop: tuple[str, ...]        # left out besides the targets
    only: tuple[str, ...] | None # the columns by name, instead of all numeric ones
    sediment_class: bool         # one-hot STRATCODE is added
    scale: str                   # "none", "all", "train"
    white: float                 # white-noise term of the kernel
    jitter: float
    steps: int                   # optimiser steps of the original (reported only)


VARIANTS = {
    "base": Variant((ID, SEDIMENT_CODE), None, False, "none", 0.0, 1e-4, 100),
    "no_sediment_class": Variant((ID, SEDIMENT_CLASS), None, False, "all", 0.0, 1e-4, 100),
    "all_wave_no_sediment": Variant((ID, SEDIMENT_CODE), None, False, "train", 1e-4, 1e-3, 100),
    "all_wave_with_code": Variant((ID,), None, False, "train", 1e-4, 1e-3, 100),
    "basic_wave_with_code": Variant((ID,), None, False, "all", 1e-4, 1e-3, 100),
    "basic_wave_with_class": Variant((ID, SEDIMENT_CLASS), None, True, "all", 0.0, 1e-4, 100),
    "all_wave_with_class": Variant((), INDEX_COLUMNS + BASE_WAVE_COLUMNS, True, "all",
                                   1e-4, 1e-3, 200),
}


def feature_set(df: DataFrame, name: str, targets: list[str]) -> tuple[list[str], Variant]:
    """Numeric feature columns of ``df`` for variant ``name``, in table order
    (in the variant's own order where it names them; a named column that the
    table lacks is skipped), and the variant's settings.  The one-hot class
    columns, when the variant asks for them, are added by ``models.one_hot``
    on ``STRATCODE``."""
    v = VARIANTS[name]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if v.only is not None:
        return [c for c in v.only if c in numeric and c not in targets], v
    return [c for c in numeric if c not in (*v.drop, *targets)], v
