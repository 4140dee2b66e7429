"""Fire history per district: prepare, overlay, measure, group."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from terraquilt.operators import prep
from terraquilt.operators.overlay import DEFAULT_CELL
from terraquilt.operators.stats import lga_fire_stats
from terraquilt.sources.scan import layer_from


def prepare_fires(raw: DataFrame, column: str = "wkt", encoding: str = "wkt", loaded: dt.date | None = None,
                  date_format: str | None = None) -> DataFrame:
    """Raw fire rows to a layer: dates parsed, label split, geometry decoded."""
    fires = prep.parse_dates(raw, ["StartDate", "EndDate"], date_format)
    fires = prep.with_load_date(prep.split_label(fires), loaded)
    return layer_from(fires, column, encoding)


def prepare_lga(raw: DataFrame, state: int | None = None, column: str = "WKB", encoding: str = "wkb") -> DataFrame:
    """District rows to a layer. The state filter comes first, so it reaches the
    scan and no geometry of other states is decoded."""
    if state is not None:
        raw = prep.filter_eq(raw, "STE_CODE16", state)
    return layer_from(raw, column, encoding)


def fire_history(fires: DataFrame, lga: DataFrame, state: int | None = None, cell: float = DEFAULT_CELL) -> DataFrame:
    if state is not None:
        lga = prep.filter_eq(lga, "STE_CODE16", state)
    return lga_fire_stats(lga, fires, cell=cell)
