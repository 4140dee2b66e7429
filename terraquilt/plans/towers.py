"""Cell towers: clean, project, look up operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquilt.functions.columns import coalesce_cols
from terraquilt.functions.geom import to_web_mercator
from terraquilt.operators import prep
from terraquilt.operators.heavy import balanced_join
from terraquilt.sources.scan import union_code_tables

CUTOFF = "2003-01-01"
CODES_BYTES = 32 * 1024 * 1024  # of the lookup's text and numbers, for a broadcast


def prepare_towers(towers: DataFrame, since: str = CUTOFF) -> DataFrame:
    """Timestamps from epoch seconds, old outliers out, Web Mercator x and y,
    radio technology as a category."""
    df = prep.filter_since(prep.epoch_to_ts(towers, ["created", "updated"]), "created", since)
    metres = to_web_mercator(F.col("lon"), F.col("lat"))
    df = df.withColumn("x_3857", metres["x"]).withColumn("y_3857", metres["y"])
    return prep.categorize(df, ["radio"])


def network_codes(tables: list[DataFrame]) -> DataFrame:
    """One lookup table: the network name, else the operator, as Description;
    text columns dictionary-encoded."""
    codes = union_code_tables(tables)
    codes = codes.withColumn(
        "Description", coalesce_cols(F.col("Network"), F.col("Operator or brand name"))
    )
    codes = prep.drop(codes, ["Network", "Operator or brand name"])
    return prep.categorize(codes)


def enrich_left(towers: DataFrame, codes: DataFrame) -> DataFrame:
    """Left join on both code pairs. Null codes match null codes, towers without
    a code stay, duplicate codes multiply rows. The lookup keys are renamed since
    Spark cannot write ``mcc`` next to ``MCC``."""
    codes = codes.withColumnsRenamed({"MCC": "code_mcc", "MNC": "code_mnc"})
    widths = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in codes.columns]
    if (codes.agg(F.sum(sum(widths[1:], widths[0])).alias("bytes")).first()["bytes"] or 0) > CODES_BYTES:
        return balanced_join(towers, codes, [("mcc", "code_mcc"), ("net", "code_mnc")])
    codes = F.broadcast(codes)
    return towers.join(
        codes,
        F.col("mcc").eqNullSafe(F.col("code_mcc")) & F.col("net").eqNullSafe(F.col("code_mnc")),
        "left",
    )
