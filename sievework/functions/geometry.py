"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INPUT_SIZE = 224


def letterbox_columns(df: DataFrame, size: int = INPUT_SIZE) -> DataFrame:
    """Add the fitted box (never enlarged) and its offsets on a size × size canvas."""
    scale = F.least(F.lit(1.0), F.lit(float(size)) / F.col("width"), F.lit(float(size)) / F.col("height"))

    def fitted(side):
        return F.greatest(F.lit(1), F.floor(F.col(side) * scale + 0.5).cast("int"))

    boxed = df.withColumns({"box_width": fitted("width"), "box_height": fitted("height")})
    return boxed.withColumns({
        "offset_x": F.floor((F.lit(size) - F.col("box_width")) / 2).cast("int"),
        "offset_y": F.floor((F.lit(size) - F.col("box_height")) / 2).cast("int")})
