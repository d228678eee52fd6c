"""Size, shape and quality profiles; all quantiles are exact."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.operators import profile
from sievework.operators.quantiles import exact_quantiles
from sievework.plans.catalogue import query
from sievework.plans.items import table
from sievework.plans.staged import STAGED_SQL, staged
from sievework.session import cut_lineage

ACTIVE_SQL = "WITH " + STAGED_SQL + ", act AS (SELECT *, width / height AS aspect, least(width, height) AS short_side FROM staged WHERE status IN ('use', 'hold'))"


def measured(spark, sf_dir):
    """Active rows with the measures profiled here, written once: quantiles read them twice."""
    rows = profile.with_shape(profile.active(staged(spark, sf_dir)))
    return cut_lineage(rows.select("image_id", "dataset_id", "crop", "class_id", "source_label", "status", "width", "height", "aspect",
                                   "short_side", "is_grayscale", "sharpness_256", "brightness"))


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(ACTIVE_SQL + """ SELECT dataset_id, count(*) AS items, round(quantile_cont(width::DOUBLE, 0.5), 4) AS median_width,
  round(quantile_cont(height::DOUBLE, 0.5), 4) AS median_height, round(quantile_cont(short_side::DOUBLE, 0.05), 4) AS min_side_p05,
  round(quantile_cont(aspect, 0.5), 4) AS median_aspect FROM act GROUP BY 1""")
def size_profile(spark, sf_dir):
    return rounded(profile.size_profile(measured(spark, sf_dir)), ["median_width", "median_height", "min_side_p05", "median_aspect"])


@query(ACTIVE_SQL + """ SELECT class_id, dataset_id, round(quantile_cont(aspect, 0.5), 4) AS median_aspect FROM act
WHERE class_id IS NOT NULL GROUP BY 1, 2""")
def aspect_by_class_and_dataset(spark, sf_dir):
    rows = measured(spark, sf_dir).filter("class_id IS NOT NULL")
    return rounded(profile.wide_quantiles(rows, ["class_id", "dataset_id"], {"median_aspect": ("aspect", .5)}), ["median_aspect"])


@query(ACTIVE_SQL + """ SELECT round(quantile_cont(sharpness_256, 0.01), 4) AS p01, round(quantile_cont(sharpness_256, 0.02), 4) AS p02,
  round(quantile_cont(sharpness_256, 0.05), 4) AS p05 FROM act""")
def sharpness_quantiles(spark, sf_dir):
    named = {"p01": ("sharpness_256", .01), "p02": ("sharpness_256", .02), "p05": ("sharpness_256", .05)}
    return rounded(profile.wide_quantiles(measured(spark, sf_dir), [], named), list(named))


FIVE_SQL = ", ".join(f"round(quantile_cont(v, {p}), 4) AS {n}" for n, p in profile.FIVE_NUMBERS.items())


@query(f"SELECT l_returnflag, l_linestatus, {FIVE_SQL} FROM (SELECT *, l_extendedprice AS v FROM lineitem) GROUP BY 1, 2")
def price_boxplots(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rounded(profile.five_numbers(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice"), list(profile.FIVE_NUMBERS))


@query(ACTIVE_SQL + f", b AS (SELECT *, brightness AS v FROM act WHERE brightness IS NOT NULL) SELECT dataset_id, {FIVE_SQL} FROM b GROUP BY 1")
def brightness_boxplots(spark, sf_dir):
    rows = measured(spark, sf_dir)
    return rounded(profile.five_numbers(rows, ["dataset_id"], "brightness"), list(profile.FIVE_NUMBERS))


@query(f"SELECT p_type, {FIVE_SQL} FROM (SELECT *, p_retailprice / (p_size + 1) AS v FROM part) GROUP BY 1")
def part_ratio_boxplots(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("ratio", F.col("p_retailprice") / (F.col("p_size") + 1))
    return rounded(profile.five_numbers(rows, ["p_type"], "ratio"), list(profile.FIVE_NUMBERS))


@query(ACTIVE_SQL + """ SELECT split_source, round(quantile_cont(width::DOUBLE, 0.5), 4) AS median_width, round(quantile_cont(width::DOUBLE, 0.9), 4) AS p90
FROM act GROUP BY 1""")
def width_by_origin(spark, sf_dir):
    """Quantiles of groups of which one is NULL."""
    rows = profile.active(staged(spark, sf_dir)).select("split_source", "width")
    named = {"median_width": ("width", .5), "p90": ("width", .9)}
    return rounded(profile.wide_quantiles(cut_lineage(rows), ["split_source"], named), list(named))


@query("""SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS value, 0.5::DOUBLE AS prob, count(*) AS n FROM lineitem
UNION ALL SELECT round(quantile_cont(l_extendedprice, 0.95), 4), 0.95::DOUBLE, count(*) FROM lineitem""")
def price_quantiles(spark, sf_dir):
    return rounded(exact_quantiles(table(spark, sf_dir, "lineitem"), [], {"l_extendedprice": [.5, .95]}).drop("column"), ["value"])


@query(ACTIVE_SQL + """, s AS (SELECT sharpness_256 AS v, row_number() OVER (ORDER BY sharpness_256) AS rn, count(*) OVER () AS n
  FROM act WHERE sharpness_256 IS NOT NULL)
SELECT (SELECT count(*) FROM act WHERE short_side < 224) AS small, (SELECT count(*) FROM act WHERE is_grayscale) AS grayscale,
  max(CASE WHEN rn = n // 2 + 1 THEN v END) AS sharpness_median, max(CASE WHEN rn = n // 20 + 1 THEN v END) AS sharpness_p05 FROM s""")
def quality_flags(spark, sf_dir):
    return profile.quality_flags(measured(spark, sf_dir))


@query(ACTIVE_SQL + " SELECT image_id, sharpness_256 FROM act WHERE sharpness_256 IS NOT NULL ORDER BY sharpness_256, image_id LIMIT 36")
def blurriest(spark, sf_dir):
    return profile.smallest(profile.active(staged(spark, sf_dir)), "sharpness_256", "image_id", 36).select("image_id", "sharpness_256")


@query(ACTIVE_SQL + """, b AS (SELECT * FROM act WHERE sharpness_256 IS NOT NULL ORDER BY sharpness_256, image_id LIMIT 36)
SELECT dataset_id, source_label, count(*) AS items FROM b GROUP BY 1, 2""")
def blurriest_groups(spark, sf_dir):
    worst = profile.smallest(profile.active(staged(spark, sf_dir)), "sharpness_256", "image_id", 36)
    return worst.groupBy("dataset_id", "source_label").agg(F.count("*").alias("items"))


@query(ACTIVE_SQL + f""", a AS (SELECT crop, aspect AS v FROM act), o AS (SELECT crop, {FIVE_SQL} FROM a GROUP BY 1)
SELECT crop, median, row_number() OVER (ORDER BY median, crop)::INTEGER AS place FROM o""")
def crops_by_aspect(spark, sf_dir):
    rows = measured(spark, sf_dir)
    medians = rounded(profile.wide_quantiles(rows, ["crop"], {"median": ("aspect", .5)}), ["median"])
    # one row per crop of the registry
    return medians.withColumn("place", F.row_number().over(Window.orderBy("median", "crop")))
