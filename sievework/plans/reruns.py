"""Incremental runs: what is cached, up to date, missing or stale."""

from pyspark.sql import functions as F

from sievework.functions.text import cache_key
from sievework.operators import incremental as inc
from sievework.plans.catalogue import query
from sievework.plans.items import ITEMS_SQL, items, table
from sievework.plans.staged import STAGED_SQL, staged

# An earlier run knew every labelled document, French ones with an older text: some of them are no longer
# selected, and selected documents without a label are new.
INDEX_SQL = "WITH " + STAGED_SQL + """, selected AS (SELECT image_id, sha256 FROM staged WHERE status IN ('use', 'hold')),
idx AS (SELECT image_id, CASE crop WHEN 'fr' THEN 'old' ELSE sha256 END AS sha256 FROM items WHERE source_label <> 'unlabelled')"""


def selected(spark, sf_dir):
    return staged(spark, sf_dir).filter(F.col("status").isin("use", "hold")).select("image_id", "sha256")


def index(spark, sf_dir):
    rows = items(spark, sf_dir).filter(F.col("source_label") != "unlabelled")
    return rows.select("image_id", F.when(F.col("crop") == "fr", "old").otherwise(F.col("sha256")).alias("sha256"))


@query(INDEX_SQL + " SELECT s.image_id FROM selected s JOIN idx i ON s.image_id = i.image_id AND s.sha256 = i.sha256")
def up_to_date(spark, sf_dir):
    return inc.up_to_date(selected(spark, sf_dir), index(spark, sf_dir)).select("image_id")


@query(INDEX_SQL + " SELECT s.image_id FROM selected s LEFT JOIN idx i ON s.image_id = i.image_id AND s.sha256 = i.sha256 WHERE i.image_id IS NULL")
def to_build(spark, sf_dir):
    return inc.to_build(selected(spark, sf_dir), index(spark, sf_dir)).select("image_id")


@query(INDEX_SQL + """ SELECT 'missing' AS state, image_id FROM selected WHERE image_id NOT IN (SELECT image_id FROM idx)
UNION ALL SELECT 'stale', image_id FROM idx WHERE image_id NOT IN (SELECT image_id FROM selected)""")
def missing_and_stale(spark, sf_dir):
    want, have = selected(spark, sf_dir), index(spark, sf_dir).select("image_id")
    return inc.missing(want, have).select(F.lit("missing").alias("state"), "image_id").unionByName(
        inc.stale(have, want).select(F.lit("stale").alias("state"), "image_id"))


@query(INDEX_SQL + """ SELECT count(s.image_id) AS wanted, count(*) FILTER (s.sha256 = i.sha256) AS up_to_date,
  count(s.image_id) - count(*) FILTER (s.sha256 = i.sha256) AS to_build, count(*) FILTER (i.image_id IS NULL) AS missing,
  count(*) FILTER (s.image_id IS NULL) AS stale FROM selected s FULL JOIN idx i ON s.image_id = i.image_id""")
def build_counts(spark, sf_dir):
    return inc.build_counts(selected(spark, sf_dir), index(spark, sf_dir))


@query(INDEX_SQL + """ SELECT image_id, sha256 FROM selected""")
def pruned_index(spark, sf_dir):
    want, have = selected(spark, sf_dir), index(spark, sf_dir)
    return inc.next_index(want, have, inc.to_build(want, have), prune=True)


CACHE_SQL = """WITH cache AS (SELECT 'pages|' || url || '|' || page_id || '|' || octet_length(encode(html)) AS key,
  CASE substr(url, 1, 5) WHEN 'https' THEN '1' ELSE CASE WHEN contains(url, '.html') THEN '2' END END AS hash_version, sha256(html) AS sha256
FROM pages WHERE NOT contains(url, 'utm_source')), cur AS (SELECT * FROM cache WHERE coalesce(hash_version, '1') = '1'),
m AS (SELECT page_id, 'pages|' || url || '|' || page_id || '|' || octet_length(encode(html)) AS key FROM pages)"""


def keyed_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn(
        "key", cache_key(F.lit("pages"), F.col("url"), F.col("page_id"), F.octet_length("html")))


def page_cache(spark, sf_dir):
    """A cache from earlier runs: current rows, rows of another version, rows from before versioning, and gaps."""
    rows = keyed_pages(spark, sf_dir).filter(~F.col("url").contains("utm_source"))
    version = F.when(F.col("url").startswith("https"), "1").when(F.col("url").contains(".html"), "2")
    return inc.current_cache(rows.select("key", version.alias("hash_version"), F.sha2("html", 256).alias("sha256")), "1")


@query(CACHE_SQL + " SELECT m.page_id, c.sha256 FROM m JOIN cur c ON m.key = c.key")
def cache_hits(spark, sf_dir):
    return inc.cache_hits(keyed_pages(spark, sf_dir).select("page_id", "key"), page_cache(spark, sf_dir)).select("page_id", "sha256")


@query(CACHE_SQL + " SELECT page_id FROM m WHERE key NOT IN (SELECT key FROM cur)")
def cache_misses(spark, sf_dir):
    return inc.cache_misses(keyed_pages(spark, sf_dir).select("page_id", "key"), page_cache(spark, sf_dir)).select("page_id")
