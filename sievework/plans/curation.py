"""The whole run, from archives to a settled manifest: rules, hashes, quality, decisions, duplicates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.fingerprints import from_hex, text_fingerprints, to_hex
from sievework.functions.text import NESTED_MARK, cache_key, content_hash, is_image_path, outer_path, tokens, words
from sievework.operators import profile
from sievework.operators.classify import apply_archive_rules, classify_members
from sievework.operators.duplicates import DEFAULT_THRESHOLD, duplicate_report, resolve_duplicates
from sievework.operators.incremental import cache_hits, cache_misses
from sievework.operators.overrides import apply_overrides
from sievework.operators.quality import apply_quality_rules, mark_unreadable
from sievework.registry import Dataset, choose, dataset_table
from sievework.schema import HASHES, MANIFEST, names
from sievework.session import cut_lineage
from sievework.sources.archives import archive_files, member_index, read_selected, readable_members
from sievework.sources.files import described, joined
from sievework.sources.tables import append_cache, partial_path, read_cache, write_table

HASH_VERSION = "1"
# contents (key, content) to the layout of HASHES with the key; a row may carry an error instead
Measure = Callable[[DataFrame], DataFrame]


@dataclass
class Run:
    manifest: DataFrame
    duplicates: DataFrame | None = None
    hashed: int = 0
    partial: bool = False


def measure_texts(contents: DataFrame) -> DataFrame:
    """The default measure, for members that hold UTF-8 text: content hash, token-vote fingerprint, sizes."""
    text = F.try_validate_utf8("content")
    rows = contents.select("key", content_hash(F.col("content")).alias("sha256"), text.alias("_t"))
    share = F.try_divide(F.lit(100.0) * F.size(tokens(F.col("_t"))), F.size(words(F.col("_t"))))
    lines = F.length("_t") - F.length(F.replace("_t", F.lit("\n"), F.lit(""))) + 1
    plain = F.octet_length("_t") == F.length("_t")
    sized = rows.select(
        "key", "sha256", F.length("_t").alias("width"), lines.alias("height"), F.when(plain, "L").otherwise("RGB").alias("mode"),
        plain.alias("is_grayscale"), F.bround(share, 1).alias("sharpness_256"), F.lit(None).cast("double").alias("brightness"),
        F.when(F.col("_t").isNull(), "not UTF-8 text").alias("error"))
    prints = text_fingerprints(rows.filter("_t IS NOT NULL"), "key", "_t").select("key", to_hex(F.col("phash64")).alias("phash"))
    return sized.join(prints, "key", "left").select("key", *names(HASHES))


def list_members(spark: SparkSession, root: str, datasets: list[Dataset], index: DataFrame | None = None) -> DataFrame:
    """Classified image members, without reading any content; from an index of the archives where there is one."""
    members = readable_members(archive_index(spark, root, datasets) if index is None else index).filter(is_image_path(F.col("member_path")))
    return classify_members(members, datasets).withColumn(
        "key", cache_key(F.col("archive"), F.col("member_path"), F.col("crc"), F.col("file_bytes")))


def archive_index(spark: SparkSession, root: str, datasets: list[Dataset]) -> DataFrame:
    """Members of all archives of the data sets and their places, by one scan."""
    archives = {a.file: a for d in datasets for a in d.archives}
    missing = [a for a in archives if described(joined(root, a)) is None]
    if missing:
        raise FileNotFoundError(f"archives not found: {', '.join(missing)}")
    listed = Counter(a.file for d in datasets for a in d.archives)
    # nested archives under a skip rule stay closed, unless another data set reads the same archive by other rules
    rules = {a.file: a.rules if listed[a.file] == 1 else () for a in archives.values()}
    return member_index(spark, [joined(root, a) for a in archives], root, rules)


def member_kinds(members: DataFrame, datasets: list[Dataset]) -> DataFrame:
    """(archive, member_path, kind, skip_reason) for the archive report; a skipped nested archive is one row."""
    rows = apply_archive_rules(members, datasets)
    skipped = F.col("rule_skip").isNotNull()
    kind = (F.when(skipped, "skipped").when(~is_image_path(F.col("member_path")), "ignored")
            .when(F.col("rule_no") < 0, "unmatched").otherwise("listed"))
    path = F.when(skipped & F.col("member_path").contains(NESTED_MARK), outer_path(F.col("member_path"))).otherwise(F.col("member_path"))
    kinds = rows.select("archive", path.alias("member_path"), kind.alias("kind"), F.col("rule_skip").alias("skip_reason"))
    return kinds.filter("kind <> 'skipped'").unionByName(kinds.filter("kind = 'skipped'").distinct())


def archive_report(spark: SparkSession, root: str, datasets: list[Dataset]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per archive: size, date, counts and an unmatched example; members per skip reason; members per ignored extension)."""
    members = cut_lineage(member_kinds(readable_members(archive_index(spark, root, datasets)), datasets))
    files = archive_files(spark, root, sorted({(a.file, a.downloaded) for d in datasets for a in d.archives}, key=str))
    skips = members.filter("kind = 'skipped'").groupBy("archive", "skip_reason").agg(F.count("*").alias("members"))
    return profile.archive_counts(members, files), skips, profile.ignored_extensions(members.filter("kind = 'ignored'"))


def _cache(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The cache of this version; None if there is none yet. Any other fault of the table stops the run."""
    try:
        return read_cache(spark, path, HASH_VERSION) if path else None
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def curate(spark: SparkSession, root: str, datasets: list[Dataset], taxonomy: DataFrame, overrides: DataFrame | None = None,
           cache_path: str | None = None, threshold: int = DEFAULT_THRESHOLD, list_only: bool = False,
           measure: Measure = measure_texts, only: Iterable[str] | None = None) -> Run:
    """One run over the archives under `root`. Only members that may be used are read and hashed, and of those
    only the ones the cache does not know. `only` names the data sets of a partial run; unknown names are refused."""
    datasets = choose(datasets, only)
    index = archive_index(spark, root, datasets)
    index = index if list_only else cut_lineage(index)
    listed = list_members(spark, root, datasets, index)
    empty = {c: F.lit(None).cast(t) for c, t in (part.split() for part in MANIFEST.split(", "))}
    if list_only:
        rest = {c: e for c, e in empty.items() if c not in listed.columns}
        return Run(listed.withColumns(rest).select(*names(MANIFEST)), partial=only is not None)
    listed = cut_lineage(listed)
    wanted = listed.filter(F.col("status").isin("use", "hold"))
    cache = _cache(spark, cache_path)
    todo = (wanted if cache is None else cache_misses(wanted, cache)).dropDuplicates(["key"])
    contents = cut_lineage(read_selected(todo, root, key="key", index=index))
    lost = contents.filter(F.col("error").isNotNull()).select("key", F.col("error"))
    read = measure(contents.filter(F.col("error").isNull()).drop("error"))
    fresh = cut_lineage(read.select("key", *names(HASHES)).unionByName(lost, allowMissingColumns=True))
    known = fresh if cache is None else fresh.unionByName(cache_hits(wanted.select("key").distinct(), cache).select(*fresh.columns))
    # a row that its data set excludes gets no hashes, even if another data set reads the same member
    hashed = listed.join(known.withColumn("_wanted", F.lit(True)), (listed["key"] == known["key"]) & listed["status"].isin("use", "hold"), "left")
    hashed = hashed.drop(known["key"], "_wanted").withColumn("phash64", from_hex(F.col("phash")))
    rest = {c: e for c, e in empty.items() if c not in hashed.columns}
    manifest = cut_lineage(mark_unreadable(hashed.withColumns(rest)).select(*names(MANIFEST), "phash64"))
    if cache_path:
        append_cache(fresh, cache_path, HASH_VERSION)
    table = dataset_table(spark, datasets)
    checked = apply_quality_rules(manifest, table)
    if overrides is not None:
        numbered = overrides if "seq" in overrides.columns else overrides.withColumn("seq", F.col("decided_at"))
        checked = apply_overrides(checked, numbered, taxonomy, "seq")
    settled = resolve_duplicates(checked, table.select("dataset_id", "priority"), threshold)
    return Run(settled.manifest.select(*names(MANIFEST)), duplicate_report(settled.groups), fresh.count(), only is not None)


def write_manifest(run: Run, path: str, fmt: str = "parquet") -> str:
    """Write the manifest in the order of data set, archive and path; a partial run goes to a path of its own."""
    target = partial_path(path, run.partial)
    write_table(run.manifest.orderBy("dataset_id", "archive", "member_path"), target, MANIFEST, fmt)
    return target


def warnings(manifest: DataFrame) -> DataFrame:
    """(kind, dataset_id, detail, items): what a reader of the manifest should look at."""
    def rows(kind: str, part: DataFrame, detail: str) -> DataFrame:
        return part.groupBy("dataset_id", F.col(detail).alias("detail")).agg(F.count("*").alias("items")).select(
            F.lit(kind).alias("kind"), "dataset_id", "detail", "items")

    return rows("label without a class map entry", manifest.filter("reason = 'label_not_in_class_map'"), "source_label").unionByName(
        rows("unreadable", manifest.filter("reason = 'unreadable_image'"), "error_detail")).unionByName(
        rows("no rule matched", manifest.filter("reason = 'no_rule_matched'"), "archive"))
