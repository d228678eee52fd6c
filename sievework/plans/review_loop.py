"""The review loop: forms go out without overwriting answers, and come back as decisions, all or none."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.overrides import upsert_decisions
from sievework.operators.review import CROP_ALIASES, FormError, blank_form, check_form, import_form
from sievework.operators.sampling import audit_sample
from sievework.schema import FORM, OVERRIDES
from sievework.session import cut_lineage
from sievework.sources.tables import read_table, table_exists, write_table
from sievework.sources.versions import State, VersionedTables


def audit_form(manifest: DataFrame, version: str, per_group: int, exceptions: Mapping[tuple[str, str], int], seed: int | str) -> DataFrame:
    """An empty form for the audit sample, in the order of data set and label."""
    return blank_form(audit_sample(manifest, per_group, exceptions, seed), version).orderBy("dataset_id", "source_label", "image_id")


def write_form(form: DataFrame, path: str, force: bool = False, fmt: str = "csv") -> bool:
    """Write a form unless one is there; `force` replaces it as long as no verdict is filled in. Says if it wrote."""
    spark = form.sparkSession
    if table_exists(spark, path):
        if not force:
            return False
        answered = read_table(spark, path, FORM, fmt).filter(F.trim(F.coalesce("verdict", F.lit(""))) != "").count()
        if answered:
            raise FormError(f"{path} has {answered} answers and is not replaced")
    write_table(form, path, FORM, fmt)
    return True


def import_review(form: DataFrame, manifest: DataFrame, taxonomy: DataFrame, version: str, form_name: str, decided_by: str,
                  tables: VersionedTables, decided_at: Column | None = None, aliases: Mapping[str, str] = CROP_ALIASES) -> DataFrame:
    """Validate a filled form, put its decisions into the current ones, in the order of reason and id, and add them to
    the history. A form with a fault changes nothing, and a run that stops halfway changes neither table. Returns the
    decisions of the form."""
    fresh = cut_lineage(import_form(check_form(form, manifest, taxonomy, version, aliases), form_name, decided_by, decided_at))
    put_decisions(tables, fresh)
    return fresh


def put_decisions(tables: VersionedTables, fresh: DataFrame, layout: str = OVERRIDES, seq: str = "decided_at") -> State:
    """The version of `decisions` and `history` with new decisions in both. `fresh` is read twice."""
    base = tables.state()
    current = upsert_decisions(tables.read("decisions", layout, base), fresh, seq)
    return tables.change(base, {"decisions": current.orderBy("reason", "image_id")}, {"history": fresh})
