"""Queries of the core operators for large data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from garimpo.operators import schema_drift, units
from garimpo.session import table


def p3_found(spark, sf_dir):
    """(deadline_id, basis, minutes) of each deadline with a determined amount."""
    return units.to_minutes(table(spark, sf_dir, "deadlines"))


def p5_found(spark, sf_dir):
    """(extraction_id, change_kind, old_name, new_name) of every change within a series."""
    return schema_drift.found_changes(table(spark, sf_dir, "table_extractions"))


def p5_versions(spark, sf_dir):
    """Fingerprint and version of each file."""
    return schema_drift.versions(table(spark, sf_dir, "table_extractions"))


def p5_records(spark, sf_dir):
    """The records of all files under canonical names."""
    return schema_drift.unified(table(spark, sf_dir, "table_extractions"))


def p5_rules(spark, sf_dir):
    """The table of schema versions with their rename, cast and default rules."""
    return schema_drift.version_rules(table(spark, sf_dir, "table_extractions")).select("family", "version", "first_month", "files", "fingerprint", F.to_json("renames").alias("renames"), F.to_json("casts").alias("casts"), F.array_sort(F.map_keys("defaults")).alias("missing"))


def _family(name: str):
    def query(spark, sf_dir):
        return schema_drift.family_table(table(spark, sf_dir, "table_extractions"), name)

    query.__name__, query.__doc__ = f"p5_family_{name}", f"All files of the family {name} as one typed table."
    return query


FAMILIES = ("cadastro", "estoque", "rol_procedimentos", "vendas")
QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_versions, p5_rules, p5_records, *map(_family, FAMILIES))}
SQL: dict[str, str] = {}
