"""All tables about one tree of source files, from one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks.operators import corpus, deps, javasource, jobtable, schemas
from shuffleworks.session import durable
from shuffleworks.sources.files import scan_files, scan_schemas, scan_summary


@dataclass(frozen=True)
class ProjectTables:
    files: DataFrame
    summary: DataFrame
    errors: DataFrame
    classes: DataFrame
    role_counts: DataFrame
    fields: DataFrame
    unresolved: DataFrame
    jobs: DataFrame
    risks: DataFrame
    verdict: DataFrame


def analyse_project(
    spark: SparkSession, root: str, prefixes: list[str] | DataFrame, action: str = "warn", skip_build_dirs: bool = True
) -> ProjectTables:
    """Classes, schemas, jobs and risks of the files below ``root``.

    The classes feed five of the tables and are checkpointed once; all else is
    lazy.
    """
    scanned = scan_files(spark, root, skip_build_dirs)
    files, errors = corpus.split_good_bad(scanned)
    sources = files.where(F.col("kind") == "source")
    parsed = javasource.scan_once(sources)
    classes = durable(javasource.scan_classes(parsed))
    fields, unresolved = schemas.resolve_schemas(classes, sources, scan_schemas(spark, root))
    risks = deps.scan_risks(classes, files.where(F.col("kind") == "build"), prefixes)
    return ProjectTables(
        files=scanned.drop("content"),
        summary=scan_summary(scanned),
        errors=errors,
        classes=classes,
        role_counts=corpus.role_counts(classes),
        fields=fields,
        unresolved=unresolved,
        jobs=jobtable.assemble_jobs(sources, classes, scanned=parsed),
        risks=risks,
        verdict=deps.risk_verdict(risks, action),
    )
