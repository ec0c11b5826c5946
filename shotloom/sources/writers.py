"""Sinks: JSON lines, write-once tables, artifact lineage and stage caches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines; a number that is not one is an error."""
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            rows = rows.withColumn(name, F.when(F.isnan(name), F.raise_error(F.lit(f"not a number in {name}")).cast(kind)).otherwise(F.col(name)))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def content_key(rows: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order."""
    row = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *rows.columns))).first()
    return ":".join(str(x) for x in row)


def write_once(rows: DataFrame, path: str) -> bool:
    """Write a table unless it is there; the same rows again are no change, others an error. Whether it was written."""
    try:
        there = rows.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows.write.mode("errorifexists").parquet(path)
        return True
    if content_key(there) != content_key(rows):
        raise ValueError(f"{path} holds other rows")
    return False


def artifact_records(files: DataFrame, kind: str, path: str = "path", content: str = "content", version: int = 1) -> DataFrame:
    """Lineage rows of artifacts: an id from kind and content hash, kind, path, hash, version."""
    digest = F.sha2(content, 256)
    payload = F.concat(F.lit('{"content_hash":"'), digest, F.lit(f'","kind":"{kind}"}}'))
    name = F.concat(F.lit("artifact_"), F.substring(F.sha2(payload, 256), 1, 24))
    return files.select(name.alias("artifact_id"), F.lit(kind).alias("kind"), path, digest.alias("content_hash"), F.lit(version).alias("schema_version"))


def cached_stage(spark: SparkSession, root: str, name: str, config: str, inputs: dict[str, DataFrame], build: object) -> DataFrame:
    """The table that ``build(**inputs)`` makes, kept under a name made of the stage, its config and its inputs' rows.

    A second call with the same three reads the table instead; anything else builds anew.
    """
    import hashlib

    key = hashlib.sha256("\0".join([name, config, *(f"{k}={content_key(v)}" for k, v in sorted(inputs.items()))]).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build(**inputs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_snapshot(rows: DataFrame, root: str, version: int) -> None:
    """Write one version of a table; a version that is there is never written again, but is an error."""
    rows.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/version={version}")
