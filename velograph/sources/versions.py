"""Tables by source that are replaced as a whole: rows, counts and provenance change in one step.

New rows are staged in a folder of their own; only when all of them are written does one manifest take their place in the table,
beside the sources that stay, together with the record of the import and its counts. A reader goes by the manifest that it read, so it
sees the table before or after and never between; a failed import changes nothing. Older versions' files stay until ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import prepare
from . import files

IMPORTS = "import_id long, source string, dataset string, feature_count long, path_count long"
EMPTY = {"version": 0, "schema": None, "sources": {}, "imports": []}


class Changed(RuntimeError):
    """Another import has been committed since the table was read."""


def manifest(path: str) -> dict:
    return files.read_manifest(path) or EMPTY


def replace(rows: DataFrame, path: str, dataset: str, feature_counts: dict[str, int] | None = None) -> dict:
    """Replace all that the table holds of the rows' sources, and record an import for each: how many features it was made
    of (``feature_counts``, or its rows) and how many rows it has. Sources without rows keep what they have, unless
    ``feature_counts`` names them: these are emptied. Returns the new manifest."""
    before, counts = manifest(path), dict(feature_counts or {})
    spark = prepare(rows.sparkSession)
    staged = f"data-{uuid.uuid4().hex}"
    rows.write.partitionBy("source").parquet(f"{path}/{staged}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{staged}").groupBy("source").agg(F.count("*").alias("n"))
    paths = {r["source"]: r["n"] for r in written.collect()}  # a row for each source
    sources, imports = dict(before["sources"]), list(before["imports"])
    for source in sorted({*paths, *counts}):
        sources[source] = staged
        imports.append({"import_id": len(imports) + 1, "source": source, "dataset": dataset, "feature_count": counts.get(source, paths.get(source, 0)), "path_count": paths.get(source, 0)})
    if manifest(path)["version"] != before["version"]:
        raise Changed(path)
    after = {"version": before["version"] + 1, "schema": rows.schema.jsonValue(), "sources": sources, "imports": imports}
    files.write_manifest(path, after)
    return after


def read(spark: SparkSession, path: str, of: dict | None = None) -> DataFrame:
    """The table of a manifest (the present one, if none is given)."""
    of = of or manifest(path)
    if of["schema"] is None:
        raise ValueError(f"no import was committed to {path}")
    schema, out = StructType.fromJson(of["schema"]), None
    for folder in sorted(set(of["sources"].values())):
        mine = [s for s, f in of["sources"].items() if f == folder]
        part = prepare(spark).read.schema(schema).parquet(f"{path}/{folder}").where(F.col("source").isin(*mine)).select(*schema.names)
        out = part if out is None else out.unionByName(part)
    return out


def imports(spark: SparkSession, path: str) -> DataFrame:
    rows = manifest(path)["imports"]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in IMPORTS.split(", ")) for r in rows], IMPORTS)


def vacuum(path: str) -> None:
    """Remove the files of older versions and of failed imports; for when no reader is left that began with an older manifest."""
    kept = tuple(f"{f}/" for f in manifest(path)["sources"].values())
    files.discard(path, [x for x in files.names(path) if x != files.MANIFEST and not x.startswith(kept)])
