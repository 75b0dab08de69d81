"""Imports of foreign tables into collections, with column detection, and a command line for it.

    python -m quillon.sources.importers SOURCE.parquet COLLECTION_DIR [--metric cosine]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.store import Collection


def detect(schema: T.StructType) -> dict[str, str | None]:
    """The vector, id and document columns: by their usual names, else the first of a fitting type."""
    names = {f.name: f.dataType for f in schema.fields}
    numeric = lambda t: isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType))
    vector = "vector" if "vector" in names else next((n for n, t in names.items() if numeric(t)), None)
    if vector is None:
        raise ValueError("no column holds vectors")
    document = next((n for n in ("text", "document", "content") if n in names), None)
    ident = "id" if "id" in names else next((n for n, t in names.items() if isinstance(t, T.StringType) and n != document), None)
    return {"vector": vector, "id": ident, "document": document}


def adapt(df: DataFrame) -> DataFrame:
    """(pos, id, vector, metadata, document): other columns become metadata, without nulls; ids are row_i if there are none."""
    c = detect(df.schema)
    rest = [n for n in df.columns if n not in c.values()]
    pos = F.monotonically_increasing_id()
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    ident = F.col(c["id"]).cast("string") if c["id"] else F.concat(F.lit("row_"), pos.cast("string"))
    document = F.col(c["document"]) if c["document"] else F.lit(None).cast("string")
    return df.select(pos.alias("pos"), ident.alias("id"), F.col(c["vector"]).cast("array<float>").alias("vector"), meta.alias("metadata"), document.alias("document"))


def import_table(df: DataFrame, path: str, metric: str = "ip", mode: str = "upsert") -> Collection:
    rows = adapt(df)
    first = rows.where("vector is not null").select(F.size("vector").alias("d")).first()
    if first is None:
        raise ValueError("the table has no vectors")
    out = Collection.open(df.sparkSession, path, first["d"], metric)
    out.write(rows, mode)
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--format", default="parquet")
    p.add_argument("--metric", default="cosine")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    out = import_table(spark.read.format(a.format).load(a.source), a.target, a.metric)
    print(f"{out.count()} rows in {a.target}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
