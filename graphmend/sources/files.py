"""File sources and sinks of the resolution workflow (CSV, JSON, Parquet).

Schemas are declared, never inferred, for the triple and node tables: an
inferred schema costs a full extra pass at scale and can change between
files.  Nested columns are written to CSV through ``to_json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE_COLUMNS = [
    "source", "source type", "target", "target type",
    "source_extracted_definition", "source_generated_definition",
    "target_extracted_definition", "target_generated_definition",
]

TRIPLE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in TRIPLE_COLUMNS])
REMAP_SCHEMA = "id string, parent_node string"


def read_triples_csv(spark: SparkSession, path: str, schema: T.StructType = TRIPLE_SCHEMA, order_col: str = "row_id",
                     multiline: bool = True) -> DataFrame:
    """Triple CSV (header, quoted multi-line fields) with canonical column names.

    ``source type`` / ``target type`` become ``source_type`` / ``target_type``;
    a ``row_id`` that follows file order is added, because "keep first" and
    "last wins" rules depend on it (it is partition-order based: read the
    file once and keep the id with the data).  Fields with line breaks need
    ``multiline``, which reads each file in one task; files without such
    fields are split when it is off.
    """
    df = (
        spark.read.schema(schema).option("header", True).option("multiLine", multiline)
        .option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    )
    for c in df.columns:
        if " " in c:
            df = df.withColumnRenamed(c, c.replace(" ", "_"))
    return df.withColumn(order_col, F.monotonically_increasing_id())


def read_remap_csv(spark: SparkSession, path: str) -> DataFrame:
    """Type remap table ``id, parent_node``."""
    return spark.read.schema(REMAP_SCHEMA).option("header", True).option("escape", '"').csv(path)


def read_nodes_csv(spark: SparkSession, path: str, label_col: str = ":LABEL") -> DataFrame:
    """Property-graph node CSV; the ``:LABEL`` column is exposed as ``label``."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.withColumn("label", F.col(f"`{label_col}`"))


def read_json_table(spark: SparkSession, path: str, columns: list[str], orient: str = "columns") -> DataFrame:
    """JSON table as the pandas reader lays it out.

    ``orient="lines"`` / ``"records"``: one object per row (splittable for
    lines).  ``orient="columns"``: one object ``{column: {index: value}}``; it
    is parsed as a map, exploded to (column, index, value) rows and pivoted
    back on the index with the given column list (a single such object is a
    single file by nature; use lines for large tables).
    """
    if orient == "lines":
        return spark.read.json(path).select(*columns)
    if orient == "records":
        return spark.read.option("multiLine", True).json(path).select(*columns)
    raw = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", "map<string,map<string,string>>")
    cells = raw.select(F.explode(m).alias("col", "inner")).select("col", F.explode("inner").alias("idx", "val"))
    wide = cells.groupBy("idx").pivot("col", columns).agg(F.first("val"))
    return wide.withColumn("row_index", F.col("idx").cast("bigint")).drop("idx").select("row_index", *columns)


def read_outputs_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Converted outputs or verdicts (``write_csv``): nested columns are JSON text and get their type back."""
    fields = T.StructType.fromDDL(schema).fields
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else f.dataType) for f in fields])
    df = spark.read.schema(flat).option("header", True).option("escape", '"').csv(path)
    return df.select(*[F.from_json(f"`{f.name}`", f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
                       for f in fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header; array / map / struct columns go out as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    out = df.select(*cols).write.mode(mode).option("header", True).option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
