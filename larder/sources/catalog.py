"""Tables of the session catalog: created with types, defaults and comments, guarded, loaded and dropped by name.

Tables are external: their files lie below the location that the caller gives,
on storage that every executor sees, and a dropped table leaves the files for the caller to keep or remove.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from larder.functions.sql_functions import lit


@dataclass(frozen=True)
class Column:
    """One column: ``default`` is an SQL literal that a load without the column gets (``NULL`` if none)."""
    name: str
    type: str
    default: str | None = None
    comment: str = ""


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def create(spark: SparkSession, name: str, columns: list[Column], location: str, comment: str = "",
           partitioned_by: list[str] = ()) -> bool:
    """Create table ``name`` unless it is there; True if it was created."""
    if spark.catalog.tableExists(name):
        return False
    parts = []
    for c in columns:
        default = f" DEFAULT {c.default}" if c.default is not None else ""
        parts.append(f"{_quoted(c.name)} {c.type}{default} COMMENT {lit(c.comment)}")
    by = f"PARTITIONED BY ({', '.join(map(_quoted, partitioned_by))})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE {_quoted(name)} ({', '.join(parts)}) USING parquet {by} "
              f"LOCATION {lit(location)} COMMENT {lit(comment)}")
    return True


def is_loaded(spark: SparkSession, name: str) -> bool:
    """The table is there and has a row."""
    return spark.catalog.tableExists(name) and not spark.table(name).isEmpty()


def load(df: DataFrame, name: str, rebuild: bool = False) -> int:
    """Load ``df`` by column names unless the table has rows; rows written (0 if it was left alone).

    Columns that ``df`` lacks get their defaults, columns that the table
    lacks are left out.  ``rebuild`` replaces what is there.
    """
    spark = df.sparkSession
    if not rebuild and is_loaded(spark, name):
        return 0
    here = {c.lower() for c in df.columns}
    names = ", ".join(_quoted(c) for c in spark.table(name).columns if c.lower() in here)
    view = "load_" + name.replace(".", "_")
    df.createOrReplaceTempView(view)
    try:
        how = "INSERT OVERWRITE" if rebuild else "INSERT INTO"
        spark.sql(f"{how} {_quoted(name)} ({names}) SELECT {names} FROM {_quoted(view)}")
    finally:
        spark.catalog.dropTempView(view)
    return spark.table(name).count()


def describe(spark: SparkSession, name: str) -> DataFrame:
    """``column, type, comment, default`` of the table, in its order."""
    rows = [(f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment", ""),
             (f.metadata or {}).get("CURRENT_DEFAULT")) for f in spark.table(name).schema.fields]
    return spark.createDataFrame(rows, "column string, type string, comment string, default string")


def drop(spark: SparkSession, name: str) -> bool:
    """Drop the table, files stay; False if it was not there."""
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    return there
