"""How the driver tables stand in for the application's own data.

``part`` rows become ingredient lines and ``(p_brand, p_size)`` recipes,
half the distance of ``p_retailprice`` from 950 is the carbohydrate value, ``documents`` are
recipe / description texts, ``labels`` are truth / prediction pairs,
``embeddings`` are the product catalogue, and ``nation -> region`` gives
real category edges.  Each builder has its DuckDB twin for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.plans.sql_text import q
from larder.session import read_table

CARBS_SQL = "(abs(p_retailprice - 950.0) / 2.0)"


def carbs() -> Column:
    """Carbohydrates of a part: 0 to 25, on both sides of the limit of 10."""
    return F.abs(F.col("p_retailprice") - 950.0) / 2.0


UNITS = ["cups", "tablespoons", "fluid ounces", "large", "pinch"]


def ingredient_line(p_size="p_size", p_name="p_name", p_type="p_type") -> Column:
    s = F.col(p_size)
    qty = F.concat((s % 4 + 1).cast("string"), F.when(s % 3 == 0, F.lit(" 1/2")).otherwise(F.lit("")))
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (s % 5 + 1).cast("int"))
    prep = F.when(s % 2 == 0, F.lit("chopped ")).otherwise(F.lit(""))
    plural = F.when(s % 7 == 0, F.lit("es")).when(s % 2 == 0, F.lit("s")).otherwise(F.lit(""))
    return F.concat(qty, F.lit(" "), unit, F.lit(" "), prep, F.col(p_name), plural,
                    F.lit(" ("), F.lower(F.col(p_type)), F.lit("), to taste"))


def ingredient_line_sql(p_size="p_size", p_name="p_name", p_type="p_type") -> str:
    unit = "CASE " + " ".join(f"WHEN {p_size} % 5 = {i} THEN {q(u)}" for i, u in enumerate(UNITS)) + " END"
    return (f"(CAST({p_size} % 4 + 1 AS VARCHAR) || CASE WHEN {p_size} % 3 = 0 THEN ' 1/2' ELSE '' END"
            f" || ' ' || {unit} || ' ' || CASE WHEN {p_size} % 2 = 0 THEN 'chopped ' ELSE '' END"
            f" || {p_name} || CASE WHEN {p_size} % 7 = 0 THEN 'es' WHEN {p_size} % 2 = 0 THEN 's' ELSE '' END"
            f" || ' (' || lower({p_type}) || '), to taste')")


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_brand", "p_size", "p_retailprice", "p_name",
                       ingredient_line().alias("line"))


# Made lexicon for the driver tables: part names use the words
# red blue hot cold old new small large + bolt gear ring rod plate anvil widget gizmo.
FLAGGED = ["bolt", "widget", "widgete", "gizmo", "red gear", "old-anvil"]
EXCUSING_BEFORE = ["new", "cold hot"]
EXCUSING_AFTER = ["substitute"]
# Made category edges (child, parent) added to nation -> region, with a cycle.
MADE_EDGES = [("red", "color"), ("blue", "color"), ("color", "plant"), ("small", "size"),
              ("size", "shape"), ("shape", "plant"), ("plant", "shape"),
              ("EARTH", "AFRICA"), ("CONTINENT", "EARTH"), ("AFRICA", "CONTINENT")]
PLANT_ROOTS = ["plant"]
CLOSURE_ROOTS = ["AFRICA", "EUROPE", "plant"]


def lexicon_rows():
    return [(t, "flagged") for t in FLAGGED] + [(t, "excusing_before") for t in EXCUSING_BEFORE] + \
           [(t, "excusing_after") for t in EXCUSING_AFTER]


def lexicon_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon_rows(), "term string, kind string")


def lexicon_sql() -> str:
    return "(VALUES " + ", ".join(f"({q(t)}, {q(k)})" for t, k in lexicon_rows()) + ") lex(term, kind)"


def edges_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    real = nation.join(region, nation.n_regionkey == region.r_regionkey) \
        .select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    made = spark.createDataFrame(MADE_EDGES, "child string, parent string")
    return real.unionByName(made)


def edges_sql() -> str:
    made = ", ".join(f"({q(c)}, {q(p)})" for c, p in MADE_EDGES)
    return (f"SELECT n.n_name AS child, r.r_name AS parent FROM nation n JOIN region r "
            f"ON n.n_regionkey = r.r_regionkey UNION ALL SELECT * FROM (VALUES {made}) v(child, parent)")
