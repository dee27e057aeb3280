"""Schemas of the tables the engine owns (see FIXTURES.md)."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, LongType, StringType,
                               StructField, StructType)

PRODUCTS_RAW = StructType([
    StructField("product_name", ArrayType(StructType([StructField("lang", StringType()),
                                                      StructField("text", StringType())]))),
    StructField("nutriments", ArrayType(StructType([StructField("name", StringType()),
                                                    StructField("value", FloatType()),
                                                    StructField("100g", FloatType())]))),
])

# read schema naming only the fields the cleaning job uses (nested pruning)
PRODUCTS_RAW_PRUNED = StructType([
    StructField("product_name", ArrayType(StructType([StructField("lang", StringType()),
                                                      StructField("text", StringType())]))),
    StructField("nutriments", ArrayType(StructType([StructField("name", StringType()),
                                                    StructField("100g", FloatType())]))),
])

PRODUCTS = StructType([StructField("product_name", StringType()), StructField("carbohydrates_100g", FloatType())])

PRODUCTS_EMBEDDED = StructType([
    StructField("index", LongType()), StructField("product_name", StringType()),
    StructField("embedding", ArrayType(FloatType())), StructField("word_count", LongType()),
    StructField("token_count", LongType()), StructField("carbohydrates_100g", DoubleType()),
])

RECIPES = StructType([
    StructField("title", StringType()), StructField("description", StringType()),
    StructField("ingredients", ArrayType(StringType())), StructField("instructions", ArrayType(StringType())),
    StructField("photo_url", StringType()),
])

RECIPES_LABELLED = StructType(RECIPES.fields + [StructField("keto", BooleanType()),
                                                StructField("vegan", BooleanType())])

INGREDIENTS = StructType([StructField("id", LongType()), StructField("ingredient", StringType())])

LABELS_SAMPLE = StructType([StructField("ingredients", StringType()), StructField("keto", BooleanType()),
                            StructField("vegan", BooleanType())])

LEXICON = StructType([StructField("term", StringType()), StructField("kind", StringType())])
LEXICON_EDGE = StructType([StructField("child", StringType()), StructField("parent", StringType())])
LEXICON_SENSE = StructType([StructField("term", StringType()), StructField("sense", StringType())])
CARB_OVERRIDE = StructType([StructField("product_name", StringType()),
                            StructField("carbohydrates_100g", DoubleType())])
