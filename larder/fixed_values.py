"""Fixed values.

These lists must equal the ones the original application uses, because the
results depend on them word for word.  They are stated here once, plainly and
in their original order; every other module imports them from here.
"""

# --- FIXED VALUES (must match the original application) -------------------

# Measurement words removed from ingredient lines, in the original order.
MEASUREMENT_WORDS = [
    "cup", "cups", "can", "cans", "tablespoon", "tablespoons", "tbsp", "teaspoon", "teaspoons", "tsp",
    "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs", "gram", "grams", "g",
    "kilogram", "kilograms", "kg", "milliliter", "milliliters", "ml", "liter", "liters", "l",
    "pinch", "pinches", "dash", "dashes", "piece", "pieces", "slice", "slices", "small", "medium", "large",
    "cube", "cubes", "inch", "inches", "cm", "mm", "quart", "quarts", "qt", "jar", "scoop", "scoops",
    "gallon", "gallons", "gal", "pint", "pints", "pt", "fluid ounce", "fluid ounces", "fl oz",
    "package", "packages", "pkg", "pack", "packs",
]

# Plant category roots: a flagged word is excused when the word before it is
# one of these or lies below one of them in the category relation.
PLANT_CATEGORIES = [
    "nut", "seed", "almond", "legume", "grain", "fruit", "vegetable", "herb", "alga", "plant", "fungus",
]

# Words that excuse a flagged word when they stand right before it
# (as one word, or as two words joined by a space).
EXCUSING_BEFORE = [
    "vegan", "non-dairy", "plant based", "tofu", "natto", "seitan", "silan", "beyond", "impossible",
    "nori", "chia", "portobello", "champignon", "not", "no",
]

# Words that excuse a flagged word when they stand right after it.
EXCUSING_AFTER = ["free", "alternative", "substitute"]

# ASCII punctuation turned into blanks by ingredient normalisation
# (the 32 characters of the C locale punctuation class).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Words of the simple keyword heuristic for the plant-based label (substring test).
HEURISTIC_ANIMAL_WORDS = "egg meat milk butter veel lamb beef chicken sausage".split()

# Relevance ranking defaults of the search service (BM25).
BM25_K1 = 1.2
BM25_B = 0.75

# Page size of search answers.
SEARCH_PAGE_SIZE = 12

# Diet names that can be filtered on.
DIETS = ["keto", "vegan"]

# --- end of fixed values ---------------------------------------------------
