"""Product facts from catalogue pages (WEB-01..03).

A page is read as the list of its text cells, the texts between tags in order.
Product facts are looked up by the cells around them.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column, label and unit of each line of the nutrition panel. A
# label may have words before it, but for those in WHOLE_LABELS.
PANEL = (
    ("fat_g", "Fat", "g"), ("sat_fat_g", "Saturated", "g"), ("carbs_g", "Carbohydrate", "g"), ("fibre_g", "Fibre", "g"), ("sugars_g", "Sugars", "g"),
    ("protein_g", "Protein", "g"), ("cholesterol_mg", "Cholesterol", "mg"), ("sodium_mg", "Sodium", "mg"), ("potassium_mg", "Potassium", "mg"),
)
WHOLE_LABELS = ("Fat", "Protein")
UNITS = "lb|kg|g|oz|mL|L"
HIDDEN = r"(?is)<(script|svg)\b.*?</\1\s*>"


def page_links(pages: DataFrame, key: str, pattern: str) -> DataFrame:
    """WEB-01: distinct link targets of each page."""
    links = F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))
    return pages.select(key, links.alias("link")).distinct()


def unescape(col: Column) -> Column:
    """HTML entities to characters, a batch of texts at a time."""
    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return decode(col)


def with_cells(pages: DataFrame, out: str = "cells") -> DataFrame:
    """Add the texts between tags, white space made single; blank ones stay
    only at both ends, where they say that the page begins or ends with a tag.
    Scripts and drawings are no text. A bar in a text parts cells too."""
    shown = F.regexp_replace("html", HIDDEN, " ")
    marked = pages.withColumn(out, F.split(unescape(F.regexp_replace(shown, "<[^>]+>", "|")), "[|]"))
    marked = marked.withColumn(out, F.transform(out, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))))
    return marked.withColumn(out, F.filter(out, lambda t, i: (t != "") | (i == 0) | (i == F.size(out) - 1)))


def flatten_html(pages: DataFrame, out: str = "flat") -> DataFrame:
    """WEB-02: the cells of a page with bars between them."""
    return with_cells(pages, "_cells").withColumn(out, F.array_join("_cells", " | ")).drop("_cells")


def cell_pairs(cells: str) -> Column:
    """Each cell with the one behind it, '' behind the last."""
    size = F.size(cells)
    return F.zip_with(F.col(cells), F.slice(F.col(cells), F.lit(2), F.greatest(size - 1, F.lit(0))), lambda a, b: F.struct(a.alias("at"), F.coalesce(b, F.lit("")).alias("then")))


def cell_after(pairs: str, test) -> Column:
    """The cell behind the first one that passes ``test`` (cell, next cell), or ''."""
    return F.coalesce(F.get(F.filter(pairs, lambda p: test(p["at"], p["then"])), F.lit(0))["then"], F.lit(""))


def amounts(pairs: str) -> Column:
    """The few pairs that end in an amount of a unit of the panel."""
    units = "|".join(dict.fromkeys(unit for _, _, unit in PANEL))
    return F.filter(pairs, lambda p: p["then"].rlike(rf"^[\d.]+ (?:{units})"))


def nutrient(pairs: str, label: str, unit: str) -> Column:
    """The amount of one line of the panel: a label cell, then amount and unit."""
    names = (lambda c: c == label) if label in WHOLE_LABELS else (lambda c: c.endswith(label))
    amount = rf"^([\d.]+) {unit}"
    return F.regexp_extract(cell_after(pairs, lambda at, then: names(at) & then.rlike(amount)), amount, 1)


def package_sizes(cells: str) -> Column:
    """Distinct cells before the ingredients that are nothing but a size."""
    tab = F.coalesce(F.get(F.filter(F.transform(cells, lambda c, i: F.when(c.contains("Ingredients"), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(cells))
    return F.array_distinct(F.filter(F.slice(F.col(cells), F.lit(1), tab), lambda c: c.rlike(rf"^[\d.]+ ?(?:{UNITS})$")))


def size_in_grams(sizes: str) -> Column:
    """Grams of the first size in grams, else of the first in kilograms."""
    first = lambda unit: F.regexp_extract(F.get(F.filter(sizes, lambda s: s.rlike(rf"^[\d.]+ ?{unit}$")), F.lit(0)), r"^([\d.]+)", 1)
    kilos = F.round(first("kg").try_cast("double") * 1000).cast("bigint").cast("string")
    return F.coalesce(first("g"), kilos, F.lit(""))


def extract_product(pages: DataFrame, key: str, max_sizes: int | None = None) -> DataFrame:
    """WEB-03: one product row per page with a JSON-LD product block: name,
    code, price, stock, sizes, ingredients, allergens and the whole panel."""
    scripts = F.regexp_extract_all("html", F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    product = F.get(F.filter(scripts, lambda s: F.get_json_object(s, "$['@type']") == "Product"), F.lit(0))
    field = lambda path: F.coalesce(F.trim(F.get_json_object("_product", path)), F.lit(""))
    d = pages.withColumn("_product", product).where(F.col("_product").isNotNull()).where(field("$.productID") != "")
    d = with_cells(d, "_cells").withColumn("_sizes", package_sizes("_cells"))
    if max_sizes is not None:
        d = d.withColumn("_sizes", F.slice("_sizes", 1, max_sizes))

    # paired once; the lines of the panel are sought among the amounts only
    d = d.withColumn("_pairs", cell_pairs("_cells")).withColumn("_amounts", amounts("_pairs"))

    # the tab heading stands twice before the ingredients
    tab = F.filter(F.sequence(F.lit(0), F.size("_cells")), lambda i: (F.get("_cells", i) == "Ingredients") & (F.get("_cells", i + 1) == "Ingredients"))
    d = d.withColumn("_tab", F.get(tab, F.lit(0)))
    cell = lambda k: F.coalesce(F.get("_cells", F.col("_tab") + k), F.lit(""))
    serving = F.regexp_extract(cell_after("_pairs", lambda at, then: (at == "Nutrition Facts") & then.startswith("Per ")), "^Per (.*)$", 1)
    energy = F.regexp_extract(F.coalesce(F.get(F.filter("_cells", lambda c: c.rlike(r"Calories \d")), F.lit(0)), F.lit("")), r"Calories (\d+)", 1)
    return d.select(
        key, field("$.productID").alias("plu"), field("$.name").alias("product_name"), F.regexp_replace(field("$.description"), r"\s+", " ").alias("web_description"), field("$.offers.price").alias("price"),
        F.when(field("$.offers.availability").contains("InStock"), "Y").otherwise("N").alias("in_stock"), F.array_join("_sizes", " / ").alias("package_size"), size_in_grams("_sizes").alias("size_g"),
        cell(2).alias("ingredients"), F.when(cell(3) == "Allergens", cell(4)).otherwise("").alias("allergens"),
        serving.alias("serving_size"), F.regexp_extract(serving, r"\(([\d.]+) ?g\)", 1).alias("serving_g"), energy.alias("calories"), *[nutrient("_amounts", label, unit).alias(c) for c, label, unit in PANEL],
    )
