"""Licence scan by sparse TF-IDF cosine and inheritance from the nearest ancestor directory (operator 2).

Weights are 1 + ln((1 + lines) / (1 + lines with the word)) for every word,
counted over all lines; lines without words count, but are no part of a run. The
units compared are set by the words of a template, not by lines, so wrapping
does not matter:

- With a template or header: every run of adjacent lines that begins and ends
  with a line that has one of its words and holds at most SPAN times its number
  of words; single lines always.
- With a full licence text: the whole text of the file, and its best stretch:
  from a line with one of the text's words to the last such line that begins
  fewer words later than the full text has, where the dot product is greatest
  (ties: the first). So a licence inside a source file is found too.

What can reach the threshold is bounded first, without losing any unit: a file by
the squared parts of a template whose words it has at all, a run by its lines'
squared norms, which its own squared norm is never below. A file has the licence
of the best full text at the threshold, else that of its best run. A directory
has the licence of its licence files; a file without a licence of its own takes
that of the nearest directory above it. All of it is DataFrame functions; only
the words of the templates, a fixed list, pass through the driver.

Null or empty text: no licence of its own. Null path: nothing is inherited. Ties
go to the first template name, and in a directory to the first licence by name.
Repeated rows are judged each; a file is a row. Empty table: no rows. Columns
beside file, path, is_licence_file and text are kept, except those named as a
result column, which the result replaces.
"""

from __future__ import annotations

import json
import math
import pkgutil
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopledger.session import cut_lineage

# Names and headers of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Proprietary": "All rights reserved.",
}
MARKS = ".,;:!?()[]{}\"'`|*#$%&+/\\<>_=@^~-"
THRESHOLD = 0.8
SPAN = 2
# Headers and names as they stand over one or several lines, beside the templates.
HEADERS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.
        If not, see <https://www.gnu.org/licenses/>."""),
    ("MIT", "MIT License"),
]
FULL = ("Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MIT")


def plain(text: str) -> list[str]:
    return "".join(c for c in text.lower() if c not in MARKS).split()


def full_texts() -> list[tuple[str, str]]:
    """Whole licence files, as they lie in ``license_texts``."""
    return [(name, (pkgutil.get_data("shopledger.llm", f"license_texts/{name}.txt") or b"").decode()) for name in FULL]


def line_words(text: Column) -> Column:
    """Array of lines, each the array of its words in lower case without marks."""
    clean = F.translate(F.lower(text), "\t\r" + MARKS, "  ")
    return F.transform(F.split(clean, "\n", -1), lambda line: F.filter(F.split(line, " ", -1), lambda word: word != ""))


def line_counts(lines: DataFrame) -> DataFrame:
    """(word, n_lines): the lines that have each word; the empty word counts all lines."""
    each = F.array_union(F.array(F.lit("")), F.col("words"))
    return cut_lineage(lines.select(F.explode(each).alias("word")).groupBy("word").agg(F.count("*").alias("n_lines")))


def template_weights(counts: DataFrame, texts: list[str]) -> dict[str, float]:
    """Weight of each template word; the weight of the empty word is that of a word on no line."""
    words = sorted({"", *(w for t in texts for w in plain(t))})
    n = {r["word"]: r["n_lines"] for r in counts.where(F.col("word").isin(words)).collect()}
    lines = n.pop("", 0)
    return {w: 1 + math.log((1 + lines) / (1 + n.get(w, 0))) for w in words}


def unit_vector(text: str, weights: dict[str, float]) -> dict[str, float]:
    parts = {w: n * weights[w] for w, n in Counter(plain(text)).items()}
    norm = math.sqrt(sum(x * x for x in parts.values()))
    return {w: x / norm for w, x in parts.items()}


def within_reach(lines: Column, vectors: list[dict[str, float]], threshold: float) -> Column:
    """Templates (by number) of which a text has words enough for any part of it to reach the threshold.

    No part's cosine with a template is above the norm of the template's unit
    vector on the words that the text has.
    """
    squares: dict[str, dict[str, list[float]]] = {}
    for k, vector in enumerate(vectors):
        for w, x in vector.items():
            squares.setdefault(w[0], {}).setdefault(w, [0.0] * len(vectors))[k] = x * x
    # By first letter, as Spark searches a map from its start.
    table = F.from_json(F.lit(json.dumps(squares)), "map<string,map<string,array<double>>>")
    vocabulary = [w for some in squares.values() for w in some]
    known = F.filter(F.array_distinct(F.flatten(lines)), lambda w: w.isin(vocabulary))
    none = F.array_repeat(F.lit(0.0), len(vectors))
    cover = F.aggregate(known, none, lambda have, w: F.zip_with(have, table[F.substring(w, 1, 1)][w], lambda x, y: x + y))
    enough = F.transform(cover, lambda c, k: F.when(c >= threshold**2 * (1 - 1e-9), k))
    return F.filter(enough, lambda k: k.isNotNull())


def own_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(file, own_license, cosine) for files (file, text) with a unit at the threshold or above."""
    spark = files.sparkSession
    short = [*sorted(templates.items()), *HEADERS]
    texts = [*short, *full_texts()]
    counts = line_counts(files.select(F.explode(line_words(F.col("text"))).alias("words")))
    weights = template_weights(counts, [text for _, text in texts])
    vectors = [unit_vector(text, weights) for _, text in texts]
    parts = spark.createDataFrame([(k, w, x) for k, v in enumerate(vectors) for w, x in v.items()], "template int, word string, part double")
    kinds = [(k, name, len(plain(text)), k >= len(short)) for k, (name, text) in enumerate(texts)]
    kind = F.broadcast(spark.createDataFrame(kinds, "template int, license string, length int, full boolean"))

    near = files.select("file", "text", F.monotonically_increasing_id().alias("row"), line_words(F.col("text")).alias("lines"))
    near = near.withColumn("templates", within_reach(F.col("lines"), vectors, threshold)).where("size(templates) > 0")
    near = cut_lineage(near.select("file", "row", "lines", "templates"))
    line = near.select("row", F.posexplode("lines").alias("n", "words")).where("size(words) > 0")
    tf = line.select("row", "n", F.explode("words").alias("word")).groupBy("row", "n", "word").agg(F.count("*").alias("tf"))
    words = cut_lineage(tf.join(counts, "word").select("row", "n", "word", "tf", (F.col("tf") * (F.lit(weights[""]) - F.log1p("n_lines"))).alias("x")))

    # Lines with their place in words, and sums up to them of words and squared norms.
    before = Window.partitionBy("row").orderBy("n")
    sums = words.groupBy("row", "n").agg(F.sum("tf").alias("size"), F.sum(F.col("x") * F.col("x")).alias("square"))
    sums = sums.select("row", "n", "square", (F.sum("size").over(before) - F.col("size")).alias("start"), F.sum("size").over(before).alias("stop"), F.sum("square").over(before).alias("squares"))
    asked = near.select("file", "row", F.explode("templates").alias("template")).join(kind, "template")
    dots = words.join(F.broadcast(parts), "word").groupBy("row", "n", "template").agg(F.sum(F.col("x") * F.col("part")).alias("dot"))
    hits = dots.join(asked, ["row", "template"]).join(sums, ["row", "n"])
    hits = hits.withColumn("dots", F.sum("dot").over(Window.partitionBy("row", "template").orderBy("n")))

    # Frames of as many words as a template allows: the place is counted in such lengths.
    def ahead(length: Column):
        return Window.partitionBy("row", "template").orderBy(F.col("start") / length).rangeBetween(0, 1)

    run = hits.where("NOT full").withColumn("ends", F.collect_list(F.struct("n", "stop", "dots", "squares")).over(ahead(F.col("length") * SPAN + 0.5)))
    bound = lambda end: (end["dots"] - F.col("dots") + F.col("dot")) >= F.sqrt(end["squares"] - F.col("squares") + F.col("square")) * (threshold * (1 - 1e-6))
    inside = lambda end: (end["n"] == F.col("n")) | (end["stop"] - F.col("start") <= F.col("length") * SPAN)
    run = run.withColumn("end", F.explode(F.filter("ends", lambda end: inside(end) & bound(end))))
    run = run.select("file", "row", "license", F.lit(1).alias("order"), F.col("n").alias("s"), F.col("end.n").alias("e"), (F.col("end.dots") - F.col("dots") + F.col("dot")).alias("dot"))
    full = hits.where("full")
    place = ahead(F.col("length") - 0.5)
    best = full.select("file", "row", "template", "license", F.struct(F.round(F.sum("dot").over(place), 9).alias("dot"), (-F.col("n")).alias("s"), F.max("n").over(place).alias("e")).alias("best"))
    best = best.groupBy("file", "row", "template", "license").agg(F.max("best").alias("best")).select("file", "row", "license", F.lit(0).alias("order"), (-F.col("best.s")).alias("s"), "best.e", "best.dot")
    whole = full.groupBy("file", "row", "template", "license").agg(F.sum("dot").alias("dot"))
    ends = sums.groupBy("row").agg(F.min("n").alias("s"), F.max("n").alias("e"))
    whole = whole.join(ends, "row").select("file", "row", "license", F.lit(0).alias("order"), "s", "e", "dot")
    units = cut_lineage(run.union(best).union(whole))

    each = units.select("row", "s", "e").distinct().select("row", "s", "e", F.explode(F.sequence("s", "e")).alias("n"))
    each = each.join(words, ["row", "n"]).groupBy("row", "s", "e", "word").agg(F.sum("x").alias("x"))
    norms = each.groupBy("row", "s", "e").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    found = units.join(norms, ["row", "s", "e"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
    best = found.where(F.col("cosine") >= threshold).groupBy("file").agg(F.min(F.struct("order", (-F.col("cosine")).alias("c"), "license")).alias("best"))
    return best.select("file", F.col("best.license").alias("own_license"), (-F.col("best.c")).alias("cosine"))


def license_scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds own_license, cosine, license and from_path to files (file, path, is_licence_file, text).

    ``file`` names the row, ``path`` is its place with slashes. from_path is the
    file itself, the directory it inherits from, or null.
    """
    known = ("file", "path", "is_licence_file", "text", "own_license", "cosine", "license", "from_path")
    extra = [c for c in files.columns if c not in known]
    found = files.select("file", "path", "is_licence_file", F.struct(F.lit(0), *extra).alias("extra"))
    found = found.join(own_licences(files.select("file", "text"), templates, threshold), "file", "left")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    found = found.withColumn("directory", parent)
    licensed = found.where("is_licence_file AND own_license IS NOT NULL AND path IS NOT NULL").groupBy(F.col("directory").alias("above")).agg(F.min("own_license").alias("inherited"))
    # Directories, not files, walk up: each once, with all its ancestors.
    here = found.where("own_license IS NULL AND path IS NOT NULL").select("directory").distinct()
    steps = F.split("directory", "/", -1)
    chain = here.select("directory", F.posexplode(F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("up", "above"))
    nearest = chain.join(licensed, "above").groupBy("directory").agg(F.min(F.struct("up", "above", "inherited")).alias("near"))
    out = found.join(nearest, "directory", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        "file", "path", "is_licence_file", *[F.col(f"extra.`{c}`") for c in extra], "own_license", "cosine",
        F.coalesce("own_license", "near.inherited").alias("license"), F.when(own, F.col("path")).otherwise(F.col("near.above")).alias("from_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as a source tree: source/lang/thousand/id, with the first of each source and language as licence file one level up."""
    first = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    named = docs.select("doc_id", "source", "lang", "text").join(first.where("first IS NOT NULL"), ["source", "lang"], "left")
    top = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    is_licence = F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False))
    path = F.when(is_licence, F.concat(top, F.lit("/LICENSE"))).otherwise(F.concat_ws("/", top, F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")))
    return named.select(F.col("doc_id").alias("file"), path.alias("path"), is_licence.alias("is_licence_file"), "text")
