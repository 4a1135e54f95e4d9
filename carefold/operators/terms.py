"""Names that are nearly those of a vocabulary: an approximate join on bounded edit distance.

Two names are near if their edit distance is at most a FAR-th of the longer one's length. Method: each name is cut into
numbered 2-grams (with a mark at both ends); names that are near share all of them but GRAM for each edit, so of one
order of all grams the first ``GRAM * edits + 1`` of either name must have one in common. Only those meet in the join,
and what meets is compared by length and then by the distance itself. The order is that of the grams' hashes, so no
count of grams is needed; terms and names are distinct before they meet, so a common term costs one row.

Defined results: names are compared as ``functions.clinical.norm`` has them; blank ones are near nothing; of several
near names the one at the least distance is taken, then the first by its text; an empty vocabulary finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.functions import clinical as C
from carefold.operators.evidence import grounding_candidates
from carefold.storage import materialize

GRAM = 2
#: Characters of a name for each edit.
FAR = 5


def edits(longer: Column) -> Column:
    """The most edits between names of which the longer one has so many characters."""
    return F.floor(longer / FAR).cast("int")


def prefix(name: Column) -> Column:
    """The grams of a name of which any near name has one among its own; a near name may be longer by a fourth."""
    marked = F.concat(F.lit("\u0001"), name, F.lit("\u0002"))
    at = F.sequence(F.lit(1), F.length(name) + 1)
    grams = F.transform(at, lambda i: F.substr(marked, i, F.lit(GRAM)))
    # The second time that a gram is met it is another one.
    numbered = F.transform(grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g))))
    most = F.floor(F.length(name) / (FAR - 1)).cast("int")
    return F.slice(F.sort_array(numbered), F.lit(1), GRAM * most + 1)


def close(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name, distance): for each distinct ``term`` of terms the nearest ``name`` of names, if there is a near one."""
    left = terms.select(C.norm(F.col("term")).alias("term")).filter("term <> ''").distinct()
    right = names.select(C.norm(F.col("name")).alias("name")).filter("name <> ''").distinct()
    met = left.withColumn("gram", F.explode(prefix(F.col("term")))).join(right.withColumn("gram", F.explode(prefix(F.col("name")))), "gram")
    longer = F.greatest(F.length("term"), F.length("name"))
    fits = F.abs(F.length("term") - F.length("name")) <= edits(longer)
    pairs = met.filter(fits).select("term", "name").distinct()
    near = pairs.withColumn("distance", F.levenshtein("term", "name")).filter(F.col("distance") <= edits(longer))
    return near.groupBy("term").agg(F.min(F.struct("distance", "name")).alias("n")).select("term", "n.name", "n.distance")


def ground(facts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, grounded, name, distance): whether what a fact may be called is near a name, and the nearest one; ``grounded``
    is null where it may be called nothing. Of several candidates the nearest counts, then the first.

    Lists of candidates are made distinct and judged once each, so facts are neither exploded nor sorted.
    """
    asked = facts.select("id", grounding_candidates().alias("said"))
    lists = materialize(asked.select("said").filter(F.size("said") > 0).distinct(), "candidates")
    each = lists.select("said", F.posexplode("said").alias("place", "one")).withColumn("term", C.norm(F.col("one")))
    found = each.join(close(each.select("term"), names), "term")
    best = found.groupBy("said").agg(F.min(F.struct("distance", "place", "name")).alias("b"))
    named = F.size(F.array_compact("said")) > 0
    return asked.join(best, "said", "left").select("id", F.when(named, F.col("b").isNotNull()).alias("grounded"), "b.name", "b.distance")


#: Characters of a text by which a part of it is found.
LONGEST = 3


def within(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, part): every distinct ``part`` of parts with each distinct ``text`` of texts that contains it.

    An index of grams: a text is listed under each of its grams of LONGEST characters, a part is looked up by one of its
    own, that of the least hash, and what meets is verified. Parts of fewer characters are looked up as a whole, among
    grams of their length. Empty parts and nulls are contained in nothing.
    """
    asked = parts.select("part").filter("part <> ''").distinct()
    size = F.least(F.length("part"), F.lit(LONGEST))

    def grams_of(text: str, n: Column) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))
        return F.when(F.length(text) >= n, all_of).otherwise(F.array().cast("array<string>"))

    key = F.array_min(F.transform(grams_of("part", size), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("gram"))))["gram"]
    grams = F.concat(*[grams_of("text", F.lit(n)) for n in range(1, LONGEST + 1)])
    listed = texts.select("text").filter("text <> ''").distinct().select("text", F.explode(F.array_distinct(grams)).alias("gram"))
    return listed.join(asked.withColumn("gram", key), "gram").filter(F.col("text").contains(F.col("part"))).select("text", "part")
