"""A vocabulary that is learned over time: what a name was classified as on the day of a fact.

``learned`` has kind (drug or condition), term, class, day and seq. From its day on a row holds for its term until a
later one (by day, then seq) does; before the first one only the closed vocabulary knows the term. Rows of classes that
the closed vocabulary has not are left out, so learning never makes a class.

A drug is looked up by its name, then by its words in turn; a condition by its name, then by the longest known term
within it, of equally long ones the vocabulary's first, then by its text. At each step what is learned comes before the
vocabulary. Names are few against facts: names, and names with a day, are made distinct before anything is looked up.
What a term was on a day is read off its rows and the days asked in order, so a term's number of versions never multiplies
the rows.

Defined results: names and terms are compared as ``functions.clinical.norm`` has them; facts without a name, a day or a
known kind have no class; rows of ``learned`` without a term, a class or a day count as not there; extra columns of
facts are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import vocabulary as V
from carefold.functions import clinical as C
from carefold.operators.terms import within
from carefold.storage import materialize

DRUG, CONDITION = "drug", "condition"
CLASSES = {DRUG: sorted(V.DRUG_CLASSES), CONDITION: sorted(V.HEREDITARY)}
_KNOWN = {DRUG: V.DRUG_CLASS, CONDITION: V.FAMILY_RISK}
#: Where a whole name stands before its parts, the longest of which is at minus its length.
_WHOLE = -(1 << 30)


def _lookup(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in entries.items() for x in item]), key)


def versions(learned: DataFrame) -> DataFrame:
    """(kind, term, class, since, until): the days from and before which each class of a term held."""
    known = F.lit(False)
    for kind, names in CLASSES.items():
        known = known | ((F.col("kind") == kind) & F.col("class").isin(names))
    rows = learned.filter(known).select("kind", C.norm(F.col("term")).alias("term"), "class", "day", "seq").filter("term <> '' AND day IS NOT NULL")
    last = rows.groupBy("kind", "term", "day").agg(F.max_by("class", F.struct("seq", "class")).alias("class"))
    order = Window.partitionBy("kind", "term").orderBy("day")
    return last.select("kind", "term", "class", F.col("day").alias("since"), F.lead("day").over(order).alias("until"))


def _asked(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, name, place, term): what each distinct name may be known by, in order."""
    whole = names.select("kind", "name", F.lit(_WHOLE).alias("place"), F.col("name").alias("term"))
    words = F.posexplode(F.split(F.replace("name", F.lit("/"), F.lit(" ")), r"\s+")).alias("place", "term")
    drugs = names.filter(F.col("kind") == DRUG).select("kind", "name", words).filter("term <> ''")
    conditions = names.filter(F.col("kind") == CONDITION)
    at = (-F.length("term")).alias("place")
    fixed = F.filter(F.array(*map(F.lit, V.FAMILY_RISK)), lambda k: F.contains("name", k))
    of_vocabulary = conditions.select("kind", "name", F.explode(fixed).alias("term")).select("kind", "name", at, "term")
    of_learned = within(conditions.select(F.col("name").alias("text")), terms.filter(F.col("kind") == CONDITION).select(F.col("term").alias("part")))
    of_learned = of_learned.select(F.lit(CONDITION).alias("kind"), F.col("text").alias("name"), F.col("part").alias("term")).select("kind", "name", at, "term")
    return whole.unionByName(drugs).unionByName(of_vocabulary).unionByName(of_learned).distinct()


def _on(asked: DataFrame, of: DataFrame) -> DataFrame:
    """(kind, term, day, said): for distinct (kind, term, day) of ``asked`` the class that held of the term, if any did."""
    begins = of.select("kind", "term", F.col("since").alias("day"), "class", F.lit(False).alias("is_asked"))
    rows = begins.unionByName(asked.select("kind", "term", "day").distinct().select("*", F.lit(None).cast("string").alias("class"), F.lit(True).alias("is_asked")))
    until = Window.partitionBy("kind", "term").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("said", F.last("class", ignorenulls=True).over(until)).filter("is_asked AND said IS NOT NULL").select("kind", "term", "day", "said")


def classify_on(facts: DataFrame, learned: DataFrame) -> DataFrame:
    """``facts`` (id, kind, name, day) with class and was_learned, as of each fact's day."""
    of = versions(learned)
    named = C.norm(F.col("name"))
    keyed = materialize(facts.select("kind", named.alias("name"), "day").filter("name <> '' AND day IS NOT NULL").distinct(), "asked-names")
    asked = _asked(keyed.select("kind", "name").distinct(), of)
    met = materialize(keyed.join(asked, ["kind", "name"]), "asked-terms")
    met = met.join(_on(met, of), ["kind", "term", "day"], "left")
    known = F.coalesce(*[F.when(F.col("kind") == kind, _lookup(entries, F.col("term"))) for kind, entries in _KNOWN.items()])
    found = met.withColumn("known", known).withColumn("class", F.coalesce("said", "known")).filter("class IS NOT NULL")
    best = F.min(F.struct("place", F.col("known").isNull().alias("new"), "term", "class", F.col("said").isNotNull().alias("was_learned"))).alias("b")
    best = found.groupBy(F.col("kind").alias("of_kind"), F.col("name").alias("of_name"), F.col("day").alias("of_day")).agg(best)
    same = (facts["kind"] == best["of_kind"]) & (C.norm(facts["name"]) == best["of_name"]) & (facts["day"] == best["of_day"])
    return facts.join(best, same, "left").select(*facts.columns, F.col("b.class").alias("class"), F.coalesce("b.was_learned", F.lit(False)).alias("was_learned"))
