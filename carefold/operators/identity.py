"""Who is who: patients by name, date of birth and record number; relatives who are patients; consent.

``registry`` has patient_id, ord (its order, unique), name, dob (a date, may be null) and mrn (may be null or blank).

Every match is an equi-join with a table of the registry aggregated by its key first (one row per number, name, or
name and date), so a common name costs one row and never a list of pairs. Defined results: names are compared as
``functions.clinical.normal_name`` has them, numbers in lower case and trimmed; blank names and numbers match nothing;
of several matches the first in the registry's order is taken; extra columns of queries are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import vocabulary as V
from carefold.functions import clinical as C
from carefold.operators.terms import within
from carefold.storage import materialize

#: Birth years that a name's patients are counted by: those of people on record, and unknown.
_UNKNOWN = -1


def _first(at: str = "id") -> Column:
    return F.min_by("patient_id", "ord").alias(at)


def _keyed(registry: DataFrame) -> DataFrame:
    return registry.select("patient_id", "ord", C.normal_name(F.col("name")).alias("name_key"), "dob", C.norm(F.col("mrn")).alias("mrn_key"))


def find(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """``queries`` (name, dob, mrn) with ``found``, the patient who has the number, else one of that name.

    A patient of that name is taken if the dates of birth are equal or one of them is missing.
    """
    known = _keyed(registry)
    by_mrn = known.filter("mrn_key <> ''").groupBy("mrn_key").agg(_first("by_mrn"))
    one = F.struct("ord", "patient_id")
    by_name = known.filter("name_key <> ''").groupBy("name_key").agg(F.min(one).alias("any_of_name"), F.min(F.when(F.col("dob").isNull(), one)).alias("undated"))
    by_both = known.filter("name_key <> '' AND dob IS NOT NULL").groupBy("name_key", F.col("dob").alias("dob_key")).agg(F.min(one).alias("dated"))
    asked = queries.withColumns({"name_key": C.normal_name(F.coalesce("name", F.lit(""))), "dob_key": F.col("dob"), "mrn_key": C.norm(F.col("mrn"))})
    met = asked.join(by_mrn, "mrn_key", "left").join(by_name, "name_key", "left").join(by_both, ["name_key", "dob_key"], "left")
    named = F.when(F.col("dob").isNull(), F.col("any_of_name")).otherwise(F.least("dated", "undated"))
    return met.select(*queries.columns, F.coalesce("by_mrn", named["patient_id"]).alias("found"))


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``n``, 1, 2, ... in the given order: sorted by ranges, and each range counted before it is numbered."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranges")  # once, as another run may cut the ranges elsewhere
    ranged = ranged.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))  # one row per partition
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("part", F.coalesce(before, F.lit(0)).alias("begins"))
    return ranged.join(F.broadcast(begins), "part").withColumn("n", F.col("begins") + F.col("place") + 1).select(*rows.columns, "n")


def resolve(queries: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with patient and created, new registry rows): unknown people get charts.

    ``queries`` have query_id, name, dob, mrn. Queries without a name and a number resolve to nobody. Unknown queries
    that agree on the number, or without one on name and date of birth, are one new person. New patient_ids follow the
    registry's greatest, in the order of the first query; a missing number becomes MRN- and 900000 more than the id, a
    missing name P and the id.
    """
    asked = find(queries.select("query_id", "name", "dob", "mrn"), registry)
    known = C.norm(F.col("name")) != ""
    person = F.when(C.norm(F.col("mrn")) != "", F.concat(F.lit("mrn "), C.norm(F.col("mrn")))).otherwise(
        F.concat(F.lit("name "), C.normal_name(F.col("name")), F.lit(" "), F.coalesce(F.col("dob").cast("string"), F.lit("")))
    )
    asked = asked.withColumn("person", F.when(F.col("found").isNull() & (known | (C.norm(F.col("mrn")) != "")), person))
    people = asked.filter("person IS NOT NULL").groupBy("person").agg(F.min("query_id").alias("first"), F.min_by(F.struct("name", "dob", "mrn"), "query_id").alias("r"))
    top = registry.agg(F.coalesce(F.max("patient_id"), F.lit(0)).alias("top_id"), F.coalesce(F.max("ord"), F.lit(0)).alias("top_ord"))
    new = numbered(people, "first").crossJoin(F.broadcast(top))  # one row
    new = new.withColumn("patient_id", F.col("top_id") + F.col("n"))
    number = F.coalesce(F.nullif(F.trim("r.mrn"), F.lit("")), F.concat(F.lit("MRN-"), (F.col("patient_id") + 900000).cast("string")))
    rows = new.select("patient_id", (F.col("top_ord") + F.col("n")).alias("ord"), F.coalesce(F.nullif(F.trim("r.name"), F.lit("")), F.format_string("P%03d", "patient_id")).alias("name"), "r.dob", number.alias("mrn"))
    out = asked.join(new.select("person", "patient_id"), "person", "left")
    return out.select("query_id", F.coalesce("found", "patient_id").alias("patient"), F.col("patient_id").isNotNull().alias("created")), rows


def chart_of(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """``documents`` (query_id, hint, ref, name, dob, mrn) with patient and created.

    A hint that is a patient comes first, then a reference that is one, then name or number, found or created, and
    last the reference as it stands. Without any of them there is no patient.
    """
    known = registry.select(F.col("patient_id").alias("id"))
    hints, refs = known.select(F.col("id").alias("hint"), F.lit(True).alias("hint_known")), known.select(F.col("id").alias("ref"), F.lit(True).alias("ref_known"))
    met = documents.join(hints, "hint", "left").join(refs, "ref", "left")
    found, _ = resolve(documents.select("query_id", "name", "dob", "mrn"), registry)
    met = met.join(found, "query_id", "left")
    direct = F.when(F.col("hint_known"), F.col("hint")).when(F.col("ref_known"), F.col("ref"))
    return met.select(
        *documents.columns, F.coalesce(direct, F.col("patient"), F.col("ref")).alias("chart"), (direct.isNull() & F.coalesce("created", F.lit(False))).alias("created")
    )


def relatives(facts: DataFrame) -> DataFrame:
    """(fact_id, patient_id, valid_from, relation, name, dob, mrn): first-degree relatives with a name or a number."""
    relation = C.norm(F.col("relation"))
    named = (C.norm(F.col("relative_name")) != "") | (C.norm(F.col("relative_mrn")) != "")
    rows = facts.filter((F.col("resource_type") == "FamilyHistory") & (F.col("status") != "retracted") & C.is_first_degree(relation) & named)
    return rows.select(F.col("id").alias("fact_id"), "patient_id", "valid_from", relation.alias("relation"), F.col("relative_name").alias("name"), F.col("relative_dob").alias("dob"), F.col("relative_mrn").alias("mrn"))


def match_relatives(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """``mentions`` (as ``relatives`` gives them) with relative_id and confidence, those that match a patient.

    The record number decides, then name and date of birth (both high). Else patients of the name whose birth year
    is impossible for the relation are dropped; those it confirms come before those without a year, then the
    registry's order. It is high for a single one that is confirmed and has the patient's surname, else medium.
    The patient is never a relative. A name's patients are counted by birth year, so a mention meets a bounded number
    of rows however common the name is.
    """
    known = _keyed(registry)
    two = F.slice(F.sort_array(F.collect_set(F.struct("ord", "patient_id"))), 1, 2)  # the first, and the next if that is the patient
    firsts = F.transform(two, lambda x: x["patient_id"])
    order = Window.partitionBy("key").orderBy("ord")

    def first_two(key: Column, name: str) -> DataFrame:
        rows = known.withColumn("key", key).filter("key IS NOT NULL").withColumn("nth", F.row_number().over(order)).filter("nth <= 2")
        return rows.groupBy("key").agg(firsts.alias(name)).withColumnRenamed("key", f"{name}_key")

    dated = lambda name, dob: F.when((name != "") & dob.isNotNull(), F.concat(name, F.lit(" "), dob.cast("string")))
    by_mrn = first_two(F.nullif("mrn_key", F.lit("")), "mrn_of")
    by_dob = first_two(dated(F.col("name_key"), F.col("dob")), "dob_of")
    year = F.coalesce(F.year("dob"), F.lit(_UNKNOWN))
    by_year = known.filter("name_key <> ''").groupBy("name_key", year.alias("year")).agg(F.count("*").alias("n"), F.min(F.struct("ord", "patient_id")).alias("one"))
    per = Window.partitionBy("name_key", "year").orderBy("ord")
    nexts = known.filter("name_key <> ''").withColumn("year", year).withColumn("nth", F.row_number().over(per)).filter("nth = 2")
    by_year = by_year.join(nexts.select("name_key", "year", F.struct("ord", "patient_id").alias("two")), ["name_key", "year"], "left")

    own = registry.select("patient_id", C.normal_name(F.col("name")).alias("own_name"), F.year("dob").alias("own_year"))
    name = C.normal_name(F.coalesce("name", F.lit("")))
    asked = mentions.join(own, "patient_id").withColumn("name_key", name)
    asked = asked.withColumns({"mrn_of_key": F.nullif(C.norm(F.col("mrn")), F.lit("")), "dob_of_key": dated(name, F.col("dob"))})
    met = asked.join(by_mrn, "mrn_of_key", "left").join(by_dob, "dob_of_key", "left")
    other = lambda ids: F.get(F.filter(ids, lambda x: x != F.col("patient_id")), F.lit(0))
    met = met.withColumn("sure", F.coalesce(other(F.col("mrn_of")), other(F.col("dob_of"))))

    rows = met.filter("sure IS NULL AND name_key <> ''").join(by_year, "name_key")
    is_self = (F.col("own_name") == F.col("name_key")) & (F.coalesce("own_year", F.lit(_UNKNOWN)) == F.col("year"))
    fits = C.generation_plausible(F.col("relation"), F.col("own_year"), F.nullif("year", F.lit(_UNKNOWN)))
    rows = rows.select(
        "fact_id", F.coalesce(fits, F.lit(False)).alias("confirmed"), (F.col("n") - is_self.cast("int")).alias("n"),
        F.when(F.col("one.patient_id") == F.col("patient_id"), F.col("two")).otherwise(F.col("one")).alias("one"), fits.alias("fits"),
        (C.surname(F.col("own_name")) == C.surname(F.col("name_key"))).alias("same_surname"),
    ).filter("n > 0 AND coalesce(fits, true)")
    best = rows.groupBy("fact_id").agg(
        F.max("confirmed").alias("confirmed"), F.sum(F.when(F.col("confirmed"), F.col("n")).otherwise(0)).alias("n_confirmed"),
        F.min(F.when(F.col("confirmed"), F.col("one"))).alias("of_confirmed"), F.min("one").alias("of_any"), F.first("same_surname").alias("same_surname"),
    )
    guess = F.when(F.col("confirmed"), F.col("of_confirmed")).otherwise(F.col("of_any"))["patient_id"]
    certain = F.col("confirmed") & (F.col("n_confirmed") == 1) & F.col("same_surname")
    best = best.select("fact_id", guess.alias("guess"), F.when(certain, "high").otherwise("medium").alias("guessed"))
    return met.join(best, "fact_id", "left").select(
        *mentions.columns, F.coalesce("sure", "guess").alias("relative_id"), F.when(F.col("sure").isNotNull(), "high").otherwise(F.col("guessed")).alias("confidence")
    ).filter("relative_id IS NOT NULL")


def links(matched: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(patient_id, relative_id, relation, confidence, consent, proposed, ord): both directions of each match.

    Of several edges between two patients in one direction the first stays, by the mention's (valid_from, fact_id), and
    an edge in ``existing`` is never changed. High confidence gives consent, any other a proposal.
    """
    inverse = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for e in V.INVERSE.items() for x in e]), F.col("relation")), F.lit("relative"))
    ways = F.array(
        F.struct(F.col("patient_id").alias("a"), F.col("relative_id").alias("b"), F.col("relation").alias("r"), F.lit(0).alias("way")),
        F.struct(F.col("relative_id").alias("a"), F.col("patient_id").alias("b"), inverse.alias("r"), F.lit(1).alias("way")),
    )
    edges = matched.select("valid_from", "fact_id", "confidence", F.explode(ways).alias("e"))
    first = F.min(F.struct("valid_from", "fact_id", "e.way", "e.r", "confidence")).alias("x")
    edges = edges.groupBy(F.col("e.a").alias("patient_id"), F.col("e.b").alias("relative_id")).agg(first)
    high = F.col("x.confidence") == "high"
    out = edges.select(
        "patient_id", "relative_id", F.col("x.r").alias("relation"), F.col("x.confidence").alias("confidence"), high.alias("consent"), (~high).alias("proposed"),
        (F.col("x.fact_id") * 2 + F.col("x.way")).alias("ord"),
    )
    if existing is None:
        return out
    new = out.join(existing, ["patient_id", "relative_id"], "left_anti")
    return existing.unionByName(new)


def set_consent(of: DataFrame, changes: DataFrame) -> DataFrame:
    """``of`` (links) with the consent of ``changes`` (a, b, consent, seq) on both directions of a pair; the last counts.

    What was proposed stays so."""
    pair = lambda a, b: [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]
    last = changes.select(*pair("a", "b"), "seq", F.col("consent").alias("said")).groupBy("low", "high").agg(F.max_by("said", "seq").alias("said"))
    keyed = of.select("*", *pair("patient_id", "relative_id"))
    return keyed.join(last, ["low", "high"], "left").withColumn("consent", F.coalesce("said", "consent")).select(*of.columns)


def family_members(of: DataFrame, registry: DataFrame) -> DataFrame:
    """(patient_id, name, mrn, parent_mrn): a node for each record number with links, made from its first link; the
    parent is the relative if that link says child."""
    first = of.groupBy("patient_id").agg(F.min_by(F.struct("relative_id", "relation"), "ord").alias("l"), F.min("ord").alias("at"))
    people = registry.select("patient_id", "name", "mrn")
    parents = registry.select(F.col("patient_id").alias("parent_id"), F.col("mrn").alias("parent_mrn"))
    parent = F.when(F.col("l.relation") == "child", F.col("l.relative_id"))
    rows = first.join(people, "patient_id").withColumn("parent_id", parent).join(parents, "parent_id", "left")
    per = Window.partitionBy("mrn").orderBy("at", "patient_id")
    return rows.withColumn("nth", F.row_number().over(per)).filter("nth = 1").select("patient_id", "name", "mrn", "parent_mrn")


#: Who may see whom: (doctor_id, ward) and (patient_id, ward), where a doctor may see all patients of the own wards.
Wards = tuple[DataFrame, DataFrame]


def _wards(access: DataFrame | Wards) -> Wards:
    """A table of (doctor_id, patient_id) is the case in which every patient is a ward."""
    if isinstance(access, tuple):
        doctors, patients = access
    else:
        doctors, patients = access.select("doctor_id", F.col("patient_id").alias("ward")), access.select("patient_id", F.col("patient_id").alias("ward"))
    return doctors.select("doctor_id", "ward").na.drop().distinct(), patients.select("patient_id", "ward").na.drop()


def _placed(patients: DataFrame) -> DataFrame:
    """(patient_id, wards): all wards of a patient, sorted, so that patients of the same wards are counted as one."""
    return patients.groupBy("patient_id").agg(F.sort_array(F.collect_set("ward")).alias("wards"))


def _visible(asked: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, n, first, last): ``asked`` has ``by`` and a ward in each row, ``counted`` wards, ward, n, first and last; a
    set of wards that is met by several of them counts once."""
    keys = [c for c in asked.columns if c in counted.columns]
    once = asked.join(counted, keys).select(*by, "wards", "n", "first", "last").distinct()
    return once.groupBy(*by).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


_COUNTS = (F.count, "n"), (F.min, "first"), (F.max, "last")


def _counted(placed: DataFrame, *more: str) -> DataFrame:
    of = placed.groupBy(*more, "wards").agg(*[f("patient_id").alias(name) for f, name in _COUNTS])
    return of.withColumn("ward", F.explode("wards"))


def scopes(access: DataFrame | Wards) -> DataFrame:
    """(doctor_id, patients, first, last): how many patients a doctor may see; doctors without any have no row.

    Patients are counted by their wards before they meet doctors, so pairs of them are never made.
    """
    doctors, patients = _wards(access)
    return _visible(doctors, _counted(_placed(patients)), ["doctor_id"]).withColumnRenamed("n", "patients")


def gate(requests: DataFrame, access: DataFrame | Wards) -> DataFrame:
    """``requests`` (doctor_id, patient_id and any columns) with ``allowed``: whether the doctor may see the patient.

    A request meets its patient's wards; what doctors ask for then is looked up once for each doctor and set of wards.
    """
    doctors, patients = _wards(access)
    met = materialize(requests.join(_placed(patients), "patient_id", "left"), "requests")
    pairs = met.select("doctor_id", "wards").filter("wards IS NOT NULL").distinct()
    open_to = pairs.withColumn("ward", F.explode("wards")).join(doctors, ["doctor_id", "ward"]).select("doctor_id", "wards").distinct()
    return met.join(open_to.withColumn("allowed", F.lit(True)), ["doctor_id", "wards"], "left").select(*requests.columns, F.coalesce("allowed", F.lit(False)).alias("allowed"))


def search(queries: DataFrame, registry: DataFrame, access: DataFrame | Wards) -> DataFrame:
    """(doctor_id, query, candidates, resolved): patients whom a doctor may see by a part of the name or number, or the id.

    Distinct texts of queries are looked up in an index of grams over distinct names and numbers (``terms.within``); what
    they hit is counted by wards, and these counts meet the doctors' wards: equi-joins throughout, and no pairs of
    doctors and patients. One candidate is resolved; queries without any have no candidates, an empty query has all of
    the doctor's patients, and a null one none.
    """
    doctors, patients = _wards(access)
    said = queries.select("doctor_id", "query", C.norm(F.col("query")).alias("q")).filter("query IS NOT NULL").distinct()
    texts = registry.select("patient_id", F.explode(F.array(F.lower("name"), F.lower("mrn"))).alias("text"))
    found = within(texts.select("text"), said.select(F.col("q").alias("part")))
    by_part = texts.join(found, "text").select("patient_id", F.col("part").alias("q"))
    by_id = registry.select("patient_id", F.col("patient_id").cast("string").alias("q")).join(said.select("q").distinct(), "q").select("patient_id", "q")
    placed = _placed(patients)
    hits = by_part.unionByName(by_id).distinct().join(placed, "patient_id")
    mine = said.join(doctors, "doctor_id")
    some = _visible(mine.filter("q <> ''"), _counted(hits, "q"), ["doctor_id", "query"])
    own = placed.join(registry.select("patient_id").distinct(), "patient_id", "left_semi")
    every = _visible(mine.filter("q = ''").drop("q"), _counted(own), ["doctor_id", "query"])
    counted = some.unionByName(every).select("doctor_id", "query", "n", "first")
    return queries.join(counted, ["doctor_id", "query"], "left").select(
        "doctor_id", "query", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"), F.when(F.col("n") == 1, F.col("first")).alias("resolved")
    )
