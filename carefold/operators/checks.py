"""Safety checks over charts: cards about drugs and allergies, trends and gaps, family risk.

``facts`` are charts of all patients: id, patient_id, valid_from, resource_type, subject, predicate, value, status, and
the attributes analyte, reading (a number), abnormal_flag, drug, substance, reaction, severity, condition, relation,
age_at_onset, factor. A card is a row of CARD; (check_ord, ord1, ord2, ord3) is its place among cards of equal severity.

Joins are on the patient and one key more, so no two long lists of a patient meet in all pairs. Defined results:
texts of attributes are compared in lower case and trimmed; blank attributes count as missing; facts of one day
are ordered by id; retracted facts count nowhere; a chart without findings has no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import vocabulary as V
from carefold.functions import clinical as C

CARD = ("patient_id", "check_id", "indicator", "summary", "detail", "evidence", "check_ord", "ord1", "ord2", "ord3", "suggestions")


def _first_day() -> Column:
    return F.to_date(F.lit("0001-01-01"))


def _card(rows: DataFrame, **columns: Column | str | int) -> DataFrame:
    made = {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    made.setdefault("ord3", F.lit(0).cast("long"))
    return rows.select("patient_id", *[made[c].alias(c) for c in CARD[1:]])


def _filled(text: str, *values: Column) -> Column:
    """The text with the values, in turn, in place of its braces."""
    parts = text.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, part in zip(values, parts[1:], strict=True) for x in (v, F.lit(part))])


def _suggest(kind: str, *values: Column) -> Column:
    """What a kind of card suggests; the values are for its first text."""
    first, *others = V.SUGGESTIONS[kind]
    return F.array(_filled(first, *values), *map(F.lit, others))


def is_abnormal(flag: Column) -> Column:
    return C.norm(flag).isin(V.ABNORMAL)


def active_allergies(facts: DataFrame) -> DataFrame:
    """(patient_id, allergy_id, allergy_from, substance, reaction, severity); a cleared allergy is none."""
    substance = F.trim(C.filled(F.col("substance"), F.col("drug"), F.col("value")))
    found = facts.filter((F.col("resource_type") == "Allergy") & (F.col("status") == "active") & (C.norm(F.col("predicate")) != "cleared"))
    return found.select("patient_id", F.col("id").alias("allergy_id"), F.col("valid_from").alias("allergy_from"), substance.alias("substance"), "reaction", "severity").filter("substance <> ''")


def _reacts_with(drug: Column, is_allergy: bool) -> Column:
    """Keys of which two drugs that must not meet share one: class, group, or the substance as a word of the drug."""
    name, of_class = C.norm(drug), C.drug_class(drug)
    words = F.array(name) if is_allergy else F.split(F.replace(name, F.lit("/"), F.lit(" ")), r"\s+")
    classes = F.array(F.concat(F.lit("class "), of_class), F.concat(F.lit("group "), C.drug_group(of_class)))
    return F.array_distinct(F.array_compact(F.concat(classes, F.transform(words, lambda w: F.concat(F.lit("word "), w)))))


def conflicts(drugs: DataFrame, allergies: DataFrame) -> DataFrame:
    """``drugs`` (patient_id, drug and any columns) with each active allergy that forbids it; equi-joined on the keys.

    Both sides meet in a shuffle: each is many times what its table's size lets Spark expect, so neither may be broadcast.
    """
    own = [c for c in drugs.columns if c != "patient_id"]
    left = drugs.withColumn("key", F.explode(_reacts_with(F.col("drug"), False)))
    right = allergies.withColumn("key", F.explode(_reacts_with(F.col("substance"), True)))
    return left.join(right.hint("merge"), ["patient_id", "key"]).select("patient_id", *own, *allergies.columns[1:]).distinct()


def _conflict_cards(found: DataFrame, summary: Column, ord1: Column, ord2: Column, ord3: Column) -> DataFrame:
    name, of_class = F.element_at(F.split("drug", r"\s+"), 1), C.drug_class(F.col("drug"))
    detail = F.concat(
        C.title(name),
        F.when(of_class.isNotNull(), F.concat(F.lit(" is a "), of_class)).otherwise(""),
        F.when(C.drug_group(of_class) == "beta_lactam", " (beta-lactam class)").otherwise(""),
        F.lit("; the patient has a documented "), F.col("substance"), F.lit(" allergy"),
        F.coalesce(F.concat(F.lit("; prior reaction: "), F.nullif("reaction", F.lit(""))), F.lit("")),
        F.coalesce(F.concat(F.lit(" (severity: "), F.nullif("severity", F.lit("")), F.lit(")")), F.lit("")),
        F.lit("."),
    )
    agents = F.replace(F.coalesce(C.drug_group(of_class), of_class, F.lit("related")), F.lit("_"), F.lit(" "))
    suggestions = _suggest("allergy", name, agents)
    return _card(found, check_id="allergy", indicator="critical", summary=summary, detail=detail, evidence=F.array("allergy_id"), check_ord=0, ord1=ord1, ord2=ord2, ord3=ord3, suggestions=suggestions)


def allergy_cards(facts: DataFrame) -> DataFrame:
    """Active medications that an active allergy forbids, whichever came first."""
    drug = F.trim(C.filled(F.col("drug"), F.col("value")))
    taken = facts.filter("resource_type = 'Medication' AND status = 'active'").select("patient_id", drug.alias("drug"), "id", "valid_from").filter("drug <> ''")
    found = conflicts(taken, active_allergies(facts))
    summary = F.concat(F.lit("Active medication "), F.element_at(F.split("drug", r"\s+"), 1), F.lit(" conflicts with "), F.col("substance"), F.lit(" allergy"))
    return _conflict_cards(found, summary, F.col("valid_from"), F.col("id"), F.col("allergy_id"))


def _distinct(orders: DataFrame) -> DataFrame:
    """(patient_id, drug), dealt out first: orders made of a small file would all be held by one task."""
    return orders.select("patient_id", "drug").repartition("patient_id", "drug").distinct()


def prescribe_cards(orders: DataFrame, facts: DataFrame) -> DataFrame:
    """Cards for drugs about to be ordered: ``orders`` has patient_id and drug, which the cards keep. Nothing is written."""
    found = conflicts(_distinct(orders), active_allergies(facts))
    summary = F.concat(F.lit("Do not prescribe "), F.element_at(F.split("drug", r"\s+"), 1), F.lit(" — "), F.col("substance"), F.lit(" allergy"))
    keyed = found.withColumn("patient_id", F.struct("patient_id", "drug"))
    cards = _conflict_cards(keyed, summary, F.col("allergy_from"), F.col("allergy_id"), F.lit(0).cast("long"))
    return cards.select("patient_id.*", *CARD[1:])


def prescribe_screen(orders: DataFrame, facts: DataFrame) -> DataFrame:
    """(patient_id, drug, verdict, cards): critical or clear for every order, with the number of cards."""
    cards = prescribe_cards(orders, facts).groupBy("patient_id", "drug").agg(F.count("*").alias("cards"))
    return _distinct(orders).join(cards, ["patient_id", "drug"], "left").select(
        "patient_id", "drug", F.when(F.col("cards") > 0, "critical").otherwise("clear").alias("verdict"), F.coalesce("cards", F.lit(0)).cast("long").alias("cards")
    )


def prescribe_top(orders: DataFrame, facts: DataFrame, limit: int = 5) -> DataFrame:
    """The first ``limit`` cards of each order (patient_id, drug), with their place from 1."""
    return top_cards(prescribe_cards(orders, facts), limit, ("patient_id", "drug"))


def order_texts(orders: DataFrame, facts: DataFrame) -> DataFrame:
    """(patient_id, drug, text): what is said of each order before anything is ordered, its first cards in their order or
    that nothing was found."""
    line = F.concat(F.lit("- ["), F.upper("indicator"), F.lit("] "), F.col("summary"), F.lit(": "), F.col("detail"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    told = prescribe_top(orders, facts).groupBy("patient_id", "drug").agg(lines.alias("lines"))  # five cards at most
    found, none = F.concat(F.lit(f"{V.ORDER_FINDINGS}\n"), F.col("lines")), _filled(V.ORDER_CLEAR, F.col("drug"))
    return _distinct(orders).join(told, ["patient_id", "drug"], "left").select("patient_id", "drug", F.coalesce(found, none).alias("text"))


def lab_series(facts: DataFrame, today: Column) -> DataFrame:
    """(patient_id, analyte, ...): what trends and gaps are told from, one aggregation over laboratory results."""
    labs = facts.filter("resource_type = 'LabResult' AND status <> 'retracted'")
    labs = labs.select("patient_id", C.norm(F.col("analyte")).alias("analyte"), "id", "valid_from", "value", "reading", C.norm(F.col("abnormal_flag")).alias("flag")).filter("analyte <> ''")
    at, bad = F.struct("valid_from", "id"), F.col("flag").isin(V.ABNORMAL)
    valued = bad & F.col("reading").isNotNull()
    point = F.struct("valid_from", "id", "reading")
    series = labs.groupBy("patient_id", "analyte").agg(
        F.min(at).alias("seen"),
        F.max("valid_from").alias("last_lab"),
        F.max_by(F.struct("valid_from", "id", "value", "reading", "flag"), F.when(bad, at)).alias("latest"),
        F.sort_array(F.collect_list(F.when(valued, point))).alias("points"),
    )
    first, last = F.element_at("points", 1)["reading"], F.element_at("points", -1)["reading"]
    several = F.size("points") >= 2
    rising = F.when(several & (first != last), last > first)
    return series.filter("latest IS NOT NULL").select(
        "*", rising.alias("rising"), F.coalesce(rising == F.col("analyte").isin(V.RISING_BAD), F.lit(False)).alias("worsens"),
        F.datediff(today, F.col("latest.valid_from")).alias("age"),
    )


def trend_cards(series: DataFrame) -> DataFrame:
    """Abnormal readings that move the wrong way: the first and the last of them differ so."""
    name, way = F.upper("analyte"), F.when(F.col("rising"), "rising").otherwise("falling")
    moved = F.array_join(F.transform("points", lambda p: C.number_text(p["reading"])), " → ")
    span = F.concat(F.element_at("points", 1)["valid_from"].cast("string"), F.lit(" → "), F.element_at("points", -1)["valid_from"].cast("string"))
    return _card(
        series.filter("worsens"),
        check_id=F.concat(F.lit("followup_gap:trend:"), F.col("analyte")), indicator="warning", summary=F.concat(name, F.lit(" "), way, F.lit(": "), moved),
        detail=F.concat(name, F.lit(" moved "), moved, F.lit(" ("), span, F.lit(") — trending the wrong way despite prior results.")),
        evidence=F.transform("points", lambda p: p["id"]), check_ord=1, ord1=F.col("seen.valid_from"), ord2=F.col("seen.id"),
        suggestions=_suggest("trend", name),
    )


def followup_evidence(facts: DataFrame) -> DataFrame:
    """(patient_id, at, said): procedures, conditions and notes that may follow up a result."""
    noted = F.col("resource_type").isin("Procedure", "Condition") | F.lower("subject").isin(V.NOTES)
    return facts.filter((F.col("status") != "retracted") & noted).select(
        "patient_id", F.col("valid_from").alias("at"), F.lower(F.concat_ws(" ", "value", "condition")).alias("said")
    )


def _speaks_of(said: Column, analyte: Column) -> Column:
    out = said.contains(analyte)
    for name, words in V.FOLLOWUP.items():
        out = F.when(analyte == name, said.rlike("|".join(words))).otherwise(out)
    return out


def gap_cards(series: DataFrame, facts: DataFrame) -> DataFrame:
    """The latest abnormal result, GAP_DAYS old or older, that nothing later follows up; facts after today count, too."""
    open_ = series.filter(~F.col("worsens") & ~F.col("analyte").isin(V.RISK_FACTORS) & (F.col("age") >= V.GAP_DAYS) & (F.col("last_lab") <= F.col("latest.valid_from")))
    said = followup_evidence(facts)
    later = (open_["patient_id"] == said["patient_id"]) & (said["at"] > open_["latest.valid_from"]) & _speaks_of(said["said"], open_["analyte"])
    name, shown = F.upper("analyte"), F.coalesce(C.number_text(F.col("latest.reading")), F.col("latest.value"))
    return _card(
        open_.join(said, later, "left_anti"),
        check_id=F.concat(F.lit("followup_gap:gap:"), F.col("analyte")), indicator="warning",
        summary=F.concat(F.lit("Abnormal "), name, F.lit(" ("), shown, F.lit(") with no follow-up")),
        detail=F.concat(name, F.lit(" was "), shown, F.lit(" ("), F.col("latest.flag"), F.lit(") on "), F.col("latest.valid_from").cast("string"), F.lit(" with no subsequent lab, note, or referral on record.")),
        evidence=F.array("latest.id"), check_ord=1, ord1=F.col("seen.valid_from"), ord2=F.col("seen.id"),
        suggestions=_suggest("gap", name),
    )


def own_factors(facts: DataFrame) -> DataFrame:
    """(patient_id, id, valid_from, label): smoking and high LDL of the patient."""
    habits = C.norm(F.concat_ws(" ", F.coalesce("factor", F.lit("")), F.coalesce("value", F.lit(""))))
    smokes = (F.col("resource_type") == "Lifestyle") & habits.contains("smok") & ~habits.contains("non-smok") & ~habits.contains("never")
    ldl = (F.col("resource_type") == "LabResult") & (C.norm(F.col("analyte")) == "ldl") & C.norm(F.col("abnormal_flag")).isin("high", "abnormal", "critical")
    named = F.when(smokes, "current smoker").when(ldl, F.concat(F.lit("elevated LDL"), F.coalesce(F.concat(F.lit(" "), C.number_text(F.col("reading"))), F.lit(""))))
    return facts.filter("status <> 'retracted'").select("patient_id", "id", "valid_from", named.alias("label")).filter("label IS NOT NULL")


def family_risks(facts: DataFrame) -> DataFrame:
    """(patient_id, id, valid_from, category, early, described): first-degree relatives with a heritable condition."""
    condition = C.filled(F.col("condition"), F.col("value"))
    described = F.concat(
        C.title(C.filled(F.col("relation"), F.lit("relative"))), F.lit(" had "), condition, F.coalesce(F.concat(F.lit(" at age "), F.nullif(F.col("age_at_onset"), F.lit(0)).cast("string")), F.lit(""))
    )
    family = facts.filter((F.col("resource_type") == "FamilyHistory") & (F.col("status") != "retracted") & C.is_first_degree(F.col("relation")))
    early = F.coalesce(F.col("age_at_onset") < V.EARLY_ONSET, F.lit(False))
    return family.select("patient_id", "id", "valid_from", C.family_risk(condition).alias("category"), early.alias("early"), described.alias("described")).filter("category IS NOT NULL")


def _screening() -> Column:
    return _suggest("hereditary", F.col("category"))


def risk_cards(facts: DataFrame) -> DataFrame:
    """Early heart disease in the family together with an own factor; and each relative with another heritable condition."""
    family, at = family_risks(facts), F.struct("valid_from", "id")
    relative = family.filter("category = 'cardiovascular' AND early").groupBy("patient_id").agg(F.min_by(F.struct("id", "described"), at).alias("relative"))
    factors = own_factors(facts).groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("valid_from", "id", "label"))).alias("factors"))
    heart = _card(
        relative.join(factors, "patient_id"),
        check_id="combined_risk:cardiovascular", indicator="warning", summary="Elevated cardiovascular risk — family history plus active risk factors",
        detail=F.concat(F.col("relative.described"), F.lit(", combined with "), F.array_join(F.transform("factors", lambda f: f["label"]), ", "), F.lit(", raises this patient's cardiovascular risk.")),
        evidence=F.concat(F.array("relative.id"), F.transform("factors", lambda f: f["id"])), check_ord=2, ord1=_first_day(), ord2=F.lit(0).cast("long"),
        suggestions=_suggest("heart"),
    )
    other = _card(
        family.filter("category <> 'cardiovascular'"),
        check_id=F.concat(F.lit("combined_risk:"), F.col("category")), indicator="warning",
        summary=F.concat(F.lit("Hereditary "), F.col("category"), F.lit(" risk — first-degree family history")),
        detail=F.concat(F.col("described"), F.lit(", conferring a hereditary "), F.col("category"), F.lit(" risk.")),
        evidence=F.array("id"), check_ord=2, ord1=F.col("valid_from"), ord2=F.col("id"), suggestions=_screening(),
    )
    return heart.unionByName(other)


def hereditary_cards(links: DataFrame, facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Heritable conditions on linked relatives' own charts: one card per link.

    ``links`` (patient_id, relative_id, relation, consent, ord), ``registry`` (patient_id, name). Without consent a card
    names neither the relative nor the condition, only the category.
    """
    condition = C.filled(F.col("condition"), F.col("value"))
    has = facts.filter("resource_type = 'Condition' AND status = 'active'").select(F.col("patient_id").alias("relative_id"), "valid_from", "id", condition.alias("condition"), C.family_risk(condition).alias("category"))
    has = has.filter("category IS NOT NULL").groupBy("relative_id").agg(F.min_by("category", F.struct("valid_from", "id")).alias("category"), F.array_join(F.sort_array(F.collect_set("condition")), ", ").alias("conditions"))
    names = registry.select(F.col("patient_id").alias("relative_id"), "name")
    found = links.join(has, "relative_id").join(names, "relative_id", "left").withColumn("name", F.coalesce("name", F.col("relative_id").cast("string")))
    told = F.concat(F.lit("This patient's "), F.col("relation"), F.lit(" — a linked patient ("), F.col("name"), F.lit(") — has "), F.col("conditions"), F.lit(", conferring a hereditary "), F.col("category"), F.lit(" risk."))
    hidden = F.concat(F.lit("A first-degree relative in the system has a heritable "), F.col("category"), F.lit(" condition. Enable family-record consent to see details."))
    return _card(
        found, check_id=F.concat(F.lit("hereditary:"), F.col("category")), indicator="warning",
        summary=F.concat(F.lit("Hereditary "), F.col("category"), F.lit(" risk — from a linked relative's record")), detail=F.when(F.col("consent"), told).otherwise(hidden),
        evidence=F.array().cast("array<bigint>"), check_ord=3, ord1=_first_day(), ord2=F.col("ord"), ord3=F.col("relative_id"), suggestions=_screening(),
    )


def open_cards(facts: DataFrame, links: DataFrame, registry: DataFrame, today: Column) -> DataFrame:
    """All cards of a chart."""
    series = lab_series(facts, today)
    parts = [allergy_cards(facts), trend_cards(series), gap_cards(series, facts), risk_cards(facts), hereditary_cards(links, facts, registry)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def severity(indicator: Column) -> Column:
    out = F.lit(len(V.SEVERITY))
    for name, rank in V.SEVERITY.items():
        out = F.when(indicator == name, rank).otherwise(out)
    return out


def top_cards(cards: DataFrame, limit: int = 5, by: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """The first ``limit`` cards of each patient (or whatever ``by`` names), the most severe first, with their place from 1."""
    order = Window.partitionBy(*by).orderBy(severity(F.col("indicator")), "check_ord", "ord1", "ord2", "ord3")
    return cards.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def focused(cards: DataFrame, focus: Column) -> DataFrame:
    """Cards whose summary or detail has the ``focus``; all of a patient's cards if none has."""
    hit = (F.trim(focus) == "") | F.lower(F.concat("summary", "detail")).contains(C.norm(focus))
    any_hit = F.max(hit).over(Window.partitionBy("patient_id"))
    return cards.withColumn("shown", hit | ~any_hit).filter("shown").drop("shown")


def as_text(cards: DataFrame) -> DataFrame:
    """(patient_id, text): the cards in their order, a line for each."""
    line = F.concat(F.lit("- ["), F.upper("indicator"), F.lit("] "), F.col("summary"), F.lit(": "), F.col("detail"))
    lines = cards.select("patient_id", F.struct(severity(F.col("indicator")).alias("s"), "check_ord", "ord1", "ord2", "ord3", line.alias("line")).alias("x"))
    return lines.groupBy("patient_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def risk_assertions(cards: DataFrame) -> DataFrame:
    """(patient_id, text): the risk cards as sentences for a patient's memory."""
    text = F.concat(F.lit("Risk synthesis for patient "), F.col("patient_id").cast("string"), F.lit(": "), F.col("summary"), F.lit(". "), F.col("detail"))
    return cards.filter(F.col("check_id").startswith("combined_risk")).select("patient_id", text.alias("text"))
