"""Scalar functions over columns, all of built-in expressions. Null arguments give null unless a function says more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carefold import vocabulary as V


def norm(text: Column) -> Column:
    """Lower case without outer white space; null counts as empty."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def filled(*texts: Column) -> Column:
    """The first text that is not empty, null if none is."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def coerce_date(raw: Column, fallback: Column | None = None, today: Column | None = None) -> Column:
    """A date from a day, what begins with one, a month (its first day) or a year (its first day).

    Anything else, null too, is ``fallback`` (a date, or a text that begins with a day), then ``today``, which is the
    current date unless given.
    """
    raw = F.trim(raw)
    part = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(raw, F.lit("-01"))).when(raw.rlike(r"^[0-9]{4}$"), F.concat(raw, F.lit("-01-01")))
    found = [_day(raw), F.try_to_date(part, "yyyy-MM-dd")]
    if fallback is not None:
        found.append(_day(fallback.cast("string")))
    return F.coalesce(*found, F.current_date() if today is None else today)


def _day(raw: Column) -> Column:
    first = F.substring(raw, 1, 10)
    return F.try_to_date(F.when(first.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), first), "yyyy-MM-dd")


def canonical_flag(raw: Column) -> Column:
    """high for h, low for l, else the flag in lower case; null counts as empty."""
    flag = norm(raw)
    return F.when(flag == "h", "high").when(flag == "l", "low").otherwise(flag)


def canonical_analyte(raw: Column) -> Column:
    """The analyte that the first known part of the name stands for, else the name's first word."""
    name = norm(raw)
    return F.coalesce(_first_within(name, V.ANALYTE_PARTS), F.element_at(F.split(name, r"\s+"), 1))


def _first_within(text: Column, parts: dict[str, str]) -> Column:
    """What the first of the parts that the text has stands for."""
    return F.try_element_at(_table(parts), F.get(F.filter(F.array(*map(F.lit, parts)), lambda p: text.contains(p)), F.lit(0)))


def to_float(raw: Column) -> Column:
    """A finite number, else null."""
    number = F.trim(raw.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def number_text(number: Column) -> Column:
    """A number of up to six digits as people write it: 7.8 and 165, not 165.0."""
    return F.regexp_replace(F.round(number, 6).cast("string"), r"\.0$", "")


def title(text: Column) -> Column:
    """Each run of letters with a capital first letter, as in O'Neil and 5Mg."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))), "")


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1 << 30)))


def label(subject: Column, predicate: Column, value: Column) -> Column:
    """A fact in plain words, by its subject and predicate."""
    s, p = F.lower(subject), F.lower(predicate)
    return (
        F.when((s == "allergy") & (p == "cleared"), F.concat(title(value), F.lit(" allergy cleared")))
        .when(s == "allergy", F.concat(F.lit("Allergic to "), value))
        .when((s == "medication") & (p == "switched"), F.concat(F.lit("Switched to "), value))
        .when(s == "medication", F.concat(F.lit("On "), value))
        .when(s == "diagnosis", F.concat(F.lit("Diagnosed: "), value))
        .otherwise(F.concat(capitalized(predicate), F.lit(" "), value))
    )


def resource_type(given: Column, subject: Column) -> Column:
    """The given type, else the one that the subject stands for, else null."""
    return F.coalesce(given, F.try_element_at(_table(V.RESOURCE_TYPES), norm(subject)))


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in entries.items() for x in item])


def drug_class(drug: Column, learned: dict[str, str] | None = None) -> Column:
    """The class of a drug by its name, else by its first known word; ``learned`` names come before the vocabulary's."""
    classes = _table(V.DRUG_CLASS | (learned or {}))
    name = norm(drug)
    words = F.filter(F.split(F.replace(name, F.lit("/"), F.lit(" ")), r"\s+"), lambda w: F.map_contains_key(classes, w))
    return F.coalesce(F.try_element_at(classes, name), F.try_element_at(classes, F.get(words, F.lit(0))))


def drug_group(of_class: Column) -> Column:
    """The group of classes that react with each other, null if none."""
    return F.try_element_at(_table(V.CLASS_GROUP), of_class)


def family_risk(condition: Column, learned: dict[str, str] | None = None) -> Column:
    """The category of a condition's familial risk: by its name, else by the longest known name within it."""
    risks = V.FAMILY_RISK | (learned or {})
    longest_first = dict(sorted(risks.items(), key=lambda item: -len(item[0])))  # of equally long ones the vocabulary's first
    name = norm(condition)
    within = _first_within(name, longest_first)
    return F.coalesce(F.try_element_at(_table(learned), name), within) if learned else within


def is_first_degree(relation: Column) -> Column:
    return norm(relation).isin(V.FIRST_DEGREE)


def is_known(name: Column, learned: dict[str, str] | None = None) -> Column:
    """Does the vocabulary have the name as a drug (or a drug's name as a word of it), condition or analyte?"""
    analytes = {a for rules in V.MONITORING.values() for a, _ in rules}
    return drug_class(name, learned).isNotNull() | norm(name).isin(sorted({*V.MONITORING, *V.FAMILY_RISK, *analytes}))


def monitoring(condition: Column) -> Column:
    """array<struct<analyte, every_months>>: what a condition is watched by; empty if nothing is."""
    rules = [F.array(*[F.struct(F.lit(a).alias("analyte"), F.lit(m).alias("every_months")) for a, m in watched]) for watched in V.MONITORING.values()]
    known = F.create_map(*[x for name, rule in zip(V.MONITORING, rules, strict=True) for x in (F.lit(name), rule)])
    return F.coalesce(F.try_element_at(known, norm(condition)), F.array().cast("array<struct<analyte:string,every_months:int>>"))


def normal_name(raw: Column) -> Column:
    """A person's name for comparisons: lower case, no apostrophes, hyphens and runs of spaces as one space."""
    plain = F.replace(F.replace(F.lower(raw), F.lit("'"), F.lit("")), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def surname(name: Column) -> Column:
    """The last word of a normal name, empty if there is none."""
    return F.element_at(F.split(normal_name(name), " "), -1)


def age_on(dob: Column, day: Column) -> Column:
    """Whole years from ``dob`` to ``day``; null if either is."""
    before = F.month(dob) * 100 + F.dayofmonth(dob) > F.month(day) * 100 + F.dayofmonth(day)
    return F.year(day) - F.year(dob) - F.when(before, 1).otherwise(0)


def birth_year(dob: Column) -> Column:
    """The year that a text begins with, by its four leading digits; null without them."""
    return F.regexp_extract(dob.cast("string"), "^([0-9]{4})", 1).try_cast("int")


def timeline_file(patient: Column) -> Column:
    """The name of a patient's timeline file, by the digits of the id: 1 and two places at least."""
    digits = F.regexp_replace(patient.cast("string"), "[^0-9]", "")
    number = F.regexp_replace(F.when(digits == "", "01").otherwise(digits), "^0+(?=.)", "")
    return F.concat(F.lit("patient_timeline_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit(".json"))


def generation_plausible(relation: Column, patient_year: Column, relative_year: Column) -> Column:
    """May a person born in ``relative_year`` be this relation of one born in ``patient_year``? Null if it can't be told."""
    older = patient_year - relative_year
    return (
        F.when(relation.isin(V.PARENTS), older.between(*V.PARENT_GAP))
        .when(relation.isin(V.CHILDREN), (-older).between(*V.PARENT_GAP))
        .when(relation.isin(V.SIBLINGS), F.abs(older) <= V.SIBLING_GAP)
    )


def partition_name(patient_id: Column, kind: str = "") -> Column:
    """The name of a patient's partition: of the ledger, or of its ``naive`` copy or ``chat``."""
    prefix = {"": "tr", "naive": "naive", "chat": "chat"}[kind]
    return F.concat(F.lit(f"{prefix}_"), norm(patient_id))


def image_mime(filename: Column) -> Column:
    """The MIME type of an image by its extension; image/png for any other."""
    kinds = {"jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "heic": "heic", "heif": "heif"}
    extension = F.regexp_extract(F.lower(filename), r"\.([^.]*)$", 1)
    return F.concat(F.lit("image/"), F.coalesce(F.try_element_at(_table(kinds), extension), F.lit("png")))
