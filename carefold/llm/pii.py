r"""Personal data (operator 7), by DataFrame functions alone.

Method: weak-supervision aggregation. Candidate spans are what the base patterns find plus what looser patterns find
(numbers shaped like cards or phones that the base rules leave out). Labelers vote yes, no or abstain on each
candidate: the base rule, the usual grouping of the characters (regex), known prefixes and domains (gazetteer), words
shortly before the span and characters right beside it (context). Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, and gives each pattern the probability that it is personal data.
With these as soft labels a naive Bayes classifier over features of the span itself (kind, shape, length, distinct
digits) is trained, and non-base candidates are added where it is sure enough. Base spans always stay.

Distribution: the texts are read once, and only the matches found in them, with 40 characters before each, go on:
they are written to shared storage, so texts are never shuffled. Training needs counts per vote pattern and per
feature only, a few hundred rows whatever the input, which is all that reaches the driver. The classifier is a literal
map in a projection. A document's spans come together by a row number, so no group is larger than one document.

Patterns: a base pattern may start anywhere. The versions here refuse a start amid a run of the characters that it
begins with (unless the match before ended there), which finds the same matches but does not try each place of a long
run, and end in possessive groups, which the regex engine runs in a loop and not by recursion.

Defined results: a null text is empty; an empty text or table has no spans; rows are independent, so repeated rows and
null doc_ids keep their own results; with no candidates at all nothing is trained and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._common import materialize, table

KINDS = ("email", "ip", "card", "phone")

#: A candidate is added if the classifier gives it at least this probability.
SURE = 0.95
EM_ROUNDS = 50

#: The base patterns of the kinds, as told above.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)", r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)"
#: Looser patterns, whose matches are candidates that the method may add: addresses that are written out, addresses of
#: the longer kind, numbers shaped like cards or phones.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20.-]?){3}[0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: What the usual way of writing looks like, by kind.
SHAPE = {
    "email": rf"^[a-z0-9]+(?:[._+-][a-z0-9]+)*(?:@|{_AT})[a-z0-9-]+(?:(?:\.|{_DOT})[a-z0-9-]+)*(?:\.|{_DOT})[a-z]{{2,6}}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}|[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7})$",
    "card": r"^(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ -]?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}$",
}
#: Gazetteer: top-level domains, first octets in public use, issuers' first digits, country and area codes.
KNOWN = {
    "email": r"(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|example|test)$",
    "ip": r"^(?:(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|(?:2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|33|34|44|49)\b|\(?[2-9][0-9]{2})",
}
#: Words shortly before a span that speak for its kind.
CUES = {
    "email": r"(?i)(?:mail|contact|correo|courriel|write to|from:|to:)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|login)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|credit|payment)",
    "phone": r"(?i)(?:phone|call|tel|fax|mobil|handy|cell)",
}
VOTES = ("base", "shape", "known", "cue", "beside")

MATCHES = "array<struct<kind:int,loose:boolean,s:int,e:int,m:string,before:string,after:string>>"


def matched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found): per document the leftmost non-overlapping matches of all patterns, kind by kind.

    split() gives the text between the matches and regexp_extract_all() the matches; their lengths, added up, are
    the places in code points.
    """
    patterns = [(k, False, BASE[k]) for k in KINDS] + [(k, True, LOOSE[k]) for k in LOOSE]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = {}
    for i, (_, _, pattern) in enumerate(patterns):
        cut[f"p{i}"] = F.split(text, pattern, -1)
        cut[f"m{i}"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = docs.select("doc_id", *[c.alias(n) for n, c in cut.items()])
    found = []
    for i, (kind, loose, _) in enumerate(patterns):
        zipped = f"arrays_zip(slice(p{i}, 1, size(m{i})), m{i}, slice(p{i}, 2, size(m{i})))"
        places = f"""
            aggregate({zipped}, named_struct('at', 0, 'out', CAST(array() AS {MATCHES})), (acc, x) -> named_struct(
              'at', acc.at + length(x['0']) + length(x.m{i}),
              'out', concat(acc.out, array(named_struct('kind', {KINDS.index(kind)}, 'loose', {loose}, 's', acc.at + length(x['0']),
                'e', acc.at + length(x['0']) + length(x.m{i}), 'm', x.m{i}, 'before', right(x['0'], 40), 'after', left(x['2'], 1))))),
              acc -> acc.out)"""
        found.append(F.when(F.size(f"m{i}") > 0, F.expr(places)).otherwise(F.array().cast(MATCHES)))
    return out.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*found).alias("found"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does the string of digits pass the Luhn test?"""

    def value(c: Column, i: Column) -> Column:
        d = c.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)  # a span without digits gives one empty string
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def valid(kind: str, m: Column) -> Column:
    """The base rule that a match of the base pattern must pass."""
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, "+")
    return (out.when(no, "-") if no is not None else out).otherwise("0")


def _by_kind(column: str, one) -> Column:
    out = F.when(F.lit(False), one(KINDS[0]))
    for i, kind in enumerate(KINDS):
        out = out.when(F.col(column) == i, one(kind))
    return out


def candidates(found: DataFrame) -> DataFrame:
    """(row, kind, s, e, based, votes, features): a row per match; based tells the base spans."""
    each = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    m, d = F.col("m"), F.col("d")
    each = each.withColumn("d", digits(m))
    each = each.withColumn("based", ~F.col("loose") & F.coalesce(_by_kind("kind", lambda k: valid(k, m)), F.lit(False)))
    shape, known = _by_kind("kind", lambda k: m.rlike(SHAPE[k])), _by_kind("kind", lambda k: F.lower(m).rlike(KNOWN[k]))
    glued = F.right("before", F.lit(1)).rlike(r"[A-Za-z0-9_\"/=]") | F.col("after").rlike(r"[A-Za-z0-9_\"/=]")
    votes = F.concat(
        _vote(F.col("based"), ~F.col("based")),
        _vote(shape, ~shape),
        _vote(known, ~known),
        _vote(_by_kind("kind", lambda k: F.col("before").rlike(CUES[k]))),
        _vote(F.lit(False), glued),
    )
    name = _by_kind("kind", F.lit)
    value = {
        "length": F.least(F.length(m), F.lit(40)),
        "digits": F.least(F.length(d), F.lit(20)),
        "distinct": F.size(F.array_distinct(F.split(d, ""))),
        "luhn": luhn(d),
        "breaks": F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)),
    }
    features = F.array(name, *[F.concat_ws(" ", name, F.lit(n), v.cast("string")) for n, v in value.items()])
    return each.select("row", "kind", "s", "e", "based", votes.alias("votes"), features.alias("features"))


def reliabilities(counts: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]]]:
    """EM for a two-class model with independent labelers, over the counts of vote patterns.

    Returns each pattern's probability of being personal data, and per labeler, for each vote, its probability
    given no and yes. At the start a pattern's probability follows the majority of its votes.
    """
    truth = {p: min(0.9, max(0.1, 0.5 + 0.2 * (p.count("+") - p.count("-")))) for p in counts}
    model: list[dict[str, tuple[float, float]]] = []
    for _ in range(rounds):
        yes = sum(n * truth[p] for p, n in counts.items())
        no = sum(n * (1 - truth[p]) for p, n in counts.items())
        model = []
        for i in range(len(VOTES)):
            row = {}
            for v in "+-0":
                y = sum(n * truth[p] for p, n in counts.items() if p[i] == v)
                z = sum(n * (1 - truth[p]) for p, n in counts.items() if p[i] == v)
                row[v] = ((z + 1) / (no + 3), (y + 1) / (yes + 3))
            model.append(row)
        prior = math.log((yes + 1) / (no + 1))
        for p in counts:
            odds = prior + sum(math.log(model[i][v][1] / model[i][v][0]) for i, v in enumerate(p))
            truth[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth, model


def span_classifier(each: DataFrame) -> tuple[float, dict[str, float]]:
    """(prior log odds, log odds of each feature) learnt from the candidates' votes."""
    counts = {r[0]: r[1] for r in each.groupBy("votes").count().collect()}  # at most 3 ** 5 patterns
    if not counts:
        return 0.0, {}
    truth, _ = reliabilities(counts)
    soft = F.element_at(F.create_map(*[F.lit(x) for p, t in truth.items() for x in (p, float(t))]), F.col("votes"))
    rows = (
        each.select(soft.alias("y"), F.explode("features").alias("f"))
        .groupBy("f")
        .agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
        .collect()
    )  # at most some hundred features: lengths and counts are bounded
    yes = sum(n * truth[p] for p, n in counts.items())
    no = sum(n * (1 - truth[p]) for p, n in counts.items())
    odds = {r["f"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in rows}
    return math.log((yes + 0.5) / (no + 0.5)), odds


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of struct(kind, s, e), in order; kind is an index of KINDS."""
    found = materialize(matched(docs), "pii-matches")
    each = materialize(candidates(found), "pii-candidates")
    prior, odds = span_classifier(each)
    weights = F.create_map(*[F.lit(x) for f, w in sorted(odds.items()) for x in (f, float(w))]) if odds else F.create_map().cast("map<string,double>")
    scores = F.transform("features", lambda f: F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))
    score = F.lit(float(prior)) + F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    # The labelers' own votes must not speak against the span as a majority.
    ayes = F.length(F.translate("votes", "-0", "")) >= F.length(F.translate("votes", "+0", ""))
    sure = (score >= math.log(SURE / (1 - SURE))) & ayes
    span = F.struct("kind", "s", "e")
    kept = each.filter(F.col("based") | sure).groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(F.col("based"), span))).alias("base"),
        F.collect_set(F.when(~F.col("based"), span)).alias("other"),
    )
    free = F.filter("other", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    kept = kept.select("row", "base", F.array_sort(free).alias("added"))
    return found.select("row", "doc_id").join(kept, "row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.concat_ws(",", F.transform(F.array_sort(a), lambda c: F.concat_ws(":", F.get(name, c["kind"]), c["s"], c["e"])))
    count = lambda i: F.size(F.filter("base", lambda c: c["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )
