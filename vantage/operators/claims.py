"""Quantities in texts, and answers whose claims are verified against the sentences that they cite.

All checks are column expressions; scores of outside models are handed in as column functions. Languages are en, es and hi; a locale
such as es-MX adds the country's way of writing numbers and dates. Other languages have no cues.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from vantage.runtime import settle

# fixed values: months by language; numbers as words; words that make a number larger; units behind and before a number
MONTHS = {
    1: "january enero जनवरी", 2: "february febrero फ़रवरी फरवरी", 3: "march marzo मार्च", 4: "april abril अप्रैल", 5: "may mayo मई", 6: "june junio जून",
    7: "july julio जुलाई", 8: "august agosto अगस्त", 9: "september septiembre setiembre सितंबर सितम्बर", 10: "october octubre अक्टूबर अक्तूबर",
    11: "november noviembre नवंबर नवम्बर", 12: "december diciembre दिसंबर दिसम्बर",
}
NUMBER_WORDS = {
    0: "zero", 1: "one uno una एक", 2: "two dos दो", 3: "three tres तीन", 4: "four cuatro चार", 5: "five cinco पांच पाँच", 6: "six seis", 7: "seven siete",
    8: "eight ocho", 9: "nine nueve", 10: "ten diez दस", 11: "eleven", 12: "twelve", 15: "fifteen quince", 20: "twenty veinte", 30: "thirty treinta",
}
SCALES = [(r"mil\s+millones", 1e9), (r"crores?|करोड़", 1e7), (r"lakhs?|लाख", 1e5), (r"millones|millón|millions?", 1e6), (r"thousand|mil|हज़ार|हजार", 1e3)]
UNITS = [(r"%|per\s*cent|percent|por\s+ciento|प्रतिशत", "%"), (r"euros?|eur(?![a-z])|€", "EUR"), (r"rupees?|रुपये|रुपए|inr(?![a-z])", "INR"), (r"pesos|mxn(?![a-z])", "MXN"), (r"dollars?|dólares|usd(?![a-z])", "USD")]
SYMBOLS = {"€": "EUR", "₹": "INR", "£": "GBP", "rs": "INR", "inr": "INR", "usd": "USD", "eur": "EUR", "mxn": "MXN"}
DECIMAL_COMMA = ["es-ES"]
# fixed values: cues by language
NEGATION = {"en": "not no never none cannot neither nor without ineligible", "es": "no nunca jamás ningún ninguna ninguno sin tampoco ni", "hi": "नहीं न मत बिना"}
OBLIGATION = {"en": "must shall required mandatory obligatory obliged", "es": "debe deben deberá deberán obligatorio obligatoria obligatorios obligatorias", "hi": "अनिवार्य आवश्यक ज़रूरी जरूरी"}
PERMISSION = {"en": "may can allowed permitted eligible entitled", "es": "puede pueden podrá podrán permitido permitida elegible", "hi": "सकते सकता सकती सकेंगे पात्र हकदार"}
QUALIFIER = {"en": "except unless excluding however only", "es": "excepto salvo únicamente solo sólo", "hi": "सिवाय छोड़कर बशर्ते लेकिन केवल हालांकि परंतु परन्तु"}
QUALIFIER_PHRASES = {"en": ["provided that", "subject to", "does not apply", "only if"], "es": ["a menos que", "siempre que", "sin embargo", "no aplica"], "hi": ["लागू नहीं"]}
SCOPE = {
    "worker": {
        "employee": "employee employees staff empleado empleados empleada empleadas कर्मचारी कर्मचारियों", "contractor": "contractor contractors contratista contratistas ठेकेदार संविदा",
        "intern": "intern interns becario becarios becaria becarias इंटर्न प्रशिक्षु",
    },
    "place": {"india": "india indian भारत भारतीय", "spain": "spain españa स्पेन", "mexico": "mexico méxico मेक्सिको", "madrid": "madrid मैड्रिड", "mumbai": "mumbai मुंबई", "pune": "pune पुणे"},
}

_MONTH = {w: k for k, ws in MONTHS.items() for w in ws.split()}
_NAMES = "|".join(sorted(_MONTH, key=len, reverse=True))
_SPACES = "  "
_NUMBER = rf"(?:(?<![\d,.])\d[\d,.{_SPACES}]*\d(?!\d)|(?<![\d,.])\d(?!\d))"
_BEFORE = r"€|₹|£|\$|(?:rs\.?|inr|usd|eur|mxn)\s{0,3}"
_SCALED = "|".join(p for p, _ in SCALES)
_UNIT = "|".join(p for p, _ in UNITS)
# the number, with what stands right before it and after it; places without a digit fail at once
_WHOLE = rf"(?iu)(?=\d)(?:(?<=({_BEFORE}))|)({_NUMBER})(?=(?:\s*({_SCALED})(?![a-z]))?\s*({_UNIT})?)"
_DATES = {
    "ymd": r"(?iu)(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)",
    "numeric": r"(?iu)(?<!\d)(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)",
    "day month": rf"(?iu)(?<!\d)(\d{{1,2}})\s+(?:de\s+)?({_NAMES})\s*,?\s+(?:de\s+)?(\d{{4}})(?!\d)",
    "month day": rf"(?iu)({_NAMES})\s+(\d{{1,2}}),?\s+(\d{{4}})(?!\d)",
}
# what a text with any such date holds
_DATED = r"(?<!\d)\d{4}-\d|\d[/.-]\d{4}(?!\d)|\d\s+\D+\s\d{4}(?!\d)|\s\d{1,2},?\s+\d{4}(?!\d)"
EVALUATED = StructType([StructField("value", DoubleType()), StructField("operands", ArrayType(DoubleType()))])
QUANTITY = "array<struct<value:double,unit:string>>"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, vowel signs and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\wऀ-ॿ']+"), F.lit(0))


def _dated(kind: str, locale: Column) -> Callable[[Column], Column]:
    """From a date of one kind to its quantities: yyyymmdd as DATE, and the year alone; none if there is no such day."""

    def run(m: Column) -> Column:
        number = lambda k: F.regexp_extract(m, _DATES[kind], k).cast("int")
        month = lambda k: F.element_at(_map(_MONTH), F.lower(F.regexp_extract(m, _DATES[kind], k)))
        if kind == "ymd":
            y, mo, d = number(1), number(2), number(3)
        elif kind == "numeric":
            us = locale == "en-US"
            y, mo, d = number(3), F.when(us, number(1)).otherwise(number(2)), F.when(us, number(2)).otherwise(number(1))
        elif kind == "day month":
            y, mo, d = number(3), month(2), number(1)
        else:
            y, mo, d = number(3), month(1), number(2)
        day = F.struct((y * 10_000 + mo * 100 + d).cast("double").alias("value"), F.lit("DATE").alias("unit"))
        year = F.struct(y.cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))
        return F.when(mo.between(1, 12) & d.between(1, 31), F.array(day, year)).otherwise(F.array().cast(QUANTITY))

    return run


def _dates(work: Column, locale: Column) -> Column:
    """struct(dates, work): the quantities of the dates in a text, and the text with the dates cut out."""
    start = F.struct(F.array().cast(QUANTITY).alias("dates"), work.alias("work"))

    def cut(kind: str, pattern: str) -> Callable[[Column], Column]:
        found = lambda a: F.flatten(F.transform(F.regexp_extract_all(a["work"], F.lit(pattern), F.lit(0)), _dated(kind, locale)))
        return lambda a: F.struct(F.concat(a["dates"], found(a)).alias("dates"), F.regexp_replace(a["work"], pattern, "\x00").alias("work"))

    return F.when(work.rlike(_DATED), reduce(lambda a, x: bound(a, cut(*x)), _DATES.items(), start)).otherwise(start)


def _value(token: Column, locale: Column) -> Column:
    """The number that a token writes in a locale, or null."""
    def read(t: Column) -> Column:
        is_ = lambda p: t.rlike(f"^(?:{p})$")
        comma = F.when(is_(r"\d{1,3}(\.\d{3})+(,\d+)?|\d+(,\d+)?"), F.translate(F.translate(t, ".", ""), ",", "."))
        point = F.when(is_(r"\d{1,2}(,\d{2})+,\d{3}(\.\d+)?|\d{1,3}(,\d{3})+(\.\d+)?|\d+(\.\d+)?"), F.replace(t, F.lit(","), F.lit("")))
        return F.when(locale.isin(DECIMAL_COMMA), comma).otherwise(point).try_cast("double")

    return bound(F.when(token.rlike(f"[{_SPACES}]"), F.translate(token, _SPACES, "")).otherwise(token), read)


def quantities(text: Column, locale: Column, number_words: bool = False) -> Column:
    """struct(found, unread): the quantities of a text with their units, and whether some number could not be read.

    Dates come first and are cut out, so their digits are no numbers. A scale word such as lakh or million multiplies; a unit stands behind
    a number or, as a sign or code, right before it; `$` is the peso in es-MX. With number_words, words such as three count as well.
    A null text has none.
    """
    whole = lambda x, p: x.rlike(f"(?iu)^(?:{p})$")

    def quantity(x: Column) -> Column:
        # most numbers have neither: no pattern is tried on an empty one
        scale = reduce(lambda c, p: c.when(whole(x["scale"], p[0]), p[1]), SCALES[1:], F.when(x["scale"] == "", 1.0).when(whole(x["scale"], SCALES[0][0]), SCALES[0][1])).otherwise(1.0)
        unit = reduce(lambda c, p: c.when(whole(x["unit"], p[0]), p[1]), UNITS[1:], F.when(x["unit"] == "", F.lit(None).cast("string")).when(whole(x["unit"], UNITS[0][0]), UNITS[0][1]))
        sign = F.rtrim(F.replace(F.lower(x["before"]), F.lit("."), F.lit("")))
        before = F.when(sign == "$", F.when(locale == "es-MX", "MXN").otherwise("USD")).otherwise(F.element_at(_map(SYMBOLS), sign))
        return F.struct((_value(x["token"], locale) * scale).alias("value"), F.coalesce(unit, F.when((x["before"] != "") & (sign != ""), before)).alias("unit"))

    def numbers(work: Column) -> Column:
        # one search for all four groups: each number becomes a piece of its own, with marks that the text does not hold
        pieces = F.split(F.regexp_replace(F.replace(F.replace(work, F.lit("\x01"), F.lit("\x00")), F.lit("\x02"), F.lit("\x00")), _WHOLE, "\x01\x02$1\x02$2\x02$3\x02$4\x01"), "\x01")
        parts = lambda x: F.struct(*[F.get(x, F.lit(k + 1)).alias(n) for k, n in enumerate(("before", "token", "scale", "unit"))])
        token = lambda x: bound(F.split(x, "\x02"), lambda y: quantity(parts(y)))
        none = F.array().cast(QUANTITY)
        found = F.when(work.rlike(r"\d"), F.transform(F.filter(pieces, lambda x: x.startswith("\x02")), token)).otherwise(none)
        if not number_words:
            return found
        known = _map({w: float(k) for k, ws in NUMBER_WORDS.items() for w in ws.split()})
        spoken = F.filter(words(work), lambda w: w.isin(*[w for ws in NUMBER_WORDS.values() for w in ws.split()]))
        return F.concat(found, F.transform(spoken, lambda w: F.struct(F.element_at(known, w).alias("value"), F.lit(None).cast("string").alias("unit"))))

    # each step's result is bound once as a variable, else every use would search the text anew
    def read(plain: Column) -> Column:
        finish = lambda dates: lambda q: F.struct(F.concat(dates, F.filter(q, lambda x: x["value"].isNotNull()).cast(QUANTITY)).alias("found"), F.exists(q, lambda x: x["value"].isNull()).alias("unread"))
        return bound(_dates(plain, locale), lambda a: bound(numbers(a["work"]), finish(a["dates"])))

    plain = F.coalesce(text, F.lit(""))
    return bound(F.when(plain.rlike("[०-९]"), F.translate(plain, "०१२३४५६७८९", "0123456789")).otherwise(plain), read)


def close(a: Column, b: Column, least: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(least))


def same(q: Column, e: Column) -> Column:
    """Whether evidence e holds the quantity q: equal values, and equal units where both have one; a date is only a date."""
    date = lambda x: F.coalesce(x["unit"] == "DATE", F.lit(False))
    return (date(q) == date(e)) & close(q["value"], e["value"]) & (q["unit"].isNull() | e["unit"].isNull() | (q["unit"] == e["unit"]))


def holds(w: Column, listed: str) -> Column:
    return F.exists(w, lambda x: x.isin(*listed.split()))


def has(w: Column, locale: Column, cues: dict[str, str]) -> Column:
    """Whether a text's words hold a cue of its language; an English `n't` is a negation."""
    lang = F.substring_index(locale, "-", 1)
    out = F.lit(False)
    for name, listed in cues.items():
        found = holds(w, listed)
        if name == "en" and cues is NEGATION:
            found |= F.exists(w, lambda x: x.endswith("n't"))
        out = F.when(lang == name, found).otherwise(out)
    return F.coalesce(out, F.lit(False))


def qualified(text: Column, locale: Column) -> Column:
    """Whether a text limits what it says."""
    lang, low = F.substring_index(locale, "-", 1), F.lower(text)
    phrase = reduce(lambda c, x: c | ((lang == x[0]) & F.contains(low, F.lit(x[1]))), [(k, p) for k, ps in QUALIFIER_PHRASES.items() for p in ps], F.lit(False))
    return has(words(text), locale, QUALIFIER) | F.coalesce(phrase, F.lit(False))


def scopes(w: Column, more: Column | None = None) -> Column:
    """struct of the concepts of each family that a text's words name, or that `more` lists."""
    named = lambda concept, forms: holds(w, forms) | (F.lit(False) if more is None else F.coalesce(F.array_contains(more, concept), F.lit(False)))
    return F.struct(*[F.array_compact(F.array(*[F.when(named(c, f), c) for c, f in members.items()])).alias(family) for family, members in SCOPE.items()])


def signs(text: Column, locale: Column, more: Column | None = None) -> Column:
    """struct(negated, obliged, permitted, scope) of a text, from one search for its words."""
    cues = (("negated", NEGATION), ("obliged", OBLIGATION), ("permitted", PERMISSION))
    listed = [w for x in (NEGATION, OBLIGATION, PERMISSION, *SCOPE.values()) for ws in x.values() for w in ws.split()]
    telling = F.filter(words(text), lambda w: w.isin(*listed) | w.endswith("n't"))  # few words of a text are
    return bound(telling, lambda w: F.struct(*[has(w, locale, x).alias(n) for n, x in cues], scopes(w, more).alias("scope")))


@F.pandas_udf(EVALUATED)
def evaluated(expressions: pd.Series) -> pd.DataFrame:
    """The value and the numbers of an expression of + - * / and brackets; nulls where it is none, or divides by zero."""
    out = []
    for text in expressions:
        numbers: list[float] = []
        if not text:
            out.append((None, None))
            continue
        try:
            out.append((_sum(_Letters(text), numbers), numbers))
        except (ValueError, ZeroDivisionError, RecursionError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["value", "operands"])


class _Letters:
    """An expression's letters without spaces, read one after the other up to an end mark."""

    def __init__(self, text: str):
        self.text, self.at = "".join(text.split()) + "\n", 0

    def take(self, some: str) -> str:
        found = self.text[self.at]
        self.at += found in some
        return found if found in some else ""


def _sum(s: _Letters, numbers: list[float], inside: bool = False) -> float:
    value = _product(s, numbers)
    while sign := s.take("+-"):
        value += _product(s, numbers) * (1 if sign == "+" else -1)
    if not s.take(")" if inside else "\n"):
        raise ValueError
    return value


def _product(s: _Letters, numbers: list[float]) -> float:
    value = _factor(s, numbers)
    while sign := s.take("*/"):
        other = _factor(s, numbers)
        value = value * other if sign == "*" else value / other
    return value


def _factor(s: _Letters, numbers: list[float]) -> float:
    if s.take("-"):
        return -_factor(s, numbers)
    if s.take("("):
        return _sum(s, numbers, True)
    digits = ""
    while c := s.take("0123456789."):
        digits += c
    numbers.append(float(digits))
    return numbers[-1]


def shown(value: Column) -> Column:
    return F.regexp_replace(value.cast("decimal(30,6)").cast("string"), r"\.?0+$", "")


def verify_claims(claims: DataFrame, context: DataFrame, nli: Callable[[Column, Column], Column], judge: Callable[[Column, Column], Column], low: float = 0.5, high: float = 0.92) -> DataFrame:
    """claims with `accepted`, `reasons` and `nli`.

    claims: (answer_id, cid, nth, text, locale, cites, qualifies, calc, question); context: (answer_id, sid, text, locale, doc_id, section, ordinal, doc_scope), a
    sentence of an answer once. In order: citations that are there; quantities that the cited sentences, the question or a stated calculation
    hold; the same polarity as one of them; an obligation only from one; no other worker or place than theirs. A failed check
    rejects, a doubtful one leaves the claim to the judge. Then the entailment score nli(premise, claim): below `low` rejects, from `high` accepts where nothing
    was doubtful, and the judge decides the rest; without an answer (null) of either model the claim is rejected. A claim cites few sentences, so those are gathered.
    """
    text, locale = F.col("text"), F.col("locale")
    # texts are shuffled as they are and read where they are joined, so that many tasks share the reading however few files hold them
    ctx = context.select("answer_id", "sid", "text", "locale", "doc_scope").repartition("answer_id", "sid")
    ctx = ctx.select("answer_id", "sid", text.alias("said"), quantities(text, locale, True)["found"].alias("numbers"), signs(text, locale, F.col("doc_scope")).alias("signs"))
    cited = claims.select("answer_id", "cid", F.posexplode("cites").alias("pos", "sid")).join(ctx, ["answer_id", "sid"])
    names = ["said", "numbers", *[f"signs.{n}" for n in ("negated", "obliged", "permitted", "scope")]]
    gathered = cited.groupBy("answer_id", "cid").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("cited"))
    c = claims.join(gathered, ["answer_id", "cid"], "left").withColumn("cited", F.coalesce("cited", F.array().cast(gathered.schema["cited"].dataType)))
    c = c.withColumns({"own": quantities(text, locale), "asked": quantities(F.col("question"), locale, True)["found"], "flags": signs(text, locale)})
    stated = F.trim(F.get(F.split("calc", "=", 2), F.lit(1))).try_cast("double")
    c = c.withColumns({"calculated": evaluated(F.get(F.split("calc", "=", 2), F.lit(0))), "stated": stated})

    cs, flags, calc = F.col("cited"), F.col("flags"), F.col("calculated")
    some = lambda name: F.exists(cs, lambda s: s[name])
    structure = F.when(F.size(F.coalesce("cites", F.array())) == 0, "no citation").when(F.size(cs) < F.size("cites"), "a citation is not in the context")
    evidence = F.flatten(F.transform(cs, lambda s: s["numbers"]))
    pool = F.concat(evidence, "asked")
    result = F.array(F.struct(calc["value"].alias("value"), F.lit(None).cast("string").alias("unit")))
    allowed = F.when(F.col("calc").isNull(), evidence).otherwise(F.concat(evidence, result, "asked"))
    orphan = F.exists(calc["operands"], lambda o: ~F.exists(pool, lambda p: close(o, p["value"], 0.0)))
    arithmetic = (
        F.when(~F.contains("calc", F.lit("=")), "calculation without a result")
        .when(calc["value"].isNull() | F.col("stated").isNull(), "calculation does not evaluate")
        .when(orphan, "calculation with a number that is not in the evidence or the question")
        .when(~close(calc["value"], F.col("stated"), 0.005), F.concat(F.lit("calculation says "), shown(F.col("stated")), F.lit(", recomputed "), shown(calc["value"])))
    )
    missing = F.filter(F.col("own.found"), lambda q: ~F.exists(allowed, lambda e: same(q, e)))
    listed = F.array_join(F.transform(missing, lambda q: F.concat_ws(" ", shown(q["value"]), q["unit"])), ", ")
    amounts = F.coalesce(F.when(F.col("calc").isNotNull(), arithmetic), F.when(F.size(missing) > 0, F.concat(F.lit("quantity not in evidence: "), listed)))
    unread = F.when(F.col("own.unread"), "a number could not be read")
    polarity = F.when(~F.exists(cs, lambda s: s["negated"] == flags["negated"]), F.when(flags["negated"], "negation added").otherwise("negation dropped"))
    stronger = F.when(flags["obliged"] & ~some("obliged"), "obligation added")
    weaker = F.when(flags["permitted"] & some("obliged") & ~some("permitted"), "obligation became permission")
    swapped, added = [], []
    for family in SCOPE:
        theirs = F.array_distinct(F.flatten(F.col(f"cited.scope.{family}")))
        extra = F.array_except(flags["scope"][family], theirs)
        swapped.append(F.when((F.size(extra) > 0) & (F.size(theirs) > 0), F.concat(F.lit("scope swapped: "), F.array_join(extra, ", "))))
        added.append(F.when(F.size(extra) > 0, F.concat(F.lit("scope added: "), F.array_join(extra, ", "))))
    nothing = F.lit(None).cast("string")
    checks = F.array(*[F.struct(fail.alias("fail"), doubt.alias("doubt")) for fail, doubt in ((structure, nothing), (amounts, unread), (polarity, nothing), (stronger, weaker), (F.coalesce(*swapped), F.coalesce(*added)))])
    start = F.struct(F.array().cast("array<string>").alias("reasons"), F.lit(False).alias("failed"))
    step = lambda a, x: F.when(a["failed"], a).otherwise(F.struct(F.concat(a["reasons"], F.array_compact(F.array(F.coalesce(x["fail"], x["doubt"])))).alias("reasons"), x["fail"].isNotNull().alias("failed")))
    c = c.withColumn("checked", F.aggregate(checks, start, step)).withColumn("premise", F.array_join(F.transform(cs, lambda s: s["said"]), " "))
    c = c.withColumn("nli", F.when(~F.col("checked.failed"), nli(F.col("premise"), text)))
    sure = (F.col("nli") >= high) & (F.size("checked.reasons") == 0)
    c = c.withColumn("ruling", F.when((F.col("nli") >= low) & ~sure, judge(F.col("premise"), text)))
    last = (
        F.when(F.col("checked.failed") | F.coalesce(sure, F.lit(False)), nothing)
        .when(F.col("nli").isNull(), "no entailment score")
        .when(F.col("nli") < low, "entailment too low")
        .when(F.col("ruling").isNull(), "judge gave no answer")
        .when(F.col("ruling"), "accepted by judge")
        .otherwise("rejected by judge")
    )
    accepted = F.coalesce(sure | F.col("ruling"), F.lit(False)) & ~F.col("checked.failed")
    return c.withColumn("accepted", accepted).withColumn("reasons", F.concat("checked.reasons", F.array_compact(F.array(last)))).select(*claims.columns, "accepted", "reasons", "nli")


def verify_answers(claims: DataFrame, context: DataFrame, nli: Callable, judge: Callable, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answers, claims): (answer_id, status) with VERIFIED, PARTIAL or DROPPED, and verify_claims() with `limits_shown`.

    A claim that qualifies a dropped one is dropped too, in the order of nth. limits_shown lists sentences to show beside an accepted claim: those of a
    dropped claim that qualifies it; cited ones that limit what they say where the claim doesn't; and such ones at most `radius` places
    from a cited one in its section, unless an accepted claim of the answer cites them.
    """
    checked = settle(verify_claims(claims, context, nli, judge), "claims_checked")
    listed = checked.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("nth", "cid", "qualifies", "accepted"))).alias("all"))
    start = F.map_from_entries(F.transform("all", lambda x: F.struct(x["cid"], x["accepted"])))
    drop = lambda m, x: F.when(F.coalesce(~F.element_at(m, x["qualifies"]), F.lit(False)), F.transform_values(m, lambda k, v: v & (k != x["cid"]))).otherwise(m)
    final = listed.select("answer_id", F.explode(F.aggregate("all", start, drop)).alias("cid", "stands"))
    c = checked.join(final, ["answer_id", "cid"])
    dropped = F.when(F.col("accepted") & ~F.col("stands"), F.array(F.concat(F.lit("dropped with "), "qualifies"))).otherwise(F.array().cast("array<string>"))
    c = c.withColumn("reasons", F.concat("reasons", dropped)).withColumn("accepted", F.col("stands")).drop("stands")
    counts = c.groupBy("answer_id").agg(F.count_if("accepted").alias("kept"), F.count("*").alias("n"))  # without what is only shown

    limits = context.withColumn("limits", qualified(F.col("text"), F.col("locale"))).select("answer_id", "sid", "doc_id", "section", "ordinal", "limits")
    cites = c.filter("accepted").select("answer_id", "cid", qualified(F.col("text"), F.col("locale")).alias("limited"), F.explode("cites").alias("sid"))
    near = cites.join(limits, ["answer_id", "sid"])
    own = near.filter(F.col("limits") & ~F.col("limited")).select("answer_id", "cid", "sid")
    other = limits.filter("limits").select("answer_id", F.col("sid").alias("beside"), "doc_id", "section", F.col("ordinal").alias("place"))
    beside = near.join(other, ["answer_id", "doc_id", "section"]).filter((F.abs(F.col("place") - F.col("ordinal")) <= radius) & (F.col("beside") != F.col("sid")))
    beside = beside.select("answer_id", "cid", F.col("beside").alias("sid")).join(cites.select("answer_id", "sid").distinct(), ["answer_id", "sid"], "left_anti").select("answer_id", "cid", "sid")
    lost = c.filter(~F.col("accepted") & F.col("qualifies").isNotNull()).select("answer_id", F.col("qualifies").alias("cid"), F.explode("cites").alias("sid"))
    lost = lost.join(limits.select("answer_id", "sid"), ["answer_id", "sid"], "left_semi").join(c.filter("accepted").select("answer_id", "cid"), ["answer_id", "cid"], "left_semi").select("answer_id", "cid", "sid")
    shown_beside = own.unionByName(beside).unionByName(lost).groupBy("answer_id", "cid").agg(F.sort_array(F.collect_set("sid")).alias("limits_shown"))
    c = c.join(shown_beside, ["answer_id", "cid"], "left").withColumn("limits_shown", F.coalesce("limits_shown", F.array().cast("array<string>")))
    status = F.when(F.col("kept") == F.col("n"), "VERIFIED").when(F.col("kept") > 0, "PARTIAL").otherwise("DROPPED")
    return counts.select("answer_id", status.alias("status")), c
