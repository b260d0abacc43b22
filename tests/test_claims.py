"""Quantities by locale, and answers against a small policy in three languages."""

import pytest
from pyspark.sql import functions as F

from vantage.operators import claims as C


def read(spark, text, locale, number_words=False):
    r = spark.createDataFrame([(text, locale)], "t string, l string").select(C.quantities(F.col("t"), F.col("l"), number_words).alias("q")).first().q
    return [(x.value, x.unit) for x in r.found], r.unread


@pytest.mark.parametrize(
    ("text", "locale", "found"),
    [
        ("The price is 1.500,50 pesos.", "es-ES", [(1500.5, "MXN")]),
        ("The price is 1,500.50 pesos", "en-US", [(1500.5, "MXN")]),
        ("1.500 pesos", "en-US", [(1.5, "MXN")]),
        ("un 15 por ciento, o 15%", "es-ES", [(15.0, "%"), (15.0, "%")]),
        ("₹1,50,000 is 1.5 lakh rupees", "en-IN", [(150000.0, "INR"), (150000.0, "INR")]),
        ("अधिकतम राशि ₹२,००,००० है।", "hi-IN", [(200000.0, "INR")]),
        ("from 01/04/2025 on", "en-IN", [(20250401.0, "DATE"), (2025.0, None)]),
        ("from 01/04/2025 on", "en-US", [(20250104.0, "DATE"), (2025.0, None)]),
        ("April 1, 2025 and 3 de mayo de 2024", "es-MX", [(20240503.0, "DATE"), (2024.0, None), (20250401.0, "DATE"), (2025.0, None)]),
        ("2025-02-30 or 2025-13-01", "en-US", [(20250230.0, "DATE"), (2025.0, None)]),
        ("$5 and Rs. 7 and 3 million euros", "es-MX", [(5.0, "MXN"), (7.0, "INR"), (3000000.0, "EUR")]),
        ("2 mil millones de euros", "es-ES", [(2e9, None)]),
        ("10 000 EUR", "en-US", [(10000.0, "EUR")]),
        (None, "en-US", []),
    ],
)
def test_quantities(spark, text, locale, found):
    assert read(spark, text, locale) == (found, False)


def test_unread_numbers_and_words(spark):
    assert read(spark, "version 1.2.3", "en-US") == ([], True)
    assert read(spark, "a three-day trip for two", "en-US", True) == ([(3.0, None), (2.0, None)], False)


@pytest.mark.parametrize(("text", "value"), [("(2 + 3) * -4 / (1 - 3)", 10.0), ("85*3", 255.0), ("2*(3", None), ("1/0", None), ("2 ** 3", None), ("", None), (None, None), ("--2", 2.0), ("1.2.3", None), ("(" * 5000, None)])
def test_evaluated(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(C.evaluated("t").alias("e")).first().e
    assert got.value == value and (value is None) == (got.operands is None)


SENTENCES = [
    ("S1.1", "Employees travelling to Madrid may claim a per-diem of €85 per day.", "en-US", "T", "4.2", 1), ("S1.2", "The per-diem covers meals and local transport.", "en-US", "T", "4.2", 2),
    ("S1.3", "Contractors are not eligible for per-diem allowances.", "en-US", "T", "4.2", 3), ("S1.4", "Employees may book business class for flights longer than 6 hours.", "en-US", "T", "4.3", 1),
    ("S2.1", "La dieta diaria para Ciudad de México es de 1.500,50 pesos.", "es-ES", "ES", "2.1", 1), ("S3.1", "The relocation allowance is ₹1,50,000.", "en-IN", "IN", "1.1", 1),
    ("S3.2", "अधिकतम राशि ₹२,००,००० है।", "hi-IN", "IN5", "1.1", 1), ("S3.3", "The policy is effective from 01/04/2025.", "en-IN", "IN", "0.1", 1), ("S4.1", "Employees get 24 days of annual leave.", "en-US", "L", "3.1", 1),
    ("S4.2", "This does not apply to staff on fixed-term contracts in India, who get 18 days.", "en-US", "L", "3.1", 2), ("S4.3", "Employees must submit expense reports within 30 days.", "en-US", "L", "3.4", 1),
]
TRIP = "How much do I get for a three-day trip?"
# cite, claim, locale, calc, question, score, judge, accepted, first reason
CASES = [
    ("S1.1", "Employees travelling to Madrid can claim a per-diem of €85 per day.", "en-US", None, None, 0.97, True, True, None),
    ("S1.1", "Employees travelling to Madrid can claim €95 per day.", "en-US", None, None, 0.99, True, False, "quantity not in evidence: 95 EUR"),
    ("S9.9", "Employees can claim €85 per day.", "en-US", None, None, 0.97, True, False, "a citation is not in the context"),
    ("", "Employees can claim €85 per day.", "en-US", None, None, 0.97, True, False, "no citation"),
    ("S1.3", "Contractors are eligible for per-diem allowances.", "en-US", None, None, 0.99, True, False, "negation dropped"),
    ("S1.2", "The per-diem doesn't cover meals.", "en-US", None, None, 0.99, True, False, "negation added"),
    ("S1.4", "Employees must book business class for flights longer than 6 hours.", "en-US", None, None, 0.97, True, False, "obligation added"),
    ("S4.3", "Employees can submit expense reports within 30 days.", "en-US", None, None, 0.97, None, False, "obligation became permission"),
    ("S4.3", "Employees can submit expense reports within 30 days.", "en-US", None, None, 0.97, True, True, "obligation became permission"),
    ("S1.1", "Contractors travelling to Madrid can claim €85 per day.", "en-US", None, None, 0.97, True, False, "scope swapped: contractor"),
    ("S1.2", "The per-diem covers meals in Pune.", "en-US", None, None, 0.97, False, False, "scope added: pune"),
    ("S2.1", "The daily allowance for Mexico City is 1,500.50 pesos.", "en-US", None, None, 0.97, True, True, None),
    ("S2.1", "The daily allowance for Mexico City is 1.500 pesos.", "en-US", None, None, 0.97, True, False, "quantity not in evidence: 1.5 MXN"),
    ("S3.1", "The relocation allowance is 1.5 lakh rupees.", "en-IN", None, None, 0.97, True, True, None),
    ("S3.2", "The maximum amount in India is ₹2,00,000.", "en-IN", None, None, 0.97, True, True, None),
    ("S3.2", "The maximum amount in India is ₹20,000.", "en-IN", None, None, 0.97, True, False, "quantity not in evidence: 20000 INR"),
    ("S3.3", "The policy is effective from April 1, 2025.", "en-US", None, None, 0.97, True, True, None),
    ("S3.3", "The policy is effective from January 4, 2025.", "en-US", None, None, 0.97, True, False, "quantity not in evidence: 20250104 DATE"),
    ("S1.1", "Employees on a three-day trip to Madrid get €255.", "en-US", "85*3=255", TRIP, 0.97, True, True, None),
    ("S1.1", "Employees on a three-day trip to Madrid get €265.", "en-US", "85*3=265", TRIP, 0.97, True, False, "calculation says 265, recomputed 255"),
    ("S1.1", "Employees on a trip to Madrid get €255.", "en-US", "85*(4-1)=255", TRIP, 0.97, True, False, "calculation with a number that is not in the evidence or the question"),
    ("S1.1", "Employees on a three-day trip to Madrid get €255.", "en-US", None, TRIP, 0.97, True, False, "quantity not in evidence: 255 EUR"),
    ("S1.2", "The per-diem covers meals and local transport.", "en-US", None, None, 0.31, True, False, "entailment too low"),
    ("S1.2", "The per-diem covers meals and local transport.", "en-US", None, None, 0.80, True, True, "accepted by judge"),
    ("S1.2", "The per-diem covers meals and local transport.", "en-US", None, None, 0.80, False, False, "rejected by judge"),
    ("S1.2", "The per-diem covers meals and local transport.", "en-US", None, None, None, True, False, "no entailment score"),
]
CLAIM = "answer_id long, cid string, nth int, text string, locale string, cites array<string>, qualifies string, calc string, question string, score double, answer boolean"


def context(spark, answers):
    rows = [(a, *s, ["india"] if s[0] == "S3.2" else None) for a in range(answers) for s in SENTENCES]
    return spark.createDataFrame(rows, "answer_id long, sid string, text string, locale string, doc_id string, section string, ordinal int, doc_scope array<string>")


MODELS = (lambda premise, claim: F.col("score"), lambda premise, claim: F.col("answer"))


def test_claims_are_checked_in_order(spark):
    rows = [(k, "C1", 1, text, locale, [cite] if cite else [], None, calc, question, score, judge) for k, (cite, text, locale, calc, question, score, judge, _, _) in enumerate(CASES)]
    found = C.verify_claims(spark.createDataFrame(rows, CLAIM), context(spark, len(rows)), *MODELS)
    got = {r.answer_id: (r.accepted, r.reasons[0] if r.reasons else None) for r in found.collect()}
    assert [got[k] for k in range(len(CASES))] == [x[-2:] for x in CASES]
    assert found.columns[-3:] == ["accepted", "reasons", "nli"]


def test_answers_and_what_limits_them(spark):
    ok, bad = "Employees travelling to Madrid can claim a per-diem of €85 per day.", "Employees travelling to Madrid can claim €95 per day."
    row = lambda a, n, text, cite, q=None: (a, f"C{n}", n, text, "en-US", [cite], q, None, None, 0.97, True)
    rows = [
        row(0, 1, "Employees get 24 days of annual leave.", "S4.1"),
        row(1, 1, ok, "S1.1"), row(1, 2, "Contractors are eligible for the per-diem.", "S1.3", "C1"),
        row(2, 1, bad, "S1.1"), row(2, 2, "Contractors are not eligible for per-diem allowances.", "S1.3", "C1"), row(2, 3, "The per-diem covers meals and local transport.", "S1.2", "C2"),
    ]
    answers, found = C.verify_answers(spark.createDataFrame(rows, CLAIM), context(spark, 3), *MODELS)
    assert sorted(map(tuple, answers.collect())) == [(0, "VERIFIED"), (1, "PARTIAL"), (2, "DROPPED")]
    got = {(r.answer_id, r.cid): (r.accepted, r.limits_shown, r.reasons[-1:]) for r in found.collect()}
    assert got[0, "C1"] == (True, ["S4.2"], []) and got[1, "C1"] == (True, ["S1.3"], [])
    assert got[2, "C2"] == (False, [], ["dropped with C1"]) and got[2, "C3"] == (False, [], ["dropped with C2"])


def test_texts_are_searched_once_and_after_the_shuffle(spark):
    row = (0, "C1", 1, "Employees get 24 days.", "en-US", ["S4.1"], None, None, None, 0.97, True)
    found = C.verify_claims(spark.createDataFrame([row], CLAIM), context(spark, 1), *MODELS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\wऀ-ॿ']+") <= 6  # signs and number words of the sentence and the claim, before some 180
    assert plan.index("RepartitionByExpression") < plan.rindex("transform(")
    assert plan.rindex("[\\wऀ-ॿ']+") < plan.rindex("RepartitionByExpression")  # below it texts are as they were


@pytest.mark.parametrize(
    ("text", "locale", "found"),
    [
        ("\x012\x023 and $4\x01", "en-US", [(2.0, None), (3.0, None), (4.0, "USD")]),
        ("1 enero 2 febrero 2024 and 2024-05-06", "es-ES", [(20240506.0, "DATE"), (2024.0, None), (20240202.0, "DATE"), (2024.0, None), (1.0, None)]),
        ("up to 1234 items on 3 may 2024", "en-US", [(20240503.0, "DATE"), (2024.0, None), (1234.0, None)]),
        ("may 3 2024, 1 234,5 €", "es-ES", [(20240503.0, "DATE"), (2024.0, None), (1234.5, "EUR")]),
        ("rs. 5 crore, 6 % and 7", "en-IN", [(50000000.0, "INR"), (6.0, "%"), (7.0, None)]),
    ],
)
def test_quantities_from_one_search(spark, text, locale, found):
    assert read(spark, text, locale) == (found, False)


def test_statuses_need_no_limits(spark):
    row = (0, "C1", 1, "Employees get 24 days of annual leave.", "en-US", ["S4.1"], None, None, None, 0.97, True)
    answers, found = C.verify_answers(spark.createDataFrame([row], CLAIM), context(spark, 1), *MODELS)
    analysed = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "limits" not in analysed(answers) and "limits_shown" in analysed(found)
    assert answers.first().status == "VERIFIED"
