from pyspark.sql import functions as F

from vantage.operators import evidence as V


def test_sentences_keep_abbreviations_and_numbers(spark):
    rows = [
        (1, "en", 'It costs approx. 3.5 units, e.g. i.e. here. "Really?" Yes.\n\tNo end'),
        (2, "hi", "एक वाक्य। दूसरा वाक्य।"), (3, "es", "La sra. López vino. ¿Sí?"), (4, "en", None), (5, "en", "  "), (6, None, "A. B."),
    ]
    df = spark.createDataFrame(rows, "k int, lang string, t string")
    found = {r.k: r.s for r in df.select("k", V.sentences(F.col("t"), F.col("lang")).alias("s")).collect()}
    assert found[1] == ["It costs approx. 3.5 units, e.g. i.e. here.", '"Really?"', "Yes.", "No end"]
    assert found[2] == ["एक वाक्य।", "दूसरा वाक्य।"]
    assert found[3] == ["La sra. López vino.", "¿Sí?"]
    assert found[4] == found[5] == [] and found[6] == ["A.", "B."]


def test_chunks_hold_whole_sentences_in_order(spark):
    text = " ".join("However w w." if k % 7 == 3 else " ".join(["w"] * (k % 9 + 1)) + "." for k in range(300)) + " " + " ".join(["x"] * 40) + "."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "One.")], "doc_id long, text string")
    out = V.sentence_chunks(df, target=20, most=26).orderBy("doc_id", "chunk").collect()
    mine = [r for r in out if r.doc_id == 1]
    assert " ".join(r.chunk_text for r in mine) == text
    assert all(r.n_tokens == len(r.chunk_text.split()) for r in mine)
    assert all(r.n_tokens <= 26 for r in mine[:-1]) and mine[-1].n_tokens == 40
    assert any(r.n_tokens > 20 for r in mine[:-1])
    for r in mine[:-1]:
        if r.n_tokens > 20:  # only a qualifier goes past the target
            assert r.chunk_text.split(". ")[-1].startswith("However")
    assert [r.chunk_text for r in out if r.doc_id != 1] == ["One."]


def test_recompute_and_check(spark):
    rows = [("2 * 3 + 8 / 4 - 1 = 7",), ("2 - 3 - 4 = -5",), ("-2 * 3 = -6",), ("8 / 0 = 1",), ("(2) = 2",), ("2 * 3",), ("2 * 3 = 7",), ("2 + 9 = 11",), ("2 - -3 = 5",), (None,), ("",), ("2 = ",)]
    df = spark.createDataFrame(rows, "c string")
    evidence = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 8)])
    found = [(r.v, r.s) for r in df.select(V.recompute(F.split("c", "=")[0]).alias("v"), V.check_calc(F.col("c"), evidence).alias("s")).collect()]
    assert [v for v, _ in found] == [7, -5, -6, None, None, 6, 6, 11, 5, None, None, 2]
    assert [s for _, s in found][:9] == ["pass"] * 3 + ["does not evaluate"] * 2 + ["no result", "wrong result", "operand not in evidence", "pass"]
    assert found[10][1] == "no result" and found[11][1] == "does not evaluate"


def test_verify_fails_closed(spark):
    evidence = spark.createDataFrame([(1, "you must pay 30 euro in 5 days"), (2, "no refund is given")], "cite int, sentence string")
    claims = [
        (1, 9, "pay", None), (2, 1, "you must pay 40 euro", True), (3, 2, "refund is given", True), (4, 2, "no refund must be given", True), (5, 1, "you must pay 30 euro", None),
        (6, 1, "some other words entirely", True), (7, 1, "you must send money in days", True), (8, 1, "you must send money in days", None), (9, 1, "", True), (10, None, None, None),
    ]
    out = V.verify(spark.createDataFrame(claims, "claim_id int, cite int, claim string, judge boolean"), evidence)
    assert [r.status for r in out.orderBy("claim_id").collect()] == [
        "no citation", "quantity not in evidence", "polarity differs", "obligation added", "supported", "rejected", "supported by judge", "rejected by judge", "rejected", "no citation",
    ]
