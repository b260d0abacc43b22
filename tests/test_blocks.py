"""Blocks, heading paths and chunks of a page, and bounds over the given pages."""

from pyspark.sql import functions as F

from vantage.operators import blocks as B

TABLE = "<table><tr><th>Grade</th><th>Limit</th></tr>" + "".join(f"<tr><td>G{k}</td><td>{k} euros a day</td></tr>" for k in range(6)) + "</table>"
PAGE = (
    "<html><head><title>Out</title></head><body><nav><p>Menu</p></nav><h1>Policy</h1><p>All staff may travel. However, interns &amp; guests may not.</p><h2>Limits</h2><p>One two three four five six. Seven eight.</p>"
    f"<h3>By grade</h3>{TABLE}<h2>Forms</h2><p>You need:</p><ul><li>a form</li><li>a <b>signed</b> copy</li></ul><pre>\nfirst = 1\n\nsecond = 2\n</pre><!-- gone --><footer>End</footer></body></html>"
)


def made(spark, pages, **bounds):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [tuple(r) for r in B.block_chunks(df, **bounds).orderBy("page_id", "chunk").collect()]


def test_blocks_have_kinds_and_paths(spark):
    found = spark.createDataFrame([(PAGE,)], "h string").select(B.with_headings(B.blocks(F.col("h"))).alias("b")).first().b
    assert [(x.kind, [h.title for h in x.path], x.section) for x in found] == [
        ("p", ["Policy"], 1), ("p", ["Policy", "Limits"], 2), ("table", ["Policy", "Limits", "By grade"], 2),
        ("p", ["Policy", "Forms"], 3), ("li", ["Policy", "Forms"], 3), ("li", ["Policy", "Forms"], 3), ("pre", ["Policy", "Forms"], 3),
    ]
    assert found[0].text == "All staff may travel. However, interns & guests may not." and found[5].text == "a signed copy" and found[6].text == "first = 1\n\nsecond = 2"
    assert found[2].text.split("\n")[:2] == ["Grade | Limit", "G0 | 0 euros a day"]


def test_chunks_keep_units_whole(spark):
    rows = made(spark, [PAGE, None, "", "<p>Alone</p>"], target=12, least=1, most=20)
    assert rows == [
        (0, 0, "Policy", 10, "All staff may travel.\nHowever, interns & guests may not."),
        (0, 1, "Policy › Limits", 8, "One two three four five six.\nSeven eight."),
        (0, 2, "Policy › Limits › By grade", 9, "Grade | Limit\nG0 | 0 euros a day"),
        *[(0, 2 + k, "Policy › Limits › By grade", 9, f"Grade | Limit\nG{k} | {k} euros a day") for k in range(1, 6)],
        (0, 8, "Policy › Forms", 9, "You need:\n- a form\n- a signed copy"),
        (0, 9, "Policy › Forms", 6, "first = 1\n\nsecond = 2"),
        (3, 0, "", 1, "Alone"),
    ]
    glued = made(spark, ["<p>One two three. However, four five six seven. Eight.</p>"], target=5, least=1, most=9)
    assert [r[4] for r in glued] == ["One two three.\nHowever, four five six seven.", "Eight."]


def test_small_sections_join_the_next_and_long_units_stand_alone(spark):
    page = "<h2>A</h2><p>See B.</p><h2>B</h2><p>Text of b.</p><h2>C</h2><p>" + "word " * 30 + ".</p><pre>a b c\n\n\n" + "x " * 12 + "\n\nd e</pre>"
    rows = made(spark, [page], target=10, least=4, most=12)
    assert [(r[2], r[3]) for r in rows] == [("A", 5), ("C", 31), ("C", 3), ("C", 12), ("C", 2)]


def test_chunks_of_the_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    target, least, most = 40, 15, 60
    text = {}
    for r in df.select("page_id", F.explode(B.with_headings(B.blocks(F.col("html")))).alias("b")).select("page_id", "b.*").orderBy("page_id", "pos").collect():
        text.setdefault(r.page_id, []).extend(r.text.split())
    chunks = {}
    for r in B.block_chunks(df, target=target, least=least, most=most).orderBy("page_id", "chunk").collect():
        chunks.setdefault(r.page_id, []).append(r)
    assert text and chunks.keys() == text.keys()
    for page, rows in chunks.items():
        assert [r.chunk for r in rows] == list(range(len(rows)))
        assert [w for r in rows for w in r.chunk_text.split() if w != "-"] == [w for w in text[page] if w != "-"]  # nothing is lost, in order
        assert all(r.n_tokens <= most or "\n" not in r.chunk_text for r in rows)
