from eventlens.operators.html import CLEANING_DROP, EMPTY_INPUT, LANDING_DROP, extract_text, html_to_text


def test_body_and_dropped_subtrees():
    html = ("<html><head><title>T</title><style>p{}</style></head><body><p>November 12<b>,</b>2025.</p>"
            "<table><tr><td>cell<table><tr><td>inner</td></tr></table>more</td></tr></table>"
            "<!-- c --><script>var t='</p>';</script><p>A &amp; B</p>\n\n<p>  </p></body></html>")
    assert extract_text(html, CLEANING_DROP) == "November 12\n,\n2025.\nA & B"
    assert extract_text(html, LANDING_DROP) == "November 12\n,\n2025.\ncell\ninner\nmore\nA & B"


def test_document_tag_wins_and_plain_text():
    html = "<body>outside<document>inside <i>doc</i></document></body>"
    assert extract_text(html) == "inside\ndoc"
    assert extract_text("  plain\n\n  text  ") == "plain\n\n  text".replace("\n\n", "\n")
    assert extract_text("   ") == EMPTY_INPUT and extract_text(None, empty_value=None) is None


def test_stray_end_tag_and_unclosed_table():
    assert extract_text("<body>a</div>b<table>gone") == "a\nb"


def test_html_job(spark):
    df = spark.createDataFrame([(1, "<p>x</p><p>y</p>"), (2, "")], "id long, html string")
    got = {r.id: r.text for r in html_to_text(df, "html", "text").collect()}
    assert got == {1: "x\ny", 2: EMPTY_INPUT}


def test_cdata_is_its_own_text_node():
    assert extract_text("<body>a<![CDATA[ x < y ]]>b</body>") == "a\nx < y\nb"


def test_entity_references():
    got = extract_text("<body><p>a &amp; b &amp c &copy;2024 &copy2024 &#233;&#x41; &foo bar</p></body>")
    assert got == "a & b & c ©2024 &copy2024 éA &foo bar"
