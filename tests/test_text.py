import re

from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.functions.vector import cosine_similarity
from docmill.sources.route import source_kind

CASES = ["", "  ", "a b", " a\x1cb c​d\x85e", "# T\nx", "😀 é\t\r\n z", "a\x1e", None]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_words_strip_and_blank_follow_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string")
    rows = df.select("t", tx.word_count("t"), tx.strip("t"), tx.is_blank("t"), tx.char_count("t")).collect()
    for t, words, stripped, blank, chars in rows:
        if t is None:
            assert (words, stripped, blank, chars) == (None, None, True, None)
        else:
            assert (words, stripped, blank, chars) == (len(t.split()), t.strip(), not t.strip(), len(t))


def test_title_rules_differ(spark):
    def both(t):
        return tuple(one(spark, t, tx.title_in_first_lines("t"), tx.title_anywhere("t")))

    assert both("# A\nb") == ("A", "A")
    assert both("x\n" * 9 + "# Ten") == ("Ten", "Ten")
    assert both("x\n" * 10 + "# Eleven") == ("Untitled", "Eleven")
    assert both("#\n\nFoo") == ("Untitled", "Foo")
    assert both("none") == ("Untitled", None)
    assert both("# N M x \r\nz") == ("N M x", "N M x")
    assert both("  # in\n") == ("in", "in")


def test_header_text(spark):
    for t in ("a\n## H x\n b\n#no\n# \nend", "# x", "#\ny\nz", ""):
        assert one(spark, t, tx.strip_header_lines("t"))[0] == re.sub(r"^#+\s.*$", "", t, flags=re.M).strip()
    headers = F.create_map(F.lit("Header 3"), F.lit("c"), F.lit("Header 1"), F.lit("a"))
    assert one(spark, "", tx.header_lines(headers))[0] == "# a\n### c\n"
    keys = one(spark, "", tx.header_keys(2))[0]
    assert [tuple(k) for k in keys] == [("#", "Header 1"), ("##", "Header 2")]


def test_sentences_and_nul(spark):
    assert one(spark, "A b. C? D!\nE", tx.sentences("t"))[0] == ["A b.", "C?", "D!", "E"]
    assert one(spark, "a\0b", tx.remove_nul("t"))[0] == "ab"


def test_routing(spark):
    cases = {"HTTP://x/a.pdf": "html", "a.PDF": "pdf", "a.docx": "unsupported", "ftp://x": "unsupported", "https://": "html"}
    for source, kind in cases.items():
        assert one(spark, source, source_kind("t"))[0] == kind


def test_cosine(spark):
    a, b, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0))
    got = one(spark, "", cosine_similarity(a, b), cosine_similarity(a, z))
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] is None
