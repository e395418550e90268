import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import text as T
from tidemark.functions import udfs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (T.deleet, "1337", "ieet"),
        (T.deleet, "cr00si0us", "croosious"),
        (T.deleet, "}{ello", "hello"),
        (T.skeleton, "", ""),
        (T.skeleton, "aeiou", ""),
        (T.skeleton, "bobby", "by"),
        (T.shorten_runs, "aaab", "aab"),
        (T.clean_body, ">implying\nSome \t TEXT  here", "implying some text here"),
        (T.strip_html, "a&lt;b&gt;c<br>d", "a c d"),
        (T.latinise, "Аx", "Ax"),
        (T.reply_ids, "no", []),
        (T.reply_ids, ">>12 >>99999999999999999999", [12]),
        (T.split_list, " a ; ;b", ["a", "b"]),
        (S.complete_date, "2001-02", "2001-02-01"),
        (S.digits_int, "12 (3)", 123),
        (S.lenient_int, "99999999999999999999", None),
        (S.lenient_int, "-3", None),
    ],
)
def test_scalar(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_tokens_keep_underscore(spark):
    assert one(spark, "one two three_four", T.tokens) == ["one", "two", "three_four"]


def test_sigmoid(spark):
    assert one(spark, 0.0, S.sigmoid, "double") == 0.5
    assert 0 < one(spark, 1000.0, S.sigmoid, "double") <= 1
    assert 0 <= one(spark, -1000.0, S.sigmoid, "double") < 1e-100


@given(st.text("abcé", max_size=8), st.text("abcé", max_size=8))
@settings(max_examples=200)
def test_indel_is_symmetric_and_matches_dynamic_programme(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert udfs.lcs(a, b) == table[-1][-1] == udfs.lcs(b, a)


def test_skeleton_property(spark):
    words = ["".join(p) for p in __import__("itertools").product("abye", repeat=5)]

    def plain(w):
        out, last = "", ""
        for c in w:
            if c not in "aeiou" and c != last:
                out += c
                last = c
        return out

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.skeleton(F.col("w")).alias("s")).collect()
    assert all(r.s == plain(r.w) for r in rows)


def test_html_strip_leaves_unfinished_references(spark, tmp_path):
    import duckdb

    from tidemark.plans import catalogue

    pages = [(1, "<p>a &amp; b&amp"), (2, "&copy;x&quo"), (3, "&amp;copy; &quot"), (4, "&nosuch; &am"), (5, "&middot &amp;amp;")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = [tuple(r) for r in catalogue.QUERIES["html_strip"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert found == db.execute(f"select * from ({catalogue.ORACLE_SQL['html_strip']}) order by page_id").fetchall()
    assert one(spark, "a&ampb", T.strip_html) == "a&b" and one(spark, "&#65;&#x42;&notit;", lambda c: T.strip_html(c, closed=True)) == "AB&notit;"
