"""Catalogue expressions on awkward values, worked out by hand."""

from pyspark.sql import functions as F

from quern.operators import catalogue as C


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_fields_and_authors(spark):
    assert one(spark, C.clean_field(F.lit(" a\n\tb\x00c� "))) == "a b c"
    assert one(spark, C.clean_field(F.lit(None).cast("string"))) == ""
    assert one(spark, C.authors_of(F.lit("B. Ray; ; A. Ray;B. Ray"))) == ["B. Ray", "A. Ray"]
    assert one(spark, C.authors_of(F.lit(None).cast("string"))) == [C.UNKNOWN]
    assert one(spark, C.year_of(F.lit(" 1987 "))) == 1987
    assert one(spark, C.year_of(F.lit("1787"))) is None
    assert one(spark, C.citation(F.array(F.lit("A"), F.lit("B")), F.lit(None).cast("int"), F.lit("T"))) == "A et al. (s.d.) — T"


def test_pages_and_audits(spark):
    pages = lambda a, b: one(spark, C.page_list(F.lit(a).cast("int"), F.lit(b).cast("int")))
    assert pages(3, 5) == [3, 4, 5] and pages(3, 1) == [3] and pages(3, None) == [3] and pages(0, 4) == [] and pages(None, 4) == []
    cites = F.array(*[F.lit(c) for c in "abcd"])
    stands = lambda named, bad=False: one(spark, C.audited(cites, F.array(*[F.lit(n) for n in named]).cast("array<string>"), F.lit(bad)))
    assert stands(["F2", " f4 "]) == ["b", "d"]
    assert stands([]) == ["a", "b", "c"] and stands([], True) == []
    assert stands(["F99999999999", "one"]) == ["a", "b", "c", "d"]


def test_texts_and_states(spark):
    assert one(spark, C.without_noise(F.lit("a\nHTTP 429\nRate Limit hit\nb"))) == "a\nb"
    assert one(spark, C.standing(F.lit(None).cast("string"))) == "ativo"
    assert one(spark, C.truth(F.lit(" SIM "))) is True and one(spark, C.truth(F.lit(None).cast("string"))) is False
    assert one(spark, C.listed(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, C.tag(F.lit(" #Visão Geral! "))) == "visao-geral"
    assert one(spark, C.note_title(F.lit("??"))) == "Nota sem titulo"
    assert one(spark, C.found_title(F.lit("short\n  a line that is long enough \n"))) == "a line that is long enough"
    assert one(spark, C.found_year(F.lit("in 1989, 12040 and 2031"))) == "2031"
    assert one(spark, C.shown_number(F.lit(None).cast("double"), 3)) == "-" and one(spark, C.shown_p(F.lit(0.00001))) == "p<0.0001"
    assert one(spark, C.trial_fault(F.lit("F8L"))) is None and one(spark, C.trial_mode(F.lit("F3L.csv"))) == "L"
    assert one(spark, C.context_lines([("A", F.lit(None).cast("string"), 5), ("B", F.lit("abcdefg"), 5)])) == "B: abcde"


def test_differences_and_lists(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert {tuple(r) for r in C.differences(a, b).collect()} == {(3, "missing"), (1, "unexpected"), (None, "unexpected")}
    assert C.differences(a, a).count() == 0
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3)], "g int, s string, o int")
    assert [r["line"] for r in C.cited(rows, ["g"], "s", "o").orderBy("place").collect()] == ["1. b", "2. a"]
    kept = C.snippets(spark.createDataFrame([(2, "t"), (1, "t"), (3, None)], "o int, t string"), "t", ["o"]).collect()
    assert [(r["o"], r["uses"]) for r in kept] == [(1, 2)]
