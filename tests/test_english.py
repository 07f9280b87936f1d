import pytest
from pyspark.sql import functions as F

from tessera.functions import english as E
from tessera.operators import keyword


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consignment", "consign"), ("consistency", "consist"), ("knackeries", "knackeri"), ("knaves", "knave"), ("generously", "generous"), ("running", "run"),
        ("happy", "happi"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("national", "nation"), ("communication", "communic"), ("relational", "relat"), ("conditional", "condit"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"),
        ("agreed", "agre"), ("feed", "feed"), ("proceed", "proceed"), ("falling", "fall"), ("controll", "control"), ("say", "say"), ("by", "by"), ("data", "data"), ("stations", "station"), ("classification", "classif"), ("é", "é"), ("2024", "2024"),
    ],
)
def test_stem(word, stem):
    assert E.stem(word) == stem


def test_search(spark):
    rows = [(1, "Wind of changes", None, None, None, "dataset", "active"), (2, "changing the wind", None, None, None, "dataset", "active"), (3, "of the", None, None, None, "dataset", "active")]
    docs = spark.createDataFrame(rows, "id long, title string, subtitle string, description string, tags array<string>, resource_type string, status string")
    ask = lambda q: {r.id for r in keyword.keyword_search(docs, [q], analyzers=(E.english, E.query_words)).collect()}
    assert ask("change winds") == {1, 2}
    assert ask('"wind of change"') == {1} == ask('"winds the change"')  # a stop word keeps a place
    assert ask("of the") == set()
    assert ask("wind -changed") == set()


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("State-of-the-art Forecasting", [("state-of-the-art", "hyphenated"), ("state", "word"), ("of", "word"), ("the", "word"), ("art", "word"), ("forecasting", "word")]),
        ("Mail Ann.Lee+x@Mail.Example.org!", [("mail", "word"), ("ann.lee+x@mail.example.org", "email")]),
        ("see https://www.example.com/a/b?c=1, example.net", [("see", "word"), ("https", "word"), ("www.example.com/a/b?c=1,", "url"), ("www.example.com", "host"), ("/a/b?c=1,", "path"), ("example.net", "host")]),
        ("-12.5 +3 2024 1.2.3 3d covid-19 b2b", [("-12.5", "decimal"), ("+3", "integer"), ("2024", "integer"), ("1.2.3", "version"), ("3d", "word_number"), ("covid-19", "hyphenated_number"), ("covid", "word"), ("19", "integer"), ("b2b", "word_number")]),
        ("\u5929\u6c14 na\u00efve", [("\u5929\u6c14", "word"), ("na\u00efve", "word")]),
        ("", []),
        (None, []),
    ],
)
def test_token_classes(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(E.class_tokens(F.col("t"))).alias("t"))
    assert [tuple(r) for r in df.select("t", E.token_class(F.col("t"))).collect()] == found
    assert len(E.query_words(text or "")) == len(found)


def test_queries_are_analyzed_as_documents_are(spark):
    text = "State-of-the-art forecasting of -12.5 degrees at www.example.com/maps by ann@x.org, covid-19; 3D stations"
    df = spark.createDataFrame([(text,)], "t string").select(F.posexplode(E.class_tokens(F.col("t"))).alias("at", "word"))
    lexemes = {r.word: r.lexeme for r in E.dictionary(df.select("word").distinct()).collect()}
    assert [lexemes[r.word] for r in df.orderBy("at").collect()] == E.query_words(text)


def test_search_by_classes(spark):
    rows = [(1, "well-known stations", None, "mail ann@x.org", None, "dataset", "active"), (2, "known wells", None, "at -12.5 of www.example.com/maps", None, "dataset", "active"), (3, "well known", None, "12.5", None, "dataset", "active")]
    docs = spark.createDataFrame(rows, "id long, title string, subtitle string, description string, tags array<string>, resource_type string, status string")
    ask = lambda q: {r.id for r in keyword.keyword_search(docs, [q], analyzers=(E.english, E.query_words)).collect()}
    assert ask("well-known") == {1} and ask("known well") == {1, 2, 3} and ask('"well known"') == {1, 3}
    assert ask("ann@x.org") == {1} and ask("www.example.com") == {2} and ask("12.5") == {3} and ask("station") == {1}
