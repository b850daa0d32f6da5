import pytest
from pyspark.sql import functions as F

from kinfold.functions import text


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", f(F.col("s")).alias("o")).orderBy("i").collect()]


def test_ascii(spark):
    assert one(spark, text.to_ascii, "Café Zürich", "ﬁn ½", "straße ł", None, "") == ["Cafe Zurich", "fin 12", "strae ", None, ""]


def test_acronyms(spark):
    assert one(spark, text.collapse_acronyms, "l.l.p.", "u.s.a. inc", "a.b.cd", "x. y.") == ["llp", "usa inc", "a.b.cd", "x. y."]


def test_aliases(spark):
    assert one(spark, text.drop_aliases, "foo f/k/a bar", "foo dba bar", "foo aka bar", "fab a") == ["foo   bar", "foo   bar", "foo   bar", "fab a"]


def test_joined_and_stray(spark):
    f = lambda c: text.prune_stray(text.split_joined(c))
    assert one(spark, f, "su-security", "12-a", "a-1", "2702/1313", "a - b") == ["su security", "12-a", "a-1", "2702/1313", "a   b"]


def test_zeros_and_leet(spark):
    assert one(spark, text.strip_zeros, "004303", "000", "0", "a01") == ["4303", "0", "0", "a01"]
    assert one(spark, text.undo_leet, "c0mpany", "2nd", "e18", "109th", "2eme", "abc-1") == ["company", "2nd", "e18", "109th", "2eme", "abc-i"]


def test_names(spark):
    assert one(spark, text.normalize_name, "Sharma Traders Pvt Ltd", "Ltd Co", "A & B", None, "New York Foods, Inc.") == ["sharma traders", "ltd co", "a b", "", "ny foods"]


def test_addresses(spark):
    assert one(spark, text.normalize_address, "Shop No. 4, MG Rd, Alabama", "CT", "Connecticut", "Flat", "St. Louis") == ["4 mg road al", "court", "ct", "", "street louis"]


def test_number_parts(spark):
    assert one(spark, text.number_parts, "2702/1313 main 109th 5", "") == [["2702", "1313", "109"], []]


def test_block_text_and_pairs(spark):
    df = spark.createDataFrame([("a b c", ""), ("x", "12/34 road")], "n string, a string")
    rows = df.select(text.block_text(F.col("n"), F.col("a")).alias("b"), text.word_pairs(text.words_of(F.col("n"))).alias("p")).collect()
    assert [(r.b, r.p) for r in rows] == [("a b c ", ["a_b", "b_c"]), ("x 12/34 road 12 34", [])]


@pytest.mark.parametrize("ascii_only", [True, False])
def test_empty_table(spark, ascii_only):
    df = spark.createDataFrame([], "business_name string, business_address string")
    assert text.add_normalized(df, ascii_only).collect() == []


def test_letters_of_other_scripts_are_spelled():
    cases = {"कंपनी": "knpni", "दिल्ली": "dilli", "மதுரை": "mturai", "Москва": "Moskva", "Щука": "Shchuka", "Αθήνα": "Athina", "Σοφία": "Sophia", "१२३": "123", "Café №5": "Cafe No5", "東京 x": " x", "straße": "strae", "": ""}
    assert {x: text.spell_ascii(x) for x in cases} == cases
