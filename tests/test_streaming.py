from pyspark.sql import functions as F

from kinfold.operators import blocking
from kinfold.plans import fixtures as fx
from kinfold.streaming import arrivals

SF = "/root/testdata/sf0.001"
COLUMNS = ["entity_id", "country", "business_name", "business_address"]


def test_arrivals_get_what_a_full_search_gives(spark, tmp_path):
    s1, index = fx.sides(spark, SF)
    keep = ["entity_id", "country", "terms"]
    counts = blocking.term_counts(index.select(keep))
    terms = blocking.vocabulary(index.select(keep), counts)
    weights = blocking.weights(blocking.term_counts(s1.select(keep)), terms)
    raw = fx.records(spark, SF).where("source <> 'S1'").select(COLUMNS)
    for k in (0, 1):
        raw.where(F.pmod(F.xxhash64("entity_id"), F.lit(2)) == k).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    arrivals.match_arrivals(stream, weights, terms, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = blocking.top_k(blocking.scored_pairs(s1.select(keep), index.select(keep)), blocking.REVERSE_K, "cand_id", "s1_id")
    rows = lambda df: sorted((r.s1_id, r.cand_id, r["rank"], round(r.score, 9)) for r in df.select("s1_id", "cand_id", "rank", "score").collect())
    assert got.select("batch").distinct().count() == 2 and rows(got) == rows(want)
