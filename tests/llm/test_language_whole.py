import pytest
from pyspark.sql import functions as F
from test_language import DE, EN, FR, model  # noqa: F401

from corpusloom.llm import language as L


def test_trust_is_counted_over_all_texts(spark, model):  # noqa: F811
    """Texts that a sample drawn by a hash of the id would leave out are the only ones that change their language."""
    ids = spark.range(13_000).select(F.lit("t").alias("tbl"), F.col("id").alias("rec_id"))
    out = F.pmod(F.xxhash64("tbl", "rec_id", F.lit(19)), F.lit(2)) == 1
    df = ids.select("*", F.when(out, f"{EN} {DE}").otherwise(EN).alias("text"), F.lit("en").alias("declared"), F.lit("").alias("host"), F.lit(None).cast("string").alias("address"))
    assert L.fit_priors(df, model)[1] > 0.9


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """English texts, half of them with a word that the other half lacks, many with French in them, few that are French."""
    d = str(tmp_path_factory.mktemp("whole"))
    out = F.pmod(F.xxhash64("row_idx", F.lit(11)), F.lit(2)) == 1
    i = F.col("row_idx")
    text = F.when(i >= 4100, FR).when(out, "The zzyzx of the harbour is near the lantern.").otherwise(f"The lantern answers slowly. {FR}")
    said = F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content")), F.struct(F.lit("assistant").alias("role"), text.alias("content")))
    spark.range(4150).select(F.col("id").alias("row_idx")).select("row_idx", said.alias("messages"), F.when(i >= 4100, "fr").otherwise("en").alias("lang")).write.parquet(f"{d}/train_samples.parquet")
    return L.fit_whole(spark, d), L.fit_model(spark, d)


def test_words_are_counted_over_all_replies(whole):
    assert "zzyzx" in whole[0].weights and "zzyzx" not in whole[1].weights


def test_mixed_texts_count_by_sentence(whole):
    assert [s[0] for s in whole[0].segments(f"The lantern answers slowly. {FR}")] == ["en", "fr"]
    assert whole[0].weights["lantern"][0] == 0 and whole[0].weights["guitare"][2] == 0
