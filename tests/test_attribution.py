import pytest
from pyspark.sql import functions as F

from corvane.functions.phonetics import metaphone
from corvane.operators import attribution


@pytest.mark.parametrize("word, code", [("KNIGHT", "NT"), ("PHONE", "FN"), ("WRITE", "RT"), ("SHIP", "XP"), ("THUMB", "0M"), ("BRIDGE", "BRJ"), ("XENON", "SNN"), ("SCHOOL", "SKL"), ("NATION", "NXN"), ("SCIENCE", "SNS"), ("CITY", "ST"), ("42", "")])
def test_metaphone(word, code):
    assert metaphone(word) == code


def test_contributions_of_the_additive_score(spark):
    row = {"a": "1", "b": "2", "name_sim": 0.97, "pan_token_a": "p", "pan_token_b": "q", "gstin_token_a": None, "gstin_token_b": "g", "district_a": "d", "district_b": "d", "pincode_a": "1", "pincode_b": "2", "phone_a": "9", "phone_b": "9", "legal_a": "LLP", "legal_b": "HUF"}
    ev = spark.createDataFrame([row], ", ".join(f"{c} {'double' if c == 'name_sim' else 'string'}" for c in row))
    got = [tuple(r) for r in attribution.additive(ev).orderBy("place").select("feature", "contribution", "direction", "bar_pct").collect()]
    assert got == [("PAN Token Conflict", -0.4, "negative", 40), ("Name Similarity", 0.291, "positive", 29), ("District Match", 0.05, "positive", 5), ("Phone Match", 0.05, "positive", 5), ("Legal Status Conflict", -0.1, "negative", 10)]
    zero = attribution.additive(ev.withColumn("name_sim", F.lit(0.0))).filter("feature = 'Name Similarity'").first()
    assert (zero.contribution, zero.direction, zero.bar_pct) == (0.0, "positive", 0)
