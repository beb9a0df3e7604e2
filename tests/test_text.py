from pyspark.sql import functions as F

from kinship.functions import text
from kinship.functions.romanize import romanized


def apply(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r[0] for r in df.select("i", f(F.col("c")).alias("o")).orderBy("i").select("o").collect()]


def test_normalised(spark):
    got = apply(spark, text.normalized, ["Orelee's", "O'Brien", "A&B", "  x_y  ", None, "", "Straße Nº4", "CAFÉ; bar", 'a"b'])
    assert got == ["orelees", "obrien", "a and b", "x y", "", "", "strasse nº4", "cafe bar", "a b"]


def test_name_key(spark):
    f = lambda c: text.name_key(text.normalized(c))
    got = apply(spark, f, ["Sun Constructions Pvt. Ltd.", "SUN CONSTRUCTIONS PRIVATE LIMITED", "Private Limited", "Office of Housing", "Office Of Housing", ""])
    assert got == ["constructions sun", "constructions sun", "private limited", "housing of office", "housing of office", ""]


def test_addresses(spark):
    f = lambda c: text.expanded(text.normalized(c))
    assert apply(spark, f, ["12 Main Rd, N", "5 St", ""]) == ["12 main road north", "5 st", ""]
    g = lambda c: text.address_key(f(c))
    assert apply(spark, g, ["12 Main Rd", "Rd Main 12", ""]) == ["12 main road", "12 main road", ""]


def test_numbers(spark):
    assert apply(spark, text.numbers, ["12B Main St, 560012, 12", "", None]) == ["12 12 560012", "", ""]


def test_romanised(spark):
    got = apply(spark, romanized, ["राम", "प्राइवेट लिमिटेड", "plain", None, "Éclair", "રામ", "రామ", "७१"])
    assert got == ["raam", "praaivett limittedd", "plain", None, "Eclair", "raam", "raam", "71"]


def test_flags_are_of_the_raw_text(spark):
    df = spark.createDataFrame([("S2-1", "राम", "x", "India")], "entity_id string, business_name string, business_address string, country string")
    assert text.normalize(df).first()["name_non_ascii"]
    assert not text.normalize(df, flags_after=True).first()["name_non_ascii"]
    assert text.normalize(df).first()["name_norm"] == "raam"


def test_record_columns(spark):
    df = spark.createDataFrame([("S3-1", "A Bc", None, "US")], "entity_id string, business_name string, business_address string, country string")
    r = text.record_columns(text.normalize(df)).first()
    assert (r["name_len"], r["name_tokens"], r["addr_len"], r["addr_tokens"], r["is_s3"]) == (4, 2, 0, 0, 1.0)
