from pyspark.sql import functions as F

from cairn.functions import keys


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_object_path_and_key(spark):
    assert one(spark, keys.object_path(F.lit("abcdef"), F.lit("C"))) == "ab/cdefC"
    assert one(spark, keys.object_path(F.lit("ab"), F.lit("C"))) == "ab"
    assert one(spark, keys.full_hash(F.lit("abcdef"), F.lit(""))) == "abcdef"
    assert one(spark, keys.hex_of(F.lit(b"\xab\x01"))) == "ab01"


def test_suffixes(spark):
    for name, suffix in (("abC", "C"), ("abZ", "Z"), ("ab1", ""), ("", ""), ("abc", "")):
        assert one(spark, keys.suffix_from_name(F.lit(name))) == suffix
    for flags, suffix in ((1, "L"), (5, ""), (4, ""), (129, "L"), (0, "")):
        assert one(spark, keys.entry_suffix(F.lit(flags))) == suffix


def test_human_bytes(spark):
    for size, text in ((0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1536, "1.5 KB"), (5 * 1024**3, "5.0 GB"), (2**60, "1.0 EB")):
        assert one(spark, keys.human_bytes(F.lit(size).cast("long"))) == text


def test_percent_of_nothing(spark):
    assert one(spark, keys.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, keys.percent(F.lit(1), F.lit(4))) == 25.0


def test_prefixes(spark):
    got = [r["prefix"] for r in keys.prefixes(spark).orderBy("prefix").collect()]
    assert got == [f"{i:02x}" for i in range(256)]
