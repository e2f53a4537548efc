"""Reading and parsing feature tables."""

import pytest

from peerlabel.sources.tables import MissingTable, parse_features, read_feature_table, read_table


def test_parse_by_name_and_position(spark):
    raw = spark.createDataFrame([("1,2.5,-3", "7", "a")], "x STRING, y STRING, id STRING")
    row = parse_features(raw).first()
    assert (row.id, row.features, row.label) == ("a", [1.0, 2.5, -3.0], 7.0)
    assert parse_features(raw, "x", "y").first() == row
    assert parse_features(raw, as_vector=True).first().features.toArray().tolist() == [1.0, 2.5, -3.0]


def test_empty_fields_at_the_end_are_ignored(spark):
    raw = spark.createDataFrame([("1,2,,", " 3 ")], "x STRING, y STRING")
    row = parse_features(raw).first()
    assert row.features == [1.0, 2.0] and row.label == 3.0


def test_bad_numbers_fail(spark):
    raw = spark.createDataFrame([("1,two", "3")], "x STRING, y STRING")
    with pytest.raises(Exception, match="two"):
        parse_features(raw).collect()


def test_missing_inputs_fail_at_once(spark, tmp_path):
    with pytest.raises(MissingTable):
        read_table(spark, "no_such_table")
    with pytest.raises(MissingTable):
        read_table(spark, str(tmp_path / "nothing"), "parquet")


def test_read_from_files_and_views(spark, tmp_path):
    raw = spark.createDataFrame([("1,2", "0"), ("3,4", "1")], "x STRING, y STRING")
    path = str(tmp_path / "raw.parquet")
    raw.write.parquet(path)
    rows = read_feature_table(spark, path, "parquet", num_partitions=5)
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 2
    raw.createOrReplaceTempView("raw_features")
    assert read_feature_table(spark, "raw_features").count() == 2
    spark.catalog.dropTempView("raw_features")
