from tesela.session import clear_staged, cut, stage_table


def test_staged_tables_are_cleared(spark):
    df = spark.range(3)
    assert stage_table(df, "x").count() == 3 and cut(df).count() == 3
    assert clear_staged(spark) and not clear_staged(spark)
    assert stage_table(df, "x").count() == 3
