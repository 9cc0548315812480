from factloom.functions.keys import row_key


def test_rows_are_told_apart_nulls_included(spark):
    values = [None, "", "a", "b"]
    rows = [(x, y, n) for x in values for y in values for n in (None, 0, 1)]
    df = spark.createDataFrame(rows + rows, "x string, y string, n int")
    keyed = df.select(*row_key(["x", "y", "n"]), "x", "y", "n").toDF("k1", "k2", "x", "y", "n")
    assert keyed.select("k1", "k2").distinct().count() == keyed.distinct().count() == len(rows)
    assert keyed.filter("k1 = k2").count() == 0
    assert df.select(*row_key(["n"])).distinct().count() == 3
