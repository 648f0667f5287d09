from assayloom.functions import sql


def test_sql_functions(spark):
    sql.register(spark)
    got = spark.sql("SELECT cas_valid('64-17-5') AS a, cas_valid('64-17-6') AS b, cas_valid('x') AS c, cas_digits('64-17-5') AS d, natural_key('A2b') < natural_key('a10') AS e, cas_shape('64-17-55') AS f").first()
    assert tuple(got) == (True, False, False, "64175", True, False)
