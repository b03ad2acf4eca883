"""What several tests of this folder share. Not in ``conftest``: the name of
that module is the same in every test folder."""

SF_SMALL = "/root/testdata/sf0.001"


def one_col(spark, values, name="t", ddl="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {ddl}")
