from pyspark.sql import functions as F


def with_extra(df, *names):
    """The table with more columns, whose names may differ from its own by case only."""
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
