"""Helpers of these tests."""


def with_clashes(docs, *names):
    """More columns, of the names that an operator may make for itself."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit(None).cast("string") for n in names})
