"""Column functions."""

import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..tables import small_batches


def vectorized(schema: str):
    """A pandas UDF that is made when it is first used, so that modules load without a session. It gets small batches."""

    def wrap(f):
        made = []

        @functools.wraps(f)
        def call(*columns):
            if not made:
                made.append(F.pandas_udf(f, schema))
            if session := SparkSession.getActiveSession():
                small_batches(session)
            return made[0](*columns)

        return call

    return wrap
