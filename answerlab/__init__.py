"""answerlab: DataFrame operators for labelled question/answer tables on Spark.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is built
from native Spark SQL expressions; Python runs inside tasks only where a
user-supplied scorer or an exact string-similarity check needs it.
"""

from answerlab.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
