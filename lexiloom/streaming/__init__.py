"""Stateless operators on streams: the same expressions, on ``readStream``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def weighted_lines(stream: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Lines of a stream of texts with their weights."""
    cut = stream.select(*keys, F.posexplode(F.split(X.to_phonemes(F.coalesce(text, F.lit(""))), "\n")).alias("pos", "line"))
    return cut.filter("line <> ''").withColumn("w", X.weights(F.col("line")))
