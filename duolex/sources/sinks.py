"""Table writers."""

from pyspark.sql import DataFrame, SparkSession


def save_sharded(df: DataFrame, path: str, max_records=1_000_000, partition_by=("split",)) -> str:
    """Encoded data as parquet, one folder per split, bounded rows per file."""
    (
        df.write.mode("overwrite").partitionBy(*partition_by)
        .option("maxRecordsPerFile", max_records).parquet(path)
    )
    return path


def load_if_cached(spark: SparkSession, path: str):
    """The saved table, or None unless a finished write lies there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    done = hadoop.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.parquet(path)


def write_frequency_csv(freq: DataFrame, path: str, columns=("lang", "token_id", "freq", "rank")) -> str:
    """``|``-separated table of scalar cells with a header."""
    freq.select(*columns).write.mode("overwrite").csv(path, sep="|", header=True)
    return path


def write_frequent_words(side: DataFrame, path: str, first: str, second: str) -> str:
    """The words of a side-by-side table, one column per language, by rank."""
    (
        side.orderBy("rank").selectExpr(f"token_1 AS `{first}`", f"token_2 AS `{second}`")
        .write.mode("overwrite").csv(path, sep="|", header=True, quote='"', escape='"')
    )
    return path


# quotes doubled, line breaks inside quotes, blanks and empty texts kept
_CSV = dict(
    header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="",
)


def write_predictions(table: DataFrame, path: str, sep="|") -> str:
    """Texts as ``Label`` and ``Prediction`` columns."""
    (
        table.selectExpr("label AS Label", "prediction AS Prediction")
        .write.mode("overwrite").csv(path, sep=sep, quoteAll=True, **_CSV)
    )
    return path


def read_predictions(spark: SparkSession, path: str, sep="|") -> DataFrame:
    return spark.read.schema("Label string, Prediction string").csv(
        path, sep=sep, multiLine=True, nullValue="\u0000", **_CSV
    )
