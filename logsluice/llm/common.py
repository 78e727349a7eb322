"""Column handling and shared intermediates of the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.session import drop_path, scratch_path

# The white space of the contracts, [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types.

    Further columns of any name are left behind, so none can clash with what an
    operator adds. A missing column is an error that names it.
    """
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there.

    Later steps read the same rows whichever executors are lost meanwhile.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame | None) -> None:
    """Removes tables that ``stored`` wrote, once all that is made of them is stored, too."""
    for df in frames:
        if df is not None:
            for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
                drop_path(df.sparkSession, folder)


def shuffle_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as a non-negative long; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_unit(*columns: Column | str) -> Column:
    """A value in (0, 1) drawn by hashing the columns: 53 bits of xxHash64."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, splits: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each group, without a task per group.

    Rows of a group are split by the hash of their order columns into ``splits``
    parts; each part is numbered on its own and begins where the parts before it
    end. Only the part sizes (groups x splits rows) are summed in one place per
    group; they are stored, so that Spark knows their size and need not deal the rows
    anew to join them. The numbering follows the part, then ``order``. ``rows`` must be
    stored or cheap, as it is read twice.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(splits)).cast("int")
    split = rows.withColumn("__part", part)
    window = _window(group, ["__part"])
    sizes = split.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(
        *(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)),
        F.col("__part").alias("__p"),
        (F.sum("__n").over(window) - F.col("__n")).alias("__start"),
    )
    starts = stored(starts, "part-starts")
    on = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    inside = F.row_number().over(_window([*group, "__part"], order)) - 1
    return (
        split.withColumn("__inside", inside)
        .join(starts, [*on, F.col("__part") == F.col("__p")])
        .withColumn(name, (F.col("__start") + F.col("__inside")).cast("long"))
        .drop("__part", "__inside", "__p", "__start", *(f"__g{i}" for i in range(len(group))))
    )


def _window(partition: Sequence[str], order: Sequence[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*partition).orderBy(*order)
