"""All pairs of the rows of a group, by blocks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quoteloom.sources.adapters import dealt

BLOCK = 1000  # rows of a group that meet as many others under one key


def blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` without null ``keys``, each once for every block of its group: _own, the block that it is in,
    and _other, the one to meet. A group is put in ``order`` and cut evenly, into blocks of ``BLOCK`` rows at most."""
    group = Window.partitionBy(*keys)
    cut = dealt(rows.dropna(subset=keys), *keys).withColumns({"_place": F.row_number().over(group.orderBy(*order)) - 1, "_size": F.count("*").over(group)})
    cut = cut.withColumn("_blocks", F.ceil(F.col("_size") / BLOCK))
    own, other = F.floor(F.col("_place") * F.col("_blocks") / F.col("_size")), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return cut.withColumns({"_own": own, "_other": other}).drop("_place", "_size", "_blocks")


def pairs(rows: DataFrame, keys: list[str], order: list[str], unlike: Column) -> DataFrame:
    """Every two rows of one group (``keys``, none null) for which ``unlike`` holds, each pair both ways: the
    columns besides ``keys`` as ``one_`` and ``two_``, of which ``unlike`` is made.

    Each two blocks meet under a key of their own: a task holds one block at a time, a large group is dealt out
    over all tasks, and a row is copied once for ``BLOCK`` pairs. The pairs of a row of ``two_`` stand together.
    """
    cut, meet = blocks(rows, keys, order), [*keys, "_one", "_two"]

    def side(name: str, own: str, other: str) -> DataFrame:
        named = (F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in keys)
        return dealt(cut.select(*keys, F.col("_own").alias(own), F.col("_other").alias(other), *named), *meet)

    one, two = side("one", "_one", "_two"), side("two", "_two", "_one")
    return two.join(one.hint("merge"), meet).where(unlike).drop(*meet)
