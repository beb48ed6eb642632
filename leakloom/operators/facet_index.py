"""A bitmap index of facets: filters and recounts become operations on bitmaps, without a new pass over the rows.

Rows are numbered; for each value of a facet and each range of numbers a bitmap tells which rows have
it. Values of a facet are joined by or, facets by and; counts are those of set bits. Bitmaps are
Spark's own, of 32,768 rows each, so no row of the index grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.operators.findings import facet_values
from leakloom.session import materialize


class FacetIndex:
    """The index of a table's facets. Rows are numbered as they are written, once; later steps read bitmaps only."""

    def __init__(self, rows: DataFrame, scalar: list[str], listed: list[str]):
        """scalar columns have a value a row (null: "-"), listed ones an array of values, of which repeats and null count once or not at all."""
        self.rows = materialize(rows.withColumn("facet_row", F.monotonically_increasing_id()), "facet-rows")
        self.names = [*scalar, *listed]
        pairs = self.rows.select("facet_row", F.explode(facet_values(scalar, listed)).alias("x")).select("x.facet", "x.value", "facet_row")
        bits = pairs.groupBy("facet", "value", F.bitmap_bucket_number("facet_row").alias("part"))
        self.bitmaps = materialize(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("facet_row")).alias("bits")), "facet-bitmaps")

    def _of(self, chosen: dict[str, list[str]], but: str | None = None) -> DataFrame | None:
        """(part, bits): the rows that have a chosen value of each facet, `but` one facet; None if nothing is chosen."""
        asked = {f: v for f, v in chosen.items() if v and f != but}
        if not asked:
            return None
        some = F.lit(False)
        for f, values in asked.items():
            some = some | ((F.col("facet") == f) & F.col("value").isin(values))
        any_of = self.bitmaps.filter(some).groupBy("facet", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
        both = any_of.groupBy("part").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        return both.filter(F.col("n") == len(asked)).select("part", "bits")  # a facet without a bitmap here has no row here

    def counts(self, chosen: dict[str, list[str]] | None = None, apart: bool = False) -> DataFrame:
        """(facet, value, n) of all values over the rows that pass; with apart, a facet's own choice does not narrow its counts."""
        chosen = chosen or {}
        parts = [(f, self._of(chosen, f if apart else None)) for f in self.names] if apart else [(None, self._of(chosen))]
        out = None
        for facet, passing in parts:
            bitmaps = self.bitmaps if facet is None else self.bitmaps.filter(F.col("facet") == facet)
            if passing is not None:
                # A bitmap and that of the rows that pass: both, or no row of this part.
                told = bitmaps.select("facet", "value", "part", "bits").join(passing.withColumnRenamed("bits", "passing"), "part", "left")
                two = told.select("facet", "value", "part", F.explode(F.array("bits", F.coalesce("passing", F.lit(bytes(4096))))).alias("bits"))
                bitmaps = two.groupBy("facet", "value", "part").agg(F.bitmap_and_agg("bits").alias("bits"))
            n = bitmaps.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))
            out = n if out is None else out.unionByName(n)
        return out

    def passing(self, chosen: dict[str, list[str]]) -> DataFrame:
        """The rows that pass: parts of the table meet the bitmaps of their numbers."""
        found = self._of(chosen)
        if found is None:
            return self.rows.drop("facet_row")
        at = F.bitmap_bit_position("facet_row")
        held = F.conv(F.hex(F.expr("substring(passing_bits, int(bitmap_bit_position(facet_row) div 8) + 1, 1)")), 16, 10).cast("int")
        rows = self.rows.withColumn("passing_part", F.bitmap_bucket_number("facet_row")).join(found.select(F.col("part").alias("passing_part"), F.col("bits").alias("passing_bits")), "passing_part")
        return rows.filter(F.getbit(held, (at % 8).cast("int")) == 1).drop("facet_row", "passing_part", "passing_bits")
