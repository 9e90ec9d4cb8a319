"""Quantities in free text to whole amounts in canonical units.

``normalise`` parses every value in the Arrow worker of the task that read it:
no shuffle, no join, and each distinct text of a batch is parsed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions.quantity import Grammar, whole
from lekhya.io import small_rows, table

#: The units table is a fixed list; beyond this it is not one any more.
MAX_UNITS = 10_000
#: Distinct texts that a worker keeps parsed.
MEMO = 200_000


def units_of(units: DataFrame) -> list[tuple]:
    """Rows (code, dimension, factor[, offset]) without nulls, checked to be few."""
    more = [F.coalesce(F.col("offset").cast("double"), F.lit(0.0)).alias("offset")] if "offset" in units.columns else []
    rows = small_rows(units.select("code", "dimension", F.col("factor").cast("double"), *more).dropna(), MAX_UNITS)
    return [tuple(r) for r in rows]


def quantity_udf(units: list[tuple]):
    """Column function (text, bare unit) -> struct<dimension, exponents array<int>, amount bigint>.

    The struct is null where the text states no single definite quantity.  It
    counts as nondeterministic, so that a filter on it does not repeat it.
    """

    @F.pandas_udf("dimension string, exponents array<int>, amount bigint")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        grammar, memo = Grammar(units), {}
        for text, bare in batches:
            out = []
            for key in zip(text, bare):
                if key not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    got = grammar.parse(key[0], key[1])
                    n = None if got is None else whole(got[1])
                    memo[key] = (None, None, None) if n is None or abs(n) >= 2**63 else (grammar.dimension(got[0]), list(got[0]), n)
                out.append(memo[key])
            yield pd.DataFrame(out, columns=["dimension", "exponents", "amount"], dtype=object).astype({"amount": "Int64"})

    return parse.asNondeterministic()


def normalise(df: DataFrame, units: DataFrame, text: str, dimension: str, bare: str, out: str = "amount") -> DataFrame:
    """``df`` with the whole amount of column ``text``, for rows that state one.

    ``dimension`` and ``bare`` are columns: the dimension the field must have
    ("money", "money/time", "length^2"; rows of any other are no cases) and the
    unit of a number without a unit (null: such numbers are no cases).  Null,
    blank and unparsable texts, and amounts beyond 64 bits, give no row; equal
    rows give equal rows; other columns are kept, an existing column ``out`` is
    replaced.
    """
    got = df.filter(F.col(text).isNotNull()).withColumn("_q", quantity_udf(units_of(units))(F.col(text), F.col(bare)))
    return got.filter(F.col("_q.amount").isNotNull() & (F.col("_q.dimension") == F.col(dimension))).withColumn(out, F.col("_q.amount")).drop("_q")


def quantity_values(entities: DataFrame, ner_outputs: DataFrame) -> DataFrame:
    """(src_table, src_id, item_pos, text, dimension, bare) of the three fields."""

    def part(df: DataFrame, name: str, key: str, pos, text, dim: str, bare: str | None) -> DataFrame:
        return df.select(
            F.lit(name).alias("src_table"), F.col(key).alias("src_id"), pos.alias("item_pos"), text.alias("text"),
            F.lit(dim).alias("dimension"), F.lit(bare).cast("string").alias("bare"),
        )

    fees = entities.select("entity_id", F.posexplode("price_fees").alias("_pos", "_fee"))
    zero = F.lit(0)
    return (
        part(fees, "entities.price_fees", "entity_id", F.col("_pos"), F.col("_fee.amount_raw"), "money", None)
        .unionByName(part(entities, "entities.duration", "entity_id", zero, F.col("duration"), "time", None))
        .unionByName(part(ner_outputs, "ner_outputs.duration_days", "output_id", zero, F.col("duration_days"), "time", "दिन"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated quantity of the entity tables in whole NPR or days."""
    values = quantity_values(table(spark, sf_dir, "entities"), table(spark, sf_dir, "ner_outputs"))
    out = normalise(values, table(spark, sf_dir, "units"), "text", "dimension", "bare")
    return out.select("src_table", "src_id", "item_pos", "amount")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated, converted and left-over values per field."""
    values = quantity_values(table(spark, sf_dir, "entities"), table(spark, sf_dir, "ner_outputs"))
    q = quantity_udf(units_of(table(spark, sf_dir, "units")))
    got = values.withColumn("ok", q(F.col("text"), F.col("bare"))["amount"].isNotNull())
    return got.groupBy("src_table").agg(
        F.count("*").alias("n_values"), F.count("text").alias("n_stated"),
        F.sum(F.col("ok").cast("bigint")).alias("n_converted"),
    )
