"""Key rules: duplicate keys, missing references and keyed comparison.

Counts come from keys that were aggregated before any join, so a key holding a third of all rows costs one row
per map task. Rows come from joining the source to those counted keys (see ``plans.skew``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.scalar import col_of, compact_key, is_integral, normalised_key, text_of
from plumbline.plans.skew import KEY_COUNT, key_names, rows_of_keys, some_rows_of_keys, with_keys

CHECKED, FAILED, MISMATCHES = "checked_count", "failed_count", "mismatch_count"


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def _count_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    names = key_names(len(keys))
    return df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True))).groupBy(*names).agg(
        F.count(F.lit(1)).alias(KEY_COUNT)
    )


class DuplicateKeys:
    """Every row of a key that occurs more than once fails; a key with a NULL part passes."""

    def __init__(self, df: DataFrame, columns: list[str]) -> None:
        self.df = df
        self.keys = [compact_key(*col_of(df, name)) for name in columns]
        self.counted = _count_keys(df, self.keys)
        self._repeated = (F.col(KEY_COUNT) > 1) & _all_present(len(columns))

    def counts(self) -> DataFrame:
        n = F.col(KEY_COUNT)
        return self.counted.agg(_total(n).alias(CHECKED), _total(F.when(self._repeated, n)).alias(FAILED))

    def failing(self, hot_rows: int | None = None) -> DataFrame:
        return rows_of_keys(self.df, self.keys, self.counted.filter(self._repeated), hot_rows=hot_rows)

    def evidence(self, limit: int) -> DataFrame:
        return some_rows_of_keys(self.df, self.keys, self.counted.filter(self._repeated), limit)


class MissingReferences:
    """Rows whose non-null key has no equal in the target. Keys compare as stripped text, or natively."""

    def __init__(
        self, df: DataFrame, source_key: str, target: DataFrame, target_key: str, *, native: bool = False
    ) -> None:
        self.df = df
        (s, s_type), (t, t_type) = col_of(df, source_key), col_of(target, target_key)
        # Whole numbers are equal exactly when their text is, so they need no text form.
        if is_integral(s_type) and is_integral(t_type):
            s, t = s.cast("long"), t.cast("long")
        elif native:
            s, t = compact_key(s, s_type), compact_key(t, t_type)
        else:
            s, t = normalised_key(s, s_type), normalised_key(t, t_type)
        self.keys = [s]
        (name,) = key_names(1)
        known = target.select(t.alias(name)).dropna().distinct()
        self.counted = _count_keys(df, self.keys)
        self._flagged = self.counted.join(known.withColumn("__known", F.lit(True)), name, "left")
        self._orphan = F.col(name).isNotNull() & F.col("__known").isNull()
        self._orphans = self.counted.dropna(subset=[name]).join(known, name, "left_anti")

    def counts(self) -> DataFrame:
        n = F.col(KEY_COUNT)
        return self._flagged.agg(_total(n).alias(CHECKED), _total(F.when(self._orphan, n)).alias(FAILED))

    def failing(self, hot_rows: int | None = None) -> DataFrame:
        return rows_of_keys(self.df, self.keys, self._orphans, hot_rows=hot_rows)

    def evidence(self, limit: int) -> DataFrame:
        return some_rows_of_keys(self.df, self.keys, self._orphans, limit)


class KeyedComparison:
    """Pairs with an equal key whose compared columns differ as text, NULL counting as empty text.

    Pairs are never built. With s and t rows of a key on either side, and s(v)·t(v) pairs agreeing on the values
    v, the failing pairs are s·t minus the agreeing ones.
    """

    def __init__(self, df: DataFrame, key_column: str, compare_columns: list[str], target: DataFrame) -> None:
        self.df = df
        (s, s_type), (t, t_type) = col_of(df, key_column), col_of(target, key_column)
        if s_type != t_type and (T.StringType() in (s_type, t_type)):
            s, t, s_type, t_type = text_of(s, s_type), text_of(t, t_type), T.StringType(), T.StringType()
        self.keys = [compact_key(s, s_type), _values_of(df, compare_columns)]
        key, values = key_names(2)
        target_keys = [compact_key(t, t_type), _values_of(target, compare_columns)]
        ours = _count_keys(df, self.keys).withColumn("__t", F.lit(0).cast("long"))
        theirs = _count_keys(target, target_keys).select(
            key, values, F.lit(0).cast("long").alias(KEY_COUNT), F.col(KEY_COUNT).alias("__t")
        )
        self.by_values = (
            ours.unionByName(theirs)
            .dropna(subset=[key])
            .groupBy(key, values)
            .agg(F.sum(KEY_COUNT).alias(KEY_COUNT), F.sum("__t").alias("__t"))
        )
        self._key, self._values = key, values

    def counts(self) -> DataFrame:
        wide = "decimal(38,0)"
        s, t = F.col(KEY_COUNT).cast(wide), F.col("__t").cast(wide)
        per_key = self.by_values.groupBy(self._key).agg(
            (F.sum(s) * F.sum(t) - F.sum(s * t)).cast(wide).alias("__failed")
        )
        failed = per_key.agg(F.lit(0).cast("long").alias(CHECKED), _total(F.col("__failed")).alias(FAILED))
        checked = self.df.agg(F.count(F.lit(1)).alias(CHECKED), F.lit(0).cast("long").alias(FAILED))
        return checked.unionByName(failed).agg(_total(F.col(CHECKED)).alias(CHECKED), _total(F.col(FAILED)).alias(FAILED))

    def _mismatched(self) -> DataFrame:
        per_key = self.by_values.groupBy(self._key).agg(F.sum("__t").alias("__all"))
        return (
            self.by_values.filter(F.col(KEY_COUNT) > 0)
            .join(per_key, self._key)
            .withColumn(MISMATCHES, F.col("__all") - F.col("__t"))
            .filter(F.col(MISMATCHES) > 0)
            .select(self._key, self._values, KEY_COUNT, MISMATCHES)
        )

    def failing(self, hot_rows: int | None = None) -> DataFrame:
        """Each failing source row once, with the number of target rows it disagrees with."""
        return rows_of_keys(self.df, self.keys, self._mismatched(), [MISMATCHES], hot_rows)

    def evidence(self, limit: int) -> DataFrame:
        return some_rows_of_keys(self.df, self.keys, self._mismatched(), limit)


def _all_present(count: int) -> Column:
    present = F.lit(True)
    for name in key_names(count):
        present = present & F.col(name).isNotNull()
    return present


def _values_of(df: DataFrame, columns: list[str]) -> Column:
    texts = [F.coalesce(text_of(*col_of(df, name)), F.lit("")) for name in columns]
    return compact_key(F.to_json(F.array(*texts)), T.StringType())


__all__ = ["DuplicateKeys", "MissingReferences", "KeyedComparison", "with_keys"]
