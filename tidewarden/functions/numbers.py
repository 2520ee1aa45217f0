"""Type repair and ratio expressions for portfolio tables."""

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def decimal_comma(c: Column) -> Column:
    """``"1,25"`` to 1.25; cells that are not numbers become null."""
    return strip(F.translate(c, ",", ".")).try_cast("double")


def thousands(c: Column) -> Column:
    """``"1,234.5"`` to 1234.5; missing and bad cells become 0."""
    return F.coalesce(strip(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"), F.lit(0.0))


def unquote(c: Column) -> Column:
    """Remove double quotes around a value."""
    return F.btrim(c, F.lit('"'))


def strip(c: Column) -> Column:
    """Remove surrounding whitespace of any kind (``trim`` removes only blanks)."""
    return F.regexp_replace(c, SPACE, "")


def ratio(num: Column, den: Column) -> Column:
    """Quotient, null where the denominator is zero or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns of ``defaults`` that are absent; present ones are kept."""
    return df.withColumns(
        {name: value if isinstance(value, Column) else F.lit(value)
         for name, value in defaults.items() if name not in df.columns})


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Select those of the wanted columns that the frame has."""
    return df.select([name for name in wanted if name in df.columns])
