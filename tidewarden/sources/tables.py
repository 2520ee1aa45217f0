"""CSV readers for holdings and fundamentals (local paths or object-store URIs)."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers as N

HOLDING_COLUMNS = ["rank", "company", "symbol", "weight", "price"]
FUNDAMENTAL_COLUMNS = ["symbol", "company_name", "market_cap", "revenue", "op_income",
                       "net_income", "eps", "fcf"]
# Header of the fundamentals file
FUNDAMENTAL_HEADER = ["Symbol", "Company Name", "Market Cap", "Revenue", "Op. Income",
                      "Net Income", "EPS", "FCF"]
NUMERIC = ["market_cap", "revenue", "op_income", "net_income", "eps", "fcf"]


def _read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    # Declared as strings: no inference pass over the files.  The file's own
    # header is skipped, which is the positional rename.
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))


def holdings_from_strings(raw: DataFrame) -> DataFrame:
    """Repair the five holding columns; other columns pass through."""
    return raw.withColumns({
        "rank": N.strip(F.col("rank")).try_cast("int"),
        "company": N.unquote(F.col("company")),
        "weight": N.decimal_comma(F.col("weight")),
        "price": N.decimal_comma(F.col("price")),
    })


def fundamentals_from_strings(raw: DataFrame) -> DataFrame:
    """Repair the numeric columns and the padded names."""
    return raw.withColumns(
        {c: N.thousands(F.col(c)) for c in NUMERIC}
        | {"company_name": N.strip(F.col("company_name"))})


def read_holdings(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Holdings file: columns renamed by position, decimal commas, quoted names.

    The frame is left unsorted; order by weight (``order_holdings``) at output.
    ``extra`` names further trailing columns, such as a portfolio id.
    """
    return holdings_from_strings(_read_strings(spark, path, HOLDING_COLUMNS + list(extra)))


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """Fundamentals file: byte-order mark, thousands commas, unreadable cells as 0.

    The first header name is matched by position because of the byte-order mark.
    """
    return fundamentals_from_strings(_read_strings(spark, path, FUNDAMENTAL_COLUMNS))


def order_holdings(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("weight").desc(), "rank", "symbol")
