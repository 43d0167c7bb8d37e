"""The opening stock report: a table with headers as people write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The report's required headers, normalised, and our names.
HEADERS = {"categoria": "category", "item": "item", "referencia": "reference", "descripcion": "description", "cantidad": "quantity", "cantidadenremisiones": "reserved", "unidad": "unit", "estado": "status", "costopromedio": "average_cost"}
NUMBERS = {"quantity": ("decimal(18,4)", 0), "reserved": ("decimal(18,4)", 0), "average_cost": ("decimal(18,4)", None)}


def normal_header(name: str) -> str:
    import unicodedata

    plain = unicodedata.normalize("NFKD", name)
    return "".join(c for c in plain if not unicodedata.combining(c)).casefold().replace(" ", "").strip()


def opening_report(table: DataFrame, row_number: str | None = None) -> DataFrame:
    """The report's columns by our names. Other columns are left out, rows without an item too; numbers may have thousands commas, a bad one is an error."""
    found = {normal_header(c): c for c in table.columns}
    missing = [h for h in HEADERS if h not in found]
    if missing:
        raise ValueError(f"the report has no columns {missing}")
    columns = []
    for header, name in HEADERS.items():
        c = F.nullif(F.trim(F.col(f"`{found[header]}`").cast("string")), F.lit(""))
        if name in NUMBERS:
            kind, default = NUMBERS[name]
            number = F.replace(c, F.lit(","), F.lit("")).try_cast(kind)
            bad = F.raise_error(F.concat(F.lit(f"bad number for {name}: "), c)).cast(kind)
            c = F.when(c.isNull(), F.lit(default).cast(kind)).when(number.isNull(), bad).otherwise(number)
        columns.append(c.alias(name))
    place = [F.col(row_number).alias("row_number")] if row_number else []
    return table.select(*place, *columns).filter("item is not null")


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, the key by which an import is told from a repeat."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
