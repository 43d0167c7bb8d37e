"""Column helpers shared by normalisation and reports."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MONEY = "decimal(18,2)"
QUANTITY = "decimal(18,4)"
DEFAULT_CURRENCY = "COP"
NO_FAMILY = "SIN FAMILIA"
NO_SUPPLIER = "SIN PROVEEDOR"
#: Cost states of a sales line whose cost is used in reports.
COSTED = ("costed", "estimated")


def safe_ratio(a: Column, b: Column, times: int = 1) -> Column:
    """a / b * times as a double; 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")) * times, F.lit(0.0))


def ratio(a: Column, b: Column, times: int = 1) -> Column:
    """a / b * times as a double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double")) * times


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def label(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def total(c: Column, where: Column | None = None) -> Column:
    """Sum as a double, 0 without rows; sums of decimals stay exact until the end."""
    return F.coalesce(F.sum(c if where is None else F.when(where, c)), F.lit(0)).cast("double")


def is_costed(status: str = "cost_status") -> Column:
    return F.col(status).isin(*COSTED)


# JSON scalars of business documents. Each takes a JSON text and a path.


def is_object(raw: Column) -> Column:
    return F.trim(raw).startswith("{")


def json_at(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, f"$.{path}")


def text_of(payload: Column, path: str) -> Column:
    """Trimmed text or number; blank, objects and lists are null."""
    raw = F.trim(json_at(payload, path))
    return F.when(~raw.startswith("{") & ~raw.startswith("["), F.nullif(raw, F.lit("")))


def decimal_of(payload: Column, path: str, kind: str = QUANTITY) -> Column:
    """Number, or an object's amount or value; booleans and anything unreadable are null."""
    raw = F.coalesce(text_of(payload, path), text_of(payload, f"{path}.amount"), text_of(payload, f"{path}.value"))
    return F.when(~raw.isin("true", "false"), raw.try_cast(kind))


def date_of(payload: Column, path: str) -> Column:
    """Date of the first ten characters, if they are an ISO date."""
    head = F.substring(text_of(payload, path), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def code_of(payload: Column, path: str) -> Column:
    """Currency and the like: an object's code, else its name, else the scalar."""
    return F.coalesce(text_of(payload, f"{path}.code"), text_of(payload, f"{path}.name"), text_of(payload, path))


def flag_of(payload: Column, path: str) -> Column:
    """Boolean from true, 1, yes / false, 0, no."""
    raw = F.lower(text_of(payload, path))
    return F.when(raw.isin("true", "1", "yes"), F.lit(True)).when(raw.isin("false", "0", "no"), F.lit(False))


def missing_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def is_number_zero(payload: Column, path: str) -> Column:
    """Whether the value is the number 0. A text is something given, also if it says 0."""
    raw = F.get_json_object(F.concat(F.lit("["), payload, F.lit("]")), f"$[*].{path}")  # of a list's members texts keep their quotes
    return F.coalesce(raw.try_cast("double") == 0, F.lit(False))


def person_name(payload: Column, path: str) -> Column:
    """A text, else .name, else the parts of a name joined by a space."""
    parts = ("firstName", "secondName", "lastName", "secondLastName", "surname")
    joined = lambda at: F.nullif(F.concat_ws(" ", *[text_of(payload, f"{at}.{p}") for p in parts]), F.lit(""))
    return F.coalesce(text_of(payload, path), text_of(payload, f"{path}.name"), joined(f"{path}.name"), joined(path))


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then case folding."""
    plain = pc.utf8_normalize(pa.array(s, pa.string(), from_pandas=True), "NFKD")
    return plain.to_pandas().str.casefold()


def normalized_text(c: Column) -> Column:
    """Text without accents, case and repeated white space, for matching."""
    return F.trim(F.regexp_replace(F.regexp_replace(_folded(c), r"\p{M}+", ""), r"(?U)\s+", " "))
