"""Report filters and periods."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.cols import NO_FAMILY


@dataclass(frozen=True)
class ReportFilter:
    """What a report is asked for. Dates are inclusive; None doesn't filter."""

    from_date: date
    to_date: date
    tenant_id: str | None = None
    currency: str | None = None
    product_key: int | None = None
    seller_key: int | None = None
    warehouse_key: int | None = None
    status: str | None = None
    family: str | None = None
    provider_key: int | None = None

    def __post_init__(self) -> None:
        if self.from_date > self.to_date:
            raise ValueError("from_date is after to_date")

    def previous(self) -> ReportFilter:
        """The period of equal length that ends the day before this one."""
        days = (self.to_date - self.from_date).days + 1
        return replace(self, from_date=self.from_date - timedelta(days=days), to_date=self.from_date - timedelta(days=1))

    @property
    def days(self) -> int:
        return (self.to_date - self.from_date).days + 1


def default_period(as_of: date) -> ReportFilter:
    """The 30 days up to as_of."""
    return ReportFilter(as_of - timedelta(days=29), as_of)


EVERYTHING = frozenset({"currency", "product", "seller", "warehouse", "status", "provider", "family"})
SALES = EVERYTHING - {"provider"}
PURCHASES = frozenset({"currency", "product", "warehouse", "provider", "family", "status"})
PAYMENTS = frozenset({"currency"})


def of_family(fact: DataFrame, products: DataFrame, family: str) -> DataFrame:
    """Rows whose product is of a family; rows without a product never are."""
    members = products.filter(F.coalesce("family_name", F.lit(NO_FAMILY)) == family).select("product_key")
    return fact.join(members, "product_key", "left_semi")


def filter_fact(fact: DataFrame, f: ReportFilter, products: DataFrame | None = None, allow: frozenset = SALES, day: str = "date") -> DataFrame:
    """Rows of a fact in the period, not deleted, with the equalities that the report allows. A null date is never in a period."""
    out = fact.filter(F.col(day).between(F.lit(f.from_date), F.lit(f.to_date)) & ~F.col("is_deleted"))
    if f.tenant_id is not None:
        out = out.filter(F.col("tenant_id") == f.tenant_id)
    wanted = {
        "currency": ("currency_code", f.currency),
        "product": ("product_key", f.product_key),
        "seller": ("seller_key", f.seller_key),
        "warehouse": ("warehouse_key", f.warehouse_key),
        "status": ("document_status", f.status),
        "provider": ("provider_key", f.provider_key),
    }
    for name, (column, value) in wanted.items():
        if name in allow and value is not None:
            out = out.filter(F.col(column) == value)
    if "family" in allow and f.family is not None:
        out = of_family(out, products, f.family)
    return out


def latest_run(runs: DataFrame) -> DataFrame:
    """run_id of each tenant's newest succeeded run; no rows without one."""
    done = runs.filter("status = 'succeeded'")
    return done.groupBy("tenant_id").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"))


def latest_snapshot(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshot rows of the newest succeeded run. The run table has a row a tenant."""
    return snapshots.join(latest_run(runs), ["tenant_id", "run_id"], "left_semi")
