"""Replenishment: demand, candidates, queue, policies, order plans and their export.

Policies: supplier_policies (supplier_key, currency_code, minimum_order_amount, shipping_cost,
free_shipping_threshold, default_lead_time_days, max_wait_days), product_policies (supplier_key,
product_key, currency_code, minimum_order_quantity, pack_size, lead_time_days, max_wait_days,
is_preferred), actions (product_key, status, note). Quantities and money are doubles here.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions.cols import DEFAULT_CURRENCY, NO_FAMILY, label, missing_if_zero
from martloom.operators.inventory import DEMAND, _stock
from martloom.operators.sales import first
from martloom.plans.filters import ReportFilter, filter_fact

PRIORITIES = ("critical", "high", "medium")
DECISIONS = ("buy_now", "complete_order", "review", "accumulate")
STATUSES = ("pending", "reviewed", "ordered", "snoozed", "dismissed")


def demand_windows(marts, f: ReportFilter) -> DataFrame:
    """Units of each product in the period and in the last 7, 30 and 90 days up to its end, from one scan."""
    from dataclasses import replace

    wide = replace(f, from_date=min(f.from_date, f.to_date - timedelta(days=89)))
    rows = filter_fact(marts.fact_sales, wide, marts.dim_product, DEMAND).filter("product_key is not null")
    since = lambda d: F.coalesce(F.sum(F.when(F.col("date") >= F.lit(d), F.col("quantity"))), F.lit(0)).cast("double")
    back = lambda n: since(f.to_date - timedelta(days=n - 1))
    return rows.groupBy("product_key").agg(since(f.from_date).alias("units_selected"), back(7).alias("units_7d"), back(30).alias("units_30d"), back(90).alias("units_90d"))


def period_purchase_cost(marts, f: ReportFilter) -> DataFrame:
    """Average cost of each product's purchases in the period and currency; other filters don't apply."""
    plain = ReportFilter(f.from_date, f.to_date, f.tenant_id, currency=f.currency or DEFAULT_CURRENCY)
    rows = filter_fact(marts.fact_purchases, plain, allow=frozenset({"currency"})).filter("product_key is not null and quantity > 0")
    return rows.groupBy("product_key").agg(F.try_divide(F.sum("amount").cast("double"), F.sum("quantity").cast("double")).alias("average_unit_cost"))


def supplier_choices(stats: DataFrame, modes: DataFrame, contacts: DataFrame, top: int = 3) -> DataFrame:
    """Each product's and currency's best supplier and its first options: the modal one first, then the latest, cheapest, least key."""
    modal = modes.select(F.col("product_key").alias("_p"), F.col("supplier_key").alias("_s"))
    names = contacts.select(F.col("contact_key").alias("_c"), F.col("name").alias("supplier"))
    rows = stats.join(modal, F.col("product_key") == F.col("_p"), "left").join(names, F.col("supplier_key") == F.col("_c"), "left")
    rows = rows.withColumn("is_modal", F.coalesce(F.col("supplier_key") == F.col("_s"), F.lit(False)))
    order = Window.partitionBy("product_key", "currency_code").orderBy(F.desc("is_modal"), F.desc_nulls_last("last_purchase_date"), "cost_rank", "supplier_key")
    rows = rows.withColumn("choice_rank", F.row_number().over(order)).filter(F.col("choice_rank") <= top)
    option = F.struct("choice_rank", "supplier_key", "supplier", "is_modal", F.col("line_share_pct").alias("confidence_pct"), "unit_share_pct", F.col("line_count").alias("purchase_lines"), F.col("average_cost").alias("average_unit_cost"), F.col("last_cost").alias("last_unit_cost"), "last_purchase_date")
    best = lambda c: F.max(F.when(F.col("choice_rank") == 1, F.col(c)))
    return rows.groupBy("product_key", "currency_code").agg(
        best("supplier_key").alias("supplier_key"), best("supplier").alias("supplier"), best("line_share_pct").alias("confidence_pct"), best("average_cost").alias("average_unit_cost"), best("last_cost").alias("last_unit_cost"), best("last_purchase_date").alias("last_purchase_date"),
        F.sort_array(F.collect_list(option)).alias("supplier_options"))


def candidates(marts, stats: DataFrame, modes: DataFrame, f: ReportFilter, target_days: int = 30) -> DataFrame:
    """Products with demand that are in stock or kept in stock: velocity, coverage, cost, supplier and the quantity up to the target."""
    currency = f.currency or DEFAULT_CURRENCY
    stock = _stock(marts).filter("product_key is not null").groupBy(F.col("product_key").alias("_sp")).agg(F.sum("quantity").cast("double").alias("_stock"))
    choices = supplier_choices(stats, modes, marts.dim_contact).filter(F.col("currency_code") == currency).drop("currency_code").withColumnRenamed("product_key", "_cp").withColumnRenamed("average_unit_cost", "modal_average_unit_cost")
    cost = period_purchase_cost(marts, f).select(F.col("product_key").alias("_pp"), F.col("average_unit_cost").alias("_period_cost"))
    demand = demand_windows(marts, f).withColumnRenamed("product_key", "_dp")
    p = marts.dim_product.filter("not is_deleted")
    rows = p.join(demand, F.col("product_key") == F.col("_dp")).join(stock, F.col("product_key") == F.col("_sp"), "left").join(cost, F.col("product_key") == F.col("_pp"), "left").join(choices, F.col("product_key") == F.col("_cp"), "left")
    rows = rows.filter(F.col("_sp").isNotNull() | F.col("inventory_enabled"))
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    quantity, sold = F.coalesce("_stock", F.lit(0.0)), floor("units_selected")
    catalogue = F.nullif("preferred_supplier_name", F.lit(""))
    return rows.select(
        "product_key", "name", "reference", label(F.col("family_name"), NO_FAMILY).alias("family"), quantity.alias("quantity_on_hand"), sold.alias("units_sold"), floor("units_7d").alias("units_7d"), floor("units_30d").alias("units_30d"), floor("units_90d").alias("units_90d"),
        (sold / f.days).alias("daily_velocity"), F.when(sold > 0, quantity * f.days / sold).alias("coverage_days"),
        F.coalesce("_period_cost", "modal_average_unit_cost", F.col("current_cost").cast("double"), F.lit(0.0)).alias("unit_cost"), "supplier_key", F.coalesce("supplier", catalogue).alias("preferred_supplier"),
        F.when(F.col("supplier").isNotNull(), "historial_modal").when(catalogue.isNotNull(), "catalogo_actual").otherwise("sin_historial").alias("supplier_source"),
        F.coalesce("confidence_pct", F.lit(0.0)).alias("supplier_confidence_pct"), "modal_average_unit_cost", "last_unit_cost", "last_purchase_date", "supplier_options",
        F.ceil(F.greatest(sold * target_days / f.days - quantity, F.lit(0.0))).cast("double").alias("recommended_quantity"), F.lit(currency).alias("currency_code"))


def queue(rows: DataFrame, actions: DataFrame, lead_days: int = 7, safety_days: int = 7, limit: int | None = 100, review_status: str | None = None) -> DataFrame:
    """Candidates to reorder with priority, reason and position, the most urgent and valuable first. The limit comes before policies; None plans over all."""
    done = actions.select(F.col("product_key").alias("_a"), F.col("status").alias("_status"), F.col("note").alias("review_note"))
    out, late = F.col("quantity_on_hand") <= 0, F.col("coverage_days") < lead_days + safety_days
    q = rows.filter("recommended_quantity > 0").join(done, F.col("product_key") == F.col("_a"), "left").withColumn("review_status", F.coalesce("_status", F.lit("pending"))).drop("_a", "_status")
    if review_status is not None:
        q = q.filter(F.col("review_status") == review_status)
    q = q.withColumn("priority", F.when(out, "critical").when(late, "high").otherwise("medium"))
    reason = F.when(out, "Agotado con demanda reciente").when(F.col("preferred_supplier").isNull(), "Reponer y validar proveedor antes de comprar").when(late, "La cobertura no alcanza el plazo de compra y seguridad").otherwise("La cobertura está por debajo del objetivo")
    rank = F.when(out, 1).when(late, 2).otherwise(3)
    q = q.withColumn("reason", reason).withColumn("_rank", rank).withColumn("_value", F.round(F.col("recommended_quantity") * F.col("unit_cost"), 4))
    return first(q, limit, "_rank", F.desc_nulls_last("_value"), "product_key").withColumnRenamed("_rank", "queue_rank").withColumnRenamed("_value", "queue_value")


def apply_policies(q: DataFrame, supplier_policies: DataFrame, product_policies: DataFrame, stats: DataFrame, contacts: DataFrame, target_days: int = 30, lead_days: int = 7, safety_days: int = 7, wait_days: int = 7) -> DataFrame:
    """The queue with terms and order quantities.

    A preferred supplier of a product takes the place of the chosen one. Lead time and wait
    come from the product's policy, else the supplier's, else the parameter; 0 counts as not
    set. The order fills stock up to target, lead time and safety; it is at least the
    minimum and a whole number of packs, or 0. A preferred option has no score.
    """
    of = lambda df, prefix, *cols: df.select(*[F.col(c).alias(f"{prefix}{c}") for c in cols])
    known = of(stats, "_k_", "product_key", "supplier_key", "currency_code", "line_share_pct", "unit_share_pct", "line_count", "average_cost", "last_cost", "last_purchase_date")
    names = of(contacts, "_n_", "contact_key", "name")
    best = of(product_policies.filter("is_preferred"), "_w_", "product_key", "supplier_key", "currency_code")
    best = best.join(known, [F.col("_w_product_key") == F.col("_k_product_key"), F.col("_w_supplier_key") == F.col("_k_supplier_key"), F.col("_w_currency_code") == F.col("_k_currency_code")]).join(names, F.col("_w_supplier_key") == F.col("_n_contact_key"))
    rows = q.join(best, (F.col("product_key") == F.col("_w_product_key")) & (F.col("currency_code") == F.col("_w_currency_code")), "left")
    chosen = F.col("_w_supplier_key").isNotNull()
    swap = {
        "supplier_key": F.col("_w_supplier_key"), "preferred_supplier": F.col("_n_name"), "supplier_source": F.lit("politica_producto"), "supplier_confidence_pct": F.coalesce("_k_line_share_pct", F.lit(0.0)), "last_unit_cost": F.col("_k_last_cost"), "last_purchase_date": F.col("_k_last_purchase_date"),
        "unit_cost": F.coalesce(missing_if_zero(F.col("_k_last_cost")), missing_if_zero(F.col("_k_average_cost")), missing_if_zero(F.col("unit_cost")), F.lit(0.0)),
    }
    rows = rows.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in swap.items()})
    rows = rows.withColumns({"preferred_unit_share_pct": F.col("_k_unit_share_pct"), "preferred_lines": F.col("_k_line_count"), "preferred_average_cost": F.col("_k_average_cost")})
    sp = of(supplier_policies, "_s_", *supplier_policies.columns)
    pp = of(product_policies, "_p_", *product_policies.columns)
    rows = rows.join(sp, (F.col("supplier_key") == F.col("_s_supplier_key")) & (F.col("currency_code") == F.col("_s_currency_code")), "left").join(pp, (F.col("supplier_key") == F.col("_p_supplier_key")) & (F.col("product_key") == F.col("_p_product_key")) & (F.col("currency_code") == F.col("_p_currency_code")), "left")
    has_s, has_p = F.col("_s_supplier_key").isNotNull(), F.col("_p_supplier_key").isNotNull()
    term = lambda own, theirs, given: F.coalesce(missing_if_zero(F.coalesce(own, theirs)), F.lit(given)).cast("int")
    options = F.filter("supplier_options", lambda o: o["supplier_key"] == F.col("supplier_key"))
    rows = rows.withColumns({
        "minimum_order_quantity": F.col("_p_minimum_order_quantity"), "pack_size": F.when(has_p, F.col("_p_pack_size")).otherwise(F.lit(1.0)),
        "effective_lead_time_days": term(F.col("_p_lead_time_days"), F.col("_s_default_lead_time_days"), lead_days), "effective_max_wait_days": term(F.col("_p_max_wait_days"), F.col("_s_max_wait_days"), wait_days),
        "minimum_order_amount": F.col("_s_minimum_order_amount"), "shipping_cost": F.coalesce("_s_shipping_cost", F.lit(0.0)), "free_shipping_threshold": F.col("_s_free_shipping_threshold"),
        "policy_configured": has_s | has_p, "policy_source": F.when(has_p, "producto").when(has_s, "proveedor").otherwise("estandar"),
        "supplier_score": F.when(chosen, F.lit(None).cast("double")).when(F.size(options) > 0, option_score(F.get(options, F.lit(0)))).otherwise(F.col("supplier_confidence_pct")),
    })
    days = F.lit(target_days + safety_days) + F.col("effective_lead_time_days")
    base = F.greatest(F.col("daily_velocity") * days - F.col("quantity_on_hand"), F.lit(0.0))
    pack = F.coalesce(missing_if_zero(F.col("pack_size")), F.lit(1.0))
    ordered = F.when(F.round(base, 9) > 0, F.ceil(F.round(F.greatest(base, F.coalesce("minimum_order_quantity", F.lit(0.0))) / pack, 9)).cast("double") * pack).otherwise(F.lit(0.0))
    rows = rows.withColumn("order_up_to_days", days).withColumn("recommended_quantity", ordered)
    rows = rows.withColumn("estimated_purchase_value", F.col("recommended_quantity") * F.col("unit_cost"))
    return rows.drop(*[c for c in rows.columns if c.startswith(("_w_", "_k_", "_n_", "_s_", "_p_"))])


def option_score(o) -> Column:
    """0 to 100: the share of the product's lines, 25 for any purchase date, 15 for three lines or more, 15 for the modal supplier."""
    history = F.when(o["last_purchase_date"].isNotNull(), 25).otherwise(0) + F.when(o["purchase_lines"] >= 3, 15).otherwise(0) + F.when(o["is_modal"], 15).otherwise(0)
    return F.least(F.lit(100.0), F.coalesce(o["confidence_pct"], F.lit(0.0)) * 0.45 + history)


def supplier_options(items: DataFrame, supplier_policies: DataFrame, product_policies: DataFrame, top: int = 3) -> DataFrame:
    """The suppliers that each item can come from, a row an option: its history, its terms by the policies, and a score.

    items are apply_policies rows. A supplier that a product's policy prefers comes first,
    with the history that the item took over from it and no score; the other options keep
    their order; at most top of each item. Terms are the product's policy's, else the supplier's.
    """
    given = items.select("product_key", "currency_code", F.explode("supplier_options").alias("o")).select("product_key", "currency_code", F.col("o.choice_rank").alias("_nth"), "o.*").drop("choice_rank")
    given = given.withColumn("supplier_score", option_score({c: F.col(c) for c in given.columns})).withColumn("_taken", F.lit(False))
    first_of = items.filter("supplier_source = 'politica_producto'")
    taken = first_of.select(F.col("product_key").alias("_tp"), F.col("supplier_key").alias("_ts"))
    others = given.join(taken, (F.col("product_key") == F.col("_tp")) & (F.col("supplier_key") == F.col("_ts")), "left_anti")
    nothing = F.lit(None).cast("double")
    preferred = first_of.select(
        "product_key", "currency_code", F.lit(0).alias("_nth"), "supplier_key", F.col("preferred_supplier").alias("supplier"), F.lit(False).alias("is_modal"), F.col("supplier_confidence_pct").alias("confidence_pct"),
        F.coalesce("preferred_unit_share_pct", F.lit(0.0)).alias("unit_share_pct"), F.col("preferred_lines").alias("purchase_lines"), F.col("preferred_average_cost").alias("average_unit_cost"), "last_unit_cost", "last_purchase_date",
        nothing.alias("supplier_score"), F.lit(True).alias("_taken"))
    rows = others.unionByName(preferred)
    nth = F.row_number().over(Window.partitionBy("product_key", "currency_code").orderBy("_nth", "supplier_key"))
    rows = rows.withColumn("position", nth).filter(F.col("position") <= top)
    sp = supplier_policies.select(*[F.col(c).alias(f"_s_{c}") for c in supplier_policies.columns])
    pp = product_policies.select(*[F.col(c).alias(f"_p_{c}") for c in product_policies.columns])
    rows = rows.join(sp, (F.col("supplier_key") == F.col("_s_supplier_key")) & (F.col("currency_code") == F.col("_s_currency_code")), "left")
    rows = rows.join(pp, (F.col("supplier_key") == F.col("_p_supplier_key")) & (F.col("product_key") == F.col("_p_product_key")) & (F.col("currency_code") == F.col("_p_currency_code")), "left")
    has_s, has_p, free = F.col("_s_supplier_key").isNotNull(), F.col("_p_supplier_key").isNotNull(), ~F.col("_taken")
    terms = {
        "is_preferred": F.col("_taken") | F.coalesce("_p_is_preferred", F.lit(False)), "policy_source": F.when(free, F.when(has_p, "producto").when(has_s, "proveedor").otherwise("estandar")),
        "minimum_order_quantity": F.when(free, F.col("_p_minimum_order_quantity")), "pack_size": F.when(free, F.when(has_p, F.col("_p_pack_size")).otherwise(F.lit(1.0))),
        "lead_time_days": F.when(free, F.coalesce("_p_lead_time_days", "_s_default_lead_time_days")), "max_wait_days": F.when(free, F.coalesce("_p_max_wait_days", "_s_max_wait_days")),
        "minimum_order_amount": F.when(free, F.col("_s_minimum_order_amount")), "shipping_cost": F.when(free, F.when(has_s, F.col("_s_shipping_cost")).otherwise(F.lit(0.0))), "free_shipping_threshold": F.when(free, F.col("_s_free_shipping_threshold")),
    }
    return rows.select("product_key", "currency_code", "position", "supplier_key", "supplier", "is_modal", "confidence_pct", "unit_share_pct", "purchase_lines", "average_unit_cost", "last_unit_cost", "last_purchase_date", "supplier_score", *[c.alias(n) for n, c in terms.items()])


def _place() -> Column:
    return F.struct("queue_rank", (-F.coalesce("queue_value", F.lit(0.0))).alias("v"), "product_key")


def plan_lines(items: DataFrame) -> DataFrame:
    """The product lines of supplier orders, a row a line: supplier_key (null: unassigned) and the place in the order by which lines are shown."""
    rows = items.filter("recommended_quantity > 0")
    return rows.select(
        "supplier_key", _place().alias("place"), "product_key", "name", "reference", "family", F.col("recommended_quantity").alias("quantity"), "unit_cost",
        F.col("estimated_purchase_value").alias("estimated_value"), "priority", "coverage_days", "supplier_source")


def purchase_plans(items: DataFrame, as_of: date) -> DataFrame:
    """One order a supplier of the items with a quantity: totals and decision with reason; its lines are in plan_lines. Terms are those of its first item in the queue."""
    rows = items.filter("recommended_quantity > 0")
    place = _place()
    terms = F.struct(label(F.col("preferred_supplier"), "Sin proveedor").alias("supplier"), "currency_code", "minimum_order_amount", "shipping_cost", "free_shipping_threshold", "effective_max_wait_days")
    n = lambda p: F.count(F.when(F.col("priority") == p, 1))
    # Scores and most values have eight places at most; sums of doubles would round by the order in which they were added.
    worth = F.round(F.sum(F.col("estimated_purchase_value").cast("decimal(28,8)")), 4).cast("double")
    score = F.sum(F.coalesce("supplier_score", F.lit(0.0)).cast("decimal(22,8)")).cast("decimal(22,8)") / F.count("*").cast("decimal(10,0)")
    g = rows.groupBy("supplier_key").agg(
        F.min_by(terms, place).alias("t"), F.count("*").alias("lines"), F.sum("recommended_quantity").alias("units"), worth.alias("estimated_value"), n("critical").alias("critical_lines"), n("high").alias("high_lines"),
        F.max("policy_configured").alias("policy_configured"), F.round(score, 6).cast("double").alias("supplier_score"))
    g = g.select("supplier_key", "t.*", *[c for c in g.columns if c not in ("supplier_key", "t")])
    minimum, value = F.coalesce("minimum_order_amount", F.lit(0.0)), F.col("estimated_value")
    rules = [
        (F.col("supplier_key").isNull(), "review", "No hay un proveedor identificado con suficiente evidencia."),
        (F.col("critical_lines") > 0, "buy_now", "Hay productos agotados o criticos con demanda reciente."),
        ((minimum > 0) & (value >= minimum), "buy_now", "El pedido alcanza el minimo del proveedor."),
        ((F.col("free_shipping_threshold") > 0) & (value >= F.col("free_shipping_threshold")), "complete_order", "El pedido alcanza el umbral de envio gratis."),
        (~F.col("policy_configured"), "review", "Configura minimo, plazo y transporte para decidir con precision."),
        (F.lit(True), "accumulate", "Acumular hasta completar el minimo o la proxima ventana."),
    ]
    said = lambda i: F.coalesce(*[F.when(r[0], F.lit(r[i])) for r in rules])
    return g.withColumns({"decision": said(1), "decision_reason": said(2), "amount_to_minimum": F.greatest(minimum - value, F.lit(0.0)), "next_review_date": F.date_add(F.lit(as_of), F.col("effective_max_wait_days")), "estimated_total_with_shipping": value + F.col("shipping_cost")})


def plan_order() -> list[Column]:
    """The order in which plans are shown."""
    rank = F.coalesce(*[F.when(F.col("decision") == d, i) for i, d in enumerate(DECISIONS)])
    return [rank, F.desc("estimated_value"), F.asc_nulls_first("supplier_key")]


def replenishment_summary(items: DataFrame, plans: DataFrame) -> DataFrame:
    a = items.agg(F.count("*").alias("recommended_products"), F.count(F.when(F.col("priority") == "critical", 1)).alias("critical_products"), F.round(F.coalesce(F.sum("estimated_purchase_value"), F.lit(0.0)), 4).alias("estimated_value"))
    n = lambda *d: F.count(F.when(F.col("decision").isin(*d), 1))
    b = plans.agg(n("buy_now", "complete_order").alias("suppliers_to_buy"), n("accumulate").alias("suppliers_to_accumulate"), n("review").alias("suppliers_to_review"))
    return a.join(b)  # one row each


def queue_by_priority(items: DataFrame) -> DataFrame:
    return items.groupBy("priority").agg(F.count("*").alias("products"), F.count(F.when(F.col("preferred_supplier").isNull(), 1)).alias("without_supplier"), F.round(F.sum("estimated_purchase_value"), 4).alias("estimated_value"))


def queue_by_supplier(items: DataFrame) -> DataFrame:
    return items.groupBy(label(F.col("preferred_supplier"), "Sin proveedor").alias("supplier"), "review_status").agg(F.count("*").alias("products"), F.round(F.sum("estimated_purchase_value"), 4).alias("estimated_value"))


def policy_overview(stats: DataFrame, supplier_policies: DataFrame, contacts: DataFrame, currency: str = DEFAULT_CURRENCY, top: int | None = 500) -> DataFrame:
    """Suppliers with purchases in the currency beside their policy."""
    history = stats.filter(F.col("currency_code") == currency).groupBy("supplier_key").agg(F.count_distinct("product_key").alias("products"), F.round(F.sum("amount"), 2).alias("historic_amount"))
    policies = supplier_policies.filter(F.col("currency_code") == currency).select(F.col("supplier_key").alias("_s"), "minimum_order_amount", "shipping_cost", "free_shipping_threshold", "default_lead_time_days", "max_wait_days")
    names = contacts.select(F.col("contact_key").alias("_c"), F.col("name").alias("supplier"))
    rows = history.join(names, F.col("supplier_key") == F.col("_c")).join(policies, F.col("supplier_key") == F.col("_s"), "left").withColumn("configured", F.col("_s").isNotNull()).drop("_c", "_s")
    return first(rows, top, F.desc("historic_amount"), "supplier_key")


def product_policy_overview(product_policies: DataFrame, products: DataFrame, contacts: DataFrame, currency: str = DEFAULT_CURRENCY, top: int | None = 2000) -> DataFrame:
    rows = product_policies.filter(F.col("currency_code") == currency).join(products.filter("not is_deleted").select(F.col("product_key").alias("_p"), F.col("name").alias("product")), F.col("product_key") == F.col("_p")).join(contacts.select(F.col("contact_key").alias("_c"), F.col("name").alias("supplier")), F.col("supplier_key") == F.col("_c")).drop("_p", "_c")
    return first(rows, top, "product", "supplier", "product_key", "supplier_key")


def upsert_policies(base: DataFrame, edits: DataFrame, keys: list[str], order: str, valid: DataFrame | None = None, valid_key: str | None = None) -> DataFrame:
    """base with edits, by keys: of edits of one key the last by order. Edits whose valid_key isn't in valid are left out."""
    if valid is not None:
        edits = edits.join(valid.select(F.col(valid_key).alias("_v")).distinct(), F.col(valid_key) == F.col("_v"), "left_semi")
    columns = base.columns
    last = edits.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("x")).select("x.*")
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_product_policies(base: DataFrame, edits: DataFrame, order: str, valid: DataFrame | None = None) -> DataFrame:
    """upsert_policies for product policies; a supplier that an edit prefers is the only one preferred for the product and currency."""
    out = upsert_policies(base, edits, ["product_key", "supplier_key", "currency_code"], order, valid, "product_key")
    newest = edits.filter("is_preferred").groupBy(F.col("product_key").alias("_p"), F.col("currency_code").alias("_c")).agg(F.max_by("supplier_key", order).alias("_only"))
    rows = out.join(newest, (F.col("product_key") == F.col("_p")) & (F.col("currency_code") == F.col("_c")), "left")
    return rows.withColumn("is_preferred", F.when(F.col("_only").isNull(), F.col("is_preferred")).otherwise(F.col("is_preferred") & (F.col("supplier_key") == F.col("_only")))).select(*base.columns)


def upsert_actions(base: DataFrame, edits: DataFrame, order: str, valid: DataFrame | None = None) -> DataFrame:
    """upsert_policies for review actions, with one of five states."""
    return upsert_policies(base, edits.filter(F.col("status").isin(*STATUSES)), ["product_key"], order, valid, "product_key")


def export_rows(items: DataFrame, plans: DataFrame) -> DataFrame:
    """Items beside their supplier's order, as 24 columns; items without a supplier meet the unassigned order."""
    o = plans.select(F.col("supplier_key").alias("_s"), *[F.col(c).alias(f"order_{c}") for c in ("decision", "decision_reason", "lines", "units", "estimated_value", "amount_to_minimum", "next_review_date", "estimated_total_with_shipping")])
    rows = items.join(o, F.col("supplier_key").eqNullSafe(F.col("_s")), "left")
    return rows.select("product_key", "reference", "name", "family", "priority", "reason", "quantity_on_hand", "units_sold", "daily_velocity", "coverage_days", "recommended_quantity", "unit_cost", "estimated_purchase_value", "currency_code", "preferred_supplier", "supplier_source", "order_decision", "order_decision_reason", "order_lines", "order_units", "order_estimated_value", "order_amount_to_minimum", "order_next_review_date", "order_estimated_total_with_shipping")
