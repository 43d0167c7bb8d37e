"""FIFO costing of sales lines.

layers: product_key, layer_id, opened_on, source (opening or purchase), source_document_id,
source_line_number, quantity, unit_cost. sales: document_type, document_id, line_number,
date, product_key, quantity, net_sales. Both may have a tenant_id; give one tenant's rows.

A product's layers, in order, lie one after the other on an axis of units, returns after all
others as they come. A sale takes the units from where the last one ended. What is asked
beyond the supply is lost and doesn't wait for later layers. So running sums give each
line's interval, and one ordered pass over all interval starts pairs lines with layers.
Running sums go by day and over the days' totals, and the axis of a product with many
intervals is cut into cells, so that no product's rows meet in one task.

A return costs what its product's units have cost so far. The value of the axis up to there
is known if the last unit taken is of an initial layer; else it follows from the return that
this unit is of. So returns are priced in rounds, each of all those whose source has a
price, over windows and joins.

fifo_allocate writes what several steps use below spark.checkpoint.dir and counts what is
left to price: its jobs run when it is called, not when its result is asked for.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.functions.cols import normalized_text
from martloom.functions.running import running
from martloom.sources.sinks import stored

LINE = ["document_type", "document_id", "line_number"]
UNITS = "decimal(28,4)"
COST = "decimal(28,10)"
#: Intervals of a product in a cell of its axis, on average.
CELL = 50_000


# Opening balances.


def match_opening(report: DataFrame, products: DataFrame) -> DataFrame:
    """The report with product_key and match: by reference if it has one and some product has it, else by name; 'ambiguous' where several do."""

    def catalogue(column: str, key: str) -> DataFrame:
        named = products.filter("not is_deleted").select(normalized_text(F.col(column)).alias(f"_{key}"), "product_key").filter(f"_{key} <> ''")
        return named.groupBy(f"_{key}").agg(F.min("product_key").alias(f"_{key}_product"), F.count("*").alias(f"_{key}_n"))

    rows = report.withColumn("_r", normalized_text(F.coalesce("reference", F.lit("")))).withColumn("_n", normalized_text(F.col("item")))
    rows = rows.join(catalogue("reference", "ref"), F.col("_r") == F.col("_ref"), "left").join(catalogue("name", "name"), F.col("_n") == F.col("_name"), "left")
    by_ref = F.col("_ref_n").isNotNull()
    n = F.when(by_ref, F.col("_ref_n")).otherwise(F.col("_name_n"))
    how = F.when(n.isNull(), "unmatched").when(n > 1, "ambiguous").when(by_ref, "reference").otherwise("name")
    product = F.when(n == 1, F.when(by_ref, F.col("_ref_product")).otherwise(F.col("_name_product")))
    return rows.withColumn("match", how).withColumn("product_key", product).drop("_r", "_n", "_ref", "_ref_product", "_ref_n", "_name", "_name_product", "_name_n")


def classify_opening(report: DataFrame, products: DataFrame) -> DataFrame:
    """match_opening with classification; only opening layers have an opening quantity and value."""
    rows = match_opening(report, products)
    q, known = F.col("quantity"), F.col("product_key").isNotNull()
    kind = (
        F.when(~known & (q < 0), "negative_unmatched").when(~known & (q == 0), "reference_unmatched").when(~known, "unmatched")
        .when(q < 0, "negative_exception").when(q == 0, "reference_only").when(F.col("average_cost").isNull(), "unpriced_exception").otherwise("opening_layer")
    )
    rows = rows.withColumn("classification", kind)
    is_layer = F.col("classification") == "opening_layer"
    return rows.withColumn("opening_quantity", F.when(is_layer, q)).withColumn("opening_value", F.when(is_layer, q * F.col("average_cost")))


def opening_summary(classified: DataFrame) -> DataFrame:
    """Rows, units and value of each classification."""
    return classified.groupBy("classification").agg(F.count("*").alias("rows"), F.coalesce(F.sum("opening_quantity"), F.lit(0)).cast("double").alias("units"), F.coalesce(F.sum("opening_value"), F.lit(0)).cast("double").alias("value"))


def opening_decision(runs: DataFrame, tenant_id: str, cutoff: date, content_hash: str) -> str:
    """What to do with an opening import: 'reuse' of the same content, 'reject' beside another succeeded one of the cutoff, else 'import'."""
    rows = runs.filter((F.col("tenant_id") == tenant_id) & (F.col("cutoff") == F.lit(cutoff)))
    if rows.filter((F.col("content_hash") == content_hash) & (F.col("status") != "failed")).limit(1).count():
        return "reuse"
    return "reject" if rows.filter(F.col("status").startswith("succeeded")).limit(1).count() else "import"


def opening_decisions(imports: DataFrame, runs: DataFrame) -> DataFrame:
    """opening_decision of many imports (tenant_id, cutoff, content_hash and what else they have) against one table of runs."""
    key = ["tenant_id", "cutoff"]
    of = lambda rows, keys, flag: rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn(flag, F.lit(True))
    on = lambda keys: [F.col(k) == F.col(f"_{k}") for k in keys]
    same = of(runs.filter("status <> 'failed'"), [*key, "content_hash"], "_same")
    done = of(runs.filter(F.col("status").startswith("succeeded")), key, "_done")
    rows = imports.join(same, on([*key, "content_hash"]), "left").select(*imports.columns, "_same").join(done, on(key), "left")
    return rows.select(*imports.columns, F.when(F.col("_same"), "reuse").when(F.col("_done"), "reject").otherwise("import").alias("decision"))


def opening_warehouse(warehouses: DataFrame, tenant_id: str, external_id: str | None = None) -> int:
    """Key of the one active warehouse of a tenant, or of the one with this external id; none or several are an error."""
    rows = warehouses.filter((F.col("tenant_id") == tenant_id) & ~F.col("is_deleted"))
    if external_id is not None:
        rows = rows.filter(F.col("external_id") == external_id)
    found = rows.select("warehouse_key").orderBy("warehouse_key").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"an opening report needs one active warehouse, not {'several' if found else 'none'}")
    return found[0][0]


def layer_warehouse(warehouses: DataFrame, tenant_id: str) -> int:
    """Key of the lowest active warehouse of a tenant, where cost layers lie; none is an error."""
    found = warehouses.filter((F.col("tenant_id") == tenant_id) & ~F.col("is_deleted")).agg(F.min("warehouse_key")).first()[0]
    if found is None:
        raise ValueError("no active warehouse")
    return found


def allocation_statuses(layers: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """allocation_status of each of many cutoffs (a column cutoff; repeats are one)."""
    opened = layers.filter("source = 'opening'").select(F.col("opened_on").alias("_d")).distinct()
    rows = cutoffs.select("cutoff").distinct().join(opened, F.col("cutoff") == F.col("_d"), "left")
    return rows.select("cutoff", F.when(F.col("_d").isNull(), "skipped_no_opening_basis").otherwise("ready").alias("status"))


def layer_warehouses(warehouses: DataFrame) -> DataFrame:
    """layer_warehouse of each tenant that has one."""
    return warehouses.filter("not is_deleted").groupBy("tenant_id").agg(F.min("warehouse_key").alias("warehouse_key"))


def allocation_status(layers: DataFrame, cutoff: date) -> str:
    """'skipped_no_opening_basis' if no opening layer opens at the cutoff, else 'ready'."""
    basis = layers.filter((F.col("source") == "opening") & (F.col("opened_on") == F.lit(cutoff)))
    return "ready" if basis.limit(1).count() else "skipped_no_opening_basis"


def cost_layers(classified: DataFrame, purchases: DataFrame, cutoff: date) -> DataFrame:
    """Opening layers, and a layer of each purchase line with a product, a quantity above 0 and a cost, from the cutoff."""
    opening = classified.filter("classification = 'opening_layer'").select("product_key", F.concat(F.lit("O"), F.col("row_number").cast("string")).alias("layer_id"), F.lit(cutoff).alias("opened_on"), F.lit("opening").alias("source"), F.lit(None).cast("string").alias("source_document_id"), F.col("row_number").cast("int").alias("source_line_number"), F.col("quantity").cast(UNITS).alias("quantity"), F.col("average_cost").cast(COST).alias("unit_cost"))
    bought = purchases.filter(~F.col("is_deleted") & F.col("product_key").isNotNull() & (F.col("quantity") > 0) & F.col("unit_cost").isNotNull() & (F.col("date") >= F.lit(cutoff)))
    bought = bought.select("product_key", F.concat(F.lit("P"), F.col("document_id"), F.lit("/"), F.col("line_number").cast("string")).alias("layer_id"), F.col("date").alias("opened_on"), F.lit("purchase").alias("source"), F.col("document_id").alias("source_document_id"), F.col("line_number").alias("source_line_number"), F.col("quantity").cast(UNITS).alias("quantity"), F.col("unit_cost").cast(COST).alias("unit_cost"))
    return opening.unionByName(bought)


def layer_order() -> list[Column]:
    return [F.col("opened_on"), (F.col("source") == "purchase"), F.coalesce("source_document_id", F.lit("")), F.col("source_line_number"), F.col("layer_id")]


# Allocation.


SALES_ORDER = ["_credit", "document_id", "line_number"]


def _lines(sales: DataFrame, cutoff: date | None) -> DataFrame:
    rows = sales.filter(F.col("quantity") != 0)
    return rows if cutoff is None else rows.filter(F.col("date") >= F.lit(cutoff))


def sales_sequence(sales: DataFrame, cutoff: date | None = None) -> DataFrame:
    """Lines with a quantity, from the cutoff, numbered for each product: by date, invoices before credit notes, document and line."""
    rows = _lines(sales, cutoff).withColumn("_credit", F.col("document_type") == "credit_note")
    return running(rows, "product_key", "date", SALES_ORDER, {"seq": ("sum", F.lit(1), True)}).withColumn("seq", F.col("seq").cast("int")).drop("_credit")


def intervals(sales: DataFrame, layers: DataFrame, cutoff: date | None = None) -> DataFrame:
    """sales_sequence with each line's place on its product's axis: takes [lo, hi), or for a return the layer [lo, hi) that it adds; used is what has been taken so far, supply the initial units.

    Products without any initial layer have no supply at all: their returns add nothing.
    """
    supply = layers.filter("quantity > 0").groupBy(F.col("product_key").alias("_s")).agg(F.sum("quantity").alias("supply"), F.sum(F.col("quantity") * F.col("unit_cost")).alias("supply_value"))
    zero, q = F.lit(0).cast(UNITS), F.col("quantity").cast(UNITS)
    taken, given = F.greatest(q, zero), F.greatest(-q, zero)
    first = Window.unboundedPreceding
    day = Window.partitionBy("_k").orderBy(*SALES_ORDER)
    upto = day.rowsBetween(first, 0)
    # Supply joins the days; lines are dealt once, by product and day in one column that is never null.
    local = _lines(sales, cutoff).withColumn("_credit", F.col("document_type") == "credit_note").withColumn("_k", F.struct(F.col("product_key").alias("p"), F.col("date").alias("d")))
    local = local.select("*", F.sum(q).over(upto).alias("_net"), F.sum(taken).over(upto).alias("_asked"), F.sum(given).over(upto).alias("_back"), F.row_number().over(day).alias("_nth"))
    local = local.select("*", F.max("_net").over(upto).alias("_top"), F.max("_net").over(day.rowsBetween(first, -1)).alias("_top_before"))
    past = Window.partitionBy("_p").orderBy("_d").rowsBetween(first, -1)
    days = local.groupBy(F.col("_k").alias("_of")).agg(F.sum(q).alias("_n"), F.sum(taken).alias("_a"), F.sum(given).alias("_b"), F.max("_net").alias("_t"), F.count("*").alias("_rows"))
    days = days.select("_of", F.col("_of.p").alias("_p"), F.col("_of.d").alias("_d"), "_n", "_a", "_b", "_t", "_rows")
    days = days.select("_of", "_p", "_d", "_t", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in ("_n", "_a", "_b", "_rows")])
    days = days.withColumn("_high", F.max(F.col("_n") + F.col("_t")).over(past)).join(supply, F.col("_p") == F.col("_s"), "left").drop("_t", "_p", "_d", "_s")
    rows = local.join(days, F.col("_k") == F.col("_of"))
    lost = lambda high: F.greatest(high - F.col("supply"), zero)
    asked, back = F.col("_a") + F.col("_asked"), F.col("_b") + F.col("_back")
    used = asked - lost(F.greatest(F.col("_high"), F.col("_n") + F.col("_top")))
    start = asked - q - lost(F.greatest(F.col("_high"), F.col("_n") + F.col("_top_before")))
    is_return = F.col("quantity") < 0
    lo = F.when(is_return, F.col("supply") + back + q).otherwise(start)
    hi = F.when(is_return, F.col("supply") + back).otherwise(used)
    seq = (F.col("_rows") + F.col("_nth")).cast("int").alias("seq")
    return rows.select(*sales.columns, seq, "supply", "supply_value", lo.cast(UNITS).alias("lo"), hi.cast(UNITS).alias("hi"), used.cast(UNITS).alias("used"))


def met(placed: DataFrame, layers: DataFrame, cell: int = CELL) -> DataFrame:
    """Which layer lies where: a row for each stretch that a line takes from a layer (sale), and for each return with units taken before, at the layer of the last of them (ask)."""
    nothing = lambda kind: F.lit(None).cast(kind)
    first = running(layers.filter("quantity > 0"), "product_key", "opened_on", layer_order(), {"_hi": ("sum", F.col("quantity"), True), "_worth": ("sum", F.col("quantity") * F.col("unit_cost"), False)})
    worth = F.col("_worth").cast("double").alias("worth")
    of_layer = F.struct((F.col("_hi") - F.col("quantity")).cast(UNITS).alias("lo"), F.col("_hi").cast(UNITS).alias("hi"), "layer_id", "unit_cost", nothing("int").alias("return_seq"), worth, "source", "source_document_id", "source_line_number")
    supply = first.select("product_key", (F.col("_hi") - F.col("quantity")).cast(UNITS).alias("lo"), F.col("_hi").cast(UNITS).alias("hi"), of_layer.alias("layer"))
    name = F.concat(F.lit("R"), F.col("document_id"), F.lit("/"), F.col("line_number").cast("string")).alias("layer_id")
    of_return = F.struct("lo", "hi", name, nothing(COST).alias("unit_cost"), F.col("seq").alias("return_seq"), nothing("double").alias("worth"), F.lit("return").alias("source"), nothing("string").alias("source_document_id"), nothing("int").alias("source_line_number"))
    back = placed.filter("quantity < 0 and supply is not null")
    takes = placed.filter("quantity > 0 and hi > lo and supply is not null").select("product_key", "lo", "hi", F.struct("hi", "seq", *LINE).alias("sale"))
    asks = back.filter("used > 0").select("product_key", F.col("used").alias("lo"), F.col("used").alias("hi"), F.col("seq").alias("ask"))
    spans = supply.unionByName(back.select("product_key", "lo", "hi", of_return.alias("layer"))).unionByName(takes, True).unionByName(asks, True)
    ends = back.select("product_key", "hi").unionByName(takes.select("product_key", "hi")).unionByName(asks.select("product_key", "hi")).groupBy("product_key").agg(F.count("*").alias("n"), F.max("hi").alias("hi"))
    ends = ends.unionByName(layers.filter("quantity > 0").groupBy("product_key").agg(F.count("*").alias("n"), F.sum("quantity").cast(UNITS).alias("hi")))
    parts = F.ceil(F.sum("n") / cell)
    sizes = ends.groupBy(F.col("product_key").alias("_p")).agg(parts.alias("_parts"), (F.ceil(F.max("hi") / parts * 10000) / 10000).cast(UNITS).alias("_width")).filter("_parts > 1").drop("_parts")
    sizes = stored(sizes)  # few: spans needn't be dealt to meet them
    spans = spans.join(sizes, F.col("product_key") == F.col("_p"), "left").drop("_p")
    least = F.lit("0.0001").cast(UNITS)
    of_cell = lambda x: F.floor(x / F.col("_width")).cast("long")
    cells = F.sequence(of_cell(F.when(F.col("ask").isNull(), F.col("lo")).otherwise(F.col("lo") - least)), of_cell(F.col("hi") - least))
    spans = spans.withColumn("_cell", F.explode(F.when(F.col("_width").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)))
    pos = F.when(F.col("ask").isNotNull(), F.col("lo")).otherwise(F.greatest(F.col("lo"), (F.col("_cell") * F.col("_width")).cast(UNITS)))
    spans = spans.withColumn("pos", pos).withColumn("_end", ((F.col("_cell") + 1) * F.col("_width")).cast(UNITS))
    order = Window.partitionBy("product_key", "_cell").orderBy("pos", F.when(F.col("ask").isNotNull(), -1).otherwise(F.coalesce("sale.seq", F.lit(0))))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    here = spans.select("product_key", "pos", "ask", "_end", F.lead("pos").over(order).alias("_next"), F.last("layer", True).over(upto).alias("layer"), F.last("sale", True).over(upto).alias("sale"))
    taken = (F.least("_next", "_end", "sale.hi", "layer.hi") - F.col("pos")).cast(UNITS)
    here = here.withColumn("taken", F.when(F.col("ask").isNull(), taken)).filter("layer is not null and (ask is not null or sale is not null and taken > 0)")
    return here.select("product_key", "pos", "taken", F.when(F.col("ask").isNull(), F.col("sale")).alias("sale"), "layer", "ask", F.col("_end").isNotNull().alias("cut"))


def segments(found: DataFrame) -> DataFrame:
    """Lines and the layers that they take from: product_key, the line, seq, pos, taken, and of the layer layer_id, unit_cost (null for returns), return_seq and source. What the limit of a cell cut is one again."""
    rows = found.filter("ask is null")
    of_layer = ["layer_id", "unit_cost", "return_seq", "source", "source_document_id", "source_line_number"]
    key = ["product_key", *LINE, "seq", *of_layer]
    flat = rows.select("product_key", *[F.col(f"sale.{c}").alias(c) for c in LINE], F.col("sale.seq").alias("seq"), "pos", "taken", *[F.col(f"layer.{c}").alias(c) for c in of_layer], "cut")
    again = flat.filter("cut").groupBy(*key).agg(F.min("pos").alias("pos"), F.sum("taken").cast(UNITS).alias("taken"))
    return flat.filter("not cut").drop("cut").unionByName(again)


def priced(state: DataFrame) -> DataFrame:
    """One round: of the groups of returns without a price those get one whose source has it. The groups with a price are the first of each product."""
    worth = running(state, "product_key", "date", ["lo"], {"_worth": ("sum", F.col("q") * F.col("x"), False)})
    known = worth.filter("x is not null").select(F.col("product_key").alias("_p"), F.col("lo").alias("_lo"), (F.col("supply_value") + F.col("_worth")).alias("_v"), F.col("x").alias("_x"))
    found = state.join(known, (F.col("product_key") == F.col("_p")) & (F.col("source_lo") == F.col("_lo")), "left")
    x = (F.col("_v") + (F.col("used") - F.col("_lo")) * F.col("_x")) / F.col("used")
    return found.withColumn("x", F.coalesce("x", x)).select(*state.columns)


def return_costs(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(product_key, seq, unit_cost) of returns with supply: cost per unit of all units taken before, else the average of the initial layers.

    Returns that follow one another without a sale between them, or each with nothing left
    in stock, have one price and are one group. There are as many rounds as groups that
    follow from one another in some product, two for each table that is written.
    """
    number = lambda c: F.col(c).cast("double")
    asked = found.filter("ask is not null").select(F.col("product_key").alias("_p"), F.col("ask").alias("_ask"), F.col("layer.lo").cast("double").alias("_lo"), number("layer.unit_cost").alias("_cost"), F.col("layer.worth").alias("_worth"), F.col("layer.return_seq").alias("_return"))
    rows = placed.filter("quantity < 0 and supply is not null").join(asked, (F.col("product_key") == F.col("_p")) & (F.col("seq") == F.col("_ask")), "left")
    plain = F.when(F.col("_ask").isNull(), number("supply_value") / number("supply")).when(F.col("_return").isNull(), (F.col("_worth") + (number("used") - F.col("_lo")) * F.col("_cost")) / number("used"))
    rows = rows.select("product_key", "seq", "date", number("lo").alias("lo"), (-number("quantity")).alias("q"), number("used").alias("used"), number("supply_value").alias("supply_value"), F.when(F.col("_return").isNotNull(), F.col("_lo")).alias("source_lo"), plain.alias("x"))
    chained = rows.filter("source_lo is not null").select(F.col("product_key").alias("_c")).distinct()
    easy = rows.join(chained, F.col("product_key") == F.col("_c"), "left_anti")
    hard = rows.join(chained, F.col("product_key") == F.col("_c"), "left_semi")
    before = running(hard, "product_key", "date", ["lo"], {"_used": ("max", F.col("used"), False), "_lo": ("max", F.col("lo"), False)})
    same = (F.col("used") == F.col("_used")) | ((F.col("used") == F.col("lo")) & (F.col("_used") == F.col("_lo")))
    before = before.withColumn("_first", F.when(~F.coalesce(same, F.lit(False)), F.col("lo"))).drop("_used", "_lo")
    grouped = stored(running(before, "product_key", "date", ["lo"], {"group": ("max", F.col("_first"), True)}).drop("_first"))
    first = F.min_by(F.struct("date", "used", "supply_value", "source_lo", "x"), "lo").alias("f")
    state = grouped.groupBy("product_key", F.col("group").alias("lo")).agg(F.sum("q").alias("q"), first).select("product_key", "lo", "q", "f.*")
    of = grouped.select(F.col("product_key").alias("_p"), F.col("lo").alias("_lo"), F.col("group").alias("_group"))
    state = state.join(of, (F.col("product_key") == F.col("_p")) & (F.col("source_lo") == F.col("_lo")), "left").withColumn("source_lo", F.col("_group")).drop("_p", "_lo", "_group")
    state = stored(state)
    while state.filter("x is null").limit(1).count():
        state = stored(priced(priced(state)))
    prices = state.select(F.col("product_key").alias("_p"), F.col("lo").alias("_lo"), F.col("x").alias("_x"))
    done = grouped.drop("x").join(prices, (F.col("product_key") == F.col("_p")) & (F.col("group") == F.col("_lo"))).select("product_key", "seq", F.col("_x").alias("x"))
    return easy.select("product_key", "seq", "x").unionByName(done).select("product_key", "seq", F.col("x").cast(COST).alias("unit_cost"))


def fifo_allocate(sales: DataFrame, layers: DataFrame, cutoff: date | None = None, cell: int = CELL) -> DataFrame:
    """All allocations: consumed segments (fifo), returns (credit_note_return) and what could not be costed (unavailable).

    The last consumed segment of a line takes up the rounding, so that a line's segments
    add up to its cost rounded to cents. A line without a product is unavailable as a whole.
    """
    layers = stored(layers)
    placed = stored(intervals(sales.select(*LINE, "date", "product_key", "quantity"), layers, cutoff))
    found = stored(met(placed, layers, cell))
    cut = segments(found)
    costs = return_costs(placed, found)
    of_layer = costs.select(F.col("product_key").alias("_p"), F.col("seq").alias("_s"), F.col("unit_cost").alias("_cost"))
    of_returns = cut.filter("return_seq is not null").join(of_layer, (F.col("product_key") == F.col("_p")) & (F.col("return_seq") == F.col("_s")), "left").withColumn("unit_cost", F.col("_cost")).drop("_p", "_s", "_cost")
    used = cut.filter("return_seq is null").unionByName(of_returns)
    line = Window.partitionBy(*LINE)
    order = line.orderBy("pos")
    exact = (F.col("taken") * F.col("unit_cost")).cast(COST)
    used = used.withColumn("_exact", exact).withColumn("sequence", (F.row_number().over(order) - 1).cast("int")).withColumn("_n", F.count("*").over(line)).withColumn("_all", F.sum("_exact").over(line)).withColumn("_sum", F.sum("_exact").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    amount = F.when(F.col("sequence") == F.col("_n") - 1, F.round("_all", 2) - (F.col("_sum") - F.col("_exact"))).otherwise(F.col("_exact"))
    shared = ["product_key", *LINE]
    used = used.select(*shared, "sequence", F.col("taken").alias("quantity_allocated"), "unit_cost", amount.cast(COST).alias("cost_amount"), F.lit("fifo").alias("allocation_type"), F.when(F.col("source") == "opening", "certified").otherwise("source").alias("confidence"), "layer_id", "source_document_id", "source_line_number", F.col("_exact").alias("exact_cost"))
    nothing = [F.lit(None).cast("string").alias("source_document_id"), F.lit(None).cast("int").alias("source_line_number")]
    back = placed.filter("quantity < 0").join(costs.select(F.col("product_key").alias("_p"), F.col("seq").alias("_s"), "unit_cost"), (F.col("product_key") == F.col("_p")) & (F.col("seq") == F.col("_s")))
    back_cost = (F.col("quantity") * F.col("unit_cost")).cast(COST)
    back = back.select(*shared, F.lit(0).alias("sequence"), F.col("quantity").cast(UNITS).alias("quantity_allocated"), "unit_cost", F.round(back_cost, 2).cast(COST).alias("cost_amount"), F.lit("credit_note_return").alias("allocation_type"), F.lit("estimated").alias("confidence"), F.concat(F.lit("R"), F.col("document_id"), F.lit("/"), F.col("line_number").cast("string")).alias("layer_id"), *nothing, back_cost.alias("exact_cost"))
    n_used = cut.groupBy(*[F.col(c).alias(f"_{c}") for c in LINE]).agg(F.count("*").cast("int").alias("_segments"))
    short = placed.withColumn("_missing", F.when(F.col("quantity") > 0, F.col("quantity") - F.coalesce(F.when(F.col("supply").isNotNull(), F.col("hi") - F.col("lo")), F.lit(0))).when(F.col("supply").isNull(), F.col("quantity"))).filter("_missing <> 0")
    short = short.join(n_used, (F.col("document_type") == F.col("_document_type")) & (F.col("document_id") == F.col("_document_id")) & (F.col("line_number") == F.col("_line_number")), "left")
    missing = short.select(*shared, F.coalesce("_segments", F.lit(0)).alias("sequence"), F.col("_missing").cast(UNITS).alias("quantity_allocated"))
    missing = missing.select("*", F.lit(None).cast(COST).alias("unit_cost"), F.lit(0).cast(COST).alias("cost_amount"), F.lit("unavailable").alias("allocation_type"), F.lit("unavailable").alias("confidence"), F.lit(None).cast("string").alias("layer_id"), *nothing, F.lit(0).cast(COST).alias("exact_cost"))
    return used.unionByName(back).unionByName(missing)


def line_costs(sales: DataFrame, allocations: DataFrame) -> DataFrame:
    """Each allocated line's costed and uncosted units, cost, status, unit cost, margin and confidence."""
    missing = F.col("allocation_type") == "unavailable"
    g = allocations.groupBy(*LINE).agg(
        F.coalesce(F.sum(F.when(~missing, F.col("quantity_allocated"))), F.lit(0)).cast(UNITS).alias("costed_quantity"), F.coalesce(F.sum(F.when(missing, F.col("quantity_allocated"))), F.lit(0)).cast(UNITS).alias("uncosted_quantity"), F.round(F.sum("exact_cost"), 2).cast("decimal(18,2)").alias("cogs"))
    rows = sales.select(*LINE, "product_key", "quantity", "net_sales").join(g, LINE)
    whole = F.col("uncosted_quantity") == 0
    status = F.when(~whole & (F.col("costed_quantity") != 0), "partial").when(~whole, "unavailable").when(F.col("document_type") == "credit_note", "estimated").otherwise("costed")
    rows = rows.withColumn("cost_status", status)
    known = F.col("cost_status").isin("costed", "estimated")
    return rows.withColumn("unit_cost", F.when(known, F.try_divide(F.col("cogs").cast("double"), F.col("quantity").cast("double")))).withColumn("margin", F.when(known, F.col("net_sales") - F.col("cogs"))).withColumn(
        "confidence", F.when(F.col("cost_status") == "costed", "certified_or_source").when(F.col("cost_status") == "unavailable", "unavailable").otherwise(F.col("cost_status")))


def apply_costs(sales: DataFrame, costs: DataFrame, cutoff: date) -> DataFrame:
    """Sales facts with their costs: outside_scope before the cutoff, unavailable unless computed, method fifo."""
    found = costs.select(*[F.col(c).alias(f"_{c}") for c in LINE], F.col("cost_status").alias("_status"), F.col("cogs").alias("_cogs"), F.col("margin").alias("_margin"))
    rows = sales.drop("cost_status", "cogs", "margin").join(found, [F.col(c) == F.col(f"_{c}") for c in LINE], "left")
    early = F.col("date") < F.lit(cutoff)
    rows = rows.withColumn("cost_status", F.when(early, "outside_scope").otherwise(F.coalesce("_status", F.lit("unavailable"))))
    return rows.withColumn("cogs", F.when(~early, F.col("_cogs"))).withColumn("margin", F.when(~early, F.col("_margin"))).withColumn("cost_method", F.when(F.col("_status").isNotNull() & ~early, "fifo")).drop(*[f"_{c}" for c in LINE], "_status", "_cogs", "_margin")


def layer_balances(layers: DataFrame, allocations: DataFrame) -> DataFrame:
    """Original, taken and remaining units of each layer, those of returns included."""
    returns = allocations.filter("allocation_type = 'credit_note_return'").select("product_key", "layer_id", F.lit("return").alias("source"), (-F.col("quantity_allocated")).cast(UNITS).alias("quantity"), "unit_cost")
    every = layers.select("product_key", "layer_id", "source", F.col("quantity").cast(UNITS).alias("quantity"), F.col("unit_cost").cast(COST).alias("unit_cost")).unionByName(returns)
    taken = allocations.filter("allocation_type = 'fifo'").groupBy(F.col("product_key").alias("_p"), F.col("layer_id").alias("_l")).agg(F.sum("quantity_allocated").alias("_taken"))
    rows = every.join(taken, (F.col("product_key") == F.col("_p")) & (F.col("layer_id") == F.col("_l")), "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast(UNITS)).withColumn("remaining", (F.col("quantity") - F.col("taken")).cast(UNITS))
    return rows.select("product_key", "layer_id", "source", "quantity", "taken", "remaining", F.when(F.col("remaining") > 0, "open").otherwise("depleted").alias("status"))


def run_summary(costs: DataFrame) -> DataFrame:
    """One row: lines by status, units, cost, and whether the run had exceptions."""
    n = lambda status: F.count(F.when(F.col("cost_status").isin(*status), 1))
    g = costs.agg(F.count("*").alias("lines_read"), n(["costed", "estimated"]).alias("lines_costed"), n(["partial"]).alias("lines_partial"), n(["unavailable"]).alias("lines_unavailable"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("double").alias("sales_units"), F.coalesce(F.sum("costed_quantity"), F.lit(0)).cast("double").alias("costed_units"), F.coalesce(F.sum("cogs"), F.lit(0)).cast("double").alias("cogs"))
    return g.withColumn("status", F.when((F.col("lines_partial") + F.col("lines_unavailable")) > 0, "succeeded_with_exceptions").otherwise("succeeded"))


def cost_status_summary(fact: DataFrame) -> DataFrame:
    return fact.groupBy("cost_status").agg(F.count("*").alias("lines"), F.coalesce(F.sum("net_sales"), F.lit(0)).cast("double").alias("net_sales"), F.coalesce(F.sum("cogs"), F.lit(0)).cast("double").alias("cogs"), F.coalesce(F.sum("margin"), F.lit(0)).cast("double").alias("margin"))


def opening_value(layers: DataFrame) -> DataFrame:
    """Layers, units and value at the cutoff."""
    return layers.filter("source = 'opening'").agg(F.count("*").alias("layers"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("double").alias("units"), F.coalesce(F.sum(F.col("quantity") * F.col("unit_cost")), F.lit(0)).cast("double").alias("value"))
