"""Finance-pack jobs over the driver tables.

Stand-ins: an *entity* (company) is ``l_suppkey``; a fact is a lineitem row
(concept from the return flag, unit from the line status, form from the line
number parity, filed/end dates from the ship date); a facts document is one
lineitem nested as ``facts.us-gaap.{concept}.units.{unit}[]``; a filing
index is one lineitem's filings as parallel arrays; a price series is a
user's events (close = value, newest first by ``ts``); a macro series is an
event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts as fx
from ..sources.tables import table

WANTED_UNIT = "USD"
# Metric -> ordered concepts (the stand-in of the ten metric definitions).
METRICS = [("revenue", ["SalesRevenueNet", "Revenues"]), ("net_income", ["NetIncomeLoss"])]
FORM_PERIOD = [("10-K", "annual"), ("10-Q", "quarterly")]


def _concept():
    return (F.when(F.col("l_returnflag") == "R", "Revenues").when(F.col("l_returnflag") == "A", "SalesRevenueNet")
            .otherwise("NetIncomeLoss"))


def fact_rows(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("entity"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
        _concept().alias("concept"),
        F.when(F.col("l_linestatus") == "F", "USD").otherwise("EUR").alias("unit"),
        F.col("l_extendedprice").alias("val"),
        F.year("l_shipdate").cast("bigint").alias("fy"),
        F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("fp"),
        F.when(F.col("l_linenumber") % 2 == 1, "10-K").otherwise("10-Q").alias("form"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("filed"),
        F.date_format(F.date_sub(F.to_date("l_shipdate"), F.col("l_linenumber") * 30), "yyyy-MM-dd").alias("end"),
    )


def _metric_dim(spark):
    rows = [(m, c, i) for m, cs in METRICS for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "metric string, concept string, concept_ordinal int")


def fact_documents(spark, sf) -> DataFrame:
    """One nested facts JSON document per lineitem (no grouping, so no group
    can grow with skew): ``facts.us-gaap.{concept}.units`` holds the row's
    unit and, for returned lines (flag ``R``), a second ``AUD`` unit listed
    first, so the wanted unit is sometimes absent and sometimes not first."""
    f = fact_rows(spark, sf)
    rec = F.struct("val", "fy", "fp", "form", "filed", "end", F.lit(None).cast("string").alias("frame"))
    aud = F.struct((F.col("val") * 2).alias("val"), "fy", "fp", "form", "filed", "end",
                   F.lit(None).cast("string").alias("frame"))
    units = F.when(F.col("l_returnflag") == "R",
                   F.create_map(F.lit("AUD"), F.array(aud), F.col("unit"), F.array(rec))) \
        .otherwise(F.create_map(F.col("unit"), F.array(rec)))
    gaap = F.create_map(F.col("concept"), F.struct(units.alias("units")))
    doc = F.to_json(F.struct(F.struct(gaap.alias("us-gaap")).alias("facts")))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "entity", doc.alias("doc"))


def explode_nested_facts(spark, sf):
    docs = fact_documents(spark, sf)
    out = fx.explode_facts(docs, "doc", ["l_orderkey", "l_linenumber", "l_partkey", "entity"], WANTED_UNIT)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "entity", "concept", "unit",
                      F.col("pos").cast("int").alias("pos"), "val", "fy", "fp", "form", "filed", "end")


def _latest(spark, sf) -> DataFrame:
    f = fact_rows(spark, sf).join(F.broadcast(_metric_dim(spark)), "concept")
    return fx.latest_fact(f, ["entity", "form", "concept"], ["l_orderkey", "l_linenumber", "l_partkey", "val"])


def latest_fact(spark, sf):
    return _latest(spark, sf).select("entity", "form", "concept", "val", "filed", "end", "l_orderkey", "l_linenumber")


def _preferred(spark, sf) -> DataFrame:
    return fx.preferred_concept(_latest(spark, sf), ["entity", "form", "metric"], "concept_ordinal")


def preferred_concept(spark, sf):
    return _preferred(spark, sf).select("entity", "form", "metric", "concept", "val", "filed", "end")


def unpivot_metrics(spark, sf):
    """Wide per-entity metric structs (annual/quarterly x metric) unpivoted
    to long rows; absent metrics dropped, absent attributes become ''."""
    pref = _preferred(spark, sf).withColumn(
        "slot", F.concat(F.when(F.col("form") == "10-K", "annual").otherwise("quarterly"), F.lit("__"), F.col("metric")))
    slots = [f"{p}__{m}" for _f, p in FORM_PERIOD for m, _c in METRICS]
    wide = pref.groupBy("entity").pivot("slot", slots).agg(
        F.first(F.struct("concept", "val", F.col("fy").cast("string").alias("fy"), "fp", "form", "filed", "end")))
    long = wide.unpivot("entity", slots, "slot", "m").filter(F.col("m").isNotNull())
    parts = F.split("slot", "__")
    return long.select(
        "entity", parts[0].alias("period_type"), parts[1].alias("metric_key"), F.col("m.concept").alias("concept"),
        F.col("m.val").alias("value"),
        *[F.coalesce(F.col(f"m.{c}"), F.lit("")).alias(c) for c in ("fy", "fp", "form", "filed", "end")])


def filing_lists(spark, sf, li: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """One filing index per lineitem with parallel arrays (form,
    accession, document, filing date): the line's own filing and, for open
    lines, a follow-up ``8-K``; closed lines add a non-kept ``S-1`` first.
    Built per row, so no group grows with the data. ``li``: lineitems with further columns, of which ``also`` are kept."""
    li = table(spark, sf, "lineitem") if li is None else li
    form = (F.when(F.col("l_returnflag") == "R", "10-K").when(F.col("l_returnflag") == "A", "10-Q")
            .otherwise("DEF 14A"))
    acc = F.when(F.col("l_linenumber") == 3, F.lit("")).otherwise(
        F.format_string("%010d-%02d-%06d", F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey")))
    doc = F.concat(F.lit("doc"), F.col("l_partkey").cast("string"), F.lit(".htm"))
    fdate = F.date_format("l_shipdate", "yyyy-MM-dd")
    is_open = F.col("l_linestatus") == "O"
    forms = F.when(is_open, F.array(form, F.lit("8-K"))).otherwise(F.array(F.lit("S-1"), form))
    accs = F.when(is_open, F.array(acc, F.concat(acc, F.lit("-8")))).otherwise(F.array(F.concat(acc, F.lit("-s")), acc))
    docs = F.when(is_open, F.array(doc, F.lit("event.htm"))).otherwise(F.array(F.lit(""), doc))
    dates = F.array(fdate)  # shorter array: the second filing has no date
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *also,
                     F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("cik"),
                     forms.alias("form_arr"), accs.alias("acc_arr"), docs.alias("doc_arr"), dates.alias("fdate_arr"))


def _field(name: str):
    return lambda r: r[name]


def _kept_filings(spark, sf, li: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    z = fx.zip_explode(filing_lists(spark, sf, li, also), ["l_orderkey", "l_linenumber", "l_partkey", *also, "cik"],
                       {"form": "form_arr", "accession": "acc_arr", "document": "doc_arr", "filing_date": "fdate_arr"})
    z = z.filter(fx.keep_filing(F.col("form"), F.col("accession"), F.col("document")))
    return z.withColumn("idx", F.col("idx").cast("int"))


def _told(z: DataFrame, *also: str) -> DataFrame:
    """Kept filings with their URL and use."""
    return z.select("l_orderkey", "l_linenumber", "l_partkey", *also, "cik", "idx", "form", "accession", "document",
                    "filing_date", fx.filing_url(F.col("cik"), F.col("accession"), F.col("document")).alias("sec_url"),
                    F.array_join(fx.form_use(F.col("form")), "; ").alias("agent_use"))


def _filings(spark, sf) -> DataFrame:
    return _told(_kept_filings(spark, sf))


def _first_filings(spark, sf, n: int) -> DataFrame:
    """The first ``n`` kept filings of each company (customer) in source order, ``rank`` 1 to ``n``.

    Lineitems meet their orders by the few columns that filings are made of; the strings are made of them
    behind that shuffle, and the URL only of the filings that are left."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
                                             "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # A filing is cut by what it is ordered by, next to its line's own columns; the rest is read again behind the cut.
    line = ("o_custkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    z = _kept_filings(spark, sf, li, line).select("l_orderkey", "l_linenumber", "l_partkey", *line, "accession", "idx")
    top = fx.first_n_per_key(z, ["o_custkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                                                F.col("accession"), F.col("idx")], n).drop("accession")
    again = filing_lists(spark, sf, top, ("o_custkey", "rank", "idx"))
    named = {"form": "form_arr", "accession": "acc_arr", "document": "doc_arr", "filing_date": "fdate_arr"}
    return _told(again.select("*", *[F.get(src, F.col("idx")).alias(name) for name, src in named.items()]), "o_custkey", "rank")


def zip_explode_filings(spark, sf):
    return _filings(spark, sf)


def recent_filings(spark, sf):
    """First 10 kept filings per company (customer) in source order."""
    top = _first_filings(spark, sf, 10)
    return top.select("o_custkey", F.col("rank").cast("int").alias("rank"), "l_orderkey", "idx", "form", "sec_url")


def window_change_pct(spark, sf):
    ev = fx.valid_prices(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "ts", "value")
    pos = ev.withColumn("pos", F.struct("ts", "event_id"))
    out = fx.window_change_pct(pos, ["user_id"], "pos", "value", newest_is_min=False)
    return out.select("user_id", "newest", "oldest", "change_pct")


def _macro_value():
    return F.when(F.col("value") < 1, F.lit(".")).otherwise(F.col("value").cast("string"))


def last_n_per_key(spark, sf):
    """Last 24 valid observations per series (event type), oldest first."""
    ev = table(spark, sf, "events").select("event_type", "event_id", "ts", _macro_value().alias("raw_value"))
    v = F.when(F.col("raw_value").isin(".", ""), F.lit(None)).otherwise(F.col("raw_value").try_cast("double"))
    ok = ev.withColumn("value", v).filter(F.col("value").isNotNull() & ~F.isnan("value")
                                          & (F.abs("value") != float("inf")))
    top = fx.first_n_per_key(ok, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 24)
    return top.select("event_type", (F.lit(25) - F.col("rank")).cast("int").alias("position"), "event_id", "ts", "value")


def latest_per_key(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    best = ev.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"),
                                              F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", "b.*")


def share_of_total(spark, sf):
    """Percent of all records per class; the total is a scalar subquery (no
    single-partition window)."""
    src = table(spark, sf, "events")
    ev = src.groupBy("event_type").agg(F.count(F.lit(1)).alias("records"))
    total = src.agg(F.count(F.lit(1))).scalar()
    pct = F.round((F.col("records") * 100).cast("decimal(38,6)") / total, 2).cast("double")
    return ev.select("event_type", "records", pct.alias("share_pct"))


def dataset_cards(spark, sf):
    li = table(spark, sf, "lineitem")
    ev = table(spark, sf, "events")
    facts = li.agg(F.count_distinct("l_suppkey").alias("n")).select(
        F.lit("dataset-fundamentals").alias("card_id"), F.lit("example_entities").alias("measure"), "n")
    filings = _filings(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("dataset-filing-events").alias("card_id"), F.lit("record_count").alias("measure"), "n")
    macro = ev.agg(F.count_distinct("event_type").alias("n")).select(
        F.lit("dataset-macro-panel").alias("card_id"), F.lit("indicator_count").alias("measure"), "n")
    prices = ev.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("dataset-recent-ohlcv").alias("card_id"), F.lit("record_count").alias("measure"), "n")
    return facts.unionByName(filings).unionByName(macro).unionByName(prices).select(
        "card_id", "measure", F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------------------
# The facts chain on nested documents, and the company snapshot
# ---------------------------------------------------------------------------
CONCEPTS = [c for _m, _l, cs, _u in fx.METRICS for c in cs]
EPS = "EarningsPerShareDiluted"


def company_documents(spark, sf) -> DataFrame:
    """Stand-in facts documents: one per order, company = customer, a record per line under the concept that its part
    picks; open lines are filed in euro, returned lines also in Australian dollars, named first; every sixth line's
    value is no number. An order holds a handful of lines, so no group grows with the data."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_linestatus", "l_returnflag",
                                             "l_shipdate")

    def record(x: F.Column, value: F.Column) -> F.Column:
        rest = F.to_json(F.struct(F.year(x["l_shipdate"]).alias("fy"), F.concat(F.lit("Q"), F.quarter(x["l_shipdate"]).cast("string")).alias("fp"),
                                  F.when(x["l_linenumber"] % 2 == 1, "10-K").otherwise("10-Q").alias("form"),
                                  F.date_format(x["l_shipdate"], "yyyy-MM-dd").alias("filed"),
                                  F.date_format(F.date_sub(F.to_date(x["l_shipdate"]), x["l_linenumber"] * 30), "yyyy-MM-dd").alias("end")))
        val = F.when(x["l_linenumber"] % 6 == 0, F.lit('"n/a"')).otherwise(value.cast("string"))
        return F.concat(F.lit('{"val":'), val, F.lit(","), F.substr(rest, F.lit(2)))

    def told(x: F.Column) -> F.Column:
        # a null part picks the last concept
        concept = F.when(x["l_partkey"].isNull(), CONCEPTS[-1]).otherwise(
            F.element_at(F.array(*map(F.lit, CONCEPTS)), (x["l_partkey"] % len(CONCEPTS) + 1).cast("int")))
        share = F.when(concept == EPS, "/shares").otherwise("")
        unit = F.concat(F.when(x["l_linestatus"] == "F", "USD").otherwise("EUR"), share)
        here = F.struct(unit.alias("unit"), record(x, x["l_extendedprice"]).alias("record"))
        both = F.when(x["l_returnflag"] == "R", F.array(F.struct(F.lit("AUD").alias("unit"), record(
            x, x["l_extendedprice"] * 2).alias("record")), here))
        return F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"), x["l_extendedprice"].alias("l_extendedprice"),
                        concept.alias("concept"), F.coalesce(both, F.array(here)).alias("entries"))

    # an order's lines meet by their own narrow columns and are put into words behind that
    lines = li.select("l_orderkey", F.struct(*[c for c in li.columns if c != "l_orderkey"]).alias("line"))
    docs = lines.groupBy("l_orderkey").agg(F.collect_list("line").alias("lines"))
    docs = docs.withColumn("lines", F.array_sort(F.transform("lines", told)))
    docs = docs.withColumn("e", F.flatten(F.transform("lines", lambda x: F.transform(
        x["entries"], lambda y: F.struct(x["concept"].alias("concept"), y["unit"].alias("unit"), y["record"].alias("record"))))))

    def named(name, body) -> F.Column:
        return F.concat(F.lit('"'), name, F.lit('":'), body)

    def units(c) -> F.Column:
        own = F.filter("e", lambda x: x["concept"] == c)
        return F.array_join(F.transform(F.array_distinct(F.transform(own, lambda x: x["unit"])), lambda u: named(u, F.concat(
            F.lit("["), F.array_join(F.transform(F.filter(own, lambda x: x["unit"] == u), lambda x: x["record"]), ","), F.lit("]")))), ",")

    body = F.array_join(F.transform(F.array_distinct(F.transform("e", lambda x: x["concept"])), lambda c: named(c, F.concat(
        F.lit('{"units":{'), units(c), F.lit("}}")))), ",")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"))
    docs = docs.select("l_orderkey", F.concat(F.lit('{"facts":{"us-gaap":{'), body, F.lit("}}}")).alias("doc"))
    return docs.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("entity", "l_orderkey", "doc")


def _company_records(spark, sf) -> DataFrame:
    return fx.metric_records(company_documents(spark, sf), "doc", ["entity", "l_orderkey"])


def company_metrics(spark, sf):
    """The chain from nested documents to long metric rows: records by unit rule, the latest of each concept, the
    preferred concept of each metric, unpivoted with blanks for what is absent."""
    records = fx.usable_records(_company_records(spark, sf))
    latest = fx.latest_fact(records, ["entity", "form", "metric", "concept"], ["l_orderkey", "pos"])
    best = fx.preferred_concept(latest, ["entity", "form", "metric"], "concept_ordinal")
    period = F.when(F.col("form") == "10-K", "annual").otherwise("quarterly")
    return best.select("entity", period.alias("period_type"), F.col("metric").alias("metric_key"), "label", "concept", "unit", "used_unit",
                       F.col("val").alias("value"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("fy", "fp", "form", "filed", "end")])


def _snapshots(spark, sf) -> DataFrame:
    # lines meet their orders by the columns that filings are made of; the strings are made behind that
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
                                             "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    filings = _told(_kept_filings(spark, sf, li, ("o_custkey",)), "o_custkey")
    filing = fx.child_rows(filings, "o_custkey", F.lit("filing"), F.lit("filing"),
                           [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "idx")],
                           F.struct("form", "filing_date", F.col("agent_use").alias("description"), "sec_url"))
    prices = fx.valid_prices(table(spark, sf, "events").select("user_id", "event_id", "ts", "value", "props"), "ts", "value")
    price = fx.price_children(prices, "user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double"))
    nat = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("domicile"))
    companies = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), "c_nationkey") \
        .join(nat, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return fx.company_snapshots(companies, "c_custkey", ["name", "sector", "domicile"],
                                [fx.metric_children(_company_records(spark, sf), "entity", ["l_orderkey", "pos"]), filing, price])


def company_snapshot(spark, sf):
    """The nested snapshot of every company, read back from its struct."""
    s = _snapshots(spark, sf)

    def told(col: str):
        return F.array_join(F.transform(F.map_entries(col), lambda e: F.concat_ws(
            ":", e["key"], *[F.try_variant_get(e["value"], f"$.{n}", "string") for n in ("concept", "filed", "fy")])), ",")

    def total(col: str):
        return F.aggregate(F.map_values(col), F.lit(0.0), lambda acc, v: acc + F.try_variant_get(v, "$.value", "double"))

    shown = F.transform("latest_filings", lambda f: F.concat_ws(
        "@", *[F.try_variant_get(f, f"$.{n}", "string") for n in ("form", "filing_date", "sec_url")]))
    return s.select("c_custkey", "identity.name", "identity.sector", "identity.domicile", told("annual_metrics").alias("annual"),
                    F.round(total("annual_metrics"), 2).alias("annual_total"), told("quarterly_metrics").alias("quarterly"),
                    F.round(total("quarterly_metrics"), 2).alias("quarterly_total"), F.array_join(shown, ",").alias("filings"),
                    F.col("market.close").alias("close"), F.col("market.volume").alias("volume"),
                    F.col("market.approx_window_change_pct").alias("change_pct"), F.size("agent_ready_fields").alias("n_fields"))


def _price_str():
    return (F.when(F.col("o_orderstatus") == "P", F.lit(""))
            .otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))))


def parse_money(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _price_str().alias("price_str"))
    return o.select("o_orderkey", "price_str", fx.parse_number(F.col("price_str")).alias("price"))


def us_date_to_iso(spark, sf):
    o = table(spark, sf, "orders")
    m, d, y = (F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"),
               F.year("o_orderdate").cast("string"))
    us = F.when(F.col("o_orderpriority").startswith("1"), F.concat_ws("/", m, y)).otherwise(F.concat_ws("/", m, d, y))
    return o.select("o_orderkey", us.alias("us_date")).select("o_orderkey", "us_date",
                                                              fx.us_date_to_iso(F.col("us_date")).alias("iso_date"))


def compact_number(spark, sf):
    li = table(spark, sf, "lineitem")
    agg = li.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    return agg.select("l_suppkey", F.col("total").cast("double").alias("total"),
                      F.concat(fx.compact_number(F.col("total")), F.lit(" USD")).alias("compact"))


def entity_snapshot(spark, sf):
    """One row per company: identity joined with its metric, filing-date and
    value aggregates (J10)."""
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    pref = _preferred(spark, sf)
    m = pref.groupBy("entity").agg(
        F.count(F.when(F.col("form") == "10-K", 1)).alias("n_annual"),
        F.count(F.when(F.col("form") == "10-Q", 1)).alias("n_quarterly"),
        F.max("filed").alias("latest_filed"),
        F.max(F.when((F.col("form") == "10-K") & (F.col("metric") == "revenue"), F.col("val"))).alias("annual_revenue"))
    return (sup.join(nat, "s_nationkey", "left")
            .join(m, F.col("s_suppkey") == F.col("entity"), "left")
            .select("s_suppkey", "s_name", "n_name", F.coalesce("n_annual", F.lit(0)).alias("n_annual"),
                    F.coalesce("n_quarterly", F.lit(0)).alias("n_quarterly"), "latest_filed", "annual_revenue"))
