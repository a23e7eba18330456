"""Finance-pack table jobs: nested fact explode, parallel-array filings,
latest fact per concept, concept preference, price window change, last-N per
key, latest row per key, share of total, and scalar cleanups.

Skew: "latest per key" is ``max_by`` with a composite ordering key, a hash
aggregate with map-side partial combine, so an entity holding a third of all
rows never lands in one task. Top-N per key uses ``row_number() <= n``, which
plans as a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# FIXED VALUES — filing forms kept, and their agent-use labels.
KEEP_FORMS = ["10-K", "10-Q", "8-K", "DEF 14A"]
FORM_USE = [
    ("10-K", ["annual business/risk extraction", "financial statement grounding", "management discussion retrieval"]),
    ("10-Q", ["quarterly update monitor", "trend and guidance comparison", "working capital change extraction"]),
    ("8-K", ["event detection", "material change alerts", "deal/executive/earnings trigger extraction"]),
]
FORM_USE_OTHER = ["governance signal extraction", "shareholder proposal analysis", "board and compensation review"]
FILING_URL_PREFIX = "https://www.sec.gov/Archives/edgar/data/"

FACT_RECORD = "struct<val:double,fy:bigint,fp:string,form:string,filed:string,end:string,frame:string>"
FACTS_DOC_SCHEMA = f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<{FACT_RECORD}>>>>>>"


def explode_facts(docs: DataFrame, doc_col: str, keys: list[str], wanted_unit: str) -> DataFrame:
    """``facts.us-gaap.{concept}.units.{unit}[]`` to flat rows
    ``(*keys, concept, unit, pos, val, fy, fp, form, filed, end, frame)``.
    The wanted unit is used when present, else the first unit of the
    concept (JSON key order is kept by the map parse)."""
    parsed = docs.select(*keys, F.from_json(F.col(doc_col), FACTS_DOC_SCHEMA).alias("_d"))
    concepts = parsed.select(*keys, F.explode(F.col("_d.facts.`us-gaap`")).alias("concept", "_c"))
    units = F.col("_c.units")
    chosen_unit = F.when(F.element_at(units, F.lit(wanted_unit)).isNotNull(), F.lit(wanted_unit)) \
        .otherwise(F.element_at(F.map_keys(units), 1))
    picked = concepts.select(*keys, "concept", chosen_unit.alias("unit"), units.alias("_u"))
    recs = picked.select(*keys, "concept", "unit", F.posexplode(F.element_at("_u", F.col("unit"))).alias("pos", "r"))
    return recs.select(*keys, "concept", "unit", "pos", "r.*")


# FIXED VALUES — metrics in order: key, label, concepts in order of preference, wanted unit.
METRICS = [
    ("revenue", "Revenue", ["RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "Revenues"], "USD"),
    ("net_income", "Net income", ["NetIncomeLoss", "ProfitLoss"], "USD"),
    ("operating_income", "Operating income", ["OperatingIncomeLoss"], "USD"),
    ("operating_cash_flow", "Operating cash flow", ["NetCashProvidedByUsedInOperatingActivities"], "USD"),
    ("capex", "Capital expenditures", ["PaymentsToAcquirePropertyPlantAndEquipment"], "USD"),
    ("research_and_development", "Research and development expense", ["ResearchAndDevelopmentExpense"], "USD"),
    ("assets", "Assets", ["Assets"], "USD"),
    ("liabilities", "Liabilities", ["Liabilities"], "USD"),
    ("equity", "Stockholders' equity",
     ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"], "USD"),
    ("diluted_eps", "Diluted EPS", ["EarningsPerShareDiluted"], "USD/shares"),
]
FORM_PERIOD = [("10-K", "annual"), ("10-Q", "quarterly")]
#: Records of a concept: what is no text becomes the text of its value, but ``val`` keeps its kind.
RECORDS = "array<struct<val:variant,fy:string,fp:string,form:string,filed:string,end:string,frame:string>>"


def metric_dim(spark: SparkSession, metrics=METRICS) -> DataFrame:
    """One row per metric and concept; a table of the code's own size."""
    return spark.createDataFrame([(m, label, c, i, unit) for m, label, cs, unit in metrics for i, c in enumerate(cs)],
                                 "metric string, label string, concept string, concept_ordinal int, unit string")


def metric_records(docs: DataFrame, doc_col: str, keys: list[str], metrics=METRICS) -> DataFrame:
    """Every record of the metrics' concepts in nested documents, whatever other concepts and units they hold:
    (*keys, metric, label, concept, concept_ordinal, unit, used_unit, pos, val, fy, fp, form, filed, end, frame).

    Concepts and units are read as maps, which keep the document's order: a concept's records are those of the
    metric's unit, or else of the first unit that the document names. The records are a VARIANT, cast to their
    fields once and exploded by an expression, so that no filter on them is pushed down to parse the JSON again;
    ``val`` is null if it is no number, ``unit`` is the metric's, ``used_unit`` the one read."""
    spark = docs.sparkSession
    concepts = docs.select(*keys, F.explode(F.from_json(F.col(doc_col), "struct<facts:struct<`us-gaap`:map<string,string>>>")
                                            ["facts"]["us-gaap"]).alias("concept", "body"))
    known = concepts.join(F.broadcast(metric_dim(spark, metrics)), "concept").withColumn(
        "by_unit", F.from_json("body", "struct<units:map<string,variant>>")["units"])
    known = known.withColumn("own", F.try_element_at("by_unit", F.col("unit")))
    wanted = F.col("own").isNotNull() & ~F.is_variant_null("own")
    known = known.withColumn("used_unit", F.when(wanted, F.col("unit")).otherwise(F.get(F.map_keys("by_unit"), F.lit(0))))
    read = F.try_variant_get(F.when(wanted, F.col("own")).otherwise(F.try_element_at("by_unit", F.col("used_unit"))), "$", RECORDS)
    each = known.select(*keys, "metric", "label", "concept", "concept_ordinal", "unit", "used_unit", F.posexplode(read).alias("pos", "r"))

    kind = F.schema_of_variant("r.val")
    number = F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("r.val", "$", "double"))
    return each.select(*keys, "metric", "label", "concept", "concept_ordinal", "unit", "used_unit", "pos", number.alias("val"),
                       *[F.col(f"r.{n}") for n in ("fy", "fp", "form", "filed", "end", "frame")])


def usable_records(records: DataFrame) -> DataFrame:
    """Records of a kept form with a number, a filing date and an end."""
    filled = [F.coalesce(c, F.lit("")) != "" for c in ("filed", "end")]
    return records.where(F.col("form").isin(*[f for f, _p in FORM_PERIOD]) & F.col("val").isNotNull() & ~F.isnan("val") & filled[0] & filled[1])


def latest_fact(facts: DataFrame, keys: list[str], order_cols: list[str], form: str | None = None) -> DataFrame:
    """Per ``keys``: the record with the largest ``filed-end`` string among
    records of ``form`` with a numeric value and non-empty filed and end; ties
    go to the earliest record by ``order_cols``."""
    f = facts.filter(F.col("val").isNotNull() & ~F.isnan("val")
                     & (F.coalesce(F.col("filed"), F.lit("")) != "") & (F.coalesce(F.col("end"), F.lit("")) != ""))
    if form is not None:
        f = f.filter(F.col("form") == form)
    rank_key = F.struct(F.concat_ws("-", "filed", "end").alias("k"),
                        *[(-F.col(c)).alias(f"_o{i}") for i, c in enumerate(order_cols)])
    payload = [c for c in facts.columns if c not in keys]
    best = f.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank_key).alias("_b"))
    return best.select(*keys, "_b.*")


def preferred_concept(latest: DataFrame, keys: list[str], concept_ordinal: str) -> DataFrame:
    """Among the latest facts of a metric's concepts: the largest
    ``filed-end``; ties go to the earlier listed concept."""
    rank_key = F.struct(F.concat_ws("-", "filed", "end").alias("k"), (-F.col(concept_ordinal)).alias("o"))
    payload = [c for c in latest.columns if c not in keys]
    return latest.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank_key).alias("_b")).select(*keys, "_b.*")


def zip_explode(df: DataFrame, keys: list[str], arrays: dict[str, str]) -> DataFrame:
    """Rows from parallel arrays aligned by index: ``(*keys, idx, name...)``.
    Shorter arrays yield NULL past their end."""
    zipped = F.arrays_zip(*[F.col(src).alias(name) for name, src in arrays.items()])
    return df.select(*keys, F.posexplode(zipped).alias("idx", "_z")).select(*keys, "idx", "_z.*")


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    """Archive URL: CIK without leading zeros, accession without dashes."""
    return F.concat(F.lit(FILING_URL_PREFIX), cik.cast("bigint").cast("string"), F.lit("/"),
                    F.regexp_replace(accession, "-", ""), F.lit("/"), document)


def form_use(form: Column) -> Column:
    expr = None
    for f, labels in FORM_USE:
        arr = F.array(*[F.lit(x) for x in labels])
        expr = F.when(form == f, arr) if expr is None else expr.when(form == f, arr)
    return expr.otherwise(F.array(*[F.lit(x) for x in FORM_USE_OTHER]))


def keep_filing(form: Column, accession: Column, document: Column) -> Column:
    return (form.isin(*KEEP_FORMS) & (F.coalesce(accession, F.lit("")) != "")
            & (F.coalesce(document, F.lit("")) != ""))


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def round_half_up(x: Column, digits: int) -> Column:
    """``Math.round``-style rounding: half toward +infinity."""
    f = 10 ** digits
    return F.floor(x * f + F.lit(0.5)) / f


def window_change_pct(df: DataFrame, keys: list[str], pos: str, value: str,
                      newest_is_min: bool = True) -> DataFrame:
    """(newest - oldest) / oldest * 100; by default the newest row has the
    smallest position (rows listed newest first). NULL when the oldest value
    is 0. One hash aggregate, map-side combined."""
    lo, hi = F.min_by(value, pos), F.max_by(value, pos)
    newest, oldest = (lo, hi) if newest_is_min else (hi, lo)
    agg = df.groupBy(*keys).agg(newest.alias("newest"), oldest.alias("oldest"))
    pct = F.try_divide(F.col("newest") - F.col("oldest"), F.col("oldest")) * 100
    return agg.withColumn("change_pct", round_half_up(F.when(F.col("oldest") != 0, pct), 2))


def parse_number(s: Column, strip: str = "[$,]") -> Column:
    """Number(...) of a cleaned string: blank -> 0, garbage -> NaN."""
    cleaned = F.trim(F.regexp_replace(s, strip, ""))
    return (F.when(s.isNull() | (cleaned == ""), F.lit(0.0))
            .otherwise(F.coalesce(cleaned.try_cast("double"), F.lit(float("nan")))))


def us_date_to_iso(s: Column) -> Column:
    """``m/d/yyyy`` to ``yyyy-mm-dd`` (zero padded); any missing part -> ''."""
    parts = F.split(s, "/")
    m, d, y = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    ok = (F.coalesce(m, F.lit("")) != "") & (F.coalesce(d, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
    return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.lit(""))


def compact_number(x: Column) -> Column:
    """English compact notation with at most two fraction digits (K, M, B,
    T), half away from zero, trailing zeros dropped; ``n/a`` for NULL.
    ``x`` must be DECIMAL so rounding is exact. The unit is picked on the
    rounded value, so 999.999 becomes 1K."""
    tiers = [("", 0), ("K", 3), ("M", 6), ("B", 9)]

    def scaled(p: int) -> Column:
        return F.round(x / F.lit(10 ** p).cast("decimal(38,0)"), 2) if p else F.round(x, 2)

    chosen = None
    for suf, p in tiers:
        cond = F.abs(scaled(p)) < 1000
        val = F.struct(scaled(p).cast("decimal(38,2)").alias("v"), F.lit(suf).alias("s"))
        chosen = F.when(cond, val) if chosen is None else chosen.when(cond, val)
    chosen = chosen.otherwise(F.struct(scaled(12).cast("decimal(38,2)").alias("v"), F.lit("T").alias("s")))
    num = F.regexp_replace(F.regexp_replace(chosen["v"].cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.concat(num, chosen["s"]))


def valid_prices(df: DataFrame, date: str = "date", close: str = "close") -> DataFrame:
    """Keep rows with a non-empty date and a finite close."""
    c = F.col(close)
    return df.filter((F.coalesce(F.col(date).cast("string"), F.lit("")) != "") & c.isNotNull() & ~F.isnan(c)
                     & (F.abs(c) != float("inf")))


# ---------------------------------------------------------------------------
# Company snapshot
# ---------------------------------------------------------------------------
FILINGS_SHOWN = 3
# FIXED VALUES — what an agent can read from a snapshot.
AGENT_FIELDS = ["company identity", "SEC filing provenance", "latest annual and quarterly XBRL facts",
                "recent filing event stream", "recent OHLCV market context"]
CHILD = ["entity", "slot", "name", "o1", "o2", "o3", "o4", "o5", "payload"]


def child_rows(rows: DataFrame, entity: str, slot: Column, name: Column, order: list[Column], payload: Column,
               newest: Column | None = None) -> DataFrame:
    """Children of a company in one shape: within a slot rows stand by ``newest`` (descending text), then ``order``."""
    order = [o.cast("long") for o in order] + [F.lit(0).cast("long")] * (4 - len(order))
    return rows.select(F.col(entity).alias("entity"), slot.alias("slot"), name.alias("name"),
                       (F.lit("") if newest is None else newest).alias("o1"), *[o.alias(f"o{i + 2}") for i, o in enumerate(order)],
                       F.to_variant_object(payload).alias("payload"))


def metric_children(records: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """The usable records as children: of a period and metric the largest filed-end leads, then the earlier concept,
    then the earlier record."""
    period = F.when(F.col("form") == FORM_PERIOD[0][0], FORM_PERIOD[0][1]).otherwise(FORM_PERIOD[1][1])
    payload = F.struct("concept", "label", "unit", F.col("val").alias("value"), "fy", "fp", "form", "filed", "end", "frame")
    return child_rows(usable_records(records), entity, F.concat_ws(":", period, "metric"), F.col("metric"),
                      [F.col("concept_ordinal"), *map(F.col, order)], payload, F.concat_ws("-", "filed", "end"))


def price_children(prices: DataFrame, entity: str, at: str, tie: str, close: str, volume: Column) -> DataFrame:
    """Each company's newest and oldest price as children."""
    payload = F.struct(F.col(at).cast("string").alias("date"), F.col(close).alias("close"), volume.alias("volume"))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    ends = prices.withColumn("_end", F.explode(F.array(F.lit("newest"), F.lit("oldest"))))
    sign = F.when(F.col("_end") == "newest", -1).otherwise(1)
    return child_rows(ends, entity, F.col("_end"), F.col("_end"), [sign * micros, sign * F.col(tie)], payload)


def company_snapshots(companies: DataFrame, key: str, identity: list[str], children: list[DataFrame]) -> DataFrame:
    """One nested row per company: ``key``, identity struct, annual and quarterly metrics (maps), first filings,
    market snapshot, agent fields.

    All children are dealt once, by (company, slot), after each task has cut its slots to the rows that can be shown
    (a ranked window with a group limit before the shuffle); so a company with a third of all rows is a few rows a
    task and slot. What is left, some tens of rows a company, is assembled by one aggregation."""
    rows = children[0]
    for more in children[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("entity", "slot").orderBy(F.desc("o1"), "o2", "o3", "o4", "o5")
    shown = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FILINGS_SHOWN)
    shown = shown.where((F.col("rank") == 1) | (F.col("slot") == "filing"))

    def metrics(period: str) -> Column:
        entry = F.when(F.col("slot").startswith(f"{period}:"), F.struct("name", "payload"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1)))

    def one(slot: str) -> Column:
        return F.any_value(F.when(F.col("slot") == slot, F.col("payload")), True)

    filing = F.when(F.col("slot") == "filing", F.struct("rank", "payload"))
    made = shown.groupBy("entity").agg(
        *[metrics(p).alias(f"{p}_metrics") for _f, p in FORM_PERIOD],
        F.transform(F.array_sort(F.collect_list(filing), lambda a, b: a["rank"] - b["rank"]), lambda f: f["payload"]).alias("latest_filings"),
        one("newest").alias("newest"), one("oldest").alias("oldest"))
    new, old = (F.try_variant_get(c, "$.close", "double") for c in ("newest", "oldest"))
    change = round_half_up(F.when(old != 0, F.try_divide(new - old, old) * 100), 2)
    market = F.when(F.col("newest").isNotNull(), F.struct(
        F.try_variant_get("newest", "$.date", "string").alias("date"), new.alias("close"),
        F.try_variant_get("newest", "$.volume", "double").alias("volume"), change.alias("approx_window_change_pct")))
    empty = F.create_map().cast("map<string,variant>")
    return companies.join(made, companies[key] == made["entity"], "left").select(
        F.col(key), F.struct(*identity).alias("identity"),
        *[F.coalesce(f"{p}_metrics", empty).alias(f"{p}_metrics") for _f, p in FORM_PERIOD],
        F.coalesce("latest_filings", F.array().cast("array<variant>")).alias("latest_filings"), market.alias("market"),
        F.array(*map(F.lit, AGENT_FIELDS)).alias("agent_ready_fields"))
