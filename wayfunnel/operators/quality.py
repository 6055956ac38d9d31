"""Data-quality checks: contracts, null and duplicate ratios, scores, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfunnel.functions.common import ratio, scalar, zero
from wayfunnel.operators.cleaning import iqr_flag
from wayfunnel.operators.ranks import concentration, quantiles
from wayfunnel.operators.relational import calendar, missing_from, outer_union
from wayfunnel.schemas import TYPE_MATCH, Contract

# Score weights, grade limits and alert limits.
NULL_PENALTY, DUPLICATE_PENALTY, ANOMALY_PENALTY = 50.0, 30.0, 100.0
GRADES = ((90.0, "excellent"), (75.0, "good"), (50.0, "fair"))
CONCENTRATION_LIMIT, DUPLICATE_LIMIT, EMPTY_TEXT_LIMIT, COMPLETENESS_LIMIT = 0.8, 0.05, 0.2, 0.9
NULL_ERROR_RATIO = 0.01
NULL_LIMITS = {"interactions": 0.05, "dataset_features": 0.1, "user_profile": 0.2}


def _rows() -> Column:
    return F.count(F.lit(1))


def table_rules(tables: Mapping[str, DataFrame | None], rules: Mapping[str, tuple[Sequence[str], int]]) -> DataFrame:
    """pass / fail / missing per table from required columns and minimum rows."""
    spark = next(df.sparkSession for df in tables.values() if df is not None)
    parts = []
    for name, (required, min_rows) in rules.items():
        df = tables.get(name)
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("row_count"),
                                               F.lit("").alias("missing_columns"), F.lit("missing").alias("status")))
            continue
        absent = ",".join(c for c in required if c not in df.columns)
        n = F.col("row_count")
        status = F.when(n == 0, "missing").when((F.lit(absent) != "") | (n < min_rows), "fail").otherwise("pass")
        parts.append(df.agg(_rows().alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(absent).alias("missing_columns"), status.alias("status")))
    return outer_union(parts)


def require_pass(checks: DataFrame) -> DataFrame:
    """Raise when a table failed; the check table has one row per table."""
    failed = [r["table_name"] for r in checks.filter("status <> 'pass'").select("table_name").collect()]
    if failed:
        raise ValueError("tables failing their checks: " + ", ".join(sorted(failed)))
    return checks


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Missing columns and wrong types from the schema; nulls and key faults from one aggregation."""
    present = {f.name: f.dataType for f in df.schema.fields}
    found: list[Column] = []

    def violation(column: str, check: str, severity: Column | str, value: Column) -> Column:
        sev = F.lit(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(column).alias("column"), F.lit(check).alias("check"), sev.alias("severity"),
                        value.cast("double").alias("value"))

    aggregates = [_rows().alias("_n")]
    none = F.lit(None).cast("double")
    for i, rule in enumerate(contract.columns):
        if rule.name not in present:
            found.append(violation(rule.name, "missing_column", "error", none))
            continue
        kinds = TYPE_MATCH.get(rule.type)
        if kinds and not isinstance(present[rule.name], kinds):
            found.append(violation(rule.name, "type_mismatch", "warning", none))
        if not rule.nullable:
            aggregates.append(F.count_if(F.col(rule.name).isNull()).alias(f"_null{i}"))
            share = ratio(f"_null{i}", "_n")
            severity = F.when(share > NULL_ERROR_RATIO, "error").otherwise("warning")
            found.append(F.when(F.col(f"_null{i}") > 0, violation(rule.name, "nulls", severity, share)))
    absent = [k for k in contract.key if k not in present]
    key = ",".join(contract.key)
    if absent:
        found.append(violation(",".join(absent), "key_missing", "error", none))
    else:
        any_null = F.greatest(*[F.col(k).isNull().cast("int") for k in contract.key], F.lit(0)) == 1
        aggregates.append(F.count_if(any_null).alias("_knull"))
        aggregates.append((_rows() - F.count_distinct(F.struct(*contract.key))).alias("_kdup"))
        found.append(F.when(F.col("_knull") > 0, violation(key, "key_nulls", "error", F.col("_knull"))))
        found.append(F.when(F.col("_kdup") > 0, violation(key, "key_duplicates", "error", F.col("_kdup"))))
    row = df.agg(*aggregates).select(F.explode(F.array(*found)).alias("v")).filter("v is not null")
    return row.select(F.lit(contract.source).alias("source"), F.lit(contract.table).alias("table_name"), "v.*")


def validate_contracts(spark: SparkSession, tables: Mapping[str, DataFrame | None],
                       contracts: Sequence[Contract]) -> DataFrame:
    parts = []
    for contract in contracts:
        df = tables.get(contract.table)
        if df is not None:
            parts.append(contract_violations(df, contract))
        else:
            parts.append(spark.range(1).select(
                F.lit(contract.source).alias("source"), F.lit(contract.table).alias("table_name"),
                F.lit(None).cast("string").alias("column"), F.lit("missing_table").alias("check"),
                F.lit("error").alias("severity"), F.lit(None).cast("double").alias("value")))
    return outer_union(parts)


def contract_status(violations: DataFrame, contracts: Sequence[Contract]) -> DataFrame:
    """Passed when no error was found; one row per contract."""
    spark = violations.sparkSession
    names = spark.createDataFrame([(c.source, c.table) for c in contracts], "source string, table_name string")
    counted = violations.groupBy("source", "table_name").agg(
        _rows().alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"))
    return names.join(counted, ["source", "table_name"], "left").select(
        "source", "table_name", zero("violations", "long").alias("violations"),
        (zero("errors", "long") == 0).alias("passed"))


def null_ratios(df: DataFrame, limit: float) -> DataFrame:
    row = df.agg(_rows().alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), ratio(c, "_n").alias("null_ratio")) for c in df.columns])
    return row.select(F.explode(items).alias("r")).select("r.*", (F.col("r.null_ratio") > limit).alias("is_high"))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keys).agg(_rows().alias("n"))
    return per.agg((zero(F.sum("n"), "long") - _rows()).alias("duplicate_count"),
                   ratio(F.sum("n") - _rows(), F.sum("n")).alias("duplicate_ratio"))


def date_completeness(df: DataFrame, column: str, listed: int = 10) -> DataFrame:
    """Days present against the calendar between the first and last; first missing days."""
    days = df.filter(F.col(column).isNotNull()).select(F.to_date(column).alias("day")).distinct()
    expected = calendar(days, "day")
    missing = missing_from(expected, days, ["day"])
    totals = scalar(expected, n=_rows(), lo=F.min("day"), hi=F.max("day"))
    # one row per missing day; only the first few are listed
    first = missing.orderBy("day").limit(listed).agg(
        F.array_join(F.array_sort(F.collect_list(F.col("day").cast("string"))), ",").alias("v")).scalar()
    return missing.agg(_rows().alias("missing_periods")).select(
        (F.col("missing_periods") == 0).alias("complete"), "missing_periods",
        totals["n"].alias("total_expected"),
        (1 - F.col("missing_periods") / totals["n"]).alias("completeness_ratio"),
        F.concat_ws(" to ", totals["lo"].cast("string"), totals["hi"].cast("string")).alias("date_range"),
        first.alias("missing_dates"))


def grade(score: Column) -> Column:
    expr: Column | None = None
    for limit, name in GRADES:
        expr = F.when(score >= limit, name) if expr is None else expr.when(score >= limit, name)
    return expr.otherwise("poor")


def _quality_row(df: DataFrame, name: str, keys: Sequence[str], anomalies: Column, scored_anomalies: bool,
                 scored_duplicates: bool, extra: Mapping[str, Column] | None = None) -> DataFrame:
    nulls = {c: F.avg(F.col(c).isNull().cast("double")) for c in df.columns}
    dup = scalar(df.groupBy(*keys).agg(_rows().alias("n")), d=zero(F.sum("n"), "long") - _rows(),
                 r=ratio(F.sum("n") - _rows(), F.sum("n")))
    mean_null = sum(nulls.values(), F.lit(0.0)) / len(nulls)
    high = F.array_join(F.filter(F.array(*[F.when(e > NULL_LIMITS[name], F.lit(c)) for c, e in nulls.items()]),
                                 lambda x: x.isNotNull()), ",")
    row = df.agg(_rows().alias("row_count"), mean_null.alias("_nulls"), high.alias("high_null_columns"),
                 anomalies.cast("long").alias("anomaly_count"), *[c.alias(n) for n, c in (extra or {}).items()])
    score = 100.0 - NULL_PENALTY * F.col("_nulls")
    if scored_duplicates:
        score = score - DUPLICATE_PENALTY * dup["r"]
    if scored_anomalies:
        score = score - ANOMALY_PENALTY * ratio("anomaly_count", "row_count")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return row.select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"),
        "high_null_columns", dup["d"].alias("duplicate_count"), dup["r"].alias("duplicate_ratio"), "anomaly_count",
        *(extra or {}), score.alias("quality_score"), grade(score).alias("status"))


def interactions_quality(df: DataFrame, as_of: Column) -> DataFrame:
    """Score, duplicates, anomalies and concentration of the interactions table."""
    per_user = df.groupBy("user_id").agg(_rows().alias("n")).filter("user_id is not null")
    per_item = df.groupBy("dataset_id").agg(_rows().alias("n")).filter("dataset_id is not null")
    ug = concentration(per_user, "n").select("as_written").scalar()
    ig = concentration(per_item, "n").select("as_written").scalar()
    anomalies = F.count_if(F.col("weight") < 0) + F.count_if(F.col("last_event_time") > as_of)
    row = _quality_row(df, "interactions", ["user_id", "dataset_id"], anomalies, True, True)
    users, items = per_user.agg(_rows().alias("n")).scalar(), per_item.agg(_rows().alias("n")).scalar()
    return row.select("*", ug.alias("user_concentration"), ig.alias("item_concentration"),
                      users.alias("unique_users"), items.alias("unique_items"),
                      ratio("row_count", users).alias("avg_per_user"), ratio("row_count", items).alias("avg_per_item"))


def items_quality(df: DataFrame) -> DataFrame:
    flagged = iqr_flag(df, "price", 3.0)
    outliers = scalar(flagged, n=F.count_if("is_outlier"))["n"]

    def empty(c: str) -> Column:
        return F.avg((F.trim(F.coalesce(c, F.lit(""))) == "").cast("double"))

    row = _quality_row(df, "dataset_features", ["dataset_id"], F.lit(0), False, True,
                       {"empty_description": empty("description"), "empty_tag": empty("tag")})
    return row.withColumn("anomaly_count", outliers)


def users_quality(df: DataFrame) -> DataFrame:
    return _quality_row(df, "user_profile", ["user_id"], F.lit(0), False, False)


def quality_report(parts: Sequence[DataFrame]) -> DataFrame:
    cols = ["table_name", "row_count", "duplicate_count", "duplicate_ratio", "high_null_columns", "anomaly_count",
            "quality_score", "status"]
    tables = outer_union([p.select(*cols, *([F.col("user_concentration")] if "user_concentration" in p.columns else []))
                          for p in parts])
    advice = F.concat_ws("; ", F.when(F.col("status") == "poor", "review collection"),
                         F.when(F.col("duplicate_ratio") > DUPLICATE_LIMIT, "remove duplicates"),
                         F.when(F.col("high_null_columns") != "", "investigate nulls"),
                         F.when(F.col("user_concentration") > CONCENTRATION_LIMIT, "cold-start strategies"))
    w = Window.partitionBy(F.lit(1))  # one row per table
    return tables.select(*cols, advice.alias("advice"), F.avg("quality_score").over(w).alias("overall_score")) \
        .withColumn("overall_status", grade(F.col("overall_score")))


def quality_alerts(interactions: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """Concentration and duplicate alerts, plus one per contract violation."""
    def alert(severity: str, message: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit("interactions").alias("table_name"),
                        F.lit(message).alias("message"))

    rules = F.array(
        F.when(F.col("user_concentration") > CONCENTRATION_LIMIT, alert("warning", "user concentration")),
        F.when(F.col("item_concentration") > CONCENTRATION_LIMIT, alert("warning", "item concentration")),
        F.when(F.col("duplicate_ratio") > DUPLICATE_LIMIT, alert("error", "duplicate ratio")))
    out = interactions.select(F.explode(rules).alias("a")).filter("a is not null").select("a.*")
    if violations is not None:
        out = out.unionByName(violations.select(
            "severity", F.concat_ws(".", "source", "table_name").alias("table_name"),
            F.concat_ws(": ", "column", "check").alias("message")))
    return out


def gauge_lines(report: DataFrame, alerts: DataFrame, status: DataFrame) -> DataFrame:
    """Metrics as exposition text, one line per row."""
    def line(name: str, label: str, key: str, value: Column) -> Column:
        return F.concat(F.lit(f'{name}{{{label}="'), F.col(key), F.lit('"} '), value)

    source = status.withColumn("t", F.concat_ws(".", "source", "table_name"))
    by_severity = alerts.groupBy("severity").agg(_rows().alias("n"))
    parts = [
        report.select(line("data_quality_score", "table", "table_name",
                           F.format_string("%.3f", "quality_score")).alias("line")),
        report.select(line("data_quality_anomalies", "table", "table_name",
                           F.col("anomaly_count").cast("string")).alias("line")),
        by_severity.select(line("data_quality_alerts", "severity", "severity", F.col("n").cast("string")).alias("line")),
        source.select(line("data_schema_contract_status", "table", "t",
                           F.col("passed").cast("int").cast("string")).alias("line")),
        source.select(line("data_schema_contract_violations", "table", "t",
                           F.col("violations").cast("string")).alias("line")),
    ]
    return outer_union(parts)


def training_readiness(exposures: DataFrame, clicks: DataFrame, labels: DataFrame, slots: DataFrame,
                       min_positive: int = 5) -> DataFrame:
    e = scalar(exposures, n=_rows(), r=F.count_distinct("request_id"))
    c = scalar(clicks, n=_rows(), r=F.count_distinct("request_id"))
    s = scalar(slots, n=_rows())
    row = labels.agg(_rows().alias("label_rows"), zero(F.sum("label"), "long").alias("positive_datasets"))
    warnings = F.concat_ws("; ", F.when(c["n"] == 0, "no clicks"),
                           F.when(F.col("positive_datasets") < min_positive, "too few positive items"),
                           F.when(s["n"] == 0, "no slot metrics"))
    return row.select(
        e["n"].alias("exposures_rows"), e["r"].alias("exposures_request_ids"), c["n"].alias("click_rows"),
        c["r"].alias("click_request_ids"), "label_rows", "positive_datasets", s["n"].alias("slot_metric_rows"),
        warnings.alias("warnings"), F.when(e["n"] == 0, "exposure log is empty").otherwise("").alias("errors"))


def popular_audit(popular: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each popular item with a high / low quality label; and the distribution with rule thresholds."""
    joined = popular.join(features, "dataset_id").select(
        "dataset_id", "price", "interaction_count", "days_since_last_purchase", "popularity_score")
    low = (F.col("price") < 1.0) | (F.col("interaction_count") < 50) | (F.col("days_since_last_purchase") > 180)
    labelled = joined.withColumn("quality", F.when(low, "low").otherwise("high"))
    price = quantiles(joined, "price", {"q1": 0.25, "median": 0.5})
    count = quantiles(joined, "interaction_count", {"q1": 0.25, "median": 0.5})
    p = price.select(F.struct("q1", "median").alias("s")).scalar()
    c = count.select(F.struct("q1", "median").alias("s")).scalar()
    row = joined.agg(_rows().alias("items"), F.min("price").alias("price_min"), F.max("price").alias("price_max"),
                     F.avg("price").alias("price_mean"), F.avg("interaction_count").alias("interaction_mean"),
                     F.min("days_since_last_purchase").alias("days_min"),
                     F.max("days_since_last_purchase").alias("days_max"))
    summary = row.select("*", p["median"].alias("price_median"), c["median"].alias("interaction_median"),
                         F.greatest(F.lit(1.0), p["q1"]).alias("rule_price"),
                         F.greatest(F.lit(50.0), c["q1"]).alias("rule_interactions"))
    return labelled, summary


def required_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    row = df.agg(_rows().alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing"), F.col("total").alias("total"))
                      for c in fields])
    return row.select(F.explode(items).alias("r")).select("r.*", (F.col("r.missing") == 0).alias("ok"))


def freshness_check(tables: Mapping[str, tuple[DataFrame, str]], as_of: Column, max_hours: float = 48.0) -> DataFrame:
    parts = []
    for name, (df, column) in tables.items():
        newest = df.agg(F.max(column).alias("newest"))
        hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
        parts.append(newest.select(F.lit(name).alias("table_name"), hours.alias("age_hours"),
                                   (hours > max_hours).alias("is_stale")))
    return outer_union(parts)


def table_profile(df: DataFrame, value: str, user: str, item: str) -> DataFrame:
    return df.agg(
        _rows().alias("total_records"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
        F.min(value).alias("value_min"), F.max(value).alias("value_max"), F.avg(value).alias("value_mean"),
        F.stddev_samp(value).alias("value_std"), F.count_distinct(user).alias("unique_users"),
        F.count_distinct(item).alias("unique_items"))


def explained_variance(vectors: DataFrame, column: str, max_components: int) -> DataFrame:
    """Cumulative explained variance by number of components (one row per component)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    model = PCA(k=max_components, inputCol="v", outputCol="p").fit(data)
    shares = [float(x) for x in model.explainedVariance]
    running = [sum(shares[: i + 1]) for i in range(len(shares))]
    return vectors.sparkSession.createDataFrame(
        [(i + 1, s, r) for i, (s, r) in enumerate(zip(shares, running))],
        "components int, variance double, cumulative double")


def components_for(variance: DataFrame, targets: Sequence[float] = (0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    picks = F.array(*[F.struct(F.lit(t).alias("target"), F.min(F.when(F.col("cumulative") >= t, F.col("components")))
                               .alias("components")) for t in targets])
    return variance.agg(picks.alias("p")).select(F.explode("p").alias("r")).select("r.*")


def reconstruction_error(vectors: DataFrame, column: str, components: Sequence[int]) -> DataFrame:
    """Mean squared error after projecting to k components and back, one row per k.

    The centred squared length minus the squared length of the projection is the
    squared error, so one projection to the largest k serves every k.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(data).transform(data)
    model = PCA(k=max(components), inputCol="c", outputCol="p").fit(centred)
    arrays = model.transform(centred).select(vector_to_array("c").alias("c"), vector_to_array("p").alias("p"))

    def squares(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)

    errors = [F.avg((squares(F.col("c")) - squares(F.slice("p", 1, k))) / F.size("c")).alias(str(k)) for k in components]
    row = arrays.agg(*errors)
    items = F.array(*[F.struct(F.lit(k).alias("components"), F.col(str(k)).alias("mse")) for k in components])
    return row.select(F.explode(items).alias("r")).select("r.*")
