"""Scans, sources and sinks: S1-S22, with A31, A38, A39, O6 and U5, over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators import profile as P
from probanza.plans import audit as A
from probanza.plans import evidence as V
from probanza.session import scratch_path, side_by_side
from probanza.sources import files as L
from probanza.sources import sinks
from probanza.sources import tables as S
from suite.domain import DRIVER_TABLES, driver_table, table, tables, with_tables
from suite.joins import EVIDENCE_TABLES, fk_sql, ts
from suite.profiles import each, types_sql, union
from suite.registry import register

_CALLS = "call_center_interactions"
_AS_IS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_TREES: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf: str, label: str, write) -> str:
    """Path of a file tree that is written once per application and scale."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _TREES:
        root = scratch_path(spark, label)
        write(root)
        _TREES[key] = root
    return _TREES[key]


def csv_tree(spark: SparkSession, sf: str) -> str:
    """Static customers and products, interactions by year, month and day."""

    def write(root: str) -> None:
        for name in ("customers", "products"):
            table(spark, sf, name).write.options(**_AS_IS).csv(f"{root}/{name}")
        day = F.to_date(F.substring("interaction_date", 1, 10))
        calls = table(spark, sf, _CALLS).withColumn("interaction_date", _call_day())
        parts = {"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")}
        calls.withColumns(parts).write.partitionBy(*parts).options(**_AS_IS).csv(f"{root}/{_CALLS}")

    return _once(spark, sf, "csv-tree", write)


def _call_day():
    return F.coalesce(C.parse_ts("interaction_date").cast("string"), F.lit("2024-01-15"))


_CALL_DAY = f"CAST(coalesce({ts('interaction_date')}, TIMESTAMP '2024-01-15') AS DATE)"


def drifting_tree(spark: SparkSession, sf: str) -> str:
    """Complaints in two layouts: other column order, and columns that only one layout has."""

    def write(root: str) -> None:
        rows = table(spark, sf, "complaints").select("complaint_id", "priority", "status", "category")
        closed = F.col("status") == "Closed"
        out = {"layout=a": rows.filter(closed).select("complaint_id", "priority", "status"),
               "layout=b": rows.filter(~closed).select("status", "complaint_id", "category")}
        for folder, part in out.items():
            part.write.option("header", True).csv(f"{root}/complaints/{folder}")

    return _once(spark, sf, "drifting", write)


def scoped_tree(spark: SparkSession, sf: str) -> str:
    """The tables of the evidence pass, a folder of CSV files each.

    As plain text they take seven times the tables' Parquet. A file in gzip is read by one task, so its rows are bounded.
    """

    def write(root: str) -> None:
        def one(name: str):
            return lambda: table(spark, sf, name).write.options(**_AS_IS, maxRecordsPerFile=100_000).csv(f"{root}/{name}", compression="gzip")

        side_by_side(spark, [one(name) for name in vocab.SCOPED_COLUMNS])

    return _once(spark, sf, "scoped-tree", write)


def ragged_tree(spark: SparkSession, sf: str) -> str:
    """Customers as raw lines; some segments have a field too many, some one too few."""

    def write(root: str) -> None:
        name = F.concat(F.lit('"'), F.col("c_name"), F.lit(', Sr."'))
        extra = F.when(F.col("c_mktsegment") == "BUILDING", ",x").otherwise("")
        key = F.col("c_custkey").cast("string")
        line = F.when(F.col("c_mktsegment") == "MACHINERY", key).otherwise(F.concat(key, F.lit(","), name, extra))
        customers = driver_table(spark, sf, "customer")
        customers.select(line.alias("id,name")).write.option("header", True).option("quote", "").csv(f"{root}/ragged")

    return _once(spark, sf, "ragged", write)


def day_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A listing as Spark derives it from the interactions: one entry per dataset, channel and day."""
    calls = table(spark, sf, _CALLS).select("channel", F.to_date(_call_day()).alias("day"))
    counts = calls.groupBy("channel", "day").agg(F.count(F.lit(1)).alias("bytes"))
    path = F.concat(
        F.lower("channel"), F.date_format("day", "'/year='yyyy'/month='MM'/day='dd'/f.csv'")
    )
    return counts.select(F.lower("channel").alias("dataset"), path.alias("relative_path"), "bytes")


_LISTING = f""", li AS (SELECT lower(channel) AS dataset, lower(channel) || strftime(d, '/year=%Y/month=%m/day=%d/f.csv') AS relative_path, count(*) AS bytes
  FROM (SELECT channel, {_CALL_DAY} AS d FROM {_CALLS}) GROUP BY 1, 2)
"""


# --- S1-S4 ----------------------------------------------------------------------------------------
@register(
    "s01_discover_datasets",
    with_tables(_CALLS, "customers")
    + f"""SELECT '{_CALLS}' AS dataset, count(DISTINCT {_CALL_DAY}) AS partition_dates, min({_CALL_DAY}) AS first_partition, max({_CALL_DAY}) AS last_partition, true AS has_bytes FROM {_CALLS}
    UNION ALL SELECT 'customers', 0, NULL, NULL, count(*) > 0 FROM customers UNION ALL SELECT 'products', 0, NULL, NULL, count(*) > 0 FROM orders""",
)
def discover_datasets(spark, sf):
    found = L.dataset_files(L.list_files(spark, csv_tree(spark, sf)))
    return found.select(
        "dataset", "partition_dates", "first_partition", "last_partition", (F.col("bytes") > 0).alias("has_bytes")
    )


@register("s02_inferred_scan", with_tables("customers") + "SELECT customer_id, CAST(estimated_monthly_income AS DOUBLE) AS estimated_monthly_income FROM customers")
def inferred_scan(spark, sf):
    rows = S.read_inferred(spark, f"{csv_tree(spark, sf)}/customers")
    return rows.select("customer_id", "estimated_monthly_income")


@register(
    "s03_union_by_name",
    with_tables("complaints")
    + """SELECT complaint_id, status, CASE WHEN status = 'Closed' THEN priority END AS priority, CASE WHEN status <> 'Closed' THEN category END AS category FROM complaints""",
)
def union_by_name(spark, sf):
    rows = S.read_dataset(spark, drifting_tree(spark, sf), "complaints")
    return rows.select("complaint_id", "status", "priority", "category")


@register(
    "s04_partitioned_scan",
    with_tables(_CALLS)
    + f"""SELECT strftime({_CALL_DAY}, '%Y') AS year, strftime({_CALL_DAY}, '%m') AS month, strftime({_CALL_DAY}, '%d') AS day, count(*) AS rows, count(reason_category) AS with_reason
    FROM {_CALLS} GROUP BY ALL""",
)
def partitioned_scan(spark, sf):
    rows = S.read_dataset(spark, csv_tree(spark, sf), _CALLS)
    return rows.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("rows"), F.count("reason_category").alias("with_reason"))


# --- S5-S9 ----------------------------------------------------------------------------------------
@register("s05_strict_scan", with_tables("customers") + "SELECT * FROM customers")
def strict_scan(spark, sf):
    return S.read_dataset(spark, csv_tree(spark, sf), "customers").drop(S.SOURCE_FILE)


@register(
    "s06_lenient_scan",
    """SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'malformed' ELSE 'good' END AS kind, count(*) AS rows,
      CAST(coalesce(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_custkey END), 0) AS BIGINT) AS ids FROM customer GROUP BY 1""",
)
def lenient_scan(spark, sf):
    paths = [f"{ragged_tree(spark, sf)}/ragged"]
    good, bad = S.read_lenient(spark, paths, ["id", "name"])
    good = good.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("id").cast("bigint")).alias("ids"))
    bad = bad.agg(F.count("_corrupt_record").alias("rows")).withColumn("ids", F.lit(0).cast("bigint"))
    return good.select(F.lit("good").alias("kind"), "*").unionByName(bad.select(F.lit("malformed").alias("kind"), "*"))


@register("s07_provenance", with_tables(_CALLS) + f"SELECT {_CALL_DAY} AS partition_date, count(*) AS rows FROM {_CALLS} GROUP BY 1")
def provenance(spark, sf):
    rows = S.read_dataset(spark, csv_tree(spark, sf), _CALLS)
    return rows.groupBy(C.partition_date(S.SOURCE_FILE).alias("partition_date")).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "s08_scoped_projection",
    with_tables("customers")
    + "SELECT customer_id, registration_branch_id, customer_status, country, detected_accent, CAST(NULL AS VARCHAR) AS credit_score FROM customers",
)
def scoped_projection(spark, sf):
    wanted = [*vocab.SCOPED_COLUMNS["customers"], "credit_score"]
    return S.scoped(S.read_dataset(spark, csv_tree(spark, sf), "customers"), wanted).drop(S.SOURCE_FILE)


@register(
    "s09_scoped_cache",
    with_tables("customers", "products", _CALLS) + each("SELECT '{t}' AS dataset, count(*) AS rows FROM {t}", ("customers", "products", _CALLS)),
)
def scoped_cache(spark, sf):
    wanted = {t: vocab.SCOPED_COLUMNS[t] for t in ("customers", "products", _CALLS)}
    return P.row_counts(S.scoped_cache(spark, csv_tree(spark, sf), wanted))


# --- S10-S12 --------------------------------------------------------------------------------------
@register(
    "s10_predictions",
    with_tables("answers")
    + """SELECT 'csv' AS form, case_id, predicted_action, predicted_balance, '' AS predicted_currency FROM answers
    UNION ALL SELECT 'jsonl', case_id, predicted_action, predicted_balance, '' FROM answers""",
)
def predictions(spark, sf):
    def write(root: str) -> None:
        answers = table(spark, sf, "answers").drop("predicted_currency")
        answers.write.option("header", True).csv(f"{root}/answers.csv")
        answers.write.json(f"{root}/answers.jsonl")

    root = _once(spark, sf, "answers", write)
    loaded = [S.load_predictions(spark, f"{root}/answers.{form}").withColumn("form", F.lit(form)) for form in ("csv", "jsonl")]
    return union(loaded).select("form", "case_id", "predicted_action", "predicted_balance", "predicted_currency")


@register(
    "s11_last_record_wins",
    with_tables("cases")
    + """SELECT trim(case_id) AS case_id, category, CASE WHEN category = 'AUTHORIZATION' THEN 'second' ELSE expected_action END AS expected_action FROM cases WHERE trim(case_id) <> ''""",
)
def last_record_wins(spark, sf):
    def write(root: str) -> None:
        cases = table(spark, sf, "cases")
        cases.write.option("header", True).csv(f"{root}/first.csv")
        second = cases.filter("category = 'AUTHORIZATION'").withColumn("expected_action", F.lit("second"))
        second.write.option("header", True).csv(f"{root}/second.csv")

    root = _once(spark, sf, "cases", write)
    return S.load_cases(spark, [f"{root}/first.csv", f"{root}/second.csv"]).select("case_id", F.coalesce("category", F.lit("")).alias("category"), "expected_action")


@register("s12_catalog", with_tables("products") + "SELECT customer_id, product_id, product_type, product_number, trim(current_balance) AS current_balance, currency FROM products")
def catalog(spark, sf):
    products = S.load_catalog(spark, f"{csv_tree(spark, sf)}/products")
    return products.select(*(C.strip(c).alias(c) for c in vocab.CATALOG_COLUMNS))


# --- S13, S14 -------------------------------------------------------------------------------------
@register(
    "s13_union_csv_sink",
    with_tables("branches", "service_agents")
    + """SELECT branch_id, country, CAST(NULL AS VARCHAR) AS agent_id FROM branches UNION ALL SELECT assigned_branch_id, NULL, agent_id FROM service_agents""",
)
def union_csv_sink(spark, sf):
    t = tables(spark, sf, "branches", "service_agents")
    agents = t["service_agents"].select("agent_id", F.col("assigned_branch_id").alias("branch_id"))
    path = scratch_path(spark, "union-csv")
    sinks.write_csv(sinks.union_all([t["branches"].select("branch_id", "country"), agents]), path)
    return spark.read.option("header", True).csv(path)


_MANIFEST = ("customers", "products", "transactions")


@register(
    "s14_manifest",
    with_tables(*_MANIFEST)
    + ", m AS ("
    + each(
        "SELECT '{t}' AS dataset, count(*) AS rows, (SELECT sha256(string_agg(column_name, '|')) FROM (DESCRIBE SELECT * FROM {t})) AS schema_sha256 FROM {t}", _MANIFEST
    )
    + ") SELECT dataset, rows, schema_sha256, CAST((SELECT sum(rows) FROM m) AS BIGINT) AS total_rows FROM m",
)
def manifest(spark, sf):
    t = tables(spark, sf, *_MANIFEST)
    names = P.columns_frame(spark, {n: df.columns for n, df in t.items()})
    path = scratch_path(spark, "manifest")
    sinks.write_json(sinks.manifest(spark, P.row_counts(t), P.schema_hashes(names), {"data_root": sf}, ["exact"]), path)
    return spark.read.json(path).select("total_rows", F.explode("tables").alias("t")).select("t.*", "total_rows")


# --- S15-S19 --------------------------------------------------------------------------------------
@register(
    "s15_input_fingerprint",
    with_tables(_CALLS)
    + _LISTING
    + "SELECT sha256(string_agg(relative_path || bytes, '' ORDER BY relative_path)) AS plain, sha256(string_agg(relative_path || ':' || bytes, '' ORDER BY relative_path)) AS separated FROM li",
)
def input_fingerprint(spark, sf):
    listing = day_listing(spark, sf)
    separated = L.input_fingerprint(listing, ":").scalar()
    return L.input_fingerprint(listing).select(F.col("input_fingerprint").alias("plain"), separated.alias("separated"))


@register(
    "s16_content_hashes",
    with_tables(_CALLS, "customers", "products")
    + f"""SELECT '{_CALLS}' AS dataset, count(DISTINCT {_CALL_DAY}) AS days, true AS all_hashed, true AS all_different FROM {_CALLS}
    UNION ALL SELECT 'customers', 0, count(*) > 0, count(*) > 0 FROM customers UNION ALL SELECT 'products', 0, count(*) > 0, count(*) > 0 FROM products""",
)
def content_hashes(spark, sf):
    """Every file of the tree."""
    hashed = L.content_hashes(spark, csv_tree(spark, sf))
    return hashed.groupBy(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("dataset")).agg(
        F.count_distinct(C.partition_date("relative_path")).alias("days"),
        (F.min(F.length("sha256")) == 64).alias("all_hashed"),
        (F.count_distinct("sha256") == F.count(F.lit(1))).alias("all_different"),
    )


def _filled_sql(t: str) -> str:
    """Columns of a table with their types and how many rows fill them."""
    return f"""SELECT '{t}' AS dataset, column_name, column_type, filled_rows FROM (DESCRIBE SELECT * FROM {t})
      JOIN (SELECT column_name, count(v) AS filled_rows FROM (SELECT COLUMNS(*)::VARCHAR FROM {t}) UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(*))) GROUP BY 1) USING (column_name)"""


@register(
    "s17_schema_hashes",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS dataset, sha256(string_agg(column_name, '|' ORDER BY place)) AS schema_sha256, CAST(sum(filled_rows) AS BIGINT) AS filled_cells "
        f"FROM ({_filled_sql(t)}) JOIN (SELECT column_name, row_number() OVER () AS place FROM (DESCRIBE SELECT * FROM {t})) USING (column_name) WHERE filled_rows > 0"
        for t in DRIVER_TABLES
    ),
)
def schema_hashes(spark, sf):
    """Hashes over the columns that any row fills."""
    filled = P.observed_columns({t: driver_table(spark, sf, t) for t in DRIVER_TABLES}).filter("filled_rows > 0")
    cells = filled.groupBy("dataset").agg(F.sum("filled_rows").alias("filled_cells"))
    return P.schema_hashes(filled).join(cells, "dataset")


@register(
    "s18_artifact_manifest",
    "SELECT 'nations' AS artifact, true AS has_bytes, count(*) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation UNION ALL SELECT 'regions', true, count(*), CAST(sum(r_regionkey) AS BIGINT) FROM region",
)
def artifact_manifest(spark, sf):
    """The artifacts' sizes from the listing, their rows from what was written."""

    def write(root: str) -> None:
        sinks.write_csv(driver_table(spark, sf, "nation"), f"{root}/nations")
        sinks.write_csv(driver_table(spark, sf, "region"), f"{root}/regions")

    root = _once(spark, sf, "artifacts", write)
    sizes = L.artifact_manifest(spark, root).groupBy("artifact").agg((F.sum("bytes") > 0).alias("has_bytes"))
    held = union(
        S.read_dataset(spark, root, name).select(F.lit(name).alias("artifact"), F.col(key).cast("bigint").alias("key"))
        for name, key in (("nations", "n_nationkey"), ("regions", "r_regionkey"))
    )
    return sizes.join(held.groupBy("artifact").agg(F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys")), "artifact")


@register(
    "s19_representative_files",
    with_tables(_CALLS)
    + _LISTING
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY relative_path) AS place, count(*) OVER (PARTITION BY dataset) AS files FROM li)
    SELECT dataset, relative_path, place, files FROM r WHERE place IN (1, files // 2 + 1, files)""",
)
def representative_files(spark, sf):
    return L.representative_files(day_listing(spark, sf)).select("dataset", "relative_path", "place", "files")


# --- S20-S22 --------------------------------------------------------------------------------------
@register(
    "s20_prefix_sample",
    with_tables(_CALLS)
    + f"SELECT {_CALL_DAY} AS partition_date, least(count(*), 40) AS first_file_rows FROM {_CALLS} GROUP BY 1",
)
def prefix_sample(spark, sf):
    """Sampled rows of the first file of every day (the writer may cut a day into several files)."""
    header = table(spark, sf, _CALLS).columns
    schema = ", ".join(f"`{c}` string" for c in [*header, *S.PARTITION_COLUMNS])
    folder = f"{csv_tree(spark, sf)}/{_CALLS}"
    rows = spark.read.schema(schema).options(**S.RFC_4180).option("basePath", folder).csv(folder)
    sample = S.prefix_sample(S.with_position(rows), 40)
    per_file = sample.groupBy("_file", C.partition_date("_file").alias("partition_date")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("partition_date").agg(F.max("n").alias("first_file_rows"))


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "array<float>": "FLOAT[]",
}


@register("s21_describe", "\nUNION ALL\n".join(_filled_sql(t) for t in DRIVER_TABLES))
def describe(spark, sf):
    """Columns with their types and the rows that fill them."""
    found = P.observed_columns({t: driver_table(spark, sf, t) for t in DRIVER_TABLES}).drop("position")
    names = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    return found.withColumn("column_type", F.coalesce(names[F.col("column_type")], F.col("column_type")))


@register(
    "s22_tree_profile",
    "SELECT 3 AS datasets, 1 AS extensions, 0 AS zero_byte_files, 0 AS files_missing_a_partition_level, 'call_center_interactions,customers,products' AS largest FROM (SELECT count(*) FROM events)",
)
def tree_profile(spark, sf):
    listing = L.list_files(spark, csv_tree(spark, sf))
    top = L.largest(listing, "dataset").agg(F.array_join(F.array_sort(F.collect_list("dataset")), ",").alias("d")).scalar()
    profile = L.tree_profile(listing)
    numbers = ("datasets", "extensions", "zero_byte_files", "files_missing_a_partition_level")
    return profile.select(*(F.col(c).cast("int").alias(c) for c in numbers), top.alias("largest"))


# --- A31, A38, A39, O6, U5 ------------------------------------------------------------------------


@register(
    "a31_inventory",
    with_tables("customers", _CALLS)
    + f"""SELECT 'customers' AS dataset, count(*) AS rows, 8 AS columns, false AS event_like, 0 AS partition_dates, 'customer_id,full_name' AS keys, CAST(NULL AS TIMESTAMP) AS min_timestamp, CAST(NULL AS TIMESTAMP) AS max_timestamp FROM customers
    UNION ALL SELECT '{_CALLS}', count(*), 18, true, count(DISTINCT {_CALL_DAY}), 'interaction_id', min(least({ts('interaction_date')}, {ts('process_date')})), max(greatest({ts('interaction_date')}, {ts('process_date')})) FROM {_CALLS}""".replace(
        "'customer_id,full_name'", "'customer_id'"
    ),
)
def inventory(spark, sf):
    t = tables(spark, sf, "customers", _CALLS)
    files = L.dataset_files(L.list_files(spark, csv_tree(spark, sf)))
    quality = union(P.column_profile(df, n) for n, df in t.items())
    found = A.inventory(t, files, quality, "2024-01-20")
    return found.select(
        "dataset", "rows", "columns", "event_like", "partition_dates", F.col("candidate_primary_key").alias("keys"), "min_timestamp", "max_timestamp"
    )


def _all_cells(dataset: str, source: str) -> str:
    return f"SELECT '{dataset}' AS dataset, column_name, nullif(trim(v), '') AS v FROM (SELECT COLUMNS(*)::VARCHAR FROM {source}) UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(*)))"


@register(
    "a38_sample_statistics",
    with_tables("customers", "products", _CALLS)
    + types_sql(
        " UNION ALL ".join([
            _all_cells("customers", "customers"), _all_cells("products", "products"),
            _all_cells(_CALLS, f"(SELECT * REPLACE (coalesce(CAST({ts('interaction_date')} AS VARCHAR), '2024-01-15') AS interaction_date) FROM {_CALLS})"),
        ])
    ).replace("FROM x", ", true AS present_in_all_samples, regexp_matches(column_name, '(^|[_-])(id|key|number|no)$|(^|[_-])(id|key)([_-]|$)') AS primary_key_candidate FROM x"),
)
def sample_statistics(spark, sf):
    """Column inventory of the whole tree: all rows of all files are typed."""
    return A.schema_recon(spark, csv_tree(spark, sf)).select(
        "dataset", "column_name", "observed_nonempty_values", "observed_distinct_values_capped", "semantic_type", "present_in_all_samples",
        "primary_key_candidate",
    )


@register(
    "a39_row_widths",
    """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS width, count(*) AS rows, true AS mixed FROM customer GROUP BY 1""",
)
def row_widths(spark, sf):
    widths = S.row_widths(spark, ragged_tree(spark, sf))
    total = widths.groupBy("width").agg(F.sum("rows").alias("rows"))
    kinds = widths.agg((F.count_distinct("width") > 1).alias("mixed")).scalar()
    return total.select("width", "rows", kinds.alias("mixed"))


@register(
    "o06_file_cap",
    with_tables(_CALLS)
    + _LISTING
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY relative_path) AS place, count(*) OVER (PARTITION BY dataset) AS available_files FROM li)
    SELECT dataset, relative_path, place, available_files, available_files > 12 AS rows_are_sampled FROM r WHERE place <= 12""",
)
def file_cap(spark, sf):
    return L.capped_files(day_listing(spark, sf), 12).select("dataset", "relative_path", "place", "available_files", "rows_are_sampled")


@register(
    "u05_header_drift",
    "SELECT 'complaints' AS dataset, 2 AS headers, 2 AS columns_in_all_files, 2 AS columns_in_some_files, true AS header_inconsistency, true AS schema_drift FROM (SELECT count(*) FROM orders)",
)
def header_drift(spark, sf):
    found = L.header_drift(L.list_files(spark, drifting_tree(spark, sf)))
    counts = ("headers", "columns_in_all_files", "columns_in_some_files")
    return found.select("dataset", *(F.col(c).cast("int").alias(c) for c in counts), "header_inconsistency", "schema_drift")


_JOIN_NUMBERS = ("child_row_count", "non_null_child_keys", "distinct_child_keys", "matched_distinct_keys", "unmatched_distinct_keys")


@register(
    "s23_evidence_from_files",
    with_tables(*EVIDENCE_TABLES)
    + f"""SELECT record_id, status, {', '.join(_JOIN_NUMBERS)}, match_rate_pct, child_row_count AS manifest_rows
    FROM ({" UNION ALL ".join(fk_sql(e) for e in vocab.EVIDENCE_EDGES)})""",
)
def evidence_from_files(spark, sf):
    """The evidence pass from CSV files to artifacts; its join artifact and its manifest are read back from what it wrote."""
    reports = scratch_path(spark, "evidence-reports")
    V.run(spark, scoped_tree(spark, sf), reports, "2024-01-20")
    joins = spark.read.options(**_AS_IS).csv(f"{reports}/06_join_quality")
    counted = spark.read.json(f"{reports}/manifest").select(F.inline("tables")).select("dataset", F.col("rows").alias("manifest_rows"))
    return joins.join(counted, F.col("child_dataset") == F.col("dataset")).select(
        "record_id", "status", *(F.col(c).cast("long").alias(c) for c in _JOIN_NUMBERS),
        F.col("match_rate_pct").cast("double").alias("match_rate_pct"), "manifest_rows",
    )
