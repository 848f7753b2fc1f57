"""Input tables and the report-shaped views derived from them.

Every view exists twice: as a DataFrame and as a SQL common table expression.
The reports are rendered from order data, so the values an extraction has to
find are known from the source columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportloom.functions.text import confidence_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- reports rendered from orders -------------------------------------------

# Rendered category text and the categories expected from it, by market segment.
CATEGORY_TEXT = {
    "AUTOMOBILE": "road highways safety related deaths",
    "BUILDING": "Railway",
    "FURNITURE": "Product related deaths; Other related deaths",
    "HOUSEHOLD": "Suicide from 2015, suicide FROM 2015",
    "MACHINERY": "Unlisted matter",
}
CATEGORY_LIST = {
    "AUTOMOBILE": ["Road Highways Safety related deaths"],
    "BUILDING": ["Railway related deaths"],
    "FURNITURE": ["Product related deaths", "Other related deaths"],
    "HOUSEHOLD": ["Suicide from 2015"],
    "MACHINERY": ["Unlisted matter"],
}


def _by_value(column: str, values: dict[str, str]) -> Column:
    first, *rest = values.items()
    case = F.when(F.col(column) == first[0], first[1])
    for key, value in rest:
        case = case.when(F.col(column) == key, value)
    return case


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the values its report will state."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return joined.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.concat(
            F.when(F.col("o_orderstatus") == "F", "Response to ").otherwise(""),
            F.lit("Report "), F.col("o_orderkey"),
        ).alias("title"),
        F.concat(
            F.year("o_orderdate"), F.lit("-"),
            F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"),
        ).alias("fact_ref"),
        F.to_date("o_orderdate").alias("fact_date"),
        "c_name", "n_name", "c_mktsegment", "o_orderpriority", "o_orderstatus",
    )


def uk_ordinal(day: Column) -> Column:
    suffix = (
        F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st")
        .when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    )
    return F.concat(day.cast("string"), suffix)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order reports as text: ``record_id, ingest_seq, title, content`` and facts."""
    facts = order_facts(spark, sf_dir)
    d = F.col("fact_date")
    ordinal = uk_ordinal(F.dayofmonth(d))
    date_line = (
        F.when(F.col("c_mktsegment") == "FURNITURE", F.lit(None))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Date of report: "), F.date_format(d, "d MMMM yyyy")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Date of report: "), F.date_format(d, "dd/MM/yyyy")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("Date of report: "), ordinal, F.date_format(d, " MMMM yyyy")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("DATED this "), ordinal, F.lit(" day of "), F.date_format(d, "MMMM yyyy")))
        .otherwise(F.concat(F.lit("Date: "), F.date_format(d, "d MMM yyyy")))
    )
    concern = F.when(F.col("o_orderstatus") != "P", F.concat(
        F.lit("MATTERS OF CONCERN: "), "o_orderpriority",
        F.lit(" issue was found. More follows ACTION SHOULD BE TAKEN at once."),
    ))
    content = F.concat_ws(
        "\n", date_line,
        F.concat(F.lit("Ref: "), "fact_ref"),
        F.concat(F.lit("Deceased name: "), "c_name"),
        F.concat(F.lit("Coroner name: Dr "), "c_name"),
        F.concat(F.lit("Coroner Area: "), "n_name"),
        F.concat(F.lit("Category: "), _by_value("c_mktsegment", CATEGORY_TEXT),
                 F.lit(" This report is being sent to: Trust")),
        concern,
    )
    return facts.withColumn("content", content)


def _sql_case(column: str, values: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {whens} END"


REPORTS_SQL = f"""
facts AS (
  SELECT o_orderkey AS record_id, o_orderkey AS ingest_seq,
    (CASE WHEN o_orderstatus = 'F' THEN 'Response to ' ELSE '' END) || 'Report ' || o_orderkey AS title,
    year(o_orderdate) || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS ref,
    o_orderdate::DATE AS full_date,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE o_orderdate::DATE END AS date_of_report,
    c_name AS deceased_name, 'Dr ' || c_name AS coroner_name, n_name AS coroner_area,
    {_sql_case("c_mktsegment", {k: "|".join(v) for k, v in CATEGORY_LIST.items()})} AS categories,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority || ' issue was found.' END AS extracted_concerns,
    o_orderpriority, o_orderstatus, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


# --- annotations derived from order lines -----------------------------------

THEME_PREFIX = {
    "STANDARD": "Person", "ECONOMY": "Communication and Culture", "LARGE": "External",
    "PROMO": "Human Error", "SMALL": "Jobs/Task", "MEDIUM": "Weather",
}


def line_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation table: one row per order, framework and theme of its parts."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    facts = order_facts(spark, sf_dir).select(
        "record_id", "title", F.col("c_name").alias("coroner_name"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("n_name")).alias("coroner_area"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.year("fact_date")).alias("year"),
    )
    themed = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("record_id"),
        F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), "Alpha")
        .when(F.col("p_type").isin("LARGE", "PROMO"), "Beta").otherwise("Gamma").alias("framework"),
        F.concat(
            _by_value("p_type", THEME_PREFIX), F.lit(" - "), F.substring_index("p_name", " ", -1)
        ).alias("theme"),
        (0.3 + 6 * F.col("l_discount")).alias("score"),
    )
    grouped = themed.groupBy("record_id", "framework", "theme").agg(
        F.round(F.max("score"), 3).alias("combined_score")
    )
    return grouped.join(facts, "record_id").withColumn("confidence", confidence_label("combined_score"))


ANNOTATIONS_SQL = f"""
ann AS (
  SELECT t.*, title, c_name AS coroner_name,
    CASE WHEN o_orderpriority <> '5-LOW' THEN n_name END AS coroner_area,
    CASE WHEN c_mktsegment <> 'FURNITURE' THEN year(o_orderdate)::INT END AS "year",
    CASE WHEN combined_score >= 0.7 THEN 'High' WHEN combined_score >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM (
    SELECT l_orderkey AS record_id,
      CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'Alpha'
           WHEN p_type IN ('LARGE', 'PROMO') THEN 'Beta' ELSE 'Gamma' END AS framework,
      {_sql_case("p_type", THEME_PREFIX)} || ' - ' || split_part(p_name, ' ', 2) AS theme,
      round(max(0.3 + 6 * l_discount), 3) AS combined_score
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
  ) t
  JOIN (SELECT *, (CASE WHEN o_orderstatus = 'F' THEN 'Response to ' ELSE '' END) || 'Report ' || o_orderkey AS title FROM orders) ON record_id = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


# --- documents as reports ---------------------------------------------------

def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("record_id"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("coroner_area"),
        F.array("lang", F.when(F.col("n_chars") >= 1500, "long").otherwise("short")).alias("categories"),
        (2015 + F.col("doc_id") % 8).cast("int").alias("year"),
        F.make_date(
            (2015 + F.col("doc_id") % 8).cast("int"), (1 + F.col("doc_id") % 12).cast("int"),
            (1 + F.col("doc_id") % 28).cast("int"),
        ).alias("date_of_report"),
        "lang", "n_chars",
    )


DOCS_SQL = """
docs AS (
  SELECT doc_id AS record_id, 'Doc ' || doc_id AS title, text AS content, source AS coroner_area,
    [lang, CASE WHEN n_chars >= 1500 THEN 'long' ELSE 'short' END] AS categories,
    (2015 + doc_id % 8)::INT AS "year",
    make_date(2015 + doc_id % 8, 1 + doc_id % 12, 1 + doc_id % 28) AS date_of_report, lang, n_chars
  FROM documents
)"""

# The test framework: theme, number of its vector, keywords.
FRAMEWORKS = {
    "Alpha": [
        ("T1", 1, ["thanedble", "of the"]),
        ("T2", 2, ["attion", "ering"]),
        ("T3", 3, ["ertion", "erble", "thanea"]),
    ],
    "Beta": [
        ("T4", 4, ["oned", "attion"]),
        ("T5", 5, ["aned", "oning", "in the"]),
        ("T6", 6, ["zzz"]),
    ],
}


def framework_rows() -> list[tuple]:
    return [
        (name, t, theme, k, keyword)
        for name, themes in FRAMEWORKS.items()
        for t, (theme, _, keywords) in enumerate(themes)
        for k, keyword in enumerate(keywords)
    ]


def frameworks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        framework_rows(), "framework string, theme_idx int, theme string, kw_idx int, keyword string"
    )


FRAMEWORKS_SQL = "fw(framework, theme_idx, theme, kw_idx, keyword) AS (VALUES " + ", ".join(
    f"('{f}', {t}, '{theme}', {k}, '{kw}')" for f, t, theme, k, kw in framework_rows()
) + ")"


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the embedding its id points to (500 exist everywhere)."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"), (F.col("doc_id") % 500).alias("vec_id")
    )
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return d.join(e, "vec_id").select("record_id", "vector")


def theme_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean embedding of the label each theme points to."""
    themes = spark.createDataFrame(
        [(f, t, theme, label) for f, ts in FRAMEWORKS.items() for t, (theme, label, _) in enumerate(ts)],
        "framework string, theme_idx int, theme string, label int",
    )
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return themes.join(vectors, "label").select(
        "framework", "theme_idx", "theme", F.transform("v", lambda c: c["x"]).alias("theme_vector")
    )


VECTORS_SQL = """
labels_of(framework, theme_idx, theme, label) AS (VALUES """ + ", ".join(
    f"('{f}', {t}, '{theme}', {label})"
    for f, ts in FRAMEWORKS.items() for t, (theme, label, _) in enumerate(ts)
) + """),
means AS (
  SELECT label, list(x ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label
),
tv AS (SELECT framework, theme_idx, theme, v FROM labels_of JOIN means USING (label)),
dv AS (SELECT doc_id AS record_id, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id % 500)"""


# --- labels as evaluation rows ----------------------------------------------

def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human and predicted label per document; case and blank variants."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    plain = F.when(F.col("quality") == 1, "good").otherwise("poor")
    return joined.select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("title"),
        F.when(F.col("lang") == "es", " ")
        .when(F.col("lang") == "fr", F.concat(F.lit(" "), F.initcap(plain)))
        .otherwise(plain).alias("human"),
        F.when(F.col("n_chars") >= 1500, "good").when(F.col("n_chars") >= 900, "unsure")
        .otherwise("poor").alias("predicted"),
        "text", "lang",
    )


EVAL_SQL = """
raw AS (
  SELECT l.doc_id AS record_id, source AS title,
    CASE WHEN lang = 'es' THEN ' '
         WHEN lang = 'fr' THEN CASE WHEN quality = 1 THEN ' Good' ELSE ' Poor' END
         ELSE CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END END AS human,
    CASE WHEN n_chars >= 1500 THEN 'good' WHEN n_chars >= 900 THEN 'unsure' ELSE 'poor' END AS predicted,
    text, lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
),
ev AS (SELECT record_id, title, trim(human) AS human, predicted FROM raw WHERE trim(human) <> '')"""


# --- conversations as reports with attachments ------------------------------

def attachment_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per conversation; its turns are the attachments.

    A conversation is one document of a few turns, so its list stays small.
    """
    c = table(spark, sf_dir, "conversations")
    pdf = F.struct(
        F.col("turn").cast("int").alias("pos"),
        F.concat("role", F.lit("_"), "turn", F.lit(".pdf")).alias("name"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("MATTERS OF CONCERN: "), "text"))
        .otherwise(F.col("text")).alias("content"),
        F.concat(F.lit("/files/"), "conv_id", F.lit("/"), "role", F.lit(".pdf")).alias("path"),
        F.when(F.col("role") == "assistant", "response").otherwise("report").alias("type"),
    )
    return c.groupBy(F.col("conv_id").alias("record_id")).agg(
        F.sort_array(F.collect_list(pdf)).alias("pdfs"),
        F.max(F.when(F.col("role") == "system", F.col("text"))).alias("content"),
    ).withColumns({
        "title": F.concat(F.lit("Case "), "record_id"),
        "extracted_concerns": F.lit(None).cast("string"),
        "ingest_seq": F.col("record_id"),
    })


ATTACH_SQL = """
att AS (
  SELECT conv_id AS record_id, turn::INT AS pos, role || '_' || turn || '.pdf' AS name,
    CASE WHEN role = 'assistant' THEN 'MATTERS OF CONCERN: ' || text ELSE text END AS content,
    '/files/' || conv_id || '/' || role || '.pdf' AS path,
    CASE WHEN role = 'assistant' THEN 'response' ELSE 'report' END AS type, role, text
  FROM conversations
)"""
