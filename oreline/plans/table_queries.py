"""Sources and sinks as round trips of the given tables, and row-wise columns."""

from pyspark.sql import functions as F

from oreline.operators import scalars as sc
from oreline.plans.catalog import query
from oreline.session import scratch_path
from oreline.sources import batches as bt, tables as tb

CUSTOMER = "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("read_delimited", CUSTOMER)
def read_delimited(t):
    path = scratch_path(t.spark, "csv")
    tb.write_csv(t.customer, path)
    return tb.infer_types(tb.read_delimited(t.spark, path))


@query("read_delimited_tabs", CUSTOMER)
def read_tabs(t):
    path = scratch_path(t.spark, "tsv") + ".tsv"
    tb.write_tsv(t.customer, path)
    return tb.infer_types(tb.read_any(t.spark, path))


@query("write_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def write_json(t):
    path = scratch_path(t.spark, "json") + ".json"
    tb.write_json(t.customer, path, ["c_custkey", "c_name", "c_acctbal"])
    return tb.read_any(t.spark, path)


@query("read_orc_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def read_orc(t):
    path = scratch_path(t.spark, "orc") + ".orc"
    t.orders.select("o_orderkey", "o_totalprice").write.orc(path)
    return tb.read_any(t.spark, path)


@query(
    "infer_types_sampled",
    """SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS name,
              unnest(['number', 'string', 'string', 'string', 'number']) AS type""",
)
def infer_sampled(t):
    return tb.infer_types_sampled(t.documents)


@query("numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_columns(t):
    return tb.numeric_columns(t.part)


@query("save_load_dataset", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def save_load(t):
    folder = scratch_path(t.spark, "store")
    name = "stored_" + folder[-12:]
    tb.save_dataset(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), name, folder)
    assert tb.has_dataset(t.spark, name)
    return tb.load_dataset(t.spark, name)


@query(
    "append_rows",
    """SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS _row_idx FROM supplier UNION ALL
       SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 + (SELECT count(*) FROM supplier) FROM customer""",
)
def append_rows(t):
    path = scratch_path(t.spark, "rows")
    tb.append_rows(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path, "id")
    tb.append_rows(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path, "id")
    return t.spark.read.parquet(path)


@query(
    "page_batches",
    """WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _row_idx, s_suppkey AS id, s_name AS name FROM supplier),
            b AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 + (SELECT count(*) FROM a) AS _row_idx, c_custkey AS id, c_name AS name FROM customer)
       SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY _row_idx LIMIT 120 OFFSET 50""",
)
def page_of_batches(t):
    """A page over two batches, of which the first is appended twice."""
    path = scratch_path(t.spark, "batches")
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    bt.append_batch(suppliers, path, "id", "suppliers")
    bt.append_batch(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path, "id", "customers")
    bt.append_batch(suppliers, path, "id", "suppliers")
    return bt.page_batches(t.spark, path, 50, 120)


@query("page_rows", "SELECT o_orderkey AS _row_idx, o_totalprice FROM orders ORDER BY 1 LIMIT 500 OFFSET 1000")
def page_rows(t):
    return tb.page_rows(t.orders.select(F.col("o_orderkey").alias("_row_idx"), "o_totalprice"), 1000, 500)


@query("records_from_json", "SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events")
def records(t):
    return tb.records_from_json(t.events.select("event_id", "event_type", "props"), "props", "k bigint")


@query("head_sample", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def head_sample(t):
    return tb.head_sample(t.customer, "c_custkey", 5)


@query(
    "bounded_sample",
    """SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS rn,
         sum(length('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}')) OVER (ORDER BY c_custkey) AS b
       FROM customer) WHERE rn <= 1000 AND (b <= 20000 OR rn <= 50)""",
)
def bounded_sample(t):
    return tb.bounded_sample(t.customer.select("c_custkey", "c_name"), "c_custkey", 1000, 20_000)


@query(
    "stride_sample",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % (SELECT ceil(count(*) / 2000)::BIGINT FROM orders) = 0",
)
def stride_sample(t):
    return tb.stride_sample(t.orders.select("o_orderkey", "o_totalprice"), 2000, "o_orderkey")


@query("random_sample", "SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || '~42'), p_partkey LIMIT 300")
def random_sample(t):
    return tb.random_sample(t.part.select("p_partkey", "p_name"), 300, "p_partkey")


# --- row-wise columns -----------------------------------------------------------------------------


@query(
    "derive_formula",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) ^ 2
              - CASE WHEN l_tax = 0 THEN 0 ELSE l_quantity / l_tax END + l_quantity % 7, 6) AS v FROM lineitem""",
)
def derive(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    made = sc.derive(rows, "v", "l_extendedprice * (1 - l_discount) ^ 2 - l_quantity / l_tax + l_quantity % 7")
    return made.select("l_orderkey", "l_linenumber", "v")


@query(
    "formula_functions",
    """SELECT p_partkey, round(log10(p_retailprice) + ln(p_size) + sqrt(p_size) - abs(-p_size) + exp(p_size / 50)
              + least(p_size, 10) * greatest(p_size, 20), 6) AS v FROM part""",
)
def functions(t):
    text = "log(p_retailprice) + ln(p_size) + sqrt(p_size) - abs(-p_size) + exp(p_size / 50) + min(p_size, 10) * max(p_size, 20)"
    return sc.derive(t.part, "v", text).select("p_partkey", "v")


@query(
    "math_op",
    """SELECT p_partkey, p_retailprice / p_size AS ratio, p_size::DOUBLE * p_size AS squared,
              round(sqrt(p_retailprice), 6) AS root FROM part""",
)
def math_op(t):
    out = sc.math_op(t.part, "ratio", "p_retailprice", "/", "p_size")
    out = sc.math_op(out, "squared", "p_size", "**2")
    out = sc.math_op(out, "root", "p_retailprice", "sqrt")
    return out.select("p_partkey", "ratio", "squared", F.round("root", 6).alias("root"))


@query(
    "log_transforms",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS ln,
              CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 6) END AS log2,
              CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS log10,
              CASE WHEN c_acctbal >= 0 THEN round(ln(1 + c_acctbal), 6) END AS log1p,
              CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS root FROM customer""",
)
def logs(t):
    out = t.customer
    for kind in ("ln", "log2", "log10"):
        out = sc.log_transform(out, "c_acctbal", kind, kind)
    out = sc.sqrt_transform(sc.log1p(out, "c_acctbal", "log1p"), "c_acctbal", "root")
    return out.select("c_custkey", "ln", "log2", "log10", "log1p", "root")


@query(
    "l2_normalize",
    """SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(l_quantity ^ 2 + l_tax ^ 2), 6) AS l_quantity,
              round(l_tax / sqrt(l_quantity ^ 2 + l_tax ^ 2), 6) AS l_tax FROM lineitem""",
)
def l2(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return sc.l2_normalize(rows, ["l_quantity", "l_tax"]).select(
        "l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax")
    )


@query(
    "interactions",
    """SELECT p_partkey, round(p_size * p_retailprice, 4) AS product, round(p_retailprice / p_size, 4) AS ratio,
              round(p_retailprice - p_size, 4) AS difference, round(p_size + p_retailprice, 4) AS sum,
              round((p_size + p_retailprice) / 2, 4) AS mean FROM part""",
)
def interactions(t):
    out = t.part
    for kind, (a, b) in {
        "product": ("p_size", "p_retailprice"), "ratio": ("p_retailprice", "p_size"),
        "difference": ("p_retailprice", "p_size"), "sum": ("p_size", "p_retailprice"), "mean": ("p_size", "p_retailprice"),
    }.items():
        out = sc.interaction(out, a, b, kind, kind)
    return out.select("p_partkey", *[F.round(k, 4).alias(k) for k in ("product", "ratio", "difference", "sum", "mean")])


@query(
    "date_extract",
    """SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month,
              day(o_orderdate)::INT AS o_orderdate_day, hour(o_orderdate)::INT AS o_orderdate_hour,
              dayofweek(o_orderdate)::INT AS o_orderdate_weekday, quarter(o_orderdate)::INT AS o_orderdate_quarter,
              weekofyear(o_orderdate)::INT AS o_orderdate_week, dayofweek(o_orderdate) IN (0, 6) AS o_orderdate_is_weekend
       FROM orders""",
)
def date_extract(t):
    return sc.date_extract(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", list(sc.DATE_PARTS)).drop("o_orderdate")


@query(
    "parse_number",
    "SELECT p_partkey, p_retailprice AS price, (regexp_extract(p_brand, '\\d+'))::DOUBLE AS brand FROM part",
)
def parse_number(t):
    text = F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    return t.part.select(
        "p_partkey", sc.parse_number(F.concat(text, F.lit(" kg"))).alias("price"),
        sc.parse_number(F.regexp_replace("p_brand", "Brand#", "")).alias("brand"),
    )


@query("parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def parse_date(t):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return t.orders.select("o_orderkey", F.date_format(sc.parse_date(text, "dd/MM/yyyy"), "yyyy-MM-dd").alias("d"))


@query("json_get", "SELECT event_id, (props->>'$.k')::INT AS k, '{\"k\":' || (props->>'$.k') || '}' AS again FROM events")
def json_get(t):
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.to_json(F.from_json("props", "k int")).alias("again"),
    )


@query(
    "string_ops",
    """SELECT doc_id, len(string_split(lower(trim(text)), ' '))::INT AS words, contains(lower(text), 'license') AS licensed,
              length(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', '', 'g'))::INT AS plain, lang || '|' || source AS key
       FROM documents""",
)
def string_ops(t):
    low = F.lower(F.trim("text"))
    return t.documents.select(
        "doc_id", F.size(F.split(low, " ")).alias("words"), F.lower("text").contains("license").alias("licensed"),
        F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\s]", "")).alias("plain"),
        F.concat_ws("|", "lang", "source").alias("key"),
    )


@query(
    "rounding",
    """SELECT o_orderkey, round(o_totalprice / 7, 3) AS r3, round(o_totalprice / 7, 4) AS r4, round(o_totalprice / 7, 6) AS r6
       FROM orders""",
)
def rounding(t):
    x = F.col("o_totalprice") / 7
    return t.orders.select("o_orderkey", *[F.round(x, n).alias(f"r{n}") for n in (3, 4, 6)])


@query(
    "array_ops",
    """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS positive,
              round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 4) AS doubled,
              len(list_distinct(list_transform(embedding, lambda x: x > 0)))::INT AS signs,
              len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_large FROM embeddings""",
)
def array_ops(t):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
        F.round(F.aggregate(F.transform(e, lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x), 4).alias("doubled"),
        F.size(F.array_distinct(F.transform(e, lambda x: x > 0))).alias("signs"),
        F.exists(e, lambda x: x > F.lit(0.3)).alias("any_large"),
    )


@query(
    "color_scale",
    """SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS color
       FROM customer""",
)
def color_scale(t):
    return sc.color_scale(t.customer, "c_acctbal").select("c_custkey", F.round("color", 6).alias("color"))


@query("palette_index", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1) % 8 AS color FROM part")
def palette(t):
    return sc.palette_index(t.part.select("p_partkey", "p_brand"), "p_brand", 8).select("p_partkey", "color")
