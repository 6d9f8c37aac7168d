"""Deterministic projections of the test tables into the shapes the operators read.

Each binding exists twice: as a DataFrame here and as a common table expression in ``ORACLE``
below, written independently in the SQL of the checking engine. All perturbations are integer
arithmetic, so both sides agree exactly. Nothing is sampled or left out: where an engine "saw
nothing" the observation row is there with a null value.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.sources.tables import dealt, read_table


def _mix(a: Column, b: Column, c: Column | int, n: int) -> Column:
    return F.pmod(a * 31 + b * 7 + (c if isinstance(c, Column) else F.lit(c)) * 13, F.lit(n))


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def batches(spark: SparkSession, base: str) -> DataFrame:
    orders = read_table(spark, base, "orders")
    customer = read_table(spark, base, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("batch_id"),
        F.col("o_custkey").alias("company_id"),
        F.col("c_name").alias("importer"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "enterprise").otherwise("sme").alias("tier"),
        F.coalesce(_lookup({"F": "accepted", "O": "review_ready"}, F.col("o_orderstatus")), F.lit("rejected")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("cif_value"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderstatus") == "P").alias("rejected"),
    )


def documents_of_batches(spark: SparkSession, base: str) -> DataFrame:
    """One row per shipping document: a line of an order."""
    return shape_documents(read_table(spark, base, "lineitem"))


def shape_documents(li: DataFrame) -> DataFrame:
    return li.select(
        F.col("l_orderkey").alias("batch_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("doc_id"),
        F.element_at(F.array(*[F.lit(t) for t in K.DOC_TYPES]), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("doc_type"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_shipdate", "l_returnflag",
    )


def observations(spark: SparkSession, base: str, fields: Collection[str] | None = None) -> DataFrame:
    """Central fact table: one engine's reading of one field of one document. With ``fields``, the rows of these fields only."""
    return shape_observations(dealt(documents_of_batches(spark, base), "batch_id", "doc_id"), fields)


CROWDED = 10_000  # a batch with more documents is not one piece of work


def documents_by_batch(spark: SparkSession, base: str) -> list[DataFrame]:
    """The documents for work by batch, in two parts without a batch in common: those of batches that fit a piece, dealt out by batch so that
    groups by batch run where the readings are made, and those of crowded batches, dealt out by document. At most one batch in ``CROWDED`` documents is crowded."""
    docs = documents_of_batches(spark, base)
    counted = docs.groupBy(F.col("batch_id").alias("crowded")).agg(F.count(F.lit(1)).alias("n"))
    crowded = F.broadcast(counted.where(F.col("n") > CROWDED).select("crowded"))
    among = F.col("batch_id").eqNullSafe(F.col("crowded"))
    few = dealt(docs.join(crowded, among, "left_anti"), "batch_id")
    many = dealt(docs.join(crowded, among, "left_semi"), "batch_id", "doc_id")
    return [few, many]


def observations_by_batch(spark: SparkSession, base: str) -> list[DataFrame]:
    """The readings of both parts of ``documents_by_batch``."""
    return [shape_observations(docs) for docs in documents_by_batch(spark, base)]


def shape_observations(docs: DataFrame, fields: Collection[str] | None = None) -> DataFrame:
    order, part, supp, rank = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("engine_rank")
    ranks = F.array(*[F.lit(r) for r in range(1, len(K.ENGINES) + 1)])
    engines = F.array(*[F.lit(e) for e in K.ENGINES])
    read = docs.withColumn("engine_rank", F.explode(ranks)).select(
        "batch_id", "doc_id", "doc_type", F.element_at(engines, rank).alias("engine"), rank,
        (F.pmod(order + part * 3 + rank * 5, F.lit(17)) != 0).alias("seen"),
        ((F.lit(60) + F.pmod(part * 3 + rank * 11, F.lit(40))) / F.lit(100.0)).alias("confidence"),
        (F.col("l_quantity").cast("bigint") + F.when(_mix(order, part, rank, 10) == 0, 1).otherwise(0)).alias("packages"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("money"),
        F.lpad(part.cast("string"), 8, "0").alias("tariff"), _mix(order, part, rank, 25).alias("cut"), supp.alias("supp"),
    )
    money = F.col("money")
    weight = F.when(rank == 2, F.format_number(money, 2)).when(rank == 3, F.concat(money.cast("string"), F.lit(" KGS"))).otherwise(money.cast("string"))
    code = F.when(F.col("cut") == 0, F.left("tariff", F.lit(6))).otherwise(F.col("tariff"))
    vessel = F.concat(F.when(rank % 2 == 0, "M/V SUPPLIER ").otherwise("Supplier "), F.col("supp").cast("string"))
    values = {"total_packages": F.col("packages").cast("string"), "gross_weight": weight, "hs_code": code, "vessel_name": vessel}
    cells = [(F.lit(f).alias("field"), F.when(F.col("seen"), v).alias("value")) for f, v in values.items() if fields is None or f in fields]
    if len(cells) == 1:  # a constant field: of the forms by field, the planner keeps the one that is its own
        return read.select("batch_id", "doc_id", "doc_type", "engine", "engine_rank", *cells[0], "confidence")
    cells = F.array(*[F.struct(*c) for c in cells])
    return read.select("batch_id", "doc_id", "doc_type", "engine", "engine_rank", F.inline(cells), "confidence")


def batch_scores(spark: SparkSession, base: str) -> DataFrame:
    """Per-batch score inputs, one pre-aggregation of the lines before the join to the orders."""
    li = read_table(spark, base, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"])
    per_batch = li.groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        F.sum(F.col("l_discount").cast("decimal(12,2)")).alias("disc"),
        F.sum(F.col("l_tax").cast("decimal(12,2)")).alias("tax"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("package_count"),
        F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("weight"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_returnflag") == "A").alias("adjusted"),
        F.count_if(F.pmod(F.col("l_partkey"), F.lit(5)) == 0).alias("weak"),
    )
    orders = read_table(spark, base, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    n = F.col("n").cast("double")
    return per_batch.join(orders, F.col("batch_id") == F.col("o_orderkey")).select(
        "batch_id",
        F.col("o_custkey").alias("company_id"),
        (F.lit(1.0) - F.col("disc").cast("double") / n).alias("doc_quality"),
        ((n - F.col("weak")) / n).alias("completeness"),
        ((n - F.col("returned")) / n).alias("consistency"),
        (F.lit(1.0) - F.col("tax").cast("double") * 4 / n).alias("agreement"),
        (F.lit(0.5) + F.pmod(F.col("batch_id"), F.lit(50)) / F.lit(100.0)).alias("hs_conf"),
        F.col("o_totalprice").alias("cif_value"),
        "package_count",
        F.col("weight").cast("double").alias("gross_weight"),
        F.when(F.col("returned") >= 3, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("critical"),
        F.least(F.col("adjusted"), F.lit(3)).cast("int").alias("warnings"),
        F.element_at(F.array(F.lit("passed"), F.lit("info"), F.lit("warning"), F.lit("critical")), (F.pmod(F.col("o_custkey"), F.lit(4)) + 1).cast("int")).alias("vessel_status"),
        F.col("weak").alias("missing"),
        (F.col("returned") + F.col("adjusted")).alias("disagreements"),
        (F.col("o_orderstatus") == "P").alias("label"),
    )


EVENT_ACTIONS = {"signup": "uploaded", "view": "preprocessing", "click": "validated", "purchase": "accepted", "error": "rejected"}


def shape_events(raw: DataFrame) -> DataFrame:
    """Event log layout from the raw event table; serves batch reads and streams alike."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(
        F.col("user_id").alias("batch_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(_lookup(EVENT_ACTIONS, F.col("event_type")), F.lit("unknown")).alias("action"),
        k.alias("k"),
        F.concat(F.lit("field_"), F.pmod(k, F.lit(12)).cast("string")).alias("field_name"),
        F.floor(F.col("value") / 10).cast("bigint").alias("pages"),
        F.col("value").alias("amount"),
        F.floor(F.col("event_id") / 2).cast("bigint").alias("idem_key"),
    )


def events(spark: SparkSession, base: str) -> DataFrame:
    return shape_events(read_table(spark, base, "events"))


def text_documents(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents")
    labels = read_table(spark, base, "labels", ["doc_id", "quality"]).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars",
        (F.lit(1) + F.floor(F.col("n_chars") / 3000)).cast("bigint").alias("page_count"), "quality",
    )


def eval_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Ground truth (two accepted spellings) and a prediction for every sentence of every document; ``doc_id`` names the sentence."""
    docs = dealt(read_table(spark, base, "documents", ["doc_id", "text"]), "doc_id")
    cut = docs.select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", r"[.\n]+")).alias("line", "raw"))
    title = F.trim(F.regexp_replace("raw", r"\s+", " "))
    rows = cut.select("source_id", "line", title.alias("title")).where("title <> ''")
    names = list(K.EVAL_FIELD_WEIGHTS)
    turn = F.col("source_id") + F.col("line")
    field = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(turn, F.lit(len(names))) + 1).cast("int"))
    return rows.select(
        F.concat_ws("-", "source_id", "line").alias("doc_id"), "source_id",
        field.alias("field"),
        F.array(F.col("title"), F.expr("substring(title, 5)")).alias("gt"),
        F.when(F.pmod(turn, F.lit(11)) == 0, F.lit(None))
        .when(F.pmod(turn, F.lit(3)) == 0, F.regexp_replace("title", "e", "o"))
        .otherwise(F.col("title")).alias("pred"),
        _lookup(K.EVAL_FIELD_WEIGHTS, field).alias("weight"),
        F.when(F.pmod("source_id", F.lit(5)) == 0, "val").otherwise("train").alias("split"),
    )


def positions(spark: SparkSession, base: str) -> DataFrame:
    return shape_positions(read_table(spark, base, "events"))


def shape_positions(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("user_id").alias("imo"),
        F.concat(F.lit("VESSEL "), F.col("user_id").cast("string")).alias("vessel_name"),
        ts.alias("ts"), "event_id",
        (ts + F.make_interval(days=F.pmod(k, F.lit(10)).cast("int"))).alias("eta"),
        F.col("value").alias("speed"),
        (k * 5).alias("heading"),
    )


def lineups(spark: SparkSession, base: str) -> DataFrame:
    li = read_table(spark, base, "lineitem", ["l_suppkey", "l_shipdate"])
    supplier = read_table(spark, base, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, base, "nation", ["n_nationkey", "n_name"])
    return (
        li.join(supplier, li.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("l_suppkey").alias("imo"), F.col("n_name").alias("port"), F.col("l_shipdate").cast("timestamp").alias("eta"))
    )


def vessels(spark: SparkSession, base: str) -> DataFrame:
    supplier = read_table(spark, base, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nation = read_table(spark, base, "nation", ["n_nationkey", "n_name"])
    key = F.col("s_suppkey")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("imo"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("flag"),
        (F.lit(1980) + F.pmod(key, F.lit(40))).cast("int").alias("built_year"),
        F.when(F.pmod(key, F.lit(20)) == 0, 1998).cast("int").alias("dead_year"),
        (F.pmod(key, F.lit(7)) != 0).alias("trading"),
        F.when(F.pmod(key, F.lit(3)) == 0, "Bulk").otherwise("Container").alias("vessel_type"),
    )


def owners(spark: SparkSession, base: str) -> DataFrame:
    supplier = read_table(spark, base, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("imo"), F.col("n_name").alias("country"),
        (F.col("n_regionkey") / F.lit(10.0)).alias("risk"),
    )


def tariff(spark: SparkSession, base: str) -> DataFrame:
    part = read_table(spark, base, "part", ["p_partkey", "p_name", "p_size"])
    code = F.lpad(F.pmod(F.col("p_partkey") * 1237, F.lit(100000000)).cast("string"), 8, "0")
    return part.select(
        code.alias("hs_code"), F.col("p_name").alias("description"),
        (F.col("p_size") / F.lit(1000.0)).alias("duty"), F.lit(0.11).alias("vat"),
        (F.pmod("p_partkey", F.lit(9)) != 0).alias("active"),
    )


def tariff_items(spark: SparkSession, base: str) -> DataFrame:
    docs = documents_of_batches(spark, base)
    # spread the parts over the tariff chapters with the scatter factor, so restricted chapters occur
    code = F.lpad(F.pmod(F.col("l_partkey") * 1237, F.lit(100000000)).cast("string"), 8, "0")
    chapter = F.lpad(F.pmod(F.col("l_partkey"), F.lit(100)).cast("string"), 2, "0")
    return docs.select(
        "batch_id", "doc_id", code.alias("hs_code"),
        F.concat(chapter, F.substring(code, 3, 6)).alias("goods_code"),
        F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), (F.pmod("l_suppkey", F.lit(2)) == 0).alias("has_permit"),
    )


# --------------------------------------------------------------------------------------------------
# The same bindings for the checking engine
# --------------------------------------------------------------------------------------------------

def _oracle_observations() -> str:
    rows = []
    for rank, engine in enumerate(K.ENGINES, start=1):
        weight = {
            2: "format('{:,.2f}', l_extendedprice)",
            3: "l_extendedprice::DECIMAL(18,2)::VARCHAR || ' KGS'",
        }.get(rank, "l_extendedprice::DECIMAL(18,2)::VARCHAR")
        prefix = "M/V SUPPLIER " if rank % 2 == 0 else "Supplier "
        seen = f"(l_orderkey + 3*l_partkey + {5 * rank}) % 17 <> 0"
        conf = f"(60 + (l_partkey*3 + {11 * rank}) % 40) / 100.0"
        values = {
            "total_packages": f"(l_quantity::BIGINT + CASE WHEN (l_orderkey*31 + l_partkey*7 + {13 * rank}) % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR",
            "gross_weight": weight,
            "hs_code": f"CASE WHEN (l_orderkey*31 + l_partkey*7 + {13 * rank}) % 25 = 0 THEN left(lpad(l_partkey::VARCHAR, 8, '0'), 6) ELSE lpad(l_partkey::VARCHAR, 8, '0') END",
            "vessel_name": f"'{prefix}' || l_suppkey::VARCHAR",
        }
        for field, value in values.items():
            rows.append(
                f"SELECT batch_id, doc_id, doc_type, '{engine}' AS engine, {rank} AS engine_rank, '{field}' AS field, "
                f"CASE WHEN {seen} THEN {value} END AS value, ({conf})::DOUBLE AS confidence FROM docs"
            )
    return " UNION ALL ".join(rows)


_CODE = "lpad(((l_partkey*1237) % 100000000)::VARCHAR, 8, '0')"
_EVAL_NAMES = ", ".join(f"'{n}'" for n in K.EVAL_FIELD_WEIGHTS)
_EVAL_WEIGHTS = " ".join(f"WHEN '{n}' THEN {w}" for n, w in K.EVAL_FIELD_WEIGHTS.items())

ORACLE: dict[str, tuple[list[str], str]] = {
    "b1": ([], """SELECT o_orderkey AS batch_id, o_custkey AS company_id, c_name AS importer,
        CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'enterprise' ELSE 'sme' END AS tier,
        CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'review_ready' ELSE 'rejected' END AS status,
        o_orderpriority AS priority, o_totalprice AS cif_value, o_orderdate AS created_at, o_orderstatus = 'P' AS rejected
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "docs": ([], """SELECT l_orderkey AS batch_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS doc_id,
        CASE l_linenumber % 3 WHEN 0 THEN 'bill_of_lading' WHEN 1 THEN 'packing_list' ELSE 'invoice' END AS doc_type, * FROM lineitem"""),
    "b2": (["docs"], _oracle_observations()),
    "b3": ([], """SELECT batch_id, o_custkey AS company_id, 1.0::DOUBLE - disc / n::DOUBLE AS doc_quality, (n - weak)::DOUBLE / n AS completeness,
        (n - returned)::DOUBLE / n AS consistency, 1.0::DOUBLE - tax * 4 / n::DOUBLE AS agreement,
        0.5::DOUBLE + (batch_id % 50) / 100.0::DOUBLE AS hs_conf, o_totalprice AS cif_value, package_count, weight AS gross_weight,
        CASE WHEN returned >= 3 THEN 1 ELSE 0 END AS critical, least(adjusted, 3) AS warnings,
        CASE o_custkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'critical' END AS vessel_status,
        weak AS missing, returned + adjusted AS disagreements, o_orderstatus = 'P' AS label
        FROM (SELECT l_orderkey AS batch_id, sum(l_discount::DECIMAL(12,2))::DOUBLE AS disc, sum(l_tax::DECIMAL(12,2))::DOUBLE AS tax,
              sum(l_quantity::BIGINT)::BIGINT AS package_count, sum(l_extendedprice::DECIMAL(14,2))::DOUBLE AS weight, count(*) AS n,
              count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag = 'A') AS adjusted,
              count(*) FILTER (l_partkey % 5 = 0) AS weak FROM lineitem GROUP BY 1) JOIN orders ON batch_id = o_orderkey"""),
    "b4": ([], """SELECT user_id AS batch_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'preprocessing'
        WHEN 'click' THEN 'validated' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'unknown' END AS action,
        (props->>'k')::BIGINT AS k, 'field_' || ((props->>'k')::BIGINT % 12)::VARCHAR AS field_name, floor(value / 10)::BIGINT AS pages,
        value AS amount, event_id // 2 AS idem_key FROM events"""),
    "b5": ([], """SELECT d.doc_id, text, lang, source, n_chars, (1 + n_chars // 3000)::BIGINT AS page_count, quality FROM documents d
        LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id"""),
    "b6": ([], f"""SELECT source_id::VARCHAR || '-' || line::VARCHAR AS doc_id, source_id, field, gt1, substr(gt1, 5) AS gt2, CASE WHEN (source_id + line) % 11 = 0 THEN NULL WHEN (source_id + line) % 3 = 0
        THEN replace(gt1, 'e', 'o') ELSE gt1 END AS pred, (CASE field {_EVAL_WEIGHTS} END)::DOUBLE AS weight,
        CASE WHEN source_id % 5 = 0 THEN 'val' ELSE 'train' END AS split
        FROM (SELECT source_id, line, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS gt1, ([{_EVAL_NAMES}])[((source_id + line) % {len(K.EVAL_FIELD_WEIGHTS)})::INT + 1] AS field
              FROM (SELECT doc_id AS source_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS line FROM (SELECT doc_id, string_split_regex(text, '[.\\n]+') AS parts FROM documents))) WHERE gt1 <> ''"""),
    "positions": ([], """SELECT user_id AS imo, 'VESSEL ' || user_id::VARCHAR AS vessel_name, ts, event_id,
        ts + to_days(((props->>'k')::BIGINT % 10)::INT) AS eta, value AS speed, (props->>'k')::BIGINT * 5 AS heading FROM events"""),
    "lineups": ([], """SELECT l_suppkey AS imo, n_name AS port, l_shipdate AS eta FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""),
    "vessels": ([], """SELECT s_suppkey AS imo, s_name AS name, n_name AS flag, 1980 + (s_suppkey % 40)::INT AS built_year,
        CASE WHEN s_suppkey % 20 = 0 THEN 1998 END AS dead_year, s_suppkey % 7 <> 0 AS trading,
        CASE WHEN s_suppkey % 3 = 0 THEN 'Bulk' ELSE 'Container' END AS vessel_type
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "owners": ([], """SELECT s_suppkey AS imo, n_name AS country, n_regionkey / 10.0::DOUBLE AS risk
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "tariff": ([], """SELECT lpad(((p_partkey*1237) % 100000000)::VARCHAR, 8, '0') AS hs_code, p_name AS description,
        p_size / 1000.0::DOUBLE AS duty, 0.11::DOUBLE AS vat, p_partkey % 9 <> 0 AS active FROM part"""),
    "items": (["docs"], f"""SELECT batch_id, doc_id, {_CODE} AS hs_code, lpad((l_partkey % 100)::VARCHAR, 2, '0') || substr({_CODE}, 3, 6) AS goods_code,
        l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS amount, l_linenumber AS line, l_partkey AS part,
        l_suppkey % 2 = 0 AS has_permit FROM docs"""),
}


def oracle(body: str, *needs: str, **extra: str) -> str:
    """Checking query: the needed common table expressions in order, then ``body``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        before, text = ORACLE[name]
        for other in before:
            add(other)
        done[name] = text

    for name in needs:
        add(name)
    done.update(extra)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in done.items()) + "\n" + body
