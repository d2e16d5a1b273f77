"""Rule-driven aggregation, stat codes and ordered merging. Roles: an order is a job, a customer a report, a line a stat row."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators.merge import canonical, first_of, signature
from tallyforge.operators import rules as R
from tallyforge.operators.rules import Rule, apply_rules, overlay, pivot_codes
from tallyforge.plans.registry import query, read

FIELDS = {n: f"stt_{n:02d}" for n in range(1, 8)}
#: Totals over the stand-in codes: 1 = 2 + 3, and 4 = 5 + 6 + 7.
EQUATIONS = [("stt_01", ["stt_02", "stt_03"]), ("stt_04", ["stt_05", "stt_06", "stt_07"])]


def stat_rows(spark, sf_dir):
    """(report, code, value) of every line."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("code"), F.col("l_quantity").cast("long").alias("value"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("report"), "code", "value")


_STAT = "SELECT o_custkey AS report, l_linenumber AS code, CAST(l_quantity AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_PIVOT = f"SELECT report, {', '.join(f'CAST(sum(CASE WHEN code = {n} THEN value END) AS BIGINT) AS {f}' for n, f in FIELDS.items())} FROM ({_STAT}) GROUP BY report"


@query(f"SELECT report, CAST(sum(value) AS BIGINT) AS total, round_even(avg(value), 4) AS mean, CAST(min(value) AS BIGINT) AS low, CAST(max(value) AS BIGINT) AS high, count(value) AS n FROM ({_STAT}) GROUP BY report")
def rule_sum_avg_min_max_count(spark, sf_dir):
    rules = [Rule("total", "value"), Rule("mean", "value", "avg", 4), Rule("low", "value", "MIN"), Rule("high", "value", "MAX"), Rule("n", "value", "COUNT")]
    return apply_rules(stat_rows(spark, sf_dir), ["report"], rules)


@query("SELECT c_custkey, coalesce(sum(CAST(round(o_totalprice) AS BIGINT)), 0)::BIGINT AS total, round_even(avg(CAST(round(o_totalprice) AS BIGINT)), 3) AS mean, coalesce(max(CAST(round(o_totalprice) AS BIGINT)), 0)::BIGINT AS high, coalesce(min(CAST(round(o_totalprice) AS BIGINT)), 0)::BIGINT AS low, count(o_totalprice) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rule_defaults_on_empty(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.round("o_totalprice").cast("long").alias("price"))
    rows = read(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return apply_rules(rows, ["c_custkey"], [Rule("total", "price"), Rule("mean", "price", "AVG", 3), Rule("high", "price", "MAX"), Rule("low", "price", "MIN"), Rule("n", "price", "COUNT")])


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, text) AS roles FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def rule_concat_ordered(spark, sf_dir):
    rows = apply_rules(read(spark, sf_dir, "conversations"), ["conv_id"], [Rule("roles", "role", "CONCAT")], F.struct("turn", "text"))
    return rows.withColumn("roles", F.array_join("roles", ","))


@query("SELECT conv_id, arg_max(text, turn) AS last_text FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS text FROM conversations) WHERE text IS NOT NULL GROUP BY conv_id")
def rule_last_non_null(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("role") == "user", F.col("text")))
    return apply_rules(said, ["conv_id"], [Rule("last_text", "said", "LAST")], F.struct("turn", "text")).where("last_text is not null")


_TEXTS = "CASE WHEN event_id % 5 = 0 THEN concat(' ', CAST(user_id AS VARCHAR(20)), ',5 ') WHEN event_id % 5 = 1 THEN 'không' WHEN event_id % 5 = 2 THEN '1,500,000' WHEN event_id % 5 = 3 THEN CAST(event_id AS VARCHAR(20)) END"
_N1 = f"CASE WHEN {_TEXTS} IS NOT NULL THEN coalesce(TRY_CAST(replace(trim({_TEXTS}), ',', '.') AS DECIMAL(38,10)), 0) END"


@query(f"SELECT event_type, CAST(sum({_N1}) AS DOUBLE) AS total, round(CAST(avg(CAST({_N1} AS DOUBLE)) AS DOUBLE), 2) AS mean, CAST(max({_N1}) AS DOUBLE) AS high, count({_TEXTS}) AS n, NULL::INTEGER AS lost, NULL::INTEGER AS odd FROM events GROUP BY event_type")
def rule_text_values(spark, sf_dir):
    """Rules over a column of texts, and two rules that can't be computed."""
    rows = read(spark, sf_dir, "events").select("event_type", F.expr(_TEXTS).alias("x"))
    rules = [Rule("total", "x"), Rule("mean", "x", "AVG", 2), Rule("high", "x", "max"), Rule("n", "x", "COUNT"), Rule("lost", "y"), Rule("odd", "x", "MEDIAN")]
    return apply_rules(rows, ["event_type"], rules).withColumns({c: F.col(c).cast("int") for c in ("lost", "odd")})


@query("SELECT user_id, string_agg(event_type || ',' || k, ',' ORDER BY ts, event_id) AS listed FROM (SELECT user_id, event_type, ts, event_id, CAST(event_id % 3 AS VARCHAR) AS k FROM events WHERE event_type <> 'view') GROUP BY user_id")
def rule_concat_lists(spark, sf_dir):
    """A5: lists are flattened by one level, in order; nulls are skipped."""
    pair = F.when(F.col("event_type") != "view", F.array("event_type", (F.col("event_id") % 3).cast("string")))
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", pair.alias("pair"))
    out = apply_rules(rows, ["user_id"], [Rule("listed", "pair", "CONCAT")], F.struct("ts", "event_id"))
    return out.where("size(listed) > 0").select("user_id", F.array_join("listed", ",").alias("listed"))


@query(f"SELECT report, CAST(coalesce(sum(CASE WHEN code = 2 THEN value END), 0) AS BIGINT) AS stt_2, CAST(coalesce(sum(CASE WHEN code = 5 THEN value END), 0) AS BIGINT) AS stt_5 FROM ({_STAT}) GROUP BY report")
def stat_code_sum(spark, sf_dir):
    return apply_rules(stat_rows(spark, sf_dir), ["report"], [Rule("stt_2", method="STT_SUM", stt=2), Rule("stt_5", method="STT_SUM", stt=5)])


@query(_PIVOT)
def stat_pivot_named(spark, sf_dir):
    return pivot_codes(stat_rows(spark, sf_dir), ["report"], FIELDS, "code", F.col("value"))


@query(f"SELECT report, c.code, CASE WHEN c.code = 4 THEN 'total' ELSE 'STT ' || c.code END AS label FROM (SELECT DISTINCT report FROM ({_STAT})) CROSS JOIN (SELECT unnest(range(1, 8))::INTEGER AS code) c WHERE (report, c.code) NOT IN (SELECT report, code FROM ({_STAT}))")
def stat_unpivot_missing(spark, sf_dir):
    """The codes that a report lacks: its set of codes against the list, without a second pass over the rows."""
    held = stat_rows(spark, sf_dir).groupBy("report").agg(F.collect_set("code").alias("held"))
    rows = held.select("report", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(7)), "held")).alias("code"))
    return rows.withColumn("label", F.when(F.col("code") == 4, "total").otherwise(F.concat(F.lit("STT "), F.col("code"))))


@query(f"""WITH p AS ({_PIVOT}) SELECT report,
CAST(CASE WHEN stt_01 IS NULL AND stt_02 IS NOT NULL AND stt_03 IS NOT NULL THEN stt_02 + stt_03 ELSE stt_01 END AS BIGINT) AS stt_01,
CAST(CASE WHEN stt_01 IS NOT NULL AND stt_02 IS NULL AND stt_03 IS NOT NULL THEN greatest(0, stt_01 - stt_03) ELSE stt_02 END AS BIGINT) AS stt_02,
CAST(CASE WHEN stt_01 IS NOT NULL AND stt_03 IS NULL AND stt_02 IS NOT NULL THEN greatest(0, stt_01 - stt_02) ELSE stt_03 END AS BIGINT) AS stt_03,
CAST(CASE WHEN stt_04 IS NULL AND stt_05 IS NOT NULL AND stt_06 IS NOT NULL AND stt_07 IS NOT NULL THEN stt_05 + stt_06 + stt_07 ELSE stt_04 END AS BIGINT) AS stt_04,
CAST(CASE WHEN stt_04 IS NOT NULL AND stt_05 IS NULL AND stt_06 IS NOT NULL AND stt_07 IS NOT NULL THEN greatest(0, stt_04 - stt_06 - stt_07) ELSE stt_05 END AS BIGINT) AS stt_05,
CAST(CASE WHEN stt_04 IS NOT NULL AND stt_06 IS NULL AND stt_05 IS NOT NULL AND stt_07 IS NOT NULL THEN greatest(0, stt_04 - stt_05 - stt_07) ELSE stt_06 END AS BIGINT) AS stt_06,
CAST(CASE WHEN stt_04 IS NOT NULL AND stt_07 IS NULL AND stt_05 IS NOT NULL AND stt_06 IS NOT NULL THEN greatest(0, stt_04 - stt_05 - stt_06) ELSE stt_07 END AS BIGINT) AS stt_07 FROM p""")
def derive_additive(spark, sf_dir):
    return R.derive_additive(stat_pivot_named(spark, sf_dir), EQUATIONS)


@query("SELECT o_custkey, arg_max(o_orderpriority, row(CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey)) AS last_priority FROM orders GROUP BY o_custkey")
def sort_then_last(spark, sf_dir):
    order = F.struct(F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderkey")
    return apply_rules(read(spark, sf_dir, "orders"), ["o_custkey"], [Rule("last_priority", "o_orderpriority", "LAST")], order)


@query("SELECT o_custkey, strftime(min(o_orderdate), '%d/%m/%Y') AS tu_ngay, strftime(max(o_orderdate), '%d/%m/%Y') AS den_ngay FROM orders GROUP BY o_custkey")
def reporting_window(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return rows.select("o_custkey", F.date_format("a", "dd/MM/yyyy").alias("tu_ngay"), F.date_format("b", "dd/MM/yyyy").alias("den_ngay"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS sig FROM documents) WHERE sig <> '' GROUP BY sig")
def dedup_signature_first(spark, sf_dir):
    """Texts are grouped by a digest, so they aren't shuffled."""
    docs = read(spark, sf_dir, "documents").select("doc_id", signature([F.col("text")]).alias("sig"))
    return docs.where("sig <> ''").select("doc_id", F.sha2("sig", 256).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("SELECT min(p_partkey) AS p_partkey FROM part GROUP BY lower(p_brand), lower(p_type)")
def dedup_lower(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return first_of(part, signature([F.col("p_brand"), F.col("p_type")], lower=True), [F.col("p_partkey")], drop_empty=False).select("p_partkey")


@query("SELECT min(l_orderkey) AS l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus")
def dedup_canonical(spark, sf_dir):
    columns = ["l_linenumber", "l_returnflag", "l_linestatus"]
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", *columns)
    return first_of(rows, canonical(columns), [F.col("l_orderkey")])


@query("SELECT p_brand, string_agg(p_name, '; ' ORDER BY k, p_name) AS names FROM (SELECT p_brand, p_name, min(p_partkey) AS k FROM part WHERE trim(p_name) <> '' GROUP BY p_brand, p_name) GROUP BY p_brand")
def dedup_ordered_text(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey").where(F.trim("p_name") != "")
    firsts = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("k"))
    items = F.array_sort(F.collect_list(F.struct("k", "p_name")))
    return firsts.groupBy("p_brand").agg(F.array_join(F.transform(items, lambda x: x["p_name"]), "; ").alias("names"))


@query("SELECT conv_id, string_agg(n || '. ' || role || ' (' || length(text) || ')', '; ' ORDER BY n) AS detail FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY conv_id")
def detail_text_synthesis(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    say = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["role"], F.lit(" ("), F.length(x["text"]).cast("string"), F.lit(")")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(say, "; ").alias("detail"))


@query("SELECT CASE WHEN quality IS NOT NULL THEN 'reviewed' WHEN text IS NOT NULL AND lang = 'en' THEN 'stage1+stage2' ELSE 'stage1_only' END AS data_source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def data_authority_overlay(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    rows = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    spoken = overlay(F.col("quality"), F.col("text"), F.when(F.col("lang") == "en", 1))
    return rows.groupBy(spoken.alias("data_source")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT vec_id, round(list_sum([CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) for x in embedding]) / 10000.0, 4) AS total FROM embeddings")
def recursive_number_sum(spark, sf_dir):
    parts = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x) / 10000.0, 4).alias("total"))


@query("SELECT l_orderkey, string_agg(key, ',' ORDER BY flag, k) AS keys FROM (SELECT l_orderkey, key, CASE WHEN regexp_matches(key, '^[0-9]+$') THEN 0 ELSE 1 END AS flag, CASE WHEN regexp_matches(key, '^[0-9]+$') THEN lpad(key, 4, '0') ELSE lower(key) END AS k FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE CAST(l_linenumber AS VARCHAR) END AS key FROM lineitem)) GROUP BY l_orderkey")
def stat_sort_mixed(spark, sf_dir):
    """Numbers before text."""
    key = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_linenumber").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", key.alias("key"))
    ranked = F.transform(F.collect_set("key"), lambda k: F.struct(F.when(k.rlike(r"^\d+$"), 0).otherwise(1), F.when(k.rlike(r"^\d+$"), F.lpad(k, 4, "0")).otherwise(F.lower(k)), k.alias("key")))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(ranked), lambda x: x["key"]), ",").alias("keys"))


@query("SELECT conv_id, turn, role, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_status FROM conversations")
def status_backfill(spark, sf_dir):
    """A blank status takes the next one that isn't."""
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, Window.unboundedFollowing)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.first(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(ahead).alias("next_status"))
