"""Queries of sources, filters, parsing, joins, and the embedding."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.quota import evidence
from vectide.operators import embed as E
from vectide.operators import moments as M
from vectide.operators import qc as C
from vectide.operators import sparse as X
from vectide.plans.base import CELLS, D, EVIDENCE, KEYS, ORACLES, THETA, WITHIN, cells, flat, group_moments, judged, ks, q6, q6s, query, r6, sql_moments, standard, table, with_, work_path, written
from vectide.plans.core import CONTROLS, MATCHED, matched, plate_controls, rounded
from vectide.sources import ingest as I
from vectide.streaming import moments as T

Spark, Frame = SparkSession, DataFrame


@query("SELECT label, k - 1 AS gene, count(*) AS n, round(sum(v), 4) + 0.0 AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k")
def s01_scan_list_counts(spark: Spark, sf: str) -> Frame:
    df = I.scan_list_counts(spark, f"{sf}/embeddings.parquet", ["label", "embedding"])
    long = df.select("label", F.posexplode("embedding").alias("gene", "v"))
    return long.groupBy("label", F.col("gene").cast("long").alias("gene")).agg(F.count("*").alias("n"), (F.round(F.sum(F.col("v").cast("double")), 4) + 0.0).alias("s"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS cell, count(DISTINCT CAST(l_partkey AS INT)) AS genes, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def s02_scan_coo_counts(spark: Spark, sf: str) -> Frame:
    df = I.scan_coo_counts(spark, f"{sf}/lineitem.parquet", "l_orderkey", "l_partkey", "l_quantity")
    return df.groupBy("cell").agg(F.count_distinct("gene").alias("genes"), F.sum("value").alias("total"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def s03_scan_dimensions(spark: Spark, sf: str) -> Frame:
    return I.scan_dimension(spark, f"{sf}/part.parquet", "p_partkey", ["p_brand", "p_type"]).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query(with_(CELLS, sql_moments("brand, line, plate")) + f"SELECT brand, line, plate, n, {ks('round(b#, 4) + 0.0 AS s2_#')} FROM mom")
def s04_moments_table(spark: Spark, sf: str) -> Frame:
    path = work_path(spark, "moments")
    I.write_moments(group_moments(spark, sf, ["brand", "line", "plate"]), path)
    return I.read_moments(spark, path).select("brand", "line", "plate", "n", *[(F.round(F.col("s2")[k], 4) + 0.0).alias(f"s2_{k + 1}") for k in range(D)])


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def s05_json_values(spark: Spark, sf: str) -> Frame:
    ev = table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return ev.groupBy("event_type").agg(F.sum("p.k").alias("k"))


@query(with_(CELLS, sql_moments(), WITHIN) + f"SELECT {q6('(' + ks('e#', ' + ') + ') / 4', 'sigma2')}, {ks('round(e#, 6) + 0.0 AS ell_#')} FROM within_")
def s05_read_calibration(spark: Spark, sf: str) -> Frame:
    path = work_path(spark, "calibration")
    M.within_variance(group_moments(spark, sf), D).coalesce(1).write.json(path)
    return I.read_calibration(spark, path).select(r6("sigma2", "sigma2"), *flat("ell"))


SHARDS = "ids AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem)), k AS (SELECT count(*) AS n FROM ids), one AS (SELECT DISTINCT CAST(least(round_even(j * (n - 1) / 6.0, 0), n - 1) AS BIGINT) AS i FROM k, range(7) t(j))"


@query(with_(SHARDS) + "SELECT l_suppkey, count(*) AS n FROM lineitem JOIN ids ON s = l_suppkey SEMI JOIN one USING (i) GROUP BY 1")
def s06_systematic_sample(spark: Spark, sf: str) -> Frame:
    return I.systematic_sample(table(spark, sf, "lineitem"), "l_suppkey", 7).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(
    with_(
        SHARDS,
        "two AS (SELECT DISTINCT CAST(least(round_even((j + 0.5) * (n - 1) / 6.0, 0), n - 1) AS BIGINT) AS i FROM k, range(7) t(j))",
        "sel AS (SELECT i FROM two WHERE i NOT IN (SELECT i FROM one))",
        "top AS (SELECT i FROM ids WHERE i NOT IN (SELECT i FROM one) AND i NOT IN (SELECT i FROM sel) ORDER BY i LIMIT (SELECT greatest(least(7, n - (SELECT count(*) FROM one)) - (SELECT count(*) FROM sel), 0) FROM k))",
        "both_ AS (SELECT i FROM sel UNION ALL SELECT i FROM top)",
    )
    + "SELECT l_suppkey, count(*) AS n FROM lineitem JOIN ids ON s = l_suppkey WHERE i IN (SELECT i FROM both_) GROUP BY 1"
)
def s07_disjoint_sample(spark: Spark, sf: str) -> Frame:
    return I.disjoint_sample(table(spark, sf, "lineitem"), "l_suppkey", 7).groupBy("l_suppkey").agg(F.count("*").alias("n"))


def line_shards(spark: Spark, sf: str) -> str:
    """The line items in a folder for each supplier."""
    path = work_path(spark, "shards")
    table(spark, sf, "lineitem").repartition("l_suppkey").write.partitionBy("l_suppkey").parquet(path)
    return path


@query(ORACLES["s06_systematic_sample"])
def s06_shard_files(spark: Spark, sf: str) -> Frame:
    """The same sample by file: shards outside it are listed, but never opened."""
    return I.sampled_shards(spark, line_shards(spark, sf), "l_suppkey", 7).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(ORACLES["s07_disjoint_sample"])
def s07_disjoint_files(spark: Spark, sf: str) -> Frame:
    return I.sampled_shards(spark, line_shards(spark, sf), "l_suppkey", 7, second=True).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey < 5000 GROUP BY 1")
def s08_head_block(spark: Spark, sf: str) -> Frame:
    return I.head_block(table(spark, sf, "orders"), "o_orderkey", 5000).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(EVIDENCE + f"SELECT cond_id, {q6s('m_raw', 'm_corr')}, n_t, n_c, {q6('CASE WHEN n_star = CAST(' + chr(39) + 'Infinity' + chr(39) + ' AS DOUBLE) THEN -1 ELSE n_star END', 'n_star')}, regime FROM ev")
def s09_write_condition_table(spark: Spark, sf: str) -> Frame:
    path = work_path(spark, "conditions")
    I.write_condition_table(judged(spark, sf), path, "csv")
    out = spark.read.csv(path, header=True, schema="cond_id string, m_raw double, m_corr double, n_t double, n_c double, n_star double, regime string")
    return out.select("cond_id", r6("m_raw", "m_raw"), r6("m_corr", "m_corr"), "n_t", "n_c", r6("n_star", "n_star"), "regime")


@query(EVIDENCE + "SELECT concat('| ', regime, ' | ', printf('%.1f', count(*)::DOUBLE), ' |') AS line FROM ev GROUP BY regime")
def s10_write_report(spark: Spark, sf: str) -> Frame:
    path = work_path(spark, "report")
    I.write_report(judged(spark, sf).groupBy("regime").agg(F.count("*").alias("n")), path, "regime", ["n"])
    return spark.read.text(f"{path}/markdown").select(F.col("value").alias("line"))


STREAM = "SELECT event_type AS cond, user_id % 5 AS line, count(*) AS n, round(sum(value), 4) + 0.0 AS s1_1, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 4) + 0.0 AS s1_2, round(sum(value * value), 3) + 0.0 AS s2_1 FROM events GROUP BY ALL"


@query(STREAM)
def s11_incremental_moments(spark: Spark, sf: str) -> Frame:
    """Partial moments of each batch of files, folded into one table."""
    path, keys = work_path(spark, "stream"), ["cond", "line"]
    stream = T.shard_stream(spark, f"{sf}/events*.parquet", T.EVENTS)
    T.merge_batches(T.event_rows(stream), keys, 2, path, f"{path}/checkpoint").awaitTermination()
    T.fold(spark, path, keys, 2)
    m = T.merged(spark, path, keys, 2)
    return m.select("cond", "line", "n", *[(F.round(F.col("s1")[k], 4) + 0.0).alias(f"s1_{k + 1}") for k in range(2)], (F.round(F.col("s2")[0], 3) + 0.0).alias("s2_1"))


@query("SELECT 'ids are not contiguous' AS rule, CAST(count(*) AS DOUBLE) AS value FROM lineitem HAVING count(*) <> count(DISTINCT l_orderkey) UNION ALL SELECT 'row count differs', CAST(0 AS DOUBLE) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def s12_assert_integrity(spark: Spark, sf: str) -> Frame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders")
    counted = customers.join(orders.groupBy("o_custkey").agg(F.count("*").alias("n_t")), "o_custkey", "left").withColumn("n_t", F.coalesce("n_t", F.lit(-1)))
    return C.contiguous_ids(table(spark, sf, "lineitem"), "l_orderkey").unionByName(C.counts_agree(orders, counted, ["o_custkey"]))


@query("SELECT l_orderkey AS cell, count(*) AS n FROM lineitem WHERE l_partkey >= 3 GROUP BY 1")
def q01_drop_special_tokens(spark: Spark, sf: str) -> Frame:
    return C.drop_special_tokens(table(spark, sf, "lineitem"), "l_partkey").groupBy(F.col("l_orderkey").alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT d.source, count(*) AS pre, CAST(count_if(quality = 1) AS BIGINT) AS post FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def q02_pass_filter(spark: Spark, sf: str) -> Frame:
    met = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    post = C.pass_filter(met, F.col("quality") == 1).groupBy("source").agg(F.count("*").alias("post"))
    return met.groupBy("source").agg(F.count("*").alias("pre")).join(post, "source", "left").select("source", "pre", F.coalesce("post", F.lit(0)).cast("long").alias("post"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 0.5 * (SELECT quantile_cont(n_chars, 0.5) FROM documents)")
def q03_low_depth_filter(spark: Spark, sf: str) -> Frame:
    return C.low_depth_filter(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 0.5)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount * 100 / 100.0 * l_quantity <= 1.5 GROUP BY 1")
def q04_high_mito_filter(spark: Spark, sf: str) -> Frame:
    df = table(spark, sf, "lineitem").withColumn("pct", F.col("l_discount") * 100)
    return C.high_mito_filter(df, "l_quantity", "pct", 1.5).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 OR split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2)")
def q05_guide_concordance_filter(spark: Spark, sf: str) -> Frame:
    words = F.split("p_name", " ")
    guide = F.when(F.col("p_partkey") % 3 == 0, F.concat(words[0], F.lit("_1|"), words[1], F.lit("_2"))).otherwise(F.concat(words[0], F.lit("_1; nan")))
    df = table(spark, sf, "part").withColumn("guide", guide)
    return C.guide_concordance_filter(df, "guide").select("p_partkey")


@query("SELECT gene, round(avg(umi), 6) AS umi, round(avg(mito), 6) AS mito FROM (SELECT l_returnflag AS gene, l_quantity AS umi, l_discount AS mito FROM lineitem) GROUP BY 1")
def q06_resolve_columns(spark: Spark, sf: str) -> Frame:
    raw = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("Gene"), F.col("l_quantity").alias("UMI_count"), F.col("l_discount").alias("mitopercent"))
    return C.resolve_columns(raw).groupBy("gene").agg(F.round(F.avg("umi"), 6).alias("umi"), F.round(F.avg("mito"), 6).alias("mito"))


@query("SELECT round(avg(CASE WHEN l_quantity >= 10 THEN 1.0 ELSE 0 END), 6) AS depth, round(avg(CASE WHEN l_discount <= 0.05 THEN 1.0 ELSE 0 END), 6) AS mito, round(avg(CASE WHEN l_quantity >= 10 AND l_discount <= 0.05 THEN 1.0 ELSE 0 END), 6) AS all_rules, count(*) AS n FROM lineitem")
def q07_qc_report(spark: Spark, sf: str) -> Frame:
    return rounded(C.qc_report(table(spark, sf, "lineitem"), {"depth": F.col("l_quantity") >= 10, "mito": F.col("l_discount") <= 0.05}))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 100")
def q08_min_rows_filter(spark: Spark, sf: str) -> Frame:
    return C.min_rows_filter(table(spark, sf, "lineitem").select("l_suppkey"), ["l_suppkey"], 100).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(with_(CELLS, sql_moments("brand")) + "SELECT brand, n FROM mom WHERE brand <> 'Brand#1' AND n >= 25")
def q09_scored_condition_filter(spark: Spark, sf: str) -> Frame:
    return C.scored_condition_filter(group_moments(spark, sf, ["brand"]), "brand", "Brand#1").select("brand", "n")


@query("SELECT c_mktsegment AS label, count(*) AS n FROM customer WHERE regexp_matches(c_mktsegment, '(?i)^(auto|furn)') GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def q10_detect_control_label(spark: Spark, sf: str) -> Frame:
    m = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    best = C.detect_control_label(m, "label", "(?i)^(auto|furn)")
    return m.where(F.col("label") == best)


@query("SELECT p_partkey, label FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ' Unclear' WHEN p_partkey % 4 = 1 THEN NULL ELSE p_type END AS label FROM part) WHERE label IS NOT NULL AND lower(trim(label)) NOT IN ('unclear', 'none', '')")
def q11_usable_label_predicate(spark: Spark, sf: str) -> Frame:
    k = F.col("p_partkey") % 4
    df = table(spark, sf, "part").select("p_partkey", F.when(k == 0, " Unclear").when(k == 1, None).otherwise(F.col("p_type")).alias("label"))
    return df.where(C.usable_label("label"))


@query("SELECT concat_ws('|', p_name, p_brand, p_type) AS key, concat_ws('|', p_name, p_brand) AS sample, p_type AS line FROM part")
def p01_split_key(spark: Spark, sf: str) -> Frame:
    df = table(spark, sf, "part").withColumn("sample", F.concat_ws("|", "p_name", "p_brand")).select(I.compose_key("sample", "p_type").alias("key"))
    sample, line = I.split_key("key")
    return df.select("key", sample.alias("sample"), line.alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS dose, CASE WHEN p_size % 5 = 0 THEN '?' ELSE p_brand END AS drug FROM part")
def p02_parse_dose(spark: Spark, sf: str) -> Frame:
    literal = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("[('"), F.col("p_brand"), F.lit("', "), (F.col("p_size") / 2).cast("string"), F.lit(", 'uM')]")))
    df = table(spark, sf, "part").withColumn("literal", literal)
    dose = I.parse_dose("literal")
    return df.select("p_partkey", F.when(~F.isnan(dose), dose).alias("dose"), I.parse_drug("literal").alias("drug"))


@query("SELECT l_suppkey, min_by(l_shipmode, l_orderkey * 100 + l_linenumber) AS first_flag FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(CASE WHEN l_quantity > 5 THEN l_returnflag END) AS l_shipmode FROM lineitem GROUP BY ALL) WHERE l_shipmode IS NOT NULL GROUP BY 1")
def p03_first_seen_attribute(spark: Spark, sf: str) -> Frame:
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min(F.when(F.col("l_quantity") > 5, F.col("l_returnflag"))).alias("first_flag"))
    return C.first_seen(li.withColumn("at", F.col("l_orderkey") * 100 + F.col("l_linenumber")), ["l_suppkey"], "first_flag", "at")


def word_counts(spark: Spark, sf: str) -> Frame:
    docs = table(spark, sf, "documents")
    words = docs.select(F.col("doc_id").alias("cell"), F.explode(F.split("text", "[ \\n]+")).alias("gene")).where("gene <> ''")
    return words.groupBy("cell", "gene").agg(F.count("*").alias("value"))


WORDS = "wc AS (SELECT doc_id AS cell, gene, count(*) AS value FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS gene FROM documents) WHERE gene <> '' GROUP BY ALL), tot AS (SELECT cell, CASE WHEN sum(value) = 0 THEN 1 ELSE sum(value) END AS total FROM wc GROUP BY 1)"
FEATURES = "feat AS (SELECT gene FROM (SELECT gene, sum(value) AS s FROM wc GROUP BY 1) ORDER BY s DESC, gene LIMIT 200)"


def top_words(counts: Frame, n: int = 200) -> Frame:
    return counts.groupBy("gene").agg(F.sum("value").alias("s")).orderBy(F.desc("s"), "gene").limit(n).select("gene")


def word_lists(spark: Spark, sf: str, where: str = "true") -> Frame:
    """Documents as cells whose list column holds their words."""
    split = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    return table(spark, sf, "documents").where(where).select("doc_id", "source", "lang", split.alias("words"))


def list_features(lists: Frame, n: int = 200) -> Frame:
    """The words that are met most often."""
    return top_words(X.sum_by_gene(lists, [], "words").select("gene", F.col("s1").alias("value")), n)


@query(with_(WORDS) + "SELECT cell, CAST(total AS BIGINT) AS total FROM tot")
def p04_total_counts(spark: Spark, sf: str) -> Frame:
    return E.total_counts(word_counts(spark, sf))


@query(with_(WORDS) + "SELECT gene, round(sum(ln(1 + value * 10000.0 / total)), 4) AS s FROM wc JOIN tot USING (cell) GROUP BY 1")
def p05_normalize_log1p(spark: Spark, sf: str) -> Frame:
    return E.normalize_log1p(word_counts(spark, sf)).groupBy("gene").agg(F.round(F.sum("log"), 4).alias("s"))


@query(with_(WORDS, FEATURES) + "SELECT cell, count(*) AS genes, CAST(sum(value) AS BIGINT) AS kept FROM wc WHERE gene IN (SELECT gene FROM feat) GROUP BY 1")
def p06_restrict_to_features(spark: Spark, sf: str) -> Frame:
    counts = word_counts(spark, sf)
    return E.restrict_to_features(counts, top_words(counts)).groupBy("cell").agg(F.count("*").alias("genes"), F.sum("value").alias("kept"))


#: a stated basis of five components on the features, so that projection has an exact answer
BASIS = "bas AS (SELECT gene, pc, (ascii(gene) % 7 - 3) * 0.1 * (pc + 1) AS w FROM feat CROSS JOIN range(5) t(pc)), mu AS (SELECT gene, ln(1 + length(gene)) AS mu FROM feat), ofs AS (SELECT pc, sum(w * mu) AS o FROM bas JOIN mu USING (gene) GROUP BY 1)"


def stated_basis(features: Frame) -> tuple[Frame, Frame]:
    pcs = features.withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return pcs.select("gene", "pc", ((F.ascii("gene") % 7 - 3) * F.lit(0.1) * (F.col("pc") + 1)).alias("w")), features.select("gene", F.log1p(F.length("gene")).alias("mu"))


@query(with_(WORDS, FEATURES, BASIS) + "SELECT cell, CAST(pc AS INT) AS pc, round(coalesce(y, 0) - o, 5) + 0.0 AS x FROM (SELECT DISTINCT cell FROM wc) c CROSS JOIN ofs LEFT JOIN (SELECT cell, pc, sum(ln(1 + value * 10000.0 / total) * w) AS y FROM wc JOIN tot USING (cell) JOIN bas USING (gene) GROUP BY ALL) h USING (cell, pc)")
def p07_project_cells(spark: Spark, sf: str) -> Frame:
    lists = word_lists(spark, sf).where(F.size("words") > 0)
    # the features are written once; loadings and means come from that table
    loadings, means = stated_basis(written(list_features(lists)))
    x = E.project_lists(lists, "doc_id", "words", None, loadings, means)
    return x.select("cell", F.posexplode("x").alias("pc", "x")).select("cell", "pc", (F.round("x", 5) + 0.0).alias("x"))


@query(with_(WORDS, FEATURES, BASIS, "cl AS (SELECT doc_id AS cell, source FROM documents)", "n AS (SELECT source, count(*) AS n FROM cl GROUP BY 1)") + "SELECT source, CAST(pc AS INT) AS pc, round(coalesce(y, 0) / n - o, 5) + 0.0 AS mu FROM n CROSS JOIN ofs LEFT JOIN (SELECT source, pc, sum(ln(1 + value * 10000.0 / total) * w) AS y FROM wc JOIN tot USING (cell) JOIN bas USING (gene) JOIN cl USING (cell) GROUP BY ALL) h USING (source, pc)")
def p08_project_centroids(spark: Spark, sf: str) -> Frame:
    counts = word_counts(spark, sf)
    loadings, means = stated_basis(top_words(counts))
    bulk, n = E.pseudobulk(E.normalize_log1p(counts), doc_cells(spark, sf), "source")
    return E.project_centroids(bulk, n, "source", loadings, means).select("source", "pc", (F.round("mu", 5) + 0.0).alias("mu"))


def doc_cells(spark: Spark, sf: str) -> Frame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("cell"), "source", "lang")


@query(with_(WORDS, FEATURES, "cl AS (SELECT doc_id AS cell, lang FROM documents)", "n AS (SELECT lang, count(*) AS n FROM cl GROUP BY 1)") + "SELECT lang, gene, round(sum(ln(1 + value * 10000.0 / total)), 4) AS s, any_value(n) AS n FROM wc JOIN tot USING (cell) JOIN cl USING (cell) JOIN n USING (lang) WHERE gene IN (SELECT gene FROM feat) GROUP BY lang, gene")
def a01_pseudobulk(spark: Spark, sf: str) -> Frame:
    lists = word_lists(spark, sf)
    bulk = X.sum_by_gene(lists, ["lang"], "words", features=list_features(lists), form="log")
    n = lists.groupBy("lang").agg(F.count_distinct("doc_id").alias("n"))
    return bulk.select("lang", "gene", F.round("s1", 4).alias("s")).join(n, "lang")


HVG = with_(
    WORDS,
    "st AS (SELECT gene, sum(x) / n AS mean, (sum(x * x) - power(sum(x) / n, 2) * n) / (n - 1) AS var FROM (SELECT gene, value * 10000.0 / total AS x FROM wc JOIN tot USING (cell)) CROSS JOIN (SELECT count(*) AS n FROM documents) GROUP BY gene, n)",
    "g AS (SELECT gene, ln(1 + mean) AS lm, ln(var / mean) AS disp FROM st WHERE mean > 0 AND var > 0)",
    "b AS (SELECT *, CAST(least(floor((lm - lo) / (hi - lo) * 20), 19) AS INT) AS bin FROM g CROSS JOIN (SELECT min(lm) AS lo, max(lm) AS hi FROM g))",
    "p AS (SELECT bin, avg(disp) AS m, stddev_samp(disp) AS sd, count(*) AS k FROM b GROUP BY 1)",
    "z AS (SELECT gene, CASE WHEN k = 1 THEN 1.0 WHEN sd > 0 THEN (disp - m) / sd ELSE 0 END AS score FROM b JOIN p USING (bin))",
)


def word_stats(spark: Spark, sf: str, where: str = "true") -> Frame:
    """Statistics of un-logged normalised values over the documents that fit."""
    kept = table(spark, sf, "documents").where(where).select(F.col("doc_id").alias("cell"))
    counts = word_counts(spark, sf).join(kept, "cell", "left_semi")
    normal = counts.join(E.total_counts(counts), "cell").select("gene", (F.col("value") * 10000.0 / F.col("total")).alias("x"))
    return E.gene_stats(normal, kept.count())


@query(HVG + "SELECT gene, round(score, 5) + 0.0 AS score FROM z ORDER BY round(z.score, 9) DESC, gene LIMIT 200")
def f1_select_hvg(spark: Spark, sf: str) -> Frame:
    return E.select_hvg(X.stats_by_gene(word_lists(spark, sf), "words"), 200).select("gene", (F.round("score", 5) + 0.0).alias("score"))


@query(with_(WORDS, FEATURES) + "SELECT gene, CAST(sum(value) AS BIGINT) AS s FROM wc SEMI JOIN feat USING (gene) GROUP BY 1")
def f2_frozen_features(spark: Spark, sf: str) -> Frame:
    lists = word_lists(spark, sf)
    return X.sum_by_gene(lists, [], "words", features=list_features(lists)).select("gene", F.col("s1").cast("long").alias("s"))


def vectors(spark: Spark, sf: str, where: str = "true") -> Frame:
    return table(spark, sf, "embeddings").where(where).select(F.col("vec_id").cast("string").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


WIDE = "feat AS (SELECT gene FROM (SELECT gene, sum(value) AS s FROM wc GROUP BY 1) ORDER BY s DESC, gene LIMIT 2000), n AS (SELECT count(DISTINCT cell) AS n FROM wc)"


@query(with_(WORDS, WIDE) + "SELECT (SELECT count(*) FROM feat) AS features, n AS cells, CAST(50 AS BIGINT) AS components, round(sum(v), 5) AS total, CAST(0 AS DOUBLE) AS worst, CAST(0 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS skew FROM (SELECT gene, (sum(l * l) - sum(l) * sum(l) / any_value(n)) / (any_value(n) - 1) AS v FROM (SELECT gene, ln(1 + value * 10000.0 / total) AS l FROM wc SEMI JOIN feat USING (gene) JOIN tot USING (cell)) CROSS JOIN n GROUP BY gene) CROSS JOIN n GROUP BY n")
def f3_sparse_pca(spark: Spark, sf: str) -> Frame:
    """Fifty components of 2000 features from list columns: each is an eigenvector, by another pass over the cells, and all are orthonormal."""
    cells = word_lists(spark, sf).where(F.size("words") > 0)
    names = X.names_of(list_features(cells, 2000))
    logs = written(X.feature_logs(cells, "words", None, names))
    loadings, _, info = X.fit_pca(logs, names, 50)
    w = loadings.toPandas().pivot(index="gene", columns="pc", values="w").loc[names.to_pylist()].to_numpy()
    found = info.toPandas()
    turned, _, spread, n = X.covariance_times(logs, w)
    worst = float(abs(turned - w * found["var"].to_numpy()).max())
    skew = float(abs(w.T @ w - np.eye(w.shape[1])).max())
    row = (len(names), n, w.shape[1], round(float(spread.sum()), 5), round(worst, 6) + 0.0, round(float(found.residual.max()), 6) + 0.0, round(skew, 6) + 0.0)
    return spark.createDataFrame([row], "features long, cells long, components long, total double, worst double, residual double, skew double")


@query()
def f3_fit_pca(spark: Spark, sf: str) -> Frame:
    loadings, _, info = E.fit_pca(vectors(spark, sf), 64, 10)
    return info.join(loadings.groupBy("pc").agg(F.max("w").alias("top_loading")), "pc").select("pc", r6("var", "var"), r6("evr", "evr"), r6("top_loading", "top_loading"))


@query("WITH w AS (SELECT lang, gene, count(*) AS k FROM (SELECT lang, unnest(regexp_split_to_array(text, '[ \\n]+')) AS gene FROM documents) WHERE gene <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, gene) AS r FROM w) SELECT count(*) AS shared FROM (SELECT gene FROM r WHERE lang = 'fr' AND r <= 200 INTERSECT SELECT gene FROM r WHERE lang = 'es' AND r <= 200)")
def f4_hvg_overlap(spark: Spark, sf: str) -> Frame:
    counts = word_counts(spark, sf).join(doc_cells(spark, sf), "cell")
    return E.hvg_overlap(top_words(counts.where("lang = 'fr'")), top_words(counts.where("lang = 'es'")))


def two_bases(spark: Spark, sf: str) -> tuple[Frame, Frame]:
    return E.fit_pca(vectors(spark, sf, "vec_id % 2 = 0"), 64, 8)[0], E.fit_pca(vectors(spark, sf, "vec_id % 2 = 1"), 64, 8)[0]


@query()
def f5_subspace_overlap(spark: Spark, sf: str) -> Frame:
    return E.subspace_overlap(*two_bases(spark, sf), 8).select(r6("overlap", "overlap"))


@query()
def f6_principal_angles(spark: Spark, sf: str) -> Frame:
    return rounded(E.angle_summary(E.principal_angles(*two_bases(spark, sf))))


#: two stated pairs of directions over the embedding's entries, so that overlaps and angles have exact answers
PAIR = "pa AS (SELECT g AS gene, pc, cos(pi() * (g + 0.5) * (pc + 1) / 64) * sqrt(2.0 / 64) AS w FROM range(64) a(g), range(2) b(pc)), pb AS (SELECT gene, pc, w * 0.8 + 0.6 * cos(pi() * (gene + 0.5) * (pc + 5) / 64) * sqrt(2.0 / 64) AS w FROM pa), emb AS (SELECT avg(embedding[1]) AS tilt FROM embeddings), pt AS (SELECT gene, pc, w * (1 + tilt * gene / 64) AS w FROM pb CROSS JOIN emb), cr AS (SELECT a.pc AS pc_a, b.pc AS pc_b, sum(a.w * b.w) AS c FROM pa a JOIN pt b USING (gene) GROUP BY ALL)"


def stated_pair(spark: Spark, sf: str) -> tuple[Frame, Frame]:
    """Cosines, and cosines turned and tilted by what the embeddings hold."""
    wave = lambda k: F.cos(F.lit(math.pi) * (F.col("gene") + 0.5) * (F.col("pc") + k) / 64) * math.sqrt(2 / 64)
    grid = spark.range(64).select(F.col("id").alias("gene"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pc"))
    a = grid.withColumn("w", wave(1))
    tilt = table(spark, sf, "embeddings").agg(F.avg(F.col("embedding")[0].cast("double")).alias("tilt"))
    b = grid.crossJoin(F.broadcast(tilt)).select("gene", "pc", ((wave(1) * 0.8 + wave(5) * 0.6) * (F.lit(1.0) + F.col("tilt") * F.col("gene") / 64)).alias("w"))
    return a, b


@query(with_(PAIR) + f"SELECT {q6('sum(c * c) / 2', 'overlap')} FROM cr")
def f5_stated_overlap(spark: Spark, sf: str) -> Frame:
    return E.subspace_overlap(*stated_pair(spark, sf), 2).select(r6("overlap", "overlap"))


@query(with_(PAIR) + f"SELECT CAST(pc_a AS INT) AS pc_a, CAST(pc_b AS INT) AS pc_b, {q6s('c')} FROM cr")
def j10_stated_overlap_join(spark: Spark, sf: str) -> Frame:
    return E.cross_products(*stated_pair(spark, sf)).select("pc_a", "pc_b", r6("c", "c"))


@query(with_(PAIR, "m AS (SELECT sum(CASE WHEN pc_a = 0 AND pc_b = 0 THEN c END) AS a, sum(CASE WHEN pc_a = 0 AND pc_b = 1 THEN c END) AS b, sum(CASE WHEN pc_a = 1 AND pc_b = 0 THEN c END) AS c, sum(CASE WHEN pc_a = 1 AND pc_b = 1 THEN c END) AS d FROM cr)", "q AS (SELECT (a * a + b * b + c * c + d * d) / 2 AS s, sqrt(greatest(power((a * a + b * b + c * c + d * d) / 2, 2) - power(a * d - b * c, 2), 0)) AS t FROM m)") + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS i, round(degrees(acos(least(1, sqrt(greatest(s {sign} t, 0))))), 4) AS angle FROM q" for i, sign in ((0, "+"), (1, "-"))))
def f6_stated_angles(spark: Spark, sf: str) -> Frame:
    return E.principal_angles(*stated_pair(spark, sf)).select("i", F.round("angle", 4).alias("angle"))


@query(with_(PAIR, "ww AS (SELECT a.pc AS pc_a, b.pc AS pc_b, sum(a.w * b.w) AS c FROM pt a JOIN pt b USING (gene) GROUP BY ALL)") + f"SELECT {q6('max(abs(c - CASE WHEN pc_a = pc_b THEN 1 ELSE 0 END))', 'residual')} FROM ww")
def f7_stated_residual(spark: Spark, sf: str) -> Frame:
    return E.orthonormality_residual(stated_pair(spark, sf)[1]).select(r6("residual", "residual"))


EMBEDDED = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query(with_(EMBEDDED, "c AS (SELECT a.i AS i, b.i AS j, covar_samp(a.v, b.v) AS c FROM e a JOIN e b USING (vec_id) GROUP BY ALL)") + "SELECT CAST(64 AS BIGINT) AS components, round(sum(CASE WHEN i = j THEN c END), 6) AS total, round(sum(c * c), 6) AS squares, CAST(1 AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS worst FROM c")
def f3_pca_spectrum(spark: Spark, sf: str) -> Frame:
    """All components: their variances add up to the trace, their squares to that of the covariance, and each is an eigenvector."""
    x = vectors(spark, sf)
    loadings, _, info = E.fit_pca(x, 64, 64)
    cov = M.group_covariance(x.withColumn("one", F.lit(1)), ["one"], 64).select("i", "j", "value")
    full = cov.unionByName(cov.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    turned = full.join(loadings.select(F.col("gene").cast("int").alias("j"), "pc", "w"), "j").groupBy("i", "pc").agg(F.sum(F.col("value") * F.col("w")).alias("cw"))
    met = turned.join(loadings.select(F.col("gene").cast("int").alias("i"), "pc", "w"), ["i", "pc"]).join(info, "pc")
    worst = met.agg(F.max(F.abs(F.col("cw") - F.col("var") * F.col("w"))).alias("worst"))
    sums = info.agg(F.count("*").alias("components"), F.round(F.sum("var"), 6).alias("total"), F.round(F.sum(F.col("var") * F.col("var")), 6).alias("squares"), F.round(F.sum("evr"), 6).alias("shares"))
    return sums.crossJoin(worst.select(r6("worst", "worst")))


@query(with_(EMBEDDED, "m AS (SELECT label, i, avg(v) AS mu, count(*) AS n FROM e GROUP BY ALL)", "r AS (SELECT vec_id, i, v - mu AS v FROM e JOIN m USING (label, i))", "d AS (SELECT count(DISTINCT vec_id) - count(DISTINCT label) AS dof FROM embeddings)") + "SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.v * b.v) / any_value(dof), 5) + 0.0 AS value FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.i <= b.i CROSS JOIN d GROUP BY a.i, b.i")
def a11_within_covariance_embeddings(spark: Spark, sf: str) -> Frame:
    return M.within_covariance(vectors(spark, sf), ["label"], 64).select("i", "j", (F.round("value", 5) + 0.0).alias("value"))


@query(with_(EMBEDDED) + "SELECT a.label, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.v, b.v), 5) + 0.0 AS value FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.label, a.i, b.i")
def a12_group_covariance_embeddings(spark: Spark, sf: str) -> Frame:
    return M.group_covariance(vectors(spark, sf), ["label"], 64).select("label", "i", "j", (F.round("value", 5) + 0.0).alias("value"))


@query(
    with_(
        EMBEDDED,
        "mu AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL)",
        "r AS (SELECT vec_id, i, v - m AS v FROM e JOIN mu USING (label, i))",
        "n AS (SELECT count(DISTINCT vec_id) AS n FROM r)",
        "q AS (SELECT sum(s * s) AS q FROM (SELECT vec_id, sum(v * v) AS s FROM r GROUP BY vec_id))",
        "c AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / any_value(n) AS c FROM r a JOIN r b ON a.vec_id = b.vec_id CROSS JOIN n GROUP BY a.i, b.i)",
        "h AS (SELECT sum(CASE WHEN i = j THEN c END) / 64 AS mu, sum(c * c) AS sq FROM c)",
        "s AS (SELECT n, mu, greatest(least((q / n - sq) / n, sq - 64 * mu * mu), 0) / (sq - 64 * mu * mu) AS shrinkage FROM h CROSS JOIN n CROSS JOIN q)",
    )
    + "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, n, round(mu, 6) AS mu, round(shrinkage, 7) AS shrinkage, round(c * (1 - shrinkage) + CASE WHEN i = j THEN shrinkage * mu ELSE 0 END, 5) + 0.0 AS value FROM c CROSS JOIN s WHERE i <= j"
)
def a14_ledoit_wolf_embeddings(spark: Spark, sf: str) -> Frame:
    """The shrunk covariance inside labels at 64 entries."""
    shrunk = M.ledoit_wolf(vectors(spark, sf), ["label"], 64)
    flat_ = M.tidy_triangle(shrunk, 64, "cov")
    return flat_.select("i", "j", "n", F.round("mu", 6).alias("mu"), F.round("shrinkage", 7).alias("shrinkage"), (F.round("value", 5) + 0.0).alias("value"))


@query()
def f7_orthonormality_residual(spark: Spark, sf: str) -> Frame:
    return E.orthonormality_residual(E.fit_pca(vectors(spark, sf), 64, 8)[0]).select(r6("residual", "residual"))


def hvg_sql(name: str, where: str) -> str:
    """The best 200 words of the documents that fit, as a table."""
    own = HVG.removeprefix("WITH ")
    for t in ("wc", "tot", "st", "g", "b", "p", "z"):
        own = re.sub(rf"(?<![\w.]){t}(?= AS \(| JOIN | CROSS | GROUP | WHERE |\)|,\n)", f"{name}_{t}", own)
        own = re.sub(rf"(?<=FROM ){t}(?!\w)|(?<=JOIN ){t}(?!\w)", f"{name}_{t}", own)
    own = own.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {where})")
    return own.strip() + f",\n{name} AS (SELECT gene FROM {name}_z ORDER BY round(score, 9) DESC, gene LIMIT 200)"


def shared_sql(a: str, b: str, out: str) -> str:
    return f"(SELECT count(*) FROM {a} SEMI JOIN {b} USING (gene)) AS {out}"


@query("WITH " + ",\n".join(hvg_sql(n, w) for n, w in (("fr", "lang = 'fr'"), ("es", "lang = 'es'"), ("pool", "lang IN ('fr', 'es')"))) + f" SELECT {shared_sql('fr', 'es', 'shared_apart')}, {shared_sql('fr', 'pool', 'a_in_pool')}, {shared_sql('es', 'pool', 'b_in_pool')}")
def f8_consensus_pool_hvg(spark: Spark, sf: str) -> Frame:
    a, b = word_stats(spark, sf, "lang = 'fr'"), word_stats(spark, sf, "lang = 'es'")
    return E.consensus_pool_hvg(a, b, word_stats(spark, sf, "lang in ('fr', 'es')"), 200)


@query()
def f8_frozen_comparison(spark: Spark, sf: str) -> Frame:
    """Bases of French and Spanish documents on 200 features of their own, and on 200 of both together."""
    a, b = (word_lists(spark, sf, f"lang = '{lang}'") for lang in ("fr", "es"))
    return rounded(X.frozen_comparison(a, b, "words", None, written, 200, 10))


def stated_hvg(features: Frame, shift: int) -> Frame:
    """Two orthogonal directions over features by their rank: those of even and of odd ``(r + gene's length) // shift``."""
    at = ((F.col("r") + F.length("gene")) / shift).cast("int") % 2
    picked = features.select("gene", at.alias("pc"))
    size = picked.groupBy("pc").agg(F.count("*").alias("k"))
    return picked.join(F.broadcast(size), "pc").select("gene", "pc", (F.lit(1.0) / F.sqrt("k")).alias("w"))


def stated_hvg_sql(name: str, features: str, shift: int) -> str:
    return f"{name} AS (SELECT gene, pc, 1 / sqrt(count(*) OVER (PARTITION BY pc)) AS w FROM (SELECT gene, ((r + length(gene)) // {shift}) % 2 AS pc FROM {features}))"


def pair_sql(a: str, b: str, out: str) -> str:
    """The mean squared cosine and the largest angle of two stated bases."""
    entry = lambda i, j: f"coalesce(sum(CASE WHEN x.pc = {i} AND y.pc = {j} THEN x.w * y.w END), 0)"
    s, det = f"({' + '.join(f'power({entry(i, j)}, 2)' for i in (0, 1) for j in (0, 1))})", f"({entry(0, 0)} * {entry(1, 1)} - {entry(0, 1)} * {entry(1, 0)})"
    return f"{out} AS (SELECT {s} / 2 AS cos2, degrees(acos(least(1, sqrt(greatest(({s} - sqrt(greatest({s} * {s} - 4 * {det} * {det}, 0))) / 2, 0))))) AS angle FROM {a} x JOIN {b} y USING (gene))"


@query(
    "WITH " + ",\n".join(hvg_sql(n, w).replace("(SELECT gene FROM", "(SELECT gene, row_number() OVER (ORDER BY round(score, 9) DESC, gene) AS r FROM") for n, w in (("fr", "lang = 'fr'"), ("es", "lang = 'es'"), ("pool", "lang IN ('fr', 'es')")))
    + ",\n" + ",\n".join([stated_hvg_sql("la", "fr", 2), stated_hvg_sql("lb", "es", 3), stated_hvg_sql("fa", "pool", 2), stated_hvg_sql("fb", "pool", 3), pair_sql("la", "lb", "own"), pair_sql("fa", "fb", "frozen")])
    + f" SELECT {shared_sql('fr', 'es', 'shared')}, round(own.cos2, 6) AS own_cos2, round(own.angle, 4) AS own_angle, round(frozen.cos2, 6) AS frozen_cos2, round(frozen.angle, 4) AS frozen_angle FROM own CROSS JOIN frozen"
)
def f8_stated_comparison(spark: Spark, sf: str) -> Frame:
    """The same comparison with stated loadings on the chosen features, so that both overlaps have exact answers."""
    a, b, pool = (written(E.select_hvg(X.stats_by_gene(word_lists(spark, sf, w), "words"), 200)) for w in ("lang = 'fr'", "lang = 'es'", "lang in ('fr', 'es')"))
    own, frozen = X.overlap(stated_hvg(a, 2), stated_hvg(b, 3), 2), X.overlap(stated_hvg(pool, 2), stated_hvg(pool, 3), 2)
    shared = E.hvg_overlap(a, b).first().shared
    return spark.createDataFrame([(shared, round(own[0], 6), round(own[1], 4), round(frozen[0], 6), round(frozen[1], 4))], "shared long, own_cos2 double, own_angle double, frozen_cos2 double, frozen_angle double")


@query("SELECT p_brand AS drug, p_size AS dose, l_suppkey % 5 AS plate, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 10 <> 0 GROUP BY ALL")
def j01_sample_dimension(spark: Spark, sf: str) -> Frame:
    dim = I.scan_dimension(spark, f"{sf}/part.parquet", "p_partkey", ["p_brand", "p_size"]).where("p_partkey % 10 <> 0")
    met = table(spark, sf, "lineitem").join(dim, F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy(F.col("p_brand").alias("drug"), F.col("p_size").alias("dose"), (F.col("l_suppkey") % 5).alias("plate")).agg(F.count("*").alias("n"))


@query(with_(CELLS, sql_moments()) + f"SELECT t.brand, t.band, t.line, {ks('round(l.a# / l.n, 6) + 0.0 AS mu_c_#')}, CAST(l.n AS DOUBLE) AS n_c FROM mom t JOIN (SELECT line, sum(n) AS n, {ks('sum(a#) AS a#')} FROM mom GROUP BY line) l USING (line)")
def j02_condition_baseline(spark: Spark, sf: str) -> Frame:
    m = group_moments(spark, sf)
    return m.join(M.line_baseline(m, "line", D), "line").select(*KEYS, *flat("mu_c"), "n_c")


@query(MATCHED + "SELECT brand, band, line, n_t FROM met WHERE whole")
def j03_matched_control_join(spark: Spark, sf: str) -> Frame:
    return matched(spark, sf).select(*KEYS, "n_t")


@query(EVIDENCE + f"SELECT cond_id, n_c, {ks('round(c#, 6) + 0.0 AS mu_c_#')} FROM std")
def j04_control_broadcast(spark: Spark, sf: str) -> Frame:
    return standard(group_moments(spark, sf)).select("cond_id", "n_c", *flat("mu_c"))


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT l_orderkey) AS cells FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def j05_cell_metadata(spark: Spark, sf: str) -> Frame:
    met = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("cells"))


@query(with_(CELLS) + "SELECT brand, line, count(*) AS pre, CAST(count_if(x3 < 8) AS BIGINT) AS post FROM cells GROUP BY ALL")
def j06_pre_post_merge(spark: Spark, sf: str) -> Frame:
    return cells(spark, sf).groupBy("brand", "line").agg(F.count("*").alias("pre"), F.count_if(F.col("x")[2] < 8).alias("post"))


@query("SELECT p_partkey, coalesce(r_name, 'unclear') AS label FROM part LEFT JOIN nation ON n_nationkey = p_size LEFT JOIN region ON r_regionkey = n_regionkey")
def j07_mechanism_label(spark: Spark, sf: str) -> Frame:
    dim = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return table(spark, sf, "part").join(dim, F.col("p_size") == F.col("n_nationkey"), "left").select("p_partkey", F.coalesce("r_name", F.lit("unclear")).alias("label"))


@query("SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = s_nationkey")
def j08_line_name(spark: Spark, sf: str) -> Frame:
    half = table(spark, sf, "nation").where("n_nationkey % 2 = 0")
    dim = C.first_per_id(half.union(half), "n_nationkey", "n_name")
    return table(spark, sf, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("name"))


@query(with_(CELLS) + "SELECT brand, band, line, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) % 2 = 0")
def j09_condition_members(spark: Spark, sf: str) -> Frame:
    rows = cells(spark, sf)
    # an odd group is on record with one row too many, and is skipped
    on_record = rows.groupBy(*KEYS).agg((F.count("*") + F.count("*") % 2).alias("n_t"))
    met = rows.join(on_record, KEYS).groupBy(*KEYS, "n_t").agg(F.count("*").alias("n"))
    return met.where("n = n_t").select(*KEYS, "n")


@query()
def j10_basis_overlap_join(spark: Spark, sf: str) -> Frame:
    return E.cross_products(*two_bases(spark, sf)).select("pc_a", "pc_b", r6("c", "c"))
