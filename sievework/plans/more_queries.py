"""Queries over the audits, labellers, sources and sinks, with the same answer in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.operators import audits, behaviour, calibration, filters, generation, identifier_ops, labels, reports, selection
from sievework.operators.rows import KEY, OCC, ORIGIN, SPLIT, Context
from sievework.plans.queries import CTX, DECISIONS, DRAW, ROWS, RUN, _generated, _run, decided, query, rows, chats, table
from sievework.plans.staging import stage_path
from sievework.sources import readers, writers

TEXT = ("text",)


# Joins and audits
@query(f"""WITH {ROWS}, {RUN}, e AS (SELECT lang, source FROM rows JOIN run USING (k) WHERE p > 0.3 AND p < 0.7)
SELECT 'lang' AS column_name, coalesce(lang, '(empty)') AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, '(empty)'), count(*) FROM e GROUP BY 2""")
def excluded_by_band(spark, sf_dir):
    d = rows(spark, sf_dir)
    r = labels.threshold_labeler(d, Context(TEXT, inputs={"run": _run(d)}), 0.7, 0.3, True)
    return audits.excluded_by_band(r.events, d, ["lang", "source"]).withColumnsRenamed({"column": "column_name", "rows": "n"})


@query(f"WITH {ROWS}, g AS (SELECT count(*) AS n FROM rows WHERE split = 'train' AND doc_id % 4 = 1 AND occ = 0) SELECT least(n, greatest(100, n // 100)) AS checked, least(n, greatest(100, n // 100)) AS matching FROM g")
def verify_keys(spark, sf_dir):
    r = _generated(spark, sf_dir)
    return audits.verify_keys(r.output, r.events, TEXT, True).agg(F.count("*").alias("checked"), F.count(F.when(F.col("matches"), 1)).alias("matching"))


@query(f"""WITH {ROWS}, v AS (SELECT 'exact' AS kind, sha256(text) AS v, split, min(k) AS k FROM rows WHERE trim(text) <> '' GROUP BY 2, 3 UNION ALL SELECT 'group', source || '/' || n_chars, split, min(k) FROM rows GROUP BY 2, 3)
SELECT a.kind, a.k AS key_a, a.split AS side_a, b.k AS key_b, b.split AS side_b, 1.0::DOUBLE AS similarity FROM v a JOIN v b ON a.kind = b.kind AND a.v = b.v AND a.split < b.split""")
def leakage_pairs(spark, sf_dir):
    d = rows(spark, sf_dir).withColumn("grp", F.concat_ws("/", F.col("source"), F.col("n_chars").cast("string")))
    return audits.leakage_pairs(d.withColumn("grp", F.when(F.col("source").isNotNull(), F.col("grp"))), TEXT, "grp").drop("excerpt_a", "excerpt_b")


@query(f"WITH {ROWS}, {RUN}, s AS (SELECT source, lang, quality, p FROM rows JOIN run USING (k) WHERE quality IS NOT NULL AND source IS NOT NULL) SELECT count(*) AS pairs, coalesce(sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END), 0)::DOUBLE AS wins FROM s a JOIN s b ON a.source = b.source AND a.lang IS NOT DISTINCT FROM b.lang AND a.quality = 1 AND b.quality <> 1")
def paired_counts(spark, sf_dir):
    d = rows(spark, sf_dir, True)
    return audits.paired_counts(d.join(_run(d).select(F.col("row_key").alias(KEY), "p"), KEY), "source", F.col("quality") == 1, "p", "lang")


@query(f"""WITH {ROWS}, {RUN}, s AS (SELECT doc_id, source, quality, p, lang = 'fr' AS ref FROM rows JOIN run USING (k) WHERE source IS NOT NULL), f AS (SELECT source, arg_min(p, doc_id) AS ref_p FROM s WHERE ref GROUP BY 1)
SELECT quality::INTEGER AS label, count(*) AS n, count(*) FILTER (p > ref_p) AS wins FROM s JOIN f USING (source) WHERE NOT coalesce(ref, false) AND quality IS NOT NULL GROUP BY 1""")
def reference_pairs(spark, sf_dir):
    d = rows(spark, sf_dir, True)
    d = d.join(_run(d).select(F.col("row_key").alias(KEY), "p"), KEY)
    return audits.reference_pairs(d, "source", F.col("lang") == "fr", F.col("quality") == 1, "p", "doc_id").withColumnRenamed("rows", "n")


@query("SELECT 'odd' AS column_name, 'boolean' AS type, 'false' AS low, 'true' AS high UNION ALL SELECT 'label_text', 'string', 'bad', 'good' UNION ALL SELECT 'quality', 'bigint', '0', '1' UNION ALL SELECT 'toxic', 'bigint', '0', '1'")
def two_valued_columns(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    d = lab.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label_text"), (F.col("doc_id") % 2 == 1).alias("odd"), F.lit("x").alias("one"))
    return audits.two_valued_columns(d, ["doc_id"]).withColumnRenamed("column", "column_name")


@query(f"""WITH {ROWS}, c AS (SELECT *, row_number() OVER (ORDER BY {DRAW}, k, occ) - 1 AS place, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS flat FROM rows WHERE lang = 'en' AND label = 'good')
SELECT place, k AS row_key, occ AS occurrence, label, CASE WHEN length(flat) > 160 THEN flat[:159] || '…' ELSE flat END AS excerpt FROM c WHERE place < 30 AND place >= 10 AND place < 20""")
def cell_sample(spark, sf_dir):
    return audits.cell_sample(rows(spark, sf_dir, True), TEXT, "lang", "en", "label", "good", 7, 30, 1, 10)


@query(f"""WITH {ROWS}, c AS (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS value, label, count(*) AS before FROM rows WHERE label IS NOT NULL GROUP BY 1, 2) SELECT value, label, before, (SELECT min(before) FROM c) AS kept, (SELECT min(before) FROM c) AS cap FROM c""")
def balancer_preview(spark, sf_dir):
    d = rows(spark, sf_dir, True).where("label is not null").withColumn("side", F.when(F.col("lang") == "en", "en").otherwise("other"))
    return audits.balancer_preview(d, "side")


@query(f"""WITH {ROWS}, l AS (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS v, label, row_number() OVER (PARTITION BY CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END, label ORDER BY {DRAW}, k, occ) AS rn FROM rows WHERE label IS NOT NULL), cap AS (SELECT min(n) AS cap FROM (SELECT count(*) AS n FROM l GROUP BY v, label)),
b AS (SELECT max(share) AS x FROM (SELECT count(*) / sum(count(*)) OVER (PARTITION BY v) - sum(count(*)) OVER (PARTITION BY label) / sum(count(*)) OVER () AS share FROM l GROUP BY v, label)), a AS (SELECT max(share) AS x FROM (SELECT count(*) / sum(count(*)) OVER (PARTITION BY v) - sum(count(*)) OVER (PARTITION BY label) / sum(count(*)) OVER () AS share FROM l, cap WHERE rn <= cap GROUP BY v, label))
SELECT 'side' AS column_name, round(b.x, 9) AS before, round(a.x, 9) AS after FROM a, b""")
def balance_check(spark, sf_dir):
    """A balancer's own re-audit: after it no value favours a label."""
    d = rows(spark, sf_dir, True).where("label is not null").withColumn("side", F.when(F.col("lang") == "en", "en").otherwise("other"))
    r = audits.balance_check(d, selection.cell_balancer(d, CTX, "side").output, ["side"])
    return r.select(F.col("column").alias("column_name"), F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))


@query(f"""WITH {ROWS}, a AS (SELECT split, coalesce(label, '(empty)') AS label, count(*) AS rows_a FROM rows GROUP BY 1, 2), b AS (SELECT split, coalesce(label, '(empty)') AS label, count(*) AS rows_b FROM rows WHERE length(text) >= 300 AND coalesce(label, '') <> 'bad' GROUP BY 1, 2)
SELECT split, label, coalesce(rows_a, 0) AS rows_a, coalesce(rows_b, 0) AS rows_b, round(coalesce(rows_a / sum(rows_a) OVER (PARTITION BY split), 0), 9) AS share_a, round(coalesce(rows_b / sum(rows_b) OVER (PARTITION BY split), 0), 9) AS share_b FROM a FULL JOIN b USING (split, label)""")
def label_balance(spark, sf_dir):
    d = rows(spark, sf_dir, True)
    r = audits.label_balance(d, d.where("length(text) >= 300 and coalesce(label, '') <> 'bad'"))
    return r.select("split", "label", "rows_a", "rows_b", F.round("share_a", 9).alias("share_a"), F.round("share_b", 9).alias("share_b"))


@query(f"WITH {ROWS} SELECT 'dropped' AS kind, 'length_out_of_band' AS reason_code, count(*) FILTER (length(text) < 300) AS rows_a, count(*) FILTER (length(text) < 500) AS rows_b FROM rows UNION ALL SELECT 'dropped', 'value_excluded', 0, count(*) FROM rows WHERE lang = 'es' AND length(text) >= 500")
def drop_log_difference(spark, sf_dir):
    d = rows(spark, sf_dir)
    a, b = (filters.length_band(d, CTX, min_length=n, max_length=10_000_000) for n in (300, 500))
    return audits.drop_log_difference(a.events, b.events.unionByName(filters.metadata_value_filter(b.output, CTX, "lang", ["es"]).events))


@query("""WITH c AS (SELECT source AS v, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 3 = 0) AS b FROM documents GROUP BY 1), t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY a + b DESC, v NULLS LAST) AS rn FROM c WHERE a + b > 0))
SELECT CASE WHEN rn <= 5 THEN coalesce(v, '(empty)') ELSE 'other' END AS value, sum(a)::BIGINT AS rows_a, sum(b)::BIGINT AS rows_b FROM t GROUP BY 1""")
def top_values_compared(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return audits.top_values_compared(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), "source", 5)


PAIRS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.4),
both_ways AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x), root AS (SELECT x AS node, least(x, min(y)) AS root FROM reach GROUP BY x)"""


@query(f"WITH RECURSIVE {PAIRS} SELECT size, count(*) AS groups FROM (SELECT root, count(*) AS size FROM root GROUP BY 1) GROUP BY 1")
def embedding_groups(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return audits.embedding_groups(v, 0.4)


@query("""WITH c AS (SELECT vec_id AS cluster, embedding::DOUBLE[] AS centre FROM embeddings WHERE vec_id < 7), d AS (SELECT e.vec_id AS key, cluster, list_distance(embedding::DOUBLE[], centre) AS distance FROM embeddings e, c)
SELECT key, arg_min(cluster, distance)::INTEGER AS cluster, round(min(distance), 6) AS distance FROM d GROUP BY 1""")
def assign_to_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = e.where("vec_id < 7").select(F.col("vec_id").cast("int").alias("cluster"), F.col("embedding").alias("centre"))
    return audits.assign_to_centroids(e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), c).withColumn("distance", F.round("distance", 6))


@query("SELECT count(DISTINCT n_chars // 1000) / 40 AS occupied, round((SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY n_chars // 1000)) / count(*), 9) AS largest FROM documents")
def cluster_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("n_chars div 1000").alias("cluster"))
    return audits.cluster_coverage(d, 40).withColumn("largest", F.round("largest", 9))


@query("SELECT unnest(range(0, 1001))::INTEGER AS permille, round(unnest(quantile_cont(n_chars, list_transform(range(0, 1001), lambda i: i / 1000))), 6) AS value FROM documents".replace("list_transform(range(0, 1001), lambda i: i / 1000)", str([i / 1000 for i in range(1001)])))
def length_points(spark, sf_dir):
    return audits.length_points(table(spark, sf_dir, "documents"), "n_chars")[0].select(F.col("permille"), F.round("value", 6).alias("value"))


@query("WITH t AS (SELECT quantile_cont(n_chars, 0.99) AS top FROM documents) SELECT least(floor(n_chars / top * 30), 29)::INTEGER AS bin, count(*) AS n FROM documents, t WHERE n_chars <= top GROUP BY 1")
def length_bins(spark, sf_dir):
    return audits.length_points(table(spark, sf_dir, "documents"), "n_chars")[1].withColumnRenamed("rows", "n")


@query("""WITH c AS (SELECT l_orderkey, nullif(l_returnflag, 'R') AS v, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, sum(n) AS asked, coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS votes, count(v) AS kinds, max(n) FILTER (v IS NOT NULL) AS top FROM c GROUP BY 1),
t AS (SELECT g.l_orderkey, asked, votes, kinds, count(c.v) AS tops, max(c.v) AS v FROM g LEFT JOIN c ON c.l_orderkey = g.l_orderkey AND c.v IS NOT NULL AND c.n = g.top GROUP BY ALL)
SELECT l_orderkey, CASE WHEN votes = 0 OR tops > 1 THEN 'excluded' ELSE v END AS verdict, CASE WHEN votes = 0 THEN 'no_verdicts' WHEN tops > 1 OR kinds > 1 THEN 'disagreement' WHEN votes < asked THEN 'missing_verdict' END AS flag FROM t""")
def aggregate_verdict(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    return audits.aggregate_verdict(d, "l_orderkey", "v").withColumnRenamed("row", "l_orderkey")


@query("SELECT CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' AND l_quantity > 40 THEN 'parse_failure' WHEN l_returnflag = CASE WHEN l_discount > 0.05 THEN 'A' ELSE 'N' END THEN l_returnflag ELSE 'position_inconsistent' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1")
def swap_and_agree(spark, sf_dir):
    first = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    second = F.when(~((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)), F.when(F.col("l_discount") > 0.05, "A").otherwise("N"))
    return table(spark, sf_dir, "lineitem").groupBy(audits.swap_and_agree(first, second).alias("verdict")).agg(F.count("*").alias("n"))


def _count_the(row: dict) -> int | str | None:
    if row["text"] is None:
        return None
    if row["n_chars"] < 50:
        return "too short"
    return row["text"].count(" the ")


@query("SELECT doc_id, CASE WHEN n_chars >= 50 THEN len(string_split(text, ' the ')) - 1 END AS n, CASE WHEN n_chars < 50 THEN 'too short' END AS reason FROM documents")
def code_rule(spark, sf_dir):
    return audits.code_rule(table(spark, sf_dir, "documents"), _count_the, ["text", "n_chars"]).select("doc_id", F.col("code_rule.count").alias("n"), F.col("code_rule.reason").alias("reason"))


@query("SELECT 'pass' AS result, count(*) AS n FROM documents")
def version_check(spark, sf_dir):
    d = rows(spark, sf_dir).withColumn("carrier_id", F.concat_ws(":", KEY, OCC)).withColumn("generation_run", F.col("doc_id") % 3).withColumn("cell", F.lit(None).cast("string"))
    r = audits.run_check(d, CTX, behaviour.carrier_check)
    return spark.createDataFrame([(r["result"], r["rows"])], "result string, n long")


@query(f"""WITH {ROWS} SELECT 'test' AS split, 'held_out' AS role, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) < 100) AS too_short, (SELECT count(DISTINCT a.k) FROM rows a JOIN rows b ON a.k = b.k AND a.split = 'test' AND b.split = 'train') AS shared_keys FROM rows WHERE split = 'test'
UNION ALL SELECT 'train', 'practice', count(*), count(*) FILTER (length(coalesce(text, '')) < 100), 0 FROM rows WHERE split = 'train'""")
def partition_roles(spark, sf_dir):
    return audits.partition_roles(rows(spark, sf_dir), {"test": "held_out", "train": "practice"}, "text", 100).withColumnRenamed("rows", "n")


@query("SELECT count(*) AS n, 0::BIGINT AS nulls, min(t) AS shortest, max(t) AS longest, round(avg(t), 9) AS mean FROM (SELECT count(*) AS t FROM conversations GROUP BY conv_id)")
def list_lengths(spark, sf_dir):
    return audits.list_lengths(chats(spark, sf_dir), "messages").select(F.col("rows").alias("n"), "nulls", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"), F.round("mean", 9).alias("mean"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'org/m' || doc_id % 5 WHEN doc_id % 3 = 1 THEN 'm:x' || doc_id % 5 ELSE 'plain' END AS model, count(*) AS n FROM documents GROUP BY 1")
def model_identity(spark, sf_dir):
    k = F.col("doc_id")
    five = (k % 5).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("org/m"), five, F.lit("@rev:"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("m:x"), five, F.lit(":"), k.cast("string"))).otherwise("plain")
    return table(spark, sf_dir, "documents").groupBy(audits.model_identity(name).alias("model")).agg(F.count("*").alias("n"))


# Labellers
@query(f"""WITH {ROWS}, lab AS (SELECT k, max(quality) AS q FROM rows WHERE doc_id % 3 = 0 AND quality IS NOT NULL GROUP BY 1), x AS (SELECT DISTINCT k FROM rows WHERE split = 'test'), g AS (SELECT DISTINCT source || lang AS v FROM rows WHERE split = 'test' AND doc_id < 200)
SELECT CASE WHEN lab.k IS NULL THEN 'not_in_calibration_set' WHEN x.k IS NOT NULL THEN 'shares_row_with_excluded_split' ELSE 'kept' END AS reason_code, count(*) AS n FROM rows LEFT JOIN lab USING (k) LEFT JOIN x USING (k) GROUP BY 1""")
def calibration_labels(spark, sf_dir):
    d = rows(spark, sf_dir, True)
    cal = d.where("doc_id % 3 = 0 and quality is not null").groupBy(F.col(KEY).alias("row_key")).agg(F.max("quality").alias("label"))
    r = labels.calibration_labels(d, Context(TEXT, inputs={"calibration": cal}), "human", d.where(F.col(SPLIT) == "test"))
    return r.events.groupBy("reason_code").agg(F.count("*").alias("n")).unionByName(r.output.agg(F.lit("kept").alias("reason_code"), F.count("*").alias("n")).where("n > 0"))


@query("SELECT CASE WHEN greatest(l_discount * 10, l_tax * 10, 0.3) >= 0.5 THEN CASE WHEN l_discount * 10 >= greatest(l_tax * 10, 0.3) THEN 'discount' WHEN l_tax * 10 >= 0.3 THEN 'tax' ELSE 'plain' END ELSE 'excluded' END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def top_label(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.groupBy(labels.top_label({"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 10, "plain": F.lit(0.3)}, 0.5).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT len(list_filter(range(0, 6), lambda i: (doc_id % 7) < i * 3 + 2 AND i * 3 < (doc_id % 7) + 3)) > 0 AS meets, count(*) AS n FROM documents GROUP BY 1")
def interval_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fixed = F.array(*[F.struct(F.lit(i * 3).cast("long").alias("start"), F.lit(i * 3 + 2).cast("long").alias("end")) for i in range(6)])
    own = F.array(F.struct((F.col("doc_id") % 7).alias("start"), (F.col("doc_id") % 7 + 3).alias("end")))
    return d.groupBy(labels.overlaps(own, fixed).alias("meets")).agg(F.count("*").alias("n"))


@query(f"""WITH {ROWS}, s AS (SELECT lang, n_chars % 100 AS en, (n_chars * 7) % 100 AS fr FROM rows WHERE lang IS NOT NULL), e AS (SELECT 'en' AS class, lang = 'en' AS y, en AS p FROM s UNION ALL SELECT 'fr', lang = 'fr', fr FROM s),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2 AS r FROM e), a AS (SELECT class, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auroc FROM r GROUP BY 1)
SELECT class, round(auroc, 9) AS auroc FROM a UNION ALL SELECT 'macro', round(avg(auroc), 9) FROM a""")
def macro_auroc(spark, sf_dir):
    d = rows(spark, sf_dir).where("lang is not null").select("lang", (F.col("n_chars") % 100).alias("en_p"), ((F.col("n_chars") * 7) % 100).alias("fr_p"))
    return reports.macro_auroc(d, "lang", {"en": "en_p", "fr": "fr_p"}).withColumn("auroc", F.round("auroc", 9))


@query("SELECT source AS value, CASE source WHEN 'src1' THEN 'one' WHEN 'src2' THEN 'two' END AS target, count(*) AS n FROM documents GROUP BY 1")
def label_mapping_check(spark, sf_dir):
    return calibration.label_mapping_check(table(spark, sf_dir, "documents"), "source", {"src1": "one", "src2": "two"}).withColumnRenamed("rows", "n")


@query("SELECT count(n_chars) AS n, min(n_chars) AS low, quantile_cont(n_chars, 0.5) AS middle, max(n_chars) AS high, min(n_chars) = max(n_chars) AS constant FROM documents")
def threshold_statistics(spark, sf_dir):
    return calibration.threshold_statistics(table(spark, sf_dir, "documents"), F.col("n_chars")).withColumnRenamed("rows", "n")


@query("WITH e AS (SELECT quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM documents) SELECT 'band ' || len(list_filter(list_distinct(q), lambda x: n_chars >= x)) AS band, count(*) AS n FROM documents, e GROUP BY 1")
def decile_band(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(reports.decile_band(d, "n_chars").alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'no_characters' WHEN regexp_matches(t, '[^0-9A-Z]') THEN 'illegal_character' WHEN length(t) NOT IN (4, 14) THEN 'wrong_length' ELSE 'ok' END AS reason FROM (SELECT regexp_replace(coalesce(CASE doc_id % 4 WHEN 0 THEN upper(source) WHEN 1 THEN lang || '.' WHEN 2 THEN ' - ' ELSE upper(source) || ' - ' || upper(lang) || '-00000000' END, ''), '[ -]', '', 'g') AS t FROM documents)) GROUP BY 1""")
def length_charset(spark, sf_dir):
    k = F.col("doc_id") % 4
    value = F.when(k == 0, F.upper("source")).when(k == 1, F.concat("lang", F.lit("."))).when(k == 2, F.lit(" - ")).otherwise(F.concat(F.upper("source"), F.lit(" - "), F.upper("lang"), F.lit("-00000000")))
    return table(spark, sf_dir, "documents").groupBy(identifier_ops.length_charset(value, [4, 14], "upper_alnum")["reason"].alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {ROWS}, l AS (SELECT quality = 1 AS y, coalesce(lang, '(empty)') AS lang, coalesce(source, '(empty)') AS source FROM rows WHERE quality IS NOT NULL), e AS (SELECT 'lang' AS c, y, avg(y::INT) OVER (PARTITION BY lang) AS p FROM l UNION ALL SELECT 'source', y, avg(y::INT) OVER (PARTITION BY source) FROM l),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2 AS r FROM e)
SELECT c AS column_name, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auroc FROM r GROUP BY 1""")
def shortcut_areas(spark, sf_dir):
    return calibration.shortcut_areas(rows(spark, sf_dir, True), ["lang", "source"], "quality", "1").select(F.col("column").alias("column_name"), F.round("auroc", 9).alias("auroc"))


# Selection
@query(f"""WITH RECURSIVE {PAIRS}, {ROWS}, byk AS (SELECT k, min(doc_id) AS id FROM rows WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY k), kp AS (SELECT a.k AS x, b.k AS y FROM p JOIN byk a ON p.a = a.id JOIN byk b ON p.b = b.id), kb AS (SELECT x, y FROM kp UNION SELECT y, x FROM kp), kr AS (SELECT x, y FROM kb UNION SELECT r.x, e.y FROM kr r JOIN kb e ON r.y = e.x),
grp AS (SELECT r.k, r.occ, r.split, coalesce((SELECT least(r.k, min(y)) FROM kr WHERE kr.x = r.k), r.k) AS g, r.k IN (SELECT x FROM kr) AS tied FROM rows r), low AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k, occ) AS rn, min(split) OVER (PARTITION BY g) <> max(split) OVER (PARTITION BY g) AS spans FROM grp)
SELECT count(*) AS dropped FROM low WHERE rn > 1 AND NOT spans""")
def dedup_embedding(spark, sf_dir):
    d = rows(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    have = d.join(e.select("vec_id"), F.col("doc_id") == F.col("vec_id")).groupBy(F.col(KEY).alias("key")).agg(F.min("doc_id").alias("id"))
    v = have.join(e, F.col("id") == F.col("vec_id")).select("key", F.col("embedding").alias("vector"))
    return selection.dedup_embedding(d, Context(TEXT, inputs={"vectors": v}), 0.4).events.agg(F.count("*").alias("dropped"))


@query(f"WITH {ROWS}, c AS (SELECT *, min(doc_id) OVER (PARTITION BY k) % 6 AS cluster FROM rows), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {DRAW}, k, occ) AS rn FROM c) SELECT k AS row_key, occ AS occurrence FROM r WHERE rn <= 40")
def cap_clusters(spark, sf_dir):
    """Rows alike stand in the cluster of their first id."""
    d = rows(spark, sf_dir)
    per = d.groupBy(F.col(KEY).alias("row_key")).agg((F.min("doc_id") % 6).alias("cluster"))
    return selection.cap_clusters(d, CTX, per, cap=40).output.select(F.col(KEY).alias("row_key"), F.col(OCC).alias("occurrence"))


@query("""WITH c AS (SELECT coalesce(source, '(empty)') AS value, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, 100 * n / sum(n) OVER () AS x FROM c), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, value) AS rn, sum(floor(x)) OVER () AS given FROM e)
SELECT value, (floor(x) + CASE WHEN rn <= 100 - given THEN 1 ELSE 0 END)::INTEGER AS n FROM r""")
def largest_remainder(spark, sf_dir):
    sizes = {r["value"]: r["n"] for r in table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("(empty)")).alias("value")).agg(F.count("*").alias("n")).collect()}  # one row a source
    names = sorted(sizes)
    return spark.createDataFrame([*zip(names, selection.largest_remainder([sizes[n] for n in names], 100))], "value string, n int")


@query("SELECT 100 AS n, 1 AS least, true AS within")
def proportional_allocation(spark, sf_dir):
    """Exactly so many rows, at least one a stratum, none over its size."""
    sizes = {r["value"]: r["n"] for r in table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("(empty)")).alias("value")).agg(F.count("*").alias("n")).collect()}  # one row a source
    got = selection.proportional_allocation(sizes, 100)
    return spark.createDataFrame([(sum(got.values()), min(1, min(got.values())), all(got[k] <= sizes[k] for k in got))], "n int, least int, within boolean")


# Columns
@query("SELECT 'doc_id,lang,n_chars,text' AS columns, count(*) AS n FROM documents")
def drop_columns(spark, sf_dir):
    d = filters.drop_columns(rows(spark, sf_dir), CTX, patterns=["sou*"]).output
    return d.agg(F.lit(",".join(sorted(c for c in d.columns if not c.startswith("_dw_")))).alias("columns"), F.count("*").alias("n"))


@query("SELECT doc_id, 'doc ' || doc_id || ' in ' || coalesce(lang, '') || ': ' || coalesce(source, '') AS line FROM documents")
def template_column(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", filters.template_column(d, "doc {{ doc_id }} in {{lang}}: {{ source }}").alias("line"))


# Sources and sinks: written to the shared folder and read back
SHAPE = "SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents"


def _shape(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids"), F.sum(F.length("text")).alias("chars"), F.countDistinct(F.when(F.col("lang") != "", F.col("lang"))).alias("langs"))


@query(SHAPE)
def read_by_name(spark, sf_dir):
    """Two files whose columns stand in another order, one without a column, read by name."""
    d, path = table(spark, sf_dir, "documents"), stage_path(spark, "named")
    d.where("doc_id % 2 = 0").select("text", "doc_id", "lang", "source").write.parquet(f"{path}/a")
    d.where("doc_id % 2 = 1").select("lang", "n_chars", "doc_id", "text").write.parquet(f"{path}/b")
    return _shape(readers.read_parquet(spark, f"{path}/a", f"{path}/b", by_name=True))


@query(SHAPE)
def read_csv(spark, sf_dir):
    path = stage_path(spark, "csv")
    table(spark, sf_dir, "documents").write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    return _shape(readers.read_csv(spark, path))


@query(SHAPE)
def read_jsonl(spark, sf_dir):
    path = stage_path(spark, "jsonl")
    table(spark, sf_dir, "documents").write.json(path)
    return _shape(readers.read_jsonl(spark, path))


@query("SELECT 'a.jsonl' AS file, 'jsonl' AS kind UNION ALL SELECT 'b.csv', 'csv' UNION ALL SELECT 'c.parquet', 'parquet'")
def sniff(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents").limit(5).coalesce(1), stage_path(spark, "sniff")
    files = []
    for name, write in (("a.jsonl", d.write.json), ("b.csv", d.select("doc_id", "lang").write.option("header", "true").csv), ("c.parquet", d.write.parquet)):
        write(f"{path}/{name}")
        part = spark.read.format("binaryFile").load(f"{path}/{name}/part-*").select("path").first()[0]  # one file
        files.append((name, readers.sniff(spark, part)))
    return spark.createDataFrame(files, "file string, kind string")


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, least(count(*), 50) AS n, (sum(doc_id) FILTER (rn <= 50))::BIGINT AS ids FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 10 = 0 ORDER BY doc_id) AS rn FROM documents) GROUP BY 1")
def read_hub_directory(spark, sf_dir):
    path = stage_path(spark, "hub")
    for s, test in (("train", "doc_id % 10 <> 0"), ("test", "doc_id % 10 = 0")):
        table(spark, sf_dir, "documents").where(test).withColumn("_dw_row_key", F.lit("x")).write.parquet(f"{path}/{s}")
    parts = readers.read_hub_directory(spark, path, ["train", "test"], 50, "doc_id")
    assert all("_dw_row_key" not in d.columns for _, d in parts)
    one = [d.agg(F.lit(s).alias("split"), F.count("*").alias("n"), F.sum("doc_id").alias("ids")) for s, d in parts]
    return one[0].unionByName(one[1])


@query("SELECT range AS number FROM range(5, 105)")
def index_source(spark, sf_dir):
    return readers.index_source(spark, 100, 5, "number")


@query(f"WITH {ROWS.replace('ORDER BY split DESC, doc_id', 'ORDER BY doc_id')} SELECT doc_id FROM rows ORDER BY sha256('3:' || k || ':' || occ) LIMIT 100")
def source_preview(spark, sf_dir):
    return readers.preview(table(spark, sf_dir, "documents"), list(TEXT), "doc_id", 100, 3).select("doc_id")


@query(f"WITH {ROWS} SELECT split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM rows GROUP BY 1 UNION ALL SELECT 'empty', 0, 0")
def write_version(spark, sf_dir):
    path = stage_path(spark, "version")
    writers.write_version(rows(spark, sf_dir), path, ["empty"])
    counts = lambda s: spark.read.parquet(f"{path}/{SPLIT}={s}").agg(F.lit(s).alias("split"), F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids"))
    return counts("train").unionByName(counts("test")).unionByName(counts("empty"))


@query(f"WITH {ROWS} SELECT k AS row_key, lang FROM rows WHERE split = 'test'")
def write_download(spark, sf_dir):
    path = stage_path(spark, "download")
    writers.write_download(rows(spark, sf_dir), "test", ["lang"], path)
    return spark.read.schema(f"{KEY} string, lang string").json(path).withColumnRenamed(KEY, "row_key")


@query(f"WITH {ROWS} SELECT split, 'label,text' AS columns, count(*) AS n, count(label) AS labelled FROM rows GROUP BY 1")
def write_export(spark, sf_dir):
    path = stage_path(spark, "export")
    made = writers.write_export(rows(spark, sf_dir, True), "detector", path)
    d = spark.read.parquet(f"{path}/data")
    assert made["rows"] == {r[SPLIT]: r["count"] for r in d.groupBy(SPLIT).count().collect()}  # one row a split
    return d.groupBy(F.col(SPLIT).alias("split")).agg(F.lit(",".join(sorted(c for c in d.columns if c != SPLIT))).alias("columns"), F.count("*").alias("n"), F.count("label").alias("labelled"))


@query(f"WITH {DECISIONS}, d AS (SELECT documents.doc_id, effective.label, state, effective_label FROM documents JOIN effective ON doc_id = row_key) SELECT CASE WHEN state = 'overridden' THEN effective_label ELSE label END AS label, count(*) AS n FROM d WHERE state <> 'flagged_unresolved' GROUP BY 1")
def publish_projection(spark, sf_dir):
    """Keys are ids here, as the decisions name ids."""
    e = decided(spark, sf_dir)
    d = rows(spark, sf_dir).join(e.select(F.col("row_key").alias("id"), "label"), F.col("doc_id") == F.col("id")).drop("id").withColumn(KEY, F.col("doc_id").cast("string"))
    p = writers.publish_projection(d, e.withColumn("row_key", F.col("row_key").cast("string")))
    return p.groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {ROWS} SELECT 0 AS step, count(*) FILTER (length(text) < 300) AS n FROM rows UNION ALL SELECT 1, count(*) FILTER (length(text) >= 300 AND lang = 'es') FROM rows")
def append_events(spark, sf_dir):
    """The first step is written twice, as a retry would."""
    path, d = stage_path(spark, "events"), rows(spark, sf_dir)
    one = filters.length_band(d, CTX, min_length=300, max_length=10_000_000)
    two = filters.metadata_value_filter(one.output, CTX, "lang", ["es"])
    for step, ev in ((0, one.events), (0, one.events), (1, two.events)):
        writers.append_events(ev, path, step)
    return spark.read.parquet(path).groupBy("step").agg(F.count("*").alias("n"))


@query("SELECT '{\"rows\":' || count(*) || ',\"sha256\":\"' || sha256('{\"rows\":' || count(*) || '}') || '\"}' AS value FROM documents")
def write_manifest(spark, sf_dir):
    path = stage_path(spark, "manifest")
    writers.write_manifest(spark, {"rows": table(spark, sf_dir, "documents").count()}, path)
    return spark.read.text(path)


@query(f"WITH {ROWS} SELECT count(*) AS n FROM rows")
def logical_digest(spark, sf_dir):
    """The digest of a table and of the same rows in another order and layout agree."""
    d = rows(spark, sf_dir)
    a, b = reports.logical_digest(d), reports.logical_digest(d.repartition(7, "lang"))
    return a.join(b, ["rows", "digest", "total"]).select(F.col("rows").alias("n"))


# Reports as steps of a recipe
@query(f"WITH {ROWS} SELECT 'exact' AS kind, 'test' AS side_a, 'train' AS side_b, coalesce(sum(a.n * b.n), 0)::BIGINT AS pairs FROM (SELECT text, count(DISTINCT k) AS n FROM rows WHERE split = 'test' AND trim(text) <> '' GROUP BY 1) a JOIN (SELECT text, count(DISTINCT k) AS n FROM rows WHERE split = 'train' GROUP BY 1) b USING (text)")
def report_step(spark, sf_dir):
    """leakage_check as a step of a recipe: rows pass, the report stands beside them."""
    from sievework.plans.recipe import run_recipe

    v = run_recipe(spark, rows(spark, sf_dir), [{"operator": "leakage_check", "version": "1.0.0", "params": {"near": False}}])
    return v.reports["0:leakage_check@1.0.0"]["crossings"]
