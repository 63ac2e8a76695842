"""Queries: joins, regions, comparison of samples, multi-sample tables, sets, windows and sorting."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import alleles as A
from ..operators import compare as C
from ..operators import multi as M
from ..operators import positions as P
from ..operators import quantify as Z
from ..operators import regions as R
from ..sources.files import stored
from .derived import WINDOW, WITH, alleles, reads, table, variants
from .queries_edits import _IN, _N, _PILE, _count
from .registry import query

_AL = f"SELECT sample, ref_name, aln_seq, aln_ref, NOT modified AS unedited, CAST(n_del AS INT) AS n_deleted, CAST(n_ins AS INT) AS n_inserted, n_sub AS n_mutated, {_N} AS n_reads FROM vars GROUP BY ALL"
_AK = ", ".join(["ref_name", *C.ALLELE_KEYS])


def _both(spark, sf):
    rows = stored(A.allele_rows(variants(spark, sf), ["sample"]), "alleles")  # called once, then summed and compared
    t = A.with_percent(rows, ["sample"]).withColumn("unedited", F.col("read_status") == "UNMODIFIED")
    return C.two_samples(t, ["ref_name", *C.ALLELE_KEYS], "O", "F")


@query(
    "D03_merged_alleles",
    WITH + f""", al AS (SELECT *, 100.0 * n_reads / CAST(sum(n_reads) OVER (PARTITION BY sample) AS DOUBLE) AS pct FROM ({_AL}) AS t)
SELECT {', '.join(f'coalesce(a.{k}, b.{k}) AS {k}' for k in _AK.split(', '))}, coalesce(a.n_reads, 0) AS n_reads_1, coalesce(b.n_reads, 0) AS n_reads_2, coalesce(a.pct, 0.0) AS pct_reads_1, coalesce(b.pct, 0.0) AS pct_reads_2
FROM (SELECT * FROM al WHERE sample = 'O') AS a FULL OUTER JOIN (SELECT * FROM al WHERE sample = 'F') AS b ON {' AND '.join(f'a.{k} = b.{k}' for k in _AK.split(', '))}""",
)
def merged_alleles(spark, sf):
    return _both(spark, sf).drop("lfc")


@query(
    "F38_log_fold_change",
    WITH + f""", al AS (SELECT *, 100.0 * n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS pct FROM (SELECT ref_name, aln_seq, aln_ref, sample, count(*) AS n FROM reads GROUP BY ALL) AS c),
w AS (SELECT ref_name, aln_seq, aln_ref, coalesce(max(pct) FILTER (WHERE sample = 'O'), 0.0) AS a, coalesce(max(pct) FILTER (WHERE sample = 'F'), 0.0) AS b FROM al GROUP BY ALL)
SELECT ref_name, aln_seq, aln_ref, round(log2((a + {C.PSEUDO}) / (b + {C.PSEUDO})), 9) AS lfc FROM w""",
)
def log_fold_change(spark, sf):
    t = A.with_percent(alleles(spark, sf), ["sample"])
    keys = ["ref_name", "aln_seq", "aln_ref"]
    return C.merged_alleles(t.where("sample = 'O'"), t.where("sample = 'F'"), keys).select(*keys, F.round("lfc", 9).alias("lfc"))


_CHANGED = f"""SELECT *, log2((pct_reads_1 + {C.PSEUDO}) / (pct_reads_2 + {C.PSEUDO})) AS r FROM (SELECT {_AK}, CAST(coalesce(sum(n_reads) FILTER (WHERE sample = 'O'), 0) AS BIGINT) AS n_reads_1, CAST(coalesce(sum(n_reads) FILTER (WHERE sample = 'F'), 0) AS BIGINT) AS n_reads_2,
  coalesce(sum(pct) FILTER (WHERE sample = 'O'), 0.0) AS pct_reads_1, coalesce(sum(pct) FILTER (WHERE sample = 'F'), 0.0) AS pct_reads_2 FROM (SELECT *, 100.0 * n_reads / CAST(sum(n_reads) OVER (PARTITION BY sample) AS DOUBLE) AS pct FROM ({_AL}) AS t) AS al GROUP BY {_AK}) AS w"""


@query("H02_most_changed", WITH + f"""SELECT * EXCLUDE (r), round(r, 9) AS lfc, 'first' AS side FROM (SELECT * FROM ({_CHANGED}) AS a ORDER BY r DESC, aln_seq, aln_ref LIMIT 20) AS x
UNION ALL SELECT * EXCLUDE (r), round(r, 9), 'second' FROM (SELECT * FROM ({_CHANGED}) AS a ORDER BY r, aln_seq, aln_ref LIMIT 20) AS y""")
def most_changed(spark, sf):
    return C.most_changed(_both(spark, sf), 20).withColumn("lfc", F.round("lfc", 9))


_RATES = f"SELECT sample, ref_name, {_N} AS n_reads, 100.0 * count(*) FILTER (WHERE modified) / CAST(count(*) AS DOUBLE) AS m FROM vars GROUP BY ALL"


@query("D04_rate_difference", WITH + f", r AS ({_RATES}) SELECT a.ref_name, a.n_reads AS n_reads_1, b.n_reads AS n_reads_2, round(a.m - b.m, 9) AS modified_diff FROM r AS a LEFT JOIN r AS b ON a.ref_name = b.ref_name AND b.sample = 'F' WHERE a.sample = 'O'")
def rate_difference(spark, sf):
    rates = Z.editing(variants(spark, sf), ["sample", "ref_name"])
    d = C.rate_difference(rates.where("sample = 'O'"), rates.where("sample = 'F'"), ["ref_name"])
    return d.select("ref_name", "n_reads_1", "n_reads_2", F.round("modified_diff", 9).alias("modified_diff"))


@query("F39_editing_difference", WITH + f", r AS ({_RATES}) SELECT a.ref_name, round(a.m, 9) AS modified_1, round(b.m, 9) AS modified_2, round(b.m - a.m, 9) AS unmodified_diff FROM r AS a LEFT JOIN r AS b ON a.ref_name = b.ref_name AND b.sample = 'F' WHERE a.sample = 'O'")
def editing_difference(spark, sf):
    rates = Z.editing(variants(spark, sf), ["sample", "ref_name"])
    d = C.rate_difference(rates.where("sample = 'O'"), rates.where("sample = 'F'"), ["ref_name"])
    return d.select("ref_name", *[F.round(c, 9).alias(n) for c, n in (("modified_pct_1", "modified_1"), ("modified_pct_2", "modified_2"), ("unmodified_diff", "unmodified_diff"))])


def _tests(spark, sf):
    pos = P.edit_positions(variants(spark, sf), ["sample", "ref_name"], in_window=True)
    totals = alleles(spark, sf).groupBy("sample", "ref_name").agg(F.sum("n_reads").alias("n_reads"))
    every = totals.select("ref_name").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return C.position_tests(pos, totals, ["ref_name"], every, "O", "F")


@query("F36_tested_counts", WITH + f"""SELECT r.ref_name, CAST(i AS INT) AS pos, CAST(count(*) FILTER (WHERE sample = 'O') AS BIGINT) AS n_1, CAST(count(*) FILTER (WHERE sample = 'F') AS BIGINT) AS n_2
FROM (SELECT DISTINCT ref_name FROM reads) AS r CROSS JOIN range(64) AS x(i) LEFT JOIN ({_IN}) AS t ON t.ref_name = r.ref_name AND t.pos = i GROUP BY ALL""")
def tested_counts(spark, sf):
    return _tests(spark, sf).select("ref_name", "pos", "n_1", "n_2")


_GENE = "SELECT s_suppkey, CAST(s_suppkey % 5 AS INT) AS chr, s_suppkey * 7 AS tx_start, s_suppkey * 7 + 10 AS tx_end FROM supplier"
_REGION = "SELECT p_partkey, CAST(p_partkey % 5 AS INT) AS chr, p_partkey * 3 AS start, p_partkey * 3 + p_size AS stop FROM part"


def _regions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("chr"), (F.col("p_partkey") * 3).alias("start"), (F.col("p_partkey") * 3 + F.col("p_size")).alias("stop"))


def _genes(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).cast("int").alias("chr"), (F.col("s_suppkey") * 7).alias("tx_start"), (F.col("s_suppkey") * 7 + 10).alias("tx_end"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("gene"))


@query("D06_region_genes", f"SELECT r.p_partkey, string_agg(lpad(CAST(g.s_suppkey AS VARCHAR), 9, '0'), ',' ORDER BY g.s_suppkey) AS genes FROM ({_REGION}) AS r LEFT JOIN ({_GENE}) AS g ON r.chr = g.chr AND g.tx_start <= r.stop AND r.start <= g.tx_end GROUP BY r.p_partkey")
def region_genes(spark, sf):
    return R.gene_names(_regions(spark, sf), _genes(spark, sf), ["p_partkey"], "chr", ("start", "tx_start"), ("stop", "tx_end"), "gene").select("p_partkey", "genes")


@query("D07_reads_in_region", f"SELECT r.p_partkey, CAST(count(*) AS BIGINT) AS n_reads FROM ({_REGION}) AS r JOIN (SELECT CAST(o_custkey % 5 AS INT) AS chr, o_custkey AS pos, o_custkey + 20 AS pos_end FROM orders) AS o ON o.chr = r.chr AND o.pos <= r.stop AND r.start <= o.pos_end GROUP BY r.p_partkey")
def reads_in_region(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 5).cast("int").alias("chr"), F.col("o_custkey").alias("pos"), (F.col("o_custkey") + 20).alias("pos_end"))
    return R.overlapping(_regions(spark, sf), o, "chr", ("start", "pos"), ("stop", "pos_end"), width=64).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_reads"))


@query("F33_demultiplexed", "SELECT CAST(o_custkey % 5 AS INT) AS chr, o_custkey AS start, o_custkey + 20 AS stop, CAST(count(*) AS BIGINT) AS n_reads FROM orders GROUP BY ALL")
def demultiplexed(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 5).cast("int").alias("chr"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + 20).alias("stop"))
    return R.demultiplexed(o, "chr", "start", "stop")


@query("D08_amplicon_locations", "SELECT c_custkey, coalesce(n, 0) AS n_reads FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) AS o ON c_custkey = o_custkey")
def amplicon_locations(spark, sf):
    counts = demultiplexed(spark, sf)
    places = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("chr"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + 20).alias("stop"))
    return places.join(counts, ["chr", "start", "stop"], "left").select("c_custkey", F.coalesce("n_reads", F.lit(0)).alias("n_reads"))


@query("D09_unmatched_regions", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def unmatched_regions(spark, sf):
    return R.unmatched(table(spark, sf, "part").select("p_partkey"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey")), ["p_partkey"])


@query("D05_amplicon_genome_location", WITH + f"SELECT r.ref_name, n.n_name AS place, {_N} AS n_reads FROM reads AS r LEFT JOIN nation AS n ON r.ref_id = n.n_nationkey GROUP BY ALL")
def amplicon_genome_location(spark, sf):
    r = reads(spark, sf).groupBy("ref_name", "ref_id").agg(F.count(F.lit(1)).alias("n_reads"))
    return r.join(table(spark, sf, "nation"), r["ref_id"] == F.col("n_nationkey"), "left").select("ref_name", F.col("n_name").alias("place"), "n_reads")


@query("D10_guides_in_no_reference", WITH + "SELECT part FROM (VALUES ('ACGT'), ('TTTTTTTTTT'), ('GATTACA')) AS v(part) WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT ref_seq FROM reads) AS r WHERE contains(r.ref_seq, part) OR contains(reverse(translate(r.ref_seq, 'ACGT', 'TGCA')), part))")
def guides_in_no_reference(spark, sf):
    from ..operators.references import missing_parts
    from .derived import references

    return missing_parts(references(spark, sf), ["ACGT", "TTTTTTTTTT", "GATTACA"])


@query("D12_shared_amplicons", WITH + f"SELECT ref_seq, CAST(count(DISTINCT sample) AS BIGINT) AS n_samples, {_N} AS n_reads FROM reads GROUP BY ref_seq")
def shared_amplicons(spark, sf):
    per = reads(spark, sf).groupBy("ref_seq", "sample").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("ref_seq").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("n").alias("n_reads"))


@query("J01_modification_summary", WITH + f"SELECT ref_name, sample, kind, pos, n, n / CAST((SELECT count(*) FROM vars v WHERE v.sample = t.sample AND v.ref_name = t.ref_name) AS DOUBLE) AS fraction FROM (SELECT sample, ref_name, kind, pos, {_N} AS n FROM ({_IN}) AS u GROUP BY ALL) AS t")
def modification_summary(spark, sf):
    v = variants(spark, sf)
    return M.fractions(P.edit_positions(v, ["sample", "ref_name"], in_window=True), M.totals(v, ["sample", "ref_name"]), ["sample", "ref_name"])


@query("J01_nucleotide_fractions", WITH + f"SELECT sample, ref_name, pos, base, n, n / CAST(sum(n) OVER (PARTITION BY sample, ref_name, pos) AS DOUBLE) AS fraction FROM (SELECT sample, ref_name, pos, base, CAST(sum(n) AS BIGINT) AS n FROM ({_PILE}) AS t GROUP BY ALL) AS u")
def nucleotide_fractions(spark, sf):
    a = alleles(spark, sf)
    return M.fractions(P.nucleotides(a, ["sample", "ref_name"]), M.totals(a, ["sample", "ref_name"]), ["sample", "ref_name"])


@query("J02_window_fractions", WITH + f"SELECT sample, ref_name, pos, base, CAST(sum(n) AS BIGINT) AS n FROM ({_PILE}) AS t WHERE pos BETWEEN 22 AND 41 GROUP BY ALL")
def window_fractions(spark, sf):
    return P.nucleotides(alleles(spark, sf), ["sample", "ref_name"]).where(F.col("pos").between(22, 41))


@query("J03_guide_consensus", WITH + "SELECT ref_name, count(DISTINCT p % 2) = 1 AS agree FROM (SELECT ref_name, sample, min(p % 2) AS p FROM reads GROUP BY ALL) AS t GROUP BY ref_name")
def guide_consensus(spark, sf):
    from ..operators.guides import agree

    g = reads(spark, sf).groupBy("ref_name", "sample").agg(F.min(F.col("p") % 2).alias("w"))
    return agree(g.select("ref_name", "sample", F.lit("g").alias("guide"), F.array("w").alias("window")), ["ref_name"])


@query("J05_batch_quantification", WITH + f"SELECT sample AS batch, ref_name, {_N} AS n_reads, {_count('modified')} AS modified, {_count('ins_w')} AS insertions, {_count('del_w')} AS deletions, {_count('sub_w')} AS substitutions FROM vars GROUP BY sample, ref_name")
def batch_quantification(spark, sf):
    return Z.editing(variants(spark, sf), ["sample", "ref_name"]).select(F.col("sample").alias("batch"), "ref_name", "n_reads", "modified", "insertions", "deletions", "substitutions")


@query("J07_amplicon_information", WITH + f"SELECT ref_seq, CAST(count(DISTINCT sample) AS BIGINT) AS n_samples, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM reads GROUP BY ref_seq")
def amplicon_information(spark, sf):
    return M.amplicon_information(reads(spark, sf).select("ref_seq", "sample").distinct(), "ref_seq", "sample")


@query("F34_sample_summary", WITH + f"SELECT sample, {_N} AS n_reads, {_count('modified')} AS modified, {_count('NOT modified')} AS unmodified, 100.0 * {_count('modified')} / CAST(count(*) AS DOUBLE) AS modified_pct FROM vars GROUP BY sample")
def sample_summary(spark, sf):
    return M.summary(Z.editing(variants(spark, sf), ["sample", "ref_name"]), ["sample"]).select("sample", "n_reads", "modified", "unmodified", "modified_pct")


@query("F30_guide_categories", WITH + f"SELECT sample, category, {_N} AS n_reads FROM (SELECT sample, CASE WHEN sub_w OR del_w OR (e = 'I' AND p BETWEEN 31 AND 33) THEN 'MODIFIED cut' ELSE 'UNMODIFIED' END AS category FROM vars) AS t GROUP BY ALL")
def guide_categories(spark, sf):
    from ..operators.guides import by_guide

    return by_guide(variants(spark, sf), {"cut": WINDOW}, ["sample"])


@query("F29_frameshift_rollup", WITH + f"SELECT sample, {_count('modified AND change % 3 <> 0')} AS frameshift, {_count('modified AND change % 3 = 0')} AS in_frame FROM (SELECT *, CASE WHEN ins_w OR del_w THEN k ELSE 0 END AS change FROM vars) AS t GROUP BY sample")
def frameshift_rollup(spark, sf):
    whole = F.array(*map(F.lit, range(64)))
    per = Z.frames(variants(spark, sf), ["sample", "ref_name"], whole, F.array().cast("array<int>"))
    return per.groupBy("sample").agg(F.sum("frameshift").alias("frameshift"), F.sum("in_frame").alias("in_frame"))


@query("F41_top_unaligned", WITH + f"SELECT read_seq, n_reads FROM (SELECT read_seq, {_N} AS n_reads FROM reads WHERE e = 'N' GROUP BY read_seq) AS t ORDER BY n_reads DESC, read_seq LIMIT 10")
def top_unaligned(spark, sf):
    return A.unique_reads(reads(spark, sf).where("e = 'N'"), [], "read_seq").orderBy(F.desc("n_reads"), "read_seq").limit(10)


@query("G01_running_sum", WITH + f"SELECT sample, size, n, CAST(sum(n) OVER (PARTITION BY sample ORDER BY size) AS BIGINT) AS running FROM (SELECT sample, CAST(n_del AS INT) AS size, {_N} AS n FROM vars GROUP BY ALL) AS t")
def running_sum(spark, sf):
    h = P.sizes(variants(spark, sf), ["sample"]).where("kind = 'deletion'").drop("kind")
    return h.withColumn("running", F.sum("n").over(W.partitionBy("sample").orderBy("size")))


@query("G02_rank", WITH + f"SELECT sample, ref_name, n_reads, CAST(rank() OVER (PARTITION BY sample ORDER BY n_reads DESC) AS INT) AS rank FROM (SELECT sample, ref_name, {_N} AS n_reads FROM reads GROUP BY ALL) AS t")
def rank(spark, sf):
    t = reads(spark, sf).groupBy("sample", "ref_name").agg(F.count(F.lit(1)).alias("n_reads"))
    return t.withColumn("rank", F.rank().over(W.partitionBy("sample").orderBy(F.desc("n_reads"))))


@query("G04_labels", WITH + "SELECT ref_name, CAST(row_number() OVER (ORDER BY ref_name) AS INT) AS label FROM (SELECT DISTINCT ref_name FROM reads) AS t")
def labels(spark, sf):
    return reads(spark, sf).select("ref_name").distinct().withColumn("label", F.row_number().over(W.orderBy("ref_name")))


@query("G05_cumulative_sizes", WITH + f"SELECT ref_name, CAST(sum(n) OVER (ORDER BY ref_name) AS BIGINT) AS upto FROM (SELECT ref_name, {_N} AS n FROM reads GROUP BY ref_name) AS t")
def cumulative_sizes(spark, sf):
    t = reads(spark, sf).groupBy("ref_name").agg(F.count(F.lit(1)).alias("n"))
    return t.select("ref_name", F.sum("n").over(W.orderBy("ref_name")).alias("upto"))


@query("G06_previous_count", WITH + f"SELECT sample, ref_name, n_reads, lag(n_reads) OVER (PARTITION BY sample ORDER BY n_reads DESC, ref_name) AS previous FROM (SELECT sample, ref_name, {_N} AS n_reads FROM reads GROUP BY ALL) AS t")
def previous_count(spark, sf):
    t = reads(spark, sf).groupBy("sample", "ref_name").agg(F.count(F.lit(1)).alias("n_reads"))
    return t.withColumn("previous", F.lag("n_reads").over(W.partitionBy("sample").orderBy(F.desc("n_reads"), "ref_name")))


@query("H03_demux_order", "SELECT chr, start, n_reads FROM (SELECT CAST(o_custkey % 5 AS INT) AS chr, o_custkey AS start, CAST(count(*) AS BIGINT) AS n_reads FROM orders GROUP BY ALL) AS t ORDER BY chr, start")
def demux_order(spark, sf):
    return demultiplexed(spark, sf).select("chr", "start", "n_reads").orderBy("chr", "start")


@query("H04_region_order", "SELECT c, n_reads FROM (SELECT o_custkey AS c, CAST(count(*) AS BIGINT) AS n_reads FROM orders GROUP BY o_custkey) AS t ORDER BY n_reads DESC, c")
def region_order(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n_reads")).orderBy(F.desc("n_reads"), "c")


@query("H05_homology_order", WITH + "SELECT aln_seq, score FROM (SELECT aln_seq, max(CASE e WHEN 'S' THEN 63.0 WHEN 'D' THEN 64.0 - k ELSE 64.0 END / CAST(CASE e WHEN 'I' THEN 64 + k ELSE 64 END AS DOUBLE)) AS score FROM reads GROUP BY aln_seq) AS t ORDER BY score DESC, aln_seq DESC")
def homology_order(spark, sf):
    from ..functions.sequences import homology

    a = alleles(spark, sf).groupBy("aln_seq").agg(F.max(homology(F.col("aln_seq"), F.col("aln_ref"))).alias("score"))
    return a.orderBy(F.desc("score"), F.desc("aln_seq"))


@query("H06_combination_order", WITH + f"SELECT e, n, first_seen FROM (SELECT e, {_N} AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM reads GROUP BY e) AS t ORDER BY n DESC, first_seen")
def combination_order(spark, sf):
    return reads(spark, sf).groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("H08_summary_order", WITH + f"SELECT ref_name, {_N} AS n_reads FROM reads GROUP BY ref_name ORDER BY ref_name")
def summary_order(spark, sf):
    return reads(spark, sf).groupBy("ref_name").agg(F.count(F.lit(1)).alias("n_reads")).orderBy("ref_name")


@query("H10_limits", WITH + "SELECT l_orderkey, l_linenumber, read_seq FROM reads ORDER BY l_orderkey, l_linenumber, read_seq LIMIT 100")
def limits(spark, sf):
    return reads(spark, sf).select("l_orderkey", "l_linenumber", "read_seq").orderBy("l_orderkey", "l_linenumber", "read_seq").limit(100)


@query("I01_union_of_samples", WITH + f"SELECT sample, {_N} AS n_reads FROM reads GROUP BY sample UNION ALL SELECT 'all', {_N} FROM reads")
def union_of_samples(spark, sf):
    per = reads(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).alias("n_reads"))
    return per.unionByName(per.agg(F.lit("all").alias("sample"), F.sum("n_reads").alias("n_reads")))


@query("I02_union_of_scores", WITH + "SELECT DISTINCT read_seq, 'aligned' AS kind FROM reads WHERE e <> 'N' UNION ALL SELECT DISTINCT read_seq, 'exact' FROM reads WHERE e = 'N'")
def union_of_scores(spark, sf):
    r = reads(spark, sf)
    pick = lambda t, k: r.where(t).select("read_seq").distinct().withColumn("kind", F.lit(k))
    return pick("e <> 'N'", "aligned").union(pick("e = 'N'", "exact"))


@query("I03_concatenated_reads", WITH + f"SELECT length(read_seq) AS length, {_N} AS n FROM (SELECT read_seq FROM reads WHERE e = 'D' UNION ALL SELECT read_seq FROM reads WHERE e = 'I') AS t GROUP BY ALL")
def concatenated_reads(spark, sf):
    r = reads(spark, sf)
    return r.where("e = 'D'").select("read_seq").union(r.where("e = 'I'").select("read_seq")).groupBy(F.length("read_seq").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("I04_distinct_amplicons", WITH + "SELECT DISTINCT ref_seq FROM reads")
def distinct_amplicons(spark, sf):
    return reads(spark, sf).select("ref_seq").distinct()


@query("I05_position_difference", WITH + "SELECT DISTINCT ref_name, p AS pos FROM vars WHERE e = 'S' AND p NOT IN (31, 32)")
def position_difference(spark, sf):
    v = variants(spark, sf)
    return v.select("ref_name", F.explode(F.array_except("edits.all_substitution_positions", F.array(F.lit(31), F.lit(32)))).alias("pos")).distinct()


@query("I06_position_intersection", WITH + f"SELECT ref_name, pos, {_N} AS n FROM (SELECT ref_name, CAST(unnest(range(p, p + k)) AS INT) AS pos FROM vars WHERE del_w) AS t GROUP BY ALL")
def position_intersection(spark, sf):
    v = variants(spark, sf)
    both = F.array_intersect("edits.all_deletion_positions", "edits.deletion_positions")
    return v.select("ref_name", "n_reads", F.explode(both).alias("pos")).groupBy("ref_name", "pos").agg(F.sum("n_reads").alias("n"))


@query("I07_amplicons_in_both", WITH + "SELECT ref_name FROM reads WHERE sample = 'O' INTERSECT SELECT ref_name FROM reads WHERE sample = 'F'")
def amplicons_in_both(spark, sf):
    r = reads(spark, sf)
    return r.where("sample = 'O'").select("ref_name").intersect(r.where("sample = 'F'").select("ref_name"))


@query("F26_upset_subset", WITH + f"""SELECT combination, n_reads, CAST(rank AS INT) AS rank FROM (SELECT *, rank() OVER (ORDER BY n_reads DESC) AS rank FROM (SELECT concat(CASE WHEN sub_w THEN 'S' ELSE '' END, CASE WHEN del_w THEN 'D' ELSE '' END, CASE WHEN ins_w THEN 'I' ELSE '' END) AS combination, {_N} AS n_reads FROM vars GROUP BY ALL) AS c) AS t WHERE n_reads >= 5 AND rank <= 3""")
def upset_subset(spark, sf):
    from ..operators.base_edits import membership, subset

    mark = lambda k, c: F.when(F.col(f"edits.{k}_n") > 0, c).otherwise("")
    v = variants(spark, sf).groupBy(F.concat(mark("substitution", "S"), mark("deletion", "D"), mark("insertion", "I")).alias("combination")).agg(F.sum("n_reads").alias("n_reads"))
    return subset(membership(v), min_size=5, max_rank=3).select("combination", "n_reads", "rank")
