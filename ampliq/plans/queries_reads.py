"""Queries: reads, sequence functions, filters, unique reads, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qualities as Q
from ..functions import sequences as S
from ..operators import alleles as A
from .derived import WITH, alleles, reads, references, table
from .registry import query


@query("A03_unique_reads", WITH + "SELECT sample, read_seq, CAST(count(*) AS BIGINT) AS n_reads FROM reads GROUP BY sample, read_seq")
def unique_reads(spark, sf):
    return A.unique_reads(reads(spark, sf), ["sample"], "read_seq")


@query(
    "A04_unique_pairs",
    WITH + """SELECT r1 AS seq1, r2 AS seq2, CAST(count(*) AS BIGINT) AS n_reads, arg_min(q1, o) AS qual1, arg_min(q2, o) AS qual2 FROM (
  SELECT substr(read_seq, 1, 40) AS r1, substr(read_seq, 25) AS r2, substr(qual, 1, 40) AS q1, substr(qual, 25) AS q2, l_orderkey * 10 + l_linenumber AS o FROM reads) AS t GROUP BY r1, r2""",
)
def unique_pairs(spark, sf):
    r = reads(spark, sf).select(F.substring("read_seq", 1, 40).alias("seq1"), F.expr("substr(read_seq, 25)").alias("seq2"), F.substring("qual", 1, 40).alias("qual1"), F.expr("substr(qual, 25)").alias("qual2"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return A.unique_pairs(r, [], "o")


@query("A07_count_reads", WITH + "SELECT sample, CAST(count(*) AS BIGINT) AS n_reads FROM reads GROUP BY sample")
def count_reads(spark, sf):
    return reads(spark, sf).groupBy("sample").agg(F.count(F.lit(1)).alias("n_reads"))


@query("A08_count_by_flag", "SELECT CAST(count(*) AS BIGINT) AS n_primary FROM orders WHERE (CAST(o_custkey AS INT) & 2304) = 0")
def count_by_flag(spark, sf):
    from ..operators.regions import excluding_flags

    return excluding_flags(table(spark, sf, "orders").select(F.col("o_custkey").cast("int").alias("flag")), 0x900).agg(F.count(F.lit(1)).alias("n_primary"))


@query("A09_average_read_length", WITH + "SELECT sample, CAST(floor(avg(length(read_seq))) AS INT) AS read_length FROM reads GROUP BY sample")
def average_read_length(spark, sf):
    return reads(spark, sf).groupBy("sample").agg(F.floor(F.avg(F.length("read_seq"))).cast("int").alias("read_length"))


@query("A10_split_interleaved", WITH + "SELECT CAST(l_linenumber % 2 AS INT) AS mate, CAST(count(*) AS BIGINT) AS n_reads, CAST(sum(length(read_seq)) AS BIGINT) AS bases FROM reads GROUP BY l_linenumber % 2")
def split_interleaved(spark, sf):
    r = reads(spark, sf).withColumn("mate", (F.col("l_linenumber") % 2).cast("int"))
    return r.groupBy("mate").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("read_seq")).alias("bases"))


@query(
    "A12_amplicon_checks",
    WITH + """SELECT ref_name, CAST(length(ref_seq) AS INT) AS length, regexp_matches(ref_seq, '[^ACGTN]') AS bad_bases,
  CAST((SELECT count(*) FROM (SELECT DISTINCT ref_seq FROM reads) b WHERE b.ref_seq = a.ref_seq) AS BIGINT) AS same,
  CAST((SELECT count(*) FROM (SELECT DISTINCT ref_seq FROM reads) b WHERE b.ref_seq = reverse(translate(a.ref_seq, 'ACGT', 'TGCA'))) AS BIGINT) AS turned
FROM (SELECT DISTINCT ref_name, ref_seq FROM reads) a""",
)
def amplicon_checks(spark, sf):
    from ..sources.tables import amplicon_problems

    return amplicon_problems(references(spark, sf).withColumnsRenamed({"ref_seq": "amplicon_seq"})).select("ref_name", "length", "bad_bases", "same", "turned")


@query("A16_reference_fetch", WITH + "SELECT ref_name, substr(ref_seq, 21, 20) AS ref_seq FROM (SELECT DISTINCT ref_name, ref_seq FROM reads) a")
def reference_fetch(spark, sf):
    from ..operators.regions import fetched

    contigs = references(spark, sf).select(F.col("ref_name").alias("chr"), F.col("ref_seq").alias("seq"))
    return fetched(contigs, contigs.select("chr", F.lit(20).alias("start"), F.lit(40).alias("end"))).select(F.col("chr").alias("ref_name"), "ref_seq")


@query("B01_reverse_complement", WITH + "SELECT DISTINCT read_seq, reverse(translate(upper(read_seq), 'ACGT', 'TGCA')) AS turned FROM reads")
def reverse_complement(spark, sf):
    return reads(spark, sf).select("read_seq").distinct().withColumn("turned", S.reverse_complement(F.col("read_seq")))


@query("B02_reverse", WITH + "SELECT DISTINCT aln_seq, reverse(upper(aln_seq)) AS turned FROM reads")
def reverse(spark, sf):
    return reads(spark, sf).select("aln_seq").distinct().withColumn("turned", S.reverse(F.col("aln_seq")))


@query(
    "B03_illegal_bases",
    "SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_filter(string_split(upper(p_name), ''), lambda c: c NOT IN ('A', 'C', 'G', 'T', 'N')))), 'string_agg', '') AS illegal FROM part",
)
def illegal_bases(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.nullif(F.array_join(S.illegal_bases(F.col("p_name")), ""), F.lit("")).alias("illegal"))


@query("B04_capitalised", "SELECT p_partkey, upper(p_name) AS name FROM part")
def capitalised(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.capitalised(F.col("p_name")).alias("name"))


@query("B05_slug", "SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name), '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_+', '_', 'g') AS slug FROM part")
def slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


_AMINO = "map {" + ", ".join(f"'{c}': '{a}'" for c, a in S.AMINO.items()) + "}"


@query(
    "B06_translation",
    WITH + f"""SELECT ref_name, array_to_string(list_transform(range(0, CAST(floor(length(ref_seq) / 3) AS BIGINT)), lambda i: {_AMINO}[substr(ref_seq, CAST(3 * i + 1 AS BIGINT), 3)]), '') AS protein
FROM (SELECT DISTINCT ref_name, ref_seq FROM reads) a""",
)
def translation(spark, sf):
    return references(spark, sf).select("ref_name", S.translated(F.col("ref_seq")).alias("protein"))


@query(
    "B09_alignment_cigar",
    WITH + """SELECT DISTINCT ref_name, aln_seq, CASE e WHEN 'D' THEN concat(CAST(p AS VARCHAR), 'M', CAST(k AS VARCHAR), 'D', CAST(64 - p - k AS VARCHAR), 'M')
  WHEN 'I' THEN concat(CAST(p AS VARCHAR), 'M', CAST(k AS VARCHAR), 'I', CAST(64 - p AS VARCHAR), 'M') ELSE '64M' END AS cigar FROM reads""",
)
def alignment_cigar(spark, sf):
    return alleles(spark, sf).select("ref_name", "aln_seq", S.alignment_cigar(F.col("aln_seq"), F.col("aln_ref")).alias("cigar")).distinct()


@query("B10_cigar_lengths", WITH + "SELECT DISTINCT ref_name, aln_seq, CAST(64 AS BIGINT) AS ref_length, CAST(length(read_seq) AS BIGINT) AS read_length FROM reads")
def cigar_lengths(spark, sf):
    c = alignment_cigar(spark, sf)
    return c.select("ref_name", "aln_seq", S.cigar_length(F.col("cigar"), "MDN=X").alias("ref_length"), S.cigar_length(F.col("cigar"), "MIS=X").alias("read_length")).distinct()


@query(
    "B13_clip_extended",
    "SELECT s_suppkey, 100 * s_suppkey - s_suppkey % 7 AS start, 100 * s_suppkey + 50 + s_suppkey % 5 AS stop FROM supplier",
)
def clip_extended(spark, sf):
    part = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    s = table(spark, sf, "supplier").withColumn("cigar", F.concat(part(F.col("s_suppkey") % 7), F.lit("30M5I5D15M"), part(F.col("s_suppkey") % 5)))
    start, stop = S.clip_extended(100 * F.col("s_suppkey"), F.col("cigar"))
    return s.select("s_suppkey", start.alias("start"), stop.alias("stop"))


@query("B14_homology", WITH + "SELECT DISTINCT ref_name, aln_seq, CASE e WHEN 'S' THEN 63.0 WHEN 'D' THEN 64.0 - k WHEN 'I' THEN 64.0 ELSE 64.0 END / CAST(CASE e WHEN 'I' THEN 64 + k ELSE 64 END AS DOUBLE) AS homology FROM reads")
def homology(spark, sf):
    return alleles(spark, sf).select("ref_name", "aln_seq", S.homology(F.col("aln_seq"), F.col("aln_ref")).alias("homology")).distinct()


@query("B18_contains_inside", WITH + "SELECT read_seq, strpos(read_seq, 'GATT') > 1 OR strpos(read_seq, 'AATC') > 1 AS found FROM (SELECT DISTINCT read_seq FROM reads) a")
def contains_inside(spark, sf):
    return reads(spark, sf).select("read_seq").distinct().withColumn("found", S.contains_inside(F.col("read_seq"), F.lit("GATT")))


@query(
    "B19_display_class",
    WITH + """SELECT label, CAST(count(*) AS BIGINT) AS n_reads FROM (SELECT CASE WHEN ref_name = 'R0' AND NOT modified THEN 'R0' WHEN ref_name = 'R0' THEN 'NHEJ' WHEN ref_name = 'R1' AND NOT modified THEN 'R1'
  WHEN ref_name = 'R1' THEN 'Imperfect R1' ELSE ref_name END AS label FROM vars) AS t GROUP BY label""",
)
def display_class(spark, sf):
    from ..operators.edits import modified
    from .derived import variants

    return variants(spark, sf).groupBy(S.display_class(F.col("ref_name"), modified(), "R0", "R1").alias("label")).agg(F.sum("n_reads").alias("n_reads"))


_QUALS = "list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)"


@query("C01_min_quality", WITH + f"SELECT l_orderkey, l_linenumber FROM reads WHERE list_min({_QUALS}) >= 2")
def min_quality(spark, sf):
    return Q.filtered(reads(spark, sf), min_single=2, mates=(("read_seq", "qual"),)).select("l_orderkey", "l_linenumber")


@query("C02_mean_quality", WITH + f"SELECT l_orderkey, l_linenumber FROM reads WHERE CAST(list_sum({_QUALS}) AS DOUBLE) / length(qual) >= 22")
def mean_quality(spark, sf):
    return Q.filtered(reads(spark, sf), min_mean=22, mates=(("read_seq", "qual"),)).select("l_orderkey", "l_linenumber")


_MASKED = f"array_to_string(list_transform(list_zip(string_split(read_seq, ''), {_QUALS}), lambda x: CASE WHEN x[2] < 10 THEN 'N' ELSE x[1] END), '')"


@query("C03_masked_bases", WITH + f"SELECT l_orderkey, l_linenumber, {_MASKED} AS read_seq FROM reads")
def masked_bases(spark, sf):
    return Q.filtered(reads(spark, sf), mask_below=10, mates=(("read_seq", "qual"),)).select("l_orderkey", "l_linenumber", "read_seq")


@query("C04_all_quality_filters", WITH + f"SELECT l_orderkey, l_linenumber, {_MASKED} AS read_seq FROM reads WHERE list_min({_QUALS}) >= 2 AND CAST(list_sum({_QUALS}) AS DOUBLE) / length(qual) >= 20")
def all_quality_filters(spark, sf):
    return Q.filtered(reads(spark, sf), 2, 20, 10, (("read_seq", "qual"),)).select("l_orderkey", "l_linenumber", "read_seq")


@query(
    "C05_paired_quality",
    WITH + """SELECT l_orderkey, l_linenumber FROM (SELECT *, list_transform(string_split(substr(qual, 1, 30), ''), lambda c: ascii(c) - 33) AS a, list_transform(string_split(substr(qual, 31), ''), lambda c: ascii(c) - 33) AS b FROM reads) AS t
WHERE CAST(list_sum(a) AS DOUBLE) / len(a) >= 20 AND CAST(list_sum(b) AS DOUBLE) / len(b) >= 20""",
)
def paired_quality(spark, sf):
    r = reads(spark, sf).select("l_orderkey", "l_linenumber", F.substring("read_seq", 1, 30).alias("s1"), F.expr("substr(read_seq, 31)").alias("s2"), F.substring("qual", 1, 30).alias("q1"), F.expr("substr(qual, 31)").alias("q2"))
    return Q.filtered(r, min_mean=20, mates=(("s1", "q1"), ("s2", "q2"))).select("l_orderkey", "l_linenumber")


@query("C07_sequence_presence", WITH + "SELECT sample, CAST(count(*) AS BIGINT) AS n_reads FROM reads WHERE (contains(read_seq, 'GATT') OR contains(read_seq, 'ACGT')) AND NOT contains(read_seq, 'TTTT') GROUP BY sample")
def sequence_presence(spark, sf):
    return Q.by_presence(reads(spark, sf), ["GATT", "ACGT"], ["TTTT"], ("read_seq",)).groupBy("sample").agg(F.count(F.lit(1)).alias("n_reads"))


@query("C07_presence_counts", WITH + "SELECT part, CAST(count(*) FILTER (WHERE contains(read_seq, part)) AS BIGINT) AS n FROM reads, (VALUES ('GATT'), ('ACGT'), ('TTTT')) AS v(part) GROUP BY part")
def presence_counts(spark, sf):
    return Q.presence_counts(reads(spark, sf), ["GATT", "ACGT", "TTTT"], "read_seq")


@query("E22_most_frequent_reads", WITH + "SELECT sample, read_seq, n_reads FROM (SELECT sample, read_seq, CAST(count(*) AS BIGINT) AS n_reads, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, read_seq) AS rn FROM reads GROUP BY sample, read_seq) AS t WHERE rn <= 10")
def most_frequent_reads(spark, sf):
    from pyspark.sql import Window as W

    u = A.unique_reads(reads(spark, sf), ["sample"], "read_seq")
    return u.withColumn("rn", F.row_number().over(W.partitionBy("sample").orderBy(F.desc("n_reads"), "read_seq"))).where("rn <= 10").drop("rn")


@query("E25_force_merged_pairs", WITH + "SELECT l_orderkey, l_linenumber, concat(substr(read_seq, 1, 30), reverse(translate(substr(read_seq, 31), 'ACGT', 'TGCA'))) AS seq, concat(substr(qual, 1, 30), substr(qual, 31)) AS qual FROM reads")
def force_merged_pairs(spark, sf):
    from ..operators.pairs import force_merged

    r = reads(spark, sf).select("l_orderkey", "l_linenumber", F.substring("read_seq", 1, 30).alias("seq1"), F.expr("substr(read_seq, 31)").alias("seq2"), F.substring("qual", 1, 30).alias("qual1"), F.expr("substr(qual, 31)").alias("qual2"))
    return force_merged(r).select("l_orderkey", "l_linenumber", "seq", "qual")


@query("J13_reconstituted_reads", WITH + "SELECT sample, read_seq, CAST(count(*) AS BIGINT) AS n_reads FROM reads GROUP BY sample, read_seq")
def reconstituted_reads(spark, sf):
    return A.reconstituted(alleles(spark, sf)).groupBy("sample", "read_seq").agg(F.count(F.lit(1)).alias("n_reads"))


@query(
    "D13_strand_merged",
    WITH + """SELECT sample, arg_min(seq, o) AS seq, CAST(sum(n) AS BIGINT) AS n_reads, min(o) AS first_seen FROM (
  SELECT sample, seq, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS key, CAST(count(*) AS BIGINT) AS n, min(l_orderkey * 10 + l_linenumber) AS o
  FROM (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN read_seq ELSE reverse(translate(read_seq, 'ACGT', 'TGCA')) END AS seq FROM reads) AS r GROUP BY sample, seq) AS t GROUP BY sample, key""",
)
def strand_merged(spark, sf):
    r = reads(spark, sf).withColumn("seq", F.when(F.col("l_orderkey") % 2 == 0, F.col("read_seq")).otherwise(S.reverse_complement(F.col("read_seq")))).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.strand_merged(A.unique_reads(r, ["sample"], "seq", "o"), ["sample"]).select("sample", "seq", "n_reads", "first_seen")


@query("D02_annotated_reads", WITH + "SELECT l_orderkey, l_linenumber, read_seq, CAST(count(*) OVER (PARTITION BY sample, read_seq) AS BIGINT) AS n_reads FROM reads")
def annotated_reads(spark, sf):
    return A.annotated(reads(spark, sf).select("l_orderkey", "l_linenumber", "sample", "read_seq"), ["sample"], "read_seq").drop("sample")


@query("D11_pairs_seen_again", WITH + "SELECT l_orderkey, l_linenumber FROM reads WHERE (sample, read_seq) IN (SELECT (sample, read_seq) FROM reads GROUP BY sample, read_seq HAVING count(*) > 20)")
def pairs_seen_again(spark, sf):
    return A.seen_often(reads(spark, sf).select("l_orderkey", "l_linenumber", "sample", "read_seq"), ["sample"], 20, "read_seq").select("l_orderkey", "l_linenumber")
