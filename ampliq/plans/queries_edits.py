"""Queries: edits, positions, rates, alleles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import alleles as A
from ..operators import positions as P
from ..operators import quantify as Z
from ..operators.edits import modified, with_edits
from .derived import CUT, WINDOW, WITH, alleles, reads, ref_bases, reference_rows, table, variants
from .registry import query

KEYS = ["sample", "ref_name"]
_N = "CAST(count(*) AS BIGINT)"


def _count(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"


@query(
    "E05_called_edits",
    WITH + """SELECT DISTINCT ref_name, aln_seq, CAST(CASE WHEN e = 'S' THEN 1 ELSE 0 END AS INT) AS substitutions, CAST(CASE WHEN e = 'D' THEN k ELSE 0 END AS INT) AS deleted, CAST(CASE WHEN e = 'I' THEN 1 ELSE 0 END AS INT) AS insertions,
  CAST(CASE WHEN sub_w THEN 1 ELSE 0 END AS INT) AS substitution_n, CAST(n_del AS INT) AS deletion_n, CAST(n_ins AS INT) AS insertion_n FROM vars""",
)
def called_edits(spark, sf):
    return variants(spark, sf).select("ref_name", "aln_seq", F.size("edits.all_substitution_positions").alias("substitutions"), F.size("edits.all_deletion_positions").alias("deleted"), F.size("edits.all_insertion_left_positions").alias("insertions"), "edits.substitution_n", "edits.deletion_n", "edits.insertion_n").distinct()


@query("C09_window_membership", WITH + f"SELECT {_count('sub_w')} AS substitution, {_count('del_w')} AS deletion, {_count('ins_w')} AS insertion FROM vars")
def window_membership(spark, sf):
    count = lambda k: F.sum(F.when(F.col(f"edits.{k}_n") > 0, F.col("n_reads")).otherwise(0)).alias(k)
    return variants(spark, sf).agg(*[count(k) for k in ("substitution", "deletion", "insertion")])


@query("C10_modified_reads", WITH + f"SELECT sample, ref_name, {_count('modified')} AS modified, {_count('NOT modified')} AS unmodified FROM vars GROUP BY sample, ref_name")
def modified_reads(spark, sf):
    return Z.editing(variants(spark, sf), KEYS).select(*KEYS, "modified", "unmodified")


@query("C10_modified_ignoring_substitutions", WITH + f"SELECT sample, ref_name, {_count('del_w OR ins_w')} AS modified FROM vars GROUP BY sample, ref_name")
def modified_ignoring(spark, sf):
    return Z.editing(variants(spark, sf), KEYS, ignore=("substitution",)).select(*KEYS, "modified")


@query("C11_discarded_indels", WITH + f"SELECT sample, ref_name, {_count('del_w OR ins_w')} AS discarded, {_count('NOT (del_w OR ins_w)')} AS n_reads FROM vars GROUP BY sample, ref_name")
def discarded_indels(spark, sf):
    return Z.editing(variants(spark, sf), KEYS, discard_indels=True).select(*KEYS, "discarded", "n_reads")


@query("C12_irregular_ends", WITH + f"SELECT sample, {_count('l_linenumber = 1 OR k = 2')} AS irregular, {_N} AS n_reads FROM vars GROUP BY sample")
def irregular_ends(spark, sf):
    """Some reads lack their first base, some have another last one."""
    r = reads(spark, sf).withColumn("aln_seq", F.when(F.col("l_linenumber") == 1, F.concat(F.lit("-"), F.expr("substr(aln_seq, 2)"))).otherwise(F.col("aln_seq")))
    r = r.withColumn("aln_seq", F.when(F.col("k") == 2, F.expr("concat(substr(aln_seq, 1, length(aln_seq) - 1), translate(right(aln_seq, 1), 'ACGT', 'CGTA'))")).otherwise(F.col("aln_seq")))
    counts = r.groupBy("sample", "ref_name", "aln_seq", "aln_ref").agg(F.count(F.lit(1)).alias("n_reads"))
    return with_edits(counts, reference_rows()).groupBy("sample").agg(F.sum(F.when(F.col("edits.irregular_ends"), F.col("n_reads")).otherwise(0)).alias("irregular"), F.sum("n_reads").alias("n_reads"))


@query("C13_enough_reads", WITH + f"SELECT sample, ref_name, {_N} AS n_reads FROM reads GROUP BY sample, ref_name HAVING count(*) >= 1450")
def enough_reads(spark, sf):
    from ..operators.regions import enough

    return enough(reads(spark, sf).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_reads")), 1450, strict=False)


@query(
    "C14_frequent_alleles",
    WITH + """SELECT aln_seq, aln_ref, n_reads FROM (SELECT aln_seq, aln_ref, CAST(count(*) AS BIGINT) AS n_reads, 100.0 * count(*) / (SELECT count(*) FROM reads) AS pct FROM reads GROUP BY aln_seq, aln_ref) AS t
WHERE pct >= 0.01 ORDER BY n_reads DESC, aln_seq, aln_ref LIMIT 50""",
)
def frequent_alleles(spark, sf):
    return A.frequent(A.with_percent(A.collapsed(alleles(spark, sf), []), []), 0.01, 50).select("aln_seq", "aln_ref", "n_reads")


@query("F01_run_statistics", WITH + """SELECT CAST(count(*) AS BIGINT) AS n_aligned, CAST(sum(CASE WHEN sub_w THEN 1 ELSE 0 END) AS BIGINT) AS substitution_n, CAST(sum(CASE WHEN e = 'S' AND NOT sub_w THEN 1 ELSE 0 END) AS BIGINT) AS substitutions_outside_window,
  CAST(sum(n_sub + n_del + n_ins) AS BIGINT) AS mods_in_window, CAST(max(length(read_seq)) AS INT) AS read_length FROM vars""")
def run_statistics(spark, sf):
    v = variants(spark, sf)
    return Z.run_statistics(v, v.where("false")).select("n_aligned", "substitution_n", "substitutions_outside_window", "mods_in_window", "read_length")


@query("F02_class_counts", WITH + f"SELECT sample, concat(ref_name, CASE WHEN modified THEN '_MODIFIED' ELSE '_UNMODIFIED' END) AS class_name, {_N} AS n FROM vars GROUP BY ALL")
def class_counts(spark, sf):
    return Z.class_counts(variants(spark, sf), ["sample"])


@query(
    "F03_editing_quantification",
    WITH + f"""SELECT sample, ref_name, {_N} AS n_reads, {_count('modified')} AS modified, {_count('NOT modified')} AS unmodified, CAST(0 AS BIGINT) AS discarded,
  {_count('ins_w')} AS insertions, {_count('del_w')} AS deletions, {_count('sub_w')} AS substitutions,
  {_count('ins_w AND NOT del_w AND NOT sub_w')} AS only_insertions, {_count('NOT ins_w AND del_w AND NOT sub_w')} AS only_deletions, {_count('NOT ins_w AND NOT del_w AND sub_w')} AS only_substitutions,
  {_count('ins_w AND del_w AND NOT sub_w')} AS insertions_and_deletions, {_count('ins_w AND NOT del_w AND sub_w')} AS insertions_and_substitutions, {_count('NOT ins_w AND del_w AND sub_w')} AS deletions_and_substitutions,
  {_count('ins_w AND del_w AND sub_w')} AS insertions_deletions_and_substitutions,
  100.0 * count(*) FILTER (WHERE modified) / CAST(count(*) AS DOUBLE) AS modified_pct, 100.0 * count(*) FILTER (WHERE NOT modified) / CAST(count(*) AS DOUBLE) AS unmodified_pct
FROM vars GROUP BY sample, ref_name""",
)
def editing_quantification(spark, sf):
    return Z.editing(variants(spark, sf), KEYS)


_ALL = """SELECT sample, ref_name, 'substitution' AS kind, p AS pos FROM vars WHERE e = 'S'
  UNION ALL SELECT sample, ref_name, 'deletion', CAST(unnest(range(p, p + k)) AS INT) FROM vars WHERE e = 'D'
  UNION ALL SELECT sample, ref_name, 'insertion', unnest([p - 1, p]) FROM vars WHERE e = 'I'"""
_IN = """SELECT sample, ref_name, 'substitution' AS kind, p AS pos FROM vars WHERE sub_w
  UNION ALL SELECT sample, ref_name, 'deletion', CAST(unnest(range(p, p + k)) AS INT) FROM vars WHERE del_w
  UNION ALL SELECT sample, ref_name, 'insertion', unnest([p - 1, p]) FROM vars WHERE ins_w"""


@query("F04_all_edit_positions", WITH + f"SELECT sample, ref_name, kind, pos, {_N} AS n FROM ({_ALL} UNION ALL SELECT sample, ref_name, 'insertion_left', p - 1 FROM vars WHERE e = 'I') AS t GROUP BY ALL UNION ALL SELECT sample, ref_name, 'total', pos, {_N} FROM ({_ALL}) AS t GROUP BY ALL")
def all_edit_positions(spark, sf):
    return P.with_totals(P.edit_positions(variants(spark, sf), KEYS), KEYS)


@query("F05_window_edit_positions", WITH + f"SELECT sample, ref_name, kind, pos, {_N} AS n FROM ({_IN}) AS t GROUP BY ALL")
def window_edit_positions(spark, sf):
    return P.edit_positions(variants(spark, sf), KEYS, in_window=True)


@query("F06_substitution_bases", WITH + f"SELECT sample, ref_name, p AS pos, substr(aln_seq, p + 1, 1) AS base, {_N} AS n FROM vars WHERE e = 'S' GROUP BY ALL")
def substitution_bases(spark, sf):
    return P.substitution_bases(variants(spark, sf), KEYS)


@query("F06_window_substitution_bases", WITH + f"SELECT sample, ref_name, p AS pos, substr(aln_seq, p + 1, 1) AS base, {_N} AS n FROM vars WHERE sub_w GROUP BY ALL")
def window_substitution_bases(spark, sf):
    return P.substitution_bases(variants(spark, sf), KEYS, in_window=True)


#: The aligned read without the columns of insertions, base by base.
_PILE = """SELECT sample, ref_name, CAST(i AS INT) AS pos, substr(CASE WHEN e = 'I' THEN concat(substr(aln_seq, 1, p), substr(aln_seq, p + k + 1)) ELSE aln_seq END, CAST(i + 1 AS BIGINT), 1) AS base, n FROM
  (SELECT sample, ref_name, aln_seq, e, p, k, CAST(count(*) AS BIGINT) AS n FROM vars GROUP BY ALL) AS a, range(64) AS r(i)"""


@query("F07_nucleotide_pileup", WITH + f"SELECT sample, ref_name, pos, base, CAST(sum(n) AS BIGINT) AS n FROM ({_PILE}) AS t GROUP BY ALL")
def nucleotide_pileup(spark, sf):
    return P.nucleotides(alleles(spark, sf), KEYS)


_SIZES = "SELECT sample, ref_name, 'insertion' AS kind, CAST(n_ins AS INT) AS size FROM vars UNION ALL SELECT sample, ref_name, 'deletion', CAST(n_del AS INT) FROM vars UNION ALL SELECT sample, ref_name, 'substitution', n_sub FROM vars"


@query("F08_size_histograms", WITH + f"SELECT sample, ref_name, kind, CAST(size AS INT) AS size, {_N} AS n FROM ({_SIZES}) AS t GROUP BY ALL")
def size_histograms(spark, sf):
    return P.sizes(variants(spark, sf), KEYS)


@query("F08_zero_filled", WITH + f"""SELECT k.sample, k.kind, CAST(b.size AS INT) AS size, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT sample, kind FROM ({_SIZES}) AS t) AS k CROSS JOIN range(0, 11) AS b(size)
  LEFT JOIN (SELECT sample, kind, size, {_N} AS n FROM ({_SIZES}) AS t GROUP BY ALL) AS h ON h.sample = k.sample AND h.kind = k.kind AND h.size = b.size""")
def zero_filled_histograms(spark, sf):
    return P.zero_filled(P.sizes(variants(spark, sf), ["sample"]), ["sample", "kind"], 0, 10)


@query("F09_mean_deletion_size", WITH + "SELECT sample, ref_name, pos, sum(CAST(k AS DOUBLE)) / count(*) AS mean_size FROM (SELECT sample, ref_name, k, CAST(unnest(range(p, p + k)) AS INT) AS pos FROM vars WHERE del_w) AS t GROUP BY ALL")
def mean_deletion_size(spark, sf):
    return P.mean_sizes(variants(spark, sf), KEYS, "deletion")


@query("F09_mean_insertion_size", WITH + "SELECT sample, ref_name, pos, sum(CAST(k AS DOUBLE)) / count(*) AS mean_size FROM (SELECT sample, ref_name, k, unnest([p - 1, p]) AS pos FROM vars WHERE ins_w) AS t GROUP BY ALL")
def mean_insertion_size(spark, sf):
    return P.mean_sizes(variants(spark, sf), KEYS, "insertion")


_EXON = "range(10, 33)"


@query(
    "F10_frameshifts",
    WITH + f"""SELECT sample, ref_name, {_count("modified AND coding AND change % 3 <> 0")} AS frameshift, {_count("modified AND coding AND change % 3 = 0")} AS in_frame, {_count("modified AND NOT coding")} AS non_coding,
  {_count("(sub_w AND p IN (33, 34)) OR (del_w AND p + k > 33) OR (ins_w AND p IN (33, 34))")} AS splice_sites
FROM (SELECT *, CASE WHEN sub_w THEN p <= 32 WHEN del_w THEN p <= 32 WHEN ins_w THEN p - 1 <= 32 ELSE FALSE END AS coding,
  CASE WHEN ins_w THEN k WHEN del_w THEN least(p + k, 33) - p ELSE 0 END AS change FROM vars) AS t GROUP BY ALL""",
)
def frameshifts(spark, sf):
    exon = F.array(*map(F.lit, range(10, 33)))
    return Z.frames(variants(spark, sf), KEYS, exon, F.array(F.lit(33), F.lit(34)))


@query("F11_splice_sites", WITH + f"SELECT ref_name, {_count('(sub_w AND p = 32) OR (del_w AND p + k > 32) OR (ins_w AND p = 32)')} AS splice_sites FROM vars GROUP BY ref_name")
def splice_sites(spark, sf):
    return Z.frames(variants(spark, sf), ["ref_name"], F.array(*map(F.lit, range(10, 32))), F.array(F.lit(32), F.lit(33))).select("ref_name", "splice_sites")


@query("F12_non_coding_positions", WITH + f"SELECT ref_name, kind, pos, {_N} AS n FROM ({_IN}) AS t WHERE NOT (pos BETWEEN 10 AND 31) GROUP BY ALL")
def non_coding_positions(spark, sf):
    return P.edit_positions(variants(spark, sf), ["ref_name"], in_window=True).where(~F.col("pos").isin(list(range(10, 32))))


@query("F13_percent_vectors", WITH + f"""SELECT t.ref_name, t.kind, t.pos, t.n, 100.0 * t.n / CAST(a.n AS DOUBLE) AS pct FROM (SELECT ref_name, kind, pos, {_N} AS n FROM ({_IN}) AS u GROUP BY ALL) AS t
  JOIN (SELECT ref_name, count(*) AS n FROM vars GROUP BY ref_name) AS a ON a.ref_name = t.ref_name""")
def percent_vectors(spark, sf):
    v = variants(spark, sf)
    return P.percents(P.edit_positions(v, ["ref_name"], in_window=True), v.groupBy("ref_name").agg(F.sum("n_reads").alias("n_reads")), ["ref_name"])


@query("F15_allele_table", WITH + f"""SELECT t.*, 100.0 * n_reads / CAST((SELECT count(*) FROM reads r WHERE r.sample = t.sample) AS DOUBLE) AS pct_reads FROM (
  SELECT sample, ref_name, aln_seq, aln_ref, CASE WHEN modified THEN 'MODIFIED' ELSE 'UNMODIFIED' END AS read_status, CAST(n_del AS INT) AS n_deleted, CAST(n_ins AS INT) AS n_inserted, n_sub AS n_mutated, {_N} AS n_reads FROM vars GROUP BY ALL) AS t""")
def allele_table(spark, sf):
    return A.allele_table(variants(spark, sf), ["sample"])


#: Columns around the cut: from where position 31 is, ten to the left with it and eight to the right.
_AT = "(CASE WHEN e = 'I' AND p <= 31 THEN 32 + k ELSE 32 END)"


@query("F16_alleles_around_cut", WITH + f"""SELECT sample, ref_name, substr(aln_seq, {_AT} - 9, 18) AS aln_seq, substr(aln_ref, {_AT} - 9, 18) AS aln_ref, NOT modified AS unedited, CAST(n_del AS INT) AS n_deleted, CAST(n_ins AS INT) AS n_inserted, n_sub AS n_mutated, {_N} AS n_reads
FROM vars GROUP BY ALL""")
def alleles_around_cut(spark, sf):
    return A.around_cut(A.allele_table(variants(spark, sf), ["sample"]), KEYS, F.lit(CUT), 10, 8)


@query("F18_target_base_alleles", WITH + """, c AS (SELECT sample, ref_name, list_filter(list_zip(string_split(aln_seq, ''), string_split(aln_ref, '')), lambda x: x[2] = 'C') AS z FROM reads)
SELECT sample, ref_name, array_to_string(list_transform(z, lambda x: x[1]), '') AS aln_seq, array_to_string(list_transform(z, lambda x: x[2]), '') AS aln_ref, CAST(count(*) AS BIGINT) AS n_reads FROM c GROUP BY ALL""")
def target_base_alleles(spark, sf):
    return A.at_target_base(alleles(spark, sf), KEYS, "C")


@query("F20_collapsed_alleles", WITH + f"SELECT aln_seq, aln_ref, {_N} AS n_reads FROM reads GROUP BY ALL")
def collapsed_alleles(spark, sf):
    return A.collapsed(alleles(spark, sf), [])


@query("F21_percent_by_reference", WITH + f"SELECT t.*, 100.0 * n_reads / CAST(sum(n_reads) OVER (PARTITION BY ref_name) AS DOUBLE) AS pct_reads FROM (SELECT ref_name, aln_seq, {_N} AS n_reads FROM reads GROUP BY ALL) AS t")
def percent_by_reference(spark, sf):
    return A.with_percent(alleles(spark, sf).groupBy("ref_name", "aln_seq").agg(F.sum("n_reads").alias("n_reads")), ["ref_name"])


@query("F22_homology_scores", WITH + f"""SELECT sample, read_seq, max(CASE e WHEN 'S' THEN 63.0 WHEN 'D' THEN 64.0 - k ELSE 64.0 END / CAST(CASE e WHEN 'I' THEN 64 + k ELSE 64 END AS DOUBLE)) AS score, {_N} AS n_reads FROM reads GROUP BY sample, read_seq""")
def homology_scores(spark, sf):
    a = alleles(spark, sf).withColumn("score", S.homology(F.col("aln_seq"), F.col("aln_ref"))).withColumn("read_seq", F.translate("aln_seq", "-", ""))
    return a.groupBy("sample", "read_seq").agg(F.max("score").alias("score"), F.sum("n_reads").alias("n_reads"))


@query("F23_base_changes", WITH + f"SELECT sample, substr(ref_seq, p + 1, 1) AS ref_base, substr(aln_seq, p + 1, 1) AS base, {_N} AS n FROM vars WHERE e = 'S' GROUP BY ALL")
def base_changes(spark, sf):
    seen = P.substitution_bases(variants(spark, sf), KEYS).join(ref_bases(spark, sf), ["ref_name", "pos"])
    return P.base_changes(seen, ["sample"])


_REFBASE = "(SELECT DISTINCT ref_name, ref_seq FROM reads)"


@query("F24_selected_nucleotides", WITH + f"SELECT t.ref_name, pos, base, CAST(sum(n) AS BIGINT) AS n FROM ({_PILE}) AS t JOIN {_REFBASE} AS r ON r.ref_name = t.ref_name WHERE substr(ref_seq, pos + 1, 1) = 'C' GROUP BY ALL")
def selected_nucleotides(spark, sf):
    return P.selected(P.nucleotides(alleles(spark, sf), ["ref_name"]), ref_bases(spark, sf), "C").select("ref_name", "pos", "base", "n")


@query("F27_conversion_rates", WITH + f"""SELECT t.sample, t.ref_name, pos, coalesce(sum(n) FILTER (WHERE base = 'G') / nullif(CAST(sum(n) FILTER (WHERE base IN ('C', 'G')) AS DOUBLE), 0), 0.0) AS rate FROM ({_PILE}) AS t JOIN {_REFBASE} AS r ON r.ref_name = t.ref_name
  WHERE substr(ref_seq, pos + 1, 1) = 'C' GROUP BY ALL""")
def conversion_rates(spark, sf):
    return P.conversion_rates(P.nucleotides(alleles(spark, sf), KEYS), KEYS, ref_bases(spark, sf), "C", "G")


@query("F44_other_base_shares", WITH + f"""SELECT ref_name, pos, base, n, n / CAST(sum(n) OVER (PARTITION BY ref_name, pos) AS DOUBLE) AS share FROM (SELECT t.ref_name, pos, base, CAST(sum(n) AS BIGINT) AS n FROM ({_PILE}) AS t JOIN {_REFBASE} AS r ON r.ref_name = t.ref_name
  WHERE substr(ref_seq, pos + 1, 1) = 'C' AND base <> 'C' GROUP BY ALL) AS u""")
def other_base_shares(spark, sf):
    return P.other_shares(selected_nucleotides(spark, sf), ["ref_name"], "C")


@query("F40_percentile_cut", WITH + f"""SELECT kind, min(size) AS cut FROM (SELECT kind, size, sum(n) OVER (PARTITION BY kind ORDER BY size) AS run, sum(n) OVER (PARTITION BY kind) AS total FROM (SELECT kind, CAST(size AS INT) AS size, {_N} AS n FROM ({_SIZES}) AS t GROUP BY ALL) AS h) AS r
WHERE run > 0.97 * total GROUP BY kind""")
def percentile_cut(spark, sf):
    return P.percentile_cut(P.sizes(variants(spark, sf), []), ["kind"], 0.97)


@query("F31_high_quality_bases", WITH + f"SELECT sample, substr(read_seq, 31, 1) AS base, {_count('ascii(substr(qual, 31, 1)) - 33 >= 30')} AS high, {_count('ascii(substr(qual, 31, 1)) - 33 < 30')} AS low FROM reads GROUP BY ALL")
def high_quality_bases(spark, sf):
    r = reads(spark, sf).withColumn("q", F.ascii(F.substring("qual", 31, 1)) - 33)
    return r.groupBy("sample", F.substring("read_seq", 31, 1).alias("base")).agg(F.count_if(F.col("q") >= 30).alias("high"), F.count_if(F.col("q") < 30).alias("low"))


@query("F42_compiled_references", WITH + """, a AS (SELECT ref_name, aln_seq, CAST(count(*) AS BIGINT) AS n_reads FROM reads GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ref_name ORDER BY n_reads DESC, aln_seq) AS rank, n_reads / CAST(sum(n_reads) OVER (PARTITION BY ref_name) AS DOUBLE) AS share FROM a)
SELECT ref_name, ref_seq, n_reads, CAST(row_number() OVER (PARTITION BY ref_name ORDER BY n_reads DESC, aln_seq) AS INT) AS rank FROM (SELECT ref_name, replace(aln_seq, '-', '') AS ref_seq, max(n_reads) AS n_reads, arg_min(aln_seq, rank) AS aln_seq FROM r WHERE rank = 1 OR share >= 0.02 GROUP BY ALL) AS t""")
def compiled_references(spark, sf):
    return A.compiled_references(percent_by_reference(spark, sf), ["ref_name"], 0.02).select("ref_name", "ref_seq", "n_reads", "rank")


@query("B17_edit_text", WITH + "SELECT DISTINCT ref_name, aln_seq, CASE WHEN del_w THEN concat(CAST(p AS VARCHAR), '(', CAST(k AS VARCHAR), ')') ELSE '' END AS deletions FROM vars")
def edit_text(spark, sf):
    v = variants(spark, sf)
    return v.select("ref_name", "aln_seq", S.edit_text(F.transform("edits.deletion_coordinates", lambda c: c["start"]), F.col("edits.deletion_sizes")).alias("deletions")).distinct()


@query("G03_window_islands", WITH + """SELECT sample, ref_name, min(pos) AS start, max(pos) AS stop FROM (SELECT *, pos - CAST(row_number() OVER (PARTITION BY sample, ref_name ORDER BY pos) AS INT) AS island FROM (SELECT DISTINCT sample, ref_name, p AS pos FROM vars WHERE e = 'S') AS d) AS t GROUP BY sample, ref_name, island""")
def window_islands(spark, sf):
    seen = variants(spark, sf).select(*KEYS, F.explode("edits.all_substitution_positions").alias("pos")).distinct()
    runs = seen.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy(*KEYS).orderBy("pos")))
    return runs.groupBy(*KEYS, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("stop")).drop("island")


@query("H01_ordered_alleles", WITH + f"SELECT aln_seq, aln_ref, {_N} AS n_reads FROM reads GROUP BY ALL ORDER BY n_reads DESC, aln_seq, aln_ref")
def ordered_alleles(spark, sf):
    return A.ordered(A.collapsed(alleles(spark, sf), []))


@query("D14_guide_specific_edits", WITH + f"""SELECT category, {_N} AS n_reads FROM (SELECT CASE WHEN g1 AND g2 THEN 'MODIFIED g1 + g2' WHEN g1 THEN 'MODIFIED g1' WHEN g2 THEN 'MODIFIED g2' ELSE 'UNMODIFIED' END AS category FROM (
  SELECT coalesce((e = 'S' AND p BETWEEN 24 AND 30) OR (e = 'D' AND p <= 30 AND p + k > 24) OR (e = 'I' AND p BETWEEN 24 AND 31), FALSE) AS g1, coalesce((e = 'S' AND p BETWEEN 29 AND 36) OR (e = 'D' AND p <= 36 AND p + k > 29) OR (e = 'I' AND p BETWEEN 29 AND 37), FALSE) AS g2 FROM vars) AS t) AS u GROUP BY category""")
def guide_specific_edits(spark, sf):
    from ..operators.guides import by_guide

    return by_guide(variants(spark, sf), {"g1": list(range(24, 31)), "g2": list(range(29, 37))}, []).groupBy("category").agg(F.sum("n_reads").alias("n_reads"))


@query(
    "E02_best_reference",
    WITH + f"""SELECT sample, read_seq, {_N} AS n_reads, ref_name, ref_id AS ref_idx, round_even(100.0 * CASE e WHEN 'S' THEN 63 WHEN 'D' THEN 64 - k ELSE 64 END / CAST(CASE e WHEN 'I' THEN 64 + k ELSE 64 END AS DOUBLE), 3) AS score, '+' AS strand, CAST(1 AS INT) AS n_best
FROM reads GROUP BY sample, read_seq, ref_name, ref_id, CASE e WHEN 'S' THEN 63 WHEN 'D' THEN 64 - k ELSE 64 END, CASE e WHEN 'I' THEN 64 + k ELSE 64 END""",
)
def best_reference(spark, sf):
    """The aligner on distinct reads against all references, with the best of them. Where a gap may lie at several places, SQL doesn't know which the aligner
    takes, but the reference and the score are the same."""
    from ..operators.align import best_alignments

    r = A.unique_reads(reads(spark, sf), ["sample"], "read_seq").groupBy("read_seq").agg(F.collect_list(F.struct("sample", "n_reads")).alias("_of"))
    best = best_alignments(r, _reference_dicts(spark, sf, [f"R{k}" for k in range(20)]), seq="read_seq")
    return best.withColumn("_of", F.explode("_of")).select("read_seq", "_of.sample", "_of.n_reads", "ref_name", "ref_idx", "score", "strand", "n_best")


def _reference_dicts(spark, sf, names):
    import numpy as np

    incentive = np.zeros(65, int)
    incentive[CUT + 1] = 1
    seqs = {r["ref_name"]: r["ref_seq"] for r in table_of_references(spark, sf).where(F.col("ref_name").isin(names)).collect()}  # a handful of references
    return [{"name": n, "seq": seqs[n], "incentive": incentive, "min_score": 60.0} for n in names]


def table_of_references(spark, sf):
    from .derived import references

    return references(spark, sf)


#: What an alignment shows of reads wherever it puts their gaps.
SEEN = f"{_N} AS n_reads, {_count('sub_w')} AS substitutions, {_count("e = 'S'")} AS substituted, CAST(sum(CASE WHEN e = 'D' THEN k ELSE 0 END) AS BIGINT) AS deleted_bases, {_count("e = 'I'")} AS inserted"


def seen(v, keys):
    """The same from called edits: reads, those with a substitution in the window, substitutions, deleted bases and insertions."""
    total = lambda c: F.sum(c.cast("long") * F.col("n_reads"))
    return v.groupBy(*keys).agg(
        F.sum("n_reads").alias("n_reads"), total(F.col("edits.substitution_n") > 0).alias("substitutions"), total(F.size("edits.all_substitution_positions")).alias("substituted"),
        total(F.size("edits.all_deletion_positions")).alias("deleted_bases"), total(F.size("edits.all_insertion_left_positions")).alias("inserted"),
    )


@query("E07_variants_by_alignment", WITH + f"SELECT sample, ref_name, {SEEN} FROM vars GROUP BY sample, ref_name")
def variants_by_alignment(spark, sf):
    """Reads aligned and their edits called: the whole core on raw reads, by what doesn't depend on where a gap is put."""
    from .analysis import called

    names = [f"R{k}" for k in range(20)]
    r = reads(spark, sf).select("sample", F.col("read_seq").alias("seq"))
    return seen(called(r, _reference_dicts(spark, sf, names), {n: WINDOW for n in names}, ["sample"]), KEYS)


#: The reference with the inserted bases in place, and how far an edit moves left in it.
_TEXT = "(CASE WHEN e = 'I' THEN concat(substr(ref_seq, 1, p), substr('GATTACA', 1, k)) ELSE ref_seq END)"
_LEFT = f"(p - (coalesce(list_min(list_filter(range(1, p + 1), lambda j: substr({_TEXT}, p - j + 1, 1) <> substr({_TEXT}, p + k - j + 1, 1))), p + 1) - 1))"


@query(
    "F32_vcf_edits",
    WITH + f"""SELECT t.*, n_reads / CAST((SELECT count(*) FROM reads r WHERE r.sample = t.sample) AS DOUBLE) AS frequency FROM (SELECT sample, concat('chr', CAST(ref_id AS VARCHAR)) AS chr, CAST(1000 + p AS BIGINT) AS pos, substr(ref_seq, p + 1, 1) AS ref, substr(aln_seq, p + 1, 1) AS alt, {_N} AS n_reads FROM vars WHERE sub_w GROUP BY ALL
UNION ALL SELECT sample, concat('chr', CAST(ref_id AS VARCHAR)), CAST(999 + {_LEFT} AS BIGINT), substr(ref_seq, {_LEFT}, k + 1), substr(ref_seq, {_LEFT}, 1), {_N} FROM vars WHERE del_w GROUP BY ALL
UNION ALL SELECT sample, concat('chr', CAST(ref_id AS VARCHAR)), CAST(999 + {_LEFT} AS BIGINT), substr(ref_seq, {_LEFT}, 1), substr({_TEXT}, {_LEFT}, k + 1), {_N} FROM vars WHERE ins_w GROUP BY ALL) AS t""",
)
def vcf_edits(spark, sf):
    from ..sources.vcf import edit_counts

    return edit_counts(variants(spark, sf), {f"R{k}": (f"chr{k}", 1000) for k in range(20)}, ["sample"])


_CHECKS = {
    "total_reads": (10000, "n < 10000", "n"), "aligned_share": (0.9, "n <= 0.9 * n", "1.0"), "share_in_window": (0.01, "mods > 0 AND mods_in <= 0.01 * mods", "mods_in / mods"), "ends_modified": (0.01, "FALSE", "0.0"),
    "outside_window_substitutions": (0.002, "subs_out >= 0.002 * subs", "subs_out / subs"), "substitution_rate": (0.3, "subs >= 0.3 * mods", "subs / mods"),
}
_EACH = "(SELECT DISTINCT ref_name, ref_seq FROM reads) AS a"


@query(
    "F35_guardrails",
    WITH + """, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(n_sub + n_del + n_ins) AS DOUBLE) AS mods_in, CAST(sum(CASE e WHEN 'S' THEN 1 WHEN 'D' THEN k WHEN 'I' THEN 1 ELSE 0 END) AS DOUBLE) AS mods, CAST(sum(CASE WHEN e = 'S' THEN 1 ELSE 0 END) AS DOUBLE) AS subs,
  CAST(sum(CASE WHEN e = 'S' AND NOT sub_w THEN 1 ELSE 0 END) AS DOUBLE) AS subs_out, CAST(max(length(aln_seq)) AS DOUBLE) AS longest FROM vars)
"""
    + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", CAST(NULL AS VARCHAR) AS subject, CAST({v} AS DOUBLE) AS value, CAST({x} AS DOUBLE) AS \"limit\", {t} AS raised FROM s" for c, (x, t, v) in _CHECKS.items())
    + f""" UNION ALL SELECT 'amplicon_length', ref_name, 64.0, 50.0, FALSE FROM {_EACH} UNION ALL SELECT 'guide_length', substr(ref_seq, 16, 20), 20.0, 19.0, FALSE FROM {_EACH}
UNION ALL SELECT 'amplicon_to_read_length', ref_name, 64.0 / longest, 1.5, 64.0 > 1.5 * longest FROM s, {_EACH}
UNION ALL SELECT 'proportion', ref_name, c / (n / 20), 0.9, c <= 0.9 * n / 20 OR c >= 0.1 * n / 20 FROM s, (SELECT ref_name, CAST(count(*) AS DOUBLE) AS c FROM reads GROUP BY ref_name) AS b""",
)
def guardrails(spark, sf):
    from .derived import references

    v, seqs = variants(spark, sf), {r["ref_name"]: r["ref_seq"] for r in references(spark, sf).collect()}  # 20 references
    return Z.guardrails(Z.run_statistics(v, v.where("false")), v.groupBy("ref_name").agg(F.sum("n_reads").alias("n_reads")), {k: len(s) for k, s in seqs.items()}, {s[15:35]: 20 for s in seqs.values()})


@query("H09_coordinate_sorted", "SELECT o_orderkey, CAST(o_custkey % 5 AS INT) AS chr, o_custkey AS pos FROM orders")
def coordinate_sorted(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("chr"), F.col("o_custkey").alias("pos"))
    return o.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos")


__all__ = ["modified"]
