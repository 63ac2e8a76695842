"""Queries: whole analyses and operators that need an aligner."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amino, guess, guide_search, prime
from ..operators import references as R
from ..operators.align import alignments, best_alignments
from ..operators.alleles import allele_table, unique_reads
from .derived import REFS, WINDOW, WITH, reads, references, variants
from .fisher import BY_KIND, fisher_sql
from .modes import batch, compared, paired, pooled
from .queries_edits import _N, SEEN, _count, seen
from .registry import query

NAMES = [f"R{k}" for k in range(REFS)]


def _refs(spark, sf, names):
    """References of 64 bases whose guide cuts between positions 31 and 32."""
    seqs = {r["ref_name"]: r["ref_seq"] for r in references(spark, sf).where(F.col("ref_name").isin(names)).collect()}  # a handful
    return [R.build(n, seqs[n], [seqs[n][15:35]], skip_left=5, skip_right=5, plot=10) for n in names]


def _raw(spark, sf):
    return reads(spark, sf).select("sample", F.col("read_seq").alias("seq"))


@query("J08_pooled", WITH + f"SELECT ref_name, {SEEN} FROM vars GROUP BY ref_name")
def pooled_rates(spark, sf):
    return seen(pooled(_raw(spark, sf), _refs(spark, sf, NAMES), 100)["variants"], ["ref_name"])


@query("J08_pooled_rates", WITH + f"SELECT ref_name, {_N} AS n_reads, CASE WHEN count(*) > 100 THEN {_count('sub_w')} END AS substitutions FROM vars GROUP BY ref_name")
def pooled_enough(spark, sf):
    return pooled(_raw(spark, sf), _refs(spark, sf, NAMES), 100)["editing"].select("ref_name", "n_reads", "substitutions")


@query("J05_batch_from_reads", WITH + f"SELECT sample, ref_name, {SEEN} FROM vars GROUP BY sample, ref_name")
def batch_rates(spark, sf):
    return seen(batch(_raw(spark, sf), _refs(spark, sf, NAMES))["variants"], ["sample", "ref_name"])


@query("J10_compare", WITH + f"SELECT ref_name, kind, CAST(sum(CASE WHEN least(1.0, 64 * p) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant, CAST(sum(CASE WHEN least(1.0, 64 * p) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant_window FROM ({fisher_sql(BY_KIND, 'ref_name, kind, pos')}) AS t GROUP BY ref_name, kind")
def compare_samples(spark, sf):
    refs = _refs(spark, sf, NAMES)
    return compared(variants(spark, sf), refs, "O", "F")["significant"]


@query("E08_paired_variants", WITH + f"SELECT sample, ref_name, {_N} AS n_reads, {_count('sub_w')} AS substitutions FROM vars GROUP BY sample, ref_name")
def paired_variants(spark, sf):
    r = reads(spark, sf).select("sample", F.substring("read_seq", 1, 45).alias("seq1"), F.expr("substr(read_seq, 20)").alias("seq2"), F.substring("qual", 1, 45).alias("qual1"), F.expr("substr(qual, 20)").alias("qual2"))
    found = paired(r, _refs(spark, sf, NAMES), ["sample"])
    return found.groupBy("sample", "ref_name").agg(F.sum("n_reads").alias("n_reads"), F.sum(F.when(F.col("edits.substitution_n") > 0, F.col("n_reads")).otherwise(0)).alias("substitutions"))


@query("F14_from_first_reference")
def from_first_reference(spark, sf):
    """Reads under the reference they fit best, with their edits seen from the first one; ambiguous reads count for none."""
    refs = [r.as_row() for r in _refs(spark, sf, NAMES)]
    counts = unique_reads(_raw(spark, sf), [], "seq")
    owned = best_alignments(counts, refs).where("n_best = 1").select("seq", "n_reads", "ref_name")
    return prime.from_first(alignments(counts.select("seq"), refs[:1]), owned, NAMES[0], WINDOW).groupBy("assigned_ref").agg(F.sum("n_reads").alias("n_reads"), F.sum(F.col("edits.substitution_n") * F.col("n_reads")).alias("substitutions"))


@query("F19_amino_acid_alleles")
def amino_acid_alleles(spark, sf):
    return amino.amino_alleles(allele_table(variants(spark, sf), ["sample"]), ["sample", "ref_name"], 10, 15, 7)


#: What follows position 31 in the read and in the reference.
_REST = "CASE WHEN e = 'I' AND p < 32 THEN substr(aln_seq, 33 + k) ELSE substr(aln_seq, 33) END"


@query("F28_scaffold_sizes", WITH + f"""SELECT sample, CAST(list_max(list_transform(range(0, 8), lambda n: CASE WHEN substr(replace({_REST}, '-', ''), 1, n) = substr('GATTACA', 1, n) THEN n ELSE 0 END)) AS INT) AS matched,
  CAST(CASE WHEN e = 'I' AND p = 32 THEN k ELSE 0 END AS INT) AS gap, {_N} AS n_reads FROM reads GROUP BY ALL""")
def scaffold_sizes(spark, sf):
    return prime.scaffold_sizes(variants(spark, sf), 32, "GATTACA", ["sample"])


@query("E23_guessed_amplicons")
def guessed_amplicons(spark, sf):
    """From all reads: at a share of 0.02 only the 50 most frequent ones can be looked at."""
    r = _raw(spark, sf)
    counted = [(x["seq"], x["n_reads"]) for x in guess.most_frequent(r, None).collect()]  # at most 1,000 sequences
    return spark.createDataFrame([(k, s) for k, s in enumerate(guess.amplicons(counted, r.count(), 0.02))], "rank int, amplicon string")


@query("E24_guessed_guide")
def guessed_guide(spark, sf):
    """One guide per reference, from all of its reads."""
    r = reads(spark, sf).select("ref_name", F.col("read_seq").alias("seq"))
    found = guess.guides(r, {x.name: x.seq for x in _refs(spark, sf, NAMES)}, min_share=0.001, min_fold=1.0)
    return spark.createDataFrame(found, "ref_name string, guide string, base_editor boolean")


@query("E12_guide_placement", WITH + "SELECT DISTINCT ref_name, substr(ref_seq, 16, 20) AS guide, CAST(15 AS INT) AS start, CAST(34 AS INT) AS stop, CAST(31 AS INT) AS cut, '31,32' AS quantified, CAST(22 AS INT) AS plot_start, CAST(41 AS INT) AS plot_stop FROM reads")
def guide_placement(spark, sf):
    rows = [(r.name, g.seq, g.start, g.end, g.cut, ",".join(map(str, r.window)), g.plot[0], g.plot[-1]) for r in _refs(spark, sf, NAMES) for g in r.guides]
    return spark.createDataFrame(rows, "ref_name string, guide string, start int, stop int, cut int, quantified string, plot_start int, plot_stop int")


#: Guides with one base changed, laid on both strands of every reference at every place, and where they differ.
_SITES = """, amps AS (SELECT DISTINCT ref_name, ref_seq FROM reads),
asked AS (SELECT ref_name AS guide_name, concat(substr(ref_seq, 16, 4), translate(substr(ref_seq, 20, 1), 'ACGT', 'CGTA'), substr(ref_seq, 21, 15)) AS guide FROM amps),
laid AS (SELECT *, '+' AS strand, guide AS laid FROM asked UNION ALL SELECT *, '-', reverse(translate(guide, 'ACGT', 'TGCA')) FROM asked),
put AS (SELECT guide_name, ref_name, strand, CAST(place AS INT) AS start, laid, substr(ref_seq, CAST(place AS INT) + 1, 20) AS found FROM laid, amps, range(0, 45) AS t(place)),
seen AS (SELECT *, list_filter(range(0, 20), lambda i: substr(found, CAST(i AS INT) + 1, 1) <> substr(laid, CAST(i AS INT) + 1, 1)) AS wrong FROM put)
SELECT guide_name, ref_name, strand, start, CASE strand WHEN '+' THEN found ELSE reverse(translate(found, 'ACGT', 'TGCA')) END AS site, CAST(len(wrong) AS INT) AS n_mismatches,
  array_to_string(CASE strand WHEN '+' THEN wrong ELSE list_reverse(list_transform(wrong, lambda i: 19 - i)) END, ',') AS mismatches FROM seen WHERE len(wrong) <= 8"""


@query("E20_guide_sites", WITH + _SITES)
def guide_sites(spark, sf):
    """Every place on any reference, on either strand, where a guide with one changed base fits with at most eight mismatches."""
    refs = references(spark, sf)
    changed = F.concat(F.substring("ref_seq", 16, 4), F.translate(F.substring("ref_seq", 20, 1), "ACGT", "CGTA"), F.substring("ref_seq", 21, 15))
    found = guide_search.sites(refs, refs.select(F.col("ref_name").alias("guide_name"), changed.alias("guide")), 8)
    return found.select("guide_name", "ref_name", "strand", "start", "site", "n_mismatches", F.array_join(F.col("mismatches").cast("array<string>"), ",").alias("mismatches"))


@query("E14_cloned_windows", WITH + "SELECT DISTINCT ref_name, array_to_string(list_concat(range(5, 15), range(47, 57)), ',') AS there FROM reads")
def cloned_windows(spark, sf):
    """The windows 5-14 and 50-59 of every reference on itself without three bases between the two."""
    target = F.concat(F.substring("ref_seq", 1, 32), F.expr("substr(ref_seq, 36)"))
    pairs = references(spark, sf).select("ref_name", F.col("ref_seq").alias("source_seq"), target.alias("target_seq"), F.lit("5-14_50-59").alias("coordinates"))
    return guide_search.with_cloned_windows(pairs).select("ref_name", F.array_join(F.col("window").cast("array<string>"), ",").alias("there"))
