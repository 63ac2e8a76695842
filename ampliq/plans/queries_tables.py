"""Queries: published tables, values at reference positions, stored alleles, pooled modes on mapped reads, runs compared region by region."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import annotation, contains_fragment, values_at_reference
from ..operators import alleles as A
from ..operators import base_edits as B
from ..operators import compare as C
from ..operators import multi as M
from ..operators import positions as P
from ..operators import quantify as Z
from ..operators import references as R
from ..operators.align import rc
from ..sources.files import shared_folder, stored
from ..sources.sinks import EDITING_NAMES, publish_lines, published_lines
from .derived import CUT, REFS, WINDOW, WITH, alleles, reads, references, table, variants
from .fisher import BY_KIND, BY_POSITION, fisher_sql
from .modes import pooled_mixed, pooled_on_genome, regions_compared
from .queries_edits import _ALL, _AT, _IN, _N, _PILE, KEYS, _count
from .queries_modes import NAMES, _refs
from .queries_samples import _tests
from .registry import query
from .tables import VECTORS, around_guides, guides_of, published

#: What a read has at reference position i, by construction.
_VALUE = "(CASE WHEN e = 'I' AND i = p - 1 THEN concat(substr(ref_seq, i + 1, 1), substr('GATTACA', 1, k)) WHEN e = 'I' THEN substr(ref_seq, i + 1, 1) ELSE substr(aln_seq, i + 1, 1) END)"
_CODE = f"(CASE WHEN {_VALUE} = 'C' THEN 'R' WHEN {_VALUE} = 'T' THEN 'T' WHEN {_VALUE} = '-' THEN 'D' WHEN length({_VALUE}) <> 1 THEN 'I' ELSE 'N' END)"


@query("B15_reference_values", WITH + f"SELECT sample, ref_name, CAST(i AS INT) AS pos, {_VALUE} AS value, {_N} AS n_reads FROM reads, range(64) AS r(i) GROUP BY ALL")
def reference_values(spark, sf):
    long = alleles(spark, sf).select(*KEYS, "n_reads", F.posexplode(values_at_reference(F.col("aln_seq"), F.col("aln_ref"))).alias("pos", "value"))
    return long.groupBy(*KEYS, "pos", "value").agg(F.sum("n_reads").alias("n_reads"))


@query(
    "B17_annotations",
    WITH + """SELECT DISTINCT ref_name, aln_seq, concat('D', CAST(CAST(n_del AS INT) AS VARCHAR), ';I', CAST(CAST(n_ins AS INT) AS VARCHAR), ';S', CAST(n_sub AS VARCHAR)) AS mods, CASE WHEN del_w THEN concat(CAST(p AS VARCHAR), '(', CAST(k AS VARCHAR), ')') ELSE '' END AS del,
  CASE WHEN ins_w THEN concat(CAST(p - 1 AS VARCHAR), '(', CAST(k AS VARCHAR), '+', substr('GATTACA', 1, k), ')') ELSE '' END AS ins, CASE WHEN sub_w THEN CAST(p AS VARCHAR) ELSE '' END AS sub FROM vars""",
)
def annotations(spark, sf):
    return variants(spark, sf).select("ref_name", "aln_seq", *[c.alias(n.lower()) for n, c in annotation().items()]).distinct()


@query("B18_contains_fragment", WITH + "SELECT read_seq, strpos(read_seq, 'GAT') > 1 OR strpos(read_seq, 'ATC') > 1 AS found FROM (SELECT DISTINCT read_seq FROM reads) a")
def contains_fragments(spark, sf):
    return reads(spark, sf).select("read_seq").distinct().withColumn("found", contains_fragment(F.col("read_seq"), "CCCGATCCC"))


_RUN = """SELECT sample, ref_seq, CASE WHEN ref_id % 3 = 0 THEN sample ELSE substr(ref_seq, 16, 20) END AS guide, CAST(31 + CASE WHEN ref_id % 4 = 1 AND sample = 'F' THEN 1 ELSE 0 END AS INT) AS cut,
  concat(sample, '_', ref_name, '.txt') AS file FROM (SELECT DISTINCT sample, ref_id, ref_name, ref_seq FROM reads) AS d"""


@query("D15_matching_allele_files", WITH + f"SELECT a.ref_seq AS sequence, a.file AS file_1, b.file AS file_2 FROM ({_RUN}) AS a JOIN ({_RUN}) AS b ON a.ref_seq = b.ref_seq AND a.cut = b.cut AND a.guide = b.guide WHERE a.sample = 'O' AND b.sample = 'F'")
def matching_allele_files(spark, sf):
    """Two runs on the same amplicons; some have another guide or cut in the second run."""
    runs = reads(spark, sf).select("sample", "ref_id", "ref_name", "ref_seq").distinct().select(
        "sample", F.col("ref_seq").alias("sequence"), F.array(F.when(F.col("ref_id") % 3 == 0, F.col("sample")).otherwise(F.substring("ref_seq", 16, 20))).alias("guides"),
        F.array(F.lit(CUT) + F.when((F.col("ref_id") % 4 == 1) & (F.col("sample") == "F"), 1).otherwise(0)).alias("cuts"), F.array(F.concat("sample", F.lit("_"), "ref_name", F.lit(".txt"))).alias("files"),
    )
    return C.matching_alleles(runs.where("sample = 'O'"), runs.where("sample = 'F'"))


@query(
    "E19_prime_editing_guides",
    WITH + """, amps AS (SELECT DISTINCT ref_name, ref_seq, concat(substr(ref_seq, 1, 36), translate(substr(ref_seq, 37, 1), 'ACGT', 'CGTA'), substr(ref_seq, 38)) AS edited FROM reads),
both_refs AS (SELECT ref_name, 'reference' AS target, ref_seq AS seq FROM amps UNION ALL SELECT ref_name, 'edited', edited FROM amps)
SELECT ref_name, target, 'PE Extension' AS guide, substr(seq, 31, 16) AS seq, CAST(0 AS INT) AS center, CAST(5 AS INT) AS size FROM both_refs UNION ALL SELECT ref_name, target, 'PE spacer sgRNA', substr(seq, 16, 20), -3, 1 FROM both_refs
UNION ALL SELECT ref_name, target, 'PE nicking sgRNA', substr(reverse(translate(seq, 'ACGT', 'TGCA')), 6, 20), -3, 1 FROM both_refs""",
)
def prime_editing_guides(spark, sf):
    """A substitution written behind the spacer of every reference: guides on the reference itself and on the edited one."""
    out = []
    for r in references(spark, sf).collect():  # 20 references
        first = r["ref_seq"]
        edited = first[:36] + first[36].translate(str.maketrans("ACGT", "CGTA")) + first[37:]
        for target, seq in (("reference", first), ("edited", edited)):
            out += [(r["ref_name"], target, *g) for g in R.prime_editing_guides(seq, first, edited, rc(edited[30:46]), first[15:35], rc(first)[5:25])]
    return spark.createDataFrame(out, "ref_name string, target string, guide string, seq string, center int, size int")


@query(
    "F17_whole_alleles_around_cut",
    WITH + f"""SELECT sample, ref_name, aln_seq AS whole_seq, aln_ref AS whole_ref, substr(aln_seq, {_AT} - 9, 20) AS aln_seq, substr(aln_ref, {_AT} - 9, 20) AS aln_ref, NOT modified AS unedited, CAST(n_del AS INT) AS n_deleted, CAST(n_ins AS INT) AS n_inserted, n_sub AS n_mutated, {_N} AS n_reads
FROM vars GROUP BY ALL""",
)
def whole_alleles_around_cut(spark, sf):
    return A.around_cut(A.allele_table(variants(spark, sf), ["sample"]), KEYS, F.lit(CUT), 10, 10, keep_whole=True)


@query(
    "J14_rewindowed_alleles",
    WITH + """, placed AS (SELECT *, CASE WHEN e = 'I' AND p <= 26 THEN 27 + k ELSE 27 END AS c FROM vars)
SELECT t.*, 100.0 * n_reads / CAST((SELECT count(*) FROM reads r WHERE r.sample = t.sample) AS DOUBLE) AS pct_reads FROM (SELECT sample, ref_name, substr(aln_seq, c - 6, 19) AS aln_seq, substr(aln_ref, c - 6, 19) AS aln_ref, NOT modified AS unedited, CAST(n_del AS INT) AS n_deleted, CAST(n_ins AS INT) AS n_inserted, n_sub AS n_mutated, CAST(count(*) AS BIGINT) AS n_reads
FROM placed GROUP BY ALL) AS t""",
)
def rewindowed_alleles(spark, sf):
    cuts = spark.createDataFrame([(n, "g", 26) for n in NAMES], "ref_name string, guide string, cut int")
    return A.rewindowed(A.allele_table(variants(spark, sf), ["sample"]), cuts, 7, 12, ["sample"]).drop("guide")


def _combination(value: str, between: str) -> str:
    places = "list_filter(range(0, 64), lambda i: substr(ref_seq, i + 1, 1) = 'C')"
    return f"array_to_string(list_transform({places}, lambda i: {value}), '{between}')"


for _form, _sql in (("category", _combination(_CODE, "")), ("binary", _combination(f"CASE WHEN {_VALUE} = 'T' THEN 'T' ELSE 'X' END", "")), ("precise", _combination(_VALUE, ","))):

    @query("F25_base_edit_combinations" if _form == "category" else f"F25_{_form}_combinations", WITH + f"SELECT sample, ref_name, {_sql} AS combination, {_N} AS n_reads FROM reads GROUP BY ALL")
    def base_edit_combinations(spark, sf, form=_form):
        return B.combinations(alleles(spark, sf), KEYS, "C", "T", form=form)


_INDEL = "(n_del > 0 OR n_ins > 0)"


@query(
    "K06_base_edit_positions",
    WITH + f"""SELECT sample, ref_name, pos, {_N} AS total, {', '.join(f"{_count(f"code = '{c}'")} AS {n}" for c, n in (('R', 'reference'), ('T', 'target'), ('D', 'deletion'), ('I', 'insertion'), ('N', 'other')))}
FROM (SELECT sample, ref_name, CAST(i AS INT) AS pos, {_CODE} AS code FROM reads, range(64) AS r(i) WHERE substr(ref_seq, i + 1, 1) = 'C') AS t GROUP BY ALL""",
)
def base_edit_positions(spark, sf):
    return B.base_edit_counts(A.allele_table(variants(spark, sf), ["sample"]), KEYS, "C", "T")["positions"]


@query(
    "K06_base_edit_reads",
    WITH + f"""SELECT sample, ref_name, {', '.join(f"{_count(f"kind = '{k}' AND {'' if i else 'NOT '}indel")} AS {k}{'_indels' if i else ''}" for k in ('reference', 'target', 'other') for i in (0, 1))}
FROM (SELECT sample, ref_name, {_INDEL} AS indel, CASE WHEN regexp_matches({_combination(_CODE, '')}, '^R*$') THEN 'reference' WHEN regexp_matches({_combination(_CODE, '')}, '^T+$') THEN 'target' ELSE 'other' END AS kind FROM vars) AS t GROUP BY ALL""",
)
def base_edit_reads(spark, sf):
    return B.base_edit_counts(A.allele_table(variants(spark, sf), ["sample"]), KEYS, "C", "T")["reads"]


@query(
    "K05_tables_around_guides",
    WITH + f"""SELECT ref_name, substr(aln_seq, {_AT} - 9, 20) AS aln_seq, substr(aln_ref, {_AT} - 9, 20) AS aln_ref, NOT modified AS unedited, {_N} AS n_reads FROM vars GROUP BY ALL""",
)
def tables_around_guides(spark, sf):
    """The allele table around the guide of every reference, in one plan."""
    found = around_guides(A.allele_table(variants(spark, sf), []), [], guides_of(spark, _refs(spark, sf, NAMES)))
    return found.groupBy("ref_name", "aln_seq", "aln_ref", "unedited").agg(F.sum("n_reads").alias("n_reads"))


def _published(spark, sf):
    """Every table of the two samples and 20 references as text, read back: sample, ref_name (or none), name, and the cells of each line but headers."""
    path = f"{shared_folder(spark)}/published"
    publish_lines(published(stored(variants(spark, sf), "variants"), _refs(spark, sf, NAMES), ["sample"]), path)
    parts = F.split("table", r"\.")
    lines = published_lines(spark, path).select(parts[0].alias("sample"), F.when(F.size(parts) > 2, parts[1]).alias("ref_name"), F.element_at(parts, -1).alias("name"), F.split("value", "\t").alias("cells"))
    return lines.where(~F.col("cells")[0].isin("", "Sequence", "Amplicon", "Aligned_Sequence"))


def _vectors(spark, sf, name, labels):
    """(sample, ref_name, kind, pos, n) of wide tables: what isn't 0."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("cells")[0])
    rows = _published(spark, sf).where(F.col("name") == name).select("sample", "ref_name", kind.alias("kind"), F.posexplode(F.slice("cells", 2, 64)).alias("pos", "n"))
    return rows.select("sample", "ref_name", "kind", "pos", F.col("n").cast("double").cast("long").alias("n")).where("n > 0")


@query("K03_count_vectors", WITH + f"""SELECT sample, ref_name, kind, pos, {_N} AS n FROM ({_ALL} UNION ALL SELECT sample, ref_name, 'insertion_left', p - 1 FROM vars WHERE e = 'I') AS t GROUP BY ALL UNION ALL SELECT sample, ref_name, 'total', pos, {_N} FROM ({_ALL}) AS t GROUP BY ALL
UNION ALL SELECT sample, ref_name, 'reads', CAST(i AS INT), {_N} FROM vars, range(64) AS r(i) GROUP BY ALL""")
def count_vectors(spark, sf):
    return _vectors(spark, sf, "Modification_count_vectors", VECTORS)


@query("K03_window_vectors", WITH + f"SELECT sample, ref_name, kind, pos, {_N} AS n FROM ({_IN}) AS t GROUP BY ALL UNION ALL SELECT sample, ref_name, 'total', pos, {_N} FROM ({_IN}) AS t GROUP BY ALL UNION ALL SELECT sample, ref_name, 'reads', CAST(i AS INT), {_N} FROM vars, range(64) AS r(i) GROUP BY ALL")
def window_vectors(spark, sf):
    return _vectors(spark, sf, "Quantification_window_modification_count_vectors", VECTORS)


@query("K04_nucleotide_table", WITH + f"SELECT sample, ref_name, base AS kind, pos, CAST(sum(n) AS BIGINT) AS n FROM ({_PILE}) AS t GROUP BY ALL")
def nucleotide_table(spark, sf):
    return _vectors(spark, sf, "Nucleotide_frequency_table", {b: b for b in P.BASES})


@query("K01_allele_file", WITH + f"SELECT sample, ref_name, aln_seq, aln_ref, modified, {_N} AS n_reads, round(100.0 * count(*) / CAST(sum(count(*)) OVER (PARTITION BY sample) AS DOUBLE), 6) AS pct FROM vars GROUP BY sample, ref_name, aln_seq, aln_ref, modified")
def allele_file(spark, sf):
    c = lambda k: F.col("cells")[k]
    rows = _published(spark, sf).where("name = 'Alleles_frequency_table'")
    return rows.select("sample", c(2).alias("ref_name"), c(0).alias("aln_seq"), c(1).alias("aln_ref"), (c(3) == "MODIFIED").alias("modified"), c(7).cast("long").alias("n_reads"), F.round(c(8).cast("double"), 6).alias("pct"))


@query("K02_editing_file", WITH + f"SELECT sample, ref_name, {_N} AS n_reads, round(100.0 * {_count('modified')} / CAST(count(*) AS DOUBLE), 6) AS modified_pct FROM vars GROUP BY sample, ref_name")
def editing_file(spark, sf):
    names = [c for c in EDITING_NAMES if c in Z.editing(variants(spark, sf), ["sample", "ref_name"]).columns]
    at = lambda c: F.col("cells")[names.index(c)]
    rows = _published(spark, sf).where("name = 'quantification_of_editing_frequency'")
    return rows.select("sample", at("ref_name").alias("ref_name"), at("n_reads").cast("long").alias("n_reads"), F.round(at("modified_pct").cast("double"), 6).alias("modified_pct"))


@query("K05_guide_files", WITH + f"SELECT sample, ref_name, substr(aln_seq, {_AT} - 9, 20) AS aln_seq, substr(aln_ref, {_AT} - 9, 20) AS aln_ref, NOT modified AS unedited, {_N} AS n_reads FROM vars GROUP BY ALL")
def guide_files(spark, sf):
    c = lambda k: F.col("cells")[k]
    rows = _published(spark, sf).where("name LIKE 'Alleles_frequency_table_around_sgRNA_%'").select("sample", "ref_name", c(0).alias("aln_seq"), c(1).alias("aln_ref"), (c(2) == "true").alias("unedited"), c(6).cast("long").alias("n"))
    return rows.groupBy("sample", "ref_name", "aln_seq", "aln_ref", "unedited").agg(F.sum("n").alias("n_reads"))


_RATES = f"SELECT sample, ref_name, 100.0 * {_count('NOT modified')} / CAST(count(*) AS DOUBLE) AS u, {_N} AS n_reads FROM vars GROUP BY ALL"


@query("J11_region_differences", WITH + f", r AS ({_RATES}) SELECT a.ref_name, a.n_reads AS n_reads_1, b.n_reads AS n_reads_2, round(a.u, 9) AS unmodified_pct_1, round(b.u, 9) AS unmodified_pct_2, round(a.u - b.u, 9) AS unmodified_diff FROM r AS a LEFT JOIN r AS b ON a.ref_name = b.ref_name AND b.sample = 'F' WHERE a.sample = 'O'")
def region_differences(spark, sf):
    d = regions_compared(variants(spark, sf), _refs(spark, sf, NAMES), "O", "F")["difference"]
    return d.select("ref_name", "n_reads_1", "n_reads_2", *[F.round(c, 9).alias(c) for c in ("unmodified_pct_1", "unmodified_pct_2", "unmodified_diff")])


@query("F36_fisher_tests", WITH + f"SELECT ref_name, pos, CAST(n_1 AS BIGINT) AS n_1, CAST(n_2 AS BIGINT) AS n_2, round(p, 8) AS p, round(least(1.0, 64 * p), 8) AS q FROM ({fisher_sql(BY_POSITION, 'ref_name, pos')}) AS t")
def fisher_tests(spark, sf):
    return _tests(spark, sf).withColumns({c: F.round(c, 8) for c in ("p", "q")})


@query("F37_significant_positions", WITH + f"""SELECT ref_name, CAST(sum(CASE WHEN least(1.0, 64 * p) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant, CAST(sum(CASE WHEN least(1.0, 64 * p) <= 0.05 AND pos IN (31, 32) THEN 1 ELSE 0 END) AS BIGINT) AS n_significant_window
FROM ({fisher_sql(BY_POSITION, 'ref_name, pos')}) AS t GROUP BY ref_name""")
def significant_positions(spark, sf):
    return C.significant(_tests(spark, sf), ["ref_name"], 0.05, WINDOW)


@query("J11_significant_positions", WITH + f"SELECT ref_name, kind, CAST(sum(CASE WHEN least(1.0, 64 * p) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant FROM ({fisher_sql(BY_KIND, 'ref_name, kind, pos')}) AS t GROUP BY ref_name, kind")
def significant_by_region(spark, sf):
    return regions_compared(stored(variants(spark, sf), "variants"), _refs(spark, sf, NAMES), "O", "F")["significant"].select("ref_name", "kind", "n_significant")


def _mapped(spark, sf):
    """The reads as mapped to a genome with a chromosome for every reference, which starts behind its thousandth base."""
    tail = F.lit(64) - F.col("p")
    cigar = F.when(F.col("e") == "D", F.concat(F.col("p"), F.lit("M"), F.col("k"), F.lit("D"), tail - F.col("k"), F.lit("M"))).when(F.col("e") == "I", F.concat(F.col("p"), F.lit("M"), F.col("k"), F.lit("I"), tail, F.lit("M"))).otherwise("64M")
    return reads(spark, sf).select(F.concat(F.lit("chr"), "ref_id").alias("chr"), F.lit(1001).cast("long").alias("pos"), cigar.alias("cigar"), F.col("read_seq").alias("seq"))


@query("J08_pooled_on_genome", WITH + f"SELECT concat('REGION_chr', CAST(ref_id AS VARCHAR), '_1001_1065') AS region, {_N} AS n_reads, {_count("e = 'S'")} AS substitutions FROM reads GROUP BY ref_id")
def pooled_by_place(spark, sf):
    """Amplicons found on the genome; without guides the window is all but 15 bases at either end, and every substitution lies in it."""
    contigs = references(spark, sf).select(F.concat(F.lit("chr"), F.substring("ref_name", 2, 3)).alias("chr"), F.concat(F.repeat(F.lit("A"), F.lit(1000)), "ref_seq", F.lit("CCCC")).alias("seq"))
    return pooled_on_genome(_mapped(spark, sf), contigs, [], min_reads=10)["editing"].select("region", "n_reads", "substitutions")


_PLACED = "SELECT r_regionkey AS ref_id, concat('R', CAST(r_regionkey AS VARCHAR)) AS name FROM region"


@query("J08_pooled_mixed", WITH + f"SELECT name AS region, {_N} AS n_reads, {_count('sub_w')} AS substitutions FROM vars JOIN ({_PLACED}) AS a ON vars.ref_id = a.ref_id GROUP BY name")
def pooled_with_places(spark, sf):
    """Amplicons with given places, as many as there are regions; reads of other places belong to none of them."""
    return _mixed(spark, sf)["editing"].select("region", "n_reads", "substitutions")


@query("J08_places_of_no_amplicon", WITH + f"SELECT concat('chr', CAST(ref_id AS VARCHAR)) AS chr, {_N} AS n_reads FROM reads WHERE ref_id NOT IN (SELECT ref_id FROM ({_PLACED}) AS a) GROUP BY ref_id")
def places_of_no_amplicon(spark, sf):
    return _mixed(spark, sf)["unmatched"].select("chr", "n_reads")


def _mixed(spark, sf):
    placed = table(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("name"), F.concat(F.lit("chr"), "r_regionkey").alias("chr"), F.lit(1001).cast("long").alias("bpstart"), F.lit(1064).cast("long").alias("bpend"))
    return pooled_mixed(_mapped(spark, sf), placed, _refs(spark, sf, [f"R{k}" for k in range(REFS)]), min_reads=1)


@query("C11_discarded_classes", WITH + f"SELECT sample, CASE WHEN del_w OR ins_w THEN concat('DISCARDED_', ref_name) WHEN sub_w THEN concat(ref_name, '_MODIFIED') ELSE concat(ref_name, '_UNMODIFIED') END AS class_name, {_N} AS n FROM vars GROUP BY ALL")
def discarded_classes(spark, sf):
    return Z.class_counts(variants(spark, sf), ["sample"], discard_indels=True)


@query("F02_class_order", WITH + f"SELECT sample, concat(ref_name, CASE WHEN modified THEN '_MODIFIED' ELSE '_UNMODIFIED' END) AS class_name, {_N} AS n, CAST(row_number() OVER (PARTITION BY sample ORDER BY ref_id, modified) AS INT) AS rank FROM vars GROUP BY sample, ref_id, ref_name, modified")
def class_order(spark, sf):
    return Z.ordered_classes(Z.class_counts(variants(spark, sf), ["sample"]), ["sample"], NAMES)


@query(
    "F41_first_unaligned",
    WITH + f"""SELECT seq, n_reads FROM (SELECT read_seq AS seq, {_N} AS n_reads FROM (SELECT * FROM reads WHERE e IN ('N', 'S') ORDER BY l_orderkey, l_linenumber, read_seq LIMIT 10000) AS f GROUP BY read_seq) AS t
WHERE (SELECT count(*) FROM reads WHERE e NOT IN ('N', 'S')) < 0.5 * (SELECT count(*) FROM reads) ORDER BY n_reads DESC, seq LIMIT 10""",
)
def first_unaligned(spark, sf):
    """Reads without an insertion or deletion stand for the unaligned ones."""
    r = reads(spark, sf).select("e", F.col("read_seq").alias("seq"), F.struct("l_orderkey", "l_linenumber", "read_seq").alias("ord"))
    return Z.top_unaligned(r.where("e IN ('N', 'S')"), F.lit(r.count()))


@query("F26_target_at_positions", WITH + f"""SELECT combination, n_reads FROM (SELECT {_combination(_CODE.replace("'C' THEN 'R'", "'G' THEN 'R'"), '').replace("= 'C')", "= 'G')")} AS combination, {_N} AS n_reads FROM reads GROUP BY ALL) AS t
WHERE substr(combination, 8, 1) = 'T' AND substr(combination, 1, 1) <> 'T'""")
def target_at_positions(spark, sf):
    return B.subset(B.membership(B.combinations(alleles(spark, sf), [], "G", "T")), present=(7,), absent=(0,)).select("combination", "n_reads")


NOT = {"high": "", "low": "NOT "}
#: The column of position 31 in the read as it was sequenced, and its base.
_QUAL31 = "ascii(substr(qual, CASE WHEN e = 'I' AND p <= 31 THEN 32 + k WHEN e = 'D' AND p + k <= 31 THEN 32 - k ELSE 32 END, 1)) - 33 >= 30"
_BASE31 = "(CASE WHEN e = 'I' THEN substr(ref_seq, 32, 1) ELSE substr(aln_seq, 32, 1) END)"


@query(
    "F31_base_qualities",
    WITH + f"""SELECT sample, {_N} AS total, {', '.join(f"{_count(f'{test} AND {NOT[level]}({_QUAL31})')} AS {k}_{level}" for k, test in (('original', f"{_BASE31} = 'C'"), ('target', f"{_BASE31} = 'G'"), ('other', f"{_BASE31} NOT IN ('C', 'G', '-')")) for level in ('high', 'low'))},
  {_count(f"{_BASE31} = '-'")} AS deleted FROM reads GROUP BY sample""",
)
def base_qualities(spark, sf):
    return Z.base_qualities(reads(spark, sf), ["sample"], 31, "C", "G", 30)


@query("F29_with_repair_template", WITH + f"""SELECT sample, {_count('modified AND change % 3 <> 0')} AS frameshift, {_count('modified AND change % 3 = 0')} AS in_frame, {_count("ref_name = 'R1' AND NOT modified")} AS non_coding
FROM (SELECT *, CASE WHEN ins_w OR del_w THEN k ELSE 0 END AS change FROM vars) AS t GROUP BY sample""")
def frames_with_template(spark, sf):
    v = variants(spark, sf)
    per = Z.frames(v, KEYS, F.array(*map(F.lit, range(64))), F.array().cast("array<int>"))
    return Z.over_references(per, Z.editing(v, KEYS), ["sample"], "R1").drop("splice_sites")


@query("J06_positions_of_several_samples", WITH + f"SELECT sample, ref_name, kind, pos, {_N} AS n FROM ({_IN}) AS t WHERE ref_name IN (SELECT ref_name FROM ({_IN}) AS u GROUP BY ref_name HAVING count(DISTINCT sample) >= 2) GROUP BY ALL")
def positions_of_several(spark, sf):
    return M.of_several(P.edit_positions(variants(spark, sf), KEYS, in_window=True), ["ref_name"], "sample")
