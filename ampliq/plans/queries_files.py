"""Queries over files: derived reads are written in a format, read back by its source, and summed."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import alignment_cigar, reverse_complement
from ..operators import regions as R
from ..operators.quantify import editing
from ..sources import bam, fasta, fastq, runs, sam, tables, vcf
from ..sources.files import shared_folder, stored
from .derived import WITH, reads, references, table, variants
from .modes import whole_genome
from .queries_edits import _N, _count
from .queries_modes import NAMES, _refs
from .registry import query

#: An order of the reads in which only equal rows are tied.
ORDER = ["l_orderkey", "l_linenumber", "read_seq", "sample"]
_ORDER = ", ".join(ORDER)


def _as_fastq(r, path, seq, qual):
    """The reads in ``ORDER`` as a FASTQ folder."""
    rows = r.select(F.struct(*ORDER).alias("ord"), F.concat_ws(":", "sample", "l_orderkey", "l_linenumber").alias("read_id"), seq.alias("seq"), qual.alias("qual"))
    fastq.write(rows, path)
    return path


@query("A01_fastq_scan", WITH + f"""SELECT sample, {_N} AS n_reads, CAST(sum(ord) AS BIGINT) AS places, CAST(sum(length(read_seq)) AS BIGINT) AS bases, {_count("qual LIKE '!%'")} AS lowest, min(concat(read_seq, qual)) AS first
FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS ord FROM reads) AS r GROUP BY sample""")
def fastq_scan(spark, sf):
    path = _as_fastq(reads(spark, sf), f"{shared_folder(spark)}/reads", F.col("read_seq"), F.col("qual"))
    r = fastq.read(spark, path).withColumn("sample", F.substring_index("read_id", ":", 1))
    return r.groupBy("sample").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("ord").alias("places"), F.sum(F.length("seq")).alias("bases"), F.count_if(F.col("qual").startswith("!")).alias("lowest"), F.min(F.concat("seq", "qual")).alias("first"))


@query("A02_fastq_pairs", WITH + f"""SELECT substr(read_seq, 1, 45) AS seq1, substr(read_seq, 20) AS seq2, {_N} AS n_reads, CAST(sum(ord) AS BIGINT) AS places, max(substr(qual, 20)) AS qual2
FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS ord FROM reads) AS r GROUP BY ALL""")
def fastq_pairs(spark, sf):
    r, folder = reads(spark, sf), shared_folder(spark)
    one = _as_fastq(r, f"{folder}/r1", F.substring("read_seq", 1, 45), F.substring("qual", 1, 45))
    two = _as_fastq(r, f"{folder}/r2", reverse_complement(F.expr("substr(read_seq, 20)")), F.reverse(F.expr("substr(qual, 20)")))
    return fastq.pairs(spark, one, two).groupBy("seq1", "seq2").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("ord").alias("places"), F.max("qual2").alias("qual2"))


@query("A07_file_count", WITH + f"SELECT {_N} AS n_reads FROM reads")
def file_count(spark, sf):
    path = _as_fastq(reads(spark, sf), f"{shared_folder(spark)}/reads", F.col("read_seq"), F.col("qual"))
    return spark.range(1).select(F.lit(fastq.count(spark, path)).cast("long").alias("n_reads"))


@query("A10_interleaved_file", WITH + f"""SELECT mate, {_N} AS n_reads, CAST(sum(ord // 2) AS BIGINT) AS places, CAST(sum(length(read_seq)) AS BIGINT) AS bases
FROM (SELECT *, CAST(ord % 2 AS INT) AS mate FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS ord FROM reads) AS r) AS s GROUP BY mate""")
def interleaved_file(spark, sf):
    path = _as_fastq(reads(spark, sf), f"{shared_folder(spark)}/reads", F.col("read_seq"), F.col("qual"))
    mates = fastq.split_interleaved(fastq.read(spark, path))
    both = mates[0].withColumn("mate", F.lit(0)).unionByName(mates[1].withColumn("mate", F.lit(1)))
    return both.groupBy("mate").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("ord").alias("places"), F.sum(F.length("seq")).alias("bases"))


@query("K07_annotated_fastq", WITH + f"SELECT note, {_N} AS n_reads FROM (SELECT concat('+', e, CAST(k AS VARCHAR)) AS note FROM reads) AS r GROUP BY note")
def annotated_fastq(spark, sf):
    path = f"{shared_folder(spark)}/annotated"
    r = reads(spark, sf).select(F.struct(*ORDER).alias("ord"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("read_id"), F.col("read_seq").alias("seq"), "qual", F.concat("e", F.col("k").cast("string")).alias("note"))
    fastq.write(r, path, annotation="note")
    return spark.read.text(path).where(F.col("value").rlike("^[+][SDIN][123]$")).groupBy(F.col("value").alias("note")).agg(F.count(F.lit(1)).alias("n_reads"))


#: Reads on contigs named as their references: where they lie, and their flag of a second place.
_PLACE, _FLAG = "1 + (l_orderkey % 1000) * 10", "CASE WHEN e = 'S' THEN 256 ELSE 0 END"
_CIGAR = "CASE e WHEN 'D' THEN concat(CAST(p AS VARCHAR), 'M', CAST(k AS VARCHAR), 'D', CAST(64 - p - k AS VARCHAR), 'M') WHEN 'I' THEN concat(CAST(p AS VARCHAR), 'M', CAST(k AS VARCHAR), 'I', CAST(64 - p AS VARCHAR), 'M') ELSE '64M' END"
CONTIGS = {n: 100_000 for n in NAMES}


def _mapped(spark, sf):
    r = reads(spark, sf).select(
        F.concat_ws(":", "sample", "l_orderkey", "l_linenumber").alias("name"), F.expr(_FLAG).alias("flag"), F.col("ref_name").alias("chr"), F.expr(_PLACE).cast("long").alias("pos"), F.lit(60).alias("mapq"),
        alignment_cigar(F.col("aln_seq"), F.col("aln_ref")).alias("cigar"), F.col("read_seq").alias("seq"), "qual", F.create_map(F.lit("NM"), F.col("k").cast("string")).alias("tags"), F.concat("e", F.lit("-"), F.col("k").cast("string")).alias("note"),
    )
    return r


def _as_bam(spark, sf, **more):
    path = f"{shared_folder(spark)}/reads"
    bam.write(_mapped(spark, sf), path, CONTIGS, **more)
    return path


_SUMS = "CAST(sum(pos) AS BIGINT) AS places, CAST(sum(nm) AS BIGINT) AS tags, min(concat(read_seq, qual)) AS first"


def _summed(records, keys):
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reads"), F.sum("pos").alias("places"), F.sum(F.element_at("tags", "NM").cast("long")).alias("tags"), F.min(F.concat("seq", "qual")).alias("first"))


@query("A05_bam_scan", WITH + f"SELECT chr, cigar, flag, {_N} AS n_reads, {_SUMS} FROM (SELECT ref_name AS chr, {_CIGAR} AS cigar, CAST({_FLAG} AS INT) AS flag, {_PLACE} AS pos, k AS nm, read_seq, qual FROM reads) AS r GROUP BY chr, cigar, flag")
def bam_scan(spark, sf):
    """Splits much smaller than usual, so that records and blocks are cut on these tables too."""
    return _summed(bam.read(spark, _as_bam(spark, sf), split_bytes=1 << 18), ["chr", "cigar", "flag"])


@query("A05_bam_region", WITH + f"SELECT cigar, {_N} AS n_reads, {_SUMS} FROM (SELECT {_CIGAR} AS cigar, {_PLACE} AS pos, k AS nm, read_seq, qual FROM reads WHERE ref_name = 'R3' AND e <> 'S') AS r WHERE pos <= 5000 AND pos + 63 >= 2000 GROUP BY cigar")
def bam_region(spark, sf):
    return _summed(bam.read(spark, _as_bam(spark, sf), exclude_flags=0x100, chrom="R3", start=2000, end=5000), ["cigar"])


@query("K08_annotated_bam", WITH + f"SELECT note, {_N} AS n_reads, CAST(sum(nm) AS BIGINT) AS tags FROM (SELECT concat(e, '-', CAST(k AS VARCHAR)) AS note, k AS nm FROM reads) AS r GROUP BY note")
def annotated_bam(spark, sf):
    r = bam.read(spark, _as_bam(spark, sf, annotation="note"))
    return r.groupBy(F.element_at("tags", "c2").alias("note")).agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.element_at("tags", "NM").cast("long")).alias("tags"))


@query("H09_bam_order", WITH + f"SELECT ref_name AS chr, {_N} AS n_reads, CAST(0 AS BIGINT) AS out_of_place FROM reads GROUP BY ref_name")
def bam_order(spark, sf):
    """Reads that lie before the one that is written before them, within a file or in the file before it."""
    r = bam.read(spark, _as_bam(spark, sf), places=True).withColumn("key", F.struct(F.array_position(F.array(*map(F.lit, NAMES)), F.col("chr")).alias("c"), "pos"))
    inside = r.withColumn("before", F.lag("key").over(W.partitionBy("file").orderBy("place")))
    files = r.groupBy("file").agg(F.min("key").alias("least"), F.max("key").alias("most")).withColumn("earlier", F.lag("most").over(W.orderBy("file")))  # a row a file
    counted = inside.groupBy("chr").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(F.col("before") > F.col("key")).alias("wrong"))
    between = files.where("earlier > least").groupBy(F.element_at(F.array(*map(F.lit, NAMES)), F.col("least.c").cast("int")).alias("chr")).agg(F.count(F.lit(1)).alias("more"))
    return counted.join(between, "chr", "left").select("chr", "n_reads", (F.col("wrong") + F.coalesce("more", F.lit(0))).alias("out_of_place"))


@query("K08_annotated_sam", WITH + f"SELECT chr, {_N} AS n_reads, CAST(sum(pos) AS BIGINT) AS places, min(concat(read_seq, qual)) AS first FROM (SELECT ref_name AS chr, {_PLACE} AS pos, read_seq, qual FROM reads WHERE e <> 'S') AS r GROUP BY chr")
def annotated_sam(spark, sf):
    path = f"{shared_folder(spark)}/sam"
    r = _mapped(spark, sf).withColumns({"next_chr": F.lit("*"), "next_pos": F.lit(0), "length": F.lit(0)})
    sam.write(r, path, CONTIGS, annotation="note")
    return sam.read(spark, path, exclude_flags=0x100).where(F.element_at("tags", "c2").isNotNull()).groupBy("chr").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("pos").alias("places"), F.min(F.concat("seq", "qual")).alias("first"))


@query("A16_fasta_ranges", WITH + """SELECT ref_name, CAST(stop - start AS BIGINT) AS asked, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT piece) AS BIGINT) AS different, CAST(sum(length(piece)) AS BIGINT) AS bases, min(piece) AS first, max(piece) AS last
FROM (SELECT ref_name, start, stop, substr(genome, start + 1, stop - start) AS piece FROM (SELECT ref_name, repeat(ref_seq, 40) AS genome FROM (SELECT DISTINCT ref_name, ref_seq FROM reads) AS a) AS g,
  (SELECT DISTINCT l_orderkey % 2600 AS start, l_orderkey % 2600 + 1 + l_linenumber * 90 AS stop FROM reads) AS w) AS x GROUP BY ref_name, stop - start""")
def fasta_ranges(spark, sf):
    """References as contigs of a FASTA file, whose ranges are put together from blocks of 256 bases; some reach beyond the end."""
    path = f"{shared_folder(spark)}/genome"
    fasta.write(references(spark, sf).select(F.col("ref_name").alias("chr"), F.repeat("ref_seq", 40).alias("seq")), path)
    start = (F.col("l_orderkey") % 2600).cast("long")
    places = reads(spark, sf).select(start.alias("start"), (start + 1 + F.col("l_linenumber") * 90).alias("end")).distinct()
    found = R.fetched(fasta.read(spark, path, 256), places.withColumn("chr", F.explode(F.array(*map(F.lit, NAMES)))), width=256)
    sums = F.count(F.lit(1)).alias("n"), F.count_distinct("ref_seq").alias("different"), F.sum(F.length("ref_seq")).alias("bases"), F.min("ref_seq").alias("first"), F.max("ref_seq").alias("last")
    return found.groupBy(F.col("chr").alias("ref_name"), (F.col("end") - F.col("start")).alias("asked")).agg(*sums)


@query("A16_contig_lengths", WITH + "SELECT DISTINCT ref_name AS chr, CAST(2560 AS BIGINT) AS length FROM reads")
def contig_lengths(spark, sf):
    path = f"{shared_folder(spark)}/genome"
    fasta.write(references(spark, sf).select(F.col("ref_name").alias("chr"), F.repeat("ref_seq", 40).alias("seq")), path)
    return fasta.lengths(spark, path)


@query("B11_reference_positions", WITH + f"""SELECT cigar, array_to_string(CASE e WHEN 'D' THEN list_concat(range(1, p + 1), range(p + k + 1, 65)) WHEN 'I' THEN list_concat(range(1, p + 1), list_concat(list_transform(range(k), lambda x: -1), range(p + 1, 65))) ELSE range(1, 65) END, ',') AS positions, {_N} AS n_reads
FROM (SELECT *, {_CIGAR} AS cigar FROM reads) AS r GROUP BY ALL""")
def reference_positions(spark, sf):
    """Inserted bases have no position; they are -1 here."""
    counts = _mapped(spark, sf).groupBy("cigar").agg(F.count(F.lit(1)).alias("n_reads"))
    at = R.read_offsets(F.lit(1), F.col("cigar"))
    return counts.select("cigar", F.array_join(F.transform(at, lambda x: F.coalesce(x, F.lit(-1)).cast("string")), ",").alias("positions"), "n_reads")


#: The bases that a read has on positions 26 to 40 of its reference; none if one of the two ends is deleted.
_TRIMMED = "SELECT ref_name, replace(substr(aln_seq, a, b - a + 1), '-', '') AS seq FROM (SELECT *, CASE WHEN e = 'I' AND p <= 25 THEN 26 + k ELSE 26 END AS a, CASE WHEN e = 'I' AND p <= 39 THEN 40 + k ELSE 40 END AS b FROM reads) AS c WHERE substr(aln_seq, a, 1) <> '-' AND substr(aln_seq, b, 1) <> '-'"


@query("B12_trimmed_reads", WITH + f"SELECT ref_name, seq, {_N} AS n_reads FROM ({_TRIMMED}) AS t GROUP BY ALL")
def trimmed_reads(spark, sf):
    records = _mapped(spark, sf).withColumn("pos", F.lit(1).cast("long")).select("chr", "pos", "cigar", "seq")
    regions = records.select("chr").distinct().select("chr", F.lit(26).cast("long").alias("bpstart"), F.lit(40).cast("long").alias("bpend"), F.col("chr").alias("ref_name"))
    return R.covering(records, regions).groupBy("ref_name", "seq").agg(F.count(F.lit(1)).alias("n_reads"))


@query("J09_whole_genome", WITH + f"SELECT ref_name AS region, {_N} AS n_reads, {_count('sub_w')} AS substitutions FROM vars GROUP BY ref_name")
def whole_genome_regions(spark, sf):
    """Every reference's piece of the genome is a region."""
    records, refs = _mapped(spark, sf).withColumn("pos", F.lit(1001).cast("long")).select("chr", "pos", "cigar", "seq"), _refs(spark, sf, NAMES)
    regions = spark.createDataFrame([(r.name, 1001, 1000 + len(r.seq), r.name) for r in refs], "chr string, bpstart long, bpend long, name string")
    return whole_genome(records, F.broadcast(regions), {r.name: r for r in refs})["editing"].select("region", "n_reads", "substitutions")


@query("A19_nested_runs", WITH + f"""SELECT run, part_of, ref_name, CASE WHEN run = 'F' THEN NULL ELSE n_reads END AS n_reads, modified FROM (
  SELECT sample AS run, CASE WHEN sample = 'F' THEN 'batch' ELSE 'batch/pool' END AS part_of, ref_name, {_N} AS n_reads, {_count('modified')} AS modified FROM vars GROUP BY sample, ref_name) AS t
UNION ALL SELECT 'alone', '', ref_name, {_N}, {_count('modified')} FROM vars GROUP BY ref_name""")
def nested_runs(spark, sf):
    """A batch of a run and a pool of another, and a single run; one that isn't over and one that never began count for nothing. One run lacks a column."""
    v, folder = stored(variants(spark, sf), "variants"), shared_folder(spark)
    rates = lambda df: editing(df, ["ref_name"]).select("ref_name", "n_reads", "modified")
    runs.write(spark, f"{folder}/b/F", "F", {"editing": rates(v.where("sample = 'F'")).drop("n_reads")})
    runs.write(spark, f"{folder}/b/pool/O", "O", {"editing": rates(v.where("sample = 'O'"))})
    runs.write(spark, f"{folder}/b/pool", "pool", {}, "pooled", parts=["O", "never"])
    runs.write(spark, f"{folder}/b", "batch", {}, "batch", parts=["F", "pool"])
    runs.write(spark, f"{folder}/alone", "alone", {"editing": rates(v)})
    runs.write(spark, f"{folder}/broken", "broken", {}, status="running")
    found = runs.table(spark, runs.unrolled(runs.catalogue(spark, folder)), "editing")
    return found.select("run", F.array_join("part_of", "/").alias("part_of"), "ref_name", "n_reads", "modified")


@query("K09_vcf_file", WITH + f"SELECT concat('chr', CAST(ref_id AS VARCHAR)) AS chr, CAST(1000 + p AS BIGINT) AS pos, substr(ref_seq, p + 1, 1) AS ref, substr(aln_seq, p + 1, 1) AS alt, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY p, substr(aln_seq, p + 1, 1)) AS INT) AS nth FROM (SELECT DISTINCT ref_id, ref_seq, aln_seq, p FROM vars WHERE sub_w) AS s")
def vcf_file(spark, sf):
    """Substitutions of a written file, in the order of its lines within their chromosome."""
    path = f"{shared_folder(spark)}/edits"
    v = variants(spark, sf).where("edits.deletion_n = 0 AND edits.insertion_n = 0")
    vcf.write(vcf.edit_counts(v, {n: (f"chr{n[1:]}", 1000) for n in NAMES}, []), path, {f"chr{n[1:]}": 2000 for n in NAMES})
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("line", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    c = lambda k: F.split("value", "\t")[k]
    rows = lines.select("line", c(0).alias("chr"), c(1).cast("long").alias("pos"), c(3).alias("ref"), c(4).alias("alt"))
    return rows.select("chr", "pos", "ref", "alt", F.row_number().over(W.partitionBy("chr").orderBy("line")).cast("int").alias("nth"))


@query("A13_region_file", "SELECT concat('chr', CAST(CAST(p_partkey % 5 AS INT) AS VARCHAR)) AS chr_id, CAST(sum(p_partkey * 3) AS BIGINT) AS starts, CAST(sum(p_partkey * 3 + p_size) AS BIGINT) AS ends, max(concat('region_', CAST(p_partkey AS VARCHAR))) AS name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL")
def region_file(spark, sf):
    path = f"{shared_folder(spark)}/regions"
    p = table(spark, sf, "part")
    start = F.col("p_partkey") * 3
    p.select(F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")), start.cast("string"), (start + F.col("p_size")).cast("string"), F.concat(F.lit("region "), F.col("p_partkey").cast("string")), F.lit("NA")).alias("value")).write.text(path)
    r = tables.regions(spark, path).where(F.col("guide_seq").isNull())
    return r.groupBy("chr_id").agg(F.sum("bpstart").alias("starts"), F.sum("bpend").alias("ends"), F.max("name").alias("name"), F.count(F.lit(1)).alias("n"))


@query("A15_alternate_alleles", WITH + "SELECT region_name, reference_name, max(reference_seq) AS reference_seq FROM (SELECT ref_name AS region_name, unnest(['whole', 'half']) AS reference_name, unnest([ref_seq, substr(ref_seq, 1, 32)]) AS reference_seq FROM reads) AS t GROUP BY ALL")
def alternate_alleles(spark, sf):
    path = f"{shared_folder(spark)}/alternates"
    references(spark, sf).select(F.concat_ws("\t", "ref_name", F.concat_ws(",", "ref_seq", F.substring("ref_seq", 1, 32)), F.lit("whole,half")).alias("value")).write.text(path)
    return tables.alternate_alleles(spark, path).select("region_name", "reference_name", "reference_seq")


@query("A14_batch_file", "SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS name, concat('reads/', CAST(s_suppkey AS VARCHAR), '.fastq') AS fastq_r1, CASE WHEN s_suppkey % 3 = 0 THEN 'GGGG' ELSE concat('ACGT', repeat('A', CAST(s_suppkey % 5 AS INT))) END AS amplicon_seq FROM supplier")
def batch_file(spark, sf):
    path = f"{shared_folder(spark)}/batch"
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("n"), F.concat(F.lit("reads/"), F.col("s_suppkey").cast("string"), F.lit(".fastq")).alias("r1"), F.when(F.col("s_suppkey") % 3 == 0, "NA").otherwise(F.concat(F.lit("ACGT"), F.repeat(F.lit("A"), (F.col("s_suppkey") % 5).cast("int")))).alias("a"))
    s.write.option("sep", "\t").option("header", True).csv(path)
    return tables.batch(spark, path, {"amplicon_seq": "GGGG"}).select("name", "fastq_r1", "amplicon_seq")
