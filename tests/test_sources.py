import gzip
import random
import re
import struct

import pytest

from ampliq.operators import regions
from ampliq.operators.edits import with_edits
from ampliq.sources import bam, fasta, fastq, runs, sam, sinks, tables, vcf
from ampliq.streaming import ingest

READS = [("r1", "ACGT", "IIII"), ("r2", "GGGT", "@III"), ("r3", "TTTT", "!!!!")]


def fastq_file(path, reads=READS):
    path.write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in reads))
    return str(path)


def test_fastq_round_trip(spark, tmp_path):
    reads = fastq.read(spark, fastq_file(tmp_path / "a.fastq"))
    assert [(r.read_id, r.seq, r.qual) for r in reads.orderBy("ord").collect()] == READS
    fastq.write(reads, str(tmp_path / "out"))
    assert sorted((r.read_id, r.seq) for r in fastq.read(spark, str(tmp_path / "out")).collect()) == [(i, s) for i, s, _ in READS]
    assert fastq.count(spark, str(tmp_path / "a.fastq")) == 3


def test_fastq_in_many_splits(spark, tmp_path):
    many = [(f"r{k}", "ACGT" * (1 + k % 5), "@" * 4 * (1 + k % 5)) for k in range(3000)]
    path = fastq_file(tmp_path / "big.fastq", many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        reads = fastq.read(spark, path)
        assert [(r.read_id, r.seq, r.qual) for r in reads.orderBy("ord").collect()] == many
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_records_are_assembled_where_they_are_read(spark, tmp_path):
    many = [(f"r{k}", "ACGT" * (1 + k % 5), "@" * 4 * (1 + k % 5)) for k in range(12)]
    (tmp_path / "in").mkdir()
    a, b = fastq_file(tmp_path / "in" / "a.fastq", many), fastq_file(tmp_path / "in" / "b.fastq", READS)
    for path, more in ((a, "\n\n"), (b, "")):
        with open(path, "a") as f:
            f.write(more)
    for size in ("61", "1m"):  # shorter than a record, and than a line
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            reads = fastq.read(spark, str(tmp_path / "in"))
            assert [tuple(r) for r in reads.orderBy("ord").collect()] == [(k, *r) for k, r in enumerate([*many, *READS])]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = reads._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan text") - 600 : plan.index("FileScan text")]
    assert "MapInArrow" in scan and "Exchange" not in scan
    (tmp_path / "none.fastq").write_text("")
    assert fastq.read(spark, str(tmp_path / "none.fastq")).count() == 0


def test_fastq_checks(spark, tmp_path):
    fastq.validate(spark, fastq_file(tmp_path / "a.fastq"))
    (tmp_path / "bad.fastq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(ValueError):
        fastq.validate(spark, str(tmp_path / "bad.fastq"))


def test_pairs(spark, tmp_path):
    a, b = fastq_file(tmp_path / "1.fastq"), fastq_file(tmp_path / "2.fastq", [("x", "AACC", "1234")] * 3)
    row = fastq.pairs(spark, a, b).orderBy("ord").first()
    assert (row.seq1, row.seq2, row.qual2) == ("ACGT", "GGTT", "4321")
    with pytest.raises(ValueError):
        fastq.pairs(spark, a, fastq_file(tmp_path / "3.fastq", READS[:2]))


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\nr2\t256\tchr1\t50\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    got = sam.read(spark, str(tmp_path / "a.sam"), exclude_flags=0x900)
    assert [(r.name, r.pos, r.tags) for r in got.collect()] == [("r1", 5, {"NM": "0"})]
    assert sam.read(spark, str(tmp_path / "a.sam"), chrom="chr1", start=40, end=60).count() == 1
    sam.write(got, str(tmp_path / "out"), {"chr1": 100})
    assert sam.read(spark, str(tmp_path / "out")).count() == 1


def test_bam(spark, tmp_path):
    name, cigar, seq = b"r1\0", struct.pack("<I", 4 << 4), bytes([0x12, 0x48])
    body = struct.pack("<iiBBHHHiiii", 0, 4, len(name), 60, 0, 1, 16, 4, -1, -1, 0) + name + cigar + seq + bytes([40] * 4)
    raw = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 100) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw[:30]) + gzip.compress(raw[30:]))
    (row,) = bam.read(spark, str(tmp_path / "a.bam")).collect()
    assert (row.name, row.flag, row.chr, row.pos, row.cigar, row.seq, row.qual) == ("r1", 16, "chr1", 5, "4M", "ACGT", "IIII")


CONTIGS = {"chr1": 5_000_000, "chr2": 40_000_000}


def mapped(n=6000):
    """Records of several blocks: all kinds of optional fields' forms that the writer knows, reads of odd lengths, without qualities, without a place."""
    rng, rows = random.Random(7), []
    for k in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 35, 100, 151])))
        chrom = rng.choice(["chr1", "chr2", "chr2"]) if k % 50 else "*"
        pos = rng.randrange(1, 4_900_000) if chrom != "*" else 0
        cigar = "*" if chrom == "*" else f"{len(seq)}M" if len(seq) < 35 else f"5S{len(seq) - 15}M10I" if k % 3 else f"{len(seq) - 5}M{rng.choice([3, 70_000])}N5M"
        rows.append((f"r{k}", [0, 16, 256, 1024][k % 4] if chrom != "*" else 4, chrom, pos, k % 61, cigar, "*", 0, 0, seq, "*" if k % 7 == 0 else "".join(chr(33 + rng.randrange(40)) for _ in seq), {"NM": str(k % 9), "MD": "4A"} if k % 2 else {}))
    return rows


def as_tuple(r):
    return (*(r[c] for c in bam.COLUMNS[:-1]), tuple(sorted(r["tags"].items())))


def reference_end(pos, cigar):
    return pos - 1 + max(1, sum(int(n) for n, op in re.findall(r"(\d+)([A-Z=])", cigar) if op in "MDN=X"))


def test_bam_in_splits(spark, tmp_path):
    rows = mapped()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bam.write(spark.createDataFrame(rows, bam.SCHEMA).repartition(3), str(tmp_path / "out"), CONTIGS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((*r[:-1], tuple(sorted(r[-1].items()))) for r in rows)
    whole = bam.read(spark, str(tmp_path / "out"), places=True)
    assert sorted(as_tuple(r) for r in whole.collect()) == want
    for size in (20_000, 70_001):  # splits within blocks: less than a block, and some blocks
        parts = bam.read(spark, str(tmp_path / "out"), split_bytes=size)
        assert parts.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
        assert sorted(as_tuple(r) for r in parts.collect()) == want
    # the files, in the order of their names, are in the order of places
    got = [(list(CONTIGS).index(r.chr) if r.chr != "*" else 9, r.pos) for r in whole.orderBy("file", "place").collect()]
    assert got == sorted(got)
    assert whole.select("file").distinct().count() > 1


def test_bam_regions_and_flags(spark, tmp_path):
    rows = mapped()
    df = spark.createDataFrame(rows, bam.SCHEMA)
    bam.write(df.coalesce(1), str(tmp_path / "out"), CONTIGS)
    want = lambda c, a, b, mask=0: sorted(r[0] for r in rows if r[2] == c and r[3] <= b and reference_end(r[3], r[5]) >= a and not r[1] & mask)
    for c, a, b in (("chr1", 1, 100_000), ("chr2", 2_000_000, 2_000_300), ("chr2", 4_800_000, 40_000_000)):
        with_index = bam.read(spark, str(tmp_path / "out"), chrom=c, start=a, end=b, exclude_flags=0x100)
        assert sorted(r.name for r in with_index.collect()) == want(c, a, b, 0x100)
    assert bam.read(spark, str(tmp_path / "out"), chrom="chr9", start=1, end=5).count() == 0
    for p in (tmp_path / "out").glob("*.bai"):
        p.unlink()
    assert sorted(r.name for r in bam.read(spark, str(tmp_path / "out"), chrom="chr2", start=2_000_000, end=2_000_300).collect()) == want("chr2", 2_000_000, 2_000_300)
    assert bam.read(spark, str(tmp_path / "out"), chrom="chr1").count() == sum(r[2] == "chr1" for r in rows)


def test_index_names_the_chunks_of_a_region(tmp_path):
    rng = random.Random(1)
    entries, place = [], 100
    for pos in sorted(rng.randrange(0, 3_000_000) for _ in range(2000)):
        entries.append((1, pos, pos + rng.choice([1, 150, 40_000]), place, place + 10))
        place += 10
    data = bam.index_bytes(entries, 3)
    for a, b in ((0, 10), (16_000, 17_000), (1_000_000, 1_300_000), (2_999_000, 2_999_001)):
        chunks = bam.indexed_chunks(data, 1, a, b)
        held = [e for e in entries if any(x <= e[3] and e[4] <= y for x, y in chunks)]
        assert {e for e in entries if e[1] < b and e[2] > a} <= set(held) and bam.indexed_chunks(data, 0, a, b) == []
        assert len(held) < 1000


def test_annotated_bam(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "chr1", 5, "2M", "AC", "II", {"NM": "1", "c2": "old"}, "D0;I0;S1"), ("b", 4, "*", 0, "*", "G", "!", {}, None)], "name string, flag int, chr string, pos long, cigar string, seq string, qual string, tags map<string,string>, note string")
    bam.write(df, str(tmp_path / "out"), CONTIGS, annotation="note")
    assert {r.name: r.tags for r in bam.read(spark, str(tmp_path / "out")).collect()} == {"a": {"NM": "1", "c2": "D0;I0;S1"}, "b": {"c2": ""}}
    bam.write(df.limit(0), str(tmp_path / "none"), CONTIGS)
    assert bam.read(spark, str(tmp_path / "none")).count() == 0


def test_optional_fields_of_every_form():
    body = b"XAAxXcc\xffXCC\xffXss\xfe\xffXSS\x01\x01Xii\xff\xff\xff\xffXII\x05\0\0\0Xff\0\0\xc0?XZZhi\0XHH1A\0XBBs\x02\0\0\0\x01\0\xff\xff"
    assert dict(bam._tags(body, 0)) == {"XA": "x", "Xc": "-1", "XC": "255", "Xs": "-2", "XS": "257", "Xi": "-1", "XI": "5", "Xf": "1.5", "XZ": "hi", "XH": "1A", "XB": "s,1,-1"}


def test_fasta_in_splits(spark, tmp_path):
    rng = random.Random(3)
    contigs = {f"c{k}": "".join(rng.choice("ACGTN") for _ in range(n)) for k, n in enumerate((0, 1, 59, 700, 2500))}
    (tmp_path / "in").mkdir()
    lines = [x for c, s in contigs.items() for x in (f">{c} some note", *(s[i : i + 40].lower() for i in range(0, len(s), 40)))]
    (tmp_path / "in" / "a.fa").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.fa").write_text(">other\nACGT\r\nGG")
    contigs["other"] = "ACGTGG"
    for size in ("700", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            blocks = fasta.read(spark, str(tmp_path / "in"), 128).collect()
            found = {r.chr: r.length for r in fasta.lengths(spark, str(tmp_path / "in")).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert found == {c: len(s) for c, s in contigs.items()}
        assert {(r.chr, r.block): r.bases for r in blocks} == {(c, k): s[128 * k : 128 * k + 128] for c, s in contigs.items() for k in range(-(-len(s) // 128))} and len(blocks) == sum(-(-len(s) // 128) for s in contigs.values())
    ranges = [(c, a, b) for c in (*contigs, "none") for a, b in ((0, 5), (100, 900), (127, 129), (600, 600), (690, 5000), (-3, 4))]
    got = regions.fetched(spark.createDataFrame([(r.chr, r.block, r.bases) for r in blocks], "chr string, block long, bases string"), spark.createDataFrame(ranges, "chr string, start int, end int"), width=128)
    assert {(r.chr, r.start, r.end): r.ref_seq for r in got.collect()} == {(c, a, b): contigs.get(c, "")[max(a, 0) : b] for c, a, b in ranges}
    fasta.write(spark.createDataFrame([(c, s) for c, s in contigs.items() if s], "chr string, seq string"), str(tmp_path / "out"), 30)
    assert {r.chr: r.bases for r in fasta.read(spark, str(tmp_path / "out")).collect()} == {c: s for c, s in contigs.items() if s}


def test_amplicon_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("one\tacgt\tCG\ntwo\tGGGG\tNA\n")
    assert [(r.amplicon_name, r.amplicon_seq, r.guide_seq) for r in tables.amplicons(spark, str(tmp_path / "a.tsv")).collect()] == [("one", "ACGT", "CG"), ("two", "GGGG", None)]
    (tmp_path / "b.tsv").write_text("Amplicon_Name\tamplicon_sequence\none\tACGT\n")
    assert tables.amplicons(spark, str(tmp_path / "b.tsv")).first().amplicon_seq == "ACGT"
    (tmp_path / "r.tsv").write_text("chr1\t5\t9\tmy region\n")
    assert tables.regions(spark, str(tmp_path / "r.tsv")).first().name == "my_region"
    (tmp_path / "c.tsv").write_text("n\tr1\nx\tx.fastq\n")
    assert tables.batch(spark, str(tmp_path / "c.tsv"), {"guide_seq": "G"}).first().asDict() == {"name": "x", "fastq_r1": "x.fastq", "guide_seq": "G"}
    (tmp_path / "n.txt").write_text("\tA\tA\nA\t5\t6\n")
    assert sorted((r.label, r.pos, r.ref_base, r.value) for r in tables.count_file(spark, str(tmp_path / "n.txt")).collect()) == [("A", 0, "A", 5.0), ("A", 1, "A", 6.0)]


def test_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("A", 0, 5), ("C", 1, 7)], "base string, pos int, n long")
    bases = spark.createDataFrame([(0, "A"), (1, "A")], "pos int, ref_base string")
    sinks.wide(counts, bases, str(tmp_path / "w"), "base", "n")
    lines = [r.value for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert lines == ["\tA\tA", "A\t5\t0", "C\t0\t7"]
    sinks.tsv(spark.createDataFrame([("x", 1 / 3, None)], "a string, b double, c int").coalesce(1), str(tmp_path / "t"), {"a": "Name", "b": "%", "c": "c"})
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["Name\t%\tc", "x\t0.33333333\tNA"]


def test_vcf(spark, tmp_path):
    v = with_edits(spark.createDataFrame([("r", "AC-TACGT", "ACGTACGT", 3), ("r", "ACGTACGT", "ACGTACGT", 1)], "ref_name string, aln_seq string, aln_ref string, n_reads long"), {"r": [2]})
    counts = vcf.edit_counts(v, {"r": ("chr2", 100)}, [])
    assert [tuple(r) for r in counts.collect()] == [("chr2", 101, "CG", "C", 3, 0.75)]
    vcf.write(counts, str(tmp_path / "v"), {"chr2": 8})
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert "chr2\t101\t.\tCG\tC\t.\tPASS\tAF=0.750" in lines and "##contig=<ID=chr2,length=8>" in lines
    names = spark.createDataFrame([(c, 1, "A", "C") for c in ("chr10", "chr2", "10", "2")], "chr string, pos long, ref string, alt string")
    assert [r.chr for r in vcf.sorted_records(names).collect()] == ["2", "10", "chr10", "chr2"]


def test_published_tables(spark, tmp_path):
    from ampliq.operators.alleles import allele_table
    from ampliq.operators.references import build
    from ampliq.plans import tables as published

    ref = build("r", "ACGTCACGTACCATGGACGTCCATTGCAAT", ["CACGTACCATGG"], skip_left=0, skip_right=0, plot=5)
    edited = ref.seq[:10] + "T" + ref.seq[11:]
    v = with_edits(spark.createDataFrame([("r", ref.seq, ref.seq, 3), ("r", edited, ref.seq, 1)], "ref_name string, aln_seq string, aln_ref string, n_reads long"), {"r": ref.window})
    made = published.per_guide(allele_table(v, []), ref, "C", "T")
    published.publish(made, str(tmp_path / "out"))
    text = lambda name: [r.value for r in spark.read.text(str(tmp_path / "out" / name)).collect()]
    guide = ref.guides[0].seq
    rows = text(f"r.Alleles_frequency_table_around_sgRNA_{guide}.txt")
    assert rows[0].split("\t")[:2] == ["Aligned_Sequence", "Reference_Sequence"] and len(rows) >= 2
    assert any(line.endswith("False\t3") for line in text(f"10i.r.sgRNA_{guide}.binary_allele_counts.txt"))
    arrays = {line.split("\t")[0]: line.split("\t")[1:] for line in text(f"10i.r.sgRNA_{guide}.arrays.txt")}
    assert set(arrays["total_counts"]) == {"4"} and len(arrays) == 6


def test_tables_of_all_keys_in_one_plan(spark, tmp_path):
    from ampliq.operators.references import build
    from ampliq.plans import tables as published

    seqs = ["ACGTCACGTACCATGGACGTCCATTGCAAT", "TTGTCACGTACCATGGACGTCCATTGCGG"]
    refs = [build(f"r{k}", s, ["CACGTACCATGG"], skip_left=0, skip_right=0, plot=5) for k, s in enumerate(seqs)]
    rows = [(sample, r.name, r.seq[:p] + "-" + r.seq[p + 1 :] if p else r.seq, r.seq, n) for sample in "ab" for r in refs for p, n in ((0, 3), (9, 2), (13, 1)) if (sample, r.name) != ("b", "r1")]
    v = with_edits(spark.createDataFrame(rows, "sample string, ref_name string, aln_seq string, aln_ref string, n_reads long"), {r.name: r.window for r in refs})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.publish_lines(published.published(v, refs, ["sample"]), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda name: [line for p in sorted((tmp_path / "out" / f"table={name}").glob("part-*")) for line in p.read_text().splitlines()]
    wide = [line.split("\t") for line in files("a.r0.Modification_count_vectors")]
    assert wide[0] == ["Sequence", *seqs[0]] and [w[0] for w in wide[1:]] == list(published.VECTORS)
    assert wide[3][1:] == ["2" if k == 9 else "1" if k == 13 else "0" for k in range(30)] and set(wide[1][1:]) == {"0"} and set(wide[6][1:]) == {"6"}
    assert [line.split("\t")[0] for line in files("b.r0.Nucleotide_frequency_table")] == ["", *"ACGTN-"] and files("b.r0.Nucleotide_frequency_table")[6].split("\t")[10] == "2.0"
    alleles = [line.split("\t") for line in files("a.Alleles_frequency_table")]
    assert alleles[0][:4] == ["Aligned_Sequence", "Reference_Sequence", "Reference_Name", "Read_Status"] and [x[7] for x in alleles[1:]] == ["3", "3", "2", "2", "1", "1"]
    assert files("a.quantification_of_editing_frequency")[0].startswith("Amplicon\tUnmodified%") and not files("b.r1.Modification_count_vectors")
    # as many steps for two references as for one
    size = lambda some: published.published(v, some, ["sample"])._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert size(refs) == size(refs[:1])


def test_nested_runs(spark, tmp_path):
    rows = lambda kind, *x: {"t": spark.createDataFrame(list(x), kind)}
    at = str(tmp_path / "all")
    runs.write(spark, f"{at}/b/one", "one", rows("a int", (1,), (2,)))
    runs.write(spark, f"{at}/b/w/two", "two", rows("a int, b string", (3, "x")))
    runs.write(spark, f"{at}/b/w", "w", {}, "wgs", parts=["two", "gone"])
    runs.write(spark, f"{at}/b", "b", {}, "batch", parts=["one", "w"])
    runs.write(spark, f"{at}/open", "open", rows("a int", (9,)), status="running")
    found = runs.unrolled(runs.catalogue(spark, at))
    assert {r.name: (r.status, r.part_of) for r in found.collect()} == {"one": ("complete", ["b"]), "two": ("complete", ["b", "w"]), "gone": ("missing", ["b", "w"]), "open": ("running", [])}
    assert sorted((r.run, r.a, r.b, r.part_of) for r in runs.table(spark, found, "t").collect()) == [("one", 1, None, ["b"]), ("one", 2, None, ["b"]), ("two", 3, "x", ["b", "w"])]
    with pytest.raises(ValueError, match="no complete run"):
        runs.table(spark, found.where("name = 'open'"), "t")


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    reads = spark.createDataFrame([("s", "ACGT")] * 3 + [("s", "TTTT")], "sample string, seq string")
    reads.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = ingest.reads(spark, str(tmp_path / "in"), "sample string, seq string", 1)
    ingest.merged(stream, str(tmp_path / "out"), ["sample"]).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.seq, r.n_reads) for r in ingest.totals(spark, str(tmp_path / "out"), ["sample"]).collect()) == [("ACGT", 3), ("TTTT", 1)]
