"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from ampliq.plans.derived import reads, references

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["A03_unique_reads", "B09_alignment_cigar", "C03_masked_bases", "D03_merged_alleles", "D06_region_genes", "F03_editing_quantification", "F04_all_edit_positions", "F07_nucleotide_pileup", "F16_alleles_around_cut", "F18_target_base_alleles", "F40_percentile_cut", "G06_previous_count", "J01_modification_summary", "B15_reference_values", "C04_all_quality_filters", "E02_best_reference", "F25_precise_combinations", "F28_scaffold_sizes", "F32_vcf_edits", "F35_guardrails", "F37_significant_positions", "H02_most_changed", "J08_pooled_mixed", "J14_rewindowed_alleles", "K06_base_edit_reads"]


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[k]) for k in at) for r in sql.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_references_are_those_of_all_reads(spark):
    assert sorted(references(spark, SF).collect()) == sorted(reads(spark, SF).select("ref_name", "ref_seq").distinct().collect())
