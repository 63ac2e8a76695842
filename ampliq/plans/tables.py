"""The tables that a run publishes, by name: per guide, coding, repair template, prime editing and base editing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alleles as A
from ..operators import amino, prime
from ..operators import positions as P
from ..operators.base_edits import base_edit_counts
from ..operators.multi import totals
from ..operators.quantify import editing
from ..operators.references import Guide, Reference
from ..sources.sinks import ALLELE_NAMES, EDITING_NAMES, base_edit_files, tsv, tsv_lines, wide_lines


def label(guide: Guide) -> str:
    return guide.name or f"sgRNA_{guide.seq}"


def per_guide(alleles: DataFrame, ref: Reference, source: str | None = None, target: str | None = None) -> dict[str, DataFrame]:
    """Tables around each guide of one reference, from its alleles (ref_name, aln_seq, aln_ref, read_status, n_deleted, n_inserted, n_mutated, n_reads): the
    alleles around the cut, and, for base editors, counts and percents of nucleotides at the source base and combinations of base edits in the guide."""
    own = alleles.where(F.col("ref_name") == ref.name)
    out: dict[str, DataFrame] = {}
    for g in ref.guides:
        name, half = label(g), len(g.plot) // 2
        out[f"{ref.name}.Alleles_frequency_table_around_{name}"] = A.with_percent(A.around_cut(own, [], F.lit(g.cut), half, half), [])
        if source is None or target is None:
            continue
        bases = P.nucleotides(own, []).where(F.col("pos").isin(g.plot) & F.col("pos").isin([k for k in g.plot if ref.seq[k] == source]))
        out[f"{ref.name}.Selected_nucleotide_frequency_table_around_{name}"] = bases
        all_reads = F.broadcast(own.agg(F.sum("n_reads").alias("_all")))  # one row
        out[f"{ref.name}.Selected_nucleotide_percentage_table_around_{name}"] = bases.crossJoin(all_reads).select("pos", "base", (100.0 * F.col("n") / F.col("_all")).alias("pct"))
        inside = list(range(g.start, g.end + 1))
        out |= {f"10i.{ref.name}.{name}.{k}": t for k, t in base_edit_counts(own, [], source, target, positions=inside).items()}
    if source is not None and ref.guides:
        out[f"{ref.name}.base_edit_{source}s_quilt"] = A.with_percent(A.at_target_base(own, [], source), [])
    return out


def guides_of(spark: SparkSession, refs: list[Reference]) -> DataFrame:
    """(ref_name, guide, cut, half, plot, inside): a row per guide, with the positions that its tables show and those it lies on."""
    rows = [(r.name, label(g), g.cut, len(g.plot) // 2, g.plot, list(range(g.start, g.end + 1))) for r in refs for g in r.guides]
    return spark.createDataFrame(rows, "ref_name string, guide string, cut int, half int, plot array<int>, inside array<int>")


def around_guides(alleles: DataFrame, keys: list[str], guides: DataFrame) -> DataFrame:
    """Alleles around the cut of every guide, in one plan whatever the number of references: (keys, ref_name, guide, aln_seq, aln_ref, unedited, n_deleted, n_inserted,
    n_mutated, n_reads, pct_reads), percents being those of the guide's reads."""
    keys = [*keys, "ref_name", "guide"]
    return A.with_percent(A.around_cut(alleles.join(guides, "ref_name"), keys, F.col("cut"), F.col("half"), F.col("half")), keys)


def base_edits_in_guides(alleles: DataFrame, keys: list[str], guides: DataFrame, source: str, target: str) -> dict[str, DataFrame]:
    """``base_edit_counts`` within every guide, by keys, ref_name and guide."""
    return base_edit_counts(alleles.join(guides, "ref_name"), [*keys, "ref_name", "guide"], source, target, positions=F.col("inside"))


#: The published rows of count vectors, and the kinds they hold.
VECTORS = {"Insertions": "insertion", "Insertions_Left": "insertion_left", "Deletions": "deletion", "Substitutions": "substitution", "All_modifications": "total", "Total": "reads"}


def published(variants: DataFrame, refs: list[Reference], keys: list[str]) -> DataFrame:
    """The lines (table, head, weight, line) of the tables of all keys and references in one plan, for ``publish_lines``: editing frequencies and alleles of each key; of
    each reference the counts of edits by position, over all and in the window, and of nucleotides; and the alleles around each guide.

    A table is called as published ones are, behind its keys and its reference."""
    spark = variants.sparkSession
    own = lambda *more: F.concat_ws(".", *keys, *more)
    guides, bases = guides_of(spark, refs), spark.createDataFrame([(r.name, r.seq) for r in refs], "ref_name string, ref_seq string")
    both, alleles = [*keys, "ref_name"], A.allele_table(variants, keys)
    reads = totals(variants, both)
    named = lambda name: own("ref_name", F.lit(name))
    there = lambda name: reads.select(named(name).alias("table"), "ref_name")

    def vectors(name: str, in_window: bool) -> DataFrame:
        labels = {k: v for k, v in VECTORS.items() if not (in_window and v == "insertion_left")}
        counts = P.with_totals(P.edit_positions(variants, both, in_window), both)
        every = reads.join(bases, "ref_name").select(*both, F.lit("reads").alias("kind"), F.explode(F.sequence(F.lit(0), F.length("ref_seq") - 1)).alias("pos"), F.col("n_reads").alias("n"))
        of_kind = F.element_at(F.create_map(*[F.lit(x) for k, v in labels.items() for x in (v, k)]), F.col("kind"))
        counts = counts.select(*both, "kind", "pos", "n").unionByName(every).select(named(name).alias("table"), of_kind.alias("label"), "pos", F.col("n").alias("value"))
        return wide_lines(counts, there(name), bases, list(labels), "Sequence")

    pile = P.nucleotides(variants, both).select(named("Nucleotide_frequency_table").alias("table"), F.col("base").alias("label"), "pos", F.col("n").cast("double").alias("value"))
    rates = editing(variants, both)
    around = around_guides(alleles, keys, guides)
    names = {c: ALLELE_NAMES.get(c, c) for c in around.columns if c not in (*keys, "ref_name", "guide")}
    parts = [
        tsv_lines(rates, own(F.lit("quantification_of_editing_frequency")), {c: n for c, n in EDITING_NAMES.items() if c in rates.columns}, F.lit(0)),
        tsv_lines(alleles, own(F.lit("Alleles_frequency_table")), {c: n for c, n in ALLELE_NAMES.items() if c in alleles.columns}, F.col("n_reads")),
        vectors("Modification_count_vectors", False), vectors("Quantification_window_modification_count_vectors", True),
        wide_lines(pile, there("Nucleotide_frequency_table"), bases, list(P.BASES)),
        tsv_lines(around, own("ref_name", F.concat(F.lit("Alleles_frequency_table_around_"), "guide")), names, F.col("n_reads")),
    ]
    return reduce(DataFrame.unionByName, parts)


def coding(alleles: DataFrame, ref: Reference, parts: list[tuple[str, str]], cut: int, width: int) -> dict[str, DataFrame]:
    """The amino acid table of each coding part (name, sequence) of one reference."""
    own = alleles.where(F.col("ref_name") == ref.name)
    return {f"{ref.name}.amino_acid_table_for_{name}": amino.amino_alleles(own, [], ref.seq.index(part.upper()), cut, width) for name, part in parts if part.upper() in ref.seq}


def repair_template(seen_from_first: DataFrame, keys: tuple[str, ...] = ("assigned_ref",)) -> dict[str, DataFrame]:
    """Percents of nucleotides and of edits by position of the first reference, for the reads of each reference (from ``prime.from_first``)."""
    keys = list(keys)
    all_reads = totals(seen_from_first, keys)
    return {
        "Reads_from_all_amplicons_nucleotide_percent_table": P.percents(P.nucleotides(seen_from_first, keys), all_reads, keys).drop("n"),
        "Reads_from_all_amplicons_modification_percent_table": P.percents(P.with_totals(P.edit_positions(seen_from_first, keys), keys), all_reads, keys).drop("n"),
    }


def prime_editing(variants: DataFrame, after: int, scaffold: str) -> dict[str, DataFrame]:
    """Sizes of the insertions of scaffold, from the reads in which it was found."""
    return {"Scaffold_insertion_sizes": prime.scaffold_sizes(variants.where(F.col("ref_name") == prime.SCAFFOLD), after, scaffold, ["aln_seq", "aln_ref"])}


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as tab-separated text in a folder of its own name; alleles under their published column names."""
    groups: dict[str, dict[str, DataFrame]] = {}
    for name, t in tables.items():
        if name.startswith("10i."):
            stem, form = name.rsplit(".", 1)
            groups.setdefault(stem, {})[form] = t
        else:
            tsv(t, f"{folder}/{name}.txt", {c: ALLELE_NAMES.get(c, c) for c in t.columns})
    for stem, found in groups.items():
        base_edit_files(found, f"{folder}/{stem}")

