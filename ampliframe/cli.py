"""Command line: the steps of a run, each from files to files, over the Spark session that ``spark-submit`` or the environment sets up.

    python -m ampliframe.cli filter reads/*.fastq.gz --out filtered --trunc-q 2 --max-ee 2
    python -m ampliframe.cli derep filtered --out uniques
    python -m ampliframe.cli learn-errors uniques --out rates
    python -m ampliframe.cli denoise uniques --rates rates --out variants
    python -m ampliframe.cli table variants --out table
    python -m ampliframe.cli remove-bimera table --out clean
    python -m ampliframe.cli assign-taxonomy clean --references refs.fasta --out taxonomy
    python -m ampliframe.cli summary reads/*.fastq.gz --out summary
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ampliframe.operators import denoise, derep, errors, reads, tables, taxonomy
from ampliframe.params import BimeraParams, DenoiseParams, FilterParams, LearnParams, TaxonomyParams
from ampliframe.sources import files

VARIANTS = "sample_id string, asv_idx int, seq string, abundance long"


def _inputs(spark: SparkSession, paths: Sequence[str]):
    parts = [files.read_reads(spark, p) for p in files.checked_paths(list(paths))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _filter(spark: SparkSession, a: argparse.Namespace) -> None:
    given = {k: getattr(a, k) for k in ("trunc_q", "trunc_len", "min_len", "max_len", "max_ee", "max_n", "trim_left", "trim_right") if getattr(a, k) is not None}
    rows = _inputs(spark, a.inputs)
    files.write_stage(reads.filtered(rows, FilterParams(**given)), a.out, "filter")


def _derep(spark: SparkSession, a: argparse.Namespace) -> None:
    columns = "sample_id string, read_no long, name string, descr string, seq string, qual string"
    rows = files.read_stage(spark, a.inputs[0], columns, ["filter"])
    files.write_stage(derep.dereplicate(rows), a.out, "derep")


def _learn(spark: SparkSession, a: argparse.Namespace) -> None:
    err, _ = errors.learn_errors(files.read_uniques(spark, a.inputs[0]), LearnParams(bases=a.bases, seed=a.seed, model=a.model))
    errors.to_table(spark, err).coalesce(1).write.option("header", True).csv(a.out)


def _denoise(spark: SparkSession, a: argparse.Namespace) -> None:
    table = files.checked_rates(files.read_rates(spark, a.rates))
    nq = table.agg(F.max("q")).collect()[0][0] + 1
    err = errors.to_matrix(table.withColumn("n", F.col("rate")), nq)
    uniques, params = files.read_uniques(spark, a.inputs[0]), DenoiseParams()
    if a.mode == "pooled":
        found = denoise.denoise_pooled(uniques, err, params)
    else:
        run = denoise.denoise_pseudo if a.mode == "pseudo" else denoise.denoise
        found = denoise.variants(run(uniques, err, params)).withColumn("abundance", F.col("kept_abundance"))
    files.write_stage(found.select("sample_id", "asv_idx", "seq", "abundance"), a.out, "denoise")


def _table(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [files.read_counts(spark, p) for p in files.checked_paths(a.inputs)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    files.write_stage(tables.sequence_table(rows), a.out, "table")


def _remove_bimera(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_stage(tables.without_bimeras(files.read_counts(spark, a.inputs[0]), BimeraParams(method=a.method)), a.out, "table")


def _assign_taxonomy(spark: SparkSession, a: argparse.Namespace) -> None:
    params = TaxonomyParams(min_boot=a.min_boot)
    found = taxonomy.assign_taxonomy(files.read_queries(spark, a.inputs[0]), files.read_fasta(spark, a.references), params)
    files.write_tsv(files.taxonomy_table(found, list(params.levels)), a.out)


def _summary(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _inputs(spark, a.inputs).withColumn("read_id", F.col("name"))
    files.write_tsv(reads.cycle_histogram(rows).orderBy("sample_id", "pos", "q"), a.out)


COMMANDS = {
    "filter": _filter, "derep": _derep, "learn-errors": _learn, "denoise": _denoise, "table": _table,
    "remove-bimera": _remove_bimera, "assign-taxonomy": _assign_taxonomy, "summary": _summary,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ampliframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        step = steps.add_parser(name)
        step.add_argument("inputs", nargs="+")
        step.add_argument("--out", required=True)
        if name == "filter":
            for option in ("trunc-q", "trunc-len", "min-len", "max-len", "max-n", "trim-left", "trim-right"):
                step.add_argument(f"--{option}", type=int)
            step.add_argument("--max-ee", type=float)
        elif name == "learn-errors":
            step.add_argument("--bases", type=float, default=LearnParams().bases)
            step.add_argument("--seed", type=int)
            step.add_argument("--model", choices=sorted(errors.MODELS), default="loess")
        elif name == "denoise":
            step.add_argument("--rates", required=True)
            step.add_argument("--mode", choices=("sample", "pooled", "pseudo"), default="sample")
        elif name == "remove-bimera":
            step.add_argument("--method", choices=("consensus", "pooled", "per-sample"), default="consensus")
        elif name == "assign-taxonomy":
            step.add_argument("--references", required=True)
            step.add_argument("--min-boot", type=int, default=TaxonomyParams().min_boot)
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    COMMANDS[a.command](spark or SparkSession.builder.appName("ampliframe").getOrCreate(), a)


if __name__ == "__main__":
    main()
