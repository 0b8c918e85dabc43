"""Command line: ``index``, ``scan`` and ``mask`` over files every executor can read."""

from __future__ import annotations

import argparse
import sys
from functools import reduce
from itertools import groupby

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.index import Index, build_index, load_index, save_index
from .plans.mask import mask
from .plans.scan import rejected_queries, scan
from .profile import (
    MAX_REF_LEN, NO_OPTIONS, OPTIONS, RUN_OPTIONS, Profile, RunOptions, options_of_file, parse_options, profile_of,
    profiles_from_toml,
)
from .sources.fasta import RECORD_BITS, expanded, read_fasta, read_records, write_records
from .sources.paf import write_paf

_FASTA_SUFFIX = (".fa", ".fasta", ".fna", ".fa.gz", ".fasta.gz", ".fna.gz", ".fa.bz2", ".fasta.bz2", ".fna.bz2")


# File numbers set aside for a table whose ids are dense: 2^44 records.
TABLE_FILES = 1 << 12


def by_table(path: str) -> bool:
    """Whether a path is read through Spark's readers; the others are streamed file by file."""
    return path.endswith((".parquet", *_FASTA_SUFFIX))


def read_table_path(spark: SparkSession, path: str, first_file: int) -> DataFrame:
    """A Parquet folder with a ``seq_id``, or FASTA through the splittable reader; ids moved to their place."""
    t = spark.read.parquet(path) if path.endswith(".parquet") else read_fasta(spark, path)
    at = F.col("seq_id").cast("long")
    outside = (at < 0) | (at >= TABLE_FILES << RECORD_BITS)
    message = F.concat(F.lit(f"record number outside its range in {path}: "), at.cast("string"))
    return t.withColumn("seq_id", F.when(outside, F.raise_error(message).cast("long")).otherwise(at + (first_file << RECORD_BITS)))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files one after the other; ``block`` is the place of the path.

    Ids sort by (path, file, record).  Files that are streamed one after the other
    are one table, however many there are.
    """
    tables, first = [], 0
    for tabular, run in groupby(enumerate(paths), lambda x: by_table(x[1])):
        if tabular:
            for i, p in run:
                tables.append(read_table_path(spark, p, first).withColumn("block", F.lit(i)))
                first += TABLE_FILES
            continue
        files = [(i, f) for i, p in run for f in expanded(p)]
        blocks = spark.createDataFrame([(first + k, i) for k, (i, _) in enumerate(files)], "_file long, block int")
        rows = read_records(spark, [f for _, f in files], first_file=first)
        rows = rows.withColumn("_file", F.shiftright("seq_id", RECORD_BITS))
        tables.append(rows.join(blocks, "_file") if len({i for i, _ in files}) > 1 else rows.withColumn("block", F.lit(files[0][0])))
        tables[-1] = tables[-1].drop("_file")
        first += len(files)
    if first > 1 << 31:
        raise ValueError("too many files for the record ids")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_rejected(queries: DataFrame, path: str) -> int:
    """Names of the query records a scan leaves out, as text; nothing is written if there are none."""
    rejected = rejected_queries(queries)
    count = rejected.count()
    if count:
        rejected.orderBy("seq_id").select("name").write.text(path)
        print(f"{count} query records cannot be read, see {path}", file=sys.stderr)
    return count


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seedloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("index", "scan"):
        p = sub.add_parser(name)
        if name == "index":
            p.add_argument("-d", dest="index_path", help="index folder to write")
            p.add_argument("references", nargs="+")
        else:
            p.add_argument("-o", dest="out", required=True, help="folder for the PAF text")
            p.add_argument("reference", help="index folder or reference file")
            p.add_argument("queries", nargs="+")
            p.add_argument("--standard-paf", action="store_true")
        p.add_argument("-L", dest="lenient", action="store_true", help="skip references of over 32,767 bases")
        p.add_argument("-x", dest="preset", help="file with options")
        p.add_argument("-z", dest="profiles", help="TOML file with profiles")
        for flag, (attr, conv) in OPTIONS.items():
            if conv is None:
                p.add_argument(flag, dest=f"opt_{attr}", action="store_true")
            else:
                p.add_argument(flag, dest=f"opt_{attr}", type=conv)
    p = sub.add_parser("mask")
    p.add_argument("-F", dest="alignments", help="PAF text")
    p.add_argument("-o", dest="out", required=True)
    p.add_argument("-G", dest="patch_gap", type=int, help="join gaps shorter than this")
    p.add_argument("-M", dest="patch_margin", type=int)
    p.add_argument("-x", dest="preset", help="file with options")
    p.add_argument("reads", nargs="+")
    return top


def options_of(args: argparse.Namespace) -> RunOptions:
    """The options of the preset file under those of the command line."""
    given: list[str] = []
    for flag, (attr, conv) in OPTIONS.items():
        value = getattr(args, f"opt_{attr}", None)
        if conv is None:
            given += [flag] if value else []
        elif value is not None:
            given += [flag, str(value)]
    run = {n: getattr(args, n, None) for n, _ in RUN_OPTIONS.values() if n != "preset"}
    said = RunOptions({}, {n: v for n, v in run.items() if v not in (None, False)})
    preset = options_of_file(args.preset) if args.preset else NO_OPTIONS
    return said.over(parse_options(given).over(preset))


def profiles_of(options: RunOptions) -> list[Profile]:
    base = profile_of(options)
    return profiles_from_toml(options.run["profiles"], base) if "profiles" in options.run else [base]


def length_of(options: RunOptions) -> dict[str, Any]:
    return {"strict": False, "max_length": MAX_REF_LEN} if options.run.get("lenient") else {}


def open_index(spark: SparkSession, path: str, options: RunOptions) -> Index:
    header = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    if header.getFileSystem(spark._jsc.hadoopConfiguration()).exists(header):
        return load_index(spark, path).with_parameters(**options.profile)
    return build_index(read_files(spark, [path]), profiles_of(options), **length_of(options))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    options = options_of(args)
    spark = spark or SparkSession.builder.appName("seedloom").getOrCreate()
    if args.command == "index":
        if "index_path" not in options.run:
            parser.error("index needs -d, on the command line or in the option file")
        references = [*options.words, *args.references]
        save_index(build_index(read_files(spark, references), profiles_of(options), **length_of(options)), options.run["index_path"])
    elif args.command == "scan":
        queries = read_files(spark, args.queries)
        write_rejected(queries, f"{args.out.rstrip('/')}.rejected")
        found = scan(queries, open_index(spark, args.reference, options))
        write_paf(found, args.out, standard=args.standard_paf)
    else:
        if "alignments" not in options.run:
            parser.error("mask needs -F, on the command line or in the option file")
        gap, margin = options.run.get("patch_gap", 0), options.run.get("patch_margin", 0)
        write_records(mask(read_files(spark, args.reads), options.run["alignments"], gap, margin), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
