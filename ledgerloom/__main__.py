"""Command line: ``python -m ledgerloom --build FOLDER --out FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .builder import GraphBuilder
from .sources import clusters


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom", description="Build the graph of software artifacts.")
    p.add_argument("-b", "--build", action="append", default=[], help="folder to read; may be repeated")
    p.add_argument("--file-list", action="append", default=[], help="text file with one path a line; may be repeated")
    p.add_argument("-o", "--out", required=True, help="folder for the graph's tables")
    p.add_argument("--exclude", help="pattern of file names to leave out")
    p.add_argument("--block", help="file with identifiers that are neither kept nor opened")
    p.add_argument("--cutoff", help="drop what was modified later: milliseconds or a date")
    p.add_argument("--tag", help="tag of the top-level artifacts")
    p.add_argument("--tag-version", help="version in the tag")
    p.add_argument("--package-tags", action="store_true", help="tag each package that a top-level artifact is")
    p.add_argument("--cbom", help="folder for bills of materials")
    p.add_argument("--ingested", help="text table to which the paths of what was read are appended")
    p.add_argument("--dump", help="folder for all items as JSON lines")
    p.add_argument("--scanner-reports", action="append", default=[], help="report of an external scanner, or a folder of them; may be repeated")
    p.add_argument("--tag-json", help="JSON to overlay on the tag")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = GraphBuilder(SparkSession.builder.appName("ledgerloom").getOrCreate()).with_output(args.out)
    builder.with_folder(*args.build).with_file_list(*args.file_list)
    if args.exclude:
        builder.with_exclude(args.exclude)
    if args.block:
        builder.with_block_list(args.block)
    if args.cutoff:
        builder.with_cutoff(args.cutoff)
    if args.tag:
        builder.with_tag(args.tag, args.tag_version, args.tag_json)
    if args.package_tags:
        builder.with_package_tags()
    if args.cbom:
        builder.with_bills(args.cbom)
    if args.ingested:
        builder.with_ingested_list(args.ingested)
    if args.scanner_reports:
        builder.with_scanner_reports(*args.scanner_reports)
    items, edges = builder.run()
    if args.dump:
        clusters.dump(items, edges, args.dump, builder.extra)


if __name__ == "__main__":
    main()
