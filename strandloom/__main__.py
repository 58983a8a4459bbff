"""Command line: `python -m strandloom assemble|filter|evaluate|settings ...`."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from . import evaluate, stages
from .sources import formats
from .sources.config import read_config


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandloom")
    parser.add_argument("--log", help="a file to which messages are added")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("filter", help="transcripts of at least each depth, a folder for each")
    one.add_argument("fasta")
    one.add_argument("out")
    one.add_argument("--thresholds", default="0,1,2,4,6,8,12,16")
    two = commands.add_parser("evaluate", help="best matches of a table of alignment hits, and how many there are")
    two.add_argument("hits")
    two.add_argument("out")
    two.add_argument("--cover", type=float, default=0.8)
    two.add_argument("--length", type=int, default=300)
    two.add_argument("--transcripts", help="the FASTA whose transcripts were aligned, to be counted")
    three = commands.add_parser("settings", help="the settings of a file with their defaults")
    three.add_argument("path")
    four = commands.add_parser("assemble", help="contigs of a file to segments, edges and transcripts")
    four.add_argument("contigs")
    four.add_argument("out")
    four.add_argument("settings", help="a settings file")
    asked = parser.parse_args(args)
    logging.basicConfig(filename=asked.log, level=logging.INFO, format="%(asctime)s %(message)s", force=True)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    if asked.command == "filter":
        counts = formats.write_by_threshold(formats.read_transcripts(spark, asked.fasta), asked.out, [float(x) for x in asked.thresholds.split(",")])
        for row in counts.orderBy("threshold").collect():  # one row for each threshold
            logging.info("depth %s: %s transcripts", row.threshold, row.n)
    elif asked.command == "evaluate":
        matches = evaluate.with_names(evaluate.best_hits(formats.read_hits(spark, asked.hits), asked.cover, asked.length))
        found = formats.fasta_counts(spark, asked.transcripts, asked.length).first()[1] if asked.transcripts else None
        formats.write_matches(matches, asked.out, found)
        for row in evaluate.recovered(matches).orderBy("share").collect():  # one row for each share
            logging.info("covered %s: %s matches, fit %s", row.share, row.n, row.r2)
    elif asked.command == "assemble":
        for what, n in stages.assemble(spark, asked.contigs, asked.out, read_config(spark, asked.settings)).items():
            logging.info("%s: %s", what, n)
    else:
        logging.info("%s", read_config(spark, asked.path))


if __name__ == "__main__":
    main()
