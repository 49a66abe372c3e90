"""Command line: means, standard-deviations, covariances, new-header, crop.

    python -m bandwright.cli means --header image.json -o means.json
"""

from __future__ import annotations

import argparse
import os
import sys

from .errors import EngineError, InvalidArgs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bandwright")
    p.add_argument("--backend", choices=["glommio", "syscall", "mmap", "tokio"], help="accepted and without effect: there is one way to read")
    p.add_argument("--master", default=None, help="Spark master")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("means", "standard-deviations", "covariances"):
        c = sub.add_parser(name)
        c.add_argument("--header", required=True)
        c.add_argument("-o", "--output", required=True)
        if name != "means":
            c.add_argument("-m", "--means")
        if name == "covariances":
            c.add_argument("-s", "--std-devs")
    c = sub.add_parser("new-header")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-d", "--data-path", required=True)
    for k in ("channels", "lines", "pixels"):
        c.add_argument(f"-{k[0]}", f"--{k}", type=int, required=True)
    c = sub.add_parser("crop")
    c.add_argument("--header", required=True)
    c.add_argument("-o", "--output", required=True, help="data file; its header goes to the same path with .json")
    c.add_argument("-r", "--rows", type=int, nargs=2)
    c.add_argument("-c", "--cols", type=int, nargs=2)
    return p


def run(args: argparse.Namespace) -> None:
    from .sources.header import ImageHeader

    if args.command == "new-header":
        ImageHeader(args.channels, args.lines, args.pixels, args.data_path).save(args.output)
        return
    from pyspark.sql import SparkSession

    from .operators import crop, stats
    from .sources import bip, stats_json

    header = ImageHeader.load(args.header)
    builder = SparkSession.builder.appName("bandwright")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    cube = bip.read_bip(spark, args.header)
    if args.command == "crop":
        rows, cols = (tuple(x) if x else None for x in (args.rows, args.cols))
        out = crop.crop(cube, rows, cols, header.all_lines, header.pixels)
        n = header.cropped(rows, cols, os.path.abspath(args.output))
        bip.write_bip(out, n, f"{args.output}.json")
        return
    means = stats_json.load(args.means, header.channels) if getattr(args, "means", None) else None
    if args.command == "means":
        found = stats.as_vector(stats.band_means(cube))
    elif args.command == "standard-deviations":
        found = stats.as_vector(stats.band_stddevs(cube, means))  # own means where none are given
    else:
        devs = stats_json.load(args.std_devs, header.channels) if args.std_devs else None
        found = stats.as_matrix(stats.covariance(cube, means, devs))
    stats_json.save(args.output, found)


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except (EngineError, InvalidArgs) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
