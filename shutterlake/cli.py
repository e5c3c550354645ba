"""Command line: ``python -m shutterlake scan FOLDER``."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys
import threading
import time
from datetime import date, datetime

from . import __version__
from .operators.frames import Options

PROGRAM = "shutterlake"


def day(text: str) -> date:
    try:
        return date.fromisoformat(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"{text!r} is not a date like 2024-06-21") from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(PROGRAM, description="How a library of photographs was shot, from the headers of its files.")
    p.add_argument("--version", action="version", version=f"{PROGRAM} {__version__}")
    scan = p.add_subparsers(dest="command", metavar="COMMAND").add_parser("scan", help="read a folder and write a report")
    scan.add_argument("folder")
    scan.add_argument("-o", "--output", metavar="PATH", help="the HTML report (atlas.html unless --json is given alone)")
    scan.add_argument("--json", metavar="PATH", nargs="?", const="-", dest="json_path", help="the report as JSON; without a path, to standard output")
    scan.add_argument("--since", type=day, metavar="DATE")
    scan.add_argument("--until", type=day, metavar="DATE")
    scan.add_argument("--camera", metavar="TEXT", help="only bodies whose name contains TEXT")
    scan.add_argument("--lens", metavar="TEXT", help="only lenses whose name contains TEXT")
    scan.add_argument("--precise-gps", action="store_true", help="positions to five decimal places, about a metre")
    scan.add_argument("--no-gps", action="store_true", help="no positions at all")
    scan.add_argument("--cluster-km", type=float, default=25.0, metavar="KM")
    scan.add_argument("--workers", type=int, metavar="N", help="tasks that read at once")
    scan.add_argument("--quiet", action="store_true")
    return p


def session(workers: int | None):
    from pyspark.sql import SparkSession

    active = SparkSession.getActiveSession()
    cores = workers or max(2, min(16, 2 * (os.cpu_count() or 2)))
    build = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    return active or build.getOrCreate()


class Progress:
    """Says how many parts of a job are done while it runs, at intervals, from the tasks that Spark has ended."""

    def __init__(self, spark, say, every: float = 2.0):
        self.context, self.say, self.every = spark.sparkContext, say, every
        self.over, self.thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def now(self) -> str | None:
        tracker, done, parts = self.context.statusTracker(), 0, 0
        for stage in tracker.getActiveStageIds():
            if info := tracker.getStageInfo(stage):
                done, parts = done + info.numCompletedTasks, parts + info.numTasks
        return f"  reading: {done} of {parts} parts" if parts else None

    def _run(self) -> None:
        said = None
        while not self.over.wait(self.every):
            if (now := self.now()) and now != said:
                self.say(said := now)

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()


def scan(args: argparse.Namespace, say=None) -> int:
    from .plans.report import report
    from .sinks import document, page, text
    from .sources.images import read_images

    say = say or (lambda *x: print(*x, file=sys.stderr))
    folder = os.path.abspath(os.path.expanduser(args.folder))
    wrong = (
        f"not a folder: {args.folder}" if not os.path.isdir(folder)
        else "--precise-gps and --no-gps exclude each other" if args.precise_gps and args.no_gps
        else "the day of --until comes before that of --since" if args.since and args.until and args.since > args.until
        else None
    )
    if wrong:
        say(f"{PROGRAM}: {wrong}")
        return 2
    tell = (lambda *x: None) if args.quiet else say
    o = Options(args.since, args.until, args.camera, args.lens, "off" if args.no_gps else "precise" if args.precise_gps else "round", max(0.1, args.cluster_km))
    spark, began = session(args.workers), time.perf_counter()
    bronze = read_images(spark, folder).persist()
    try:
        with contextlib.nullcontext() if args.quiet else Progress(spark, say):
            files = bronze.count()
        took = max(time.perf_counter() - began, 1e-9)
        if not files:
            say(f"{PROGRAM}: no image files under {folder}")
            return 1
        meta = {"version": __version__, "root": folder, "generated": f"{datetime.now():%d %B %Y at %H:%M}", "elapsed_seconds": took, "files_per_second": files / took}
        found = report(bronze, o, meta)
    finally:
        bronze.unpersist()
    if args.json_path == "-":
        sys.stdout.write(document.to_json(found))
    elif args.json_path:
        document.put(args.json_path, document.to_json(found))
        tell(f"  wrote {args.json_path}")
    if args.output or args.json_path is None:
        out = args.output or "atlas.html"
        document.put(out, page.render(found))
        tell(f"  wrote {out} ({os.path.getsize(out) // 1024} KB)")
    tell(text.summary(found))
    tell(f"  read {text.some(files, 'file')} in {took:.2f}s, {files / took:,.0f} a second")
    if o.gps == "precise":
        tell(f"  warning: the report has precise positions of {text.some(found['locations']['photos'], 'frame')}")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command != "scan":
        p.print_help()
        return 1
    try:
        return scan(args)
    except KeyboardInterrupt:
        print(f"{PROGRAM}: interrupted", file=sys.stderr)
        return 130
