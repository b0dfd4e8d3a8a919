"""Commands: serve, work, migrate and generate. Secrets come from FEEDWEIR_TOKEN_SECRET and FEEDWEIR_STAFF_CODE."""

from __future__ import annotations

import argparse
import os
import signal
import threading
from datetime import datetime, timezone
from wsgiref.simple_server import make_server

from pyspark.sql import SparkSession

from feedweir.control import migrations
from feedweir.control.config import Config
from feedweir.control.jobs import Imports
from feedweir.control.store import Store
from feedweir.control.web import application
from feedweir.sources import datagen


def work(imports: Imports) -> None:
    """Run imports until SIGTERM or SIGINT; an import in progress is paused at the end of its window and resumed by the next worker."""
    stop = threading.Event()
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, lambda *_: stop.set())
    imports.work(stop.is_set)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="feedweir")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("serve", "work", "migrate"):
        commands.add_parser(name).add_argument("root")
    commands.choices["serve"].add_argument("--port", type=int, default=8080)
    generate = commands.add_parser("generate")
    generate.add_argument("path")
    amount = generate.add_mutually_exclusive_group(required=True)
    amount.add_argument("--rows", type=int)
    amount.add_argument("--size", type=datagen.parse_size)
    generate.add_argument("--bad-rate", type=float, default=0.02)
    generate.add_argument("--dupe-rate", type=float, default=0.05)
    generate.add_argument("--seed", type=int, default=1)
    for flag in ("crlf", "bom", "shuffle"):
        generate.add_argument(f"--{flag}", action="store_true")
    a = parser.parse_args(arguments)
    if a.command == "generate":
        print(datagen.write_feed(a.path, rows_wanted=a.rows, size=a.size, bad_rate=a.bad_rate, dupe_rate=a.dupe_rate, seed=a.seed, crlf=a.crlf, bom=a.bom, shuffle=a.shuffle))
        return
    spark = SparkSession.builder.appName(f"feedweir {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "migrate":
        print(migrations.migrate(Store(spark, f"{a.root}/store"), migrations.STEPS, lambda: datetime.now(timezone.utc)))
        return
    config = Config(token_secret=os.environ.get("FEEDWEIR_TOKEN_SECRET", ""), staff_code=os.environ.get("FEEDWEIR_STAFF_CODE", "")).checked()
    if a.command == "work":
        work(Imports(Store(spark, f"{a.root}/store"), config, f"{a.root}/uploads"))
    else:
        make_server("", a.port, application(spark, a.root, config)).serve_forever()


if __name__ == "__main__":
    main()
