"""Command line of a store: `python -m tessera.cli [store] PATH COMMAND ...`.

Exit codes: 0 done, 1 the operation failed, 2 wrong usage, 3 verify has findings, 4 not found.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from tessera.functions import states as S
from tessera.store.errors import StoreError
from tessera.store.model import CommitBatch, new_id, parse_id

DONE, FAILED, USAGE, FINDINGS, NOT_FOUND = range(5)


def state(text: str) -> int:
    name = text.replace("-", "_").replace("retrywait", "retry_wait")
    if name not in S.STATES:
        raise argparse.ArgumentTypeError(f"no state: {text}")
    return S.STATES.index(name)


def hexed(text: str) -> bytes:
    try:
        return bytes.fromhex(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    out.add_argument("path")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("doctor", "verify", "stats"):
        commands.add_parser(name)
    events = commands.add_parser("events").add_subparsers(dest="action", required=True)
    events.add_parser("tail").add_argument("--limit", type=int, default=10)
    stream = events.add_parser("stream")
    stream.add_argument("id")
    stream.add_argument("--from", dest="first", type=int, default=1)
    stream.add_argument("--limit", type=int, default=100)
    projections = commands.add_parser("projections").add_subparsers(dest="action", required=True)
    projections.add_parser("list")
    scan = projections.add_parser("scan")
    scan.add_argument("name")
    scan.add_argument("--prefix", type=hexed, default=b"")
    scan.add_argument("--limit", type=int, default=100)
    get = projections.add_parser("get")
    get.add_argument("name")
    get.add_argument("key", type=hexed)
    jobs = commands.add_parser("jobs").add_subparsers(dest="action", required=True)
    listing = jobs.add_parser("list")
    listing.add_argument("--queue")
    listing.add_argument("--state", type=state)
    listing.add_argument("--after", type=int, default=0)
    listing.add_argument("--limit", type=int, default=100)
    jobs.add_parser("show").add_argument("id")
    jobs.add_parser("uncertain")
    resolve = jobs.add_parser("resolve")
    resolve.add_argument("id")
    resolve.add_argument("resolution", choices=("retry", "succeeded", "dead"))
    backup = commands.add_parser("backup")
    backup.add_argument("dest")
    backup.add_argument("--overwrite", action="store_true")
    export = commands.add_parser("diagnostic-export")
    export.add_argument("--out")
    export.add_argument("--include-payloads", action="store_true")
    commands.add_parser("migrations").add_subparsers(dest="action", required=True).add_parser("status")
    return out


def show(value) -> None:
    print(json.dumps(value, default=lambda v: bytes(v).hex(), sort_keys=True))


def run(store, args) -> int:
    """One command on an open store."""
    what = (args.command, getattr(args, "action", None))
    if what[0] in ("doctor", "verify", "stats"):
        if what[0] != "verify":
            show(store.stats())
        found = store.verify() if what[0] != "stats" else []
        for check, detail in found:
            print(f"{check}: {detail}")
        return FINDINGS if found else DONE
    if what == ("events", "tail"):
        rows = store.last_events(args.limit)
    elif what == ("events", "stream"):
        if not store.stream_version(args.id):
            return NOT_FOUND
        rows = store.stream_events(args.id, args.first, args.limit)
    elif what == ("projections", "list"):
        rows = store.projections_list()
    elif what == ("projections", "scan"):
        rows = [{"key": k, "value": v} for k, v in store.projection_scan_prefix(args.name, args.prefix, args.limit)]
    elif what == ("projections", "get"):
        value = store.projection_get(args.name, args.key)
        if value is None:
            return NOT_FOUND
        rows = [{"value": value}]
    elif what == ("jobs", "list"):
        rows, cursor = store.jobs_page(args.queue, args.state, args.after, args.limit)
    elif what == ("jobs", "uncertain"):
        rows = store.jobs(state=S.UNCERTAIN)
    elif what == ("jobs", "show"):
        found = store.job(parse_id(args.id))
        if not found:
            return NOT_FOUND
        rows = [found]
    elif what == ("jobs", "resolve"):
        if not store.job(parse_id(args.id)):
            return NOT_FOUND
        rows = [store.commit(CommitBatch(new_id(), time.time_ns() // 1_000_000).resolve_uncertain_job(parse_id(args.id), args.resolution))]
    elif what[0] == "backup":
        store.backup(args.dest, args.overwrite)
        rows = []
    elif what[0] == "diagnostic-export":
        made = store.diagnostic_export(args.include_payloads)
        if args.out:
            made.write.text(args.out)
        else:
            for r in made.toLocalIterator():
                print(r["value"])
        rows = []
    else:
        rows = store.migrations_status()
    for row in rows:
        show(row)
    if what == ("jobs", "list") and len(rows) == args.limit:
        print(f"next: --after {cursor}")
    return DONE


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["store"]:
        argv = argv[1:]
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else DONE
    from tessera.session import local_session
    from tessera.store import Store

    spark = spark or local_session("tessera", cores=2, memory="1g")
    try:
        writes = (args.command, getattr(args, "action", None)) == ("jobs", "resolve")
        Store.open_existing(spark, args.path)
        return run((Store.open if writes else Store.open_existing)(spark, args.path), args)
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
