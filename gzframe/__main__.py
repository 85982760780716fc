"""``python -m gzframe inspect|verify PATH [--json]``; exit 0: valid, 1: not valid, 2: wrong use."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from gzframe import __version__, kernel
from gzframe.sources.reader import _file_pieces


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m gzframe", description="Validate gzip files.")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, help_ in (("inspect", "members, after full validation"), ("verify", "headers, checksums and sizes")):
        command = commands.add_parser(name, help=help_)
        command.add_argument("path")
        command.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    report = kernel.Report()
    try:
        for _ in kernel.scan(_file_pieces(args.path), report, collect=args.command == "inspect"):
            pass
    except (kernel.GzipStreamError, OSError) as e:
        print(json.dumps({"ok": False, "error": str(e)}) if args.json else f"{args.path}: not valid: {e}", file=sys.stdout if args.json else sys.stderr)
        return 1
    sizes = {k: getattr(report, k) for k in ("member_count", "compressed_size", "uncompressed_size")}
    if args.json:
        found = {"members": [dataclasses.asdict(m) for m in report.members]} if args.command == "inspect" else {"ok": True}
        print(json.dumps(found | sizes, default=bytes.hex))
        return 0
    print(f"{args.path}: valid, " + ", ".join(f"{k} {v}" for k, v in sizes.items()))
    for m in report.members:
        print("  " + ", ".join(f"{k} {v.hex() if isinstance(v, bytes) else v}" for k, v in vars(m).items() if v is not None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
