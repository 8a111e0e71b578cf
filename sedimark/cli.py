"""Command line: ``python -m sedimark.cli COMMAND -p PROJECT``."""

from __future__ import annotations

import argparse
import json
import sys

from sedimark import render
from sedimark.operators.search import InvalidQuery
from sedimark.session import local_session
from sedimark.streaming.ingest import NoRoot


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sedimark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    add = {}
    for name in ("ingest", "query", "map", "styles", "audit", "loc", "config"):
        add[name] = commands.add_parser(name)
        add[name].add_argument("-p", "--project", required=True)
        add[name].add_argument("-j", "--json", action="store_true")
        add[name].add_argument("--no-auto-refresh", action="store_true")
    add["ingest"].add_argument("-f", "--force", action="store_true")
    add["query"].add_argument("-q", "--query", required=True)
    add["query"].add_argument("-s", "--scope")
    add["query"].add_argument("-k", type=int)
    add["styles"].add_argument("-c", "--component")
    add["styles"].add_argument("--class-name")
    add["styles"].add_argument("--property")
    add["audit"].add_argument("-s", "--severity", default="ALL")
    add["audit"].add_argument("-f", "--files")
    add["loc"].add_argument("-t", "--threshold", type=int, default=200)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """0 on success, 1 on a refused query, a missing project or a project without a root; argparse exits with 2."""
    from sedimark.api import Engine

    args = arguments(argv)
    try:
        engine = Engine(local_session(), args.project)
        if args.command == "ingest":
            result, text = engine.ingest(args.force, lambda m: print(m, file=sys.stderr)), None
        else:
            if not args.no_auto_refresh and args.command != "config":
                engine.sync()
            if args.command == "query":
                result = engine.query(args.query, args.scope, args.k)
                text = result.get("context", result["response"])
            elif args.command == "map":
                result = engine.project_map()
                text = result.get("text")
            elif args.command == "styles":
                result = engine.styles_map(args.component, args.class_name, args.property)
                text = render.styles_text(result) if result["status"] == "OK" else None
            elif args.command == "audit":
                result = engine.audit(args.severity, args.files)
                text = render.audit_text(result) if result["status"] == "OK" else None
            elif args.command == "loc":
                result = engine.code_metrics(args.threshold)
                text = render.metrics_text(result)
            else:
                ok, reason = engine.index.check()
                result = {"status": "OK", "project": engine.project, "index": engine.index.chunks.root, "usable": ok, "reason": reason}
                text = "\n".join(f"{k}: {v}" for k, v in result.items())
    except (InvalidQuery, NoRoot, FileNotFoundError, PermissionError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(json.dumps(result, default=str) if args.json or text is None else text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
