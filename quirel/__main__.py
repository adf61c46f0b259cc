"""`python -m quirel convert PATH` prints a file's Markdown; --json prints the whole result, `formats` what can be read.

Only files below the current folder are read. Exit code 1 with the error's code on standard error if a file can't be converted.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def result_json(name: str, data: bytes, by_content: bool = False) -> str:
    """A conversion's result as JSON, with the names of convert()'s columns."""
    from quirel.sources.convert import RESULT, convert_one

    return json.dumps(dict(zip([f.split()[0] for f in RESULT.split(", ")], convert_one(name, data, by_content))), ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quirel")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("path")
    c.add_argument("--json", action="store_true")
    c.add_argument("--by-content", action="store_true")
    sub.add_parser("formats")
    a = p.parse_args(argv)
    if a.command == "formats":
        from quirel.functions.text import SUPPORTED

        print("\n".join(f"{k}: {v}" for k, v in SUPPORTED.items()))
        return 0
    path = Path(a.path).resolve()
    if not path.is_relative_to(Path.cwd().resolve()):
        print("PATH_NOT_ALLOWED", file=sys.stderr)
        return 1
    if not path.is_file():
        print("io", file=sys.stderr)
        return 1
    got = json.loads(result_json(path.name, path.read_bytes(), a.by_content))
    if a.json:
        print(json.dumps(got, ensure_ascii=False))
    elif got["error_code"] is None:
        print(got["markdown"], end="")
    if got["error_code"] is not None:
        print(got["error_code"], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
