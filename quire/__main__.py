"""Command line for single documents: convert, validate, inspect, explain. Many documents go through quire.plans.convert."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quire.operators.office import BadPackage, Catalogs, Package
from quire.operators.syntax import syntax_errors
from quire.plans import convert as C
from quire.sources import bundle


def validation(markup: str) -> dict:
    found = [{"code": "TYPST_SYNTAX_ERROR", "severity": "error", "message": message, "context": {"offset": at}} for at, message in syntax_errors(markup)]
    return {"structure_ok": not found, "diagnostics": found}


def convert(args) -> int:
    options = C.load_profile(Path(args.profile).read_text(encoding="utf-8")) if args.profile else {}
    target = Path(args.output)
    single = args.single_file or options.get("output_mode") == "single_file"
    options |= {"output_mode": "single_file" if single else "bundle", "output_path": str(target)}
    made = C.convert_one(Path(args.input).read_bytes(), options)
    runtime = options.get("runtime_file") or bundle.RUNTIME_FILE
    files, folder = (bundle.single_files(made, target.name, runtime), target.parent) if single else (bundle.bundle_files(made, runtime), target)
    checked = validation(made["markup"])
    if args.validate:
        files[bundle.VALIDATION] = bundle.as_json(checked)
    bundle.write(files, folder)
    if args.report:
        Path(args.report).write_bytes(bundle.as_json(bundle.report(made)))
    for d in made["diagnostics"]:
        print(f"{d['severity']}: {d['code']}: {d['message']}", file=sys.stderr)
    return 0 if checked["structure_ok"] or not args.validate else 1


def validate(args) -> int:
    place = Path(args.input)
    markup = C.convert_one(place.read_bytes(), {})["markup"] if place.suffix == ".docx" else bundle.read(place)[0]
    found = validation(markup)
    print(json.dumps(found, indent=2, ensure_ascii=False))
    return 0 if found["structure_ok"] else 1


def inspect(args) -> int:
    package = Package(Path(args.input).read_bytes())
    held = Catalogs(package)
    print(json.dumps({"package_parts": sorted(package.parts), "fonts": held.font_names, "theme_colors": dict(held.colors), "theme_fonts": dict(held.theme_fonts), "embedded_fonts": [f"{f['family']} ({f['variant']})" for f in held.embedded]}, indent=2, ensure_ascii=False))
    return 0


def explain(args) -> int:
    print(C.explain(args.code))
    return 0 if args.code in C.MEANINGS else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("convert", help="a package to markup, as a folder or one file")
    one.add_argument("input")
    one.add_argument("--output", "-o", required=True)
    one.add_argument("--profile")
    one.add_argument("--single-file", action="store_true")
    one.add_argument("--report")
    one.add_argument("--validate", action="store_true")
    one.set_defaults(run=convert)
    for name, run, what in (("validate", validate, "a package, a folder or a markup file"), ("inspect", inspect, "a package")):
        one = commands.add_parser(name, help=what)
        one.add_argument("input")
        one.set_defaults(run=run)
    one = commands.add_parser("explain", help="what a diagnostic's code means")
    one.add_argument("code")
    one.set_defaults(run=explain)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (BadPackage, OSError, ValueError) as e:
        print(f"quire: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
