"""Converted documents as files: a folder with all of it, or one file with a report beside it; and folders read back."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from quire.operators.markup import RUNTIME, RUNTIME_FILE

MARKUP, REPORT, VALIDATION = "main.typ", "report.json", "validation.json"


def report(made: dict) -> dict:
    """What a conversion tells besides its markup: all records without their bytes."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if not isinstance(v, bytes)}
        if isinstance(x, (list, tuple)):
            return [bare(v) for v in x]
        return x

    return {k: bare(v) for k, v in made.items() if k != "markup"}


def as_json(record) -> bytes:
    return (json.dumps(record, indent=2, ensure_ascii=False) + "\n").encode()


def bundle_files(made: dict, runtime_file: str = RUNTIME_FILE) -> dict[str, bytes]:
    """Path to bytes of a document's folder."""
    held = {x["emitted_path"]: x["bytes"] for x in (*made["assets"], *made["embedded_fonts"]) if x["emitted_path"]}
    return {MARKUP: made["markup"].encode(), REPORT: as_json(report(made)), runtime_file: RUNTIME.encode()} | held


def single_files(made: dict, name: str, runtime_file: str = RUNTIME_FILE) -> dict[str, bytes]:
    """Path to bytes of one file, its report, its fonts and what it imports."""
    stem = name.rsplit(".", 1)[0] or name
    fonts = {f"{stem}.fonts/{x['emitted_path'].rsplit('/', 1)[-1]}": x["bytes"] for x in made["embedded_fonts"] if x["emitted_path"]}
    return {name: made["markup"].encode(), f"{stem}.report.json": as_json(report(made)), runtime_file: RUNTIME.encode()} | fonts


def write(files: dict[str, bytes], folder: Path) -> None:
    for path, data in files.items():
        target = (folder / path).resolve()
        if not target.is_relative_to(folder.resolve()):
            raise ValueError(f"{path} leads out of {folder}")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)


def unpack(rows: DataFrame, folder: Path) -> None:
    """Writes files (doc_id, path, content) below folder on this machine, those of a document in a folder of its name. For chosen documents."""
    for row in rows.toLocalIterator():
        write({row["path"]: bytes(row["content"])}, folder / row["doc_id"].replace("/", "_"))


def read(place: Path) -> tuple[str, dict]:
    """Markup and report of a bundle's folder, or of a single file with its report beside it."""
    if place.is_dir():
        return (place / MARKUP).read_text(encoding="utf-8"), json.loads((place / REPORT).read_bytes())
    beside = place.with_name(f"{place.stem}.report.json")
    return place.read_text(encoding="utf-8"), json.loads(beside.read_bytes()) if beside.exists() else {}
