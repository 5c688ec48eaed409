"""Building small packages, for round trips and tests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.session import ship_package, spread  # noqa: F401  callers find spread() beside build()

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
ROOT = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


#: Parts from this size on are compressed: for smaller ones it takes longer than all else and saves next to nothing.
PACKED_FROM = 1024


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in ({"[Content_Types].xml": TYPES, "_rels/.rels": ROOT} | parts).items():
            archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED if len(data) >= PACKED_FROM else zipfile.ZIP_STORED, 1)
    return out.getvalue()


def document(body: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?><w:document {WORD}><w:body>{body}</w:body></w:document>'


def relationships(targets: dict[str, tuple[str, str | None]]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="t" Target="{escape(t)}"{f""" TargetMode="{m}" """ if m else ""}/>' for i, (t, m) in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def allowed(text: str) -> str:
    """Without the control characters that markup can't hold."""
    return "".join(c for c in text if c in "\t\n\r" or c >= " " and c not in "￾￿")


def run(text: str, props: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(allowed(text))}</w:t></w:r>'


def paragraph(text: str, props: str = "", run_props: str = "") -> str:
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{run(text, run_props) if text else ''}</w:p>"


#: Rows that become packages at once, so that a worker holds few of them.
ROWS_AT_ONCE = 64


@dataclass(frozen=True)
class Built:
    """Packages that whatever reads them builds in its own Python step: make(row) gives the parts of a row's package.

    Against build() this saves half of the Python workers and a way of all packages to them; names need no Python at all.
    """

    rows: DataFrame
    make: Callable[[dict], dict]


def named(rows: DataFrame) -> DataFrame:
    """rows with the names that their packages go by."""
    return rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")))


def packages_of(batch, make) -> Iterator[tuple[str, bytes]]:
    for i in range(0, batch.num_rows, ROWS_AT_ONCE):
        for row in batch.slice(i, ROWS_AT_ONCE).to_pylist():
            yield row["doc_id"], package(make(row))


def build(rows: DataFrame, make) -> DataFrame:
    """doc_id, content from doc_id and whatever columns make(row) turns into the parts of a package."""
    import pyarrow as pa

    ship_package(rows.sparkSession)

    def run_all(batches):
        for batch in batches:
            made = packages_of(batch, make)
            while some := list(islice(made, ROWS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.string()), pa.array([b for _, b in some], pa.binary())], names=["doc_id", "content"])

    return named(rows).mapInArrow(run_all, "doc_id string, content binary")
