"""Converting, inspecting and validating packages.

A document is converted in one narrow pass: nothing is shuffled, a document's failure is a row of its own, and the side
tables are columns of arrays that explode where they are wanted. Options are a dictionary: output_mode (bundle or
single_file), output_path, runtime_file, paragraph_styles ({name: {heading_level}}), fonts ({substitutions,
embedded_paths}), reference_diff_threshold, max_package_bytes (of
all parts, unpacked), max_columns (of a table); other keys of a profile are taken and have no effect.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.body import MOST_COLUMNS, Body
from quire.operators.compare import dice_by_key, within_threshold
from quire.operators.markup import RUNTIME, RUNTIME_FILE, Writer
from quire.operators.office import MOST_BYTES, BadPackage, Catalogs, Package
from quire.operators.syntax import syntax_errors
from quire.plans.session import ship_package
from quire.sources.build import Built
from quire.sources.package import by_document

DIAGNOSTIC = "struct<code: string, severity: string, message: string, part: string, path: string, context: map<string, string>>"
CONVERTED = (
    "doc_id string, status string, error string, markup string, parts long, n_assets long, paragraphs long, tables long, sections long, "
    "assets array<struct<id: string, original_path: string, media_type: string, emitted_path: string, alt_text: string, bytes: binary>>, "
    "embedded_fonts array<struct<family: string, variant: string, original_path: string, media_type: string, emitted_path: string, subsetted: boolean, obfuscated: boolean, usable: boolean, rights: string, no_subsetting: boolean, bitmap_only: boolean, bytes: binary>>, "
    "fallbacks array<struct<id: string, kind: string, feature: string, asset_id: string, alt_text: string, width_emu: long, height_emu: long, part: string, path: string>>, "
    f"fallback_inventory array<string>, diagnostics array<{DIAGNOSTIC}>, "
    "font_decisions array<struct<requested: string, resolved: string, reason: string, part: string, path: string>>, font_search_paths array<string>"
)
INSPECTED = f"doc_id string, error string, package_parts array<string>, relationships map<string, array<string>>, styles array<string>, fonts array<string>, embedded_fonts array<string>, theme_colors map<string, string>, theme_fonts map<string, string>, diagnostics array<{DIAGNOSTIC}>"
DEFAULT_THRESHOLD = 85
#: What the codes of diagnostics mean.
MEANINGS = {
    "WML_UNSUPPORTED_BODY_CHILD": "The body of the document holds an element that is neither a paragraph, a table nor a section end; it was skipped.",
    "WML_UNSUPPORTED_INLINE_CONTAINER": "A container inside a paragraph has no counterpart in the markup; what it holds may be missing.",
    "FONT_SUBSTITUTION": "The profile gives another font for one that the document asks for; the location is where that font was first used.",
    "DOCX_EMBEDDED_FONT_LICENSE": "The document brings a font whose licence bits forbid taking it out, so it was left behind.",
    "DOCX_EMBEDDED_FONT_MISSING_RELATIONSHIP": "The font table points to an embedded font through a relationship that isn't there.",
    "DOCX_EMBEDDED_FONT_MISSING_PART": "The font table's relationship leads to a part that the package doesn't hold.",
    "DOCX_EMBEDDED_FONT_DEOBFUSCATION_FAILED": "The key of a scrambled embedded font is missing or malformed, so its bytes can't be restored.",
    "DOCX_FALLBACK_RENDERED_ASSET": "A drawing or an equation can't be shown as markup; a picture with its text stands in its place.",
    "REFERENCE_PDF_LOAD_ERROR": "The document to compare with couldn't be read.",
    "REFERENCE_PDF_PARSE_ERROR": "The rendered document couldn't be read back for the comparison.",
    "REFERENCE_PAGE_COUNT_MISMATCH": "The rendered document and its reference have different numbers of pages.",
    "REFERENCE_TEXT_EXTRACT_ERROR": "No text could be taken from one of the two documents that were to be compared.",
    "REFERENCE_TEXT_BELOW_THRESHOLD": "Too few words of the rendered document and its reference agree.",
    "TYPST_SYNTAX_ERROR": "The markup that was written isn't well-formed.",
    "TYPST_WARNING": "The typesetter accepted the markup but complained about it.",
    "TYPST_COMPILE_ERROR": "The typesetter rejected the markup.",
    "TYPST_PDF_ERROR": "The markup was typeset, but writing the PDF went wrong.",
}
UNKNOWN = "No diagnostic has this code."


def explain(code: str) -> str:
    return MEANINGS.get(code, UNKNOWN)


def explain_column(code):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair]), code), F.lit(UNKNOWN))


def load_profile(text: str) -> dict:
    """Options from the text of a TOML profile."""
    profile = tomllib.loads(text)
    return {**profile, "reference_diff_threshold": profile.get("validation", {}).get("reference_diff_threshold")}


def convert_one(content: bytes, options: dict) -> dict:
    package = Package(content, options.get("max_package_bytes") or MOST_BYTES)
    body = Body(package, Catalogs(package), options.get("paragraph_styles"), most_columns=options.get("max_columns") or MOST_COLUMNS).read()
    writer = Writer(body, options)
    markup = writer.write()
    top = [b["is"] for s in body.sections for b in s["blocks"] if not b.get("list")]
    return {
        "markup": markup, "parts": len(package.parts), "n_assets": len(body.assets), "paragraphs": sum(x != "table" for x in top), "tables": sum(x == "table" and not _in_list(s["blocks"], i) for s in body.sections for i, x in enumerate(b["is"] for b in s["blocks"])), "sections": len(body.sections),
        "assets": [writer.assets[a["id"]] for a in body.assets.values()], "embedded_fonts": writer.embedded, "fallbacks": body.fallbacks, "fallback_inventory": [f"{f['kind']}:{f['feature']}" for f in body.fallbacks],
        "diagnostics": [{**d, "context": list(d["context"].items())} for d in body.diagnostics + writer.diagnostics], "font_decisions": writer.decisions, "font_search_paths": writer.search_paths(),
    }


def _in_list(blocks: list[dict], at: int) -> bool:
    """Whether a table follows a list paragraph and so belongs to its item."""
    while at > 0 and blocks[at]["is"] == "table":
        at -= 1
    return bool(blocks[at].get("list"))


def convert(packages: DataFrame | Built, options: dict | None = None) -> DataFrame:
    """One row for each package: status (ok or failed), error, the markup and all side records."""
    chosen = dict(options or {})

    def one(doc_id: str, content: bytes) -> Iterator[dict]:
        try:
            yield {"doc_id": doc_id, "status": "ok"} | convert_one(content, chosen)
        except Exception as e:  # whatever a package holds, it must not end the job
            yield {"doc_id": doc_id, "status": "failed", "error": str(e) if isinstance(e, BadPackage) else f"{type(e).__name__}: {e}"}

    return by_document(packages, one, CONVERTED)


def inspect(packages: DataFrame | Built, max_package_bytes: int | None = None) -> DataFrame:
    """One row for each package: parts, relationships, style and font names, theme. The body isn't read."""

    def one(doc_id: str, content: bytes) -> Iterator[dict]:
        try:
            package = Package(content, max_package_bytes or MOST_BYTES)
            held = Catalogs(package)
            relations = {p: [f"{x['id']} -> {x['target']}" for x in package.relations(p)] for p in sorted(package.parts)}
        except Exception as e:
            yield {"doc_id": doc_id, "error": str(e) if isinstance(e, BadPackage) else f"{type(e).__name__}: {e}"}
            return
        names = [s["name"] if s["name"] is not None else s["id"] for kind in ("paragraph", "character") for _, s in sorted(held.styles[kind].items())]
        yield {
            "doc_id": doc_id, "package_parts": sorted(package.parts), "relationships": [(k, v) for k, v in relations.items() if v], "styles": names, "fonts": held.font_names,
            "embedded_fonts": [f"{f['family']} ({f['variant']})" for f in held.embedded], "theme_colors": list(held.colors.items()), "theme_fonts": list(held.theme_fonts.items()),
            "diagnostics": [{**d, "context": list(d["context"].items())} for d in held.diagnostics],
        }

    return by_document(packages, one, INSPECTED)


VALIDATION = "array<struct<code: string, severity: string, message: string, context: map<string, string>>>"


def syntax_diagnostics(markup):
    """Column of TYPST_SYNTAX_ERROR records: what syntax.py finds wrong in the markup."""

    @F.arrow_udf(VALIDATION)
    def check(texts: pa.Array) -> pa.Array:
        made = [[{"code": "TYPST_SYNTAX_ERROR", "severity": "error", "message": m, "context": [("offset", str(at))]} for at, m in syntax_errors(x.as_py() or "")] for x in texts]
        return pa.array(made, pa.list_(pa.struct([("code", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("context", pa.map_(pa.string(), pa.string()))])))

    return check(markup)


def validate(results: DataFrame, reference: DataFrame | None = None, threshold: int | None = None) -> DataFrame:
    """doc_id, structure_ok, diagnostics (code, severity, message, context) and, against a reference, its comparison.

    results: doc_id, markup and, for a comparison, text and pages as rendered elsewhere; reference: doc_id, text, pages.
    """
    ship_package(results.sparkSession)
    checked = results.withColumn("found", syntax_diagnostics(F.col("markup"))).withColumn("structure_ok", F.size("found") == 0)
    if reference is None:
        return checked.select("doc_id", "structure_ok", F.col("found").alias("diagnostics"))
    limit = DEFAULT_THRESHOLD if threshold is None else threshold
    theirs = reference.select(F.col("doc_id").alias("other"), F.col("text").alias("their_text"), F.col("pages").alias("reference_pages"))
    joined = checked.join(theirs, checked["doc_id"] == theirs["other"], "left")
    both = joined.where("other IS NOT NULL")
    found = dice_by_key(both.select("doc_id", "text"), both.select("doc_id", F.col("their_text").alias("text")), "doc_id")
    similarity = F.col("similarity").cast("int")
    delta = F.col("pages") - F.col("reference_pages")
    out = joined.join(found, "doc_id", "left").select("doc_id", "structure_ok", "found", "pages", "reference_pages", F.when(F.col("other").isNotNull(), similarity).alias("similarity"), delta.alias("page_count_delta"), (delta == 0).alias("page_count_match"), F.lit(limit).alias("threshold"))
    out = out.withColumn("within_threshold", within_threshold(F.col("similarity"), F.col("page_count_match"), limit))
    pages = _record("REFERENCE_PAGE_COUNT_MISMATCH", "warning", {"generated": F.col("pages"), "reference": F.col("reference_pages")})
    text = _record("REFERENCE_TEXT_BELOW_THRESHOLD", "warning", {"similarity": F.col("similarity"), "threshold": F.col("threshold")})
    compared = F.array_compact(F.array(F.when(~F.col("page_count_match"), pages), F.when(F.col("similarity") < limit, text)))
    return out.withColumn("diagnostics", F.concat("found", compared)).drop("found", "pages", "reference_pages")


def _record(code: str, severity: str, context: dict):
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(explain(code)).alias("message"), F.create_map(*pairs).alias("context"))


def write_bundles(converted: DataFrame, folder: str) -> DataFrame:
    """Writes each document's bundle (markup, runtime, report, assets, fonts) as rows of path and bytes in Parquet at `folder`.

    Many small files for each document wear out a shared store; bundle.unpack() gives those of chosen documents.
    """
    files(converted).write.mode("overwrite").parquet(folder)
    return converted.sparkSession.read.parquet(folder)


def files(converted: DataFrame, runtime_file: str = RUNTIME_FILE) -> DataFrame:
    """doc_id, path, content: all files of each converted document's bundle."""
    report = F.to_json(F.struct(*[c for c in converted.columns if c != "markup"]), {"ignoreNullFields": "false"})
    fixed = F.array(*[F.struct(F.lit(p).alias("path"), c.cast("binary").alias("content")) for p, c in (("main.typ", F.col("markup")), ("report.json", report), (runtime_file, F.lit(RUNTIME)))])
    held = lambda c: F.transform(F.filter(c, lambda x: x["emitted_path"].isNotNull()), lambda x: F.struct(x["emitted_path"].alias("path"), x["bytes"].alias("content")))
    return converted.where("status = 'ok'").select("doc_id", F.explode(F.concat(fixed, held("assets"), held("embedded_fonts"))).alias("f")).select("doc_id", "f.*")


def convert_stream(packages: DataFrame, options: dict | None = None) -> DataFrame:
    """convert() of a streaming DataFrame: it keeps no state, so each micro-batch stands alone."""
    return convert(packages, options)
