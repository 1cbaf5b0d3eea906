"""An annotated spreadsheet (OpenDocument): four rows a query, written row by row on the driver.

The sheet is one local file for people to look at; rows come from the cluster partition by partition.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLOURS = {"strict": "#90ee90", "relaxed": "#ffff99", "wrong": "#ff9999", "none": "#ffffff"}
_TYPE = "application/vnd.oasis.opendocument.spreadsheet"
_NAMES = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("table", "table"), ("text", "text"), ("style", "style"), ("fo", "xsl-fo-compatible"))) + ' xmlns:xlink="http://www.w3.org/1999/xlink"'
_MANIFEST = (
    '<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2">'
    f'<manifest:file-entry manifest:full-path="/" manifest:media-type="{_TYPE}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
)


def sheet_cells(queries: DataFrame, spans: DataFrame) -> DataFrame:
    """``query_id``, ``words`` and the cells of ``spans`` (``query_id``, ``position``, ``word_count``, ``link``, ``rating``) by position.

    A span that begins before the end of one already placed is left out, as cells cannot overlap.
    """
    one = F.struct("position", "word_count", F.coalesce("link", F.lit("-")).alias("link"), F.coalesce("rating", F.lit("none")).alias("rating"))
    by = spans.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("s"))
    kind = "struct<end:int, cells:array<struct<position:int,word_count:int,link:string,rating:string>>>"
    start = F.struct(F.lit(0).alias("end"), F.array().alias("cells")).cast(kind)
    place = lambda a, c: F.when(c["position"] >= a["end"], F.struct((c["position"] + c["word_count"]).cast("int").alias("end"), F.array_append(a["cells"], c).alias("cells")).cast(kind)).otherwise(a)
    placed = by.select("query_id", F.aggregate("s", start, place)["cells"].alias("cells"))
    return queries.join(placed, "query_id", "left").select("query_id", "words", F.coalesce("cells", F.array().cast("array<struct<position:int,word_count:int,link:string,rating:string>>")).alias("cells"))


def _cell(value: str | float | None, style: str = "none", width: int = 1, link: str | None = None) -> str:
    """A cell of text, a number, or nothing; ``link`` makes its text a hyperlink."""
    span = f' table:number-columns-spanned="{width}" table:number-rows-spanned="1"' if width > 1 else ""
    kind = "" if value is None else ' office:value-type="string"' if isinstance(value, str) else f' office:value-type="float" office:value="{value}"'
    text = "" if value is None else escape(str(value))
    if text and link:
        text = f'<text:a xlink:href={quoteattr(link)} xlink:type="simple">{text}</text:a>'
    inside = "" if value is None else f"<text:p>{text}</text:p>"
    return f"<table:table-cell table:style-name={quoteattr(style)}{kind}{span}>{inside}</table:table-cell>" + "<table:covered-table-cell/>" * (width - 1)


def _spans(words: list[str], cells: list, base: str | None) -> Iterator[str]:
    at = 0
    for c in cells:
        yield from (_cell("-") for _ in range(c["position"] - at))
        yield _cell(c["link"], c["rating"] if c["rating"] in COLOURS else "none", c["word_count"], base and c["link"] != "-" and base + c["link"] or None)
        at = c["position"] + c["word_count"]
    yield from (_cell("-") for _ in range(len(words) - at))


def write_sheet(rows: Iterable, path: str, base: str | None = None) -> None:
    """``base``, where given, is put before links to make hyperlinks.  ``rows`` have ``words``, ``predicted`` and ``gold`` (cells of ``sheet_cells``); ``path`` is a file of the driver."""
    row = lambda cells: f"<table:table-row>{''.join(cells)}</table:table-row>"
    styles = "".join(f'<style:style style:name="{k}" style:family="table-cell"><style:table-cell-properties fo:background-color="{v}"/></style:style>' for k, v in COLOURS.items())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", _TYPE, zipfile.ZIP_STORED)
        z.writestr("META-INF/manifest.xml", _MANIFEST)
        with z.open("content.xml", "w", force_zip64=True) as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {_NAMES} office:version="1.2"><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:spreadsheet><table:table table:name="queries">'.encode())
            for r in rows:
                lines = [[_cell(None)], map(_cell, r["words"]), _spans(r["words"], r["predicted"], base), _spans(r["words"], r["gold"], base)]
                out.write("".join(map(row, lines)).encode())
            out.write(b"</table:table></office:spreadsheet></office:body></office:document-content>")


def export_sheet(queries: DataFrame, predicted: DataFrame, gold: DataFrame, path: str, base: str | None = None) -> None:
    """Words, predicted and gold spans of all queries in order of ``query_id``, streamed to one file."""
    side = lambda spans, name: sheet_cells(queries, spans).select("query_id", F.col("cells").alias(name))
    both = queries.select("query_id", "words").join(side(predicted, "predicted"), "query_id").join(side(gold, "gold"), "query_id")
    write_sheet(both.orderBy("query_id").toLocalIterator(), path, base)
