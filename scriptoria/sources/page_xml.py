"""PAGE-XML documents as rows of text lines and regions."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.functions import scalars as S

# Fixed values of the format.
NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"

# A fixed schema: inference would differ for a page without lines.
LINE_FIELDS = "_id string,_custom string,Coords struct<_points:string>,Baseline struct<_points:string>"
PAGE_FIELDS = "_imageFilename string,_imageWidth int,_imageHeight int"

# Elements at any depth, with any namespace prefix.  Lines do not nest; a region's own
# outline comes before its lines and inner regions.
_OPEN, _CLOSE = r"<(?:[\w.-]+:)?", r"</(?:[\w.-]+:)?"
LINE_PATTERN = rf"(?s){_OPEN}TextLine[\s>].*?{_CLOSE}TextLine\s*>"
REGION_PATTERN = (rf"(?s){_OPEN}TextRegion(?:\s[^>]*)?>(?:(?:(?!{_OPEN}(?:TextLine|TextRegion|Coords)[\s>/])(?!{_CLOSE}TextRegion).)*"
                  rf"{_OPEN}Coords\s[^>]*?points\s*=\s*[\"']([^\"']*)[\"'])?")

# How readers differ: number type, fewest points of a line, point separator.
READ_PROFILES = {
    "all_lines": ("int", 0, r"\s+"),
    "polygons": ("int", 3, r"\s+"),
    "decimal": ("double", 0, " "),
}

# How writers differ; ids and attributes are fixed values of the formats.
WRITE_PROFILES = {
    "crops": {"region": 'id="region_textline"', "dates": True, "line_id": "textline_%d", "line": ' custom="0"', "text": True},
    "components": {"region": 'id="r_text"', "dates": True, "line_id": "tl_%04d", "line": "", "text": False},
    "masks": {"region": 'id="region_textline" custom="0"', "dates": True, "line_id": "textline_%d", "line": ' custom="0"', "text": True},
    "detector": {"region": 'id="region_text"', "dates": False, "line_id": "textline_%d", "line": "", "text": True},
}


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per document: path, stem, image, width, height, document; prefixes are ignored.

    Records end with the document's end tag, so documents may follow each other in a file.
    """
    records = spark.read.option("lineSep", "</PcGts>").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    found = records.filter(F.col("value").rlike(rf"{_OPEN}PcGts[\s>]"))
    plain = F.regexp_replace("value", "(?s)<!--.*?-->", "")
    head = F.concat(F.lit("<Page "), F.regexp_extract("document", rf"(?s){_OPEN}Page(\s[^>]*?)/?>", 1), F.lit("/>"))
    return found.select("path", _stem_of(F.col("path")).alias("stem"), plain.alias("document")).withColumn(
        "_page", F.from_xml(head, PAGE_FIELDS)
    ).select("path", "stem", F.col("_page._imageFilename").alias("image"), F.col("_page._imageWidth").alias("width"),
             F.col("_page._imageHeight").alias("height"), "document")


def _stem_of(path: Column) -> Column:
    """The file's stem, or that of the folder ``stem=...`` that :func:`write_documents` gives a page."""
    own = F.regexp_extract(path, r"/stem=([^/]+)/[^/]*$", 1)
    # the name is escaped as a folder, and the path as a URI
    return F.when(own == "", S.stem(path)).otherwise(F.url_decode(F.regexp_replace(F.url_decode(F.regexp_replace(own, r"\+", "%2B")), r"\+", "%2B")))


def line_points(points_text: Column, profile: str) -> Column:
    """Polygon of a line in a reader profile; null when the line must be skipped."""
    number, fewest, separator = READ_PROFILES[profile]
    return G.bound(G.parse_points(points_text, number, separator), lambda points: F.when(F.size(points) >= fewest, points))


def text_lines(pages: DataFrame, profile: str = "all_lines") -> DataFrame:
    """Lines with coordinates in document order, at any depth of regions and tables: stem, line_idx, line_id, points, baseline."""
    lines = F.regexp_extract_all("document", F.lit(LINE_PATTERN), F.lit(0))
    parsed = F.transform(F.transform(lines, line_from_fragment), lambda t: F.struct(
        t["_id"].alias("line_id"), line_points(t["Coords"]["_points"], profile).alias("points"), t["Baseline"]["_points"].alias("baseline")
    ))
    # A document is one row, so its lines are filtered and numbered inside the row.
    kept = F.filter(parsed, lambda t: t["points"].isNotNull())
    return pages.select("stem", F.posexplode(kept).alias("line_idx", "e")).select(
        "stem", "line_idx", "e.line_id", "e.points", "e.baseline"
    )


def line_from_fragment(fragment: Column) -> Column:
    """One ``<TextLine>`` element as a struct; its transcription is passed over."""
    plain = F.regexp_replace(fragment, rf"(?s){_OPEN}TextEquiv[\s>].*?{_CLOSE}TextEquiv\s*>", "")
    return F.from_xml(plain, F.lit(LINE_FIELDS), {"ignoreNamespace": "true"})


def page_size(fragment: Column) -> Column:
    """imageWidth and imageHeight of a ``<Page>`` element, without reading the image."""
    page = F.from_xml(fragment, PAGE_FIELDS, {"ignoreNamespace": "true"})
    return F.struct(page["_imageWidth"].alias("width"), page["_imageHeight"].alias("height"))


def regions(pages: DataFrame) -> DataFrame:
    """Regions with coordinates, at any depth: stem, region_idx, points."""
    found = F.regexp_extract_all("document", F.lit(REGION_PATTERN), F.lit(1))
    rows = pages.select("stem", F.posexplode(found).alias("region_idx", "outline"))
    return rows.filter("outline <> ''").select("stem", "region_idx", G.parse_points(F.col("outline")).alias("points"))


def main_region(region_rows: DataFrame, key: str = "stem", rule: str = "largest") -> DataFrame:
    """One region per page: the first, or the one of largest area (first on ties)."""
    area = G.contour_area(F.col("points"))
    if rule == "first":
        best = F.min(F.struct("region_idx", "points"))
    elif rule == "largest":
        best = F.min(F.struct((-area).alias("cost"), "region_idx", "points"))
    else:
        raise ValueError(f"unknown rule: {rule}")
    return region_rows.groupBy(key).agg(best.alias("b")).select(key, "b.region_idx", "b.points")


# --- writing ---------------------------------------------------------------------------


def _text(value: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(value, "&", "&amp;"), "<", "&lt;")
    return F.regexp_replace(F.regexp_replace(escaped, ">", "&gt;"), '"', "&quot;")


def line_element(index: Column, points: Column, baseline: Column, profile: str) -> Column:
    """``<TextLine>`` element as one text row."""
    style = WRITE_PROFILES[profile]
    parts = [
        F.lit('<TextLine id="'), F.format_string(style["line_id"], index), F.lit(f'"{style["line"]}><Coords points="'),
        points, F.lit('"/><Baseline points="'), baseline, F.lit('"/>'),
    ]
    if style["text"]:
        parts.append(F.lit("<TextEquiv><Unicode></Unicode></TextEquiv>"))
    return F.concat(*parts, F.lit("</TextLine>"))


def document_head(name: Column, width: Column, height: Column, profile: str, creator: str, timestamp: str) -> Column:
    style = WRITE_PROFILES[profile]
    w, h = width.cast("string"), height.cast("string")
    dates = f"<Created>{escape(timestamp)}</Created><LastChange>{escape(timestamp)}</LastChange>" if style["dates"] else ""
    root = (
        f'<PcGts xmlns="{NAMESPACE}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
        f'xsi:schemaLocation="{NAMESPACE} {NAMESPACE}/pagecontent.xsd">'
    )
    return F.concat(
        F.lit(f"{root}<Metadata><Creator>"), _text(F.lit(creator)), F.lit(f"</Creator>{dates}</Metadata><Page imageFilename=\""),
        _text(name), F.lit('" imageWidth="'), w, F.lit('" imageHeight="'), h,
        F.lit(f'"><TextRegion {style["region"]}><Coords points="0,0 '), w, F.lit(",0 "), w, F.lit(","), h, F.lit(" 0,"), h, F.lit('"/>'),
    )


DOCUMENT_TAIL = "</TextRegion></Page></PcGts>"


def document_rows(
    pages: DataFrame, lines: DataFrame, profile: str, creator: str = "scriptoria", timestamp: str = "1970-01-01T00:00:00"
) -> DataFrame:
    """The documents as text rows (stem, part, seq, text): head, one row per line, tail.

    *pages* has stem, file_name, width, height; *lines* has stem, line_no, points and
    baseline as point text.  No page is gathered into one row.
    """
    head = pages.select(
        "stem", F.lit(0).alias("part"), F.lit(0).alias("seq"),
        document_head(F.col("file_name"), F.col("width"), F.col("height"), profile, creator, timestamp).alias("text"),
    )
    tail = pages.select("stem", F.lit(2).alias("part"), F.lit(0).alias("seq"), F.lit(DOCUMENT_TAIL).alias("text"))
    body = lines.select(
        "stem", F.lit(1).alias("part"), F.col("line_no").alias("seq"),
        line_element(F.col("line_no"), F.col("points"), F.col("baseline"), profile).alias("text"),
    )
    return head.unionByName(body).unionByName(tail)


def write_documents(rows: DataFrame, path: str, mode: str = "overwrite", folder_per_page: bool = True) -> None:
    """Write the rows of each document in order, a document within one file.

    Rows are sorted and streamed to the writer, so a long page costs disk, not
    memory.  With *folder_per_page* every page has a folder ``stem=...`` of its own;
    otherwise documents follow each other in the part files.
    """
    ordered = rows.repartition("stem").sortWithinPartitions("stem", "part", "seq")
    if folder_per_page:
        ordered.select("stem", "text").write.mode(mode).partitionBy("stem").text(path)
    else:
        ordered.select("text").write.mode(mode).text(path)
