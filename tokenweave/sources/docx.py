"""Word documents as a Spark source: the zip and its XML are read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.morphology import strip
from ..session import file_system

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def body_paragraphs(data: bytes) -> list[tuple[str, str]]:
    """(style name, text) of the paragraphs of the body, those in tables left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
                name = style.find(_W + "name")
                names[style.get(_W + "styleId", "")] = name.get(_W + "val", "") if name is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    out = []
    for p in body.findall(_W + "p") if body is not None else []:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        key = style.get(_W + "val", "") if style is not None else ""
        text = []
        for node in p.iter():
            if node.tag == _W + "t":
                text.append(node.text or "")
            elif node.tag == _W + "tab":
                text.append("\t")
            elif node.tag in (_W + "br", _W + "cr"):
                text.append("\n")
        out.append((names.get(key, key), "".join(text)))
    return out


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """filename, paragraph_no, style, text of every .docx under path. A file that can't be read raises.

    filename is the path below `path`, so that files of one name in two folders stay two; for a single file or a pattern
    it is the name alone.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["filename"], batch["content"]):
                rows = [(name, i, style, text) for i, (style, text) in enumerate(body_paragraphs(bytes(data)))]
                if not rows:
                    rows = [(name, 0, "", "")]
                yield pd.DataFrame(rows, columns=["filename", "paragraph_no", "style", "text"])

    fs, where = file_system(spark, path)
    root = fs.makeQualified(where).toString().rstrip("/") + "/"
    below = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 20)).otherwise(F.element_at(F.split("path", "/"), -1))
    named = files.select(below.alias("filename"), "content")
    return named.mapInPandas(parse, "filename string, paragraph_no int, style string, text string")


def heading_level(style: Column) -> Column:
    """The number of a heading style; null for other styles."""
    return F.try_to_number(F.nullif(F.regexp_extract(style, r"(?i)^Heading\s*(\d+)", 1), F.lit("")), F.lit("999999")).cast("int")


def sections(paragraphs: DataFrame) -> DataFrame:
    """filename, section_no (from 0), title, text: each heading of level 1 that is not blank begins a section.

    What stands before the first is titled `Document`. Sections without text are left out, but a file with
    none at all has one section `Document` with empty text.
    """
    head = (heading_level(F.col("style")) == 1) & (strip(F.col("text")) != "")
    w = Window.partitionBy("filename").orderBy("paragraph_no")
    marked = paragraphs.withColumn("head", F.coalesce(head, F.lit(False))).withColumn("n", F.sum(F.col("head").cast("int")).over(w))
    line = F.when(~F.col("head") & (strip(F.col("text")) != ""), F.struct("paragraph_no", strip(F.col("text")).alias("t")))
    title = F.max(F.when(F.col("head"), strip(F.col("text"))))
    grouped = marked.groupBy("filename", "n").agg(F.coalesce(title, F.lit("Document")).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))
    some = grouped.where("text <> ''")
    empty = paragraphs.select("filename").distinct().join(some.select("filename"), "filename", "left_anti").select("filename", F.lit(0).alias("n"), F.lit("Document").alias("title"), F.lit("").alias("text"))
    every = some.select("filename", "n", "title", "text").unionByName(empty.withColumn("n", F.col("n").cast("long")))
    return every.select("filename", (F.row_number().over(Window.partitionBy("filename").orderBy("n")) - 1).alias("section_no"), "title", "text")


def write_docx(parts: list[tuple[str | None, str]]) -> bytes:
    """A minimal document: (heading or None, body with blank lines between paragraphs)."""
    from xml.sax.saxutils import escape

    def p(text: str, style: str = "") -> str:
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{props}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = "".join((p(h, "Heading1") if h is not None else "") + "".join(p(x) for x in b.split("\n\n")) for h, b in parts)
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {ns}><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:styles {ns}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def stem(filename: str) -> str:
    return re.sub(r"\.docx\Z", "", filename, flags=re.I)
