"""Files as documents: scans by folder or object store, and readers for text, Word and PDF files.

A scan lists files as rows (path, name, content) in Spark; parsing runs where the rows are. A Word file's XML and a PDF need a parser,
so they go through a small function over Arrow batches; text files stay in the JVM.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

EXTENSIONS = ("pdf", "txt", "docx")
MAX_UPLOAD = 25 * 1024 * 1024
BLOCK = "struct<type:string,text:string,table_index:int,headers:array<string>,rows:array<array<string>>>"
PAGES = f"array<struct<page:int,text:string,blocks:array<{BLOCK}>>>"
_RAW = "name string, kind string, parts array<struct<page:int,text:string,rows:array<array<string>>>>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_files(spark: SparkSession, path: str, recursive: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, kind, length, content) of the files with these extensions in any case, one for each base name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.select("path", F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B"))).alias("name"), kind.alias("kind"), "length", "content").where(F.col("kind").isin(*extensions))
    first = named.groupBy("name").agg(F.min("path").alias("path"))
    return named.join(first, ["name", "path"], "left_semi").select("path", "name", "kind", "length", "content")


def listed(files: DataFrame) -> DataFrame:
    """Names and sizes of scanned files by name; contents are not read."""
    return files.select("name", "kind", "length").orderBy("name")


def storage_path(kind: str, local: str = "", bucket: str = "", prefix: str = "", scheme: str = "s3a") -> str:
    """Where documents are kept: a local folder or a prefix in an object store."""
    if kind == "local" and local:
        return local
    if kind in ("r2", "s3") and bucket:
        return f"{scheme}://{object_key(bucket, prefix.strip('/'))}".rstrip("/")
    raise ValueError(f"no storage of kind {kind!r} is set up")


def valid_upload(name: Column, length: Column, limit: int = MAX_UPLOAD, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether an upload is taken: a usable name of an allowed kind, some bytes, not too many."""
    kind = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return T.safe_filename(name).isNotNull() & kind.isin(*extensions) & (length > 0) & (length <= limit)


def accepted_uploads(uploads: DataFrame, indexed: DataFrame, replace: bool = False) -> DataFrame:
    """Uploads (name, length, ...) that are taken, with safe_name; one whose name is indexed (source) already only with replace."""
    taken = uploads.where(valid_upload(F.col("name"), F.col("length"))).withColumn("safe_name", T.safe_filename(F.col("name")))
    return taken if replace else taken.join(indexed.select(F.col("source").alias("safe_name")), "safe_name", "left_anti").select(taken.columns)


def object_key(prefix: str, name: str) -> str:
    """Where a file is kept under a prefix."""
    return f"{prefix.strip('/')}/{name}" if prefix.strip("/") else name


def word_parts(content: bytes) -> list[dict]:
    """Paragraphs and tables of a Word file, in order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text_of = lambda e: "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "" for x in e.iter())
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            out.append({"page": None, "text": text_of(e), "rows": None})
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(text_of(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in e.findall(f"{_W}tr")]
            out.append({"page": None, "text": None, "rows": rows})
    return out


PdfParser = Callable[[bytes], list[dict]]


def pdf_parts(content: bytes) -> list[dict]:
    """Pages of a PDF with its tables where pdfplumber is installed, else its text by pypdf."""
    try:
        import pdfplumber

        out = []
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                out.append({"page": number, "text": page.extract_text() or "", "rows": None})
                out += [{"page": number, "text": None, "rows": [[c or "" for c in r] for r in t]} for t in page.extract_tables()]
        if any((p["text"] or "").strip() or p["rows"] for p in out):
            return out
    except Exception as e:  # a file that one parser cannot read goes to the other
        first = e
    else:
        first = None
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise first or e from None
    return [{"page": n, "text": p.extract_text() or "", "rows": None} for n, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]


def _parse(parsers: dict[str, PdfParser]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, kind, content in batch[["name", "kind", "content"]].itertuples(index=False):
                try:
                    out.append((name, kind, parsers[kind](bytes(content)), None))
                except Exception as e:  # one broken file does not stop the others
                    out.append((name, kind, [], f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["name", "kind", "parts", "error"])

    return run


def parse_files(files: DataFrame, pdf: PdfParser = pdf_parts) -> DataFrame:
    """(name, kind, parts, error): the parts of every file, each with its page, text or table rows."""
    text = files.where("kind = 'txt'").select(
        "name", "kind", F.array(F.struct(F.lit(None).cast("int").alias("page"), F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))).alias("parts"), F.lit(None).cast("string").alias("error")
    )
    return text.unionByName(files.where("kind <> 'txt'").select("name", "kind", "content").mapInPandas(_parse({"docx": word_parts, "pdf": pdf}), _RAW))


def documents(parsed: DataFrame) -> DataFrame:
    """(source, kind, title, page_count, pages) of parsed files: parts as blocks of their pages; files without text go.

    Pages are made inside each file's row, in the order of their first parts; tables are numbered through the file.
    """
    table = lambda x: x["p"]["rows"].isNotNull()
    placed = F.transform("parts", lambda p, n: F.struct(n.alias("n"), p.alias("p")))
    none = lambda x: F.struct(F.lit("text").alias("type"), T.normalize_text(x["p"]["text"]).alias("text"), F.lit(None).cast("int").alias("table_index"), F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"))
    made = lambda x, block: F.struct(x["n"].alias("n"), x["p"]["page"].alias("page"), block.cast(BLOCK).alias("block"))
    texts = F.transform(F.filter(placed, lambda x: ~table(x)), lambda x: made(x, none(x)))
    tables = F.transform(F.filter(placed, table), lambda x, i: made(x, T.table_block(x["p"]["rows"], i)))
    kept = F.filter(F.concat(texts, tables), lambda x: (x["block"]["text"] != "") | (x["block"]["type"] == "table"))
    rows = parsed.where("error is null").select("name", "kind", F.array_sort(kept).alias("all")).where(F.size("all") > 0)
    blocks_of = lambda page: F.transform(F.filter("all", lambda x: x["page"].eqNullSafe(page)), lambda x: x["block"])
    page = lambda p: F.struct(p.alias("page"), F.array_join(F.transform(blocks_of(p), lambda b: b["text"]), "\n\n").alias("text"), F.when(F.col("kind") != "txt", blocks_of(p)).alias("blocks"))
    docs = rows.select(F.col("name").alias("source"), "kind", F.transform(F.array_distinct(F.transform("all", lambda x: x["page"])), page).alias("pages"))
    count = F.nullif(F.size(F.filter("pages", lambda p: p["page"].isNotNull())), F.lit(0))
    return docs.select("source", "kind", T.infer_title(F.col("source"), F.col("pages")).alias("title"), count.alias("page_count"), "pages")


def read_documents(spark: SparkSession, path: str, recursive: bool = False, pdf: PdfParser = pdf_parts) -> DataFrame:
    """All documents of a folder or prefix, ready to be chunked."""
    return documents(parse_files(scan_files(spark, path, recursive), pdf))
