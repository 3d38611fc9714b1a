"""Reading uploaded files: kinds, encodings, documents by page, archives by file, and their chunks.

A file is parsed alone, in the partition it lies in. One that can't be read gives a row with ``error`` and no text; it
never fails the others.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainstore.operators.chunking import char_chunks, document_id, line_chunks, repository_id

#: Suffixes of documents, of single source files and of text (fixed values).
DOCUMENT_KINDS = {".pdf": "pdf", ".txt": "txt", ".md": "md", ".docx": "docx", ".xlsx": "xlsx", ".csv": "csv"}
CODE_SUFFIXES = (".java", ".py", ".js", ".ts", ".xml", ".yml", ".yaml", ".sql")
TEXT_SUFFIXES = (
    ".java", ".py", ".js", ".ts", ".jsx", ".tsx", ".md", ".txt", ".yml", ".yaml", ".json", ".xml", ".properties", ".gradle", ".sql",
    ".sh", ".bat", ".ps1", ".ini", ".cfg",
)
ARCHIVED_DOCUMENTS = (".csv", ".pdf", ".docx", ".xlsx", ".pptx")
#: Directories and files of archives that are left out (fixed values).
SKIPPED_DIRS = frozenset(".git .idea .vscode __pycache__ node_modules dist build target venv".split())
SKIPPED_FILES = frozenset(".env .env.local .env.dev .env.prod".split())
#: Chunk size and overlap, in characters, by kind (fixed values).
CHUNKS = {"pdf": (900, 150), "txt": (900, 150), "md": (900, 150), "text": (900, 150), "docx": (1000, 150), "csv": (1200, 120), "xlsx": (1200, 120)}


@dataclass(frozen=True)
class SourceConfig:
    """Limits of an archive and of a text; an archive over them is refused whole, a text is cut."""

    max_entries: int = 8000
    max_bytes: int = 300 * 1024 * 1024
    text_bytes: int = 2 * 1024 * 1024
    pdf_bytes: int = 10 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of the files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.substring_index("path", "/", -1).alias("filename"), "content")


def file_kind(content: Column, filename: Column) -> Column:
    """pdf, docx, xlsx, zip, txt, md, csv, code, text or unknown: by magic bytes, then by suffix."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    head = F.hex(F.substring(content, 1, 4))
    ends = lambda *suffixes: name.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")
    out = F.when(head == "25504446", "pdf")
    packed = head.isin("504B0304", "504B0506", "504B0708")
    out = out.when(packed & ends(".docx"), "docx").when(packed & ends(".xlsx"), "xlsx").when(packed, "zip")
    for suffix, kind in DOCUMENT_KINDS.items():
        out = out.when(ends(suffix), kind)
    return out.when(ends(".zip"), "zip").when(ends(*CODE_SUFFIXES), "code").when(ends(*TEXT_SUFFIXES), "text").otherwise("unknown")


def decoded(raw: bytes, limit: int = SourceConfig.text_bytes) -> str:
    """The first bytes of a text: UTF-8 (a mark at the start stays), else CP949, else Latin-1."""
    raw = raw[:limit]
    for codec in ("utf-8", "cp949"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def _named(header: list[str], row: list[str], skip_empty: bool) -> str:
    pairs = [(header[i].strip() if i < len(header) and header[i].strip() else f"col_{i + 1}", v) for i, v in enumerate(row) if v or not skip_empty]
    return " | ".join(f"{k}: {v}" for k, v in pairs)


def csv_text(text: str) -> str:
    """One line per row with the names of the first; a table of a header alone as it is."""
    rows = list(csv.reader(io.StringIO(text)))
    lines = [f"row {n} | {_named(rows[0], row, False)}" for n, row in enumerate(rows[1:], 2) if row] if rows else []
    return "\n".join(lines) if lines else text


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _xml(box: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(box.read(name))


def docx_text(raw: bytes) -> str:
    """Paragraphs, then table rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        body = next(e for e in _xml(box, "word/document.xml") if _tag(e) == "body")
    text = lambda e: "".join("\n" if _tag(x) == "br" else "\t" if _tag(x) == "tab" else x.text or "" for x in e.iter() if _tag(x) in ("t", "br", "tab")).strip()
    blocks = [t for e in body if _tag(e) == "p" and (t := text(e))]
    for table in (e for e in body if _tag(e) == "tbl"):
        for n, row in enumerate((e for e in table if _tag(e) == "tr"), 1):
            cells = [t for e in row if _tag(e) == "tc" and (t := text(e))]
            if cells:
                blocks.append(f"table row {n} | " + " | ".join(cells))
    return "\n\n".join(blocks)


def xlsx_sheets(raw: bytes) -> list[tuple[str, str]]:
    """(name, text) of each sheet, in order: one line per row with the names of the first row that isn't empty."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        names = set(box.namelist())
        shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in _xml(box, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        links = {e.get("Id"): e.get("Target") for e in _xml(box, "xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in (e for e in _xml(box, "xl/workbook.xml").iter() if _tag(e) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            at = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            header, lines = None, []
            for n, row in enumerate((e for e in _xml(box, at).iter() if _tag(e) == "row"), 1):
                values: dict[int, str] = {}
                for cell in row:
                    letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                    column = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else len(values)
                    value = "".join(t.text or "" for t in cell.iter() if _tag(t) in ("v", "t"))
                    values[column] = (shared[int(value)] if cell.get("t") == "s" and value else value).strip()
                cells = [values.get(i, "") for i in range(max(values, default=-1) + 1)]
                if not any(cells):
                    continue
                if header is None:
                    header = cells
                elif line := _named(header, cells, True):
                    lines.append(f"sheet {sheet.get('name')} row {row.get('r', n)} | {line}")
            out.append((sheet.get("name"), "\n".join(lines)))
    return out


def pptx_text(raw: bytes) -> str:
    """One line per slide that has text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        slides = sorted((n for n in box.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        lines = []
        for n, name in enumerate(slides, 1):
            shapes = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t").strip() for s in _xml(box, name).iter() if _tag(s) == "sp"]
            if any(shapes):
                lines.append(f"slide {n} | " + " | ".join(s for s in shapes if s))
    return "\n".join(lines)


def pdf_pages(raw: bytes) -> list[str]:
    """The text of each page; needs the optional package ``pypdf``."""
    import pypdf

    return [(p.extract_text() or "").strip() for p in pypdf.PdfReader(io.BytesIO(raw)).pages]


def safe_path(name: str) -> str:
    """The path of an archive's entry below the archive's own folder, without dots and roots; empty where none is left."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    if parts and re.fullmatch("[A-Za-z]:", parts[0]):
        parts = parts[1:]
    return "/".join(parts)


def is_wanted(path: str) -> bool:
    """Whether a file of an archive is read: known suffixes and Dockerfiles, outside tool folders."""
    *dirs, name = path.split("/")
    if SKIPPED_DIRS & set(dirs) or name in SKIPPED_FILES:
        return False
    return name == "Dockerfile" or posixpath.splitext(name)[1].lower() in (*TEXT_SUFFIXES, *ARCHIVED_DOCUMENTS)


def entry_text(path: str, raw: bytes, config: SourceConfig) -> str:
    """The text of one file of an archive, by suffix."""
    suffix = posixpath.splitext(path)[1].lower()
    if suffix == ".csv":
        return csv_text(decoded(raw, config.text_bytes))
    if suffix == ".docx":
        return docx_text(raw)
    if suffix == ".xlsx":
        return "\n".join(t for _, t in xlsx_sheets(raw) if t)
    if suffix == ".pptx":
        return pptx_text(raw)
    if suffix == ".pdf":
        return "\n\n".join(p for p in pdf_pages(raw[: config.pdf_bytes]) if p)
    return decoded(raw, config.text_bytes) if suffix in TEXT_SUFFIXES else ""


def archive_entries(raw: bytes, config: SourceConfig) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the wanted files of an archive; refused whole when over the limits."""
    with zipfile.ZipFile(io.BytesIO(raw)) as box:
        infos = box.infolist()
        if len(infos) > config.max_entries:
            raise ValueError(f"more than {config.max_entries} entries")
        if sum(i.file_size for i in infos) > config.max_bytes:
            raise ValueError(f"more than {config.max_bytes} bytes")
        for info in infos:
            path = safe_path(info.filename)
            if not info.is_dir() and path and is_wanted(path):
                with box.open(info) as f:
                    content = f.read(info.file_size + 1)
                if len(content) > info.file_size:
                    raise ValueError("an entry is larger than it says")
                yield path, content


_PAGES = "doc_id string, filename string, kind string, page int, text string, error string"
_FILES = "repo_id string, filename string, path string, text string, error string"


def _parsed(schema: str, parse):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, filename, kind, content in zip(pdf["key"], pdf["filename"], pdf["kind"], pdf["content"], strict=True):
                try:
                    rows = list(parse(key, filename, kind, bytes(content)))
                except Exception as e:  # noqa: BLE001
                    rows = [tuple({"repo_id": key, "doc_id": key, "filename": filename, "kind": kind, "error": f"{type(e).__name__}: {e}"[:300]}.get(n) for n in names)]
                yield pd.DataFrame(rows, columns=names)

    return run


def _kinds(uploads: DataFrame, key) -> DataFrame:
    rows = uploads.where(F.col("content").isNotNull())
    return rows.select(key(F.col("content")).alias("key"), "filename", file_kind(F.col("content"), F.col("filename")).alias("kind"), "content")


def document_pages(uploads: DataFrame, config: SourceConfig = SourceConfig()) -> DataFrame:
    """(doc_id, filename, kind, page, text, error) of the documents among uploads (filename, content); a sheet is a page."""

    def parse(key: str, filename: str, kind: str, raw: bytes):
        if kind == "pdf":
            pages = pdf_pages(raw)
        elif kind == "xlsx":
            pages = [t for _, t in xlsx_sheets(raw)]
        elif kind == "docx":
            pages = [docx_text(raw)]
        else:
            text = decoded(raw, config.text_bytes)
            pages = [csv_text(text) if kind == "csv" else text]
        return [(key, filename, kind, n, t, None) for n, t in enumerate(pages, 1)]

    rows = _kinds(uploads, document_id).where(F.col("kind").isin("pdf", "txt", "md", "text", "docx", "xlsx", "csv"))
    return rows.mapInPandas(_parsed(_PAGES, parse), _PAGES)


def source_files(uploads: DataFrame, config: SourceConfig = SourceConfig()) -> DataFrame:
    """(repo_id, filename, path, text, error) of single source files and of the files in archives."""

    def parse(key: str, filename: str, kind: str, raw: bytes):
        if kind == "code":
            return [(key, filename, filename, decoded(raw, config.text_bytes), None)]
        out = []
        for path, content in archive_entries(raw, config):
            try:
                out.append((key, filename, path, entry_text(path, content, config), None))
            except Exception as e:  # noqa: BLE001
                out.append((key, filename, path, None, f"{type(e).__name__}: {e}"[:300]))
        return out

    return _kinds(uploads, repository_id).where(F.col("kind").isin("code", "zip")).mapInPandas(_parsed(_FILES, parse), _FILES)


def ingest(uploads: DataFrame, config: SourceConfig = SourceConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text chunks, code chunks, errors) of uploads (filename, content); ids come of the contents, so the same upload again
    gives the same chunks."""
    pages = document_pages(uploads, config)
    parts = [char_chunks(pages.where(F.col("error").isNull() & (F.col("kind") == k)), *size) for k, size in CHUNKS.items()]
    text = parts[0]
    for p in parts[1:]:
        text = text.unionByName(p)
    names = pages.select("doc_id", "filename").distinct()
    files = source_files(uploads, config)
    errors = pages.select("filename", "error").unionByName(files.select("filename", "error")).where("error is not null")
    unknown = _kinds(uploads, document_id).where("kind = 'unknown'").select("filename", F.lit("unknown kind").alias("error"))
    return text.join(names, "doc_id"), line_chunks(files.where("error is null")), errors.unionByName(unknown)
