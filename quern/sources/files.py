"""Files to documents: by suffix, one row per file, with a status instead of an exception."""

from __future__ import annotations

import io
import re
from collections.abc import Callable
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.markdown import Section, front_matter, sections
from quern.schema import SECTION

# File types by suffix, and limits of an upload.
SUFFIXES = {".md": "markdown", ".markdown": "markdown", ".txt": "txt", ".pdf": "pdf"}
UPLOAD_FILES, UPLOAD_BYTES = 20, 20 * 1024 * 1024

LOADED = f"status string, error string, name string, source_type string, text string, sections array<{SECTION}>, metadata map<string,string>"


class Unsupported(ValueError):
    pass


class Unreadable(ValueError):
    pass


class Empty(ValueError):
    pass


def clean_plain(text: str) -> str:
    """Line feeds only, no NUL, no trailing blanks, single blank lines, trimmed."""
    text = re.sub(r"\r\n?", "\n", text).replace("\0", "")
    text = re.sub(r"[^\S\n]+(?=\n|\Z)", "", text)
    return re.sub(r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n", text).strip()


def clean_markdown(text: str) -> str:
    """The same without comments and heading anchors; one line feed at the end unless empty."""
    text = re.sub(r"<!--.*?-->", "", re.sub(r"\r\n?", "\n", text), flags=re.S)
    text = re.sub(r"[^\S\n]+(?=\n|\Z)", "", text)
    text = re.sub(r"(?m)^(#{1,6}[ \t]+.+?)[ \t]*\{#[^}\n]*\}[ \t]*$", r"\1", text)
    text = re.sub(r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n", text).strip()
    return text + "\n" if text else ""


def read_pdf(content: bytes) -> tuple[list[str], str | None]:
    """Text of every page, and the title. Needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Unreadable("pypdf is not installed") from e
    try:
        reader = PdfReader(io.BytesIO(content))
        return [p.extract_text() or "" for p in reader.pages], reader.metadata.title if reader.metadata else None
    except Exception as e:
        raise Unreadable(f"cannot parse PDF ({e})") from e


def load(source: str, content: bytes, name: str | None = None, preprocess: Callable[[str], str] | None = None) -> dict:
    """One file as a document; raises Unsupported, Unreadable or Empty."""
    path = PurePosixPath(source)
    kind = SUFFIXES.get(path.suffix.lower())
    if kind is None:
        raise Unsupported(f"{source}: unsupported file type '{path.suffix}' (supported: {', '.join(sorted(SUFFIXES))})")
    meta: dict = {}
    if kind == "pdf":
        pages, title = read_pdf(content)
        text, own = "", []
        for number, page in enumerate(map(clean_plain, pages), 1):
            if page:
                text += "\n\n" if text else ""
                own.append(Section(len(text), len(text) + len(page), page=number))
                text += page
        title = name or title or path.stem
        meta = {"page_count": len(pages)}
    else:
        try:
            raw = content.decode("utf-8")
        except UnicodeDecodeError as e:
            raise Unreadable(f"{source}: not valid UTF-8 text") from e
        if kind == "markdown":
            front, body = front_matter(raw)
            text = clean_markdown(preprocess(body) if preprocess else body)
            own, title = sections(text), str(front.get("title") or name or path.stem)
            meta = {k: front[k] for k in ("description", "content_type", "weight") if k in front}
        else:
            text = clean_plain(raw)
            text += "\n" if text else ""
            own, title = [Section(0, len(text))] if text else [], name or path.stem
    if not text.strip():
        raise Empty(f"{source}: no extractable text")
    return {"name": title, "source_type": kind, "text": text, "sections": [(s.start, s.end, list(s.heading_path), s.page) for s in own], "metadata": {"title": title} | {k: str(v) for k, v in meta.items()}}


def load_status(source: str, content: bytes | None, name: str | None = None, preprocess: Callable[[str], str] | None = None) -> tuple:
    """load() with its outcome: loaded; skipped if empty; failed with the message of a known error or the class of another."""
    try:
        d = load(source, bytes(content or b""), name, preprocess)
        return "loaded", None, d["name"], d["source_type"], d["text"], d["sections"], d["metadata"]
    except Empty as e:
        return ("skipped", str(e), None, None, None, None, None)
    except (Unsupported, Unreadable) as e:
        return ("failed", str(e), None, None, None, None, None)
    except Exception as e:
        return ("failed", type(e).__name__, None, None, None, None, None)


def load_files(files: DataFrame, preprocess: Callable[[str], str] | None = None) -> DataFrame:
    """Documents of files (source, content[, name]): source and the columns of LOADED. One bad file fails alone."""

    @F.pandas_udf(f"struct<{re.sub(r'(^|, )(\w+) ', r'\1\2:', LOADED)}>")
    def read(sources: pd.Series, contents: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [load_status(s, c, n, preprocess) for s, c, n in zip(sources, contents, names)]
        return pd.DataFrame(rows, columns=["status", "error", "name", "source_type", "text", "sections", "metadata"])

    name = F.col("name") if "name" in files.columns else F.lit(None).cast("string")
    return files.select("source", read("source", "content", name).alias("d")).select("source", "d.*")


def scan(spark: SparkSession, folder: str, prefix: str = "", only_known: bool = True) -> DataFrame:
    """source (relative to the folder, behind a prefix) and content of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    if only_known:
        found = found.where(suffix.isin(*SUFFIXES))
    base = "/" + folder.removeprefix("file:").strip("/") + "/"
    return found.select(F.concat(F.lit(prefix), F.element_at(F.split(F.col("path"), re.escape(base)), -1)).alias("source"), "content", "length", "modificationTime")


def corpus(spark: SparkSession, folder: str, subpaths: tuple[str, ...], index_page: str, prefix: str = "") -> DataFrame:
    """scan() of some folders of a documentation site, without the index page of its glossary."""
    keep = F.lit(False)
    for sub in subpaths:
        keep = keep | F.col("source").startswith(f"{prefix}{sub}/")
    return scan(spark, folder, prefix).where(keep & F.col("source").endswith(".md") & (F.col("source") != prefix + index_page))


def uploads(files: DataFrame) -> DataFrame:
    """Uploaded files (filename, content) as files to load: base names behind upload://, oversized ones with a reason."""
    base = F.element_at(F.split(F.regexp_replace("filename", r"\\", "/"), "/"), -1)
    return files.select(F.concat(F.lit("upload://"), base).alias("source"), "content", F.when(F.length("content") > UPLOAD_BYTES, F.lit("file too large")).alias("error"))


def manifest(files: DataFrame) -> DataFrame:
    """source, sha256 and bytes of every file."""
    return files.select("source", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))


def write_manifest(files: DataFrame, folder: str, header: dict[str, str]) -> None:
    """manifest() as JSON lines below ``folder``, and one row of the header with the number of files and bytes."""
    rows = manifest(files)
    rows.write.mode("overwrite").json(f"{folder}/files")
    head = rows.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).select(*[F.lit(v).alias(k) for k, v in header.items()], "files", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    head.write.mode("overwrite").json(f"{folder}/header")


def glossary_entry(stem: str, raw: str) -> tuple[str, str, str, str]:
    """Of one glossary file the id, title, short text and full text, parted at the <!--more--> mark."""
    meta, body = front_matter(raw)
    short, _, rest = body.partition("<!--more-->")
    key = str(meta.get("id") or stem)
    return key, str(meta.get("title") or key), short.strip(), f"{short.strip()}\n\n{rest.strip()}".strip()


def glossary(files: DataFrame) -> DataFrame:
    """term_id, title, short_text and full_text of glossary files; names that begin with _ are left out."""

    @F.pandas_udf("struct<term_id:string,title:string,short_text:string,full_text:string>")
    def read(stems: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [glossary_entry(s, bytes(c).decode("utf-8", "replace")) for s, c in zip(stems, contents)]
        return pd.DataFrame(rows, columns=["term_id", "title", "short_text", "full_text"])

    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")
    return files.where(~stem.startswith("_") & F.col("source").endswith(".md")).select(read(stem, "content").alias("g")).select("g.*")
