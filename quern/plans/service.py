"""The service surface over tables in a folder: health, ingest, listing and queries."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import __version__
from quern.config import Settings
from quern.functions import text as T
from quern.operators import bm25, generation, ingest
from quern.plans import registry
from quern.schema import CHUNKS, DOCUMENTS, PARENT_CHUNKS
from quern.session import checkpointed, discard
from quern.sources import files


class ServiceError(RuntimeError):
    """A failure with the HTTP status that tells whose it is."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Engine:
    """Tables documents, parent_chunks and chunks below ``folder``.

    Rows lie in ``buckets`` directories by a hash of their document. A write makes new directories for the buckets it
    touches, and then one commit file, which names the live directories of all three tables: readers see all of a write or
    nothing. Directories that the last KEPT commits do not name are removed. Of two writers at once the later
    fails, as its commit is taken.
    """

    NAMES = {"documents": DOCUMENTS, "parent_chunks": PARENT_CHUNKS, "chunks": CHUNKS}
    KEYS = {"documents": "id", "parent_chunks": "document_id", "chunks": "document_id"}
    KEPT = 2

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings(), embed: Callable[[Column], Column] | None = None, call: Callable = generation.offline, buckets: int = 64):
        self.spark, self.folder, self.settings, self.embed, self.call, self.buckets = spark, folder.rstrip("/"), settings, embed, call, buckets
        self.indexes = bm25.Registry()

    def _at(self, path: str):
        """A path of Hadoop and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[tuple[int, dict]]:
        """Number and content of all complete commits, oldest first."""
        at, fs = self._at("commits")
        if not fs.exists(at):
            return []
        out = []
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            stream = fs.open(status.getPath())
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("}\n"):  # else it is being written
                out.append((int(name.split(".")[0]), json.loads(text)))
        return sorted(out, key=lambda x: x[0])

    def _next(self) -> int:
        """One more than any commit, whole or of a writer that died."""
        at, fs = self._at("commits")
        return 1 + max((int(s.getPath().getName().split(".")[0]) for s in (fs.listStatus(at) if fs.exists(at) else ())), default=0)

    def live(self) -> dict[str, dict[str, str]]:
        """Directory by bucket of every table, as of the last commit."""
        commits = self._commits()
        return commits[-1][1] if commits else {name: {} for name in self.NAMES}

    def table(self, name: str, buckets: set[str] | None = None) -> DataFrame:
        """A table as of the last commit, or some of its buckets."""
        paths = [f"{self.folder}/{path}" for bucket, path in sorted(self.live()[name].items()) if buckets is None or bucket in buckets]
        return self.spark.read.schema(self.NAMES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.NAMES[name])

    def init(self, drop: bool = False) -> None:
        """Commit empty tables if there are none; with ``drop`` whatever is there is removed first."""
        if drop:
            at, fs = self._at("")
            fs.delete(at, True)
        if not self._commits():
            self._commit({name: {} for name in self.NAMES}, self._next())

    def _commit(self, live: dict, number: int) -> None:
        at, fs = self._at(f"commits/{number:08d}.json")
        out = fs.create(at, False)
        out.write((json.dumps(live) + "\n").encode())
        out.close()

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("string")

    def replace(self, ids: DataFrame, rows: dict[str, DataFrame]) -> None:
        """In every table the rows of the documents ``ids`` (document_id) give way to ``rows``; only the buckets of these documents are written."""
        touched = {r[0] for r in ids.select(self.bucket("document_id")).distinct().collect()}  # at most ``buckets``
        live, number = self.live(), self._next()
        for name, new in rows.items():
            key, columns = self.KEYS[name], [c.split(" ")[0] for c in self.NAMES[name].split(", ")]
            kept = self.table(name, touched).join(ids.select(F.col("document_id").alias(key)), key, "left_anti")
            path = f"{name}/v{number:08d}-{uuid.uuid4().hex[:8]}"
            both = kept.select(columns).unionByName(new.select(columns)).withColumn("bucket", self.bucket(key))
            both.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
            at, fs = self._at(path)
            written = {s.getPath().getName().split("=")[1] for s in fs.listStatus(at) if "=" in s.getPath().getName()}
            live[name] = {b: p for b, p in live[name].items() if b not in touched} | {b: f"{path}/bucket={b}" for b in written}
        self._commit(live, number)
        self._clean()

    def _clean(self) -> None:
        """Remove the directories and commits that the last commits do not name."""
        commits = self._commits()
        named = {p.split("/bucket=")[0] for _, live in commits[-self.KEPT :] for own in live.values() for p in own.values()}
        for name in self.NAMES:
            at, fs = self._at(name)
            for s in fs.listStatus(at) if fs.exists(at) else ():
                if f"{name}/{s.getPath().getName()}" not in named:
                    fs.delete(s.getPath(), True)
        for number, _ in commits[: -self.KEPT]:
            at, fs = self._at(f"commits/{number:08d}.json")
            fs.delete(at, False)

    def health(self) -> dict:
        """status ok, or degraded with the failing component."""
        components = {}
        for name in self.NAMES:
            try:
                self.table(name).limit(1).count()
                components[name] = "ok"
            except Exception as e:
                components[name] = type(e).__name__
        ok = all(v == "ok" for v in components.values())
        return {"status": "ok" if ok else "degraded", "version": __version__, "strategy": self.settings.retrieval.strategy, "components": components}

    def ingest(self, found: DataFrame, preprocess: Callable[[str], str] | None = None) -> DataFrame:
        """Load, cut and store files (source, content); the result rows of quern.operators.ingest."""
        loaded = checkpointed(files.load_files(found, preprocess))
        known = self.table("documents").select("id", F.col("metadata")["fingerprint"].alias("fingerprint"))
        t = ingest.ingest(loaded, self.settings, known, self.embed)
        results = checkpointed(t.results)
        changed = results.where("status in ('created', 'updated')").select("document_id")
        if not changed.isEmpty():
            self.replace(changed, {"parent_chunks": t.parents, "chunks": t.chunks, "documents": t.documents})
        discard(t.pieces)
        return results

    def upload(self, sent: list[tuple[str, bytes]]) -> DataFrame:
        """ingest() of up to UPLOAD_FILES files of up to UPLOAD_BYTES each."""
        if len(sent) > files.UPLOAD_FILES:
            raise ValueError(f"at most {files.UPLOAD_FILES} files")
        rows = files.uploads(self.spark.createDataFrame(sent, "filename string, content binary"))
        return self.ingest(rows.where("error is null").select("source", "content"))

    def documents(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """Documents with their number of chunks, by source; limit within 1..1000."""
        return list_documents(self.table("documents"), self.table("chunks"), limit, offset)

    def query(self, text: str, strategy: str | None = None, top_k: int | None = None, filters: dict | None = None, with_text: bool = False) -> dict:
        """One question answered from the tables: answer, citations with labels, contexts by rank, usage and timings.

        Raises ServiceError: 422 for bad arguments, 501 for a planned strategy, 503 if an embedder or a reranker fails, 502 if the
        language model does.
        """
        name = strategy or self.settings.retrieval.strategy
        try:
            if not 1 <= len(text) <= 2000:
                raise ValueError("a query has 1 to 2000 characters")
            if top_k is not None and not 1 <= top_k <= 50:
                raise ValueError("top_k must be within 1 and 50")
            began = time.perf_counter()
            asked = self.spark.createDataFrame([("q", text)], "query_id string, query string")
            c = registry.Context(self.table("chunks"), self.settings, self.embed, filters=filters, indexes=self.indexes)
            found = registry.retrieve(c, asked, top_k, name).withColumn("title", F.col("metadata")["title"])
            found = checkpointed(found)
        except NotImplementedError as e:
            raise ServiceError(501, str(e)) from e
        except ValueError as e:
            raise ServiceError(422, str(e)) from e
        except RuntimeError as e:
            raise ServiceError(503, str(e)) from e
        except PySparkException as e:  # a model function failed in a task
            raise ServiceError(503, "reranker or embedding model unavailable") from e
        retrieved = time.perf_counter()
        answers = generation.answer(asked, found, self.call, self.settings.generation.retries)
        label = T.citation_label(F.col("rank"), F.col("title"), F.col("section"), F.col("document_id"), F.col("page"))
        row = answers.join(generation.citations(answers).drop("query_id"), F.lit(True)).drop("contexts", "query_id").first().asDict(recursive=True)
        if row.pop("error"):
            raise ServiceError(502, "LLM backend error")
        shown = found.orderBy("rank").select("rank", "chunk_id", "document_id", F.round("score", 6).alias("score"), "retriever", "title", "section", F.col("metadata")["url"].alias("url"), "components", label.alias("label"), *(["text"] if with_text else []))
        contexts = [r.asDict(recursive=True) for r in shown.collect()]  # at most 50
        labels = {x["rank"]: x.pop("label") for x in contexts}
        usage = {k: row.pop(k) for k in ("model", "input_tokens", "output_tokens", "attempts", "latency_s")}
        for x in row["citations"]:
            x["context"].pop("block", None)
        return {
            "trace_id": uuid.uuid4().hex, "strategy": name, **row, "sources": [labels[x["number"]] for x in row["citations"]], "contexts": contexts, "usage": usage,
            "timings": {"retrieval_s": round(retrieved - began, 4), "total_s": round(time.perf_counter() - began, 4)},
        }


def list_documents(documents: DataFrame, chunks: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """id, name, source and chunks of documents by source; documents without chunks count 0."""
    limit, offset = min(max(limit, 1), 1000), max(offset, 0)
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("id").alias("chunks"))
    # The page is cut before the join: only its rows look up their counts.
    page = documents.select("id", "name", "source").orderBy("source", "id").offset(offset).limit(limit)
    return page.join(n, "id", "left").select("id", "name", "source", F.coalesce("chunks", F.lit(0)).alias("chunks"))
