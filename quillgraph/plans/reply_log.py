"""A log of model replies in the shared folder, read before a model is asked.

A task that runs again, because its executor was lost or the job was started anew, finds what
was answered before and asks only for the rest. Each document has its own files: one for each
time that a task took it up, a line for each reply, flushed as it comes.
"""

from __future__ import annotations

import json
import uuid
from hashlib import blake2b

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.files import _store
from .engines import ChunkContext, extract_with_retries

_LINE = "document string, chunk_index int, attempt int, model string, asked string, reply string"


def _digest(model: str, talk: list[dict]) -> str:
    return blake2b(json.dumps([model, talk]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class ReplyLog:
    """The replies of one document. A line that was cut off, as its writer died, is passed over."""

    def __init__(self, folder: str, document: str):
        self.store, root = _store(folder)
        name = blake2b(document.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        self.document, self.folder = document, f"{root}/{name[:2]}/{name}"
        self.known: dict[str, str] = {}
        self.out = None
        if self.store.get_file_info(self.folder).type == fs.FileType.Directory:
            for info in self.store.get_file_info(fs.FileSelector(self.folder)):
                with self.store.open_input_stream(info.path) as f:
                    for line in f.read().decode("utf-8", "replace").split("\n"):
                        try:
                            row = json.loads(line)
                            self.known.setdefault(row["asked"], row["reply"])
                        except (ValueError, KeyError, TypeError):
                            continue

    def add(self, asked: str, reply: str, chunk_index: int, attempt: int, model: str) -> None:
        if self.out is None:
            self.store.create_dir(self.folder)
            self.out = self.store.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
        self.out.write((json.dumps({"document": self.document, "chunk_index": chunk_index, "attempt": attempt, "model": model, "asked": asked, "reply": reply}) + "\n").encode())
        self.out.flush()
        self.known[asked] = reply

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class LoggedEngine:
    """An engine over one with ask(talk) -> reply, whose replies go to a log under folder and come from there.

    The key of a reply is the model and all that was said, so another prompt or model asks
    anew. Errors are not logged: what failed for want of an answer is asked again.
    """

    def __init__(self, inner, folder: str):
        self.inner, self.folder = inner, folder
        self.id, self.model = inner.id, inner.model
        self.log: ReplyLog | None = None

    def availability(self) -> str:
        return self.inner.availability()

    def init(self) -> None:
        self.inner.init()

    def dispose(self) -> None:
        if self.log is not None:
            self.log.close()
            self.log = None
        self.inner.dispose()

    def suggest_title(self, excerpt: str) -> str:
        return self.inner.suggest_title(excerpt)

    def extract(self, chunk: str, context: ChunkContext) -> list[dict]:
        document = context.document or ""
        if self.log is None or self.log.document != document:
            if self.log is not None:
                self.log.close()
            self.log = ReplyLog(self.folder, document)
        log, attempt = self.log, 0

        def ask(talk: list[dict]) -> str:
            nonlocal attempt
            attempt += 1
            asked = _digest(self.model, talk)
            if asked not in log.known:
                log.add(asked, self.inner.ask(talk), context.index, attempt, self.model)
            return log.known[asked]

        return extract_with_retries(ask, chunk, context)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """(document, chunk_index, attempt, model, asked, reply) of a log, each reply once; it can be parsed like any stored replies."""
    lines = spark.read.schema(f"{_LINE}, _corrupt_record string").option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    whole = lines.filter(F.col("asked").isNotNull() & F.col("reply").isNotNull() & F.col("_corrupt_record").isNull())
    return whole.dropDuplicates(["document", "asked"]).drop("_corrupt_record")
