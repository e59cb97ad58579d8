"""From pages to stored tables: structure, chunks, vectors; written by key, so that a repeated run changes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..functions.embed import embed
from ..sources.storage import small_batches, stored
from ..sources.versions import Versions
from . import chunkers, maintain, ranking


@dataclass
class Ingested:
    entries: DataFrame
    chunks: DataFrame
    terms: DataFrame


def build(pages: DataFrame, dim: int = 256, size: int = 2000, least: int = chunkers.LEAST) -> Ingested:
    """pages: page_id, url, html. Entries, their chunks with vectors, and the terms of their text; parsed once."""
    small_batches(pages.sparkSession)
    parsed = pages.select("page_id", "url", markup.page_structure(F.col("html"), F.col("url")).alias("p"))
    entries = stored(
        parsed.select(
            F.col("page_id").alias("entry_id"),
            urls.untracked(F.col("url")).alias("source_path"),
            urls.host(F.col("url")).alias("source_domain"),
            "p.title",
            "p.description",
            markup.clean_markdown(F.col("p.markdown")).alias("content"),
            F.transform("p.headings", lambda h: h["text"]).alias("tags"),
            F.sha2(F.col("p.markdown"), 256).alias("source_hash"),
        ),
        "entries",
    )
    chunks = chunkers.packed_chunks(entries, "markdown", size, least=least)
    chunks = chunks.select(F.concat_ws("#", "entry_id", "chunk_index").alias("chunk_id"), "*", embed(F.col("text"), dim).alias("vector"))
    terms, _ = ranking.postings(entries, "entry_id", "content")
    return Ingested(entries, chunks, terms)


class Store(Versions):
    """Entries, chunks and terms under one folder, each version a folder of its own; a change writes the next version.

    A change holds new rows and the ids of the entries it touches, no others. Every MERGE changes a version with all rows
    is written, which readers start from. On an empty folder a deletion changes nothing.
    """

    TABLES = ("entries", "chunks", "terms")
    MERGE = 16

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, folder, "entry_id")

    _layers, _write = Versions.layers, Versions.write

    def _change(self, ids: DataFrame, new: dict[str, DataFrame]) -> int:
        """Rows of the ids (entry_id) go, new rows come."""
        if len(self.layers()) <= self.MERGE:
            return self.write({**new, "touched": ids.select("entry_id").distinct()}, "done")
        return self.write({n: maintain.delete(self.read(n), ids, "entry_id").unionByName(new[n]) for n in self.TABLES})

    def replace(self, new: Ingested) -> int:
        """Entries with the same id are replaced with all their chunks and terms; others stay."""
        parts = {"entries": new.entries, "chunks": new.chunks, "terms": new.terms}
        return self._change(new.entries, parts) if self.version() else self.write(parts)

    def delete(self, ids: DataFrame) -> int:
        """Entries of the ids (entry_id) go, with their chunks and terms; 0 where there is no version yet."""
        return self._change(ids, {n: self.read(n).limit(0) for n in self.TABLES}) if self.version() else 0

    def clear(self) -> int:
        """A version without rows; 0 where there is no version yet."""
        return self.write({n: self.read(n).limit(0) for n in self.TABLES}) if self.version() else 0

    def reindex(self) -> int:
        """Terms of all entries anew; 0 where there is no version yet."""
        if not self.version():
            return 0
        entries = self.read("entries")
        return self.write({"entries": entries, "chunks": self.read("chunks"), "terms": ranking.postings(entries, "entry_id", "content")[0]})

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).count() if self.version() else 0 for n in self.TABLES}

    def ingest_stream(self, pages: DataFrame, checkpoint: str, **how) -> None:
        """Run a stream of pages to its end; each batch replaces the entries it has."""

        def each(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.replace(build(batch.dropDuplicates(["page_id"]), **how))

        pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
