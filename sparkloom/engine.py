"""One object over a folder of tables: search, related entries, documents, boards, statistics, ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embed import hashed_vector
from .operators import ranking, sqlgate, stats, trees, vectors
from .sources import tables

MODES = ("hybrid", "vector", "text")


class Engine:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.entries, self.chunks, self.pages = (f(spark, folder) for f in (tables.entries, tables.chunks, tables.pages))

    def search(self, terms: Sequence[str] = (), vector: Sequence[float] | None = None, mode: str = "hybrid", limit: int = 10, offset: int = 0, where: Column | None = None) -> DataFrame:
        """Hits of a mode, the window that is asked for; filters on entries act before the cut."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        fetch = 200 * (1 + (limit + offset) // 100)  # as many for all pages of a hundred, so that pages fit together
        kept = self.chunks if where is None else self.chunks.join(self.entries.filter(where).select("entry_id"), "entry_id", "left_semi")
        near = vectors.top_k(kept, [float(x) for x in vector], fetch) if vector is not None and mode != "text" else None
        text = ranking.bm25(self.entries, "entry_id", "content", terms, fetch, where) if terms and mode != "vector" else None
        if near is not None and text is not None:
            hits, order = ranking.fuse(near, text, fetch, kept.filter("chunk_index = 0").select("entry_id", "chunk_id")), [F.desc("score"), F.col("chunk_id")]
        elif near is not None:
            hits, order = near.select("chunk_id", "entry_id", "score"), [F.desc("score"), F.col("chunk_id")]
        elif text is not None:
            hits, order = text, [F.desc("score"), F.col("entry_id")]
        else:
            raise ValueError("nothing to search for: give terms, a vector, or both")
        return ranking.page(hits, order, limit, offset)

    def vector_of(self, text: str) -> list[float]:
        """A text's hashed vector, as long as the chunks' vectors are."""
        dim = self.chunks.select(F.size("vector")).first()[0]
        return [float(x) for x in hashed_vector(text, dim)]

    def related(self, entry_id: int, limit: int = 10, least: float = 0.0) -> DataFrame:
        first = vectors.first_vectors(self.chunks.filter(F.col("entry_id") == entry_id)).select("vector").first()
        if first is None:
            raise KeyError(entry_id)
        return vectors.related_entries(self.chunks, [float(x) for x in first[0]], entry_id, limit, 5 * limit, least)

    def related_to_text(self, *parts: str, exclude: int | None = None, limit: int = 10, least: float = 0.0) -> DataFrame:
        """Entries near a text made of parts, the first 2,000 characters of it; none for a blank one."""
        text = " ".join(p for p in parts if p and p.strip())[:2000]
        hits = vectors.related_entries(self.chunks, self.vector_of(text), exclude, limit, 5 * limit, least)
        return hits if text else hits.limit(0)

    def tables(self) -> DataFrame:
        """Tables of the folder with their numbers of columns and rows."""
        return sqlgate.table_report({n: tables.table(self.spark, self.folder, n) for n in sqlgate.folder_tables(self.spark, self.folder)})

    def entry(self, entry_id: int) -> DataFrame:
        return self.entries.filter(F.col("entry_id") == entry_id)

    def document(self, entry_id: int) -> DataFrame:
        nested = self.chunks.filter(F.col("entry_id") == entry_id).groupBy("entry_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
        return self.entry(entry_id).join(nested, "entry_id", "left")

    def list_entries(self, entry_type: str | None = None, domain: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        rows = self.entries
        if entry_type:
            rows = rows.filter(F.col("entry_type") == entry_type)
        if domain:
            rows = rows.filter((F.col("source_domain") == domain) | F.col("source_domain").endswith(f".{domain}"))
        return ranking.page(rows, [F.desc("entry_id")], limit, offset)

    def stats(self) -> DataFrame:
        return stats.breakdown(self.entries, type="entry_type", domain="source_domain")

    def categories(self) -> DataFrame:
        return stats.tag_counts(self.entries)

    def board(self, columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
        return trees.board(tables.cards(self.spark, self.folder), columns, F.count("number"), names or columns)

    def children(self, item_id: str) -> DataFrame:
        return trees.children(tables.work_items(self.spark, self.folder)).filter(F.col("parent_id") == item_id)

    def sql(self, text: str, parameters: dict[str, Any] | None = None, limit: int | None = 1000, offset: int = 0) -> DataFrame:
        for name in ("entries", "chunks", "pages"):
            getattr(self, name).createOrReplaceTempView(name)
        return sqlgate.run_safely(self.spark, text, parameters, limit, offset)

    def templates(self) -> dict[str, str]:
        return dict(sqlgate.TEMPLATES)
