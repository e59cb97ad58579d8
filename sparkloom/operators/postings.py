"""A stored text index: postings by term and block of documents, with positions; BM25 and phrases read what they ask for.

A document lies in one block, which holds a few hundred documents of like length. A row of postings is one term in one
block: its documents with uses, lengths and positions, and what bounds their scores: the most uses and the least length.
Rows are dealt by a hash of the term into folders and sorted by term, so that a search opens the folders of its terms
only, and within them the row groups and columns it needs. Blocks whose bound is below the k-th best score found in the
most promising blocks are not read at all.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir, stored
from ..sources.versions import Versions
from .ranking import K1, B, tokens

_CLASS = 1 << 40


def block_postings(rows: pa.Table) -> pa.Table:
    """Postings of one block's documents (block, id, words): term, block, n, most, least, ids, tfs, lens, places.

    Rows of the same id and number of words are one document, whose uses are those of all of them.
    """
    ids = rows["id"].combine_chunks()
    words = rows["words"].combine_chunks()
    lens = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    order = np.lexsort((lens, pc.rank(ids, tiebreaker="dense").to_numpy()))
    ids, words, lens = ids.take(order), words.take(order), lens[order]
    same = pc.rank(ids, tiebreaker="dense").to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (same[1:] != same[:-1]) | (lens[1:] != lens[:-1])
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    flat = words.flatten().dictionary_encode()
    starts = np.repeat(np.cumsum(lens) - lens, lens)
    at = (np.arange(len(flat)) - starts).astype(np.int32)
    use = flat.indices.to_numpy().astype(np.int64) * len(first) + np.repeat(number, lens)
    by = np.lexsort((at, use)) if len(first) < len(ids) else np.argsort(use, kind="stable")
    use, at = use[by], at[by]
    begins = np.flatnonzero(np.diff(use, prepend=-1))
    term, doc = np.divmod(use[begins], max(1, len(first)))
    tfs = np.diff(begins, append=len(use)).astype(np.int32)
    heads = np.flatnonzero(np.diff(term, prepend=-1))
    n = np.diff(heads, append=len(term))
    offsets = pa.array(np.append(heads, len(term)).astype(np.int32))
    size = lens[first[doc]].astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(use)).astype(np.int32)), pa.array(at))
    top = lambda of, values: of.reduceat(values, heads) if len(heads) else values[:0]
    columns = {
        "term": flat.dictionary.take(pa.array(term[heads])), "block": pa.array(np.full(len(heads), rows["block"][0].as_py() if len(rows) else 0, np.int64)), "n": pa.array(n.astype(np.int64)),
        "most": pa.array(top(np.maximum, tfs)), "least": pa.array(top(np.minimum, size)), "ids": listed(ids.take(pa.array(first[doc]))), "tfs": listed(pa.array(tfs)), "lens": listed(pa.array(size)), "places": listed(places),
    }
    return pa.table(columns)


class Index(Versions):
    """Postings of a text column under one folder, changed by layers. key: a column of whole numbers or text."""

    MERGE = 16
    FEW = 20_000
    BYTES = 4 << 20
    SHARE = 64 << 20

    def __init__(self, spark: SparkSession, folder: str, key: str = "entry_id", buckets: int = 64, block: int = 512) -> None:
        super().__init__(spark, folder, key)
        self.buckets, self.block = buckets, block

    def schema_of(self, name: str, layers: list[int]) -> str | None:
        if name == "left":
            return "term string, n long, bucket int"
        if name != "postings":
            return None
        key = self.spark.read.parquet(f"{self.folder}/v{layers[0]}/docs").schema[self.key].dataType.simpleString()
        return f"term string, block long, n long, most int, least int, ids array<{key}>, tfs array<int>, lens array<int>, places array<array<int>>, bucket int"

    # Writing

    def _tables(self, docs: DataFrame, text: str) -> dict[str, DataFrame]:
        """docs (key, len, _block and the other columns) and postings of rows.

        Texts are dealt by block, and a block's postings are made where they lie: no word is a row of its own.
        """
        size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
        block, total = self._block_of(docs, size)
        held = stored(docs.select(*(c for c in docs.columns if c != text), F.size(tokens(F.col(text))).alias("len"), block.alias("_block")), "index-docs")
        texts = docs.select(block.alias("block"), F.col(self.key).alias("id"), F.col(text).alias("_text")).repartition("block").sortWithinPartitions("block")
        words = texts.select("block", "id", tokens(F.col("_text")).alias("words"))
        kind = docs.schema[self.key].dataType.simpleString()
        rows = words.groupBy("block").applyInArrow(block_postings, f"term string, block long, n long, most int, least int, ids array<{kind}>, tfs array<int>, lens array<int>, places array<array<int>>")
        return {"docs": held, "postings": self._dealt(rows, total), "totals": self._totals(held)}

    def _block_of(self, docs: DataFrame, size: Column) -> tuple[Column, int]:
        """The block of a document, and the bytes of all: its class of sizes, a quarter of a doubling wide, and a part of it by a hash of the key.

        A part has about `block` documents, or BYTES bytes where that is less.
        """
        cls = F.floor(F.log2(size + 1) * 4).cast("long")
        counts = docs.groupBy(cls.alias("c")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()  # some hundred classes at most
        parts = F.lit(1)
        for r in counts:
            parts = F.when(cls == r.c, max(1, math.ceil(r.n / self.block), math.ceil(r.bytes / self.BYTES))).otherwise(parts)
        return cls * _CLASS + F.pmod(F.xxhash64(self.key), parts), sum(r.bytes for r in counts)

    def _gathered(self, uses: DataFrame, one: Column, total: int) -> DataFrame:
        """Postings from (key, len, term, tf, places, block)."""
        rows = uses.groupBy("term", "block").agg(F.sort_array(F.collect_list(one)).alias("all"), F.max("tf").alias("most"), F.min("len").alias("least"), F.count("*").alias("n"))
        return self._dealt(rows.select("term", "block", "n", "most", "least", *(F.col(f"all.{a}").alias(b) for a, b in (("id", "ids"), ("tf", "tfs"), ("len", "lens"), ("places", "places")))), total)

    def _dealt(self, rows: DataFrame, total: int) -> DataFrame:
        """Postings in order within their buckets; a bucket is dealt to as many tasks, by block, as keep each one's share of the text bounded."""
        tasks = math.ceil(total / (self.buckets * self.SHARE)) or 1
        rows = rows.select(self._bucket().alias("bucket"), "*")
        return rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(tasks))).sortWithinPartitions("bucket", "term", "block")

    def _totals(self, docs: DataFrame) -> DataFrame:
        return docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("length"))

    def _bucket(self) -> Column:
        return (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int")

    def build(self, docs: DataFrame, text: str) -> int:
        """Write all rows of docs (key, text, and columns to filter by) as a new base."""
        return self.write(self._tables(docs, text), by={"postings": "bucket"})

    def change(self, new: DataFrame, text: str, gone: DataFrame) -> int:
        """Documents of new come in, and those with their keys or the keys of gone go out.

        The change holds how many documents of each term went out, from the places of the old ones.
        """
        layers = self.layers()
        if not layers:
            return self.build(new, text)
        touched = stored(gone.select(self.key).union(new.select(self.key)).distinct(), "touched")
        old = self.live(self.of(layers, "docs").select(self.key, "len", "_block", "_layer"), layers).join(touched, self.key)
        totals = self._totals(old)
        gone_of = old.groupBy("_layer", F.col("_block").alias("block")).agg(F.collect_list(self.key).alias("_gone"))  # a block's documents at most
        posted = self.of(layers, "postings").select("_layer", "block", "term", "ids").join(gone_of, ["_layer", "block"])
        once = F.size(F.array_distinct("ids")) == F.size("ids")
        n = F.when(once, F.size(F.array_intersect("ids", "_gone"))).otherwise(F.size(F.filter("ids", lambda x: F.array_contains("_gone", x))))
        left = posted.select("term", n.cast("long").alias("n")).filter("n > 0").groupBy("term").agg(F.sum("n").alias("n")).withColumn("bucket", self._bucket())
        parts = self._tables(new, text) | {"touched": touched, "left": left, "left_totals": totals}
        if len(layers) <= self.MERGE:
            return self.write(parts, "done", {"postings": "bucket", "left": "bucket"})
        self.write(parts, "done", {"postings": "bucket", "left": "bucket"})
        return self.merge()

    def delete(self, gone: DataFrame) -> int:
        """Documents of the keys go out."""
        layers = self.layers()
        if not layers:
            return 0
        names = self.of(layers[:1], "docs").drop("_layer", "len", "_block")
        return self.change(names.withColumn("_text", F.lit("")).limit(0), "_text", gone)

    def merge(self) -> int:
        """All layers as one base, from their postings: no text is read."""
        layers = self.layers()
        docs = self.live(self.of(layers, "docs"), layers).drop("_layer", "_block")
        block, total = self._block_of(docs, F.col("len") * 6)  # about six bytes a word
        docs = stored(docs.withColumn("_block", block), "index-docs")
        rows = self.live(self._entries(self.of(layers, "postings"), ["ids", "tfs", "lens", "places"]), layers)
        rows = rows.select(self.key, "term", F.col("tfs").alias("tf"), F.col("lens").alias("len"), "places").withColumn("block", block)
        one = F.struct(F.col(self.key).alias("id"), "tf", "len", "places")
        return self.write({"docs": docs, "postings": self._gathered(rows, one, total), "totals": self._totals(docs)}, by={"postings": "bucket"})

    # Reading

    def _entries(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """One row for each term and document, of the block rows' columns."""
        kept = [c for c in ("term", "block", "_layer") if c in rows.columns]
        zipped = rows.select(*kept, F.explode(F.arrays_zip(*columns)).alias("z"))
        return zipped.select(*kept, F.col("z.ids").alias(self.key), *(F.col(f"z.{c}").alias(c) for c in columns[1:]))

    def terms(self, layers: list[int], words: Sequence[str], name: str = "postings") -> DataFrame:
        """Rows of the words: nothing but their folders is listed or read."""
        wanted = [f"bucket={b}" for b in sorted({zlib.crc32(w.encode()) % self.buckets for w in words})]
        reader = self.spark.read.schema(self.schema_of(name, layers))
        parts = []
        for n in layers:
            at = f"v{n}/{name}"
            there = [f"{self.folder}/{at}/{b}" for b in wanted if (lambda x: x[1].exists(x[0]))(self._path(f"{at}/{b}"))]
            rows = reader.option("basePath", f"{self.folder}/{at}").parquet(*there) if there else self.spark.createDataFrame([], self.schema_of(name, layers))
            parts.append(rows.withColumn("_layer", F.lit(n)))
        return reduce(DataFrame.unionByName, parts).filter(F.col("term").isin(list(words)))

    def totals(self, layers: list[int]) -> tuple[int, int]:
        """Documents and their lengths together, as of the newest layer."""
        parts = self.of(layers, "totals").select("n", "length")
        if len(layers) > 1:
            parts = parts.unionByName(self.of(layers[1:], "left_totals").select((-F.col("n")).alias("n"), (-F.col("length")).alias("length")))
        return tuple(parts.agg(F.sum("n"), F.sum("length")).first())

    def search(self, asked: Sequence[str], limit: int, where: Column | None = None, must: Sequence[str] = (), never: Sequence[str] = ()) -> DataFrame:
        """The `limit` best documents for words joined by OR: key, score; the same as ranking.bm25 of the live documents.

        What is known of the words' blocks is weighed in the driver while it has at most FEW rows, and by Spark beyond.
        """
        asked, must, never = (sorted({w.lower() for w in x}) for x in (asked, must, never))
        layers, words = self.layers(), sorted({*asked, *must, *never})
        if not layers:
            raise ValueError(f"no index in {self.folder}")
        none = self.of(layers[:1], "docs").select(self.key, F.lit(0.0).alias("score")).limit(0)
        n, length = self.totals(layers)
        if not n or not length or not asked:
            return none
        rows, mean = self.terms(layers, words), length / n
        known = rows.select("_layer", "block", "term", "n", "most", "least")
        few = known.limit(self.FEW + 1).collect()
        frequency: Counter = Counter()
        for r in few if len(few) <= self.FEW else known.groupBy("term").agg(F.sum("n").alias("n")).collect():
            frequency[r.term] += r.n
        for r in self.terms(layers[1:], words, "left").groupBy("term").agg(F.sum("n").alias("n")).collect() if len(layers) > 1 else ():
            frequency[r.term] -= r.n
        idf = {w: math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in asked}
        weight = F.lit(0.0)
        for w in asked:
            weight = F.when(F.col("term") == w, F.lit(idf[w])).otherwise(weight)
        part = lambda tf, size: weight * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.lit(mean)))
        count = lambda of: F.coalesce(F.sum(F.col("term").isin(of).cast("int")), F.lit(0)) if of else F.lit(0)

        def scored(read: DataFrame) -> DataFrame:
            hits = self._entries(read, ["ids", "tfs", "lens"]).groupBy(self.key, "_layer")
            hits = hits.agg(F.sum(part("tfs", "lens")).alias("score"), count(must).alias("has"), count(never).alias("bars"))
            hits = self.live(hits.filter((F.col("has") == len(must)) & (F.col("bars") == 0) & (F.col("score") > 0)), layers)
            if where is not None:
                hits = hits.join(self.of(layers, "docs").filter(where).select(self.key, "_layer"), [self.key, "_layer"], "left_semi")
            return hits.select(self.key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), self.key).limit(limit)

        promising = max(4, math.ceil(4 * limit / self.block))
        if len(few) <= self.FEW:
            bounds, has, rarest = Counter(), Counter(), Counter()
            rare = min(asked, key=lambda w: frequency[w] or n)
            for r in few:
                place = (r["_layer"], r.block)
                rarest[place] += r.n if r.term == rare else 0
                bounds[place] += idf.get(r.term, 0.0) * r.most * (K1 + 1) / (r.most + K1 * (1 - B + B * r.least / mean))
                has[place] += r.term in must
            places = sorted((p for p in bounds if has[p] == len(must)), key=lambda p: (-bounds[p], p))

            def of_places(some: list[tuple[int, int]]) -> DataFrame:
                which = F.lit(False)
                for layer in layers:
                    own = [b for n_, b in some if n_ == layer]
                    which |= (F.col("_layer") == layer) & F.col("block").isin(own) if own else F.lit(False)
                return rows.filter(which)

            # As many more blocks as hold enough documents with the rarest word, which the best ones are likely to have.
            upto = accumulate(rarest[p] for p in places)
            promising = max(promising, min(64, next((i for i, held in enumerate(upto, 1) if held >= 2 * limit), promising)))
            top = scored(of_places(places[:promising])).collect() if len(places) > promising else []
            least = top[-1].score - 1e-6 if len(top) == limit else 0.0  # scores are rounded
            return scored(of_places([p for i, p in enumerate(places) if i < promising or bounds[p] >= least]))
        bounds = known.groupBy("_layer", "block").agg(F.sum(part("most", "least")).alias("bound"), count(must).alias("has"))
        bounds = stored(bounds.filter(F.col("has") == len(must)).select("_layer", "block", "bound"), "bounds")
        first = stored(bounds.orderBy(F.desc("bound"), "_layer", "block").limit(promising), "first")
        of_blocks = lambda blocks: rows.join(blocks.select("_layer", "block"), ["_layer", "block"], "left_semi")
        top = scored(of_blocks(F.broadcast(first))).collect()
        least = top[-1].score - 1e-6 if len(top) == limit else 0.0
        return scored(of_blocks(bounds.filter(F.col("bound") >= least).unionByName(first).distinct()))

    def phrase(self, words: Sequence[str]) -> DataFrame:
        """Keys of the documents in which the words follow each other: their places, moved by the place in the phrase, meet."""
        words = [w.lower() for w in words]
        layers = self.layers()
        rows = self.terms(layers, sorted(set(words)))
        whole = rows.groupBy("_layer", "block").agg(F.count("*").alias("k")).filter(F.col("k") == len(set(words))).select("_layer", "block")
        held = self._entries(rows.join(whole, ["_layer", "block"], "left_semi"), ["ids", "places"])
        places = held.groupBy(self.key, "_layer").agg(*(F.first(F.when(F.col("term") == w, F.col("places")), ignorenulls=True).alias(f"_p{i}") for i, w in enumerate(sorted(set(words)))))
        back = lambda i: lambda place: place - i
        found = None
        for i, w in enumerate(words):
            moved = F.transform(f"_p{sorted(set(words)).index(w)}", back(i))
            found = moved if found is None else F.array_intersect(found, moved)
        return self.live(places.filter(F.size(found) > 0), layers).select(self.key)


def index_of(spark: SparkSession, folder: str, table: str, docs: DataFrame, text: str) -> Index:
    """The index of a table's present files: found in the shared folder, or built there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))
    name = hashlib.sha256(repr((files, sorted(docs.columns), text)).encode()).hexdigest()[:24]
    index = Index(spark, f"{shared_dir(spark)}/index-{name}", docs.columns[0])
    if not index.version():
        try:
            index.build(docs, text)
        except RuntimeError:  # another session builds it, or died while it did: this one takes a folder of its own
            index = Index(spark, f"{index.folder}-{uuid.uuid4().hex}", docs.columns[0])
            index.build(docs, text)
    return index
