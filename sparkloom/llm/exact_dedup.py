"""Exact deduplication by Grace hashing.

Rows are combined within each task first, so that a hot text leaves a task once. What is left is written to spill
files in the shared folder and dealt out by a hash of the content into as many buckets as its size asks for; where one
job can't have that many, it is first dealt into folders that are taken one after another. Each bucket goes through a
table whose keys are whole normalised contents (a dict is an open-addressing table, and equal hashes are told apart by
comparing every byte). A bucket that outgrows its memory hands whole sub-buckets on to the next level, down to a single
content if need be; the next level deals them out anew with another hash, until every bucket fits.

Memory of a worker: `memory` bytes for its table, whatever the size or the skew of the input, as long as a single row
is smaller. The copies of a content take no room in the table: each gives out a narrow link at once.

Defined results: a null text is an empty one, and all empty texts are equal. Of equal texts the row with the most code
points in its original text stays, then the smallest id (null last), then one of the identical rows. Rows that repeat
an id are rows of their own: one stays. Columns other than id and text are carried and may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WHITE, small_batches, stored, tidy

_WHITE = WHITE.encode()
_LAST = (1 << 63) - 1
#: What a leader stands for: rows counted, the best row so far, and the bytes it takes in a table.
_LEADER = "_row long, _leader long, _sha string, _hash long, _count long, _chars long, _id long, _bytes long"
_WIDTH = 8
#: Rows out of a bucket: a leader and its class, a class with its best row, a content for the next level.
LINK, CLASS, OVER = 0, 1, 2


def _digest(content: bytes) -> tuple[str, int]:
    sha = hashlib.sha256(content)
    return sha.hexdigest(), int.from_bytes(sha.digest()[:8], "little", signed=True)


def _better(a: tuple, b: tuple) -> bool:
    """Whether (chars, id, row) a stays rather than b."""
    return (-a[0], _LAST if a[1] is None else a[1], a[2]) < (-b[0], _LAST if b[1] is None else b[1], b[2])


def _weight(content: bytes, values: tuple) -> int:
    """About the bytes that a content and the columns of its best row take in a table."""
    return 2 * len(content) + sum(len(v) for v in values if isinstance(v, (str, bytes, list, dict))) + 600


def _combine(limit: int, columns: list[str], text: str, schema: pa.Schema):
    """Per task: a member row for every row, and a leader row with the best row's columns for every content held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        held = 0

        def leaders() -> Iterator[pa.RecordBatch]:
            out = _Out(schema)
            while table:
                c, e = table.popitem()
                weight = _weight(c, e[3])
                out.add((e[1][2], e[0], e[4], e[5], e[2], e[1][0], e[1][1], weight, *e[3]), weight)
                if out.full() or not table:
                    yield out.batch()

        for batch in batches:
            rows, ids, chars = (batch.column(i).to_pylist() for i in range(3))
            carried = [batch.column(i + 3).to_pylist() for i in range(len(columns))]
            texts = batch.column(3 + columns.index(text)).cast(pa.binary()).to_pylist()
            out = []
            for i, raw in enumerate(texts):
                content = (raw or b"").translate(None, _WHITE)
                mine = (chars[i], ids[i], rows[i])
                e = table.get(content)
                if e is None:
                    e = table[content] = [rows[i], mine, 1, tuple(c[i] for c in carried), *_digest(content)]
                    held += len(content) + len(raw or b"") + 300
                else:
                    e[2] += 1
                    if _better(mine, e[1]):
                        e[1], e[3] = mine, tuple(c[i] for c in carried)
                out.append((rows[i], e[0], e[4], None, None, chars[i], ids[i], None))
            arrays = [pa.array([r[j] for r in out], schema.field(j).type) for j in range(_WIDTH)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(out), f.type) for f in list(schema)[_WIDTH:]], schema=schema)
            if held > limit:
                yield from leaders()
                held = 0
        yield from leaders()

    return run


class _Out:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 100) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return self.size > (8 << 20) or len(self.rows) > 5000

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)


def _grace(level: int, limit: int, columns: list[str], text: str, schema: pa.Schema, keep_rows: bool):
    """Per bucket: resolve the contents that fit, hand the others on to the next level.

    A content that was met is either held to the end, with all its copies, or handed on, with all copies met so far; its
    later copies are handed on, too. With keep_rows a class carries its best row's columns and no links are given.
    """
    sub = lambda h: (h >> (4 * (level % 14))) & 15
    at = _WIDTH + columns.index(text)
    none = (None,) * len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}  # content: leader, count, best row, weight
        held, fits = 0, 16
        out = _Out(schema)

        def give(leader: int, count: int, r: tuple, kind: int, slim: bool) -> None:
            values = none if slim else r[_WIDTH:]
            out.add((r[0], leader, r[2], r[3], count, *r[5:_WIDTH], *values, leader, kind), 100 if slim else r[_WIDTH - 1])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = (r[at] or "").encode("utf-8", "surrogatepass").translate(None, _WHITE)
                e = table.get(content)
                if e is not None:
                    e[1] += r[4]
                    if not keep_rows:
                        out.add((r[0], r[1], *r[2:_WIDTH], *none, e[0], LINK))
                    if _better((r[5], r[6], r[0]), (e[2][5], e[2][6], e[2][0])):
                        held += r[_WIDTH - 1] - e[3]
                        e[2], e[3] = r, r[_WIDTH - 1]
                elif sub(r[3]) >= fits:
                    give(r[1], r[4], r, OVER, False)
                else:
                    table[content] = [r[1], r[4], r, r[_WIDTH - 1]]
                    held += r[_WIDTH - 1]
                while held > limit and fits and len(table) > 1:
                    fits -= 1
                    for gone in [c for c, x in table.items() if sub(x[2][3]) >= fits]:
                        if len(table) == 1:
                            break
                        leader, count, best, weight = table.pop(gone)
                        held -= weight
                        give(leader, count, best, OVER, False)
                        if out.full():
                            yield out.batch()
                if out.full():
                    yield out.batch()
        for leader, count, best, _ in table.values():
            give(leader, count, best, CLASS, not keep_rows)
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _spill(docs: DataFrame, id_col: str, text: str, limit: int) -> tuple[DataFrame, list[str]]:
    small_batches(docs.sparkSession)
    columns = docs.columns
    shown = [f"_c{i}" for i in range(len(columns))]  # positions, so that no name can clash
    body = docs.toDF(*shown)
    id_at, text_at = columns.index(id_col), columns.index(text)
    rows = body.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(shown[id_at]).cast("long").alias("_id"),
        F.coalesce(F.length(shown[text_at]), F.lit(0)).cast("long").alias("_chars"),
        *shown,
    )
    schema = T.StructType([*T.StructType.fromDDL(_LEADER).fields, *(T.StructField(n, docs.schema[i].dataType) for i, n in enumerate(shown))])
    spilled = rows.mapInArrow(tidy(_combine(limit, shown, shown[text_at], _arrow(schema))), schema)
    return stored(spilled, "grace"), shown


def _resolve(spill: DataFrame, shown: list[str], text: str, limit: int, keep_rows: bool, buckets: int) -> tuple[DataFrame, int]:
    """Rows of all buckets and levels, and how many levels deep they went. buckets: most that one job is given."""
    schema = T.StructType([*spill.schema.fields, T.StructField("_class", T.LongType()), T.StructField("_kind", T.IntegerType())])
    least = spill.sparkSession.sparkContext.defaultParallelism
    todo, done, deepest = [(spill.filter("_hash is not null"), 0)], [], 0
    while todo:
        pending, level = todo.pop()
        size = pending.agg(F.sum("_bytes")).first()[0] or 0
        wanted = -(-size // max(1, limit // 2))
        if wanted > buckets:
            parts = stored(pending.withColumn("_deal", F.pmod(F.xxhash64(F.lit(-1 - level), "_hash"), F.lit(16)).cast("int")), "dealt", by="_deal")
            todo += [(parts.filter(F.col("_deal") == i).drop("_deal"), level + 1) for i in range(16)]
            continue
        dealt = pending.repartition(max(wanted, least), F.xxhash64(F.lit(level), "_hash"))
        out = stored(dealt.mapInArrow(tidy(_grace(level, limit, shown, text, _arrow(schema), keep_rows)), schema), f"grace-{level}")
        done.append(out.filter(F.col("_kind") != OVER))
        deepest = max(deepest, level)
        over = out.filter(F.col("_kind") == OVER).drop("_class", "_kind")
        if not over.isEmpty():
            todo.append((over, level + 1))
    return functools.reduce(DataFrame.unionByName, done), deepest


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 48 << 20, buckets: int = 20_000) -> DataFrame:
    """The rows of docs that stay, with the columns of docs. memory: bytes that one table may hold; buckets: of one job."""
    columns = docs.columns
    spill, shown = _spill(docs, id_col, text_col, memory // 2)
    done, _ = _resolve(spill, shown, shown[columns.index(text_col)], memory, True, buckets)
    return done.select(*(F.col(s).alias(c) for s, c in zip(shown, columns, strict=True)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 48 << 20, buckets: int = 20_000) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spill, shown = _spill(docs.select(id_col, text_col), id_col, text_col, memory // 2)
    text = shown[[id_col, text_col].index(text_col)]
    found, levels = _resolve(spill, shown, text, memory, False, buckets)
    classes = found.filter(F.col("_kind") == CLASS).select("_class", F.col("_row").alias("_keep"), F.col("_id").alias("keep_id"), F.col("_count").alias("group_size"))
    links = found.select("_leader", "_class")  # a class is its own leader
    for _ in range(levels):  # a leader's class may have been handed on and found another class at a later level
        links = links.join(found.select(F.col("_leader").alias("_class"), F.col("_class").alias("_next")), "_class").select("_leader", F.col("_next").alias("_class"))
    members = spill.filter("_hash is null").select("_row", "_leader", F.col("_id").alias("doc_id"), F.col("_sha").alias("text_sha256"))
    named = members.join(links.join(classes, "_class"), "_leader")
    return named.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_keep")).alias("kept"), "text_sha256")
