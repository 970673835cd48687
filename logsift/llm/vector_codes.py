"""Vector code compression: product codes found with a trie over distinct parts.

Each component x becomes the integer floor(1024 * x); vectors are cut into
consecutive parts, and every part position learns a codebook of at most
``entries`` integer vectors.

Method: the distinct parts of a position, each with the number of vectors
that hold it, are counted once, dealt out in lexicographic ranges and staged;
a vector that a third of all rows repeat is one row of that table.  Every
round, tasks walk the trie of their parts depth first.  A node holds the
squared distances to all codebook entries, summed over the dimensions from the
root to it, and its children add one dimension each, so a common prefix is
priced once.  Leaves take the argmin and add their weighted part to the sums
of that entry.  Sibling nodes are expanded in blocks, and the stack holds at
most one open block of prices a depth.  What leaves a task are sums by
entry, so a round sends at most parts x entries x (part length + 1) numbers to
the driver, whatever the input.  The last assignment walks the trie of each
batch of rows and needs no join.

Cases: a vector that is null, or has a null or non-finite component, is
dropped, and so is one of another length than the kept vector with the
smallest id.  A null id sorts after all others; equal ids are ordered by their
components.  A length that the parts do not divide is cut at
``i * length // parts``; an empty vector has empty parts, nearest to entry 0.
Integers are held within the bound that keeps the squared distance of a whole
vector inside 64 bits (2**27.5, |x| up to 185,000, at 64 dimensions).  Repeated
rows are coded once each; a null label is a label of its own; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import stage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
NODE_BLOCK = 512
LAST_ID = (1 << 63) - 1


def component_bound(length: int) -> int:
    """Largest integer component for which a vector's squared distance fits into 64 bits."""
    return math.isqrt(((1 << 63) - 1) // max(length, 1)) // 2


def part_cuts(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and the place of every row among them."""
    n, width = parts.shape
    if not n or not width:
        return parts[:1], np.zeros(n, "i8")
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    place = np.empty(n, "i8")
    place[order] = np.cumsum(new) - 1
    return rows[new], place


def nearest(parts: np.ndarray, book: np.ndarray, block: int = NODE_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower index) and squared distance for distinct parts in lexicographic order.

    A stack item is a run of sibling or cousin nodes: their depth, the first row under each, the end of
    their rows, and the prices of the nodes above them.
    """
    n, width = parts.shape
    best, apart = np.zeros(n, "i8"), np.zeros(n, "i8")
    if not n or not width:
        return best, apart
    top = max(int(np.abs(parts).max()), int(np.abs(book).max()))
    kind = "i4" if width * (2 * top) ** 2 < 1 << 31 else "i8"
    columns, prices = parts.astype(kind).T.copy(), book.astype(kind).T.copy()
    split = np.zeros(n, "i8")  # the dimension where a row leaves the path of the row before
    split[1:] = (parts[1:] != parts[:-1]).argmax(axis=1)
    root = np.zeros(1, "i8")

    def runs(depth, start, end, up, above):
        nodes = start + np.flatnonzero(split[start:end] <= depth)
        if nodes[:1] != start:
            nodes = np.append(start, nodes)
        cuts = range(0, len(nodes), block)
        ends = [*(int(nodes[c]) for c in cuts[1:]), end]
        return [(depth, nodes[c:c + block], e, up, above) for c, e in zip(cuts, ends)][::-1]

    stack = runs(0, 0, n, root, np.zeros((1, len(book)), kind))
    while stack:
        depth, nodes, end, up, above = stack.pop()
        step = columns[depth][nodes][:, None] - prices[depth]
        step *= step
        step += above[np.searchsorted(up, nodes, "right") - 1]
        if depth + 1 < width:
            stack += runs(depth + 1, int(nodes[0]), end, nodes, step)
        else:
            best[nodes] = step.argmin(axis=1)
            apart[nodes] = step[np.arange(len(nodes)), best[nodes]]
    return best, apart


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("i8", copy=False).reshape(len(column), width)


def sum_parts(books: list[np.ndarray], rows: int = 1 << 15):
    """Task function: (part, x, n) to weighted sums (part, entry, pos, s); pos -1 is the weight itself."""

    def run(batches):
        total = [np.zeros((len(b), b.shape[1] + 1), "i8") for b in books]

        def add(held):
            part = np.concatenate([b.column(0).to_numpy() for b in held])
            weight = np.concatenate([b.column(2).to_numpy() for b in held])
            x = pa.concat_arrays([b.column(1) for b in held])
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                parts = _matrix(x.take(pa.array(at)), books[p].shape[1])
                leaves, place = distinct_parts(parts)
                entry = nearest(leaves, books[p])[0][place]
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                add_up = np.column_stack([parts, np.ones(len(parts), "i8")]) * weight[at][:, None]
                total[p][used] += np.add.reduceat(add_up[order], first, axis=0)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= rows:
                add(held)
                held, size = [], 0
        if size:
            add(held)
        for p, sums in enumerate(total):
            entry, pos = np.nonzero(sums)
            width = sums.shape[1] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), p, "i4")), pa.array(entry.astype("i4")),
                 pa.array(np.where(pos == width, -1, pos).astype("i4")), pa.array(sums[entry, pos])],
                ["part", "entry", "pos", "s"])

    return run


def code_rows(books: list[np.ndarray], cuts: list[int]):
    """Task function: (vec_id, label, x) to (vec_id, label, code, error)."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2), cuts[-1])
            codes, error = [], np.zeros(len(batch), "i8")
            for book, a, z in zip(books, cuts, cuts[1:]):
                leaves, place = distinct_parts(x[:, a:z])
                entry, apart = nearest(leaves, book)
                codes.append(entry[place])
                error += apart[place]
            hexes = ["".join(f"{e:02x}" for e in row) for row in zip(*(c.tolist() for c in codes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexes, pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector has no null or non-finite component."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))


def integers(rows: DataFrame, length: int, scale: int) -> DataFrame:
    """(vec_id, label, x) of the vectors of this length, in integer components."""
    edge = float(component_bound(length))
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-edge)), F.lit(edge))).cast("long"))
    return rows.where(F.size("v") == length).select("vec_id", "label", x.alias("x"))


def distinct_part_rows(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """(part, x, n): every distinct part of a position and the number of vectors that hold it, in lexicographic ranges."""
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.slice("x", a + 1, z - a).alias("x"))
                      for p, (a, z) in enumerate(zip(cuts, cuts[1:]))))
    counted = rows.select(F.explode(parts).alias("p")).groupBy("p.part", "p.x").agg(F.count(F.lit(1)).alias("n"))
    return counted.repartitionByRange("part", "x").sortWithinPartitions("part", "x")


def train(parts: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` of assigning all parts and moving the used entries to floor(sum / count)."""
    for _ in range(rounds):
        sums = parts.mapInArrow(sum_parts(books), "part int, entry int, pos int, s long").groupBy("part", "entry", "pos") \
            .agg(F.sum("s").alias("s")).where("s <> 0").collect()
        total = [np.zeros((len(b), b.shape[1] + 1), "i8") for b in books]
        for r in sums:
            total[r["part"]][r["entry"], r["pos"]] = r["s"]
        books = [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), b) for t, b in zip(total, books)]
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks by part (int64, entries x part length)."""
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    order = [F.asc_nulls_last("vec_id"), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    length = len(first[0]["v"]) if first else 0
    rows, cuts = integers(rows, length, scale), part_cuts(length, parts)
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    start = np.array([r["x"] for r in head], "i8").reshape(len(head), length)
    books = [start[:, a:z] for a, z in zip(cuts, cuts[1:])]
    if len(head):
        books = train(stage(distinct_part_rows(rows, cuts), "distinct-parts"), books, rounds)
    kind = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return rows.mapInArrow(code_rows(books, cuts), kind), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of ``error`` over equal labels, null labels together.

    The sums are staged, so that Spark joins them by their measured size; AQE splits a hot label.
    """
    coded = stage(coded, "codes")
    sums = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error",
                                           F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Every round as two views: the nearest entry of each part (exact integers in doubles), then the moved entries."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, [floor(c::DOUBLE * {SCALE}) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = len(embedding)),
p AS MATERIALIZED (
  SELECT vec_id, label, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x
  FROM v, range({PARTS}) AS r(part)),
b0 AS MATERIALIZED (
  SELECT part, rank() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min(struct_pack(
    d := list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), e := b.entry)) AS near
  FROM p JOIN b{i} b USING (part) GROUP BY ALL)""")
        if i < ROUNDS:
            steps.append(f"""
b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT part, entry, list(c ORDER BY pos) AS x FROM (
      SELECT part, near.e AS entry, pos, floor(sum(x[pos]) / count(*)) AS c
      FROM a{i}, range(1, 65) AS r(pos) WHERE pos <= len(x) GROUP BY ALL)
    GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)""")
    last = ROUNDS
    steps.append(f"""
coded AS MATERIALIZED (
  SELECT vec_id, label, string_agg(lower(lpad(to_hex(near.e), 2, '0')), '' ORDER BY part) AS code,
         sum(near.d)::BIGINT AS error
  FROM a{last} GROUP BY ALL)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos))
        FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS pos FROM b{last})) AS codebooks_sha256
FROM coded
"""


ORACLE_SQL = _oracle()
