"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. *Codes.* On a bounded sample (``sample`` vectors, those with the smallest hash of their id) the
   directions of the data are found and a rotation is learnt that brings them near the corners of a
   cube, so that signs make balanced binary codes of 64 bits. Every vector is coded.
2. *Tables.* A code is four words of 16 bits. Two vectors are candidates in a table when their
   words there differ in at most one bit; any two codes within seven bits meet in some table.
3. *Rerank.* Candidates with equal labels are compared by cosine in double precision on the original
   vectors. A pair that meets in several tables counts in the first only.

Equal vectors of one label are one class with a count, so copies are never paired. Small buckets
share a bin. A bin is dealt to blocks, and its queries to lanes, by its size; a task compares one
block with one lane, sums links per query and passes on a spanning forest of its links, never the
pairs. Vectors that are null, zero, or hold null or non-finite components, and
rows without a label, link with nothing. Labels may be of any type. Rows that share a vec_id are vectors of
their own; rows with a null vec_id are left out, other columns are ignored. No vectors: no rows. Only vectors of the table's most usual length are coded;
others are compared within their own length and label exactly, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.links import components
from chronofold.llm.tables import written

SAMPLE = 20_000
WORDS, WORD_BITS = 4, 16
ROTATIONS = 50
#: Vectors of a bin in a block, and queries in a lane; buckets up to SHARED share a bin.
BLOCK, LANE, SHARED = 1024, 2048, 128

#: ``vec_id`` is the number of a class here and in all steps up to the last.
_CODED = "vec_id long, {label}, dims int, weight long, unit array<double>, code array<int>"


def learn(sample: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """(dimensions, bits) matrix whose signs are the code: principal directions and a rotation
    found by iterative quantisation. Fewer directions than bits are filled up by random mixes."""
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(sample.T @ sample / max(len(sample), 1))
    base = vectors[:, np.argsort(-values, kind="stable")[:bits]]
    if base.shape[1] < bits:
        mixes, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        base = base @ mixes[: base.shape[1], :]
    projected = sample @ base
    rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(ROTATIONS):
        corners = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(corners.T @ projected)
        rotation = (u @ vt).T
    return base @ rotation


def _coded(matrix: np.ndarray | None):
    """Unit vectors and code words; vectors of another length have no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, codes, dims = [], [], []
            for vector in batch.column("embedding"):
                v = np.asarray(vector.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                v = v / np.abs(v).max()  # keeps the norm finite
                v = v / np.sqrt((v * v).sum())
                units.append(v)
                dims.append(len(v))
                if matrix is None or len(v) != len(matrix):
                    codes.append(None)
                else:
                    bit = (v @ matrix >= 0).reshape(WORDS, WORD_BITS)
                    codes.append((bit @ (1 << np.arange(WORD_BITS))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array(dims, pa.int32()),
                    batch.column("weight"),
                    pa.array(units, pa.list_(pa.float64())),
                    pa.array(codes, pa.list_(pa.int32())),
                ],
                ["vec_id", "label", "dims", "weight", "unit", "code"],
            )

    return run


def _marked(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` (doubles), and whether the row can link."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    links = F.col("label").isNotNull() & finite & F.exists(values, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        values.alias("embedding"),
        F.coalesce(links, F.lit(False)).alias("links"),
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links a-b: each node with the smallest that its links lead to."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words differ in at most one bit."""
    x = a ^ b
    return (x & (x - 1)) == 0


def _compare(threshold: float):
    """One lane of queries against one block of a bin: links per query, and a forest."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        nodes = counts = others = np.zeros(0, dtype=np.int64)
        if queries.num_rows and members.num_rows:
            ids, names = (x.column("vec_id").to_numpy() for x in (queries, members))
            asked, held = (x.column("bucket").to_numpy() for x in (queries, members))
            own, theirs = _words(queries), _words(members)
            table = queries.column("t").to_numpy()
            weight = members.column("weight").to_numpy()
            total = np.zeros(len(ids), dtype=np.int64)
            forest = (nodes, nodes)
            lefts, rights = _matrix(queries, "unit"), _matrix(members, "unit")
            width = min(lefts.shape[1], rights.shape[1])
            lefts, rights = lefts[:, :width], rights[:, :width]  # compared ones fit in both
            for lo in range(0, len(ids), 256):
                part = slice(lo, lo + 256)
                hit = (asked[part, None] == held) & (ids[part, None] != names)
                for earlier in range(int(table[part].max())):
                    met = _near(own[part, None, earlier], theirs[None, :, earlier])
                    hit &= ~(met & (table[part, None] > earlier))
                q, m = np.nonzero(hit)
                if not len(q):
                    continue
                # the shared bins hold many buckets, so few of their pairs are candidates
                left, right = lefts[part], rights
                for at in range(0, len(q), 1 << 16):
                    x, y = q[at : at + (1 << 16)], m[at : at + (1 << 16)]
                    linked = np.einsum("ij,ij->i", left[x], right[y]) >= threshold
                    x, y = x[linked], y[linked]
                    np.add.at(total, lo + x, weight[y])
                    forest = _forest(
                        np.concatenate([forest[0], ids[part][x]]),
                        np.concatenate([forest[1], names[y]]),
                    )
            some = np.flatnonzero(total)
            nodes = np.concatenate([ids[some], forest[0]])
            counts = np.concatenate([total[some], np.zeros(len(forest[0]), dtype=np.int64)])
            others = np.concatenate([ids[some], forest[1]])
        return pa.table({"vec_id": nodes, "links": counts, "other": others})

    return run


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """Vectors as rows, filled up with zeros; only those of one length are ever compared."""
    column = table.column(name).combine_chunks()
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(length.max())))
    out[np.arange(out.shape[1]) < length[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _words(table: pa.Table) -> np.ndarray:
    """Code words; those of vectors without a code are never looked at."""
    column = table.column("code").combine_chunks()
    out = np.zeros((len(column), WORDS), dtype=np.int32)
    coded = column.is_valid().to_numpy(zero_copy_only=False)
    out[coded] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
    return out


def _linked(coded: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, links, other): link counts, and links that connect what is linked."""
    # a bucket is (label, table, word); vectors without a code share one bucket a length: table -1
    tables = F.when(
        F.col("code").isNull(), F.array(F.struct(F.lit(-1).alias("t"), F.col("dims").alias("w")))
    ).otherwise(
        F.transform("code", lambda w, t: F.struct(t.cast("int").alias("t"), w.alias("w")))
    )
    held = coded.withColumn("at", F.explode(tables)).select(
        "label", F.col("at.t").alias("t"), F.col("at.w").alias("w"), "vec_id", "weight"
    )
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(WORD_BITS)])
    asking = held.withColumn("flip", F.explode(F.when(F.col("t") < 0, F.array(F.lit(0))).otherwise(flips)))
    asking = asking.select("label", "t", F.col("w").bitwiseXOR(F.col("flip")).alias("w"), "vec_id")
    name = F.xxhash64("label", "t", "w").alias("bucket")
    held = held.select("t", name, "vec_id", "weight")
    asking = asking.select("t", name, "vec_id")
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n"))
    asked = asking.groupBy("bucket").agg(F.count("*").alias("q"))
    buckets = written(sizes.join(asked, "bucket").where("n > 1 or q > 1"), "buckets")
    rows = buckets.where(F.col("n") <= SHARED).agg(F.sum("n")).first()[0] or 0
    shared = F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(1 + rows // SHARED))
    alone = F.col("n") > SHARED
    buckets = buckets.withColumns(
        {"alone": alone, "bin": F.when(alone, F.col("bucket")).otherwise(shared)}
    )
    load = buckets.groupBy("alone", "bin").agg(
        F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"),
        F.ceil(F.sum("q") / LANE).cast("long").alias("lanes"),
    )
    place = buckets.join(load, ["alone", "bin"]).select("bucket", "alone", "bin", "blocks", "lanes")
    place = written(place, "bins")
    zero = F.lit(0).cast("long")
    units = coded.select("vec_id", "unit", "code")
    key = ["alone", "bin", "block", "lane"]
    queries = (
        asking.join(place, "bucket")
        .withColumn("lane", F.pmod(F.xxhash64("vec_id"), F.col("lanes")))
        .withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .join(units, "vec_id")
        .select(*key, "bucket", "t", "vec_id", "unit", "code")
    )
    members = (
        held.join(place, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        .withColumn("lane", F.explode(F.sequence(zero, F.col("lanes") - 1)))
        .join(units, "vec_id")
        .select(*key, "bucket", "vec_id", "weight", "unit", "code")
        .toDF(*key, "bucket", "vec_id", "weight", "unit", "code")
    )
    return queries.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(
        _compare(threshold), "vec_id long, links long, other long"
    )


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    marked = _marked(vectors)
    usable = marked.where("links").drop("links")
    classes = usable.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight")
    )
    # numbers that the written table keeps; two vectors may share a vec_id
    classes = classes.withColumn("vec_id", F.monotonically_increasing_id())
    classes = written(classes, "vectors")
    usual = classes.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    matrix = None
    if usual is not None:
        chosen = (
            classes.where(F.size("embedding") == usual["n"])
            .orderBy(F.xxhash64("least"), "least", F.xxhash64("embedding"))
            .limit(sample)
            .select("embedding")
            .toPandas()  # at most ``sample`` rows
        )
        rows = np.array(chosen["embedding"].tolist(), dtype=np.float64)
        rows /= np.abs(rows).max(axis=1, keepdims=True)
        matrix = learn(rows / np.linalg.norm(rows, axis=1, keepdims=True), WORDS * WORD_BITS)
    label = classes.schema["label"].dataType.simpleString()
    schema = _CODED.format(label=f"label {label}")
    coded = written(classes.drop("least").mapInArrow(_coded(matrix), schema), "codes")
    linked = written(_linked(coded, threshold), "linked")
    counts = linked.groupBy("vec_id").agg(F.sum("links").alias("links"))
    ties = linked.where(F.col("vec_id") != F.col("other"))
    roots = components(ties.select(F.col("vec_id").alias("a"), F.col("other").alias("b")), "vectors")
    known = (
        classes.join(counts, "vec_id", "left")
        .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "label",
            "embedding",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "vec_id").alias("root"),
        )
    )
    known = written(known, "known")
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(lowest, "root").select("label", "embedding", "n_links", "component_id")
    own = usable.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = marked.where("not links").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return own.unionByName(rest).select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        (F.col("vec_id") == F.col("component_id")).alias("kept"),
    )
