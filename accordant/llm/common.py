"""What the operators share: reading tables, the shared scratch folder, leading decisions back to rows, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.scratch import materialise, scratch, share, shared_folder  # noqa: F401

#: Most edges that one task joins up in memory (16 bytes each).
EDGES_PER_TASK = 1_000_000
#: A key that this share of all rows or more have is matched by a broadcast: there can be at most so many such keys.
FREQUENT = 10_000
#: 64-bit words of a bitmap in every task: a bit in 16 set, up to 32 MB.
FEW_WORDS, MOST_WORDS = 1 << 14, 1 << 22
#: Bytes of an Arrow batch: Spark's own bound is 64 MB, in the JVM and in the Python worker of every task.
BATCH_BYTES = 4 << 20
#: 64-bit words of the bitmap that tells which rows may be dropped: a broadcast of at most so many rows.
MAP_WORDS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bytes of an Arrow batch to BATCH_BYTES, unless it is set to less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch("([0-9]+)b?", spark.conf.get(name))
    if not held or int(held[1]) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(_id, _h, _g): a row by its id and 128 bits of hash of its text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_h"), F.xxhash64(F.lit("text"), text).alias("_g")]


def keep_marked(documents: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents that are marked to stay, with all their columns.

    marked: (_id, _h, _g, kept), one row per row of documents.  Of rows equal in id and text as many stay as are marked.

    Texts stay where they are: a bitmap of MAP_WORDS words, put together in Spark, tells in the scan which rows may
    have been dropped; only these few meet their marks in a join.  A full bitmap costs time, not results.
    """
    word = F.pmod(F.shiftrightunsigned("_h", 6), F.lit(MAP_WORDS)).cast("int")
    bit = F.expr("shiftleft(1L, cast(_h & 63 AS int))")
    bits = materialise(marked.filter("NOT kept").groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")), "dropped")
    carried = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), *row_key(id_col, text_col))

    def doubtful(rows: DataFrame) -> DataFrame:
        held = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
        return held.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")

    sure = doubtful(carried).filter("NOT _maybe").select("_row.*")
    marks = doubtful(marked).filter("_maybe").groupBy("_id", "_h", "_g").agg(F.count_if("kept").alias("_stay"), F.count("*").alias("_all"))
    marks = marks.filter("_stay > 0").select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), F.col("_g").alias("_g2"), "_stay", "_all")
    rest = doubtful(carried).filter("_maybe")
    rest = rest.join(marks, same(rest, marks, {"_h": "_h2", "_g": "_g2", "_id": "_id2"}))
    place = F.row_number().over(Window.partitionBy("_id", "_h", "_g").orderBy("_h"))
    return sure.unionByName(rest.withColumn("_place", place).filter("_stay = _all OR _place <= _stay").select("_row.*"))


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]):
    """Null-safe equality on pairs of columns, as a join condition."""
    condition = F.lit(True)
    for a, b in pairs.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits at the hashes h: the words are put together in Spark, so what is collected has a fixed bound."""
    size, n = FEW_WORDS, hashes.count()
    while size < MOST_WORDS and 64 * size < 16 * n:
        size *= 2
    word = F.pmod(F.shiftrightunsigned("h", 6), F.lit(size)).alias("word")
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    rows = hashes.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    h, words = hashes.view(np.uint64), bits.view(np.uint64)
    return (words[(h >> np.uint64(6)) % np.uint64(len(words))] >> (h & np.uint64(63))) & np.uint64(1) > 0


def meet(rows: DataFrame, keyed: DataFrame, keys: list[str], copies: str = "copies", most: int = FREQUENT) -> DataFrame:
    """Rows with what `keyed`, one row a key, says of them; `copies`: how many of the rows have the key.  Both are read twice.

    Keys of very many rows would meet all of them in one task: they are matched by a broadcast instead, of at most
    `most` keys by the share of the rows that each must have.
    """
    total = keyed.agg(F.sum(copies)).first()[0] or 0
    often = F.col(copies) * most >= total
    first = rows.join(F.broadcast(keyed.filter(often)), keys, "left")
    rest = first.filter(F.col(copies).isNull()).select(*rows.columns).join(keyed.filter(~often), keys)
    return first.filter(F.col(copies).isNotNull()).unionByName(rest)


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each is linked with (union by minimum, path halving)."""
    nodes, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    n = len(src)
    for a, b in zip(flat[:n].tolist(), flat[n:].tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return nodes, nodes[[root(v) for v in range(len(nodes))]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if held:
        both = pd.concat(held)
        node, root = forest(both["src"].to_numpy(), both["dst"].to_numpy())
        yield pd.DataFrame({"src": node, "dst": root})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (src, dst): root is the component's smallest node.

    Tasks of at most EDGES_PER_TASK edges contract theirs to a forest.  If one task held all of them this
    is the answer; else large-star and small-star rounds (Kiveris et al., 2014) finish it on the forests,
    each round written to the shared folder.
    """
    edges = materialise(edges.select("src", "dst"), "edges")
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))
    edges = materialise(edges.repartition(tasks).mapInPandas(_contract, "src long, dst long"), "forest")
    if tasks > 1:
        nodes = edges
        before = None
        edges = edges.filter("src != dst")
        while True:
            both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            low = both.groupBy("src").agg(F.min("dst").alias("low"))
            large = (
                both.join(low, "src")
                .filter("dst > src")
                .select(F.col("dst").alias("src"), F.least("low", "src").alias("dst"))
                .filter("src != dst")
                .distinct()
            )
            down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
            low = down.groupBy("src").agg(F.min("dst").alias("low"))
            small = (
                down.join(low, "src")
                .select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst"))
                .filter("src != dst")
                .distinct()
            )
            edges = materialise(small, "star")
            mark = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
            if mark == before:
                break
            before = mark
        edges = nodes.select(F.col("src")).union(nodes.select(F.col("dst"))).distinct().join(edges, "src", "left").select("src", F.coalesce("dst", "src").alias("dst"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
