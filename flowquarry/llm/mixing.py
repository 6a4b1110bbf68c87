"""Mixes sources to target shares of the corpus size, in tokens, and deals the mix out to shards.

Documents of a source are hashed to blocks, so a block is a random draw of its documents; the number of blocks follows the number of shards. A source's
quota is its share of the corpus size, at most ``max_repeats`` times what it has. It is met by whole passes over its blocks
and by a last pass over blocks in permuted order; the block in which the quota ends is cut between two documents.

A block of a pass is a draw. Draws are dealt to the output shards by a tree: each node splits its draws, with the multivariate hypergeometric
distribution, into those of its left and right half of shards, so each shard gets an exact number of each source's draws, as in a fair shuffle of all of them.
The generator of a node is seeded by its shards, so every node can be drawn apart from the others: the driver draws the top of the tree down to about
``GROUPS`` groups of shards, the executors the rest. A shard then takes consecutive draws of each source's permuted order, without overlap, and is shuffled by itself.

The driver holds the targets, ``PIECES`` sums a source, and at most twice ``GROUPS`` nodes of the tree, whatever the corpus; blocks and draws stay on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks that the corpus has for each shard, and that a source has at least.
BLOCKS_A_SHARD, MIN_BLOCKS = 64, 64
GROUPS, PIECES = 1024, 256
#: Bound of the targets, which the driver holds; more raise.
MAX_SOURCES = 1000
SHARD_TOKENS = 64_000_000


def source_name(c: Column | str) -> Column:
    """A source trimmed, in lower case, with blanks and hyphens as ``_``; blank gives null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n"))), r"[ \-]", "_"), F.lit(""))


@dataclass
class Source:
    name: str
    share: float
    max_repeats: int
    available: int = 0  # tokens
    docs: int = 0
    blocks: int = 1  # a power of two
    passes: int = 0  # whole passes over all blocks
    tail: int = 0  # blocks of the last pass that are taken whole
    cut: int = 0  # tokens to take of the block after them

    @property
    def draws(self) -> int:
        return self.passes * self.blocks + self.tail + (self.cut > 0)


@dataclass
class Plan:
    corpus: int
    sources: list[Source]
    shards: int
    seed: int


def quota(s: Source, corpus: int) -> int:
    """Tokens the mix should hold of a source."""
    return max(0, min(math.ceil(s.share * corpus), s.available * s.max_repeats))


def n_blocks(available: int, docs: int, corpus: int, shards: int) -> int:
    """A power of two: a source's part of ``BLOCKS_A_SHARD`` blocks a shard, but not more than it has documents."""
    want = max(MIN_BLOCKS, math.ceil(BLOCKS_A_SHARD * shards * available / max(1, corpus)))
    return 1 << max(0, min((want - 1).bit_length(), max(1, docs).bit_length() - 1))


def leaves(lo: int, hi: int, counts: np.ndarray, starts: np.ndarray, seed: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, counts, starts) of the nodes below a node that hold at most ``most`` shards: how many draws of each source, and the first one's place."""
    stack = [(lo, hi, counts, starts)]
    while stack:
        lo, hi, c, at = stack.pop()
        if hi - lo <= most:
            yield lo, hi, c, at
            continue
        mid = (lo + hi) // 2
        total = int(c.sum())
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(c, total * (mid - lo) // (hi - lo)) if total else c
        stack += [(mid, hi, c - left, at + left), (lo, mid, left, at)]


def _source_rows(sized: DataFrame, sources: list[Source], names: str, values: list[tuple]) -> DataFrame:
    """A small table of a row a source, at most ``MAX_SOURCES``, as a broadcast side."""
    return F.broadcast(sized.sparkSession.createDataFrame([(s.name, *v) for s, v in zip(sources, values, strict=True)], f"source string, {names}"))


def _block(seed: int) -> Column:
    return F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.col("blocks") - 1)


def _place(copy: Column, seed: int) -> Column:
    """The place of ``block`` in the permuted order of pass ``copy``: an odd factor and a shift permute the numbers below a power of two."""
    h = F.xxhash64("source", copy, F.lit(seed))
    odd = F.shiftright(h, 20).bitwiseAND(F.lit((1 << 31) - 1)).bitwiseOR(F.lit(1))
    return (F.col("block") * odd + F.shiftrightunsigned(h, 40)).bitwiseAND(F.col("blocks") - 1)


def _find_tails(docs: DataFrame, sources: list[Source], want: list[int], seed: int) -> None:
    """Sets tail and cut of each source: where the running sum over the last pass' places reaches what is wanted.

    All sources go down together, by a factor of ``PIECES`` each round, to the one block, so only ``PIECES`` sums a source are read at a time.
    """
    at, width, left = [0] * len(sources), [s.blocks for s in sources], list(want)
    going = [w > 0 for w in want]
    number = {s.name: i for i, s in enumerate(sources)}
    while any(going):
        piece = [max(1, w // PIECES) for w in width]
        live = [i for i in range(len(sources)) if going[i]]
        rows = _source_rows(docs, [sources[i] for i in live], "blocks bigint, passes int, lo bigint, width bigint, piece bigint", [(sources[i].blocks, sources[i].passes, at[i], width[i], piece[i]) for i in live])
        placed = docs.join(rows, "source").withColumn("block", _block(seed)).withColumn("place", _place(F.col("passes"), seed))
        inside = placed.filter((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + F.col("width")))
        sums: dict[int, dict[int, int]] = {i: {} for i in live}
        for r in inside.groupBy("source", F.floor((F.col("place") - F.col("lo")) / F.col("piece")).alias("k")).agg(F.sum("n_tokens").alias("n")).collect():
            sums[number[r["source"]]][r["k"]] = r["n"]
        for i in live:
            for k in sorted(sums[i]):
                if left[i] <= sums[i][k]:
                    break
                left[i] -= sums[i][k]
            at[i] += k * piece[i]
            width[i] = piece[i]
            if piece[i] == 1:
                going[i] = False
                full = left[i] == sums[i][k]
                sources[i].tail, sources[i].cut = at[i] + full, 0 if full else left[i]


def plan(sized: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 0) -> Plan:
    """The plan of a mix. ``sized`` has doc_id, source (as ``source_name`` gives it) and n_tokens; ``targets`` has source, target_share, max_repeats.

    Sources of the targets without documents have nothing to give; documents of other sources, or of none, count in the corpus size
    only. Without ``shards`` there are eight, or one for each ``SHARD_TOKENS`` of the corpus. Targets with a null share or null or negative repeats count as 0.
    Duplicate targets, and more than ``MAX_SOURCES``, raise.
    """
    wanted = [Source(r[0], float(r[1] or 0.0), max(0, int(r[2] or 0))) for r in targets.select(source_name("source"), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()]
    by = {s.name: s for s in wanted}
    if len(wanted) > MAX_SOURCES or len(by) < len(wanted):
        raise ValueError(f"targets must name at most {MAX_SOURCES} different sources")
    known = F.when(F.col("source").isin([n for n in by if n is not None]), F.col("source"))
    corpus = 0
    for r in sized.groupBy(known.alias("source")).agg(F.sum("n_tokens").alias("n"), F.count_if(F.col("n_tokens") > 0).alias("docs")).collect():
        corpus += r["n"] or 0
        if r["source"] is not None:
            by[r["source"]].available, by[r["source"]].docs = r["n"], r["docs"]
    shards = shards or max(8, corpus // SHARD_TOKENS)
    want = []
    for s in wanted:
        s.blocks = n_blocks(s.available, s.docs, corpus, shards)
        q = quota(s, corpus)
        s.passes = q // s.available if s.available else 0
        want.append(q - s.passes * s.available)
    _find_tails(sized.filter("n_tokens > 0").select("doc_id", "source", "n_tokens"), wanted, want, seed)
    return Plan(corpus, wanted, shards, seed)


def deals(spark, p: Plan) -> DataFrame:
    """(source, rank, shard) of all draws. The driver gives the top of the tree, tasks expand the groups of shards."""
    counts = np.array([s.draws for s in p.sources], np.int64)
    top = [(lo, hi, c.tolist(), at.tolist()) for lo, hi, c, at in leaves(0, p.shards, counts, np.zeros_like(counts), p.seed, -(-p.shards // GROUPS))]
    groups = spark.createDataFrame(top, "lo bigint, hi bigint, counts array<bigint>, starts array<bigint>")
    names, seed = [s.name for s in p.sources], p.seed

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo, hi, c, at in zip(pdf["lo"], pdf["hi"], pdf["counts"], pdf["starts"], strict=True):
                rows = [(names[k], shard, first[k], n[k]) for shard, _, n, first in leaves(int(lo), int(hi), np.array(c, np.int64), np.array(at, np.int64), seed, 1) for k in np.flatnonzero(n)]
                yield pd.DataFrame(rows, columns=["source", "shard", "first", "n"])

    parts = min(len(top), spark.sparkContext.defaultParallelism * 2)
    ranges = groups.repartition(parts).mapInPandas(expand, "source string, shard bigint, first bigint, n bigint")
    return ranges.select("source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"), "shard")


def mix(sized: DataFrame, p: Plan) -> DataFrame:
    """(shard, position, source, doc_id, copy, n_tokens): the documents of the mix, each shard in its own shuffled order.

    A quota that ends within a block takes documents in a seeded order until it is reached, so it is exceeded by less than one document. Documents of null source
    or without tokens are in no mix. Documents meet their draws by (source, rank), a key that holds one block; Spark broadcasts the draws where they are few.
    """
    used = [s for s in p.sources if s.draws and s.name is not None]
    src = _source_rows(sized, used, "blocks bigint, passes int, tail bigint, cut bigint", [(s.blocks, s.passes, s.tail, s.cut) for s in used])
    docs = sized.filter("n_tokens > 0").select("doc_id", "source", "n_tokens").join(src, "source").withColumn("block", _block(p.seed))
    each = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes")))).withColumn("place", _place(F.col("copy"), p.seed))
    whole = (F.col("copy") < F.col("passes")) | (F.col("place") < F.col("tail"))
    at_cut = (F.col("copy") == F.col("passes")) & (F.col("place") == F.col("tail")) & (F.col("cut") > 0)
    columns = ["source", (F.col("copy") * F.col("blocks") + F.col("place")).alias("rank"), "doc_id", "copy", "n_tokens"]
    w = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", "copy", F.lit(p.seed)), "doc_id")  # one block of each source
    before = F.sum("n_tokens").over(w) - F.col("n_tokens")
    part = each.filter(at_cut).withColumn("before", before).filter("before < cut").select(*columns)
    rows = each.filter(whole).select(*columns).unionByName(part).join(deals(sized.sparkSession, p), ["source", "rank"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(p.seed + 1)), "doc_id", "copy")
    return rows.select("shard", F.row_number().over(order).alias("position"), "source", "doc_id", "copy", "n_tokens")


def write_mix(mixed: DataFrame, corpus: DataFrame, path: str, shards: int) -> None:
    """Writes the mix with the corpus' columns, a folder for each shard, in the order of ``position``."""
    full = mixed.join(corpus.drop("source", "n_tokens", "shard", "position", "copy"), "doc_id")
    full.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)


def report(mixed: DataFrame, p: Plan) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, target_tokens, mixed_tokens, reached_share, is_short): shares as they came out.

    A source is short if the mix, with every text used max_repeats times, holds less of it than its share of the corpus size.
    """
    rows = [(s.name, s.share, s.max_repeats, s.available, s.share * p.corpus) for s in p.sources]
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    out = mixed.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens bigint, target_tokens double")
    out = out.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # a row a source
    return out.withColumn("reached_share", F.round(F.col("mixed_tokens") / F.when(total > 0, total), 6)).withColumn("is_short", F.col("mixed_tokens") < F.col("target_tokens"))
