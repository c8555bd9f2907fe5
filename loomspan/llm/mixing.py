"""Sources mixed to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.session import materialize

#: The public tokenizer in whose tokens sizes are measured.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents of one source in a shard, about; a shard is what one task orders.
SHARD_ROWS = 200_000
#: Blocks that the source with the least target is made of, and an average shard of any source, at least.
LEAST_BLOCKS, SHARD_BLOCKS = 2_000, 128
#: Groups that the shards of a source fall into; seats are dealt to groups first, then within each.
GROUPS = 256
#: Rows up to which a table of targets, or of groups of shards, is broadcast.
BROADCAST_ROWS = 200_000


def source_name(source: Column) -> Column:
    """A source's name in one spelling: small letters, underscores for spaces and hyphens, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"(?U)^[\s_-]+|[\s_-]+$", ""), r"(?U)[\s_-]+", "_")


def count_tokens(df: DataFrame, *, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with tokens: the number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        encode = getattr(model, "encode_batch_fast", model.encode_batch)  # without offsets, where it is offered
        for texts in parts:
            lengths = []
            for at in range(0, len(texts), 256):
                some = [t or "" for t in texts.iloc[at : at + 256]]
                lengths += [len(e) for e in encode(some, add_special_tokens=False)]
            yield pd.Series(lengths, dtype="int64")

    return df.withColumn("tokens", tokens(F.col(text))).drop(text)


def sainte_lague(weights: Mapping[object, float], seats: int, caps: Mapping[object, int]) -> dict[object, int]:
    """Seats by the highest quotients weight / (2 n + 1); a key that has reached its cap gets no more.

    Ties go to the lesser key. Keys without weight get none; seats that no key
    can take are left over. Rounding the weights by their common divisor comes
    within a few seats of the result, so only these are dealt one by one, and
    the work does not grow with the seats.
    """
    given = {k: 0 for k in weights}
    live = {k: w for k, w in weights.items() if w > 0 and caps[k] > 0}
    seats = min(seats, sum(caps[k] for k in live))
    while live and (full := [k for k, w in live.items() if w * seats > (caps[k] + len(live)) * sum(live.values())]):  # sure to reach their caps
        for k in full:
            given[k] = caps[k]
            seats -= caps[k]
            del live[k]
    if not live or seats <= 0:
        return given
    whole = sum(live.values())
    for k, w in live.items():  # never more than the quotients give
        given[k] = min(caps[k], max(0, int(w * seats / whole) - len(live) - 1))
    left = seats - sum(given[k] for k in live)
    heap = [(-w / (2 * given[k] + 1), str(k), k) for k, w in live.items() if given[k] < caps[k]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, name, k = heapq.heappop(heap)
        given[k] += 1
        left -= 1
        if given[k] < caps[k]:
            heapq.heappush(heap, (-live[k] / (2 * given[k] + 1), name, k))
    return given


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many rows, marked for broadcast if they are no more than BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def block_size(have: Mapping[str, int], shards: Mapping[str, int], targets: Mapping[str, tuple[float, int]], total: int | None = None) -> tuple[int, int]:
    """(tokens of a block, blocks of the whole mix), from the tokens and the shards of each source.

    Without ``total`` the mix is as large as the targets' proportions and the
    most repeats allow. A block is small against what the least source gives and
    against every source's shards, whatever the size of the corpus.
    """
    live = {s: share for s, (share, most) in targets.items() if have.get(s, 0) > 0 and share > 0 and most > 0}
    if not live:
        return 1, 0
    weight = sum(live.values())
    size = min(have[s] * targets[s][1] * weight / share for s, share in live.items()) if total is None else total
    block = min(min(size * share / weight / LEAST_BLOCKS, have[s] / shards[s] / SHARD_BLOCKS) for s, share in live.items())
    block = max(1, round(block))
    return block, max(1, int(size // block))


def shard_quotas(sizes: DataFrame, targets: Mapping[str, tuple[float, int]], *, total: int | None = None) -> DataFrame:
    """source, shard, in_shard (tokens), give (tokens), most, block: what each shard gives.

    ``sizes``: source, shard, tokens. Blocks are dealt by Sainte-Laguë quotients
    three times: to the sources by their shares, to the groups of a source's
    shards and to the shards of a group by their tokens. Sources and groups
    (at most targets x GROUPS rows) are dealt on the driver; the shards, however
    many, where they are.
    """
    spark = sizes.sparkSession
    grouped = sizes.withColumn("group", F.pmod("shard", F.lit(GROUPS)))
    summed = grouped.groupBy("source", "group").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("shards")).collect()
    have, shards = {}, {}
    for r in summed:
        have[r.source] = have.get(r.source, 0) + r.tokens
        shards[r.source] = shards.get(r.source, 0) + r.shards
    block, seats = block_size(have, shards, targets, total)
    most = {s: m for s, (_, m) in targets.items()}
    room = lambda tokens, s: -(-tokens * most[s] // block)
    rooms = {s: room(n, s) + shards[s] for s, n in have.items() if s in targets}
    by_source = sainte_lague({s: targets[s][0] for s in rooms}, seats, rooms)
    given = []
    for s, n in by_source.items():
        own = {r.group: (float(r.tokens), r.shards) for r in summed if r.source == s}
        dealt = sainte_lague({g: t for g, (t, _) in own.items()}, n, {g: room(int(t), s) + k for g, (t, k) in own.items()})
        given += [(s, g, k, block, most[s]) for g, k in dealt.items() if k]
    plan = _small(spark.createDataFrame(given, "source string, group int, seats long, block long, most int"), len(given))
    whole = Window.partitionBy("source", "group")
    exact = F.col("tokens") * F.col("seats") / F.sum("tokens").over(whole)
    both = grouped.join(plan, ["source", "group"]).withColumn("base", F.floor(exact + 0.5))
    both = both.withColumn("short", F.col("seats") - F.sum("base").over(whole))
    quotient = F.when(F.col("short") > 0, -F.col("tokens") / (2 * F.col("base") + 1)).otherwise(F.when(F.col("base") > 0, F.col("tokens") / (2 * F.col("base") - 1)))
    place = F.row_number().over(whole.orderBy(quotient.asc_nulls_last(), "shard"))
    settled = F.col("base") + F.when(place <= F.abs("short"), F.signum("short")).otherwise(0).cast("long")
    give = F.least(settled * F.col("block"), F.col("tokens") * F.col("most"))
    return both.select("source", "shard", F.col("tokens").alias("in_shard"), give.alias("give"), "most", "block").filter("give > 0")


def mix(documents: DataFrame, targets: DataFrame, *, seed: int = 42, tokenizer: str = TOKENIZER, shard_rows: int = SHARD_ROWS, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection and the shares reached.

    ``documents``: doc_id, source, text; ``targets``: source, target_share,
    max_repeats. The first result has doc_id, source, tokens and copies (1 to
    max_repeats) of the chosen documents. The second has a row for each target:
    target_share, reachable_share (0 for a source without documents, the others
    in proportion), documents, available_tokens, selected_tokens, actual_share,
    most_copies.

    A source has as many shards as its documents ask for. Documents of a shard
    are put in seeded order and laid on a ring of its tokens, cut into blocks of
    equal tokens. Sainte-Laguë quotients give each source its blocks, and each
    shard its part of them (shard_quotas). A shard gives its blocks in whole
    rounds, then consecutive ones from a seeded block on, so each shard meets its
    quota to within a document, and a source its share to within a block.

    Source names are compared in one spelling (source_name). Documents without
    target or tokens aren't chosen; a repeated doc_id within a source counts
    once; a target listed twice counts with its greatest share. Null ids or sources are left
    out; no documents give an empty selection and shares of 0; other columns
    are ignored.

    The texts are read once and never shuffled; (id, tokens) is shuffled once,
    by source and shard. The targets and GROUPS sums a target come to the
    driver; the table of shards does not.
    """
    spark = documents.sparkSession
    wanted = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").collect():
        if r.s is not None and r.target_share is not None:
            wanted[r.s] = max(wanted.get(r.s, (0.0, 0)), (float(r.target_share), int(r.max_repeats if r.max_repeats is not None else 1)))
    names = _small(spark.createDataFrame([(s,) for s in wanted], "source string"), len(wanted))
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).join(names, "source", "left_semi")
    sized = materialize(count_tokens(rows, text="text", tokenizer=tokenizer)).filter(F.col("tokens") > 0)  # a filter before would count twice
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.ceil(F.col("n") / F.lit(shard_rows)))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n")).cast("int")
    mine = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    placed = sized.join(_small(counts, len(wanted)), "source").withColumn("shard", shard).drop("n")
    once = placed.withColumn("again", F.coalesce(F.lag("doc_id").over(mine) == F.col("doc_id"), F.lit(False))).filter(~F.col("again")).drop("again")
    before = F.coalesce(F.sum("tokens").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ringed = materialize(once.withColumn("before", before))
    sizes = ringed.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"))
    joined = ringed.join(shard_quotas(sizes, wanted, total=total), ["source", "shard"])
    start = F.col("block") * F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.ceil(F.col("in_shard") / F.col("block")))
    extra = F.pmod(F.col("before") - start, F.col("in_shard")) < F.pmod("give", "in_shard")
    copies = F.least(F.floor(F.col("give") / F.col("in_shard")) + extra.cast("int"), F.col("most"))
    chosen = joined.withColumn("copies", copies.cast("int")).filter(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")

    summed = {r.source: r for r in ringed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).collect()}
    have = {s: (summed[s].tokens, summed[s].documents) if s in summed else (0, 0) for s in wanted}
    weight = sum(share for s, (share, _) in wanted.items() if have[s][0])
    facts = [(s, share, share / weight if have[s][0] else 0.0, most, have[s][1], have[s][0]) for s, (share, most) in wanted.items()]
    frame = spark.createDataFrame(facts, "source string, target_share double, reachable_share double, max_repeats int, documents long, available_tokens long")
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"), F.max("copies").alias("most_copies"))
    shares = frame.join(taken, "source", "left").fillna(0, ["selected_tokens", "most_copies"])
    whole = F.sum("selected_tokens").over(Window.partitionBy(F.lit(1)))  # a row for each target
    return chosen, shares.withColumn("actual_share", F.when(whole > 0, F.col("selected_tokens") / whole).otherwise(0.0))
