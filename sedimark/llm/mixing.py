"""Mixing sources to target weights: token blocks, multinomial counts per output shard, index permutations.

1. *Pack.* Each source's texts are encoded and their tokens laid end to end into blocks of ``block_tokens`` ids. A
   source is packed in groups of about ``group_tokens`` tokens (texts dealt by the hash of their key), so a source
   that holds a third of all rows is many tasks; only a group's last block is shorter. No token is left out.
2. *Plan.* The mix is as large as the caps allow while every source that has texts keeps its share: the source that
   runs out first, at ``max_repeats`` passes, sets the size. ``total_tokens`` asks for another size; a capped source
   then falls short and the report says so. Listed sources without texts get nothing; the others keep their shares
   among themselves.
3. *Draw.* Output shards have ``shard_blocks`` slots. Each shard takes the whole part of every source's expected
   count and draws the slots that remain from a multinomial over the fractions, seeded by the shard's number, so any
   executor draws the same counts again. Slots of a source are numbered through all shards, by sums over runs of
   ``run_shards`` shards; within a run they are drawn again. What is drawn beyond a source's cap is given to the
   sources that have room, by their weights, so no slot stays empty while any source has blocks left.
4. *Map.* Slot k of a source with n blocks takes block ``permute(k mod n)`` of pass ``k div n``; each pass has its own
   pseudorandom permutation (a four-round Feistel network, walked until it falls within n). So no block, and no text,
   is used more often than ``max_repeats``, and one equi join on (source, block) fetches the tokens.

Driver-side state is one row per source of the target table, whose size is checked against ``MAX_SOURCES``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.bpe import DEFAULT_VOCABULARY, encode_table
from sedimark.session import cut_lineage, shuffle_width

MAX_SOURCES = 10_000
_MASK = (1 << 64) - 1


def _mix64(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def permute(index: int, size: int, key: int) -> int:
    """A pseudorandom permutation of 0..size-1: a Feistel network over the next even number of bits, cycle-walked."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    x = index
    while True:
        left, right = x >> half, x & mask
        for turn in range(4):
            left, right = right, left ^ (_mix64(right ^ (key + turn * 0x9E3779B97F4A7C15 & _MASK)) & mask)
        x = (left << half) | right
        if x < size:
            return x


def permute_all(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """:func:`permute` of many indexes at once, each with its own size and key."""
    half = np.array([max(1, (max(int(n) - 1, 1).bit_length() + 1) // 2) for n in size], dtype=np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = index.astype(np.uint64), np.zeros(len(index), dtype=np.int64)
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    open_ = np.arange(len(index))
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = x[open_] >> h, x[open_] & m
        for turn in range(4):
            z = right ^ (k + np.uint64(turn * 0x9E3779B97F4A7C15 & _MASK))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            left, right = right, left ^ (z & m)
        x[open_] = (left << h) | right
        done = x[open_] < size[open_]
        out[open_[done]] = x[open_[done]].astype(np.int64)
        open_ = open_[~done]
    return out


@dataclass
class SourcePlan:
    source: str
    share: float
    max_repeats: int
    tokens: int = 0
    blocks: int = 0
    weight: float = 0.0  # expected slots per slot of the mix


def blocks_of(texts: DataFrame, key: str, source: str, block_tokens: int, group_tokens: int) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Blocks ``source, block, n_tokens, doc_ids, tokens`` of an encoded table (``ids``), and (tokens, blocks) by source."""
    spark = texts.sparkSession
    totals = {r[0]: r[1] for r in texts.groupBy(source).agg(F.sum("n_tokens")).collect()}  # one row per listed source
    groups = spark.createDataFrame([(s, max(1, -(-(t or 0) // group_tokens))) for s, t in totals.items()] or [("", 1)], "source string, n_groups long")
    rows = texts.where("n_tokens > 0").select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").cast("string").alias("doc"), F.col("ids"), "n_tokens")
    rows = rows.join(F.broadcast(groups), "source").withColumn("grp", F.pmod(F.xxhash64("doc"), F.col("n_groups")))
    sizes = rows.groupBy("source", "grp").agg(F.sum("n_tokens").alias("t")).withColumn("n", F.ceil(F.col("t") / block_tokens))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source", "grp", "first", "n")
    counts = {r[0]: (totals[r[0]], r[1]) for r in sizes.groupBy("source").agg(F.sum("n")).collect()}
    ordered = rows.join(sizes.drop("n"), ["source", "grp"]).repartition(shuffle_width(spark), "source", "grp").sortWithinPartitions("source", "grp", "doc")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source", "block", "n_tokens", "doc_ids", "tokens"]
        group, block = None, 0
        held, docs, ends = np.zeros(0, dtype=np.int32), [], np.zeros(0, dtype=np.int64)  # tokens that fill no block yet, their documents, and where each ends

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal held, docs, ends, block
            n = -(-len(held) // block_tokens) if last else len(held) // block_tokens
            if not n:
                return None
            at = np.minimum(np.arange(n + 1) * block_tokens, len(held))
            first, upto = np.searchsorted(ends, at[:-1], "right"), np.searchsorted(ends, at[1:], "left")
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([group[0]] * n, pa.string()),
                    pa.array(np.arange(block, block + n), pa.int64()),
                    pa.array(np.diff(at), pa.int32()),
                    pa.array([list(dict.fromkeys(docs[x : y + 1])) for x, y in zip(first, upto)], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(held[: at[-1]], pa.int32())),
                ],
                names,
            )
            block += n
            rest = int(np.searchsorted(ends, at[-1], "right"))
            held, docs, ends = held[at[-1] :], docs[rest:], ends[rest:] - at[-1]
            return made

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for at in range(0, batch.num_rows, 2000):
                src, grp, doc, first = (columns[c].slice(at, 2000).to_pylist() for c in ("source", "grp", "doc", "first"))
                ids = columns["ids"].slice(at, 2000)
                flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
                i = 0
                while i < len(src):
                    j = i
                    while j < len(src) and (src[j], grp[j]) == (src[i], grp[i]):
                        j += 1
                    if (src[i], grp[i]) != group:
                        if (made := cut(True)) is not None:
                            yield made
                        group, block = (src[i], grp[i]), first[i]
                        held, docs, ends = np.zeros(0, dtype=np.int32), [], np.zeros(0, dtype=np.int64)
                    ends = np.concatenate([ends, len(held) + offsets[i + 1 : j + 1] - offsets[i]])
                    held = np.concatenate([held, flat[offsets[i] : offsets[j]].astype(np.int32)])
                    docs = docs + doc[i:j]
                    if (made := cut(False)) is not None:
                        yield made
                    i = j
        if (made := cut(True)) is not None:
            yield made

    return ordered.mapInArrow(pack, "source string, block long, n_tokens int, doc_ids array<string>, tokens array<int>"), counts


def plan_mix(targets: list[SourcePlan], block_tokens: int, total_tokens: int | None) -> tuple[list[SourcePlan], int]:
    """The sources that can contribute, with their weights, and the number of slots of the mix."""
    live = [p for p in targets if p.blocks and p.share > 0 and p.max_repeats > 0]
    if not live:
        return [], 0
    whole = sum(p.share for p in live)
    for p in live:
        p.weight = p.share / whole / (p.tokens / p.blocks)  # slots per token of the mix
    if total_tokens is None:
        total_tokens = min(p.max_repeats * p.blocks / p.weight for p in live)
    slots = int(total_tokens * sum(p.weight for p in live))
    per_slot = sum(p.weight for p in live)
    for p in live:
        p.weight /= per_slot
    return live, slots


def draw_counts(weights: np.ndarray, slots: int, shard: int, seed: int) -> np.ndarray:
    """A shard's slots per source: whole parts of the expected counts, the rest by a multinomial over the fractions."""
    expected = weights * slots
    counts = np.floor(expected).astype(np.int64)
    rest = slots - int(counts.sum())
    if rest > 0:
        fraction = expected - counts
        counts += np.random.default_rng([seed, shard]).multinomial(rest, fraction / fraction.sum())
    return counts


def share_out(n: int, room: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``n`` slots for sources with ``room`` left, by their weights; as many as there is room for."""
    out = np.zeros(len(room), dtype=np.int64)
    n = min(n, int(room.sum()))
    while n:
        able = np.where(room > out, weights, 0.0)
        part = np.minimum(np.floor(n * able / able.sum()).astype(np.int64), room - out)
        if not part.sum():
            part[int(np.argmax(able))] = 1
        out += part
        n -= int(part.sum())
    return out


def mix(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    vocabulary: str = DEFAULT_VOCABULARY,
    block_tokens: int = 64,
    group_tokens: int = 4_000_000,
    shard_blocks: int = 1024,
    run_shards: int = 16,
    total_tokens: int | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``shard, slot, source, pass, block, n_tokens, doc_ids, tokens``. Report: one row per listed source with
    ``target_share, actual_share, mix_tokens, source_tokens, passes, max_repeats``. Null and empty texts hold no
    tokens; texts whose source is null or not listed are not used; repeated rows are texts of their own; of a
    source listed more than once the row of the greatest share (then the most repeats) counts. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    each = targets.where(F.col(f"`{source}`").isNotNull()).groupBy(F.col(f"`{source}`").alias("s")).agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    listed = each.select("s", "t.*").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plans = {r[0]: SourcePlan(r[0], float(r[1] or 0), int(r[2] or 0)) for r in listed}
    names = spark.createDataFrame([(s,) for s in plans], "source string")
    wanted = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    wanted = wanted.join(F.broadcast(names), "source")
    encoded = cut_lineage(encode_table(wanted, "_key", vocabulary=vocabulary, keep=("source",)))
    blocks, counts = blocks_of(encoded, "_key", "source", block_tokens, group_tokens)
    for name, (tokens, n) in counts.items():
        plans[name].tokens, plans[name].blocks = tokens, n
    live, slots = plan_mix(list(plans.values()), block_tokens, total_tokens)
    weights = np.array([p.weight for p in live])
    shards = -(-slots // shard_blocks) if slots else 0
    sources = [p.source for p in live]

    sizes = np.array([p.blocks for p in live], dtype=np.int64)
    caps = np.array([p.blocks * p.max_repeats for p in live], dtype=np.int64)
    keys = np.array([zlib.crc32(p.source.encode()) << 20 ^ seed for p in live], dtype=np.int64)

    def drawn_in(run: int) -> Iterator[tuple[int, np.ndarray]]:
        for shard in range(run * run_shards, min((run + 1) * run_shards, shards)):
            yield shard, draw_counts(weights, min(shard_blocks, slots - shard * shard_blocks), shard, seed)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                counts = sum(c for _, c in drawn_in(run))
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(counts), pa.int64()), pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64())], ["run", "s", "n"])

    runs = spark.range(-(-shards // run_shards)).mapInArrow(total, "run long, s int, n long")
    drawn = np.zeros(len(live), dtype=np.int64)
    for r in runs.groupBy("s").agg(F.sum("n")).collect():  # one row per listed source
        drawn[r[0]] = r[1]
    over, room = np.maximum(drawn - caps, 0), np.maximum(caps - drawn, 0)
    over_from = np.concatenate([[0], np.cumsum(over)])
    given = share_out(int(over.sum()), room, weights)
    given_from = np.concatenate([[0], np.cumsum(given)])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                next_ = np.array(firsts, dtype=np.int64)
                for shard, counts in drawn_in(run):
                    s = np.repeat(np.arange(len(counts)), counts)
                    slot = np.arange(len(s))
                    k = slot - np.repeat(np.cumsum(counts) - counts, counts) + next_[s]
                    next_ += counts
                    spare = np.flatnonzero(k >= caps[s])
                    if len(spare):  # the number of the slot among all that were drawn beyond a cap says who fills it
                        number = over_from[s[spare]] + k[spare] - caps[s[spare]]
                        fills = np.searchsorted(given_from, number, "right") - 1
                        k[spare] = np.where(fills < len(live), drawn[np.minimum(fills, len(live) - 1)] + number - given_from[np.minimum(fills, len(live))], -1)
                        s[spare] = np.minimum(fills, len(live) - 1)
                        held = k >= 0
                        s, slot, k = s[held], slot[held], k[held]
                    turn, index = np.divmod(k, sizes[s])
                    block = permute_all(index, sizes[s], keys[s] + turn)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shard), pa.int64()), pa.array(slot, pa.int32()), pa.array([sources[i] for i in s], pa.string()), pa.array(turn + 1, pa.int32()), pa.array(block, pa.int64())], ["shard", "slot", "source", "pass", "block"])

    through = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.withColumn("first", F.coalesce(F.sum("n").over(through), F.lit(0))).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("s", "first"))).alias("f"))
    filled = before.select("run", F.transform("f", lambda x: x["first"]).alias("firsts")).mapInArrow(take, "shard long, slot int, source string, pass int, block long")
    mixed = filled.hint("merge").join(blocks, ["source", "block"]).select("shard", "slot", "source", "pass", "block", "n_tokens", "doc_ids", "tokens")
    listing = spark.createDataFrame([(p.source, p.share, p.max_repeats, p.tokens) for p in plans.values()], "source string, target_share double, max_repeats int, source_tokens long")
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.max("pass").alias("passes"))
    report = F.broadcast(listing).join(reached, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0))).withColumn("passes", F.coalesce("passes", F.lit(0)))
    whole = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))  # one row per listed source
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(F.lit(0.0)))
    return mixed, report.select("source", "target_share", "actual_share", "mix_tokens", "source_tokens", "passes", "max_repeats")
