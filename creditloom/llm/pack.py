"""Packing documents into sequences of at most ``capacity`` tokens.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver.  There a configuration
linear program - how often to use each multiset of lengths that fits a sequence, so that all pieces are
covered by the fewest sequences - is solved by multiplicative weights: the weights are the prices of the
lengths, a knapsack dynamic program finds the configurations of greatest price, their use lowers the prices of
what they hold.  It stops at a stated gap between the cover and the bound that the prices give.  Lengths are grouped into
``CLASSES`` for it, so its cost does not grow with the input.  The solution is rounded, badly filled sequences are
dissolved, and the pieces left over go to the fullest sequence they fit; it is never worse than best fit alone.
The result is a table of runs (so many pieces of a length, from this rank on, lie so in these sequences)
whose size depends on ``capacity`` only.  Pieces get their rank within their length in Spark: ranks inside
hashed buckets of a length plus the sizes of the buckets before, so a length that a third of the pieces
share is not ranked in one task.

A document is its token ids and one end id; null and empty texts are the end id alone.  Only documents
longer than ``capacity`` are cut, the first piece being the short one.  Rows are independent: repeated ids
are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from creditloom.llm.common import slices
from creditloom.llm.scratch import materialize
from creditloom.llm.tokens import encoder

END_ID = 0

#: Relative gap between the cover and its price bound at which the linear program counts as solved, and rounds it may take.
GAP, MOST_ROUNDS = 0.01, 600
#: Rounds after which the bound of the mean prices is worked out.
BOUND_EVERY = 25
#: Share of the pieces of a length covered in a round; how far from the greatest price a used configuration may be.
RATE, NEAR = 0.05, 0.02
#: Classes of lengths in the linear program; pieces of less than 1 / FILLER of a sequence fill what it leaves.
CLASSES, FILLER = 256, 32
#: Shares of a sequence that a rounded configuration must fill to be kept; above 1 none is, which is best fit alone.
REPAIR_BARS = (0.0, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0, 2.0)

PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer, False)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode.batch(texts)):
                    ids += end
                    n = len(ids) // 4
                    count = -(-n // capacity)
                    first = n - (count - 1) * capacity
                    at = 0
                    for i in range(count):
                        size = first if i == 0 else capacity
                        rows.append((doc_id, i, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at += size
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_FIELDS)


def length_classes(lengths: dict[int, int], capacity: int, classes: int = CLASSES) -> dict[int, list[int]]:
    """Lengths of at least ``capacity / FILLER`` in classes of about equally many pieces, by the greatest length of the class."""
    sizes = [s for s in sorted(lengths) if lengths[s] and s * FILLER >= capacity]
    if len(sizes) <= classes:
        return {s: [s] for s in sizes}
    total = sum(lengths[s] for s in sizes)
    out: dict[int, list[int]] = {}
    held, seen, border = [], 0, 1
    for s in sizes:
        held.append(s)
        seen += lengths[s]
        if seen * classes >= border * total:
            out[s], held = held, []
            border = seen * classes // total + 1
    return out


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest price for every room, and the index of a size to take there (-1: the room stays partly free).

    Sizes rise.  Rooms are worked out in blocks as wide as the least size, as these need earlier blocks only.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    m, step = len(sizes), int(sizes[0])
    for start in range(step, capacity + 1, step):
        rooms = np.arange(start, min(start + step, capacity + 1))
        left = rooms[:, None] - sizes[None, ::-1]  # of equal prices the longest piece is taken
        values = np.where(left >= 0, best[np.maximum(left, 0)] + prices[None, ::-1], -1.0)
        at = values.argmax(1)
        value = values[np.arange(len(rooms)), at]
        best[rooms] = np.maximum.accumulate(np.maximum(value, best[start - 1]))
        choice[rooms] = np.where(value >= best[rooms], m - 1 - at, -1)
    return best, choice


@dataclass
class Solution:
    """A feasible fractional cover: uses of each configuration (size index -> count), its total and a lower bound of all covers."""

    sizes: np.ndarray
    used: dict[tuple[tuple[int, int], ...], float]
    total: float
    bound: float
    rounds: int

    @property
    def gap(self) -> float:
        return self.total / self.bound - 1


def fractional_cover(need: dict[int, int], capacity: int, gap: float = GAP, most: int = MOST_ROUNDS) -> Solution:
    """The configuration linear program over ``need`` (size -> pieces), to a relative ``gap`` of cover and price bound.

    Prices are the sizes times weights that fall with what is covered already (multiplicative weights).  One dynamic program a round
    gives the best sequence around each size; those within ``NEAR`` of the greatest price are used, for a
    share ``RATE`` of the pieces at most.  Any prices bound the cover from below, the mean prices so far best: pieces times prices
    over the greatest price of a sequence.  The cover is feasible once divided by its least coverage.
    """
    sizes = np.array(sorted(need), np.int64)
    pieces_of = np.array([need[int(s)] for s in sizes], np.float64)
    covered, used, total = np.zeros(len(sizes)), {}, 0.0
    mean_prices = np.zeros(len(sizes))
    bound, best, prices = 0.0, (np.inf, 1.0, {}), sizes / capacity
    for done in range(1, most + 1):
        values, choice = knapsack(prices, sizes, capacity)
        bound = max(bound, float((pieces_of * prices).sum()) / float(values[capacity]))
        mean_prices += prices / float(values[capacity])
        if done % BOUND_EVERY == 0:
            bound = max(bound, float((pieces_of * mean_prices).sum()) / float(knapsack(mean_prices, sizes, capacity)[0][capacity]))
        if best[0] <= bound * (1 + gap):
            break
        held_at = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
        around = prices + values[capacity - sizes]
        budget = pieces_of * RATE
        for s in np.argsort(-around, kind="stable").tolist():
            if around[s] < (1 - NEAR) * values[capacity]:
                break
            held = {s: 1}
            room = int(held_at[capacity - int(sizes[s])])
            while room:
                a = int(choice[room])
                held[a] = held.get(a, 0) + 1
                room = int(held_at[room - int(sizes[a])])
            step = min(budget[a] / n for a, n in held.items())
            if step <= 1e-9 * pieces_of[s]:
                continue
            key = tuple(sorted(held.items()))
            used[key] = used.get(key, 0.0) + step
            total += step
            for a, n in held.items():
                budget[a] -= step * n
                covered[a] += step * n / pieces_of[a]
        prices = sizes / capacity * np.exp(-(covered - covered.mean()))
        least = float(covered.min())
        if least > 0 and total / least < best[0]:
            best = (total / least, least, dict(used))
    return Solution(sizes, {k: v / best[1] for k, v in best[2].items()}, best[0], bound, done)


def rounded(solution: Solution, classes: dict[int, list[int]], lengths: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Whole uses of the configurations, filled with pieces of their classes as long as there are any.

    Uses are rounded so that the sums from the fullest configuration on are right to one.
    """
    left = {size: [[s, lengths[s]] for s in sorted(held)] for size, held in classes.items()}
    fill = {key: sum(int(solution.sizes[a]) * n for a, n in key) for key in solution.used}
    plan, run, given = [], 0.0, 0
    for key in sorted(solution.used, key=lambda k: (-fill[k], k)):
        run += solution.used[key]
        times, given = int(run + 1e-9) - given, int(run + 1e-9)
        while times:
            # As many sequences as can be filled alike; the longest pieces of a class go first.
            held: dict[int, int] = {}
            alike = times
            for a, n in key:
                stock = left[int(solution.sizes[a])]
                take = n
                for s, count in reversed(stock):
                    if not take:
                        break
                    each = min(take, count)
                    held[s] = each
                    alike = min(alike, count // each)
                    take -= each
            if not held:
                break
            for a, _ in key:
                stock = left[int(solution.sizes[a])]
                for entry in stock:
                    entry[1] -= alike * held.get(entry[0], 0)
                stock[:] = [entry for entry in stock if entry[1]]
            plan.append((held, alike))
            times -= alike
    return plan


def solve(lengths: dict[int, int], capacity: int, gap: float = GAP, report: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """Configurations ({length: how many}) and how many sequences use each; covers every piece exactly.

    The rounded linear program is repaired: sequences filled to less than a bar go, and their pieces, those left over and
    the short ones go to the fullest sequence with room.  Of several bars, one of them above all sequences (best fit
    alone), the fewest sequences win, and of equal ones the lowest bar.
    """
    lengths = {s: n for s, n in lengths.items() if n}
    classes = length_classes(lengths, capacity)
    plan: list[tuple[dict[int, int], int]] = []
    if classes:
        solution = fractional_cover({size: sum(lengths[s] for s in held) for size, held in classes.items()}, capacity, gap)
        plan = rounded(solution, classes, lengths)
    tried = []
    for bar in REPAIR_BARS:
        kept = [(held, times) for held, times in plan if sum(s * n for s, n in held.items()) >= bar * capacity]
        left = dict(lengths)
        for held, times in kept:
            for s, n in held.items():
                left[s] -= times * n
        packed = best_fit(left, capacity, kept)
        tried.append((sum(times for _, times in packed), bar, sum(times * sum(held.values()) for held, times in kept), packed))
    sequences, bar, by_program, packed = min(tried, key=lambda x: x[:2])
    if report is not None:
        report.update(sequences=sequences, best_fit=tried[-1][0], bar=bar, by_program=by_program, pieces=sum(lengths.values()))
        if classes:
            report.update(cover=solution.total, bound=solution.bound, gap=solution.gap, rounds=solution.rounds)
    return packed


def best_fit(
    left: dict[int, int], capacity: int, begun: Sequence[tuple[dict[int, int], int]] = ()
) -> list[tuple[dict[int, int], int]]:
    """Pieces by falling length, each to the fullest sequence with room, those ``begun`` among them; equal sequences are kept as one group."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, held: dict[int, int], times: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append((held, times))

    for held, times in begun:
        put(capacity - sum(s * n for s, n in held.items()), held, times)
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        n = left[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * size, {size: each}, full)
                if rest:
                    put(capacity - rest * size, {size: rest}, 1)
                break
            room = rooms[i]
            held, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            each = min(room // size, n)
            groups = min(times, n // each)
            put(room - each * size, held | {size: held.get(size, 0) + each}, groups)
            if times > groups:
                put(room, held, times - groups)
            n -= groups * each
    return [group for groups in open_bins.values() for group in groups]


def runs_of(plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, first rank, pieces, pieces per sequence, first sequence, first offset) of every run."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for held, times in plan:
        offset = 0
        for size, n in sorted(held.items(), reverse=True):
            first = rank.get(size, 0)
            out.append((size, first, times * n, n, sequence, offset))
            rank[size] = first + times * n
            offset += n * size
        sequence += times
    return out


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, gap: float = GAP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    table = materialize(pieces(docs, capacity, tokenizer), "pieces")
    counts = table.groupBy("length").count().collect()  # at most ``capacity`` rows
    total = sum(r["count"] for r in counts)
    per_bucket = max(256, int(total**0.5))
    histogram = {r["length"]: r["count"] for r in counts}
    runs = runs_of(solve(histogram, capacity, gap))
    buckets = spark.createDataFrame([(s, -(-n // per_bucket)) for s, n in histogram.items()], "length long, p_buckets long")
    dealt = table.join(F.broadcast(buckets), "length").withColumn(
        "p_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("p_buckets"))
    )
    before = (
        dealt.groupBy("length", "p_bucket")
        .count()
        .withColumn("p_before", F.sum("count").over(Window.partitionBy("length").orderBy("p_bucket")) - F.col("count"))
        .drop("count")
    )
    order = Window.partitionBy("length", "p_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("p_row", F.row_number().over(order) - 1)
        .join(before, ["length", "p_bucket"])
        .withColumn("p_rank", F.col("p_row") + F.col("p_before"))
    )
    slots = spark.createDataFrame(
        runs, "length long, r_first long, r_pieces long, r_each long, r_sequence long, r_offset long"
    )
    place = F.col("p_rank") - F.col("r_first")
    inside = (ranked["length"] == slots["length"]) & (place >= 0) & (place < F.col("r_pieces"))
    return ranked.join(F.broadcast(slots), inside).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("r_sequence") + F.floor(place / F.col("r_each"))).alias("sequence_id"),
        (F.col("r_offset") + place % F.col("r_each") * ranked["length"]).alias("offset"),
    )
