"""Best-fit packing by a configuration linear program over the length histogram.

1. Tokenise: each document's ids, an end id, cut into pieces of the capacity at most.
2. Plan (driver, on the histogram: one count per length, at most ``capacity`` of them): the
   configuration LP is solved approximately by multiplicative weights. A knapsack dynamic
   program prices configurations under the current weights; every priced configuration gets
   a share of its scarcest length and the covered lengths lose weight. The fractional
   solution is rounded down; the few pieces that this and the last, not full, configurations
   leave are packed best-fit decreasing, again on counts.
3. Place: pieces are numbered within their length (counts per length and salt, prefix sums
   over the salts, numbers within a salt); number and length decide sequence and offset by
   arithmetic on the plan, which is bounded by the capacity and not by the data.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, map_arrow, scratch_table, utf8_list

# Words that a worker remembers with their ids, so that frequent words are encoded once.
REMEMBERED = 300_000
# Pricing that the plan tries: (worth taken off each piece, waste allowed); the fewest sequences win.
PRICES = ((0.0, 0), (64.0, 512))
# Letters that the word tokenizer's normaliser only lower-cases, then marks that it keeps together.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, one white-space separated word at a time.

    Its pre-tokenizer never joins what white space separates, so a text's ids are its words'
    ids in order. Plain words (letters, then marks) go to the library's model directly;
    every other word goes through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        self._byte_char = {b: chr(b) for b in keep} | {
            b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in keep)}
        self._words: dict[bytes, bytes] = {}
        self._tokens: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        ids = self._tokens.get(token)
        if ids is None:
            mapped = token if token.isascii() else "".join(map(self._byte_char.__getitem__, token.encode()))
            ids = np.array([t.id for t in self._model.tokenize(mapped)], "<u4").tobytes()
            if len(self._tokens) < REMEMBERED:
                self._tokens[token] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text)
        if plain:
            letters, marks = plain.groups()
            ids = self._token(letters.lower()) + (self._token(marks) if marks else b"")
        else:
            ids = np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self._words) < REMEMBERED:
            self._words[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian 32-bit integers."""
        known = self._words.get
        return b"".join([known(w) or self._word(w) for w in text.split()])


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _pieces(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    tokenizer, end = _tokenizer(path), np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    for part in byte_slices(batches, "text"):
        row, piece, cut = [], [], []
        for k, text in enumerate(utf8_list(part.column("text"))):
            ids = tokenizer.ids(text) + end
            for n, at in enumerate(range(0, len(ids), step)):
                row.append(k)
                piece.append(n)
                cut.append(ids[at:at + step])
        piece = np.array(piece, np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(row)), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
             pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array(cut, pa.binary())],
            ["id", "piece", "start", "length", "ids"])


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """(id, piece, start, length, ids): each document's ids then ``end_id``, cut every ``capacity`` ids.

    ``ids`` is binary, little-endian unsigned 32-bit. Null text counts as empty: one piece
    that holds the end id alone.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(cols, functools.partial(_pieces, path=tokenizer_path, end_id=end_id, capacity=capacity),
                     "id long, piece int, start long, length long, ids binary")


# ---- plan ------------------------------------------------------------------------------------

def _price(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Knapsack with at most ``most`` pieces of each length, by doubling: (copies, taken).

    ``copies`` are (length index, how many at once); ``taken[i, c]`` says whether the most worth
    of the first i + 1 copies in room c has the i-th.
    """
    copies = []
    for k, size in enumerate(lengths.tolist()):
        left, times = min(int(most[k]), capacity // size), 1
        while left > 0:
            times = min(times, left)
            copies.append((k, times))
            left, times = left - times, 2 * times
    best, taken = np.zeros(capacity + 1), np.zeros((len(copies), capacity + 1), bool)
    for i, (k, times) in enumerate(copies):
        width = times * int(lengths[k])
        with_it = best[:-width] + times * worth[k]
        np.greater(with_it, best[width:], out=taken[i, width:])
        np.maximum(with_it, best[width:], out=best[width:])
    return copies, taken


def _filled(first: int, lengths: np.ndarray, copies: list[tuple[int, int]], taken: np.ndarray, room: np.ndarray,
            capacity: int) -> tuple[tuple[tuple[int, int], ...], int]:
    """The configuration of length ``first`` with the priced filling of the rest, and its waste.

    A copy that ``room`` (pieces left of each length) no longer holds is passed over.
    """
    count, left, at = {first: 1}, capacity - int(lengths[first]), len(copies)
    while left > 0:
        used = np.flatnonzero(taken[:at, left])
        if not len(used):
            break
        at = int(used[-1])
        k, times = copies[at]
        if count.get(k, 0) + times <= room[k]:
            count[k] = count.get(k, 0) + times
            left -= times * int(lengths[k])
    return tuple(sorted(count.items())), left


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 200, batch: int = 256,
                         share: float = 0.5, rate: float = 0.0002, penalty: float = 0.0, slack: int = 0,
                         ) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional solution of the configuration LP: {configuration: how many}.

    A configuration is ((length index, times), ...) and holds no more of a length than there is.
    Weights start at the lengths (the dual of the volume bound) and fall by ``exp(-rate x share
    covered)``, so pricing keeps choosing full configurations and among them those of lengths
    covered less. Each round prices once and takes, from the longest length not covered on, up to ``batch``
    configurations that waste at most ``slack``, each for ``share`` of what its scarcest
    length has left (in whole numbers where that is below 8). ``penalty`` is taken off the worth
    of every piece: configurations of fewer pieces win over slightly fuller ones, which saves
    short pieces where long ones need them. Ends when a round takes nothing.
    """
    covered, weight = np.zeros(len(lengths)), lengths.astype(float)
    out: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        order = np.flatnonzero(counts - covered >= 1)[::-1]          # longest first
        if not len(order):
            break
        room = np.floor(counts - covered)
        copies, taken = _price(lengths[order], weight[order] - penalty, room[order], capacity)
        copies = [(int(order[k]), times) for k, times in copies]
        made_now = 0
        for first in order.tolist():
            if room[first] < 1:
                continue
            made, waste = _filled(first, lengths, copies, taken, room, capacity)
            if waste > slack:
                continue
            at, times = (np.array(x) for x in zip(*made))
            step = share * float(((counts[at] - covered[at]) / times).min())
            step = step if step >= 8 else max(1.0, float(np.floor(step)))
            out[made] = out.get(made, 0.0) + step
            covered[at] += step * times
            weight[at] *= np.exp(-rate * step * times / counts[at])
            room[at] = np.floor(counts[at] - covered[at])
            made_now += 1
            if made_now >= batch:
                break
        if not made_now:
            break
    return out


def best_fit_counts(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Best-fit decreasing on a histogram: {configuration: how many}; bins alike are one group."""
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []
    def put(room: int, made, n: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((made, n))

    for k in np.argsort(-lengths, kind="stable").tolist():
        size, left = int(lengths[k]), int(counts[k])
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                put(capacity, (), -(-left // (capacity // size)))
                continue
            room = rooms[at]
            made, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            take = min(n, left)
            if n > take:
                put(room, made, n - take)
            if made and made[-1][0] == k:
                put(room - size, (*made[:-1], (k, made[-1][1] + 1)), take)
            else:
                put(room - size, (*made, (k, 1)), take)
            left -= take
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for groups in by_room.values():
        for made, n in groups:
            if made:
                out[made] = out.get(made, 0) + n
    return out


class Plan:
    """Where the n-th piece of each length goes; arrays sorted by (length, first number).

    Of the ``partial`` sequences of pieces shorter than the capacity, ``own`` are the rounded
    program's, whose value is ``program``; best-fit made the others.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, **solver):
        whole = histogram.get(capacity, 0)
        part = sorted((n, c) for n, c in histogram.items() if n < capacity and c > 0)
        lengths = np.array([n for n, _ in part], np.int64)
        counts = np.array([c for _, c in part], np.int64)
        chosen: dict[tuple[tuple[int, int], ...], int] = {}
        self.program, self.own = 0.0, 0
        if len(lengths):
            plans = []
            for penalty, slack in PRICES:
                solution = solve_configurations(lengths, counts, capacity, penalty=penalty, slack=slack, **solver)
                plans.append((*self._rounded(solution, lengths, counts, capacity), sum(solution.values())))
            chosen, self.own, self.program = min(plans, key=lambda p: sum(p[0].values()))
        self.partial = sum(chosen.values())
        rows, base, seen = [], 0, {}
        for made, n in chosen.items():
            offset = 0
            for k, times in made:
                size = int(lengths[k])
                rows.append((size, seen.get(k, 0), base, times, offset))
                seen[k] = seen.get(k, 0) + n * times
                offset += size * times
            base += n
        if whole:
            rows.append((capacity, 0, base, 1, 0))
        self.sequences = base + whole
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 44) | table[:, 1]
        self.first, self.base, self.times, self.offset = (table[:, c] for c in range(1, 5))

    @staticmethod
    def _rounded(solution, lengths, counts, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], int], int]:
        """The solution rounded down, then the rest of the histogram best-fit: (plan, sequences of the solution)."""
        out: dict[tuple[tuple[int, int], ...], int] = {}
        left = counts.copy()
        for made, x in solution.items():
            if int(x):
                at, times = (np.array(v) for v in zip(*made))
                left[at] -= int(x) * times
                out[made] = int(x)
        own, rest = sum(out.values()), np.flatnonzero(left)
        for made, n in best_fit_counts(lengths[rest], left[rest], capacity).items():
            made = tuple(sorted((int(rest[k]), times) for k, times in made))
            out[made] = out.get(made, 0) + n
        return out, own

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, (length << 44) | number, "right") - 1
        n = number - self.first[row]
        return self.base[row] + n // self.times[row], self.offset[row] + (n % self.times[row]) * length


# ---- placement -------------------------------------------------------------------------------

def _placed(batches: Iterable[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            sequence, offset = plan.place(part.column("length").to_numpy(), part.column("number").to_numpy())
            part = part.set_column(part.schema.get_field_index("number"), "sequence_id", pa.array(sequence))
            yield part.append_column("offset", pa.array(offset))


def pack_pieces(pieces: DataFrame, capacity: int = 4096, salts: int | None = None, **solver) -> DataFrame:
    """``pieces`` (id, piece, start, length, ...) with sequence_id and offset.

    Every other column passes through. Pieces must be at least 1 and at most ``capacity``
    long. ``salts`` (default: the session's shuffle partitions) splits the numbering of each
    length, so a length that a third of all pieces has is numbered by many tasks.
    """
    spark = pieces.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the caller's columns travel as one struct, so none of their names can clash
    same = [F.col("row")[c] for c in pieces.columns if c not in ("start", "length")]
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"))
    rows = rows.select("row", F.col("row")["length"].alias("length"))
    rows = scratch_table(rows.withColumn("salt", F.pmod(F.xxhash64(*same), F.lit(salts)).cast("int")), "pieces")
    counts = scratch_table(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return rows.select("row.*", F.col("length").cast("long").alias("sequence_id"), F.col("length").cast("long").alias("offset"))
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    plan = Plan(histogram, capacity, **solver)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*same))
    numbered = (rows.withColumn("within", within).join(starts, ["length", "salt"])
                .select("row", "length", (F.col("before") + F.col("within") - 1).alias("number")))
    schema = T.StructType([*numbered.schema.fields[:2], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = map_arrow(numbered, functools.partial(_placed, plan=plan), schema)
    return placed.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 1, capacity: int = 4096, keep_ids: bool = True) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids or ids_crc32, sequence_id, offset).

    ``keep_ids=False`` replaces the ids by their CRC-32 before anything is shuffled. Null
    text is empty (its end id is packed); repeated rows are packed as often as they occur; a
    null id stays null; an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity)
    if not keep_ids:
        pieces = pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(pieces, capacity)
