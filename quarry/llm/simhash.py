"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Fingerprints are 64-bit majority votes over word shingles. All pairs of distinct
fingerprints within ``max_bits`` differing bits are found by walking a binary trie
against itself: a pair of nodes carries the number of bits that differ on the way down
and is dropped as soon as that number exceeds the budget.

To spread the walk over tasks, the trie is built in ``max_bits + 1`` rotations whose
leading blocks together cover all 64 bits. Two fingerprints within the budget agree on
at least one whole block, so in that rotation they meet below one node at the block's
depth: the walk starts there with nothing spent. A task walks all such nodes of its
partition, a bounded number of node pairs at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, connected_components, local_components, map_arrow, scratch_table, utf8_list

# Node pairs with at most this many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
# Node pairs that are walked together.
NODE_PAIRS = 1 << 18
# Links that a task holds before it reduces them to a spanning forest.
HELD_LINKS = 1 << 21
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: words lower-cased in A-Z, shingles with repeats, XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    m = n - shingle + 1
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin[:m].tolist(), end[shingle - 1:].tolist())),
                    np.uint64, m)
    by_byte = h.astype("<u8").view(np.uint8).reshape(m, 8)
    votes = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * votes > m, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, "text"):
        fp = np.fromiter((fingerprint(t, shingle, seed) for t in utf8_list(part.column("text"))), np.uint64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed 64-bit integer; null or wordless text: 0."""
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(cols, functools.partial(_fingerprints, shingle=shingle, seed=seed), "id long, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of each rotation's leading block."""
    cuts = [round(64 * k / (max_bits + 1)) for k in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def trie_self_join(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray,
                   budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of positions in ``v`` that differ in at most ``budget`` bits.

    ``v`` holds distinct values, ascending inside each root [lo, hi); a root's values share
    their ``depth`` leading bits. Pairs are yielded in bounded chunks.
    """
    for d0 in np.unique(depth):
        at = depth == d0
        walk = [(int(d0), lo[at], hi[at], lo[at], hi[at], np.zeros(int(at.sum()), np.int64))]
        counted, ones = -1, None
        while walk:
            d, a0, a1, b0, b1, spent = walk.pop()
            if len(a0) > NODE_PAIRS:  # one half waits, so that the pairs in memory stay few
                half = len(a0) // 2
                walk += [(d, *(x[half:] for x in (a0, a1, b0, b1, spent))), (d, *(x[:half] for x in (a0, a1, b0, b1, spent)))]
                continue
            size = (a1 - a0) * (b1 - b0)
            leaf = size <= LEAF_PAIRS if d < 64 else np.ones(len(size), bool)
            yield from _compare(v, a0[leaf], a1[leaf], b0[leaf], b1[leaf], budget)
            a0, a1, b0, b1, spent = (x[~leaf] for x in (a0, a1, b0, b1, spent))
            if not len(a0):
                continue
            if counted != d:
                counted, ones = d, np.concatenate([[0], np.cumsum((v >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            other = a0 != b0
            a0, a1, b0, b1, spent = (np.concatenate(x) for x in (
                (a0, am, a0, am[other]), (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]), (bm, b1, b1, bm[other]),
                (spent, spent, spent + 1, spent[other] + 1)))
            keep = (a1 > a0) & (b1 > b0) & (spent <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
            walk.append((d + 1, *(x[keep] for x in (a0, a1, b0, b1, spent))))


def _compare(v, a0, a1, b0, b1, budget, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = (a1 - a0) * (b1 - b0)
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, total[at] + chunk, "right")) - 1)
        k = np.repeat(np.arange(at, end), size[at:end])
        r = np.arange(len(k)) - np.repeat(total[at:end] - total[at], size[at:end])
        width = (b1 - b0)[k]
        i, j = a0[k] + r // width, b0[k] + r % width
        ok = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
        yield i[ok], j[ok]
        at = end


def _trie_links(batches: Iterable[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    turn, fp, node = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("turn", "fp", "node"))
    blocks = _blocks(max_bits)
    shift = np.array([a for a, _ in blocks], np.uint64)[turn]
    u = fp.view(np.uint64)
    v = np.where(shift > 0, (u << shift) | (u >> ((np.uint64(64) - shift) % np.uint64(64))), u)
    order = np.lexsort((v, turn))
    turn, v, node = turn[order], v[order], node[order]
    length = np.array([n for _, n in blocks], np.int64)[turn]
    head = v >> (64 - length).astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (turn[1:] != turn[:-1])]))
    lo, hi = new, np.concatenate([new[1:], [len(v)]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in trie_self_join(v, lo, hi, length[lo], max_bits):
        if len(i):
            held.append((node[i], node[j]))
        if sum(len(x) for x, _ in held) >= HELD_LINKS + (len(held[0][0]) if held else 0):
            held = [_forest(held)]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(held)], ["u", "v"])


def _forest(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node that it reaches) that join what ``links`` join: one per joined node."""
    a, b = (np.concatenate(x) for x in zip(*links))
    names, local = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = names[local_components(len(names), local[:len(a)], local[len(a):])]
    tree = root != names
    return names[tree], root[tree]


def simhash_links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (u, v) that connect all ``nodes(fp, node)`` whose fingerprints are within ``max_bits``.

    ``fp`` must be distinct. Each task returns a spanning forest of the links it found (every
    other link joins nodes that the forest already joins), so no group is expanded into pairs.
    """
    blocks = _blocks(max_bits)
    turn = F.explode(F.array(*[
        F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(F.shiftleft("fp", a), 64 - n).alias("head"))
        for k, (a, n) in enumerate(blocks)])).alias("at")
    spread = nodes.select("fp", "node", turn).select("at.turn", "at.head", "fp", "node").repartition("turn", "head")
    return map_arrow(spread.select("turn", "fp", "node"),
                     functools.partial(_trie_links, max_bits=max_bits), "u long, v long")


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                      max_bits: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: (``id_col``, fingerprint, component_id).

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked; component_id is
    the smallest id reachable over links, itself included. Equal fingerprints are one trie
    leaf with a representative (the smallest id), so copies of any number cost one leaf.
    Wordless and null texts have fingerprint zero and link like any other; a row without an
    id links nothing and gets a null component; rows that repeat an id share its component
    if their texts are equal. An empty table gives an empty result.
    """
    prints = scratch_table(simhash_fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = scratch_table(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    comps = connected_components(simhash_links(nodes, max_bits), "simhash-components")
    by_fp = (nodes.join(comps, "node", "left")
             .select(F.col("fp").alias("fp_"), F.coalesce("component", "node").alias("component_id")))
    out = prints.join(by_fp, prints.fp == by_fp.fp_, "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
