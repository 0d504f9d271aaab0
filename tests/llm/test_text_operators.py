"""Each operator against a brute-force version, on frames with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import packing, queries, simhash, spm_encode, substring

from .conftest import docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(1)
VOCAB = [f"w{k}" for k in range(400)]


def words(n, seed):
    return list(np.random.default_rng(seed).choice(VOCAB, n))


BASE = words(120, 1)
ROWS = [
    (5, " ".join(BASE)), (9, "\n".join(BASE)), (3, " ".join(BASE[20:80] + words(60, 2))), (12, None), (13, ""), (14, " \t\n "),
    (20, " ".join(words(30, 3) + BASE[40:53] + words(30, 4))), (21, " ".join(BASE[50:62])), (30, "Ünïcödé 你好 " * 40),
    (31, "Ünïcödé 你好 " * 40), (None, " ".join(BASE)), (40, " ".join(words(5000, 5))), (41, "same " * 100), (42, "SAME " * 100),
    (43, "one"), (44, "ONE"), (9, "\n".join(BASE)), (50, "a b c d\x1ce"), (51, "<|endoftext|> it's 12 don't é̀ ﬁ ™")]


def simhash_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, limit=4):
    nodes = sorted(prints)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark):
    got = simhash.simhash_near_dups(docs_frame(spark, ROWS)).collect()
    prints = {i: simhash_of(t) for i, t in ROWS if i is not None}
    comp = components(prints)
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", comp[r.doc_id])


def test_links_held_in_parts_join_the_same_nodes(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fp = np.unique(np.concatenate([base, *(base ^ (1 << int(k)) for k in rng.integers(0, 62, 30))]))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fp), np.int32)), pa.array(fp), pa.array(np.arange(len(fp)))],
                                       ["turn", "fp", "node"])
    whole = [b.to_pydict() for b in simhash._trie_links([batch], 4)]
    monkeypatch.setattr(simhash, "HELD_LINKS", 50)
    monkeypatch.setattr(simhash, "NODE_PAIRS", 7)
    assert [b.to_pydict() for b in simhash._trie_links([batch], 4)] == whole and len(whole[0]["u"]) > 500


def test_trie_join_finds_every_pair_within_the_budget():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    v = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(30):
            x = int(s)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            v.add(x)
    v = np.array(sorted(v), np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.trie_self_join(v, np.array([0]), np.array([len(v)]), np.array([0]), 4)
           for a, b in zip(i, j)}
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 4
    assert got == {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}


def repeats(rows, n=13):
    tokens = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in tokens:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k:k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in tokens:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def test_substring_matches_brute_force(spark):
    got = substring.substring_dedup(docs_frame(spark, ROWS)).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == repeats(ROWS)


def test_substring_finds_a_window_at_every_alignment(spark):
    rows = [(0, " ".join(BASE[:13]))] + [(1 + k, " ".join(words(k, 50 + k) + BASE[:13] + words(9, 90 + k))) for k in range(15)]
    got = sorted((r.id, r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(docs_frame(spark, rows)).collect())
    assert got == sorted(repeats(rows)) and all(n >= 13 for i, _, n, _ in got if i)


def test_cover_is_checked():
    with pytest.raises(ValueError):
        substring._check_cover(13, 7, 7, (0, 1, 2))


def test_remove_repeats_keeps_columns_and_untouched_texts(spark):
    frame = docs_frame(spark, ROWS)
    got = substring.remove_repeats(frame)
    assert got.dtypes == frame.dtypes
    changed = {(i, k) for i, _, n, k in repeats(ROWS) if n}
    for r in got.collect():
        assert (r.doc_id, r.text) in changed or (r.doc_id, r.text) in set(ROWS)


def pieces_of(rows, capacity):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out += [(i, k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(np.array(ids[k:k + capacity], "<u4").tobytes()))
                for k in range(0, len(ids), capacity)]
    return out


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_places_every_piece_without_gaps(spark, capacity):
    got = packing.pack_documents(docs_frame(spark, ROWS), queries.tokenizer_file("word_bpe_49k.json"),
                                 capacity=capacity, keep_ids=False).collect()
    assert sorted(map(str, ((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, pieces_of(ROWS, capacity)))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places])[:-1])
        assert sum(n for _, n in places) <= capacity
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // capacity) + 2


def test_configurations_reach_the_volume_bound():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 4096, 30_000)
    lengths, counts = np.unique(n, return_counts=True)
    plan = packing.Plan(dict(zip(lengths.tolist(), counts.tolist())), 4096, rounds=40)
    assert plan.sequences <= 1.003 * -(-int(n.sum()) // 4096) + 1
    assert plan.own >= 0.9 * plan.partial


@pytest.mark.parametrize("times", [1, 1000])
def test_the_program_itself_makes_the_sequences(times):
    # lengths like those of texts: many short ones, few long ones, and more of each at scale
    rng = np.random.default_rng(8)
    n = np.clip(rng.lognormal(6.3, 0.8, 6000).astype(int), 1, 4095)
    lengths, counts = np.unique(n, return_counts=True)
    counts = counts * times + (rng.integers(0, times, len(counts)) if times > 1 else 0)
    bound = -(-int((lengths * counts).sum()) // 4096)
    plan = packing.Plan(dict(zip(lengths.tolist(), counts.tolist())), 4096)
    best_fit = sum(packing.best_fit_counts(lengths, counts, 4096).values())
    assert bound <= plan.partial <= best_fit and plan.partial <= 1.0005 * bound + 1
    assert plan.own >= 0.9 * plan.partial and 0 <= plan.program - plan.own <= 0.01 * plan.program + 1
    solution = packing.solve_configurations(lengths, counts, 4096)
    used = np.zeros(len(lengths))
    for config, x in solution.items():
        at, many = (np.array(v) for v in zip(*config))
        used[at] += x * many
        assert (lengths[at] * many).sum() <= 4096
    assert (used <= counts + 1e-6).all()


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece
    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = ROWS + [(60, "  two  spaces "), (61, "▁ mark▁▁x"), (62, "\x00\x07 bell 🦜 "), (63, "<s> </s> <0x41>")]
    got = spm_encode.encode_documents(docs_frame(spark, rows), path, outputs=(
        "ids", "spans", "decoded", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        text = texts[r.id]
        ids = library.encode(text, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        raw, spans = text.encode(), list(zip(r.spans[::2], r.spans[1::2]))
        assert r.covered_bytes == len(raw) and b"".join(raw[a:b] for a, b in spans) == raw
        proto = library.encode(text, return_type="proto")
        assert [text.encode()[a:b].decode() for a, b in spans[:-1]] == [p.surface for p in proto.pieces]


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array over the keys a and ab, with replacements X and YZ."""
    blob = b"X\0YZ\0"
    units = [0] * 512
    base = {"": 256, "a": 128, "ab": 64}

    def unit(label, offset, leaf):
        return label | (leaf << 8) | (offset << 10)
    units[0] = unit(0, base[""], 0)
    at_a = base[""] ^ ord("a")
    units[at_a] = unit(ord("a"), at_a ^ base["a"], 1)
    units[base["a"]] = 0 | 1 << 31
    at_b = base["a"] ^ ord("b")
    units[at_b] = unit(ord("b"), at_b ^ base["ab"], 1)
    units[base["ab"]] = 2 | 1 << 31
    compiled = np.array([4 * len(units)], "<u4").tobytes() + np.array(units, "<u4").tobytes() + blob
    table = spm_encode.CharacterMap(compiled)
    assert table.longest(b"abc", 0) == (b"YZ", 2) and table.longest(b"acb", 0) == (b"X", 1) and table.longest(b"b", 0) is None


@pytest.mark.parametrize("make", [
    lambda d: simhash.simhash_near_dups(d), lambda d: substring.substring_dedup(d),
    lambda d: packing.pack_documents(d, queries.tokenizer_file("word_bpe_49k.json")),
    lambda d: spm_encode.encode_documents(d, queries.tokenizer_file("piece_bpe_32k.model"))])
def test_empty_tables(spark, make):
    assert make(docs_frame(spark, [])).count() == 0
