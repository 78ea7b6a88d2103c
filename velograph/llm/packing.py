"""Vector bin packing of tokenised documents into sequences.

Each document's ids are cut into whole sequences and a rest. Whole ones are sequences of their own; the rests (and short
documents) are placed under three limits at once (ids, segments, loss-bearing ids) by the dot-product heuristic: the open
sequence takes, of all pieces that still fit, the one whose demand vector has the largest inner product with the room left.
Pieces meet in groups of bounded total length, dealt by hash, so that one task never holds more than a group.

In plain documents every id bears loss, so that limit says no more than the first (``pack_documents``). In conversations only
what the assistant says does (``pack_conversations``): there all three limits bind, each on its own.

Ids are those of the ``tokenizers`` library. A tokenizer with the parts that ``KNOWN`` names is run on many texts at once;
any other one text by text.

Results for unusual input: a null or empty text is the end id alone; texts of any length are cut; equal rows are packed each
on its own; an empty table gives an empty result; a null doc_id is kept as null; other columns are ignored. Turns are put in
order, and unusual ones treated, as in ``chat``.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from . import chat
from .text import Chunk, Powers, chunks, mix

CAPACITY, SEGMENTS, LOSS, TALK_LOSS, END_ID = 2048, 256, 2048, 1024, 1
#: Ids that meet in one task; bytes of text that are tokenised together; a rank that no merge has.
GROUP_IDS, TOKEN_CHUNK, NEVER = 4_000_000, 1 << 19, np.int32(2**31 - 1)
#: Two independent hashes of byte runs.
HASHES = [(Powers(0xD6E8FEB86659FD93), mix(np.arange(256, dtype=np.uint64), 21)), (Powers(0xE7037ED1A0B428DB), mix(np.arange(256, dtype=np.uint64), 22))]
#: The parts of a tokenizer that ``BatchTokenizer`` follows.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"


class BatchTokenizer:
    """Ids of many texts at once, for a byte-pair tokenizer that lower-cases, drops white space and marks word ends.

    A chunk's words are cut into parts (letters, single digits, signs) as the tokenizer's pattern does, distinct parts are
    merged together as rows of a matrix, and every text's ids are gathered from theirs. Words with other characters than
    ASCII and Latin-1 letters, or that the pattern treats specially, are encoded one by one by the tokenizer itself.
    """

    LONGEST = 32
    BORDERS = (2, 4, 6, 8, 11, 16, LONGEST)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        parts = json.loads(self.own.to_str())
        model = parts["model"]
        self.known = all({k: v for k, v in parts[n].items() if k not in ("vocab", "merges")} == KNOWN[n] if parts[n] else False for n in KNOWN) and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        if not self.known:
            return
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = _byte_letters()
        self.base = np.array([vocabulary.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocabulary.get(c + "</w>", -1) for c in letters], np.int32)
        self.width = max(vocabulary.values()) + 1
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], np.int64)
        self.slots, self.ranks = np.full(1 << 19, -1, np.int64), np.full(1 << 19, NEVER, np.int32)
        self.probes = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            n = 1
            while self.slots[slot] >= 0:
                slot, n = (slot + 1) & (len(self.slots) - 1), n + 1
            self.slots[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, n)
        self.kind = np.zeros(256, np.int8)  # 1 letters, 2 digits, 3 signs, 0 white space, 4 anything else
        self.kind[:] = 4
        self.kind[[9, 10, 11, 12, 13, 32]] = 0
        self.kind[33:127] = 3
        self.kind[48:58] = 2
        self.kind[97:123] = self.kind[65:91] = 1
        self.kind[ord("'")] = 4

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        slot = self._slot(key)
        out = np.where(self.slots[slot] == key, self.ranks[slot], NEVER)
        for _ in range(self.probes - 1):
            slot = (slot + 1) & (len(self.slots) - 1)
            hit = self.slots[slot] == key
            out[hit] = self.ranks[slot[hit]]
        return out

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols (-1 after their end), merged by least rank and then from the left."""
        out = np.full(symbols.shape, -1, np.int32)
        rows = np.arange(len(symbols))
        m = symbols
        r = np.where(m[:, 1:] >= 0, self._rank(m[:, :-1], np.maximum(m[:, 1:], 0)), NEVER).astype(np.int32)
        at_m, at_r = np.arange(m.shape[1]), np.arange(r.shape[1])
        while len(rows):
            j = r.argmin(1)
            n = np.arange(len(rows))
            least = r[n, j]
            done = least == NEVER
            if done.any():
                out[rows[done]] = m[done]
                live = ~done
                rows, m, r, j, least = rows[live], m[live], r[live], j[live], least[live]
                n = np.arange(len(rows))
                if not len(rows):
                    break
            new = self.merged[least]
            m = np.take_along_axis(m, np.minimum(at_m + (at_m > j[:, None]), m.shape[1] - 1), 1)
            m[n, j], m[:, -1] = new, -1
            r = np.take_along_axis(r, np.minimum(at_r + (at_r > j[:, None]), r.shape[1] - 1), 1)
            r[:, -1] = NEVER
            after = m[n, np.minimum(j + 1, m.shape[1] - 1)]
            right = np.where(after >= 0, self._rank(new, np.maximum(after, 0)), NEVER)
            inside = j < r.shape[1]
            r[n[inside], j[inside]] = right[inside]
            left = j > 0
            r[n[left], j[left] - 1] = self._rank(m[n[left], j[left] - 1], new[left])
        return out

    def _parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each) of parts of the bytes; those ``alone`` go to the tokenizer as they are."""
        size = end - start
        alone = alone | (size > self.LONGEST)
        ids, counts = [], np.zeros(len(start), np.int64)
        places = []
        low = 0
        for high in self.BORDERS:
            some = np.flatnonzero(~alone & (size > low) & (size <= high))
            low = high
            if not len(some):
                continue
            column = np.arange(high)
            inside = column < size[some, None]
            raw = data[np.minimum(start[some, None] + column, len(data) - 1)]
            symbols = np.where(inside, np.where(column == size[some, None] - 1, self.last[raw], self.base[raw]), -1)
            merged = self._merge(symbols.astype(np.int32))
            kept = merged >= 0
            counts[some] = kept.sum(1)
            ids.append(merged[kept])
            places.append(some)
        for i in np.flatnonzero(alone):
            got = np.array(self.own.encode(data[start[i] : end[i]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
            counts[i] = len(got)
            ids.append(got)
            places.append(np.array([i]))
        if not ids:
            return np.empty(0, np.int32), counts
        order, flat = np.concatenate(places), np.concatenate(ids)
        begin = np.empty(len(start), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[_spread(begin, counts)], counts

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's documents one after the other, and where each document's begin."""
        raw = c.data
        if not self.known:
            each = [np.array(self.own.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids, np.int32) for a, b in zip(c.docs[:-1], c.docs[1:], strict=True)]
            return np.concatenate([np.empty(0, np.int32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        if not len(c.start):
            return np.empty(0, np.int32), np.zeros(c.n + 1, np.int64)
        kind = self.kind[raw]
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        second = raw[lead + 1]
        latin = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[latin], second[latin]
        kind[lead] = kind[lead + 1] = 1
        low[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
        kind[np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))] = 4  # "<|" may begin a special token
        odd = np.concatenate([[0], np.cumsum(kind == 4)])
        alone = odd[c.end] > odd[c.start]
        word = np.repeat(np.arange(len(c.start)), c.end - c.start)
        at = _spread(c.start, c.end - c.start)
        k = np.where(alone[word], 5, kind[at])
        first = np.ones(len(at), bool)
        first[1:] = (word[1:] != word[:-1]) | (k[1:] != k[:-1]) | (k[1:] == 2)
        begin = at[first]
        end = np.append(at[np.flatnonzero(first)[1:] - 1], at[-1]) + 1
        single = k[first] == 5
        data = np.where(np.repeat(single, np.diff(np.append(np.flatnonzero(first), len(at)))), raw[at], low[at])
        text = low.copy()
        text[at] = data
        h = [mix(p.span(p.prefix(code[text]), begin, end) + (end - begin).astype(np.uint64), 9) for p, code in HASHES]
        _, one, which = np.unique(h[0] ^ single, return_index=True, return_inverse=True)
        if (h[1] != h[1][one][which]).any() or (single != single[one][which]).any():
            _, one, which = np.unique(np.stack([*h, single.astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
        ids, counts = self._parts(text, begin[one], end[one], single[one])
        offset = np.cumsum(counts) - counts
        each = counts[which]
        total = np.concatenate([[0], np.cumsum(each)])
        return ids[_spread(offset[which], each)], total[np.searchsorted(begin, c.docs)]


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count, one after the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


@lru_cache(maxsize=4)
def shared_tokenizer(path: str) -> BatchTokenizer:
    """One per worker process."""
    return BatchTokenizer(path)


def _pieces(path: str, capacity: int, end_id: int):
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss")])

    def run(batches):
        tokenizer = shared_tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for c in chunks(batch.column("text"), TOKEN_CHUNK):
                ids, offsets = tokenizer.encode(c)
                raw, at = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
                out = []
                for doc_id, a, b in zip(batch.column("doc_id").slice(c.first, c.n).to_pylist(), at[:-1], at[1:], strict=True):
                    mine = raw[a:b] + end
                    n = len(mine) // 4
                    for s in range(0, n, capacity):
                        piece = mine[4 * s : 4 * (s + capacity)]
                        out.append((doc_id, s, len(piece) // 4, zlib.crc32(piece), n, len(piece) // 4))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], kinds)

    return run


def _talk_pieces(path: str, capacity: int, loss: int, end_id: int):
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss")])

    def run(batches):
        tokenizer = shared_tokenizer(path)
        for batch in batches:
            lists = batch.column("turns")
            flat = lists.flatten()
            learned = pc.equal(flat.field("role"), chat.LEARNED).to_numpy(zero_copy_only=False)
            ids = []
            for c in chunks(flat.field("text"), TOKEN_CHUNK):
                got, at = tokenizer.encode(c)
                ids += [got[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            out = []
            for doc_id, a, b in zip(batch.column("conv_id").to_pylist(), first[:-1], first[1:], strict=True):
                mine = np.concatenate([*ids[a:b], [end_id]]).astype("<u4")
                borne = np.concatenate([[0], np.cumsum(np.append(np.repeat(learned[a:b], [len(x) for x in ids[a:b]]), False))])
                s = 0
                while s < len(mine):
                    e = min(s + capacity, int(np.searchsorted(borne, borne[s] + loss, "right")) - 1)
                    out.append((doc_id, s, e - s, zlib.crc32(mine[s:e].tobytes()), len(mine), int(borne[e] - borne[s])))
                    s = e
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], kinds)

    return run


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and order within it for each demand vector, by the dot-product heuristic.

    Equal vectors are interchangeable, so the search is over distinct vectors, each with a list of its pieces.
    """
    kinds, inverse, counts = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    members = np.argsort(inverse.ravel(), kind="stable")
    ends = np.cumsum(counts)
    left = counts.copy()
    scaled = kinds / limits
    alive = np.arange(len(kinds))
    bins, orders = np.empty(len(demand), np.int64), np.empty(len(demand), np.int64)
    b = 0
    while len(alive):
        room, order = limits.astype(np.int64).copy(), 0
        usable = alive
        while True:
            usable = usable[(kinds[usable] <= room).all(1) & (left[usable] > 0)]
            if not len(usable):
                break
            best = usable[np.argmax(scaled[usable] @ (room / limits))]
            piece = members[ends[best] - left[best]]
            left[best] -= 1
            bins[piece], orders[piece] = b, order
            room -= kinds[best]
            order += 1
        alive = alive[left[alive] > 0]
        b += 1
    return bins, orders


def _pack(capacity: int, segments: int, loss: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        length, lossy = table["length"].to_numpy(), table["loss"].to_numpy()
        whole = (length == capacity) & (lossy <= loss)
        rest = np.flatnonzero(~whole)
        bins, orders = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
        bins[whole] = np.arange(whole.sum())
        if len(rest):
            got, orders[rest] = place(np.stack([length[rest], np.ones(len(rest), np.int64), lossy[rest]], 1), np.array([capacity, segments, loss]))
            bins[rest] = got + whole.sum()
        by = np.lexsort((orders, bins))
        run_length = np.cumsum(length[by]) - length[by]
        first = np.append(True, bins[by][1:] != bins[by][:-1])
        offset = np.empty(len(length), np.int64)
        offset[by] = run_length - np.maximum.accumulate(np.where(first, run_length, 0))
        sequence = table["grp"].to_numpy() * (1 << 32) + bins
        return table.drop_columns(["grp", "loss"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise and cut: doc_id, start, length, ids_crc32, doc_tokens, loss."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """Place pieces (length, loss) under the limits; adds sequence_id and offset. No piece may exceed a limit alone."""
    if min(capacity, segments, loss) < 1:
        raise ValueError("a piece must fit in a sequence")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // GROUP_IDS))
    # equal pieces go to several groups: ``cut`` is a table, so a row's number is the same whenever its task runs
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(capacity, segments, loss), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, tokenizer, capacity)), capacity)


def pack_conversations(conversations: DataFrame, tokenizer: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = TALK_LOSS, end_id: int = END_ID) -> DataFrame:
    """The turns' texts of each conversation, one after the other and ended by ``end_id``, packed so that no sequence holds more
    than ``capacity`` ids, ``segments`` pieces or ``loss`` ids of the assistant. Columns as in ``pack_documents``, doc_id being conv_id."""
    cut = chat.talks(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(_talk_pieces(tokenizer, capacity, loss, end_id), PIECES)
    return pack(materialise(cut), capacity, segments, loss)
