"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a block of texts are laid out in one linked symbol list. An index maps each mergeable
pair, named by its rank, to all its positions in that list. Active ranks are applied in ascending order from a
heap: each merge rewrites all positions of its pair at once and enters the two neighbouring pairs it makes into
their own position lists. A new pair of a lower rank than the current one is simply popped next, so every piece
sees its lowest rank first, from left to right, whatever the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The piece pattern of the byte-level tokenizer, with Unicode White_Space spelled out for \s.
SPACE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

PAIR_BITS = 20
BLOCK_CHARS = 4_000_000
CACHE_PARTS = 800_000
CACHED_PART_CHARS = 64
PORTION_PIECES = 100_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, as character -> byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by id, merges by packed pair of ids, and special strings, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        spec, self.digest = json.loads(raw), hashlib.sha256(raw).hexdigest()
        symbols, ids = byte_symbols(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs = {ids[a] << PAIR_BITS | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.halves = [(ids[a], ids[b]) for a, b in merges]
        self.merged = [ids[a + b] for a, b in merges]
        self.byte_pair_ranks = np.full((256, 256), -1, np.int32)
        for rank, (a, b) in enumerate(merges):
            if a in symbols and b in symbols:
                self.byte_pair_ranks[symbols[a], symbols[b]] = rank
        self.special = special


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each piece as packed little-endian unsigned 32-bit integers, by one pair occurrence index over all of them."""
    if not pieces:
        return []
    byte_ids, pairs, merged = vocabulary.byte_ids, vocabulary.pairs, vocabulary.merged
    find, halves = pairs.get, vocabulary.halves
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths + 1)  # each piece is followed by -1: no pair reaches over it
    starts = ends - lengths - 1
    symbols = np.full(len(data) + len(pieces), -1, np.int32)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = byte_ids[data]
    first = np.full(len(symbols), -1, np.int32)
    both = np.flatnonzero(inside[:-1] & inside[1:])
    first[inside] = data
    ranks = vocabulary.byte_pair_ranks[first[both], first[both + 1]]
    both, ranks = both[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    both, ranks = both[order], ranks[order]
    active, cuts = np.unique(ranks, return_index=True)
    places = {r: at.tolist() for r, at in zip(active.tolist(), np.split(both, cuts[1:]), strict=False)}
    active = active.tolist()
    symbol = symbols.tolist()
    after = list(range(1, len(symbol) + 1))
    before = list(range(-1, len(symbol) - 1))
    while active:
        rank = heapq.heappop(active)
        at = places.pop(rank)
        at.sort()
        left, right = halves[rank]
        new = merged[rank]
        high = new << PAIR_BITS
        for i in at:
            if symbol[i] != left or symbol[j := after[i]] != right:
                continue  # an earlier merge took one of the two
            symbol[i] = new
            symbol[j] = -2
            after[i] = k = after[j]
            before[k] = i
            if (c := symbol[k]) >= 0 and (r := find(high | c)) is not None:
                if r in places:
                    places[r].append(i)
                else:
                    places[r] = [i]
                    heapq.heappush(active, r)
            if (c := symbol[h := before[i]]) >= 0 and (r := find(c << PAIR_BITS | new)) is not None:
                if r in places:
                    places[r].append(h)
                else:
                    places[r] = [h]
                    heapq.heappush(active, r)
    symbols = np.array(symbol, np.int32)
    alive = symbols >= 0
    counts = np.add.reduceat(alive, starts, dtype=np.int64)
    flat = symbols[alive].astype("<u4").tobytes()
    bounds = [0, *(4 * np.cumsum(counts)).tolist()]
    return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class Encoder:
    """Encodes texts to packed little-endian ids, keeping what it met before in a bounded cache.

    A text is cut at its spaces first. Where no space is followed by white space, a piece starts at every space,
    so the part from one space to the next has its own pieces whatever stands around it; parts are looked up whole.
    """

    def __init__(self, vocabulary: Vocabulary, cache_parts: int = CACHE_PARTS):
        self.vocabulary, self.cache_parts = vocabulary, cache_parts
        self.find = regex.compile(PIECE).findall
        self.iterate = regex.compile(PIECE).finditer
        self.open_space = regex.compile(f" (?:[{SPACE}]|$)").search
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.cache: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text split at special strings: (string, id of the special token or None)."""
        if self.split is None or not any(s in text for s in self.vocabulary.special):
            return [(text, None)]
        return [(part, self.vocabulary.special.get(part)) for part in self.split(text) if part]

    def learn(self, parts: set[str], heads: set[str]) -> None:
        """Bring the ids of " " + part and of each head into the caches; all their distinct pieces share one index."""
        if len(self.cache) > self.cache_parts:
            self.cache.clear()
        if len(self.heads) > self.cache_parts // 8:
            self.heads.clear()
        fresh = [(self.cache, p, self.find(f" {p}")) for p in parts if p not in self.cache]
        fresh += [(self.heads, p, self.find(p)) for p in heads if p not in self.heads]
        ids = self.ids_of({piece for _, _, pieces in fresh for piece in pieces})
        for cache, part, pieces in fresh:
            cache[part] = ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces))

    def ids_of(self, pieces: set[str]) -> dict[str, bytes]:
        return dict(zip(pieces, encode_pieces([p.encode() for p in pieces], self.vocabulary), strict=True))

    def encode(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """Packed ids of each text, in portions."""
        split: list[list[tuple[str | None, list[str], int | None]]] = []  # a head without a space before it, parts
        seen: set[str] = set()
        heads: set[str] = set()
        for text in texts:
            runs = []
            for run, special in self.segments(text):
                if special is not None or len(run) > BLOCK_CHARS or self.open_space(run):
                    runs.append((run, [], special))
                else:
                    parts = run.split(" ")
                    head = parts.pop(0)
                    seen.update(parts)
                    if len(head) <= CACHED_PART_CHARS:
                        heads.add(head)
                    runs.append((head, parts, special))
            split.append(runs)
        self.learn(seen, heads)
        for runs in split:
            yield self.packed(runs)
        for part in [p for p in seen if len(p) > CACHED_PART_CHARS]:  # long parts hardly come again
            self.cache.pop(part, None)

    def packed(self, runs: list[tuple[str, list[str], int | None]]) -> Iterator[bytes]:
        for head, parts, special in runs:
            if special is not None:
                yield pack([special])
                continue
            if head in self.heads:
                yield self.heads[head] + b"".join(map(self.cache.__getitem__, parts))
                continue
            found = (m.group() for m in self.iterate(head))
            while portion := list(islice(found, PORTION_PIECES)):  # of a very long text too
                yield b"".join(map(self.ids_of(set(portion)).__getitem__, portion))
            yield b"".join(map(self.cache.__getitem__, parts))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def decode(packed: bytes, token_bytes: list[bytes]) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(token_bytes.__getitem__, memoryview(packed).cast("I")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary, cache_parts: int = CACHE_PARTS) -> Encoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    if vocabulary.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.digest] = Encoder(vocabulary)
    _ENCODERS[vocabulary.digest].cache_parts = cache_parts
    return _ENCODERS[vocabulary.digest]


def encode_documents(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False, cache_parts: int = CACHE_PARTS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode each text and decode it again.

    Returns one row per input row: the id column, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (of the decoded text in UTF-8); with ``keep_ids`` also ``ids``
    (array<int>). Strings of special tokens inside a text become those tokens. A null text counts as empty and
    has no tokens; a null id stays null; repeated rows each give their row; other columns are not read. The
    vocabulary file has a fixed size and is broadcast; a task holds one block of about ``block_chars`` characters and a cache
    of at most ``cache_parts`` parts, which bound its memory, and a longer text streams through in portions.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(table.value, cache_parts)
        token_bytes = own.vocabulary.token_bytes
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            counts, id_hashes, text_hashes, all_ids = [], [], [], bytearray()
            start = 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop] or "") <= block_chars):
                    held += len(texts[stop] or "")
                    stop += 1
                for parts in own.encode([t or "" for t in texts[start:stop]]):
                    n, id_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                    for packed in parts:
                        n += len(packed) // 4
                        id_hash.update(packed)
                        text_hash.update(decode(packed, token_bytes))
                        if keep_ids:
                            all_ids += packed
                    counts.append(n)
                    id_hashes.append(id_hash.hexdigest())
                    text_hashes.append(text_hash.hexdigest())
                start = stop
            columns = [names, pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            labels = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(all_ids, "<i4"), pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(columns, labels)

    schema = f"`{id_column}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, schema)
