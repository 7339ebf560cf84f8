"""Exact deduplication: compressed radix (Patricia) tries over full byte strings.

Every task first runs its own texts through a trie, so that copies meet before anything is shuffled: a text leaves
the task once, with the number of its rows and their largest id. A trie that grows too large spills by subtree: its
largest branches are sent off, and the rest goes on collecting. Texts are then partitioned by content hash and length
and sorted by them; each partition inserts hash, length and full bytes into one trie. As the order is that of the
trie's top levels, all branches before the one in hand are complete: when the trie grows large, their owners are
written out and they are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import utf8_list

TRIE_BYTES = 48_000_000
NONE = -(1 << 63)  # stands for "no id" in a terminal

OWNERS = "n_bytes long, text_hash long, text_sha256 string, keep_id long, group_size long"
PARTIALS = "n_bytes long, text_hash long, body binary, keep_id long, group_size long"


class Trie:
    """A compressed radix trie; a terminal node holds (owner id, number of rows)."""

    def __init__(self):
        self.children: dict[int, list] = {}  # first byte -> [label, children, terminal]
        self.held = 0
        self.branch: dict[int, int] = {}  # bytes held below each first byte

    def insert(self, key: bytes, owner: int, rows: int) -> None:
        """Add rows of ``key``; its terminal keeps the largest id of all."""
        children, at = self.children, 0
        while True:
            node = children.get(key[at])
            if node is None:
                children[key[at]] = [key[at:], {}, (owner, rows)]
                self.grow(key[0], len(key) - at + 200)
                return
            label = node[0]
            if not key.startswith(label, at):
                same = common_prefix(label, key, at)
                lower = [label[same:], node[1], node[2]]
                node[0], node[1], node[2] = label[:same], {label[same]: lower}, None
                label = node[0]
                self.grow(key[0], 200)
            at += len(label)
            if at == len(key):
                node[2] = (owner, rows) if node[2] is None else (max(owner, node[2][0]), rows + node[2][1])
                return
            children = node[1]

    def grow(self, first: int, size: int) -> None:
        self.held += size
        self.branch[first] = self.branch.get(first, 0) + size

    def spill(self, most: int) -> Iterator[tuple[bytes, int, int]]:
        """Take out the largest branches until at most ``most`` bytes are held, and give their terminals."""
        while self.held > most:
            first = max(self.branch, key=self.branch.get)
            self.held -= self.branch.pop(first)
            yield from self.terminals([self.children.pop(first)])

    def terminals(self, branches: list[list] | None = None) -> Iterator[tuple[bytes, int, int]]:
        """(key, owner, rows) of all terminals, or of those below some branches of the root."""
        stack = [(b"", node) for node in (self.children.values() if branches is None else branches)]
        while stack:
            above, (label, children, terminal) = stack.pop()
            key = above + label
            if terminal is not None:
                yield key, *terminal
            stack += [(key, child) for child in children.values()]


def common_prefix(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def header(n_bytes: int, text_hash: int) -> bytes:
    """The trie's top levels, in the order of the partitions. No key is a prefix of another unless it is equal: all with one header have one length."""
    return (text_hash + (1 << 63)).to_bytes(8, "big") + n_bytes.to_bytes(8, "big")


def parts(key: bytes) -> tuple[int, int, bytes]:
    """Length, hash and text of a key."""
    return int.from_bytes(key[8:16], "big"), int.from_bytes(key[:8], "big") - (1 << 63), key[16:]


def signed_hash(body: bytes) -> int:
    h = xxhash.xxh64_intdigest(body)
    return h - (1 << 64) if h >= 1 << 63 else h


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> rows of the task's distinct texts: one for each text, and one more for each spill of its branch."""
    trie = Trie()
    for batch in batches:
        for owner, body in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True):
            body = (body or b"").lower()
            trie.insert(header(len(body), signed_hash(body)) + body, NONE if owner is None else owner, 1)
            if trie.held > TRIE_BYTES:
                yield from partial_rows(trie.spill(TRIE_BYTES // 2))
    yield from partial_rows(trie.terminals())


def partial_rows(terminals: Iterator[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for key, owner, count in terminals:
        rows.append((*parts(key), None if owner == NONE else owner, count))
        held += len(key)
        if held > TRIE_BYTES // 8:
            yield record_batch(rows, pa.binary())
            rows, held = [], 0
    if rows:
        yield record_batch(rows, pa.binary())


def record_batch(rows: list[tuple], third: pa.DataType) -> pa.RecordBatch:
    n_bytes, hashes, bodies, owners, counts = zip(*rows, strict=True)
    names = ["n_bytes", "text_hash", "body" if third == pa.binary() else "text_sha256", "keep_id", "group_size"]
    return pa.RecordBatch.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(hashes, pa.int64()), pa.array(bodies, third), pa.array(owners, pa.int64()), pa.array(counts, pa.int64())], names)


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial rows -> one owner row for each text that more than one row has."""
    trie, subtree = Trie(), None
    for batch in batches:
        lengths, hashes, bodies, owners, counts = (c.to_pylist() for c in batch.columns)
        for n_bytes, text_hash, body, owner, count in zip(lengths, hashes, bodies, owners, counts, strict=True):
            if trie.held > TRIE_BYTES and (text_hash, n_bytes) != subtree:  # nothing held can come again
                yield from owner_rows(trie)
                trie = Trie()
            subtree = (text_hash, n_bytes)
            trie.insert(header(n_bytes, text_hash) + body, NONE if owner is None else owner, count)
    yield from owner_rows(trie)


def owner_rows(trie: Trie) -> Iterator[pa.RecordBatch]:
    done = []
    for key, owner, rows in trie.terminals():
        if rows > 1:
            n_bytes, text_hash, body = parts(key)
            done.append((n_bytes, text_hash, hashlib.sha256(body).hexdigest(), None if owner == NONE else owner, rows))
    if done:
        yield record_batch(done, pa.string())


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, length, content hash, digest)."""
    for batch in batches:
        bodies = [(b or b"").lower() for b in utf8_list(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, bodies), pa.int64()), pa.array(map(signed_hash, bodies), pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string())],
            ["doc_id", "n_bytes", "text_hash", "text_sha256"],
        )


def text_owners(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each text that more than one row has: its length, hash, digest, largest id and number of rows."""
    given = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    partial = given.mapInArrow(combine, PARTIALS)
    return partial.repartition("text_hash", "n_bytes").sortWithinPartitions("text_hash", "n_bytes").mapInArrow(own, OWNERS)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row, the row that stays among those with an equal text (A-Z lower-cased).

    Returns the id as ``doc_id``, ``keep_id`` (the largest id of the equal texts), ``group_size`` (their rows), ``kept`` and
    ``text_sha256`` of the normalised text. A null text counts as empty. A null id loses against any other; where
    all ids of a group are null, ``keep_id`` is null and all its rows are kept. Rows that repeat the id that stays
    are all kept, as one document. Other columns are not read, and an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(fingerprints, "doc_id long, n_bytes long, text_hash long, text_sha256 string")
    owners = text_owners(docs, id_column, text_column)
    joined = rows.join(owners, ["n_bytes", "text_hash", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
