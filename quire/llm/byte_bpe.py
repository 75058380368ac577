"""Operator 5: byte-level BPE with the ranks of a public tokenizer.

Two tiers encode a pre-token: a minimal perfect hash over the vocabulary resolves those that are tokens as a whole; the rest
are linked bytes merged in order of rank by a heap. Decoding joins the tokens' bytes.

Scale: one pass, no shuffle. The vocabulary (some 50,000 entries) and its hash are built once on the driver and broadcast.
A worker keeps the ids of pre-tokens it has met, at most `CACHE_BYTES` of them, then starts anew. A pre-token of n bytes
takes O(n log n) steps and O(n) memory, so that one text of a single long run is no trap.

Cases: a null text is encoded as an empty one (no ids). Special-token strings in a text are ordinary text. Invalid or empty
vocabularies raise; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quire.llm import common, kernels

CACHE_BYTES = 96 << 20


def read_ranks(path: str) -> list[bytes]:
    """The token of each rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[k] for k in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of the tokens: each bucket has a seed under which its tokens fall on free slots."""

    def __init__(self, tokens: list[bytes]):
        self.n = n = len(tokens)
        self.buckets = max(1, n // 3)
        groups: dict[int, list[int]] = {}
        for k, token in enumerate(tokens):
            groups.setdefault(xxhash.xxh64_intdigest(token) % self.buckets, []).append(k)
        self.seeds, self.slots = np.zeros(self.buckets, np.int32), np.full(n, -1, np.int32)
        taken = bytearray(n)
        for bucket, own in sorted(groups.items(), key=lambda x: -len(x[1])):
            seed = 1
            while True:
                at = [xxhash.xxh64_intdigest(tokens[k], seed) % n for k in own]
                if len({*at}) == len(at) and not any(taken[i] for i in at):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for k, i in zip(own, at, strict=True):
                taken[i] = 1
                self.slots[i] = k
        self.tokens, self.seeds, self.slots = tokens, self.seeds.tolist(), self.slots.tolist()

    def rank(self, token: bytes) -> int:
        """The token's rank, or -1; the stored bytes decide."""
        seed = self.seeds[xxhash.xxh64_intdigest(token) % self.buckets]
        k = self.slots[xxhash.xxh64_intdigest(token, seed) % self.n]
        return k if self.tokens[k] == token else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank merges first, the leftmost of equals.

    A part is its first byte's place; `end` links it to the next one and `before` to the last one.
    """
    n, get, push, pop = len(piece), ranks.get, heapq.heappush, heapq.heappop
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = pop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != to:  # a part has changed since
            continue
        end[i], end[j], before[to] = to, -1, i
        if to < n and (r := get(piece[i : end[to]])) is not None:
            push(heap, (r, i, end[to]))
        if (k := before[i]) >= 0 and (r := get(piece[k:to])) is not None:
            push(heap, (r, k, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec(dict):
    """Maps a pre-token to its ids as little-endian 32-bit integers."""

    def __init__(self, hashed: PerfectHash, pattern: str):
        self.hashed, self.split, self.held = hashed, regex.compile(pattern).findall, 0
        self.ranks = {token: k for k, token in enumerate(hashed.tokens)}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.hashed.rank(raw)
        ids = array("I", [whole] if whole >= 0 else merge(raw, self.ranks)).tobytes()
        self.held += len(raw) + len(ids) + 150
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.hashed.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(vocabulary: str, pattern: str, shared) -> Codec:
    """The codec of this worker process, kept from task to task."""
    if (vocabulary, pattern) not in _codecs:
        _codecs.clear()
        _codecs[vocabulary, pattern] = Codec(shared.value, pattern)
    return _codecs[vocabulary, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, digest_only: bool = False) -> DataFrame:
    """The columns of `docs` (which has text), then n_tokens and ids (binary, little-endian 32-bit) and decoded (text's bytes).

    Columns of `docs` that are called n_tokens, ids or decoded are replaced.

    With digest_only: doc_id, n_tokens and the SHA-256 of ids and of decoded, so that neither travels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(vocabulary)))
    keep = docs.select("doc_id", "text") if digest_only else docs.drop("n_tokens", "ids", "decoded")
    at = keep.columns.index("text")

    def run(batches):
        codec = _codec(vocabulary, pattern, shared)
        for batch in kernels.parts(batches):
            n, first, second = [], [], []
            for value in batch.column(at):
                ids = codec.encode(value.as_py() or "")
                back = codec.decode(ids)
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digest_only else ids)
                second.append(hashlib.sha256(back).hexdigest() if digest_only else back)
            kind = pa.string() if digest_only else pa.binary()
            own = [batch.column(0)] if digest_only else list(batch.columns)
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, kind)], names)

    if digest_only:
        schema = StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    else:
        schema = StructType([*keep.schema.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", BinaryType())])
    names = schema.names
    return keep.mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.read(spark, sf_dir, "documents"), *public_vocabulary(), digest_only=True)
