"""Operator 1: Jaccard self-join of documents on word n-grams, by filters under several global token orders.

The set of a document holds the hashes of its distinct shingles. If two sets have a Jaccard similarity of T or more, they
share a token among the first n - ceil(T n) + 1 of each under *any* global order of tokens. Candidates come from the order
"rare first" (by a table of counts over all documents, so that a passage which many documents share seldom generates one); those
that fail the same test under two hash orders are dropped before the exact verification, as are those whose parity bit maps
differ more than linked sets can. Both tests are made on signatures of some n/2 bytes, so that few whole sets travel.

Scale: equal sets collapse first, by a pre-aggregated group; a class of more than HOT copies meets its documents by salted keys, and
documents without a shingle meet nothing. A token's documents (its block) are never paired with each
other; each round pairs one document of a block (that with the largest share of recurring tokens: an original
rather than its edited copies) with the rest, so that a round is linear in the postings. Blocks whose
documents are already connected are done. What is left after `HUB_ROUNDS` is compared across components only, chunk by
chunk inside tasks, by signatures; pairs that can't be linked are never emitted. Postings travel by token; for frequent tokens
(a bounded list) the smallest documents of their blocks are a pre-aggregated, broadcast table of at most
`MAX_HEAVY` rows, and what is left of them travels by token too. The verification meets texts by a checked broadcast of ids up to
`common.BROADCAST_ROWS` of them; beyond, it shuffles the texts. Intermediate tables live in the shared checkpoint folder.

Cases: null and empty texts have an empty set, n_shingles 0, and are linked with nothing (component_id = doc_id). A text of
fewer than five words is one shingle. A repeated doc_id is one node; a null doc_id gets the smallest id among equal sets, or
null. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, kernels

SHINGLE = 5
THRESHOLD = (80, 100)
#: Frequent tokens that come last in the first order. Only the order of tokens depends on it, never a result.
MAX_HEAVY = 65_536
#: A token counts as frequent if at least so many texts of one 2 MB chunk have it.
HEAVY_IN_CHUNK = 8
HUB_ROUNDS = 2
#: A class of more equal sets than this is dealt over SALTS tasks.
HOT, SALTS = 1000, 64
#: Documents in a chunk of a block; a task compares two chunks.
CHUNK = 2048
#: A block of at most so many documents is paired by a join: a document meets a bounded number of others there.
SMALL = 32
#: Cells of the table of shingle counts, of fixed size. A passage in a fixed share of the texts stands out the more, the more texts.
CELLS = 1 << 19


def _add_up(parts: DataFrame) -> DataFrame:
    """Adds count arrays (block, counts) elementwise; a task holds one array for each block, however many parts there are."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in kernels.parts(batches):
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(raw.as_py()), np.uint64)
                total[block] = total[block] + own if block in total else own
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["block", "counts"])

    for salt in (32, 1):
        parts = parts.repartition(*["block"] + ([(F.spark_partition_id() % salt)] if salt > 1 else [])).mapInArrow(run, "block int, counts binary")
    return parts


def _survey(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """What the first order needs: at most MAX_HEAVY frequent shingles, the most frequent last, and a table of CELLS counts.

    Also a row for each document: its id, set size and 128-bit set digest. The table adds up, for all documents, how many have
    a shingle in each cell; it puts passages that recur anywhere behind those that don't. Each chunk of 2 MB of text reports
    the shingles that it sees often.
    """

    def run(batches):
        table = np.zeros(CELLS, np.uint64)
        for batch in kernels.parts(batches):
            for row, to, data, offs in kernels.chunks(batch.column(1)):
                found = [*kernels.shingles(data, offs, size)]
                every = np.concatenate(found)
                table += np.bincount(every & np.uint64(CELLS - 1), minlength=CELLS).astype(np.uint64)
                token, times = np.unique(every, return_counts=True)
                often = times >= HEAVY_IN_CHUNK
                k, m = to - row, int(often.sum())
                n = pa.array([len(s) for s in found], pa.int64())
                d1 = pa.array([int(kernels.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64())
                d2 = pa.array([int(kernels.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, k), n, d1, d2, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(token[often].view(np.int64)), pa.array(times[often].astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if table.any():
            blocks = table.reshape(-1, 1 << 16)
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(range(len(blocks)), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in blocks], pa.binary())], names)

    names = ["doc_id", "n", "d1", "d2", "block", "counts"]
    seen = common.durable(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, block int, counts binary"))
    top = seen.filter("n IS NULL AND block IS NULL").groupBy(F.col("d1").alias("token")).agg(F.sum("d2").alias("times")).orderBy(F.desc("times"), "token").limit(MAX_HEAVY).collect()
    table = np.zeros((CELLS >> 16, 1 << 16), np.uint64)
    for r in _add_up(seen.filter("block IS NOT NULL").select("block", "counts")).collect():  # CELLS / 65,536 rows
        table[r.block] = np.frombuffer(zlib.decompress(r.counts), np.uint64)
    return seen.filter("n IS NOT NULL").select("doc_id", "n", "d1", "d2"), np.array([r.token for r in reversed(top)], np.int64).view(np.uint64), np.minimum(table.reshape(-1), (1 << 24) - 1)


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


#: Seeds of the second and third order.
_ORDERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _bits(at: np.ndarray, size: int) -> bytes:
    flags = np.zeros(size, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _width(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def _orders(s: np.ndarray, p: int) -> list[np.ndarray]:
    """The prefixes of a set under the second and third order."""
    return [np.partition(v, p - 1)[:p] for v in (kernels.mix(s * np.uint64(seed)) for seed in _ORDERS)]


def _signature(s: np.ndarray, p: int) -> bytes:
    """The set's size, the parities of its tokens over some 2 n bits, and bit maps of its prefixes under two more orders."""
    width = _width(len(s))
    at, odd = np.unique(kernels.mix(s) & np.uint64(width - 1), return_counts=True)
    maps = [_bits(((v >> np.uint64(20)) & np.uint64(width // 2 - 1)).astype(np.int64), width // 2) for v in _orders(s, p)]
    return b"".join([len(s).to_bytes(8, "little"), _bits(at[odd % 2 == 1].astype(np.int64), width), *maps])


def _read_signature(raw: bytes) -> tuple[int, int, list[int]]:
    n = int.from_bytes(raw[:8], "little")
    width, at, out = _width(n), 8, []
    for size in (width // 8, width // 16, width // 16):
        out.append(int.from_bytes(raw[at : at + size], "little"))
        at += size
    return n, width, out


def _may_link(x: tuple, y: tuple, num: int, den: int) -> bool:
    """False only for pairs that can't be linked: no prefix token in common under an order, or too many odd differences."""
    if x[1] > y[1]:
        x, y = y, x
    n, width, a = x
    m, wide, b = y
    b = list(b)
    while wide > width:  # a wider map folds to a narrower one
        wide //= 2
        b = [(b[0] >> wide) ^ (b[0] & ((1 << wide) - 1)), *((v >> (wide // 2)) | (v & ((1 << (wide // 2)) - 1)) for v in b[1:])]
    return all(u & v for u, v in zip(a[1:], b[1:], strict=True)) and (a[0] ^ b[0]).bit_count() * (den + num) <= (n + m) * (den - num)


def _prefixes(docs: DataFrame, heavy: np.ndarray, table: np.ndarray, size: int, num: int, den: int) -> DataFrame:
    """doc_id, set digest, signature, and the set's prefix under the first order, split in rare and frequent tokens."""
    by_value = np.argsort(heavy)
    values = heavy[by_value]
    shared = docs.sparkSession.sparkContext.broadcast((values, by_value, table.astype(np.uint32)))

    def make(batches):
        values, rank, table = shared.value
        for batch in kernels.parts(batches):
            for row, to, data, offs in kernels.chunks(batch.column(1)):
                n, d1, d2, light, frequent, signature = [], [], [], [], [], []
                for s in kernels.shingles(data, offs, size):
                    n.append(len(s))
                    d1.append(int(kernels.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    d2.append(int(kernels.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))
                    p = _prefix_length(len(s), num, den) if len(s) else 0
                    at = np.searchsorted(values, s)
                    known = np.zeros(len(s), bool)
                    if len(values):
                        at[at == len(values)] = 0
                        known = values[at] == s
                    rare = s[~known]
                    if len(rare) > p:
                        order = table[rare & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(40) | rare >> np.uint64(24)
                        rare = rare[np.argpartition(order, p - 1)[:p]]
                    light.append(rare.view(np.int64))
                    frequent.append(s[known][np.argsort(rank[at[known]], kind="stable")][: p - len(rare)].view(np.int64))
                    signature.append(_signature(s, p) if p else b"")
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *v])) for v in (light, frequent)]
                longs = [pa.array(x, pa.int64()) for x in (n, d1, d2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), *longs, *lists, pa.array(signature, pa.binary())], ["doc_id", "n", "d1", "d2", "light", "frequent", "signature"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n long, d1 long, d2 long, light array<long>, frequent array<long>, signature binary")


def _compare_blocks(members: DataFrame, blocks: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with different labels in the same block whose signatures allow a link. Pairs are compared inside tasks.

    A block is cut into chunks of some CHUNK documents by a hash, and a task gets two chunks; only what passes is emitted.
    """
    cut = members.join(blocks.select("token", F.ceil(F.col("size") / CHUNK).cast("int").alias("cuts")), "token").withColumn("own", F.pmod(F.xxhash64("rep"), "cuts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    dealt = cut.select("token", "rep", "label", "own", other).select("token", "rep", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def rows(found: list[tuple], width: int, label: np.ndarray):
        """Sizes, labels, ids and the three maps of documents as matrices, folded to `width` bits."""
        out = [np.array([f[1] for f in found]), label, np.array([f[0] for f in found])]
        for k, size in enumerate((width, width // 2, width // 2)):
            m = np.stack([np.frombuffer(f[3 + k], np.uint8) for f in found])
            while m.shape[1] * 8 > size:
                half = m.shape[1] // 2
                m = m[:, half:] ^ m[:, :half] if k == 0 else m[:, half:] | m[:, :half]
            out.append(m if m.shape[1] % 8 else np.ascontiguousarray(m).view(np.uint64))
        return out

    def compare(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        own, labels = table.column("own").to_numpy(), table.column("label").to_numpy()
        by_width: dict[int, list[int]] = {}
        docs = []
        for k, (rep, raw) in enumerate(zip(table.column("rep").to_pylist(), table.column("signature").to_pylist(), strict=True)):
            n = int.from_bytes(raw[:8], "little")
            w = _width(n) // 8
            docs.append((rep, n, None, raw[8 : 8 + w], raw[8 + w : 8 + w + w // 2], raw[8 + w + w // 2 :]))
            by_width.setdefault(w * 8, []).append(k)
        same = table.column("j")[0].as_py() == i
        out_a, out_b = [], []
        for width, narrow in by_width.items():
            for wide in (width, 2 * width):
                if wide not in by_width:
                    continue
                left, right = np.array(narrow), np.array(by_width[wide])
                x, y = rows([docs[k] for k in left], width, labels[left]), rows([docs[k] for k in right], width, labels[right])
                for k in range(len(left)):
                    ok = (y[1] != x[1][k]) & (np.minimum(y[0], x[0][k]) * den >= np.maximum(y[0], x[0][k]) * num)
                    ok &= (y[2] > x[2][k]) if wide == width and same else (own[right] != own[left[k]]) | same
                    at = np.flatnonzero(ok)
                    at = at[np.bitwise_count(y[3][at] ^ x[3][k]).sum(1, dtype=np.int64) * (den + num) <= (y[0][at] + x[0][k]) * (den - num)]
                    for m in (4, 5):
                        at = at[(y[m][at] & x[m][k]).any(1)]
                    out_a.append(np.minimum(x[2][k], y[2][at]))
                    out_b.append(np.maximum(x[2][k], y[2][at]))
        return pa.table({"a": np.concatenate(out_a).astype(np.int64), "b": np.concatenate(out_b).astype(np.int64)})

    return dealt.join(signatures.select("rep", "signature"), "rep").groupBy("token", "i", "j").applyInArrow(compare, "a long, b long")


def _sift(pairs: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose signatures allow a link."""

    def sift(batches):
        for batch in kernels.parts(batches):
            x, y = batch.column(2), batch.column(3)
            keep = [_may_link(_read_signature(u.as_py()), _read_signature(v.as_py()), num, den) for u, v in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = pairs.join(signatures.select(F.col("rep").alias("a"), F.col("signature").alias("x")), "a").join(signatures.select(F.col("rep").alias("b"), F.col("signature").alias("y")), "b")
    return known.select("a", "b", "x", "y").mapInArrow(sift, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those linked, by their whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if common.small_enough(ids) else ids

    def full(batches):
        for batch in kernels.parts(batches):
            for row, to, data, offs in kernels.chunks(batch.column(1)):
                sets = [s.tobytes() for s in kernels.shingles(data, offs, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array(sets, pa.binary())], ["id", "set"])

    sets = common.durable(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(full, "id long, set binary"))
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        prefixes = zip(_orders(x, _prefix_length(len(x), num, den)), _orders(y, _prefix_length(len(y), num, den)), strict=True)
        if any(not len(np.intersect1d(u, v, assume_unique=True)) for u, v in prefixes):
            return False
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return den * shared >= num * (len(x) + len(y) - shared)

    def check(batches):
        for batch in kernels.parts(batches):
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the undirected links (a, b); label is the smallest node that can be reached.

    Each round takes the smallest label among neighbours, then the label of that label, until nothing changes. All of it is
    joins and pre-aggregated groups; each round is written to the shared folder.
    """
    edges = common.durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.durable(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = common.durable(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """`labels` (node, label) after more links: only the labels that these connect are gone through again."""
    if labels is None:
        return components(links)
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    new = components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b").distinct())
    old = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return common.durable(old.union(new.join(labels.select("node"), "node", "left_anti")))


def _sizes_fit(x: Column, y: Column, num: int, den: int) -> Column:
    return F.least(x, y) * den >= F.greatest(x, y) * num


def _postings(reps: DataFrame) -> DataFrame:
    """(token, rep, n, weight) of tokens that at least two representatives have in their prefixes."""
    light = reps.select("rep", "n", F.explode("light").alias("token")).repartition("token")
    block = [F.min("rep").alias("hub"), F.max("rep").alias("last")]
    several = light.groupBy("token").agg(*block).filter("hub < last").select("token")
    light = light.join(several.hint("shuffle_hash"), "token")
    frequent = reps.select("rep", "n", F.explode("frequent").alias("token"))
    # at most MAX_HEAVY rows
    frequent = frequent.join(F.broadcast(frequent.groupBy("token").agg(*block).filter("hub < last").select("token")), "token")
    live = light.select("token", "rep", "n").union(frequent.select("token", "rep", "n"))
    # copies that were edited share more with their original than with each other: in its prefix all tokens recur
    weight = live.groupBy("rep").agg((F.count("*") / F.first("n")).alias("weight"))
    return live.join(weight, "rep").select("token", "rep", "n", "weight")


def ngram_jaccard_join(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id (smallest doc_id with an equal set) for each row of `docs` (doc_id, text).

    The threshold must be over 3/4: below, sets of three shingles could link to others, and sizes differ by more than the
    comparison of blocks allows for.
    """
    num, den = threshold
    if 4 * num <= 3 * den:
        raise ValueError("the threshold must be over 3/4")
    sets, heavy, table = _survey(docs, size)
    reps = _prefixes(docs, heavy, table, size, num, den).filter("n > 3 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "light", "frequent", "signature")).alias("r"))
    reps = common.durable(reps.select(F.col("r.doc_id").alias("rep"), "n", "r.light", "r.frequent", "r.signature"))
    live = common.durable(_postings(reps))
    gc.collect()
    labels = None
    for turn in range(HUB_ROUNDS + 1):
        known = live.withColumn("label", F.col("rep")) if labels is None else live.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        block = known.groupBy("token").agg(F.min(F.struct((-F.col("weight")).alias("last"), "rep", "label", "n")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
        block = block.filter("low < high").select("token", "hub", "size")
        if turn < HUB_ROUNDS:
            rest = common.durable(known.join(block, "token").filter("rep <> hub.rep"))
            if rest.isEmpty():
                break
            pairs = rest.filter(F.col("label") != F.col("hub.label")).filter(_sizes_fit(F.col("n"), F.col("hub.n"), num, den)).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))
            live = rest.select("token", "rep", "n", "weight")
            pairs = _sift(pairs.distinct(), reps, num, den)
        else:
            few = known.join(block.filter(F.col("size") <= SMALL).select("token"), "token").select("token", "rep", "n", "label")
            other = few.select("token", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "label")])
            few = few.join(other, "token").filter("rep < rep2 AND label <> label2").filter(_sizes_fit(F.col("n"), F.col("n2"), num, den))
            many = _compare_blocks(known.select("token", "rep", "label"), block.filter(F.col("size") > SMALL), reps, num, den)
            pairs = _sift(few.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct(), reps, num, den).union(many)
        pairs = common.durable(pairs.distinct())
        if pairs.isEmpty():
            continue
        found = common.durable(_verify(pairs, docs, size, num, den))
        if not found.isEmpty():
            labels = _merged(labels, found)
        gc.collect()  # what the turn has written can go
    classes = sets.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("k"))
    if labels is None:
        classes = classes.withColumn("label", F.col("set_id"))
    else:
        classes = classes.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    classes = common.durable(classes.select("d1", "d2", "n", "k", F.struct("set_id", "label").alias("class")))
    # a large class is known SALTS times; its documents then carry a key of their own, so that the second join spreads them
    large = classes.filter(F.col("k") > HOT).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("d1", "d2", "n", "salt", F.col("class").alias("large"))
    rows = sets.filter("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(large, ["d1", "d2", "n", "salt"], "left")
    rows = rows.withColumn("d1", F.when(F.col("large").isNull(), F.col("d1")).otherwise(F.xxhash64("doc_id", "d1"))).drop("salt")
    rows = rows.join(classes.filter(F.col("k") <= HOT).drop("k"), ["d1", "d2", "n"], "left").withColumn("class", F.coalesce("large", "class"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("class.label").alias("component_id"), F.col("class.set_id").alias("set_id"))
    return out.union(sets.filter("n = 0").select("doc_id", "n", "doc_id", "doc_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(common.read(spark, sf_dir, "documents"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component, all columns kept.

    Of rows that repeat such a doc_id one with the smallest text stays. Rows without a doc_id are no nodes: all of them stay.
    """
    found = ngram_jaccard_join(docs).select("doc_id", "component_id").filter("doc_id IS NOT NULL")
    per = common.durable(found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1 OR doc_id <> least"))
    kept = docs.join(per.filter("doc_id <> least").select("doc_id"), "doc_id", "left_anti")
    several = per.filter("doc_id = least AND rows > 1").select("doc_id")
    if several.isEmpty():
        return kept
    again = kept.join(several, "doc_id", "left_semi")
    least = again.groupBy("doc_id").agg(F.min("text").alias("least")).select(F.col("doc_id").alias("id"), "least")
    again = again.join(least, (F.col("doc_id") == F.col("id")) & F.col("text").eqNullSafe(F.col("least")), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(several, "doc_id", "left_anti").union(again)


#: DuckDB: exact where a fixed number of label steps reaches all of a component.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS token FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM t x JOIN t y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE 100 * k >= 80 * (na + nb - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT doc_id, doc_id FROM s),
""" + ",\n".join(f"l{i} AS MATERIALIZED (SELECT u.a, min({'b' if i == 0 else f'l{i - 1}.l'}) AS l FROM u {'' if i == 0 else f'JOIN l{i - 1} ON u.b = l{i - 1}.a '}GROUP BY u.a)" for i in range(8)) + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l7.l AS component_id, (SELECT min(z.doc_id) FROM s z WHERE len(z.s) > 0 AND list_sort(z.s) = list_sort(s.s)) AS set_id
FROM s JOIN l7 ON s.doc_id = l7.a
"""
