"""Operator 9: cross-entropy difference of two n-gram models over words.

Both models predict a text word by word from the word before it (the start of the text for the first), with one vocabulary, the
words of all texts, and the same smoothing: p(w | v) = (c(v, w) + S p(w)) / (c(v) + S), p(w) = (c(w) + S / V) / (N + S); what
c(v) counts at the end of texts is the probability of the end. The target model learns from the texts that are labelled good;
the background model from all texts, its counts scaled to the target's size, so that the two match. A document's score is the
mean of loss(target) - loss(background) over its words: the lower, the more it looks like the target. Words are runs outside
white space (U+0009-U+000D, U+0020), compared by 64-bit hashes, as are equal rows.

Scale: neither model is ever gathered. A document's distinct word pairs go once through a shuffle, grouped by their second word:
there c(w), c(v, w), and so the losses are added up and applied to the documents of the pairs, and one pair of sums for
each document and group goes back. log p(w | v) is the log of its numerator less that of c(v) + S, which is added in the group of v.
The pairs travel as compressed blocks of columns, one for each group and HELD pairs of a task, and the sums go back to the block of
documents that they came from; in these blocks a word or pair is 48 bits of its hash and a sum a 32-bit float. Words of at least
1 / FREQUENT of all words (at most FREQUENT) are known to every task, and their pairs are grouped by pair; so are the counts of
pairs as frequent that some chunk of text holds often, which are scored without a shuffle. The ids of target texts are sent to
every task as a sorted array of up to LABELS entries (8 bytes each); more are joined by a shuffle of the texts.

Cases: a null or empty text has no tokens and null losses and score. Without any target text the target model is uniform.
Rows of `labels` that repeat a doc_id count once. An empty table gives no rows. Columns other than doc_id and text are neither read
nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, kernels

#: Counts or pairs that a task holds before it adds them up or hands them on.
HELD = 1_000_000
#: Weight of the model of the shorter context.
SMOOTHING = 4.0
FREQUENT = 40_000
#: A pair can be among the frequent ones if a chunk of text (some 2 MB) has it so many times.
OFTEN = 8
#: Word pairs in a group, about.
GROUP = 1_000_000
#: Ids of target texts that are sent to every task (64 MB).
LABELS = 8_000_000
#: Hashes that stand for the start and the end of a text.
TEXTS = 9
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, the hash of the one before it, and the number of words of each text."""
    starts, ends, first = kernels.words(data, offs)
    w = kernels.word_hashes(data, starts, ends)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = START
    return w, before, np.diff(first)


def pair_hash(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return kernels.mix(kernels.mix(w) + before * np.uint64(0x9E3779B97F4A7C15))


def added(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, and the sums of the values of each."""
    keys, at = np.unique(key, return_inverse=True)
    return [keys, *(np.bincount(at, v, len(keys)) for v in values)]


def count(rows: DataFrame, is_target, keys) -> DataFrame:
    """kind, key, n (in all texts), good (in target texts) of the kinds of keys that `keys` makes of words and the words before them.

    `keys` returns (kind, key, keep, least) tuples; keys that a chunk of text holds fewer than `least` times are left out there.
    Kind TEXTS counts the texts that have words.
    """

    def run(batches):
        held, size = {}, 0
        for batch in kernels.parts(batches):
            target = is_target(batch).astype(np.float64)
            for row, to, data, offs in kernels.chunks(batch.column(1)):
                w, before, n = tokens(data, offs)
                good = np.repeat(target[row:to], n)
                held.setdefault(TEXTS, []).append([np.zeros(1, np.uint64), np.array([np.count_nonzero(n)], np.float64), np.array([target[row:to][n > 0].sum()])])
                for kind, key, keep, least in keys(w, before):
                    own = added(key[keep], np.ones(int(keep.sum())), good[keep])
                    held.setdefault(kind, []).append([x[own[1] >= least] for x in own] if least > 1 else own)
                    size += len(held[kind][-1][0])
            if size > HELD:
                held = {k: [added(*map(np.concatenate, zip(*x, strict=True)))] for k, x in held.items()}
                size = sum(len(x[0][0]) for x in held.values())
                if size > HELD / 2:
                    yield from map(table, held.items())
                    held, size = {}, 0
        yield from map(table, held.items())

    def table(item):
        x = added(*map(np.concatenate, zip(*item[1], strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), item[0], np.int32)), *[pa.array(c.astype(np.uint64).view(np.int64)) for c in x]], ["kind", "key", "n", "good"])

    return rows.mapInArrow(run, "kind int, key long, n long, good long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of hashes (uint64, of which 48 bits stay), of floats, and of other numbers from 0 on, in as few bytes as hold them."""
    out = [len(columns).to_bytes(1, "little")]
    for x in columns:
        if x.dtype == np.uint64:
            code, raw = 6, np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        elif x.dtype == np.float32:
            code, raw = 5, x.tobytes()
        else:
            code = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
            raw = x.astype(f"<u{code}").tobytes()
        out += [code.to_bytes(1, "little"), len(x).to_bytes(4, "little"), raw]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(raw[0]):
        code, n = raw[at], int.from_bytes(raw[at + 1 : at + 5], "little")
        at += 5
        size = 4 if code == 5 else code
        own = raw[at : at + n * size]
        at += n * size
        if code == 6:
            x = np.zeros((n, 8), np.uint8)
            x[:, :6] = np.frombuffer(own, np.uint8).reshape(-1, 6)
            out.append(x.reshape(-1).view(np.uint64))
        else:
            out.append(np.frombuffer(own, "<f4" if code == 5 else f"<u{code}"))
    return out


def frequent(counts: DataFrame, kind: int, least: float) -> list[np.ndarray]:
    """key, n, good of the keys with at least `least` occurrences, by key."""
    t = counts.filter((F.col("kind") == kind) & (F.col("n") >= least)).drop("kind").toArrow()  # at most FREQUENT rows
    key, n, good = (t.column(c).to_numpy().astype(k) for c, k in (("key", np.int64), ("n", np.float64), ("good", np.float64)))
    order = np.argsort(key.view(np.uint64))
    return [key.view(np.uint64)[order], n[order], good[order]]


def place(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in the sorted keys, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return at, sorted_keys[at] == key


def score(docs: DataFrame, good_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    ids = good_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    few = common.small_enough(ids, LABELS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if few:
        known_ids = spark.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))
    else:
        rows = common.written(rows.join(ids.withColumn("target", F.lit(True)), "doc_id", "left"))

    def is_target(batch):
        """A flag for each row of doc_id, text (and target)."""
        if not few:
            return batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
        own = batch.column(0)
        return place(known_ids.value, own.fill_null(0).to_numpy())[1] & own.is_valid().to_numpy(zero_copy_only=False)

    everything = lambda w, before: [(0, w, np.ones(len(w), bool), 1), (1, pair_hash(before, w), np.ones(len(w), bool), OFTEN)]
    counts = common.written(count(rows, is_target, everything))
    total = counts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    n_all, n_good, vocabulary = (max(1, int(x)) for x in total)
    least = max(2.0, n_all / FREQUENT)
    known = frequent(counts, 0, least)
    often = frequent(counts, 1, least)[0]
    opened = counts.filter(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()

    def both_known(w, before):
        key = pair_hash(before, w)
        return [(1, key, place(known[0], w)[1] & place(often, key)[1], 1)]

    pairs = frequent(count(rows, is_target, both_known), 1, 1)
    shared = spark.sparkContext.broadcast((known, pairs))
    scale, s = n_good / n_all, SMOOTHING
    groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_all // GROUP))
    base = tuple(float(np.log(c + s)) for c in (opened[1], opened[0] * scale))  # the context of each first word

    def of_context(n, good):
        """What a word as context adds to the losses, for both models."""
        return np.log(good + s), np.log(n * scale + s)

    def of_pair(n, good, pair_n, pair_good):
        """What a word after another adds to the losses, from the counts of the word and of both."""
        p = [(c + s / vocabulary) / (m + s) for c, m in ((good, int(total[1])), (n * scale, n_good))]
        return -np.log(pair_good + s * p[0]), -np.log(pair_n * scale + s * p[1])

    def deal(batches):
        (word, word_n, word_good), (pair, pair_n, pair_good) = shared.value
        codec, task, sent = pa.Codec("zstd"), TaskContext.get().partitionId(), 0
        docs, ofknown, others, size, held_docs = [], [], [], 0, 0

        def packed():
            """A block of the documents held and one of their pairs for each group."""
            f, out = task << 32 | sent, []
            out.append((f % groups, f, True, pa.concat_batches(docs).serialize()))
            some = []
            for rows, order in ((ofknown, (1, 0)), (others, (2, 1, 0))):
                cols = list(map(np.concatenate, zip(*rows, strict=True)))
                at = np.lexsort([cols[k] for k in order])
                some.append([x[at] for x in cols])
            occurring = np.unique(np.concatenate([cols[0] for cols in some]))  # groups without a pair cost nothing
            edges = [[np.searchsorted(cols[0], occurring, side) for side in ("left", "right")] for cols in some]
            for i, g in enumerate(occurring.tolist()):
                cut = [[x[lo[i] : hi[i]] for x in cols[1:]] for cols, (lo, hi) in zip(some, edges, strict=True)]
                out.append((g, f, False, pack(*cut[0], *cut[1])))
            for x in (docs, ofknown, others):
                x.clear()
            raw = [x[3] for x in out]
            return pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_()),
                pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()),
            ], ["part", "f", "docs", "size", "block"])

        for batch in kernels.parts(batches):
            targets = is_target(batch).astype(np.uint8)
            for row, to, data, offs in kernels.chunks(batch.column(1)):
                w, before, n = tokens(data, offs)
                count_ = to - row
                text = np.repeat(np.arange(count_), n)
                target = targets[row:to]
                some = np.flatnonzero(n)
                last = np.cumsum(n)[some] - 1
                # Equal pairs of a text become one row; after them a row for each last word, which is no context.
                key = pair_hash(before, w)
                order = np.lexsort((key, text))
                new = np.ones(len(key), bool)
                new[1:] = (np.diff(key[order]) != 0) | (np.diff(text[order]) != 0)
                first = np.flatnonzero(new)
                m = np.concatenate([np.diff(first, append=len(key)), np.ones(len(some), np.int64)])
                at = order[first]
                key = np.concatenate([key[at], np.full(len(some), END)])
                w, before, text = np.concatenate([w[at], w[last]]), np.concatenate([before[at], np.full(len(some), END)]), np.concatenate([text[at], some])
                end = np.arange(len(w)) >= len(at)
                wk, is_word = place(word, w)
                pk, is_pair = place(pair, key)
                is_pair &= is_word & ~end
                sums = []
                context = of_context(word_n[wk[is_word]], word_good[wk[is_word]])
                paired = of_pair(word_n[wk[is_pair]], word_good[wk[is_pair]], pair_n[pk[is_pair]], pair_good[pk[is_pair]])
                for k in (0, 1):
                    x = np.bincount(text[is_word], context[k] * m[is_word] * np.where(end[is_word], -1, 1), count_)
                    sums.append(x + np.bincount(text[is_pair], paired[k] * m[is_pair], count_) + base[k] * (n > 0))
                docs.append(pa.RecordBatch.from_arrays([batch.column(0)[row:to], pa.array(n.astype(np.int64)), *map(pa.array, sums)], ["doc_id", "n", "a", "b"]))
                local, good = text + held_docs, target[text]
                x = is_word & ~is_pair & ~end
                ofknown.append([(kernels.mix(key[x]) % np.uint64(groups)).astype(np.int32), key[x], wk[x], local[x], m[x], good[x]])
                x = ~is_word
                others.append([(kernels.mix(w[x]) % np.uint64(groups)).astype(np.int32), w[x], before[x], local[x], m[x], good[x]])
                size += len(ofknown[-1][0]) + len(others[-1][0])
                held_docs += count_
                if size > HELD or held_docs > HELD:
                    yield packed()
                    size, held_docs, sent = 0, 0, sent + 1
        if docs:
            yield packed()

    def counted(key, m, good):
        """How often each key is seen here, and in target texts."""
        _, at = np.unique(key, return_inverse=True)
        return np.bincount(at, m)[at], np.bincount(at, m * good)[at]

    def rate(table: pa.Table) -> pa.Table:
        """Blocks of documents as they are; for each block of pairs the sums of its documents."""
        _, word_n, word_good = shared.value[0]
        codec = pa.Codec("zstd")
        own = table.column("docs").to_numpy()
        out = [table.filter(pa.array(own)).select(["f", "docs", "size", "block"])]
        blocks = table.filter(pa.array(~own))
        held = [unpack(codec.decompress(x.as_buffer(), size, asbytes=True)) for size, x in zip(blocks.column("size").to_pylist(), blocks.column("block"), strict=True)]
        if held:
            key, wk, _, m, good = (np.concatenate([x[k] for x in held]) for k in range(5))
            m, good = m.astype(np.float64), good.astype(np.float64)
            losses = [[m * p for p in of_pair(word_n[wk], word_good[wk], *counted(key, m, good))]]
            w, before, _, m, good = (np.concatenate([x[k] for x in held]) for k in range(5, 10))
            end, m, good = before == END, m.astype(np.float64), good.astype(np.float64)
            seen = np.where(end, 0, m)
            n, ok = counted(w, seen, good)
            paired = of_pair(n, ok, *counted(pair_hash(before, w), seen, good))
            losses.append([np.where(end, -c, m * (p + c)) for p, c in zip(paired, of_context(n, ok), strict=True)])
            raw, done = [], [0, 0]
            for x in held:
                cut = [slice(d, d + len(x[5 * k])) for k, d in enumerate(done)]
                done = [c.stop for c in cut]
                docs_, a, b = added(np.concatenate([x[2], x[7]]), *(np.concatenate([losses[0][k][cut[0]], losses[1][k][cut[1]]]) for k in (0, 1)))
                raw.append(pack(docs_, a.astype(np.float32), b.astype(np.float32)))
            out.append(pa.table([blocks.column("f"), blocks.column("docs"), pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], names=out[0].column_names))
        return pa.concat_tables(out)

    def gather(table: pa.Table) -> pa.Table:
        """The documents of a block with all their sums."""
        codec = pa.Codec("zstd")
        docs_, sums = None, []
        for is_docs, size, x in zip(table.column("docs").to_pylist(), table.column("size").to_pylist(), table.column("block"), strict=True):
            raw = codec.decompress(x.as_buffer(), size, asbytes=not is_docs)
            if is_docs:
                docs_ = pa.ipc.read_record_batch(raw, block)
            else:
                sums.append(unpack(raw))
        n, a, b = (docs_.column(k).to_numpy() for k in (1, 2, 3))
        if sums:
            at = np.concatenate([x[0] for x in sums])
            a, b = (c + np.bincount(at, np.concatenate([x[k] for x in sums]).astype(np.float64), len(n)) for k, c in ((1, a), (2, b)))
        none = n == 0
        a, b = (np.divide(c, n, where=~none, out=np.zeros(len(n))) for c in (a, b))
        return pa.table([docs_.column(0), docs_.column(1), *[pa.array(x, mask=none) for x in (a, b, a - b)]], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    block = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.float64()), ("b", pa.float64())])
    dealt = rows.mapInArrow(deal, "part int, f long, docs boolean, size long, block binary")
    sums = dealt.groupBy("part").applyInArrow(rate, "f long, docs boolean, size long, block binary")
    return sums.groupBy("f").applyInArrow(gather, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.read(spark, sf_dir, "labels")
    return score(common.read(spark, sf_dir, "documents"), labels.filter("quality = 1 AND toxic = 0"))
