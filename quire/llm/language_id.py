"""Operator 3: language mixtures of documents.

Each language has a model of byte trigrams (ASCII lower-cased), hashed to a fixed table and smoothed. A document is a mixture
of languages: expectation-maximisation finds the proportions that explain its trigrams. The set of languages is selected by
penalised likelihood: starting with the most likely single language, the language with the next largest share is added as
long as the log-likelihood rises by more than the penalty of one more proportion. The prediction is the largest share.

Scale: training is one pass that counts per task and adds the counts by key (at most languages x 65,536 keys); the model is
broadcast, languages x 256 KB, with at most `MAX_LANGUAGES` languages (more are refused). Prediction is one pass without a
shuffle. A worker holds 2 MB of text and one long text's distinct trigrams at a time.

Cases: a text that is null or has no letter is `und` with score 0. A text of one or two bytes has no trigram: all languages are
equally likely, the first by name is predicted and its share is the score. Repeated rows are judged each; very long texts as a
whole. Columns other than doc_id, text and lang are neither read nor returned. Rows with a null lang or text teach nothing. A null doc_id
is not held out and teaches nothing. Without any training rows all texts are `und`. Ties go to the first language by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, kernels

TABLE = 1 << 16
MAX_LANGUAGES = 256
STEPS = 12
#: Log-likelihood that one more language has to add, for each log of the number of trigrams (0.5 is the usual BIC value).
PENALTY = 2.0


def grams(data: np.ndarray) -> np.ndarray:
    """The table cell of the trigram that starts at each byte."""
    x = kernels.LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)) & np.uint32(TABLE - 1)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the log-probabilities of the table's cells for each."""

    def count(batches):
        total: dict[str, np.ndarray] = {}  # at most MAX_LANGUAGES tables, else the key's own rows are sent on
        for batch in kernels.parts(batches):
            langs = np.array(batch.column(1).to_pylist(), object)
            for row, to, data, offs in kernels.chunks(batch.column(0)):
                cell = grams(data)
                last = np.searchsorted(offs, np.arange(len(cell)), "right")  # trigrams over a text's end are not counted
                inside = np.arange(len(cell)) + 3 <= offs[last]
                own = langs[row:to][last - 1]
                for lang in set(langs[row:to]):
                    n = np.bincount(cell[inside & (own == lang)], minlength=TABLE)
                    total[lang] = total[lang] + n if lang in total else n
            if len(total) > MAX_LANGUAGES:
                yield from map(rows, total.items())
                total.clear()
        yield from map(rows, total.items())

    def rows(found):
        lang, n = found
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "cell", "n"])

    counts = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))

    def table(own: pa.Table) -> pa.Table:
        n = np.full(TABLE, 0.5)
        n[own.column("cell").to_numpy()] += own.column("n").to_numpy()
        return pa.table({"lang": own.column("lang")[:1], "logs": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    found = counts.groupBy("lang").applyInArrow(table, "lang string, logs binary").limit(MAX_LANGUAGES + 1).collect()  # 256 KB each
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted(found, key=lambda r: r.lang)
    logs = np.frombuffer(b"".join(r.logs for r in found), np.float32).reshape(len(found), TABLE)
    return [r.lang for r in found], logs


def _em(like: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Shares of the rows of `like` (probabilities scaled by cell), and the log-likelihood relative to that scale."""
    share = np.full(len(like), 1 / len(like))
    for _ in range(steps):
        joint = share[:, None] * like
        share = (joint * (n / joint.sum(0))).sum(1)
        share /= share.sum()
    return share, float((n * np.log(share @ like)).sum())


def mixture(cells: np.ndarray, n: np.ndarray, model: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, float]]:
    """(language, share) of the selected languages, largest first; without any trigram, all languages with equal shares."""
    if n.sum() == 0:
        return [(k, 1 / len(model)) for k in range(len(model))]
    logs = model[:, cells].astype(np.float64)
    scale = logs.max(0)
    single = ((logs - scale) * n).sum(1)
    best = int(single.argmax())
    order = [best]
    like = np.exp(logs - scale)
    if len(model) > 1:
        rest, _ = _em(like, n, 4)
        order += [int(k) for k in np.argsort(-rest, kind="stable") if k != best]
    chosen, share, level = order[:1], np.ones(1), float(single[best])
    cost = penalty * np.log(max(2, n.sum()))
    for k in order[1:]:
        more, new = _em(like[[*chosen, k]], n, STEPS)
        if new - level <= cost:
            break
        chosen, share, level = [*chosen, k], more, new
    return sorted(zip(chosen, share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def predict(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, mixture (map of the selected languages' shares) from doc_id and text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        model = shared.value
        for batch in kernels.parts(batches):
            texts, pred, score, mixes = batch.column(1), [], [], []
            for row, _, data, offs in kernels.chunks(texts):
                cell = grams(data)
                for i in range(len(offs) - 1):
                    own = np.unique(cell[offs[i] : max(offs[i], offs[i + 1] - 2)], return_counts=True)
                    text = texts[row + i].as_py()
                    if not languages or not text or not any(map(str.isalpha, text)):
                        pred.append("und"), score.append(0.0), mixes.append([])
                        continue
                    shares = mixture(*own, model)
                    pred.append(languages[shares[0][0]]), score.append(min(1.0, shares[0][1])), mixes.append([(languages[k], s) for k, s in shares])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = predict(docs, *train(docs.filter(fold != 0)))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
