"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every n-gram of 1 to 3 lower-cased characters falls into one of 65,536 buckets.
Training counts buckets by language on a bounded, stratified sample (about ``per_lang``
documents of each language, picked by a hash of id and text; whole texts). The
log-probability matrix (buckets x languages) is broadcast; a task turns a block of
documents into a sparse matrix of bucket ids (row pointers and indices) and adds up
the matrix rows that each document points to, in numpy.

Defined results: a null or empty text or one without a letter gives ``und`` and score 0; an
empty training set gives ``und`` for all; ties go to the language that comes first
by code point; a text of any length is read whole, in slices; repeated rows each get a row; a null id
isn't held out; no rows give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import crc_fold, few_rows

_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Characters of one text that are looked at together; longer texts come in overlapping slices.
SLICE = 1 << 19


@dataclass
class LangModel:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16


def gram_buckets(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index of each run, bucket ids, run starts) of blocks of n-grams, as (rows, starts, ids)."""
    block: list[tuple[int, str, int]] = []
    held = 0
    for i, text in enumerate(texts):
        low, most = text.lower(), max(orders)
        for at in range(0, len(low), SLICE):
            block.append((i, low[at : at + SLICE + most - 1], SLICE))
            held += len(block[-1][1])
            if held >= 2 * SLICE:
                yield from _block(block, orders, bits)
                block, held = [], 0
    if block:
        yield from _block(block, orders, bits)


def _block(block: list[tuple[int, str, int]], orders: tuple[int, ...], bits: int):
    code = np.frombuffer("".join(x[1] for x in block).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(x[1]) for x in block])
    end = np.cumsum(size)
    first = end - size
    owner = np.repeat(np.arange(len(block)), size)
    last, limit = end[owner], (first + np.array([x[2] for x in block]))[owner]
    rows, at = np.array([x[0] for x in block]), np.arange(len(code))
    h = code
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1] * _STEP + code[n - 1 :]
        if n not in orders or not len(h):
            continue
        m = len(h)
        good = (at[:m] + n <= last[:m]) & (at[:m] < limit[:m])
        ids = ((h + np.uint32(n)) * _MIX >> np.uint32(32 - bits))[good]
        per = np.bincount(owner[:m][good], minlength=len(block))
        some = per > 0
        yield rows[some], (np.cumsum(per) - per)[some], ids


def fit(labelled: DataFrame, id_col: str = "doc_id", per_lang: int = 2000, orders=(1, 2, 3), bits: int = 16, alpha: float = 0.5, matrix_mb: int = 100) -> LangModel:
    """Learn from (id, text, lang). ``matrix_mb`` bounds the broadcast matrix: with so many languages that
    it would be larger, there are fewer buckets."""
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    while 4 * len(langs) << bits > matrix_mb << 20 and bits > 8:
        bits -= 1
    if not langs:
        return LangModel([], np.zeros(0), np.zeros((1 << bits, 0), np.float32), tuple(orders), bits)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, per_lang / totals[lang])]), F.col("lang"))
    picked = F.pmod(F.xxhash64(id_col, "text"), F.lit(1 << 30)) < share * (1 << 30)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        for part in few_rows(parts, 1024):
            names = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in set(names):
                own = acc.setdefault(lang, np.zeros(1 << bits, np.int64))
                for _, _, ids in gram_buckets([t for t, x in zip(texts, names) if x == lang], orders, bits):
                    own += np.bincount(ids, minlength=1 << bits)
        for lang, own in acc.items():
            b = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(b), pa.string()), "bucket": pa.array(b, pa.int32()), "n": pa.array(own[b], pa.int64())})

    found = labelled.where(picked).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << bits, len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    counts[found.column("bucket").to_numpy(), [where[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    prob = np.log((counts + alpha) / (counts.sum(0) + alpha * len(counts)))
    prior = np.array([totals[x] for x in langs], float)
    return LangModel(langs, np.log(prior / prior.sum()), prob.astype(np.float32), tuple(orders), bits)


def score_texts(texts: list[str], model: LangModel) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language and its posterior probability, for each text."""
    total = np.tile(model.log_prior, (len(texts), 1))
    for rows, starts, ids in gram_buckets(texts, model.orders, model.bits):
        np.add.at(total, rows, np.add.reduceat(model.log_prob[ids], starts, axis=0, dtype=np.float64))
    best = total.argmax(1)
    total -= total.max(1, keepdims=True)
    return best, 1.0 / np.exp(total).sum(1)


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """``docs`` (doc_id, text, held_out) -> doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in few_rows(parts, 1024):
            texts = part.column("text").to_pylist()
            use = [i for i, t in enumerate(texts) if t and own.langs and any(map(str.isalpha, t))]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if use:
                best, prob = score_texts([texts[i] for i in use], own)
                score[use] = prob
                for i, b in zip(use, best):
                    pred[i] = own.langs[b]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, **fit_options) -> DataFrame:
    """Fit on rows outside fold 0 of 5 and predict every row."""
    fold = crc_fold(F.col("doc_id"), 5)
    model = fit(documents.where(fold != 0).select("doc_id", "text", "lang"), **fit_options)
    return predict(documents.select("doc_id", "text", (fold == 0).alias("held_out")), model)
