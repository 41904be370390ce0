"""Language identification with error-correcting output codes.

Every learned language gets a codeword; each bit of it is predicted by a binary classifier on the
document's byte n-grams, and the language whose codeword the predictions fit best is chosen, each
bit weighing as much as its classifier is sure (loss-weighted decoding, with the logistic loss).
If the runner-up fits about as well, the document is flagged ambiguous.

Up to 7 languages get an exhaustive code (2^(L-1)-1 bits); beyond that the bits are drawn by a
fixed generator, ``RANDOM_BITS`` for each doubling of the number of languages.

Features are the counts of byte bigrams and trigrams of the whole lower-cased text, hashed to
``DIM`` columns, as square roots of their shares. Training uses a bounded sample: up to
``TRAIN_ROWS`` labelled documents (as many as hashes give, never twice that), shared equally among
languages and picked by a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, table

#: Columns that n-grams are hashed to: the upper 12 bits of a 32-bit product.
DIM = 4096
#: Bound of the training sample, over all languages.
TRAIN_ROWS = 2000
#: Most bytes of a document that one count table handles; longer texts are counted in pieces.
PIECE = 1 << 22
STEPS = 150
RANDOM_BITS = 10
#: Below this lead of the best language's probability over the runner-up's, a text is ambiguous.
MARGIN = 0.2
UNKNOWN = "und"
SEED = 20240229


def codewords(n: int) -> np.ndarray:
    """``n`` codewords as rows of -1 and 1; no bit is the same for all, all rows differ."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        m = 2 ** (n - 1) - 1
        cols = [[1] + [1 if (k >> i) & 1 else -1 for i in range(n - 1)] for k in range(m)]
        return np.array(cols, float).T
    rng = np.random.default_rng(SEED)
    bits = int(RANDOM_BITS * np.ceil(np.log2(n)))
    while True:
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        gaps = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if gaps.min() >= bits // 4 and (np.abs(code.sum(0)) < n).all():
            return code


def features(texts) -> np.ndarray:
    """A row of ``DIM`` features for each text; zeros for null or empty ones."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, t in zip(out, texts, strict=True):
        raw = t.lower().encode() if isinstance(t, str) else b""
        total = np.zeros(DIM)
        for at in range(0, len(raw), PIECE):
            a = np.frombuffer(raw[at : at + PIECE + 2], np.uint8).astype(np.uint32)
            if len(a) > 1:
                two = a[:-1] * 256 + a[1:]
                total += np.bincount(two[:PIECE] * np.uint32(2654435761) >> np.uint32(20), minlength=DIM)
                total += np.bincount((two[:-1] * 256 + a[2:]) * np.uint32(2246822519) >> np.uint32(20), minlength=DIM)
        if s := total.sum():
            row[:] = np.sqrt(total / s)
    return out


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic classifier a bit, all trained at once by accelerated
    gradient steps with a small quadratic penalty. Languages weigh alike."""
    share = 1 / np.bincount(y, minlength=len(code))[y]
    share = (share / share.sum())[:, None].astype(np.float32)
    goal = code[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 8.0
    for _ in range(STEPS):
        pull = -goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30))) * share
        vw = 0.9 * vw - rate * (x.T @ pull + 1e-6 * w)
        vb = 0.9 * vb - rate * pull.sum(0)
        w, b = w + vw, b + vb
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Probabilities of the languages from the bits' margins: a softmax of minus the logistic
    loss of each codeword, summed over its bits. A large margin costs much where it is wrong."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(2)
    z = np.exp(loss.min(1, keepdims=True) - loss)
    return z / z.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


class Model:
    """Learned languages (in code-point order), their codewords and the bits' classifiers, from ``rows`` documents."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray, rows: int = 0) -> None:
        self.langs, self.code, self.w, self.b, self.rows = langs, code, w, b, rows

    @classmethod
    def train(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
        """From the rows of ``docs`` with a language and a letter. Ties of the hash that picks the
        sample are broken by the text, so that reruns agree; rows repeated in full count once. Without such rows nothing is learned
        and every prediction is ``und``; with one language, it is always predicted."""
        d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
        # Hashes are even, so a language's share of them below a bound is the share of its rows.
        key = F.xxhash64(F.col("id"), F.col("text"), F.lit(SEED))
        counts = {r.lang: r for r in d.groupBy("lang").agg(F.count("*").alias("n"), F.min(key).alias("k")).collect()}  # a row a language
        langs = sorted(counts)
        if not langs:
            return cls([], np.ones((0, 1)), np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32))
        per = max(1, rows // len(langs))
        cut = F.lit(None)
        for lang, r in counts.items():  # each language has a row at least
            cut = F.when(F.col("lang") == lang, F.lit(max(r.k, min(2**63 - 1, int(2**64 * per / r.n) - 2**63)))).otherwise(cut)
        schema = "lang string, k long, h long, x binary"

        def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"lang": pdf["lang"], "k": pdf["k"], "h": pdf["h"], "x": [r.astype(np.float16).tobytes() for r in features(pdf["text"])]})
            release()

        picked = d.select("text", "lang", key.alias("k"), F.xxhash64("text").alias("h")).filter(F.col("k") <= cut).dropDuplicates(["k", "h", "lang"])
        sample = picked.mapInPandas(rows_of, schema)
        got = sample.orderBy("k", "h", "lang").limit(2 * rows).collect()  # the hard bound
        if not got:  # only if each of thousands of languages has a sample of one
            raise ValueError(f"{rows} training rows are too few for {len(langs)} languages")
        y = np.array([langs.index(r.lang) for r in got])
        x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
        del got
        code = codewords(len(langs))
        w, b = fit(x, y, code)
        del x
        release()
        return cls(langs, code, w, b, len(y))

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The columns of ``docs`` and ``lang_pred, score, ambiguous``, from the text alone.

        ``und`` with score 0, not ambiguous, for a null text or one without a letter. Score is the
        probability by decoding. Texts of any length are read whole; rows keep their number. The
        three columns replace any of the same names."""
        langs, code = np.array(self.langs, object), self.code
        known = docs.sparkSession.sparkContext.broadcast((self.w, self.b))  # DIM x bits, by the number of languages

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = known.value
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    ok = np.array(batch.column(letter).to_pylist(), bool)
                    p = decode(features(batch.column(text_col).to_pylist()) @ w + b, code)
                    best = p.argmax(1)
                    top = p.max(1)
                    p[np.arange(len(p)), best] = -1
                    lead = top - np.maximum(p.max(1), 0)
                    new = [pa.array(np.where(ok, langs[best], UNKNOWN), pa.string()), pa.array(np.where(ok, top, 0.0)), pa.array(ok & (lead < MARGIN))]
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + new, names=keep + added)
            release()

        added = ["lang_pred", "score", "ambiguous"]
        keep = [c for c in docs.columns if c not in added]
        letter = "_has_letter"
        while letter in keep:  # a name that the table doesn't have
            letter += "_"
        schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
        if not self.langs:
            return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
        return docs.select(*keep, has_letter(F.col(text_col)).alias(letter)).mapInArrow(label, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows stay as they are; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = Model.train(docs.filter(~held_out(F.col("doc_id"))))
    return model.predict(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language could be told: those predicted ``und`` go. Ambiguous ones stay,
    as clean texts that mix languages are. Rows without an id may be learned from as any others, repeated rows
    stay or go together, and an empty table gives an empty one."""
    model = Model.train(docs.filter(~held_out(F.col("doc_id"))))
    return model.predict(docs).filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
