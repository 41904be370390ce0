"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here (its wire format is simple), and the same tokenizer is rebuilt:
normaliser (precompiled character map, whitespace rules, dummy prefix), the metaspace marker U+2581,
unigram scores or, for BPE models, merges in the order of their pieces' scores, and byte fallback.

Whole raw texts are encoded in multithreaded calls, and every text is verified against the
SentencePiece library: ``parity`` says whether both give the same ids, ``round_trip`` whether the ids
decode to the text as that library normalises it. Of unigram readings with equal scores (or, in long texts, nearly
equal ones, as that library adds up in 32 bits) the two may choose different ones, which parity then tells. Equal texts that a task meets soon after each other are
encoded and verified once.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table

MARK = "▁"
#: Threads of one task's encoder. A task has one core on most clusters; raise it with spark.task.cpus.
THREADS = 2
#: Characters of text encoded at once, and of ids kept for texts that come again.
CHARS = 500_000
KEPT_IDS = 2_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, 4-byte floats and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, buf[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", buf, at)[0]
            at += 4
        elif kind == 1:
            yield key >> 3, struct.unpack_from("<d", buf, at)[0]
            at += 8
        else:
            raise ValueError(f"wire type {kind}")


class Spec:
    """What of a SentencePiece model file its tokenizer needs."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.model_type, self.byte_fallback, self.unk_id = 1, False, 0
        self.charsmap, self.dummy_prefix, self.trim_spaces, self.escape = b"", True, True, True
        self.suffix_marker = False
        for number, value in fields(raw):
            if number == 1:  # a piece: text, score, kind
                p = dict(fields(value))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:  # trainer
                t = dict(fields(value))
                self.model_type, self.byte_fallback, self.unk_id = t.get(3, 1), bool(t.get(35, 0)), t.get(40, 0)
                self.suffix_marker = bool(t.get(24, 0))
            elif number == 3:  # normaliser
                n = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.trim_spaces, self.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        if self.model_type not in (1, 2) or self.suffix_marker or not self.escape:
            raise ValueError("only unigram and BPE models with a leading marker are supported")


def build(spec: Spec):
    """The tokenizer, without normaliser: it takes text in which the marker stands for spaces."""
    from tokenizers import AddedToken, Tokenizer, models

    if spec.model_type == 1:
        # Only normal and user's pieces are looked for in a text. Byte pieces keep their names, for the fallback, but
        # lose against any other reading; the rest get names of noncharacters.
        low = min((s for _, s, kind in spec.pieces if kind == NORMAL), default=0.0) - 1000
        named = {NORMAL: lambda i, p, s: (p, s), USER: lambda i, p, s: (p, s), BYTE: lambda i, p, s: (p, low)}
        vocab = [named.get(kind, lambda i, p, s: (f"\U0010ffff{i}\U0010ffff", 0.0))(i, p, s) for i, (p, s, kind) in enumerate(spec.pieces)]
        tok = Tokenizer(models.Unigram(vocab, unk_id=spec.unk_id, byte_fallback=spec.byte_fallback))
    else:
        ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
        # A piece merges from every split into two pieces; better pieces first, ties by the parts.
        merges = [(-s, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        tok = Tokenizer(models.BPE(ids, [m[3:] for m in sorted(merges)], unk_token=spec.pieces[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
    tok.add_tokens([AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER])
    return tok


def normalise(spec: Spec):
    """text -> the text that pieces are looked for in."""
    from tokenizers import normalizers

    chars = normalizers.Precompiled(spec.charsmap).normalize_str if spec.charsmap else str

    def run(text: str) -> str:
        text = chars(text)
        if spec.trim_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if spec.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    return run


class Encoder:
    def __init__(self, path: str) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as f:
            self.spec = Spec(f.read())
        self.tok = build(self.spec)
        self.normalise = normalise(self.spec)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [self._text(i, p, k) for i, (p, _, k) in enumerate(self.spec.pieces)]
        self.blob, self.size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _text(i: int, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """(ids, parity) of raw texts."""
        ours = self.tok.encode_batch_fast([self.normalise(t) for t in texts], add_special_tokens=False)
        theirs = self.other.encode(texts, num_threads=THREADS)
        return [(np.array(t, np.uint32) if (same := e.ids == t) else np.array(e.ids, np.uint32), same) for e, t in zip(ours, theirs, strict=True)]

    def decode(self, ids) -> str:
        """The text of ids, without the prefix that the normaliser put before it."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)
        text = self.blob[at].tobytes().decode("utf-8", "replace")
        return text.removeprefix(" ") if self.spec.dummy_prefix else text

    def normal(self, texts: list[str]) -> list[str]:
        """The texts as the library normalises them, in the form that ``decode`` gives."""
        out = [t.replace(MARK, " ") for t in self.other.normalize(texts)]
        return [t.removeprefix(" ") for t in out] if self.spec.dummy_prefix else out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def model_path() -> str:
    """The installed public model that the query uses by default."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``id, ids, n_tokens, ids_sha256, decoded_sha256, round_trip, parity`` of every row.

    ``path`` is a model file that every executor has. ``ids_sha256`` is over the ids as
    little-endian 32-bit numbers, ``decoded_sha256`` over the text that the ids decode to, in
    UTF-8. A null or empty text has no ids, parity and a round trip. Whole texts are encoded, a bounded
    number at a time. Rows keep their number, repeated ones too; a null id stays null; other columns are
    left out.
    """

    columns = ["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        kept: dict[bytes, tuple] = {}  # what the columns hold, by a hash of the text
        held = 0
        for whole in batches:
            texts = [t if isinstance(t, str) else "" for t in whole["text"]]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < CHARS):
                    size += len(texts[end])
                    end += 1
                if held > KEPT_IDS:
                    kept, held = {}, 0
                names = [hashlib.sha256(t.encode()).digest() for t in texts[at:end]]
                new = {k: t for k, t in zip(names, texts[at:end], strict=True) if k not in kept}
                raw = list(new.values())
                for k, (ids, parity), want in zip(new, enc.encode_batch(raw), enc.normal(raw), strict=True):
                    back = enc.decode(ids)
                    kept[k] = (ids.astype(np.int32) if keep_ids else None, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == want, parity)
                    held += len(ids) if keep_ids else 100
                yield pd.DataFrame([(i, *kept[k]) for i, k in zip(whole["id"][at:end], names, strict=True)], columns=columns)
                at = end
            release()

    schema = "id string, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return d.mapInPandas(run, schema).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path(), keep_ids=False).drop("ids").withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, in the order they have in its text. A null text has none; null ids and
    repeated rows stay as they are."""
    return encode(docs, model_path()).withColumnRenamed("id", "doc_id")
