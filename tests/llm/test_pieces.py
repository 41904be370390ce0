import hashlib
import struct

import numpy as np
import pytest

from treeline.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", " ", "a", "  two  spaces ", "\n\t x\r\n", "日本語 ▁ mark", "<s> </s> <unk> <0x0A>", "é́ 🙂🙂  ", "a▁b ▁▁c", "x" * 3000, "İstanbul", "The quick brown fox, isn't it? 12345 " * 50, "\u00a0nbsp\u2003em", "\x00\x01"]


@pytest.fixture(scope="module")
def enc():
    return pieces.Encoder(pieces.model_path())


def test_spec(enc):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert len(enc.spec.pieces) == sp.get_piece_size()
    for i in (0, 1, 2, 3, 258, 259, 1000, 31999):
        assert enc.spec.pieces[i][0] == sp.id_to_piece(i) and abs(enc.spec.pieces[i][1] - sp.get_score(i)) < 1e-6
    assert enc.spec.byte_fallback


def documents():
    import pyarrow.parquet as pq

    from tests.conftest import DATA

    return [x or "" for x in pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column(0).to_pylist()]


def check_parity(enc, texts):
    """Ids, normal form and decoding of whole raw texts are those of the library."""
    for t, (ids, parity), normal in zip(texts, enc.encode_batch(texts), enc.normal(texts), strict=True):
        assert ids.tolist() == enc.other.encode(t) and parity, repr(t[:40])
        assert enc.normalise(t) == enc.other.normalize(t), repr(t[:40])
        back = enc.decode(ids)
        if len(ids):
            assert back == enc.other.decode(ids.tolist()), repr(t[:40])
        if 0 not in ids:  # unknown characters have no piece of their own
            assert back == normal


def test_parity_with_the_library(enc):
    check_parity(enc, TEXTS)
    check_parity(enc, documents())


def unigram(path, byte_fallback):
    """A unigram model file over the pieces of the installed one, scored by their ranks."""
    spec = pieces.Encoder(pieces.model_path()).spec
    kept = [p for p in spec.pieces if p[2] == pieces.NORMAL or p[2] != pieces.BYTE or byte_fallback]
    words = [(p, -2 - len(kept) ** 0.25 * np.log1p(i) / 9 if k == pieces.NORMAL else 0.0, k) for i, (p, _, k) in enumerate(kept)]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, float(np.float32(s))) + field(3, k)) for p, s, k in words)
    raw += field(2, field(3, 1) + field(35, int(byte_fallback)) + field(40, 0)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path.write_bytes(raw)
    return pieces.Encoder(str(path))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_parity_with_the_library(tmp_path, byte_fallback):
    enc = unigram(tmp_path / "unigram.model", byte_fallback)
    assert enc.spec.model_type == 1 and enc.spec.byte_fallback == byte_fallback
    check_parity(enc, [t for t in TEXTS if t != "x" * 3000])  # of readings with equal scores either may be chosen
    # Elsewhere they may differ between readings that are as good (or nearly, as the library adds up in 32 bits).
    texts = sorted({x for t in documents() for x in t.split("\n")}) + documents()
    score = lambda ids: sum(map(enc.other.get_score, ids))
    equal = 0
    for (ids, parity), theirs in zip(enc.encode_batch(texts), enc.other.encode(texts), strict=True):
        assert parity == (ids.tolist() == theirs)
        assert abs(score(ids.tolist()) - score(theirs)) < 1e-6 * len(ids) ** 2 + 1e-3
        equal += parity
    assert equal > 0.9 * len(texts)


def test_a_mismatch_is_reported():
    enc = pieces.Encoder(pieces.model_path())
    enc.other = type("Broken", (), {"encode": lambda self, ws, num_threads: [[1]] * len(ws)})()
    assert enc.encode_batch(["some words"])[0][1] is False


def field(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model_chooses_the_best_scores():
    words = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.0, 1), ("a", -4.0, 1), ("abb", -9.0, 1), ("bb", -2.5, 1)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in words)
    raw += field(2, field(3, 1) + field(35, 1) + field(40, 0)) + field(3, field(3, 1) + field(4, 1) + field(5, 1))
    spec = pieces.Spec(raw)
    assert spec.model_type == 1 and spec.trim_spaces and spec.pieces[2] == ("▁ab", -1.0, 1)
    tok, norm = pieces.build(spec), pieces.normalise(spec)
    assert norm("  abb   a ") == "▁abb▁a"
    ids = tok.encode(norm("abb a"), add_special_tokens=False).ids
    assert [spec.pieces[i][0] for i in ids] == ["▁ab", "b", "▁a"]
    assert len(tok.encode(norm("é"), add_special_tokens=False).ids) == 3  # marker and two bytes


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, TEXTS[3]), (77, None), (78, "word " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS parity", "2 AS id")
    got = pieces.encode(df, pieces.model_path()).collect()
    assert len(got) == len(rows) and all(r.parity and r.round_trip for r in got)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    by = {r.id: r for r in got}
    assert by[77].n_tokens == 0 and by[77].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[78].ids == sp.encode("word " * 300_000)
    assert by[5].ids_sha256 == hashlib.sha256(np.array(sp.encode(TEXTS[5]), "<u4").tobytes()).hexdigest()
    assert pieces.encode(df.limit(0), pieces.model_path()).count() == 0


def test_stage_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_IDS", 10)
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (2, "same text"), (None, None), (3, "other " * 9)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "1 AS n_tokens")
    got = pieces.stage(spark, docs, "").collect()
    by = sorted(((r.doc_id or 0, r.n_tokens, r.parity, r.round_trip) for r in got))
    assert [x[0] for x in by] == [0, 1, 2, 2, 3] and all(p and r for *_, p, r in by)
    assert by[0][1] == 0 and len({tuple(r.ids) for r in got if r.doc_id in (1, 2)}) == 1
