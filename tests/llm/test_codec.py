import hashlib
import random

import pytest

from glyphframe.llm import piece_codec
from glyphframe.llm.queries import op6_piece_codec, piece_model


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def held(library, texts):
    codec = piece_codec.Codec(piece_model())
    for text, parts, ids in zip(texts, codec.encode(texts), library.encode(texts, num_threads=1), strict=True):
        assert "".join(p[0] for p in parts)[:-1] == ",".join(map(str, ids)), text[:80]
        assert b"".join(p[1] for p in parts).removeprefix(b" ").decode() == library.decode(ids), text[:80]
        assert piece_codec.decode_ids(codec.table, ids) == library.decode(ids)


def test_edges(library):
    held(library, ["", " ", "  ", "\n", "\n\n a", " a ", "▁a", "a▁▁b  c", "日本語 😀😀", "a" * 3000, "ab" * 500, "\0\t\r\x0b", "<s></s><unk><0x41>", " " * 40 + "y" + " " * 33, "== ---- ////", "a \nb", "a\n b", "ﬁ ＡＢ é"])


def test_random_texts(library):
    rng = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for alphabet in ("ab", "aeinrst ", " \n=-\té.", "thetinger ") for _ in range(400)]
    held(library, texts)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBER", 3)
    codec = piece_codec.Codec(piece_model())
    for _ in range(3):
        for text in ("one two three four five", "five four six", "one"):
            assert "".join(p[0] for p in codec.encode([text])[0])[:-1] == ",".join(map(str, library.encode(text)))
    assert len(codec.recent) + len(codec.older) < 20


def test_documents(spark, library, odd_docs, no_docs):
    rows = piece_codec.encode_documents(odd_docs, piece_model(), outputs=("n_tokens", "ids", "decoded")).collect()
    assert len(rows) == odd_docs.count()
    for row, text in zip(rows, [r.text for r in odd_docs.collect()], strict=True):
        assert row.ids == library.encode(text or "") and row.n_tokens == len(row.ids) and row.decoded == library.decode(row.ids)
    assert piece_codec.encode_documents(no_docs, piece_model()).count() == 0


def test_query_round_trips(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_piece_codec(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
