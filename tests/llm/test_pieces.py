import random
import struct
import time

import pytest
import sentencepiece

from corpusloom.llm import pieces
from corpusloom.llm.queries import PIECE_MODEL, queries

TEXTS = ["", " ", "  a  b ", "Hello  world\nfoo\tbar é 你 \x00x", "a" * 160, " " * 101, "    x" * 7, "mississippi" * 40, "the quick brown " * 50, "한국어 gibberish 日本語テキスト 😀", "x" * 3000 + " end"]


def random_texts(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghinorst  aee-_.éçä你1234\n") for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    return pieces.model_bytes(PIECE_MODEL)


@pytest.fixture(scope="module")
def unigram(bpe):
    """The same pieces as a unigram model, scores within what single precision adds up exactly."""
    at = bpe.index(b"\x18\x02", bpe.rfind(b"tok_v0"))
    twin = bpe[:at] + b"\x18\x01" + bpe[at + 2 :]
    return twin.replace(struct.pack("<f", -1e9), struct.pack("<f", -40000.0))


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_equal_the_library(kind, request, docs):
    data = request.getfixturevalue(kind)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(data)
    for text in [*TEXTS, *random_texts(), *(r.text for r in docs.limit(60).collect())]:
        ids = list(codec.encode(text))
        assert ids == library.encode(text), text[:60]
        assert codec.decode(ids) == text


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_one_stream_over_a_text_commits_early_and_agrees(kind, request, docs):
    data = request.getfixturevalue(kind)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = pieces.Codec(data).model
    for text in [*TEXTS[3:], *random_texts(200, 2), *(r.text[:1500] for r in docs.limit(10).collect())]:
        stream, widest = pieces.Stream(model), 0
        for char in pieces.MARK + text.replace(" ", pieces.MARK):
            stream.feed(char)
            widest = max(widest, len(stream.window))
        assert list(stream.close()) == library.encode(text)
        if " " * 20 not in text and "aaaa" not in text and "xxxx" not in text:
            assert widest <= 4 * model.longest, text[:40]


def test_every_run_goes_through_the_stream(bpe, docs, monkeypatch):
    """Each distinct run is searched once, by the streaming search, whatever its length."""
    fed = []

    class Counted(pieces.Stream):
        def close(self):
            fed.append(self.fed)
            return super().close()

    monkeypatch.setattr(pieces, "Stream", Counted)
    texts = [r.text for r in docs.limit(80).collect()] + ["y" * 70 + " " + "z" * 5000]
    codec = pieces.Codec(bpe)
    for text in texts:
        codec.encode(text)
    runs = {w for t in texts for w in t.replace("  ", " ").split(" ")}
    assert len(fed) >= len(runs) - 2 and {71, 5001} <= set(fed)


def test_long_runs_take_time_in_proportion(bpe):
    """Runs without a blank: known pieces, and characters that no piece has."""
    codec, library = pieces.Codec(bpe), sentencepiece.SentencePieceProcessor(model_proto=bpe)
    rng = random.Random(3)
    for alphabet in ("abcdefgh0123456789+/", "𝔸𝔹ℂ😀", "a😀"):
        text = "".join(rng.choice(alphabet) for _ in range(200_000))
        began = time.process_time()
        ids = codec.encode(text)
        assert time.process_time() - began < 20
        assert list(ids) == library.encode(text)


def test_query_round_trips(spark, sf, docs):
    rows = queries()["op2_sentencepiece"](spark, sf).collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)


def test_decode_operator_and_edges(spark, bpe, edge_docs, no_docs):
    coded = pieces.encode(edge_docs, bpe)
    assert coded.columns.count("ids") == 1
    back = pieces.decode(coded.withColumnRenamed("text", "original"), bpe).collect()
    assert len(back) == edge_docs.count()
    assert all(r.text == r.original for r in back)
    assert [r.ids for r in back if r.doc_id == 3] == [[]] and [r.ids for r in back if r.doc_id == 2] == [None]
    assert pieces.encode(no_docs, bpe).count() == 0


def test_the_mark_itself_reads_as_a_space(bpe):
    codec = pieces.Codec(bpe)
    assert codec.decode(codec.encode("a▁b")) == "a b"
