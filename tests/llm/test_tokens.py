import random
import zlib

import numpy as np
import pytest

from llm.conftest import ODD, sample
from repoloom.llm import common, pieces, token_files
from repoloom.llm.queries import tokenizer_path

BPE, MODEL = (tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def texts_of(spark):
    rand = random.Random(3)
    odd = "".join(rand.choice("abe ▁\n\t é🙂'sll<|endoftext|>\x1c\xa0") for _ in range(900))
    return [(r.doc_id, r.text) for r in sample(spark).collect()] + ODD + [(8000, odd), (8001, "  a\n\n b \n")]


def test_files_hold_the_tokenizers_ids(spark, documents):
    from tokenizers import Tokenizer

    rows = texts_of(spark)
    folder = common.new_folder(spark, "test")
    manifest = token_files.write_tokens(documents(rows), folder, BPE, 2)
    got = token_files.read_tokens(manifest, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BPE)
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        want.append((doc_id, start, len(ids), crc))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert {r.width for r in manifest.collect()} == {2}


def test_files_of_an_empty_table(spark, documents):
    folder = common.new_folder(spark, "test")
    manifest = token_files.write_tokens(documents([]), folder, BPE, 2)
    assert token_files.read_tokens(manifest, folder).count() == 0


def unigram():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    normal = [p for p in proto.pieces if p.type in (1, 4)]
    for p, score in zip(normal, pieces.zipf_scores(len(normal)), strict=True):
        p.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), proto


def weight(proto, ids):
    return sum(proto.pieces[i].score for i in ids if proto.pieces[i].type == 1)


def test_segmentations_are_as_heavy_as_the_librarys(spark):
    library, proto = unigram()
    model = pieces.Pieces.of(MODEL)
    same = 0
    texts = [t or "" for _, t in texts_of(spark)]
    for text in texts:
        coded = model.encode([model.prepared(text)])[0]
        own = np.frombuffer(coded, "<u4").tolist()
        other = library.encode(text)
        assert weight(proto, own) == pytest.approx(weight(proto, other), rel=1e-5)
        assert model.decode(coded) == text.replace("▁", " ")
        same += own == other
    assert same >= 0.9 * len(texts)  # the others tie


def test_chunks_combine_to_the_whole(spark):
    model = pieces.Pieces.of(MODEL)
    for _, text in texts_of(spark)[-16:]:
        text = (text or "")[:2000]
        for size in (17, 64, 333):
            starts = range(0, len(text), size)
            parts = [(text[a : a + size + model.reach - 1], min(size, len(text) - a)) for a in starts]
            if not parts:
                continue
            matrices = [model.matrix(*p) for p in parts]
            assert all((m == model._matrix(*p)).all() for m, p in zip(matrices, parts, strict=True))
            total = matrices[0]
            for m in matrices[1:]:
                total = pieces.product(total, m)
            heaviest = lambda x: next(model.solve([x.replace(" ", "▁")]))[1]
            best = heaviest(text)
            assert total[0, 0] == best
            ways = pieces.between(matrices, 0, 0)
            spans = [t[i : n + j] for (t, n), (i, j) in zip(parts, ways, strict=True)]
            assert "".join(spans) == text
            assert sum(heaviest(x) for x in spans) == best


def test_encoding_round_trips_through_the_tree(spark, documents, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 100)
    monkeypatch.setattr(pieces, "FAN", 4)
    rows = texts_of(spark)
    encoded = pieces.encode(documents(rows), MODEL)
    got = encoded.select("doc_id", pieces.decode(encoded["ids"], MODEL).alias("text"), "ids").collect()
    want = sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == want
    model = pieces.Pieces.of(MODEL)
    _, proto = unigram()
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        whole = np.frombuffer(model.encode([model.prepared(r.text)])[0], "<u4").tolist()
        assert weight(proto, ids) == pytest.approx(weight(proto, whole), rel=1e-6)


@pytest.mark.parametrize("chunk", [100, 1 << 16])
def test_summaries_are_those_of_the_ids(spark, documents, monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    rows = documents(texts_of(spark))
    want = []
    for r in pieces.encode(rows, MODEL).collect():
        text = pieces.Decoder.of(MODEL).decode(r.ids)
        want.append((r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids), len(text), zlib.crc32(text.encode())))
    got = [tuple(r) for r in pieces.summary(rows, MODEL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_encoding_of_an_empty_table(documents):
    assert pieces.summary(documents([]), MODEL).count() == 0
    assert pieces.encode(documents([]), MODEL).count() == 0
