"""SentencePiece encoding against the library: ids, spans and decoded texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from gaugeworks.llm import pieces, queries
from tests.llm.test_operators import LONG, TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁", "a▁b", " lead", "  two  spaces ", "tail ", "\n\nlines\r\n\t tab", "nul\0nul", "日本語 テキスト 한국어", "é ﬁ Ａ　Ｂ ①", "👩‍👩‍👧 🇫🇷", "​  ﻿", "aaaa" * 300, " " * 40 + "x", "<s> </s> <unk> <0x41>", "ß" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def variant(folder, **settings):
    """A copy of the model with another normaliser, and the library over it."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    for k, v in settings.items():
        setattr(proto.normalizer_spec, k, v)
    path = f"{folder}/own.model"
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def junk(seed):
    r = random.Random(seed)
    return "".join(r.choice(("a", "e", "th", "ing", " ", " ", "  ", "\n", ".", ",", "é", "ß", "ﬁ", "▁", "\t", "日", "本", "👍", "Ａ", "́", "　", "​", "\x07", "-" * 5, "0", "1")) for _ in range(r.randint(0, 60)))


def check(model, lib, text):
    normal, of = model.normalised(text)
    ids = np.frombuffer(model.encode([normal])[0], "<u4")
    assert ids.tolist() == lib.encode(text)
    assert model.decode(ids.tolist()).decode() == lib.decode(ids.tolist())
    at = model.offsets(ids, text, normal, of)
    assert list(zip(at, at[1:], strict=False)) == [(p.begin, p.end) for p in lib.encode(text, out_type="proto").pieces]


def test_ids_spans_and_texts_of_the_given_model(library):
    model = pieces.Model(PATH)
    for text in [t or "" for t in TEXTS] + ODD + [junk(k) for k in range(1500)]:
        check(model, library, text)


@pytest.mark.parametrize("settings", [{"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"add_dummy_prefix": False, "remove_extra_whitespaces": True}, {}])
@pytest.mark.parametrize("rules", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_other_normalisers(tmp_path, settings, rules):
    own = sentencepiece.SentencePieceNormalizer(rule_name=rules)
    charsmap = sentencepiece_model_pb2.ModelProto.FromString(own.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    model, lib = variant(tmp_path, precompiled_charsmap=charsmap, **settings)
    for text in [t or "" for t in TEXTS if t is not LONG] + ODD + [junk(k) for k in range(600)]:
        check(model, lib, text)


def test_any_ids_decode_as_in_the_library(library):
    model, r = pieces.Model(PATH), random.Random(3)
    odd = [1, 2, 0, *range(3, 259), 29871, 259, 260, 29896]
    for _ in range(3000):
        ids = [r.choice(odd) if r.random() < 0.7 else r.randrange(32000) for _ in range(r.randint(0, 12))]
        assert model.decode(ids).decode() == library.decode(ids), ids


def test_pairs_merge_as_in_the_library_without_words_and_memory(library):
    model = pieces.Model(PATH)
    model.words = lambda text: [text] if text else []
    model._cut = lambda words: (words, np.arange(1, len(words) + 1))
    for text in [t or "" for t in TEXTS if t is not LONG] + ODD:
        model.known, model.parts = {}, {}
        assert np.frombuffer(model.encode([model.normalised(text)[0]])[0], "<u4").tolist() == library.encode(text)


def test_models_that_are_not_covered_are_refused(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    proto.pieces[500].type = 4
    with open(tmp_path / "user.model", "wb") as f:
        f.write(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Model(str(tmp_path / "user.model"))


def test_rows(spark, library):
    rows = [(k % 5 if k else None, t, "x", b"old") for k, t in enumerate([*TEXTS, *ODD, "again", "again"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Offsets string, ids binary").repartition(3)
    out = pieces.piece_decode(pieces.piece_encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "offsets", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        ids, at = (np.frombuffer(x, "<u4").tolist() for x in (r.ids, r.offsets))
        assert ids == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert len(at) == len(ids) + 1 and at == sorted(at) and at[0] == 0 and at[-1] == len((r.text or "").encode())
        assert bytes(r.decoded).decode() == library.decode(ids)
    same = pieces.piece_round_trip(df, PATH)
    assert same.columns == ["doc_id", "ids", "offsets", "decoded"]
    assert sorted(map(tuple, same.select("ids", "offsets", "decoded").collect())) == sorted((r.ids, r.offsets, r.decoded) for r in got)
    assert not pieces.piece_encode(df.where(F.lit(False)), PATH).collect()


def test_query(spark, library, tmp_path):
    import hashlib

    rows = [(k, t, "en", "s", 0) for k, t in enumerate([*TEXTS, *ODD])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_sentencepiece"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
