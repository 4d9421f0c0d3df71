import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from jsonweave.llm import queries

TEXTS = ["a <|endoftext|> b and more", "a  <|endoftext|>", "x<|endoftext|>\n\n y  z", "<|endoftext|>", "<|endof text|> b", "b and more a", "", None]


def test_ids_are_those_of_the_library_untouched(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in TEXTS]
    want = [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    assert 50256 in ids[0]
    for got in (queries.op6_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in got.collect()) == want


def test_plain_pieces_by_ranks_give_the_librarys_ids():
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from jsonweave.llm.tokens import Pieces

    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    own, library = Pieces(path, plain=False), Tokenizer.from_file(path)
    assert own.quick is not None and Pieces(public_tokenizers.path("word_bpe_49k.json")).quick is None
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéèüßøłžıſ.,;:!?\n 's1ª漢"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(100))) for _ in range(1500)] + [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9))) for _ in range(40)) for _ in range(200)]
    for i in range(0, len(texts), 100):
        for t, ids in zip(texts[i : i + 100], own.encode(texts[i : i + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
