"""Models with a character map and unigram scores, put together here by hand, against the library."""

import random
import struct

import pytest
import sentencepiece

from jsonweave.llm.piece_fst import MARK, Arcs, Normaliser, Transducer, _fields


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def charsmap(rule):
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return dict(_fields(dict(_fields(proto))[3]))[2]


def model(pieces, fallback, rule=None, squeeze=True, prefix=True, own=()):
    """Bytes of a unigram model: unknown 0, begin 1, end 2, bytes, pieces."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback), *((p, s, 1) for p, s in pieces), *((p, 0.0, 4) for p in own)]
    out = b"".join(field(1, field(1, p) + field(2, float(s)) + field(3, k)) for p, s, k in rows)
    out += field(2, field(3, 1) + field(4, len(rows)) + field(35, int(fallback)))
    return out + field(3, field(1, "own") + (field(2, charsmap(rule)) if rule else b"") + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))


def pieces(r):
    found = {MARK: -3.0, **{c: -6.0 - r.random() for c in "abcdefgh1é"}}
    for _ in range(60):
        w = "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 5)))
        found[r.choice(["", MARK]) + w] = -r.uniform(2, 9)
    return sorted(found.items())


TEXTS = ["", " ", "abc", "  ab  cd  ", "a\tb\nc", "ＡＢＣ ｆｕｌｌ", "ﬁne ½ ①", "é é", "x​y­", "漢字 が", "ab<tag>cd <tag>", "😀😀 zz😀", " a　b", "a" * 300, "ﷺ", "▁a ▁▁b", "hhhgggfff" * 20, "a\x00b\x7f", "c▁", "▁", "a ▁ ", "▁ a"]


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize(("fallback", "squeeze", "prefix"), [(True, True, True), (False, True, False), (True, False, True)])
def test_unigram_models_give_the_librarys_ids(rule, fallback, squeeze, prefix):
    r = random.Random(f"{rule}{fallback}")
    raw = model(pieces(r), fallback, rule, squeeze, prefix, own=["<tag>"])
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), Transducer(raw)
    import numpy as np

    texts = TEXTS + ["".join(r.choice("aabbccdefgh  é1zＡ①") for _ in range(r.randrange(60))) for _ in range(60)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == library.encode(t), repr(t)
    assert own.encode(None) == b""


def test_normaliser_and_arcs_are_transducers():
    n = Normaliser(charsmap("nmt_nfkc"), True, True)
    assert n.states > 5000 and n("ﬁ ﬀ") == f"{MARK}fi{MARK}ff" and Normaliser(b"", True, True)("ﬁ") == MARK + "ﬁ"
    a = Arcs({"ab": (1, 0.5), "abc": (2, 1.5), "b": (3, 1.0)})
    assert list(a.paths("abcd", 0)) == [(2, 1, 0.5), (3, 2, 1.5)] and list(a.paths("abcd", 1)) == [(2, 3, 1.0)]
    assert sum(map(len, a.next)) == 4 and sum(e is not None for e in a.ends) == 3


def test_decoding():
    raw = model([(MARK, -3.0), ("ab", -1.0), (MARK + "ab", -1.0), ("c", -2.0)], True)
    own, library = Transducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in ("ab c", "abcé ab", "c▁"):
        assert own.decode(own.encode(t)) == library.decode(library.encode(t))
