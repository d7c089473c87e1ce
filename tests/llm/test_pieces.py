"""Encoding against the library, spans against its own offsets, and the compiled map."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import sentencepiece
from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "  two  spaces ", "Hello world", "naïve Straße 日本語 🙂 x", "a\nb\tc\r\n", "</s> <s> <unk> ▁▁x", "e\u0301 \u00a0\u3000", "\x00\x01", "word " * 3000]


def test_ids_spans_and_decoding(spark, table_of):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = pieces.encode(table_of([(i, t, 1) for i, t in enumerate(TEXTS)]), PATH)
    rows = {r["doc_id"]: r for r in got.collect()}
    decoded = {r["doc_id"]: r["decoded"] for r in pieces.decode(got, PATH).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        ids = library.encode(text, add_eos=True)
        assert rows[i]["ids"] == ids and decoded[i] == library.decode(ids)
        data, begins, ends = text.encode(), rows[i]["begins"], rows[i]["ends"]
        assert begins == sorted(begins) and all(a <= b for a, b in zip(begins, ends, strict=True))
        assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data
        assert (begins[-1], ends[-1]) == (len(data), len(data))
        proto = library.encode(text, return_type="proto")
        for piece, a, b in zip(proto.pieces, begins, ends, strict=False):
            if not piece.piece.startswith("<0x"):
                assert (piece.begin, piece.end) == (a, b)
    assert pieces.encode(table_of([]), PATH).collect() == []


class Spec:
    def __init__(self, charsmap, prefix=True, squeeze=False, escape=True):
        self.precompiled_charsmap, self.add_dummy_prefix, self.remove_extra_whitespaces, self.escape_whitespaces = charsmap, prefix, squeeze, escape


def compiled(mapping):
    """A compiled character map of a few entries, as a double array whose children sit at free blocks of 256."""
    tree = {}
    for key, value in mapping.items():
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = value
    strings, starts = bytearray(), {}
    for value in mapping.values():
        starts.setdefault(value, len(strings)) if value in starts else starts.update({value: len(strings)})
        strings += value + b"\0"
    units, free = {}, [1]

    def place(at, node, label):
        base = free[0] * 256
        free[0] += 1
        offset = at ^ base
        short = offset < 1 << 21
        units[at] = label | (0x100 if None in node else 0) | ((offset << 10) if short else ((offset >> 8) << 10 | 0x200))
        if None in node:
            units[base] = 0x80000000 | starts[node[None]]
        for byte, child in node.items():
            if byte is not None:
                place(base ^ byte, child, byte)

    place(0, tree, 0)
    array = np.zeros(free[0] * 256, "<u4")
    for at, unit in units.items():
        array[at] = unit
    return len(array.tobytes()).to_bytes(4, "little") + array.tobytes() + bytes(strings)


def test_longest_prefix_and_alignment():
    mapping = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "é".encode(): b"e", b"q": b"", "\u3000".encode(): b" "}
    held = pieces.CharacterMap(compiled(mapping))
    assert held.longest(b"abcd", 0) == (3, b"YZ") and held.longest(b"abd", 0) == (2, b"X") and held.longest(b"zab", 0) == (0, b"") and held.longest(b"a", 0) == (0, b"")
    data = "ﬁabc éq\u3000z".encode()
    normal = pieces.Normaliser(Spec(compiled(mapping), prefix=False))
    assert normal.normalise(data) == "fiYZ▁e▁z".encode()
    assert normal.align(data).tolist() == [0, 0, 3, 3, 6, 6, 6, 7, 10, 10, 10, 13, 14]
    squeezed = pieces.Normaliser(Spec(compiled(mapping), squeeze=True))
    assert squeezed.normalise(b"  a  b  ") == "▁a▁b".encode() and squeezed.align(b"  a  b  ").tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]
    assert squeezed.normalise(b"   ") == b"" and squeezed.align(b"   ").tolist() == [0]


def test_plain_models_align_like_the_spelled_way():
    fast, slow = pieces.Normaliser(Spec(b"")), pieces.Normaliser(Spec(b""))
    for text in TEXTS:
        data = (text or "").encode()
        if data:
            assert fast.align(data).tolist() == slow._spelled(data)[1].tolist()
