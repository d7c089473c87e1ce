"""SentencePiece encoding with byte spans in the original text, and decoding.

The model's segmentation comes from its own library. Beside it the text is
normalised here as the model prescribes: at each place the longest prefix found
in the compiled character map (a double-array trie) is replaced, every byte of
the result remembers the original byte it came from, and the pieces, laid end to
end over the normalised bytes, are projected through that alignment to spans of
the original UTF-8 bytes. The piece lengths must add up to the normalised text,
else the task fails.

Defined cases: a null text counts as empty and has no pieces but the end mark;
an end mark has an empty span at the end of the text; rows are handled one by
one, so ties, repeated rows and empty tables need no rule; columns other than
key and text are not looked at. Texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbatch import slices

SPACE = "▁".encode()


class CharacterMap:
    """A compiled character map: longest-prefix replacement by a double-array trie."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.strings = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes matched at a place (0: none) and what replaces them."""
        units, found = self.units, (0, b"")
        if not units:
            return found
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                begin = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[begin:self.strings.index(b"\0", begin)])
        return found


class Normaliser:
    """Normalisation with the source of every byte, as the model's specification says."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def align(self, data: bytes) -> np.ndarray:
        """For each normalised byte, and for the end, the original byte it stems from."""
        if not data:
            return np.zeros(1, np.int64)
        if self.map or self.squeeze:
            return self._spelled(data)[1]
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 0x20, len(SPACE) if self.escape else 1, 1)
        head = np.zeros((len(SPACE) if self.escape else 1) if self.prefix else 0, np.int64)
        return np.concatenate([head, np.repeat(np.arange(len(raw)), width), [len(raw)]])

    def normalise(self, data: bytes) -> bytes:
        return self._spelled(data)[0] if data else b""

    def _spelled(self, data: bytes) -> tuple[bytes, np.ndarray]:
        chars: list[tuple[bytes, int, int]] = []  # text, source, and 1 where its bytes are the source's own
        at = 0
        while at < len(data):
            used, to = self.map.longest(data, at)
            own = 0 if used else 1
            if not used:
                first = data[at]
                used = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                to = data[at:at + used]
            chars.append((to, at, own))
            at += used
        out, source, end = bytearray(), [], len(data)
        space = SPACE if self.escape else b" "
        if self.squeeze:
            while chars and chars[0][0] in (b"", b" "):
                chars.pop(0)
            while chars and chars[-1][0] in (b"", b" "):
                end = chars.pop()[1]
        if not chars:
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            out += space
            source += [chars[0][1]] * len(space)
        was_space = self.squeeze
        for to, begin, own in chars:
            text = to.lstrip(b" ") if was_space else to
            for k, byte in enumerate(text):
                piece = space if byte == 0x20 else bytes([byte])
                out += piece
                source += [begin + k * own] * len(piece)
            if text:
                was_space = self.squeeze and text.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space):], source[-len(space):]
        return bytes(out), np.array([*source, end], np.int64)


class Model:
    """A model file: the library's processor, the normaliser and the width of every piece."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.normaliser = Normaliser(proto.normalizer_spec)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.width = np.array([0 if p.type == kinds.CONTROL else 1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), -1)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of every piece."""
        width = self.width[ids]
        if self.unknown in ids:
            surface = self.processor.encode(text, out_type=str)
            at = np.flatnonzero(ids == self.unknown)
            width[at] = [len(surface[i].encode()) for i in at]
        source = self.normaliser.align(text.encode())
        ends = np.cumsum(width)
        if (ends[-1] if len(ends) else 0) != len(source) - 1:
            raise ValueError("pieces and normalised text differ in length")
        return source[ends - width], source[ends]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """One model a Python worker."""
    return Model(path)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", add_end: bool = True) -> DataFrame:
    """Per document: key, ids, and the byte spans ``begins`` and ``ends`` of its pieces."""
    docs = docs.select(F.col(key), F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(start, stop - start).to_pylist()]
                ids = [np.array(x, np.int32) for x in model.processor.encode(texts, add_eos=add_end, num_threads=1)]
                spans = [model.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = [ids, [s[0] for s in spans], [s[1] for s in spans]]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in flat]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *lists], [key, "ids", "begins", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The other columns of ``encoded``, and the decoded text in place of ``ids``."""
    others = [c for c in encoded.columns if c != ids]
    encoded = encoded.select(*others, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model_path).processor
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = processor.decode([x or [] for x in part.column(len(others)).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*others, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields[:-1])
    return encoded.mapInArrow(run, f"{schema}, `{out}` string")
