"""SentencePiece encoding with source offsets, and decoding.

Normalisation takes, at each byte, the longest prefix that the model's compiled character map holds and records for
each byte it writes where in the source it came from. The pieces that the library gives are then laid over the
normalised bytes, and each is projected to the byte span of the original text that it stands for.

Defined results: a null text is an empty one; the begin and end ids stand for an empty span; repeated rows each get
their row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, need
from tidemark.llm.segments import Remembered, split_before_breaks

SPACE = "▁"
_encoders: dict[str, PieceEncoder] = {}


class CharacterMap:
    """The compiled character map of a model: a double-array trie and the strings its values point to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of source[at:], and what it becomes."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        node ^= self._offset(units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(units) or (units[node] & 0x800000FF) != source[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i - at + 1, self.strings[value : self.strings.index(b"\0", value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


def normalise(source: bytes, chars: CharacterMap, dummy_prefix: bool, trim: bool, escape: bool) -> tuple[bytes, np.ndarray]:
    """The normalised bytes and, for each of them and one past the end, its place in source."""
    mark = SPACE.encode() if escape else b" "
    out, where, at = bytearray(), [], 0
    pieces: list[tuple[int, int, bytes]] = []
    while at < len(source):
        hit = chars.longest(source, at)
        if hit is None:
            first = source[at]
            n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            hit = (n, source[at : at + n])
        pieces.append((at, at + hit[0], hit[1]))
        at += hit[0]
    if trim:
        while pieces and not pieces[0][2].strip(b" "):
            pieces.pop(0)
        if not pieces:
            return b"", np.array([len(source)], np.int64)
    if dummy_prefix and pieces:
        out += mark
        where += [pieces[0][0]] * len(mark)
    spaced = trim
    for begin, _, text in pieces:
        unchanged = source[begin : begin + len(text)] == text  # its bytes stand for themselves one by one
        for k, byte in enumerate(text):
            if byte == 32 and trim and spaced:
                continue
            new = mark if byte == 32 else bytes([byte])
            out += new
            where += [begin + k * unchanged] * len(new)
            spaced = byte == 32
    end = pieces[-1][1] if pieces else len(source)
    if trim:
        while out.endswith(mark):
            end = where[len(out) - len(mark)]
            del out[-len(mark) :], where[-len(mark) :]
    return bytes(out), np.array([*where, end], np.int64)


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        spec = model.normalizer_spec
        self.chars = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.identity = not spec.precompiled_charsmap and not self.trim and self.escape and self.dummy
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        is_byte = np.array([self.sp.is_byte(i) for i in range(len(names))])
        special = np.array([self.sp.is_control(i) or self.sp.is_unknown(i) for i in range(len(names))])
        #: Bytes of normalised text that a piece covers, and characters of white space among them.
        self.covers = np.where(special, 0, np.where(is_byte, 1, [len(n.encode()) for n in names])).astype(np.int64)
        self.spaces = np.where(special | is_byte, 0, [n.count(SPACE) for n in names]).astype(np.int64)
        # A text may be cut before a space where no piece has a space after something else, and around a line feed
        # where no piece holds one; merges, which only ever make pieces, then never cross such a cut.
        def crosses(n: str) -> bool:
            return SPACE in n.lstrip(SPACE) or "\n" in n

        user = any(p.type == 4 for p in model.pieces)
        self.cuttable = self.identity and model.trainer_spec.model_type == 2 and not user and not self.sp.is_unknown(self.sp.piece_to_id("<0x0A>")) and not any(map(crosses, names))
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.known = Remembered(self._part, 250_000)
        self.lone = self.sp.piece_to_id(SPACE)

    def _part(self, part: str) -> bytes:
        """Ids of a part after a space, which the dummy prefix stands for; a part that begins with a line feed has
        none before it, and its prefix goes."""
        ids = self.sp.encode(part)
        if part[0] == "\n":
            if ids[0] != self.lone:
                raise ValueError("the prefix is no piece of its own")
            ids = ids[1:]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids without begin and end. A text that holds the mark itself has spaces in runs or at ends where none show,
        and takes the library's whole way."""
        parts = split_before_breaks(text) if self.cuttable and SPACE not in text else None
        if parts is None or parts[0][0] == "\n":
            return np.array(self.sp.encode(text), "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the bytes of text."""
        if self.identity and SPACE not in text:  # a mark of three bytes stands for a space of one, but the first for nothing
            ends = np.cumsum(self.covers[ids] - 2 * self.spaces[ids])
            if len(ids):
                ends -= 1
            return np.maximum(np.concatenate([[0], ends[:-1]]), 0) if len(ids) else ends, ends
        _, where = normalise(text.encode(), self.chars, self.dummy, self.trim, self.escape)
        ends = np.cumsum(self.covers[ids])
        begins = ends - self.covers[ids]
        last = len(where) - 1
        return where[np.minimum(begins, last)], where[np.minimum(ends, last)]

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Ids (begin and end included), the byte spans of the pieces, and digests: of the ids, of the decoded text, and of
    the spans without those of begin and end (all begins, then all ends, as 64-bit integers).

    with_ids=False leaves out the arrays, for callers that want the digests only. One pass over the scan's own
    partitions, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids = [e.encode(t) if t else np.empty(0, "<u4") for t in texts]
                spans = [e.spans(t, i) for t, i in zip(texts, ids)]
                full = [np.concatenate([[e.bos], i, [e.eos]]).astype("<u4") for i in ids]
                decoded = e.sp.decode([f.tolist() for f in full], num_threads=1) if full else []
                cols = [b.column(0), pa.array([len(f) for f in full], pa.int64()), pa.array([hashlib.sha256(f.tobytes()).hexdigest() for f in full]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                cols.append(pa.array([hashlib.sha256(np.concatenate(s).astype("<i8").tobytes()).hexdigest() for s in spans]))
                names.append("spans_sha256")
                if with_ids:
                    cols += [pa.array([f.astype("i4") for f in full], pa.list_(pa.int32())), pa.array([np.concatenate([[0], s[0], [len(t.encode())]]) for t, s in zip(texts, spans)], pa.list_(pa.int64())), pa.array([np.concatenate([[0], s[1], [len(t.encode())]]) for t, s in zip(texts, spans)], pa.list_(pa.int64()))]
                    names += ["ids", "begins", "ends"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = need(docs, id_col, text_col)
    schema = f"id {dict(rows.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    schema += ", ids array<int>, begins array<long>, ends array<long>" if with_ids else ""
    return map_texts(rows.toDF("id", "text"), run, schema).withColumnRenamed("id", id_col)


def decode_ids(ids: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists; null lists give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else e.sp.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    rows = need(ids, id_col, ids_col)
    return map_texts(rows.toDF("id", "ids"), run, f"id {dict(rows.dtypes)[id_col]}, text string").select(F.col("id").alias(id_col), "text")
