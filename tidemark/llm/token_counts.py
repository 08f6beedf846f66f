"""Token counts by overlap resynchronisation.

A huge document is read in overlapping chunks. Each is encoded with the offsets of its tokens. A stable boundary is a
space or line feed after something that is not white space: the pre-tokenizer cannot match across it, so the tokens on
either side do not depend on each other. A chunk ends OVERLAP characters behind a stable boundary, the next begins as
many before it, and they are spliced there if a token begins at it in both. If the offsets do not show that, the
overlap is widened to the next boundary, twice as far on as before; what has no boundary at all is encoded in one piece.
No chunk is encoded again but when it is widened, and then at double length, so the work grows with the text's length.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get their row; an empty table
gives an empty table; other columns are ignored. The length of a text is bounded only by what a cell can hold.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import need
from tidemark.llm.segments import AFTER_TEXT, OTHER_SPACE, Remembered, as_byte_chars, plain_letters, split_before_breaks

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 32_768, 1_024
#: Entries of the worker's memo.
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens of parts with a tokenizers file whose pre-tokenizer is byte-level; asks the library once for
    each distinct part. A part of plain letters is one pre-token, so the library's model alone is asked."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.processors import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.post_processor = ByteLevel(trim_offsets=False)  # offsets with their spaces; no id depends on it
        self.model = self.tokenizer.model
        self.after_space = Remembered(self._after_space)
        self.as_is = Remembered(self.whole, 50_000)
        #: Whether a special string holds white space, so that no boundary is safe.
        self.spaced = any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values())
        # The short cuts hold for the byte-level pattern without normaliser; others take the library's whole way.
        self.short = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _after_space(self, part: str) -> int:
        """Tokens of a part that begins with a line feed, or else of the part with a space before it."""
        if self.short:
            if part[-1] in ".," and plain_letters(part[:-1]):
                return self.after_space[part[:-1]] + self.as_is[part[-1]]
            if plain_letters(part):
                return len(self.model.tokenize("Ġ" + as_byte_chars(part)))
        return self.whole(part if part[0] == "\n" else " " + part)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(text) > CHUNK:
            return self.count_huge(text)
        plain = split_before_breaks(text)
        if plain is None:
            return sum(self.as_is[p] if len(p) < 64 else self.whole(p) for p in AFTER_TEXT.split(text))
        return self.as_is[plain[0]] + sum(map(self.after_space.__getitem__, plain[1:]))

    def offsets(self, text: str) -> list[int]:
        """Where each token of text begins."""
        return [o[0] for o in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def boundary(self, text: str, at: int) -> int:
        """The first stable boundary from `at` on, or the end of text."""
        if self.spaced:
            return len(text)
        for found in AFTER_TEXT.finditer(text, max(at, 1)):
            if self.stable(text, found.start()):
                return found.start()
        return len(text)

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Counts chunk by chunk: the tokens between two splices, which are final."""
        total, begin, size, width = 0, 0, chunk, overlap
        while begin < len(text):
            splice, left = self.boundary(text, begin + size), max(0, begin - width)
            starts = [left + o for o in self.offsets(text[left : splice + width])]
            first, last = bisect_left(starts, begin), bisect_left(starts, splice)
            if starts[first : first + 1] == [begin] and (splice == len(text) or starts[last : last + 1] == [splice]):
                total += last - first
                begin, size, width = splice, chunk, overlap
            elif left == 0 and splice == len(text):  # all of the text, in one piece
                return len(starts)
            else:
                size, width = 2 * size, 2 * width
        return total

    @staticmethod
    def stable(text: str, at: int) -> bool:
        return text[at] in " \n" and not text[at - 1].isspace() and not OTHER_SPACE.match(text[at - 1])


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text, and whether they are over the limit. One pass over the scan's own partitions,
    no shuffle; a lost task is run again by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            tokens = [c.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = need(docs, id_col, text_col)
    kind = dict(rows.dtypes)[id_col]
    out = rows.toDF("id", "text").mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
