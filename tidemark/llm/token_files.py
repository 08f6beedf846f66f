"""Token ids in Arrow files of equal-length sequences.

Documents in ascending id order are encoded, an end id follows each, and the ids are laid end to end into sequences
of one length, written as record batches of two fixed-size-list columns (`ids`, `mask`) in the Arrow file format.
A batch can be mapped into memory and sequence k read at once without a copy; the mask is false behind a file's last id.
Each range of ids gets one file, and a second one with the place of each document in it; how many ranges follows from
the bytes of the texts. Files are named after the attempt that writes them, and the manifest names those of the attempts
that ended well, so a task that is run again replaces nothing and renames nothing. The manifest is a file of its own,
written last: a folder without one holds no finished output, and one with it can be read by any later application.

Defined results: a null text is an empty one, with the end id alone; rows that share an id follow each other, ordered
by a hash of the text; null ids come first; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import need, new_path
from tidemark.llm.segments import Remembered, as_byte_chars, plain_letters

#: Ids of a sequence, sequences of a record batch, and bytes of text that a file is made of.
LENGTH, BATCH, FILE_BYTES = 2048, 256, 32 << 20
#: Characters that end words and are one run of marks to the splitter.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MANIFEST = "manifest.json"
_id_coders: dict[str, IdCoder] = {}


class IdCoder:
    """Ids as little-endian bytes, of two bytes where the vocabulary allows. Neither white space nor what stands
    beside it changes how a word is encoded when the pre-tokenizer drops white space, so the library is asked once
    for each distinct word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        #: By words: a lower-casing normaliser, a splitter that removes what its pattern leaves, byte characters.
        self.by_words = self._splits_at_space(json.loads(self.tokenizer.to_str()))
        self.words = Remembered(self._word, 500_000)
        self.words[""] = b""

    @staticmethod
    def _splits_at_space(rules: dict) -> bool:
        """Whether white space separates what is encoded and leaves no trace, and marks are runs of their own."""
        steps = (rules["normalizer"] or {}).get("normalizers", []), (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [s["type"] for s in steps[0]] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps[1]] != ["Split", "ByteLevel"]:
            return False
        split, byte_level = steps[1]
        pattern = split["pattern"].get("Regex", "").split("|")
        letters = all(p in pattern for p in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"))
        named = [t["content"] for t in rules["added_tokens"]]
        return letters and split["behavior"] == "Removed" and split["invert"] and not byte_level["use_regex"] and not any(t.isspace() or not t.strip(MARKS) for t in named)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if plain_letters(word):
            low = word.lower()
            if plain_letters(low):  # one pre-token of the pattern
                return self.pack([t.id for t in self.model.tokenize(as_byte_chars(low))])
        elif (core := word.rstrip(MARKS)) != word and plain_letters(core) and plain_letters(core.lower()):  # a capital I with a dot leaves a mark behind
            return self.words[core] + self.words[word[len(core) :]]
        return self.whole(word)

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def id_coder(path: str) -> IdCoder:
    if path not in _id_coders:
        _id_coders[path] = IdCoder(path)
    return _id_coders[path]


class SequenceWriter:
    """One file of sequences; holds one record batch at most."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str, length: int, batch: int):
        self.dtype, self.length, self.rows = np.dtype(dtype), length, batch
        kind = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.size = [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        full = self.rows * self.length * self.dtype.itemsize
        if self.size >= full:
            data = b"".join(self.held)
            whole = len(data) // full * full
            for at in range(0, whole, full):
                self._write(np.frombuffer(data, self.dtype, self.rows * self.length, at), self.rows * self.length)
            self.held, self.size = [data[whole:]], len(data) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.size:
            ids = np.frombuffer(b"".join(self.held), self.dtype)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to a file's sequences; local files are mapped, so that what is read is not copied."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._at, self._ids = -1, None

    def batch(self, k: int) -> np.ndarray:
        if k != self._at:
            column = self.file.get_batch(k).column(0)
            self._at, self._ids = k, column.values.to_numpy(zero_copy_only=True)
        return self._ids

    def sequence(self, k: int) -> tuple[pa.Array, ...]:
        """Ids and mask of sequence k: slices of the file's own buffers (a mask takes one bit an id)."""
        b = self.file.get_batch(k // self.rows)
        return tuple(b.column(i).values.slice(k % self.rows * self.length, self.length) for i in range(2))

    def crc32(self, start: int, n: int) -> int:
        """crc32 of n ids from start on, as little-endian unsigned 32-bit integers."""
        crc, size = 0, self.rows * self.length
        while n:
            ids = self.batch(start // size)[start % size : start % size + n]
            crc = zlib.crc32(ids.astype("<u4"), crc)
            start, n = start + len(ids), n - len(ids)
        return crc


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batch: int = BATCH, parts: int | None = None) -> tuple[str, list[tuple]]:
    """Writes the files into `out`, a URI that driver and executors can reach (default: the shared folder).

    Returns out and its manifest: (part, name, documents, ids) of each file, in order; it is also MANIFEST in the folder,
    with the type of the ids. One shuffle, by ranges of ids (and of text hashes and rows within an id, so that a
    frequent one is cut as well); one row a file comes to the driver."""
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    out = out if "://" in out or out.startswith("file:") else f"file://{out}"
    fs, folder = pafs.FileSystem.from_uri(out)
    fs.create_dir(folder, recursive=True)
    rows = need(docs, id_col, text_col).toDF("id", "text")
    if not parts:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # As many tasks as there are cores at least, where there are rows enough.
        parts = max(-(-size // FILE_BYTES), min(spark.sparkContext.defaultParallelism, size // (1 << 20)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, task = id_coder(tokenizer), None, TaskContext.get()
        fs, folder = pafs.FileSystem.from_uri(out)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        end, total, docs_n = coder.pack([end_id]), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                writer = SequenceWriter(fs, f"{folder}/{name}.arrow", coder.dtype, length, batch)
                sink = fs.open_output_stream(f"{folder}/{name}.docs.arrow")
                places = pa.ipc.new_file(sink, pa.schema([("id", b.schema.field(0).type), ("start", pa.int64()), ("n", pa.int64())]))
            starts, counts = [], []
            for text in b.column(1):
                ids = coder.encode(text.as_py() or "") + end
                writer.add(ids)
                n = len(ids) // writer.dtype.itemsize
                starts.append(total)
                counts.append(n)
                total += n
            places.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=places_schema(b)))
            docs_n += b.num_rows
        if writer is not None:
            writer.close()
            places.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([docs_n], pa.int64()), pa.array([total], pa.int64())], ["part", "name", "docs", "ids"])

    order = ["id", "th", "row"]
    dealt = rows.withColumn("th", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = dealt.select("id", "text").mapInArrow(run, "part int, name string, docs long, ids long").collect()  # a row for each file
    manifest = sorted((r.part, r.name, r.docs, r.ids) for r in found)
    with fs.open_output_stream(f"{folder}/{MANIFEST}") as f:
        f.write(json.dumps({"id": dict(rows.dtypes)["id"], "end": end_id, "length": length, "files": manifest}).encode())
    return out, manifest


def places_schema(b: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("id", b.schema.field(0).type), ("start", pa.int64()), ("n", pa.int64())])


def read_manifest(out: str) -> dict:
    """What write_token_files wrote last into the folder: id, end, length, files."""
    fs, folder = pafs.FileSystem.from_uri(out)
    with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_token_files(spark, out: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document, from the files: id, start among all ids, number of ids, crc32 of its ids. A task per file."""
    about = read_manifest(out)
    id_type, base, rows = about["id"], 0, []
    for part, name, _, ids in about["files"]:
        rows.append((part, name, base))
        base += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                reader = SequenceReader(f"{out}/{name}.arrow")
                fs, path = pafs.FileSystem.from_uri(f"{out}/{name}.docs.arrow")
                with fs.open_input_file(path) as f:
                    places = pa.ipc.open_file(f)
                    for k in range(places.num_record_batches):
                        p = places.get_batch(k)
                        starts, counts = p.column(1).to_pylist(), p.column(2).to_pylist()
                        crc = [reader.crc32(s, n) for s, n in zip(starts, counts)]
                        yield pa.RecordBatch.from_arrays([p.column(0), pa.array([base + s for s in starts], pa.int64()), p.column(2), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "part int, name string, base long")
    if rows:
        files = files.repartitionByRange(len(rows), "part")
    return files.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
