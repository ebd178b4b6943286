"""Token-id files: ORC with run-length encoded ids, row indexes and Bloom filters on doc_id.

Documents are dealt to tasks by range of doc_id and sorted, so files and rows follow doc_id.
Each task encodes its texts and writes one file. ORC keeps integers run-length encoded in stripes
that tasks read in parallel; row indexes (min and max of doc_id) and Bloom filters let a reader of
single documents skip stripes and row groups.

A text's ids are those of its white-space-free pieces in a row, and most pieces are simple: letters (ASCII or
Latin-1), digits and ASCII signs, which the tokenizer lower-cases and splits into runs of letters,
single digits and runs of signs. These runs are cut in numpy, each distinct run of a batch is looked up
once, and unknown ones go to the library's BPE model. Pieces with anything else (apostrophes, "<", other
alphabets, combining marks) go through the whole tokenizer. Each Python worker keeps the ids of up to CACHE runs.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import documents, ship
from attestor.llm.textops import LOWER, chunks, text_bytes
from attestor.session import scratch_dir

ship(__name__)

CACHE = 500_000
END_ID = 1
ROW_INDEX_STRIDE = 1_000
_GAP, _LETTER, _DIGIT, _SIGN, _RARE = range(5)


def _byte_class(b: int) -> int:
    c = chr(b)
    if b == 0x20 or 9 <= b <= 13:
        return _GAP
    if b >= 127 or b < 32 or c in "'<":
        return _RARE
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN


_CLASS = np.array([_byte_class(b) for b in range(256)], np.uint8)
#: Runs as they are after lower-casing; everything else goes through the whole tokenizer.
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


_FILE = "doc_id long, part int, pos long, ids array<int>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of whole batches of texts. ``separator`` is a special token of the tokenizer."""

    def __init__(self, path: str, separator: str = "<|endoftext|>", cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.separator, self.most = Tokenizer.from_file(path), separator, cache
        self.separator_id = self.tokenizer.token_to_id(separator)
        self.letters = byte_letters()
        self.ids: dict[bytes, bytes] = {}

    def _new(self, runs: list[bytes]) -> None:
        mark, rare, ids = self.separator.encode(), [], self.ids
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for p in runs:
            if _SIMPLE.fullmatch(p):
                text = p.decode() if p.isascii() else "".join([letters[b] for b in p])
                ids[p] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(text)])
            else:
                rare.append(p)
        plain = [p for p in rare if mark not in p]
        for at in range(0, len(plain), 500):
            part = plain[at:at + 500]
            out = np.array(self.tokenizer.encode(self.separator.join(p.decode() for p in part), add_special_tokens=False).ids, np.int32)
            for p, x in zip(part, np.split(out, np.flatnonzero(out == self.separator_id))):
                ids[p] = (x[1:] if len(x) and x[0] == self.separator_id else x).tobytes()
        for p in rare:
            if mark in p:
                ids[p] = np.array(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids, np.int32).tobytes()

    def runs(self, data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(all runs in order, runs per text)."""
        kind, low = _CLASS[data], LOWER[data]
        # Latin-1 letters are two bytes, C3 and one that isn't a multiplication or division sign.
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)) + 1
        kind[second] = kind[second - 1] = _LETTER
        upper = second[data[second] <= 0x9E]
        low[upper] += 0x20
        gap = kind == _GAP
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        head = edge[:-1].copy()
        head[0] = True
        head[1:] |= gap[:-1]
        head &= ~gap
        new = kind == _DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        odd = np.flatnonzero(kind == _RARE)
        if len(odd):
            pieces = np.flatnonzero(head)
            rare = np.unique(np.searchsorted(pieces, odd, "right") - 1)
            stops = np.flatnonzero(gap | edge[:-1])
            begin = pieces[rare]
            after = np.searchsorted(stops, begin, "right")
            end = np.append(stops, len(data))[after]
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, begin, 1)
            np.add.at(step, end, -1)
            inside = np.cumsum(step[:-1]) > 0
            new &= ~inside
            low[inside] = data[inside]
        starts = np.flatnonzero((new | head) & ~gap)
        place = np.cumsum(~gap)
        bounds = np.append(place[starts] - 1, place[-1])
        body = np.ascontiguousarray(low[~gap])
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(body)])
        return found, np.diff(np.searchsorted(starts, offs))

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each ended by ``end_id``; ids per text)."""
        if not len(data):
            return np.full(len(offs) - 1, end_id, np.int32), np.ones(len(offs) - 1, np.int64)
        found, counts = self.runs(data, offs)
        found = found.dictionary_encode()
        known = found.dictionary.to_pylist()
        new = [p for p in known if p not in self.ids]
        if len(self.ids) + len(new) > self.most:
            self.ids, new = {}, known  # the runs of this batch must all be there
        self._new(new)
        ids = [self.ids[p] for p in known]
        flat = np.frombuffer(b"".join(ids), np.int32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        # One run more per text: its end.
        size, first, flat = np.append(size, 1), np.append(first, len(flat)), np.append(flat, np.int32(end_id))
        at = np.insert(found.indices.to_numpy(zero_copy_only=False), np.cumsum(counts), len(size) - 1)
        per = size[at]
        stop = np.cumsum(per)
        out = flat[np.repeat(first[at] - (stop - per), per) + np.arange(stop[-1])]
        return out, np.diff(stop[np.cumsum(counts + 1) - 1], prepend=0)


def _worker_encoder(path: str) -> Encoder:
    """The Encoder of this Python worker, which serves many tasks."""
    kept = sys.modules.setdefault("_attestor_encoders", types.ModuleType("_attestor_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos = _worker_encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for i, j, d, o in chunks(data, offs, 4 << 20):
                ids, sizes = encoder.encode(d, o, end_id)
                n = j - i
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n).cast(pa.int64()), pa.array(np.full(n, part, np.int32)),
                     pa.array(np.arange(pos, pos + n, dtype=np.int64)), lists],
                    ["doc_id", "part", "pos", "ids"],
                )
                pos += n

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes doc_id, part, pos (row of its file) and ids of every document to ORC files at ``path``.

    Null and empty texts have the end id only. Rows with a null id come first; rows that repeat an
    id are ordered by text. An empty table gives files without rows; other columns are ignored.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encode(tokenizer or tokenizer_path(), end_id), _FILE).write.options(**{
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(ROW_INDEX_STRIDE),
        "orc.create.index": "true", "compression": "zstd",
    }).orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        offs = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "part", "pos", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: doc_id, part, pos, ids. Filters on doc_id skip stripes and row groups."""
    return spark.read.schema(_FILE).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start (ids before it in the order of the files), n_tokens, ids_crc32, part, pos."""
    rows = read_tokens(spark, path).mapInArrow(_sums, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = sums.withColumn("_before", F.expr(
        "coalesce(sum(_n) over (order by part rows between unbounded preceding and 1 preceding), 0)")).drop("_n")
    inside = rows.withColumn("_in", F.expr("sum(n_tokens) over (partition by part order by pos) - n_tokens"))
    # One row per file: a few thousand at most.
    return inside.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("_in") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", "part", "pos"
    )


def encode_documents(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files and reads their index back."""
    write_tokens(docs, path, tokenizer, end_id)
    return token_index(docs.sparkSession, path)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), scratch_dir(spark, "token-files")).drop("part", "pos")
