"""Best-fit packing of tokenized documents by hierarchical residual packing.

Partitions best-fit their pieces locally and emit the bins that are nearly full; underfull bins
become items of the next round, over fewer partitions, until one partition holds what is left
or a round no longer helps. A task holds at most ITEMS items, each with at most CONTEXT pieces.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

CONTEXT = 2048
END = 0  # the id that closes each document
VOCABULARY_FILE = "word_bpe_49k.json"
ITEMS = 100_000  # items that one task packs
SLACK = 8  # tokens that a bin may lack and still count as nearly full
LEAST_GAIN = 0.01  # a round that leaves more than 1 - this of its bins underfull is the last
CACHED = 100_000  # distinct words of which a worker keeps the ids, the first it meets,
PIECES = 200_000  # and distinct pieces of words

MEMBER = "struct<doc_id:{id},piece:int,start:bigint,length:bigint,ids_crc32:bigint>"

_PUNCTUATION = frozenset(string.punctuation)
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Their lower case is longer, or depends on what stands around them.
_ODD_CASE = frozenset("İΣ")


class _Pieces(dict):
    """The ids of what the tokenizer's own first step cuts words into."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        # Lower-case ASCII letters are as the model wants them; the rest goes through all steps.
        if piece.isascii() and piece.isalpha():
            ids = [t.id for t in self.tokenizer.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(self) < PIECES:
            self[piece] = out
        return out


class _Words(dict):
    """The ids of a word as little-endian bytes. No token of this vocabulary crosses white space."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        last = text[-1:]
        if text.isalpha() and _ODD_CASE.isdisjoint(text):
            out = self.pieces[text.lower()]
        elif last in _PUNCTUATION and text[:-1].isalpha() and _ODD_CASE.isdisjoint(text):
            out = self.pieces[text[:-1].lower()] + self.pieces[last]
        elif text.isascii() and "<|" not in text:
            out = b"".join(map(self.pieces.__getitem__, _ASCII.findall(text.lower())))
        else:
            out = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < CACHED and len(word) <= 64:
            self[word] = out
        return out


@lru_cache(1)
def _words(path: str | None) -> _Words:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY_FILE)
    return _Words(path)


def token_bytes(text: bytes | None, tokenizer: str | None = None) -> bytes:
    """A document's ids, its end included, four bytes each."""
    return b"".join(map(_words(tokenizer).__getitem__, (text or b"").split())) + END.to_bytes(4, "little")


def _cutter(tokenizer, id_type):
    def cut(batches):
        first = TaskContext.get().partitionId() << 26
        full = 0
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = token_bytes(text.as_py(), tokenizer)
                for piece, at in enumerate(range(0, len(data), 4 * CONTEXT)):
                    part = data[at : at + 4 * CONTEXT]
                    ids.append(doc_id)
                    whole = len(part) == 4 * CONTEXT
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part), first + full if whole else None))
                    full += whole
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"],
            )

    return cut


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The pieces of every document; those of CONTEXT tokens already are sequences and have an id."""
    from pyspark.sql.pandas.types import to_arrow_type

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = read.schema["doc_id"].dataType
    return read.mapInArrow(lean(_cutter(tokenizer, to_arrow_type(kind))), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long")


def best_fit(lengths: np.ndarray, capacity: int = CONTEXT) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin. Bins are kept by what they lack, with a bit for
    each lack that occurs, so the tightest bin is found without a search."""
    bins: list[list[int]] = []
    lacking: list[list[int]] = [[] for _ in range(capacity + 1)]
    occurs = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fits = occurs >> length
        if fits:
            lack = length + (fits & -fits).bit_length() - 1
            where = lacking[lack].pop()
            if not lacking[lack]:
                occurs &= ~(1 << lack)
            bins[where].append(item)
            lack -= length
        else:
            where = len(bins)
            bins.append([item])
            lack = capacity - length
        lacking[lack].append(where)
        occurs |= 1 << lack
    return bins


def _packer(round_: int):
    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        items = pa.Table.from_batches(batches).combine_chunks()
        bins = best_fit(items.column("length").to_numpy())
        taken = items.take(pa.array([i for b in bins for i in b], pa.int64())).combine_chunks()
        members = taken.column("members").combine_chunks()
        if isinstance(members, pa.ChunkedArray):
            members = members.chunk(0)
        item_ends = np.cumsum([len(b) for b in bins])
        member_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(members).to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], member_ends[item_ends]]).astype(np.int32)
        lengths = np.add.reduceat(taken.column("length").to_numpy(), np.concatenate([[0], item_ends[:-1]]))
        first = (round_ << 52) + (TaskContext.get().partitionId() << 26)
        out = pa.ListArray.from_arrays(pa.array(ends), members.flatten())
        table = pa.Table.from_arrays([pa.array(np.arange(first, first + len(bins))), pa.array(lengths, pa.int64()), out], ["sequence_id", "length", "members"])
        yield from table.to_batches(max_chunksize=10_000)

    return pack


def _places(batches):
    """One row per member, with its place in the sequence."""
    for batch in batches:
        members = batch.column("members")
        n = pc.list_value_length(members).to_numpy(zero_copy_only=False)
        flat = members.flatten()
        length = flat.field("length").to_numpy(zero_copy_only=False)
        before = np.cumsum(length) - length
        starts = np.cumsum(n) - n
        offset = before - np.repeat(before[starts], n) if len(n) else before
        ids = np.repeat(batch.column("sequence_id").to_numpy(zero_copy_only=False), n)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(flat.field(x) for x in names), pa.array(ids, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, items: int = ITEMS) -> DataFrame:
    """Pack whole documents into sequences of at most CONTEXT tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. A null or
    empty text is the end id alone; repeated rows are packed once each; a document longer than
    CONTEXT is cut, the last piece may be shorter. No row is lost at any size: bins that no
    further round can fill are emitted as they are. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = materialize(cut_pieces(docs, doc_id, text, tokenizer), "pieces", left=F.count_if(F.col("sequence_id").isNull()))
    whole = pieces.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    left = pieces.where("sequence_id is null").select("length", F.array(member).alias("members"))
    n, done, last = pieces.seen["left"], [], None
    schema = f"sequence_id long, length long, members array<{MEMBER.format(id=kind)}>"
    for round_ in range(1, 64):
        parts = max(1, -(-n // items))
        packed = left.select("length", "members").repartition(parts).mapInArrow(lean(_packer(round_)), schema)
        packed = materialize(packed, f"bins{round_}", open=F.count_if(F.col("length") < CONTEXT - SLACK))
        if last is not None:
            done.append(last.where(F.col("length") >= CONTEXT - SLACK))
        last, left = packed, packed.where(F.col("length") < CONTEXT - SLACK)
        open_ = packed.seen["open"]
        if parts == 1 or open_ > (1 - LEAST_GAIN) * n:
            break
        n = open_
    bins = reduce(DataFrame.unionAll, [*done, last])
    placed = bins.mapInArrow(lean(_places), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return whole.select(placed.columns).unionAll(placed)

