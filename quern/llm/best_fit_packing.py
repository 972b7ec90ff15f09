"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Documents become runs of token ids; pieces of full length are sequences by
themselves. The other pieces are dealt by hash into groups of a fixed size,
one task each. Within a group each piece goes where the squares of the counts
of open bins per residual gap sum to the least afterwards, a new bin
included. What a group leaves open is packed again, bins as wholes, in a
second round of the same kind over all groups' open bins.
"""

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import settle

LENGTH, END_ID = 4096, 1
#: Pieces or open bins that one task packs; bounds a task, whatever the table's size.
GROUP = 50_000
#: Words, and pieces of words, that a worker remembers: the first ones it meets, so the frequent ones.
REMEMBERED = 500_000

_S, _L, _N = "\\t-\\r \\x85\\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Of a text in lower case: beyond these characters, or with separators on which str.split() and the vocabulary's own rules differ, the tokenizer library takes the whole text.
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary shows each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(0x100)} - plain))}


class WordIds(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of a word between white space.

    Words are the unit because the vocabulary's rules never join ids over white
    space. Equal to the library's own encoding of whole texts, and many times
    faster on text that repeats words. With ``added_tokens`` the literals of
    the vocabulary's added tokens get their single ids, as the library does
    unless told otherwise; without, they are text like any other.
    """

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        literals = [f"(?i:{re.escape(t.content)})" for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.tokenizer.encode_special_tokens = not added_tokens
        self.whole = re.compile("|".join([_OTHER.pattern, *literals]))
        self.model, self.letters, self.pieces = self.tokenizer.model, byte_letters(), {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(shown)]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.pieces) < REMEMBERED:
                self.pieces[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self._piece, _PIECE.findall(word)))
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        low = text.lower()
        if self.whole.search(low):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, low.split()))


def sequence_cuts(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32 of the ids) of each piece of a document, whose ids are given without the closing one."""
    ids += np.array([END_ID], "<u4").tobytes()
    return [(at // 4, len(part := ids[at : at + 4 * length]) // 4, zlib.crc32(part)) for at in range(0, len(ids), 4 * length)]


def _cutter(path: str, length: int, added_tokens: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path, added_tokens)
        for batch in batches:
            rows = [(batch.column(0)[i].as_py(), k, *cut) for i, t in enumerate(batch.column(1)) for k, cut in enumerate(sequence_cuts(words.of_text(t.as_py() or ""), length))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["id", "piece", "start", "length", "crc"])

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """(id, piece, start, length, crc) of each document's pieces."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cutter(tokenizer, length, added_tokens), "id long, piece int, start long, length long, crc long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the given order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by level
    count = np.zeros(capacity + 1, np.int64)  # of open bins by level; 0 and full ones stay 0
    bins, offsets, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # From level h to h + s the sum of squares changes by 2 * (count[h + s] - count[h]) + 2; by a unit less where a bin closes or opens.
        gain = count[s:] - count[: capacity + 1 - s]
        gain = 2 * gain + 2
        gain[-1] -= 1
        gain[0] = 2 * count[s] + 1 if s < capacity else 0
        gain[1:][count[1 : capacity + 1 - s] == 0] = np.iinfo(np.int64).max
        h = len(gain) - 1 - int(gain[::-1].argmin())  # of equal ones the fullest
        if h:
            b = open_bins[h].pop()
            count[h] -= 1
        else:
            b = made
            made += 1
        if h + s < capacity:
            open_bins[h + s].append(b)
            count[h + s] += 1
        bins[i], offsets[i] = b, h
    return bins, offsets


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        bins, offsets = sum_of_squares(group["size"].to_numpy(), capacity)
        first = group.item.to_numpy()[np.unique(bins, return_index=True)[1]]  # a bin is named by its first item
        return pd.DataFrame({"item": group.item, "bin": first[bins], "offset": offsets, "size": group["size"]})

    return pack


def _packed(items: DataFrame, capacity: int, group: int) -> DataFrame:
    """(item, bin, offset, size): groups of about ``group`` items are packed apart."""
    groups = max(1, -(-items.count() // group))
    dealt = items.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("g"))
    return settle(dealt.groupBy("g").applyInPandas(_packer(capacity), "item long, bin long, offset long, size long"))


def packed_sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id and offset.

    A document is its token ids and a closing id; only one longer than
    ``length`` is cut. A null text counts as empty and packs its closing id.
    Repeated rows and null ids are documents of their own. An empty table
    gives an empty result; other columns are ignored.
    """
    pieces = settle(token_pieces(docs, tokenizer, length, id_col, text_col, added_tokens).withColumn("item", F.monotonically_increasing_id()))
    first = _packed(pieces.where(F.col("length") < length).select("item", F.col("length").alias("size")), length, group)
    levels = settle(first.groupBy("bin").agg(F.sum("size").alias("size")).where(F.col("size") < length).select(F.col("bin").alias("item"), "size"))
    second = _packed(levels, length, group).select(F.col("item").alias("bin"), F.col("bin").alias("final"), F.col("offset").alias("shift"))
    placed = first.join(second, "bin", "left").select("item", F.coalesce("final", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    both = pieces.join(placed, "item", "left")
    return both.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.coalesce("sequence_id", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))
