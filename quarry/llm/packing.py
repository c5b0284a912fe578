"""Packing documents into sequences of fixed length.

Documents are cut into pieces of one sequence at most; whole sequences need no search. The other pieces are
dealt to randomised groups of about `group_tokens` tokens, and in each group placed by first-fit decreasing:
longest first, each into the first bin with room, which a tournament tree over the bins' capacities finds in
logarithmic time.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut

#: Tokens of the pieces that a group should hold, about.
GROUP_TOKENS = 8_000_000
#: Entries that a worker's cache of encoded units may have.
CACHE = 1_000_000
#: How the vocabulary splits a text into parts that are encoded one by one.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Tokens as bytes. The file writes each byte as a letter: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}


class Encoder(dict):
    """Ids of texts as unsigned little-endian 32-bit bytes, by a byte-level BPE file. Keeps what units encode to.

    A space between two characters that are no white space begins a new part, and a lone line feed between
    such is a part of its own; so a text is the sum of the units between them. Texts with other white space
    beside a space, or with one of the file's special strings, are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = {k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k not in self.special}
        self.bpe = tiktoken.Encoding("bytes", pat_str=PARTS, mergeable_ranks=byte_ranks(vocabulary), special_tokens={})._core_bpe

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        if not unit or unit == "\x01":
            raise LookupError
        if unit == "\x00":
            text = "\n"
        else:
            text = unit[1:] if unit[0] == "\x01" else " " + unit
            if text.strip() != unit.lstrip("\x01"):
                raise LookupError
        if len(self) >= CACHE:
            self.clear()
        out = self[unit] = array("I", self.bpe.encode_ordinary(text)).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "\x00" not in text and "\x01" not in text and not any(s in text for s in self.special):
            try:
                return b"".join(map(self.__getitem__, ("\x01" + text.replace("\n", " \x00 \x01")).split(" ")))
            except LookupError:
                pass
        return self.whole(text)


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def pieces(docs: DataFrame, path: str, length: int, end: int, ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's tokens and the end's, in pieces."""

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                row, start, n, crc, total, own = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    raw = enc.encode(text or "") + last
                    for s in range(0, len(raw), 4 * length):
                        piece = raw[s : s + 4 * length]
                        row.append(i)
                        start.append(s // 4)
                        n.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(raw) // 4)
                        own.append(np.frombuffer(piece, "<i4") if ids else None)
                out = {"doc_id": part.column("doc_id").take(pa.array(row)), **{k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", n), ("ids_crc32", crc), ("doc_tokens", total))}}
                yield pa.record_batch(out | ({"ids": pa.array(own, pa.list_(pa.int32()))} if ids else {}))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cutting, schema + ", ids array<int>" * ids)


def first_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths come longest first.

    tree[leaves + i] is what bin i has left, and an inner node the most that its bins have left: from the
    root, the left child is taken if it has room, which leads to the first bin that has.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [size] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths.tolist():
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < n:
                at += 1
        bins.append(at - leaves)
        offsets.append(size - tree[at])
        tree[at] -= n
        at //= 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end: int = 1, seed: int = 0, group_tokens: int = GROUP_TOKENS, ids: bool = False) -> DataFrame:
    """Where each piece of each document goes.

    docs: doc_id, text, and any other columns, which are left aside. path: a tokenizers file; end: the id that
    closes a document; seed: of the groups. Returns per piece doc_id, start (in the document's ids), length,
    ids_crc32, doc_tokens, sequence_id, offset, and with ids=True the ids. A null text is empty: its document
    is the end id alone. Repeated rows are documents of their own; a null doc_id stays null. Sequences are
    filled from offset 0 without gaps.
    """
    found = cut(pieces(docs, path, length, end, ids), "pieces")
    tokens = found.where(F.col("length") < length).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))
    # whole sequences get odd ids, filled ones even ids
    whole = found.where(F.col("length") == length).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    rest = found.where(F.col("length") < length).withColumn("g", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.lit(seed)), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending")])
        bins, offsets = first_fit(np.array(table["length"]), length)
        ids_ = 2 * (bins * groups + int(table["g"][0].as_py()))
        return table.drop_columns("g").append_column("sequence_id", pa.array(ids_, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return rest.groupBy("g").applyInArrow(place, whole.schema).unionByName(whole)
