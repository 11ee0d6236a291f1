"""Tokens of whole documents packed into fixed-length sequences.

Packing is bounded-space online best fit. Each lane keeps a fixed number of open sequences
in a bitset keyed by their free space: the lowest set bit at or above a piece's length is
the best fit, the lowest bit of all is the fullest sequence and closes first. What is still
open when a lane ends is packed again with that of other lanes, level by level, so that the
whole table ends with one set of open sequences and no lane holds more than a fixed number
of pieces.

Defined results: a null or empty text is one piece with the end mark alone; repeated rows
are packed each by itself; pieces of equal place in the order are alike, so ties change
nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, stored

# Fixed value: how the byte-level tokenizer cuts text before its merges.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LANE_PIECES = 40_000
OPEN_SEQUENCES = 1024
MERGE_LANES = 16

_PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Runs of white space from this length on go to the other library: the pattern looks ahead
# at the end of such a run and takes memory on the stack for every character of it.
LONG_BLANKS = re.compile(r"\s{8000}")


class TokenIds:
    """Ids of a tokenizer file. The merges of a byte-level BPE file that cuts text by the pattern
    above run in ``tiktoken``, which is several times as fast and gives the same ids. Texts with a
    special token or long white space go to ``tokenizers``, as do all texts under any other file."""

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.special, self.fast = [t["content"] for t in parts["added_tokens"]], None
        cut, model = parts.get("pre_tokenizer") or {}, parts["model"]
        known = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not parts.get("normalizer")
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if known and plain:
            byte_of = byte_alphabet()
            ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.fast = Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or LONG_BLANKS.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies: printable
    ones stand for themselves, the rest follow from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


_LOADED: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def piece_bounds(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(at, length) for at in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = 1024, end_id: int = 2) -> DataFrame:
    """Cut every document's ids, with the end mark, into pieces of at most ``length``."""
    path = tokenizer or public_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(path)
        for batch in slices(batches):
            ids, rows = batch.column("doc_id"), []
            for at, text in enumerate(batch.column("text").to_pylist()):
                data = np.array([*tokens.of(text), end_id], dtype="<u4").tobytes()
                for n, (start, size) in enumerate(piece_bounds(len(data) // 4, length)):
                    rows.append((at, n, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])))
            at, n, start, size, crc = list(zip(*rows)) or [()] * 5
            arrays = [ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(work, _PIECES.format(id=kind))


def best_fit(sizes: list[int], capacity: int, most_open: int) -> tuple[list[int], list[int], set[int]]:
    """Pack sizes in the given order. Returns each one's sequence and offset, and which
    sequences were still open at the end."""
    free_bits, by_free, place, offset, count = 0, {}, [], [], 0
    n_open = 0
    for size in sizes:
        fit = free_bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            row = by_free[free]
            bin_ = row.pop()
            if not row:
                free_bits &= ~(1 << free)
        else:
            if n_open == most_open:  # the fullest closes
                free = (free_bits & -free_bits).bit_length() - 1
                row = by_free[free]
                row.pop()
                if not row:
                    free_bits &= ~(1 << free)
                n_open -= 1
            free, bin_ = capacity, count
            count += 1
            n_open += 1
        place.append(bin_)
        offset.append(capacity - free)
        free -= size
        if free:
            by_free.setdefault(free, []).append(bin_)
            free_bits |= 1 << free
        else:
            n_open -= 1
    return place, offset, {b for row in by_free.values() for b in row}


def _pack_lane(level: int, last: bool, capacity: int, most_open: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("order", "doc_id", "piece", "start", "length", "ids_crc32")])
        place, offset, still = best_fit(table.column("length").to_pylist(), capacity, most_open)
        base = (level << 56) + (table.column("lane")[0].as_py() << 24)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        out = out.append_column("sequence_id", pa.array([base + p for p in place], pa.int64()))
        out = out.append_column("offset", pa.array(offset, pa.int64()))
        return out.append_column("open", pa.array([not last and p in still for p in place], pa.bool_()))

    return work


def pack(cut: DataFrame, length: int = 1024, most_open: int = OPEN_SEQUENCES, lane_pieces: int = LANE_PIECES) -> DataFrame:
    """Give every piece a sequence and an offset. Full pieces are sequences of their own."""
    cut = stored(cut)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") >= length).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    rest, done, level = cut.where(F.col("length") < length), [full], 0
    lanes = max(1, -(-rest.count() // lane_pieces))
    while True:
        order = F.xxhash64("doc_id", "piece", "start", F.lit(level))
        lane = F.pmod(order, F.lit(lanes))
        dealt = rest.select(*columns, F.xxhash64(order).alias("order"), lane.alias("lane"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
        packed = stored(
            dealt.groupBy("lane").applyInArrow(
                _pack_lane(level, lanes == 1, length, most_open), schema + ", sequence_id bigint, offset bigint, open boolean"
            )
        )
        done.append(packed.where(~F.col("open")).drop("open"))
        if lanes == 1:
            return reduce(DataFrame.unionByName, done)
        rest, lanes, level = packed.where("open"), -(-lanes // MERGE_LANES), level + 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 1024) -> DataFrame:
    return pack(pieces(docs, tokenizer, length), length)
