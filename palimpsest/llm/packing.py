"""Hierarchical packing of tokenised documents into windows of several lengths.

A document is tokenised, closed by the id 0 and cut into whole long windows; what is left
is routed to the tier of the smallest window that holds it.  Tiers are packed longest
first: each window is opened by a piece of its tier, its gap is filled by the longest
pieces of shorter tiers that fit, and where none fits one piece is cut.  Windows of a tier
are dealt to step groups so that groups have like attention costs.  Everything happens
within a block of a partition, so nothing is shuffled and memory is bounded by the block;
pieces that are left at the end of a block pass to the next, and the last are laid in
windows whose lengths are powers of two.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Window lengths; powers of two.
TIERS = (1024, 512, 256, 128)
#: Sequences that make a training step's group.
GROUP = 16
#: Documents in a block of the packer.
BLOCK_DOCS = 4096

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", pa.int32()), ("step_group", pa.int64())])


#: Fixed value: the pieces that byte-level vocabularies of this family split a text into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte for which each printable character of a byte-level vocabulary stands."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as byte strings with ranks, if its ids alone say in which order pieces merge; else None.

    That is so for a byte-level BPE without normaliser, prefix blank or dropout whose merges
    make the ids after those of the single bytes, one after the other.
    """
    said = json.loads(Path(path).read_text())
    model, split = said["model"], said["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or said["normalizer"] or model["type"] != "BPE" or model["dropout"] or model.get("ignore_merges"):
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    added = {a["content"] for a in said["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)) or any(vocab[c] >= 256 for c in letters):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Token ids of a tokenizer's file as little-endian unsigned 32-bit integers.

    Where the file allows it, ranks of its own vocabulary merge the pieces, which takes a
    quarter of the time; texts that hold an added token go through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks, self.merged = byte_ranks(path), None
        if ranks:
            import tiktoken

            self.merged = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.merged is None or any(a in text for a in self.added):
            return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return _little(self.merged.encode_ordinary(text))


class Packer:
    """Packs the pieces of one partition; ``pieces`` are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, tiers=TIERS, group: int = GROUP, base: int = 0):
        self.tiers, self.group, self.base = tuple(sorted(tiers, reverse=True)), group, base
        self.longest = self.tiers[0]
        self.by_length: list[list] = [[] for _ in range(self.longest)]
        self.present = 0  # bit n: there are pieces of length n
        self.tokens = 0
        self.made: list[tuple[int, list]] = []
        self.n_sequences = self.n_groups = 0

    def add(self, doc_id, stream: bytes) -> None:
        n = len(stream) // 4
        start = 0
        while n - start >= self.longest:
            self.made.append((self.longest, [(doc_id, start, stream[4 * start : 4 * (start + self.longest)], n)]))
            start += self.longest
        if start < n:
            self._put((doc_id, start, stream[4 * start :], n))

    def _put(self, piece) -> None:
        n = len(piece[2]) // 4
        self.by_length[n].append(piece)
        self.present |= 1 << n
        self.tokens += n

    def _take(self, n: int):
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.present &= ~(1 << n)
        self.tokens -= n
        return piece

    def _window(self, size: int, first: int) -> None:
        window, gap = [self._take(first)], size - first
        while gap and self.present:
            fits = self.present & ((1 << (gap + 1)) - 1)
            if fits:
                n = fits.bit_length() - 1
                window.append(self._take(n))
                gap -= n
            else:
                doc_id, start, ids, n = self._take((self.present & -self.present).bit_length() - 1)
                window.append((doc_id, start, ids[: 4 * gap], n))
                self._put((doc_id, start + gap, ids[4 * gap :], n))
                gap = 0
        self.made.append((size, window))

    def pack(self, last: bool) -> Iterator[tuple]:
        """Packs what there is; the pieces of less than a long window stay unless ``last``."""
        for size, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            tier = ((1 << (size + 1)) - 1) & ~((1 << (shorter + 1)) - 1)
            while self.tokens >= self.longest and (own := self.present & tier):
                self._window(size, own.bit_length() - 1)
        while last and self.tokens:
            size = 1 << (self.tokens.bit_length() - 1)
            fits = self.present & ((1 << (size + 1)) - 1)
            if fits:
                self._window(size, fits.bit_length() - 1)
            else:
                doc_id, start, ids, n = self._take(self.present.bit_length() - 1)
                self.made.append((size, [(doc_id, start, ids[: 4 * size], n)]))
                self._put((doc_id, start + size, ids[4 * size :], n))
        yield from self._grouped(last)

    def _grouped(self, last: bool) -> Iterator[tuple]:
        """Deals windows to whole groups; those that make none stay for the next block unless ``last``."""
        by_tier: dict[int, list] = {}
        for size, window in self.made:
            by_tier.setdefault(size, []).append(window)
        self.made = []
        for size, windows in sorted(by_tier.items(), reverse=True):
            if not last:
                whole = len(windows) // self.group * self.group
                self.made += [(size, w) for w in windows[whole:]]
                windows = windows[:whole]
            windows.sort(key=lambda w: -sum(len(p[2]) ** 2 for p in w))
            n = -(-len(windows) // self.group)
            for i, window in enumerate(windows):
                lap, at = divmod(i, n)
                group = self.base + self.n_groups + (n - 1 - at if lap % 2 else at)
                sequence, offset = self.base + self.n_sequences, 0
                self.n_sequences += 1
                for doc_id, start, ids, total in window:
                    length = len(ids) // 4
                    yield doc_id, start, length, zlib.crc32(ids), total, sequence, offset, size, group
                    offset += length
            self.n_groups += n


def _packs(path: str, tiers, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(path)
        packer = Packer(tiers, group, TaskContext.get().partitionId() << 36)

        def out(last):
            rows = list(packer.pack(last))
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 50_000], strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_DOCS):
                block = batch.slice(i, BLOCK_DOCS)
                for doc_id, text in zip(block.column(0).to_pylist(), block.column(1), strict=True):
                    packer.add(doc_id, encoder.encode(text.as_py()) + b"\0\0\0\0")
                yield from out(False)
        yield from out(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, tiers=TIERS, group: int = GROUP) -> DataFrame:
    """The pieces of all ``docs(doc_id, text)`` with their places in packed sequences.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier, step_group``.  A sequence holds ``tier`` ids exactly, so nothing is padded; tiers
    are powers of two, and lengths below the smallest tier occur once per partition.

    A null text is empty: one piece with the id 0.  Null ids are kept.  Repeated rows are
    packed as often as they occur.  An empty table gives no rows.  Other columns are ignored.
    Sequence ids are unique; they follow the partitions in which the table is read.
    """
    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(_packs(tokenizer_path, tiers, group), SCHEMA)


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
