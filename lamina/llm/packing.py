"""Packing: bounded-space online packing of token sequences into windows of a fixed length.

Each partition streams its documents. A document's full windows leave at once; its remainder goes to the
open window with the least free space that still holds it (best fit). If none holds it, a further window
opens while fewer than ``open_windows`` are open; after that the fullest window is emitted and a new one
opened. If the fullest still has more than ``max_waste`` free places, the head of the remainder is cut off
to fill it first, so no emitted window wastes more than that. At the end of the partition its open windows
are merged (the emptiest fill the fullest) until at most one partial window is left, and the partial
windows of all partitions, a small table, are merged in groups of neighbouring partitions.

Every token of a document lies in exactly one piece. Memory per task: ``open_windows`` windows, one Arrow batch
of texts, and the ids of one document (four bytes a token); its full windows leave in small batches while it is
cut. Long texts are encoded in parts of about ``PART`` characters, cut before a lone space between two word characters,
where byte-level BPE begins a new token in any case. The packed pieces are written to the shared scratch folder
once, so that merging the last windows repeats no tokenizing, and a lost executor repeats only its own
partitions; ids are written only where they are asked for or needed by the merge.

Tokens: the vocabulary and merges of a byte-level BPE file of the ``tokenizers`` library, followed by an end
token. The merges run in ``tiktoken``, which merges by ascending id and so is used only for a file whose merges make ids in
ascending order (checked when it is read); it is several times faster. The first text of every worker is also
encoded by ``tokenizers`` and must agree. The strings of the file's added tokens become their ids, as in
``tokenizers`` with ``add_special_tokens=False``.

Defined results: NULL and empty texts are a lone end token; repeated rows are packed separately; rows
with NULL ids are packed with a NULL id; an empty table gives an empty table. Other input columns are not
read, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text_columns import column
from lamina.scratch import materialize

LENGTH, OPEN_WINDOWS, MAX_WASTE, END_ID = 2048, 64, 20, 1
MERGE_PARTITIONS, PART, BATCH = 256, 1 << 20, 1000
_ENCODERS: dict = {}
_CUT = re.compile(r"(?<=\w) (?=\w)")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str, added: bool = False):
    """``text -> list of ids`` for a byte-level BPE file; the strings of its added tokens are ordinary text, or with ``added`` become their ids."""
    if (path, added) in _ENCODERS:
        return _ENCODERS[path, added]
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special, byte_of = {t["content"]: t["id"] for t in spec["added_tokens"]}, _byte_of()
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    made = [ranks[bytes(byte_of[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(made) + 256 != len(ranks):
        raise ValueError("the file's merges do not make ids in ascending order")
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = not added
    checked = False

    def encode(text: str) -> list[int]:
        nonlocal checked
        ids = fast.encode(text, allowed_special="all") if added else fast.encode_ordinary(text)
        if text and not checked:
            checked = True
            if exact.encode(text, add_special_tokens=False).ids != ids:
                raise RuntimeError("the two BPE engines disagree")
        return ids

    _ENCODERS[path, added] = encode
    return encode


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of at least ``size`` characters whose tokens are those of the whole text."""
    begin = 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def ids_of(text: str | None, encode, end_id: int) -> np.ndarray:
    """All ids of one document."""
    arrays = [np.array(encode(part), dtype="<u4") for part in parts(text or "")]
    return np.concatenate([*arrays, np.array([end_id], dtype="<u4")])


class Packer:
    """The open windows of one stream. A piece is (doc, start, ids, doc_tokens); windows leave through ``emit``."""

    def __init__(self, emit, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, max_waste: int = MAX_WASTE):
        self.emit, self.length, self.limit, self.waste = emit, length, open_windows, max_waste
        self.free: list[tuple[int, int]] = []  # sorted (free places, window)
        self.windows: dict[int, list] = {}
        self.opened = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[None]:
        """Take a document; a step for each full window, so that the caller can pass emitted ones on between."""
        total = len(ids)
        full = total - total % self.length
        for at in range(0, full, self.length):
            self.emit([(doc, at, ids[at : at + self.length], total)])
            yield
        if total > full:
            self.place((doc, full, ids[full:], total))

    def place(self, piece) -> None:
        doc, start, ids, total = piece
        size = len(ids)
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            free, key = self.free.pop(at)
            self._put(key, free - size, piece)
            return
        if len(self.free) >= self.limit:
            free, key = self.free.pop(0)
            if free > self.waste:
                self.windows[key].append((doc, start, ids[:free], total))
                piece = (doc, start + free, ids[free:], total)
            self.emit(self.windows.pop(key))
            if free > self.waste:
                self.place(piece)
                return
        self.opened += 1
        self.windows[self.opened] = []
        self._put(self.opened, self.length - size, piece)

    def _put(self, key: int, free: int, piece) -> None:
        self.windows[key].append(piece)
        if free == 0:
            self.emit(self.windows.pop(key))
        else:
            bisect.insort(self.free, (free, key))

    def merge(self) -> list | None:
        """Close the stream: the emptiest windows fill the fullest; at most one partial window is returned."""
        while self.free and self.free[0][0] <= self.waste:
            self.emit(self.windows.pop(self.free.pop(0)[1]))
        order = [key for _, key in self.free]
        partial = fill((piece for key in order for piece in self.windows[key]), self.emit, self.length)
        self.free, self.windows = [], {}
        return partial


def fill(pieces, emit, length: int) -> list | None:
    """Fill windows with pieces in turn, cutting at each window's end; return the last, partial one."""
    window, used = [], 0
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            part = ids[at : at + length - used]
            window.append((doc, start + at, part, total))
            at, used = at + len(part), used + len(part)
            if used == length:
                emit(window)
                window, used = [], 0
    return window or None


class _Rows:
    """Emitted windows as Arrow batches of the piece schema (plus the partition and an open flag)."""

    def __init__(self, prefix: int, doc_type: pa.DataType, extra: dict | None = None, with_ids: bool = True):
        self.prefix, self.doc_type, self.extra, self.with_ids = prefix, doc_type, extra or {}, with_ids
        self.rows: list[tuple] = []
        self.count = 0

    def emit(self, window: list, is_open: bool = False) -> None:
        sequence, at = self.prefix + self.count, 0
        self.count += 1
        for doc, start, ids, total in window:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, at, raw if self.with_ids or is_open else None, is_open))
            at += len(ids)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in range(9)]
        self.rows = []
        kinds = [self.doc_type, *[pa.int64()] * 6, pa.binary(), pa.bool_()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "open"]
        arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
        for name, value in self.extra.items():
            arrays.append(pa.array([value] * len(arrays[0]), type=pa.int64()))
            names.append(name)
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _pack_partition(path: str, length: int, open_windows: int, max_waste: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(path, added=True)
        rows = _Rows(part << 32, pa.int64(), {"part": part}, with_ids)
        packer = Packer(rows.emit, length, open_windows, max_waste)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for _ in packer.add(doc.as_py(), ids_of(text.as_py(), encode, end_id)):
                    if len(rows.rows) >= BATCH:
                        yield rows.take()
            if len(rows.rows) >= BATCH:
                yield rows.take()
        partial = packer.merge()
        if partial:
            rows.emit(partial, is_open=True)
        yield rows.take()

    return run


def _merge_partials(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, window = None, None, []

        def close():
            if window:
                rows.emit(window)

        for batch in batches:
            for group_now, doc, start, total, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group_now != group:
                    close()
                    group, window = group_now, []
                    if rows is not None and rows.rows:
                        yield rows.take().drop_columns(["open"])
                    rows = _Rows((1 << 62) | (group << 32), pa.int64(), with_ids=with_ids)
                window = fill([*window, (doc, start, np.frombuffer(raw, dtype="<u4"), total)], rows.emit, length) or []
        close()
        if rows is not None and rows.rows:
            yield rows.take().drop_columns(["open"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, max_waste: int = MAX_WASTE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless switched off, ids (u32, little-endian)."""
    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    packed = source.mapInArrow(_pack_partition(tokenizer or default_tokenizer(), length, open_windows, max_waste, end_id, with_ids), PIECES + ", open boolean, part long")
    stored, _ = materialize(packed, "packed", partition_by=["open"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    partial = stored.where("open").select((F.col("part") / MERGE_PARTITIONS).cast("long").alias("group"), "part", "offset", "doc_id", "start", "doc_tokens", "ids")
    ordered = partial.repartition("group").sortWithinPartitions("group", "part", "offset")
    merged = ordered.select("group", "doc_id", "start", "doc_tokens", "ids").mapInArrow(_merge_partials(length, with_ids), PIECES)
    return stored.where("NOT open").select(*names).unionByName(merged.select(*names))
