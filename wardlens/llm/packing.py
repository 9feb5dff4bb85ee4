"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document's ids are
cut into full windows as long as they last; the rest goes whole into the open
window in which it leaves the least room (best fit).  If none has room, a new
window is opened, and with all of them open, the fullest is emitted first.
What is open at a partition's end is merged: the leftovers of many partitions
are laid end to end and cut into full windows, so that one short window a
merging task remains.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import Memo, cut, map_batches

WINDOW, OPEN, END_ID = 2048, 64, 1
#: Entries of a worker's cache of tokenised chunks.
CACHE_ENTRIES = 500_000
#: Longer chunks are not kept, which bounds the cache in bytes too.
KEPT_CHARS = 64
#: Ids a merging task gets on average.
MERGE_IDS = 8_000_000


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers use for each byte: printable bytes stand for themselves, the others come after 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def splits_words(path: str) -> bool:
    """Whether the tokenizer normalises with NFC and lower case, drops white space, takes runs of letters, and maps bytes: what :func:`encoder` relies on."""
    spec = json.loads(tokenizer(path).to_str())
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    return [x.get("type") for x in pre] == ["Split", "ByteLevel"] and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pre[0]["pattern"].get("Regex", "") and steps == ["NFC", "Replace", "Lowercase"]


def encoder(path: str, end_id: int = END_ID, entries: int = CACHE_ENTRIES):
    """A function from texts to their ids as little-endian 32-bit bytes, ``end_id`` last.

    Where the tokenizer drops white space and never merges across it, chunks
    between spaces or new lines are encoded apart, through a bounded cache.  A word of letters is a pre-token of its own, whose bytes
    go straight to the model; a full stop or comma after it is another.
    Other chunks, and texts of other tokenizers, go through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tok = tokenizer(path)
    number = [i.to_bytes(4, "little") for i in range(tok.get_vocab_size(with_added_tokens=True))]
    pack = lambda ids: b"".join([number[i] for i in ids])
    if not splits_words(path):
        return lambda texts: [pack(e.ids) + number[end_id] for e in tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    model, letters = tok.model, byte_letters()

    class Chunks(Memo):
        def make(self, c: str) -> bytes:
            core, tail = (c[:-1], c[-1]) if c[-1] in ".," else (c, "")
            low = core.lower()
            if not low.isalpha() or "Σ" in core or not (core.isascii() or is_normalized("NFC", core) and is_normalized("NFC", low)):
                return pack(tok.encode(c, add_special_tokens=False).ids)
            if low != c:
                return self[low] + self[tail]
            found = model.tokenize(low if low.isascii() else "".join([letters[x] for x in low.encode()]))
            return number[found[0].id] if len(found) == 1 else b"".join([number[t.id] for t in found])

    marks = {"": b"", **{c: pack(tok.encode(c, add_special_tokens=False).ids) for c in ".,"}}
    get, end = Chunks(None, entries, marks, KEPT_CHARS).__getitem__, number[end_id]
    return lambda texts: [b"".join(map(get, (t or "").replace("\n", " ").split(" "))) + end for t in texts]


def pack_partition(docs: Iterator[tuple[object, bytes]], window: int = WINDOW, most_open: int = OPEN) -> Iterator[tuple[bool, list[tuple]]]:
    """Yield (whether the window is closed, its pieces (id, start, ids, document's ids)); the leftovers come last."""
    open_windows: list[list] = []  # [ids used, pieces]
    for doc, data in docs:
        n, at = len(data) // 4, 0
        while n - at >= window:
            yield True, [(doc, at, data[4 * at : 4 * (at + window)], n)]
            at += window
        rest = n - at
        if not rest:
            continue
        fits = [w for w in open_windows if w[0] + rest <= window]
        if fits:
            w = max(fits, key=lambda w: w[0])
        else:
            if len(open_windows) == most_open:
                full = max(open_windows, key=lambda w: w[0])
                open_windows.remove(full)
                yield True, full[1]
            w = [0, []]
            open_windows.append(w)
        w[0] += rest
        w[1].append((doc, at, data[4 * at :], n))
        if w[0] == window:
            open_windows.remove(w)
            yield True, w[1]
    for w in open_windows:
        yield False, w[1]


def rows(windows: Iterator[tuple[int | None, list[tuple]]], keep_ids: bool) -> Iterator[dict]:
    """Output columns of windows with their sequence ids (None: a leftover, whose ids are kept)."""
    names = ("_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    out: dict[str, list] = {k: [] for k in names}
    for seq, pieces in windows:
        offset = 0
        for doc, start, data, n in pieces:
            for k, v in zip(names, (doc, start, len(data) // 4, zlib.crc32(data), n, seq, offset, data if keep_ids or seq is None else None), strict=True):
                out[k].append(v)
            offset += len(data) // 4
        if len(out["start"]) >= 2000:
            yield out
            out = {k: [] for k in names}
    yield out


def merge(pieces: Iterator[tuple], window: int) -> Iterator[list[tuple]]:
    """Lay pieces (id, start, ids, document's ids) end to end and cut the run into windows; only the last can be short."""
    got, used = [], 0
    for doc, start, data, n in pieces:
        while data:
            part = data[: 4 * (window - used)]
            got.append((doc, start, part, n))
            used, start, data = used + len(part) // 4, start + len(part) // 4, data[len(part) :]
            if used == window:
                yield got
                got, used = [], 0
    if got:
        yield got


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, most_open: int = OPEN, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack every document into sequences of at most ``window`` ids.

    One row per piece: ``id_col, start`` (its document's ids before it),
    ``length, ids_crc32`` (of the ids as little-endian 32-bit numbers),
    ``doc_tokens, sequence_id, offset`` (in the sequence, gapless from 0) and,
    with ``keep_ids``, ``ids`` (binary).  Each id of a document lies in exactly
    one piece.  A null or empty text is a document of the end id alone; repeated
    rows are packed each on their own; an empty table gives no rows.  Other
    columns of ``docs`` are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"

    def first(batches: Iterator[dict]) -> Iterator[dict]:
        encode, seq = encoder(path, end_id), TaskContext.get().partitionId() << 32
        stream = (x for b in batches for x in zip(b["_id"], encode(b["_text"]), strict=True))
        numbered = ((seq + k if closed else None, pieces) for k, (closed, pieces) in enumerate(pack_partition(stream, window, most_open)))
        yield from rows(numbered, keep_ids)

    placed = cut(map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), first, schema), "packed")
    left = placed.where(F.col("sequence_id").isNull())
    total = left.agg(F.sum("length")).first()[0] or 0

    def second(batches: Iterator[dict]) -> Iterator[dict]:
        seq = (1 << 62) + (TaskContext.get().partitionId() << 32)
        stream = (x for b in batches for x in zip(b["_id"], b["start"], b["ids"], b["doc_tokens"], strict=True))
        yield from rows(((seq + k, w) for k, w in enumerate(merge(stream, window))), keep_ids)

    # The order in a merging task is by content, so that a task that runs again gives the same sequences.
    dealt = left.repartition(-(-total // MERGE_IDS) or 1, "_id", "start", "ids_crc32").sortWithinPartitions("_id", "start", "ids_crc32")
    out = placed.where(F.col("sequence_id").isNotNull()).unionByName(map_batches(dealt.select("_id", "start", "ids", "doc_tokens"), second, schema))
    return out.withColumnRenamed("_id", id_col) if keep_ids else out.drop("ids").withColumnRenamed("_id", id_col)
