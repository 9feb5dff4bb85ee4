"""Token counts by a map-side two-tier lookup.

A SentencePiece BPE model whose normaliser is the identity and which has no
piece with a space mark after another character never merges across the
start of a word.  The tokens of a text are therefore the tokens of its
pre-tokens (a word with the spaces before it), and a new line is a token by
itself wherever no piece holds one.  Both facts are checked on the model.

Tier one is a broadcast hash table with the token counts of frequent
pre-tokens: the words that are pieces of the vocabulary themselves (BPE adds
pieces by frequency), at most one entry a piece.  Tier two is a bounded cache
in each Python worker, filled by the library on a miss.  Pre-tokens are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import Memo, map_batches

#: Entries of a worker's cache, tier one included; at this size it starts afresh from tier one.
CACHE_ENTRIES = 400_000
MARK = "▁"
#: Longer pre-tokens are counted but not kept, which bounds the cache in bytes too.
KEPT_CHARS = 64


@cache
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splittable(path: str) -> bool:
    """Whether pre-tokens can be counted apart: no piece crosses a word start or holds a new line, and white space is kept."""
    sp = model(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    crossing = any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
    sample = "a  ＡÅ  \n\t é "  # identity: what NFC, NFKC or white-space removal would change
    return not crossing and sp.decode(sp.encode(sample)) == sample


def frequent(path: str) -> dict[str, int]:
    """Tier one: token counts of the vocabulary's word-initial pieces, as words."""
    sp = model(path)
    found = [p[1:] for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i))[:1] == MARK and MARK not in p[1:] and len(p) > 1]
    return dict(zip(found, map(len, sp.encode(found, num_threads=1)), strict=True))


def counter(path: str, start: dict[str, int] | None = None, entries: int = CACHE_ENTRIES):
    """A function from text to its number of tokens, through the two tiers."""
    sp = model(path)

    def count(key: str) -> int:
        """Of a pre-token without its first space, or of a new line with what follows."""
        n = len(sp.encode(key, num_threads=1))
        return n - 1 if key[:1] == "\n" else n  # there, the library's own space mark is one token more

    get = Memo(count, entries, start, KEPT_CHARS).__getitem__

    def of_line(line: str, first: bool) -> int:
        """The first line starts with the library's space mark; the others start with the new line before them."""
        parts = line.replace(MARK, " ").split(" ")
        total = 0
        if not first:
            total, parts = get("\n" + parts[0]), parts[1:]
        if "" not in parts:
            return total + sum(map(get, parts))
        empty = 0
        for word in parts:
            if word:
                total += get(" " * empty + word)
                empty = 0
            else:
                empty += 1
        if empty:
            total += 1 if empty == 1 else get(" " * (empty - 1))
        return total

    def tokens(text: str | None) -> int:
        if not text:
            return 0
        return sum(of_line(line, not i) for i, line in enumerate(text.split("\n")))

    return tokens


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text.

    Returns ``id_col, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``),
    one row per input row in any order; repeated rows and null ids give a row
    each.  A null text counts as empty: 0 bytes, 0 tokens.  Other columns of
    ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    whole = not splittable(path)
    table = spark.sparkContext.broadcast({} if whole else frequent(path))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        count = counter(path, table.value)
        if whole:
            count = lambda text: len(model(path).encode(text or "", num_threads=1))
        for b in batches:
            yield {"_id": b["_id"], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in b["_text"]], "n_tokens": [count(t) for t in b["_text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = map_batches(rows, work, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
