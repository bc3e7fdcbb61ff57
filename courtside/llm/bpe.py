"""Byte-level BPE: encode with a priority queue of merge ranks, decode by concatenating vocabulary strings.

A text is cut at added tokens, then by the pre-token pattern. The symbols of a pre-token form a doubly linked list; a
heap holds ``(rank, position)`` of the pairs that can merge. Popped entries whose pair has since changed are stale and
skipped. The ids of a pre-token are kept in a cache of bounded size, so memory does not follow the corpus.

Spark deals the rows; a task encodes Arrow batches and no row leaves its partition, so there is no shuffle, no hot
key, and a lost executor costs only its own partitions. A null text counts as empty (no ids, empty decoded text);
texts of any length are encoded whole; extra columns pass by unless selected.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.frames import map_texts, quoted, with_fields

#: Fixed value: the published pre-token pattern of byte-level vocabularies, with white space by its Unicode property.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same cuts for the standard library's faster matcher, for texts without the characters that it classes otherwise:
#: letter-like and other numbers, and the information separators (see ``_unusual``).
PLAIN_PRE_TOKEN = r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Pre-tokens kept in a worker's cache before it starts afresh, and the longest that is worth keeping.
CACHE_WORDS, CACHE_CHARS = 1 << 18, 48


def default_vocabulary() -> str:
    """The installed public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _unusual() -> re.Pattern:
    """Finds the characters that the two patterns class differently, and any beyond the basic plane."""
    plane = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    letters, numbers = set(regex.findall(r"\p{L}", plane)), set(regex.findall(r"\p{N}", plane))
    found = [c for c in plane if "\x1c" <= c <= "\x1f" or (c in letters) != c.isalpha() or (c in numbers) != c.isdecimal()]
    return re.compile("[" + re.escape("".join(found)) + "\U00010000-\U0010ffff]")


class ByteBpe:
    """One vocabulary, ready to encode and decode. Build it with :func:`from_json`."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letters = byte_letters()
        self.of_byte = [vocabulary[letters[b]] for b in range(256)]
        self.rank = {(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [vocabulary[a + b] for a, b in merges]
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        bytes_of = {c: b for b, c in letters.items()}
        self.bytes = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, i in (vocabulary | added).items():
            self.bytes[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        self.digits = [str(i) for i in range(len(self.bytes))]
        self.pre_token = regex.compile(PRE_TOKEN)
        self.plain, self.unusual = re.compile(PLAIN_PRE_TOKEN), _unusual()
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_json(cls, content: str) -> ByteBpe:
        """From the text of a tokenizer file: its model's vocabulary and merges and its added tokens."""
        parts = json.loads(content)
        model = parts["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in parts.get("added_tokens", [])})

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to one pre-token's symbols: lowest rank first, leftmost among equals."""
        n, rank, made = len(symbols), self.rank, self.made
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbols[i] < 0 or rank.get((symbols[i], symbols[j])) != r:
                continue  # stale: one of the two has been merged meanwhile
            k = after[j]
            symbols[i], symbols[j], after[i] = made[r], -1, k
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h))
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> tuple[int, ...]:
        of_byte = self.of_byte
        ids = tuple(self.merge([of_byte[b] for b in word.encode()]))
        if len(word) <= CACHE_CHARS:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of a text, pre-token by pre-token."""
        known, miss = self.words.get, self._word
        for k, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if k % 2:
                yield (self.added[part],)
                continue
            cut = self.plain if not self.unusual.search(part) else self.pre_token
            for word in cut.findall(part):
                yield known(word) or miss(word)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of added tokens become those tokens."""
        return list(chain.from_iterable(self.pieces(text)))

    def decode(self, ids: list[int]) -> str:
        """Concatenated vocabulary strings; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _worker_bpe(content: str) -> ByteBpe:
    return ByteBpe.from_json(content)


def _vocabulary(df: DataFrame, path: str | None):
    """The tokenizer file as a broadcast string: about a megabyte, set by the vocabulary and not by the data."""
    return df.sparkSession.sparkContext.broadcast(Path(path or default_vocabulary()).read_text(encoding="utf-8"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row, texts whole; null or empty texts have no ids."""
    shared = _vocabulary(df, vocabulary)
    schema = with_fields(df, [id_col], "ids: array<int>")

    def run(batches):
        bpe = _worker_bpe(shared.value)
        for batch in batches:
            ids = pa.array([bpe.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return map_texts(df.select(F.col(id_col), F.col(text_col)), run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, text)``: the inverse of :func:`encode`; a null list of ids gives an empty text."""
    shared = _vocabulary(df, vocabulary)
    schema = with_fields(df, [id_col], "text: string")

    def run(batches):
        bpe = _worker_bpe(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return map_texts(df.select(F.col(id_col), F.col(ids_col)), run, schema)


def token_lengths(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the encoded length of each whole text (null or empty: 0)."""
    shared = _vocabulary(df, vocabulary)
    schema = with_fields(df, keep, "n_tokens: bigint")

    def run(batches):
        bpe = _worker_bpe(shared.value)
        for batch in batches:
            n = pa.array([sum(map(len, bpe.pieces(t or ""))) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return map_texts(df.select(*quoted(keep), F.col(text_col).alias("__text")), run, schema)


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, its ids decoded, both digested."""
    shared = _vocabulary(df, vocabulary)
    schema = with_fields(df, [id_col], "n_tokens: bigint, ids_sha256: string, decoded_sha256: string")

    def run(batches):
        bpe = _worker_bpe(shared.value)
        digits = bpe.digits.__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(df.select(F.col(id_col), F.col(text_col)), run, schema)
