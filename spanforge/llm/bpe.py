"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts a text where its low bits are
zero, so that a passage is cut alike in every document that holds it. Documents
are dealt to tasks by the smallest chunk hash of theirs, which brings documents
that share passages together, next to each other in a task's order; a task
encodes a chunk once and reuses its ids for every later document. Where two chunks meet, a window around the join is
encoded again and widened, word by word, until the ids at both of its rims
agree with those of the chunks; then it replaces them.

Dealing is by a rebalancing exchange, whose large partitions Spark splits, so
that a hot group of copies is spread: the ids never depend on the partition.
Memory is bounded: a worker's memo of chunks holds about ``MEMO_BYTES`` and is
emptied when full; that of words has an older and a newer half of
``MEMO_WORDS`` each, of which the older is given up when the newer is full.

White space always ends a token of this vocabulary (it is dropped before the
merges and no special token holds any), so words are the rims of agreement. An
encoder tries this when it loads and refuses a vocabulary that does otherwise.

Defined results for odd input
    Null text is the empty text: 0 tokens and the hash of no bytes. Repeated
    rows each come back. An empty table gives no rows. A null doc_id is kept.
    Very long texts are encoded whole; other columns are not read. Documents
    that tie in their least chunk hash lie next to each other, in any order,
    which changes no result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import read

WINDOW, MASK, LEAST = 16, 2047, 256
MEMO_BYTES, MEMO_WORDS = 64 << 20, 400_000
#: The white space that bytes.split() takes, all of it white space to the tokenizer.
SPACES = b" \t\n\r\x0b\x0c"
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each place, by doubling the width."""
    h, width, power = _TABLE[data], 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while width < WINDOW:
            wider = h.copy()
            wider[width:] += h[:-width] * power
            h, width, power = wider, width * 2, power * power
    return h ^ (h >> np.uint64(29))


def cuts(raw: bytes) -> list[int]:
    """Where chunks begin, 0 first and len(raw) last; never inside a character."""
    if len(raw) <= LEAST:
        return [0, len(raw)] if raw else [0]
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((rolling(data) & np.uint64(MASK)) == 0) + 1
    at = at[at < len(raw)]
    at = at[(data[at] & 0xC0) != 0x80]
    out = [0]
    for x in at.tolist():
        if x - out[-1] >= LEAST:
            out.append(x)
    return [*out, len(raw)]


def route(raw: bytes) -> int:
    """The smallest chunk hash: alike for documents that share their passages."""
    at = cuts(raw)
    return min((int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(at, at[1:])), default=0)


class Encoder:
    """Encodes whole texts to ids; one for each worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.check()
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
        self.held = 0

    def check(self) -> None:
        """Words between white space are encoded alike alone and in any company, or this is no vocabulary for us."""
        ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        bits = ["a", "The", "'s", "x'll", "23", "!?", "...", "\u00e9", "e\u0301", "\u0301", "\u03a3", "\u65e5\u672c", "\U0001f44d", "<|end", "of|>", "\ufb01n", "don't-stop"]
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        strips = any(t.lstrip or t.rstrip or t.single_word for t in self.lib.get_added_tokens_decoder().values())
        alone = {b: ids(b) for b in bits + added}
        if strips or any(len(a.split()) != 1 or a != a.strip() for a in added) or any(ids(f"{a}{gap}{b}") != alone[a] + alone[b] for a in alone for b in alone for gap in (" ", "\n", " \t ")) or ids(" a ") != alone["a"]:
            raise ValueError("white space does not end every token of this vocabulary, so its chunks can't be encoded by words")

    def learn(self, pieces: list[list[bytes]]) -> None:
        """Put the words of ``pieces`` into the memo, the new ones encoded in one go."""
        if len(self.words) > MEMO_WORDS:  # what is used again moves from the older half to the newer
            self.words, self.before = {}, self.words
        memo, before = self.words, self.before
        new = set().union(*pieces).difference(memo)
        if old := [w for w in new if w in before]:
            memo.update((w, before[w]) for w in old)
            new.difference_update(old)
        todo = list(new)
        for at in range(0, len(todo), 5000):
            part = todo[at : at + 5000]
            for w, e in zip(part, self.lib.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)):
                memo[w] = np.array(e.ids, "<u4").tobytes()

    def window(self, raw: bytes) -> bytes:
        return np.array(self.lib.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raws = [t.encode() for t in texts]
        chunked = [[raw[a:b] for a, b in zip(at, at[1:])] for raw, at in zip(raws, map(cuts, raws))]
        if self.held > MEMO_BYTES:
            self.chunks.clear()
            self.held = 0
        new = {c: c.split() for c in set().union(*chunked).difference(self.chunks)}
        self.learn(list(new.values()))
        for c, words in new.items():
            self.chunks[c] = (words, list(map(self.words.__getitem__, words)))
            self.held += 12 * len(c) + 200
        return [self.assemble(c) for c in chunked]

    def assemble(self, pieces: list[bytes]) -> bytes:
        words: list[bytes] = []
        ids: list[bytes] = []
        open_end = False
        for piece in pieces:
            w, e = self.chunks[piece]
            if open_end and w and words and piece[0] not in SPACES:
                self.join(words, ids, w, e)
            else:
                words += w
                ids += e
            open_end = piece[-1] not in SPACES
        return b"".join(ids)

    def join(self, words: list[bytes], ids: list[bytes], w: list[bytes], e: list[bytes]) -> None:
        """Append the chunk (w, e), whose first word goes on with the last of ``words``."""
        middle = words[-1] + w[0]
        k = 1
        while True:
            left, right = words[max(0, len(words) - 1 - k) : -1], w[1 : 1 + k]
            again = self.window(b" ".join([*left, middle, *right]))
            head, tail = b"".join(ids[len(ids) - 1 - len(left) : -1]), b"".join(e[1 : 1 + len(right)])
            agreed = again.startswith(head) and again.endswith(tail) and len(again) >= len(head) + len(tail)
            if agreed or (len(left) < k and len(right) < k):
                break
            k *= 2
        if not agreed:  # the window is all there is: its ids stand
            words[:], ids[:] = [b" ".join([*left, middle, *right])], [again]
            return
        words[-1], ids[-1] = middle, again[len(head) : len(again) - len(tail)]
        words += w[1:]
        ids += e[1:]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.lib.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and, if asked, decoded text."""

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = b["text"].fillna("")
            yield b.assign(route=[route(t.encode()) for t in b["text"]])

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for b in batches:
            for at in range(0, len(b), 256):  # lists of ids take many times the room of their bytes
                part = b.iloc[at : at + 256]
                ids = own.encode_many(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": own.decode(ids) if decode else None})

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").mapInPandas(routed, f"doc_id {kind}, text string, route long").hint("rebalance", "route").sortWithinPartitions("route")
    return dealt.select("doc_id", "text").mapInPandas(encoded, f"doc_id {kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the text decoded from them."""
    out = encode_documents(docs, path, decode=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary())
