"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of a batch of texts form one corpus: a flat array of symbols, linked to their neighbours.
An inverted index from merge rank (of a token pair) to the positions of that pair is processed in rank order;
every merge touches its two neighbours only, whose new pairs are added to the index.  A batch is an Arrow batch
(rows and bytes bounded by the session), so nothing of the texts is shuffled and a lost task is just run again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kelvingrid.llm.common import flat_utf8, frugal, spans_of


#: Pieces whose ids a worker keeps from one corpus to the next.
MEMO = 300_000
#: Bytes of text that are one corpus.
CORPUS_BYTES = 8 << 20
#: Positions that are entered into a new index at a time; bounds the temporaries.
FIRST_PAIRS = 1 << 17


class Vocabulary:
    """Ranks of a tiktoken file: token bytes, and the rank that each adjacent pair of tokens merges into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.memo: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.values = np.append(keys, np.iinfo(np.int64).max), np.array([*(pairs[k] for k in keys.tolist()), -1], np.int64)
        # ranks after which a lower rank can become possible beside the new token; usually none
        a, b = self.keys[:-1] >> 32, self.keys[:-1] & 0xFFFFFFFF
        self.unsafe = set(a[self.values[:-1] < a].tolist()) | set(b[self.values[:-1] < b].tolist())

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def replay_merges(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Token ids of every word, as little-endian 32-bit words: all merges in rank order over all words at once."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(vocabulary.tokens)) < 1 << 31 else np.int64
    symbol = vocabulary.byte_ids.astype(kind)[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words), dtype=kind), lengths)
    following, previous = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
    following[ends[lengths > 0] - 1] = -1
    previous[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray) -> None:
        """Enter pairs that begin at these positions into the index."""
        positions = positions[following[positions] >= 0]
        if not len(positions):
            return
        ranks = vocabulary.rank_of(symbol[positions], symbol[following[positions]])
        positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else []
        for lo, hi in zip(starts, [*starts[1:], len(ranks)]):
            r = int(ranks[lo])
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(positions[lo:hi])

    for lo in range(0, n, FIRST_PAIRS):
        add(np.arange(lo, min(lo + FIRST_PAIRS, n), dtype=kind))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = np.sort(at[alive[at]])
        right = following[at]
        at, right = at[right >= 0], right[right >= 0]
        fits = vocabulary.rank_of(symbol[at], symbol[right]) == rank
        at, right = at[fits], right[fits]
        if not len(at):
            continue
        # of pairs that share a symbol, the leftmost goes first
        chained = np.r_[False, at[1:] == right[:-1]]
        starts = np.flatnonzero(~chained)
        in_chain = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        take = in_chain % 2 == 0
        if rank in vocabulary.unsafe:  # one merge a word, then look again for lower ranks
            first = np.r_[True, word[at][1:] != word[at][:-1]]
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(heap, rank)
            take = first
        at, right = at[take], right[take]
        symbol[at] = rank
        alive[right] = False
        after = following[right]
        following[at] = after
        previous[after[after >= 0]] = at[after >= 0]
        before = previous[at]
        add(np.unique(np.concatenate([at, before[before >= 0]])))
    ids = symbol[alive].astype("<u4").tobytes()
    at = [0, *(4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))).tolist()]
    return [ids[lo:hi] for lo, hi in zip(at, at[1:])]


def encode_pieces(pieces: list[str], vocabulary: Vocabulary, memo: int = MEMO) -> list[bytes]:
    """Ids of distinct pieces as little-endian 32-bit words; a piece that is a token itself is that token.

    The table of the last corpus of this worker serves the next one; it starts anew beyond ``memo`` pieces.
    """
    if len(vocabulary.memo) > memo:
        vocabulary.memo = {}
    known = vocabulary.memo
    rest, raw = [], []
    for p in pieces:
        if p in known:
            continue
        b = p.encode()
        rank = vocabulary.ranks.get(b)
        if rank is None:
            rest.append(p)
            raw.append(b)
        else:
            known[p] = rank.to_bytes(4, "little")
    known.update(zip(rest, replay_merges(raw, vocabulary)))
    return [known[p] for p in pieces]


def _classes(kind: str, below: int) -> str:
    """The characters under ``below`` that are of a kind (``\\p{L}``, ``\\p{N}``, ``\\s``), as ranges for a character class."""
    hits = [i for i in range(below) if regex.match(kind, chr(i))]
    ends = [i for i in hits if i + 1 not in set(hits)]
    begins = [i for i in hits if i - 1 not in set(hits)]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(begins, ends))


@lru_cache(maxsize=4)
def splitter(pattern: str, below: int = 0x250) -> Callable[[str], list[str]]:
    """Pieces of a text.  Texts of Latin characters only take a twin of the pattern with spelled-out classes, which the faster engine knows."""
    general = regex.compile(pattern).findall
    letters, numbers, spaces = (_classes(k, below) for k in (r"\p{L}", r"\p{N}", r"\s"))
    twin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    twin = twin.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
    if r"\p" in twin or "[[" in twin:
        return general
    narrow, wide = re.compile(twin).findall, re.compile(f"[^\\x00-\\u{below - 1:04x}]").search
    return lambda text: general(text) if wide(text) else narrow(text)


def encode_texts(texts: list[str], vocabulary: Vocabulary, pattern: str, memo: int = MEMO) -> list[bytes]:
    """Ids of each text, as little-endian 32-bit words."""
    split, number = splitter(pattern), defaultdict(count().__next__)
    coded = []  # the pieces of a text as numbers of distinct pieces, which take little memory
    for t in texts:
        pieces = split(t)
        coded.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
    of = encode_pieces(list(number), vocabulary, memo).__getitem__
    return [b"".join(map(of, c.tolist())) for c in coded]


def decode_ids(ids: bytes, vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def corpora(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of the corpora of a batch, of about ``most`` bytes each; a longer text is one by itself."""
    _, offsets = flat_utf8(batch.column(1))
    for lo, hi in spans_of(offsets, most):
        yield batch.column(0).slice(lo, hi - lo), [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", corpus_bytes: int = CORPUS_BYTES) -> DataFrame:
    """Rows (id, ids): the token ids of every whole text as binary, little-endian 32-bit words.

    Null and empty texts have no ids.  Rows are independent, so repeated rows, ties and hot keys change nothing; an
    empty table gives no rows.  ``corpus_bytes`` bounds the texts that form one corpus (a longer text is its own).
    The rank file is read by every worker: its path must exist on all of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks_path)
        for b in batches:
            for ids, texts in corpora(b, corpus_bytes):
                yield pa.RecordBatch.from_arrays([ids, pa.array(encode_texts(texts, vocabulary, pattern), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Rows (doc_id, ids, decoded): the bytes that the ids stand for; null ids decode to nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks_path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                decoded = [decode_ids(x or b"", vocabulary) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, corpus_bytes: int = CORPUS_BYTES, memo: int = MEMO) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, and the ids decoded, in one pass of one worker.

    A worker that has later stages to run keeps no more than ``memo`` pieces after its task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks_path)
        for b in batches:
            for ids, texts in corpora(b, corpus_bytes):
                rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(decode_ids(x, vocabulary)).hexdigest()) for x in encode_texts(texts, vocabulary, pattern, memo)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)
        if len(vocabulary.memo) > memo:
            vocabulary.memo = {}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run if memo else frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
