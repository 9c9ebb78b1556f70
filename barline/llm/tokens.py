"""Token counts by heap-driven byte-pair merging, without producing token ids.

A text is cut at the vocabulary's special strings (one token each) and into pre-tokens.
The bytes of a pre-token are a linked list of symbols; a heap holds the adjacent pairs by
merge rank and place.  The lowest is popped and merged until no ranked pair is left, so a
pre-token counts its bytes minus its merges.  Counts of pre-tokens are remembered in a
table of bounded size per Python worker.

Cases: NULL and empty texts have 0 bytes and 0 tokens; rows are neither dropped nor joined,
so repeated rows count again; other columns of the input are ignored; a long text is
processed whole, pre-token by pre-token.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.text import pieces

#: Pre-tokenization of byte-level vocabularies (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points that joined Unicode after the tokenizer library's character tables were made;
#: the library takes them for symbols, newer tables for letters or numbers (fixed value, ranges in hexadecimal).
YOUNG = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_YOUNG = "[" + "".join("-".join(f"\\U{int(end, 16):08x}" for end in span.split("-")) for span in YOUNG.split()) + "]"

#: Parts remembered per worker and table, and the longest one that is.
REMEMBERED = 600_000
REMEMBERED_CHARS = 48


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: itself if visible, else counted from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_merges(lines: list) -> dict[int, int]:
    """Rank of every mergeable pair; a pair of symbols is one number, a merged symbol is 256 plus its rank."""
    as_byte = byte_symbols()
    number = {c: b for c, b in as_byte.items()}
    ranks: dict[int, int] = {}
    for rank, line in enumerate(lines):
        a, b = line.split(" ") if isinstance(line, str) else line
        ranks[number[a] << 32 | number[b]] = rank
        number.setdefault(a + b, 256 + rank)
    return ranks


def merged_length(symbols: bytes, ranks: dict[int, int]) -> int:
    """Initial symbols minus merges.  A heap entry is rank and place in one number."""
    n = len(symbols)
    if n < 2:
        return n
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    parts = [*symbols, -1]
    heap = []
    for i in range(n - 1):
        rank = get(parts[i] << 32 | parts[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return n
    heapq.heapify(heap)
    left, right = list(range(-1, n)), list(range(1, n + 2))
    merges = 0
    while heap:
        top = pop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        if parts[i] < 0 or (j := right[i]) >= n or get(parts[i] << 32 | parts[j]) != rank:
            continue  # one side has been merged meanwhile
        parts[i], parts[j] = 256 + rank, -1
        right[i] = k = right[j]
        merges += 1
        if k < n:
            left[k] = i
            rank = get(parts[i] << 32 | parts[k])
            if rank is not None:
                push(heap, rank << 32 | i)
        h = left[i]
        if h >= 0:
            rank = get(parts[h] << 32 | parts[i])
            if rank is not None:
                push(heap, rank << 32 | h)
    return n - merges


class Memo(dict):
    """Counts of text parts, worked out on first use; the older half goes when it is full."""

    def __init__(self, work: Callable[[str], int], keep: Callable[[str], bool]) -> None:
        super().__init__()
        self.work, self.keep = work, keep

    def __missing__(self, part: str) -> int:
        n = self.work(part)
        if self.keep(part):
            if len(self) >= REMEMBERED:
                for old in list(islice(self, REMEMBERED // 2)):
                    del self[old]
            self[part] = n
        return n


class Counter:
    """Counts tokens of texts; made once per Python worker from the vocabulary's parts.

    A single space between two characters that are no white space always begins a pre-token,
    and a single line feed between two such characters is one.  So texts are cut there first
    and whole chunks are remembered as well; texts with other white space are matched as a whole.
    """

    def __init__(self, ranks: dict[int, int], specials: list[str]) -> None:
        self.find = regex.compile(PRE_TOKENS).findall
        as_symbols = PRE_TOKENS.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{_YOUNG})")
        for kind in "LN":
            as_symbols = as_symbols.replace(rf" ?\p{{{kind}}}+", rf" ?[\p{{{kind}}}--{_YOUNG}]+")
        self.young, self.find_young = regex.compile(_YOUNG).search, regex.compile("(?V1)" + as_symbols).findall
        ordered = sorted(specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, ordered))) if ordered else None
        self.tokens = Memo(lambda t: merged_length(t.encode("utf-8", "surrogatepass"), ranks), lambda t: len(t) <= REMEMBERED_CHARS)
        self.spaced = Memo(lambda word: self.matched(" " + word), lambda word: len(word) <= REMEMBERED_CHARS)

    def matched(self, text: str) -> int:
        find = self.find if text.isascii() or not self.young(text) else self.find_young
        return sum(map(self.tokens.__getitem__, find(text)))

    def plain(self, text: str) -> int:
        lines = text.split("\n")
        total = len(lines) - 1
        for line in lines:
            words = line.split()
            if not words or line.split(" ") != words:
                return self.matched(text)
            total += self.matched(words[0]) + sum(map(self.spaced.__getitem__, words[1:]))
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        total, at = 0, 0
        for match in self.special.finditer(text):
            total += 1 + self.plain(text[at : match.start()])
            at = match.end()
        return total + self.plain(text[at:] if at else text)


def read_vocabulary(path: str) -> tuple[list, list[str]]:
    """Merges and special strings of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    return content["model"]["merges"], [t["content"] for t in content.get("added_tokens", ())]


def token_counts(docs: DataFrame, spark: SparkSession, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    The driver reads the vocabulary file and broadcasts its merges, which are bounded by
    the vocabulary's size.
    """
    shared = spark.sparkContext.broadcast(dict(zip(("merges", "specials"), read_vocabulary(path))))

    key = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value  # one object per Python worker, so later tasks find the memos filled
        if "counter" not in state:
            state["counter"] = Counter(load_merges(state["merges"]), state["specials"])
        counter = state["counter"]
        for batch in pieces(batches):
            tokens = [0 if t is None else counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return counted.mapInArrow(run, f"doc_id {key}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
