"""Secret scan: rule spans and dictionary-primed zstandard novelty.

Rule kinds are ``assign`` (a value given to a secret-like name), ``access`` (access key ids)
and ``hex`` (long hexadecimal runs).  The method adds ``novel`` spans: a token of mixed
characters that follows a sensitive word is compressed behind its surroundings with a
compressor primed with a dictionary of code words and identifiers; its marginal bytes are
the extra bytes it costs.  Prose, identifiers and repeats of the surroundings cost little,
random material close to its own entropy; what can hardly be compressed is reported.

Cases: NULL and empty texts have no span; positions are code points, ends exclusive; repeated
rows are scanned again; equal spans of one kind cannot occur, of several kinds are ordered as
the kinds are listed; other columns of the input are kept out of the result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.stage import spare_memory
from barline.llm.text import pieces

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Words after which a token is worth measuring, and how far after (characters).
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authoriz|client[ _-]?id", re.IGNORECASE | re.ASCII)
SENSITIVE_PARTS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "authoriz", "client")
REACH = 40
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")

#: Surroundings compressed in front of a candidate (characters on its left and right).
AROUND = 400
#: A candidate is reported from this many marginal bytes per character; random base64 costs about 1, joined identifiers up to 0.8.
NOVELTY = 0.85

#: Priming dictionary: words of code, configuration and common identifiers.
PRIMER = " ".join((
    "password passwd passphrase secret token api_key apikey access_key private_key credential bearer authorization client_id client_secret",
    "import export function return const static public private class struct void string integer boolean float double null none true false",
    "http https www localhost example com org net index html json yaml config settings default environment variable value",
    "username user_name user_id session_id request_id created_at updated_at timestamp database connection host port timeout",
    "getElementById addEventListener toString parseInt System.out.println self.assertEqual logging.getLogger os.environ.get",
    "the of and to in is that for it was on are as with be by at from this have not or an they which one you had but all were",
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 12345678 xxxxxxxx aaaaaaaa",
)).encode()


class Novelty:
    """Marginal compressed size with one primed compressor per Python worker task."""

    def __init__(self, primer: bytes = PRIMER, level: int = 3) -> None:
        primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def per_char(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).encode("utf-8", "surrogatepass")
        token = text[start:end].encode()
        return (len(self.pack(around + b"\n" + token)) - len(self.pack(around + b"\n"))) / max(1, end - start)


def mixed_token(token: str) -> bool:
    """Digits beside letters, and not one character over and over."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and len(set(token)) >= 8


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rule kinds."""
    found = []
    lower = text.lower()
    if any(name in lower for name in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: Texts without a match hold no span of any kind: every rule and every sensitive word is named here (for Java's patterns).
MAY_HOLD = "(?i)passw|passphrase|secret|token|key|credential|bearer|authoriz|client|(?-i)AKIA[A-Z0-9]{12}|[0-9a-f]{32}"


def novel_spans(text: str, known: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, marginal bytes per character) of incompressible tokens that no known span covers.

    ``known`` is in order of its starts.
    """
    lower = text.lower()
    if not any(part in lower for part in SENSITIVE_PARTS):
        return []
    out, done = [], set()
    # known spans by their start; upto[i] is the furthest end of the first i of them, so one search tells what is covered
    starts = [s for s, _, _ in known]
    upto = [0, *accumulate((e for _, _, e in known), max)]
    for word in SENSITIVE.finditer(text):
        for token in CANDIDATE.finditer(text, word.end(), min(len(text), word.end() + REACH + 4096)):
            start, end = token.span()
            if start > word.end() + REACH:
                break
            if end == word.end() + REACH + 4096 and end < len(text):
                end = CANDIDATE.match(text, start).end()
            if start in done or upto[bisect_left(starts, end)] > start:
                continue
            done.add(start)
            if mixed_token(text[start:end]):
                score = novelty.per_char(text, start, end)
                if score >= least:
                    out.append((start, 3, end, score))
    return out


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(spans))


def scan(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """doc_id, counts per kind, base_sha256 (rule spans), spans (all), n_novel and the highest novelty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in pieces(batches):
            counts, digests, lists, best = [[], [], [], []], [], [], []
            for text in batch.column(1).to_pylist():
                rules = rule_spans(text) if text else []
                novel = novel_spans(text, rules, novelty, least) if text else []
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in rules))
                counts[3].append(len(novel))
                digests.append(hashlib.sha256(listed(rules).encode()).hexdigest())
                lists.append(listed(rules + novel))
                best.append(max((score for *_, score in novel), default=None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(best, pa.float64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "novelty"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, novelty double"
    )


def redacted(docs: DataFrame, mark: str = "[REDACTED]", least: float = NOVELTY) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by ``mark``.

    Overlapping spans are replaced once as a whole; texts without a span stay byte for byte, NULL stays NULL.
    Only texts that may hold a span travel to Python.
    """

    def clean(text: str, novelty: Novelty) -> str:
        rules = rule_spans(text)
        parts, at = [], 0
        for start, _, end, *_ in sorted(rules + novel_spans(text, rules, novelty, least)):
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join(parts) + text[at:] if at else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in pieces(batches):
            at = batch.schema.get_field_index("text")
            texts = [clean(t, novelty) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        spare_memory()

    may_hold = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    return docs.filter(may_hold).mapInArrow(run, docs.schema).union(docs.filter(~may_hold))
