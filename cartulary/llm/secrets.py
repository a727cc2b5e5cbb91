"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

A random key shares nothing with the code around it nor with common identifiers and word parts. For
each distinct candidate in a sensitive context the marginal cost is measured: bytes of the compressed
context with the candidate less those without it, both primed with a dictionary. Copies of the
candidate are taken out of the context first, so a key that is written twice is as new as one written
once. A word, a path or a common name costs a few bytes, a key nearly its entropy.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and their shortest matches.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_SHORTEST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_SHORTEST = 18
HEX = re.compile(r"[0-9a-f]{16,}")

#: The added kind, last in the order of kinds.
NOVEL = "novel"
KINDS = ("assign", "access", "hex", NOVEL)

#: Words that make a context sensitive, within ``CONTEXT`` characters before a candidate.
SENSITIVE = re.compile(
    r"passw|passphrase|secret|token|api.?key|private.?key|access.?key|credential|bearer"
    r"|authorization|signature|client.?id|conn(?:ection)?.?str",
    re.IGNORECASE | re.ASCII,
)
#: One of these is in every text that ``SENSITIVE`` matches, lower-cased.
STEMS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "authori",
         "signature", "client", "conn")
#: Characters of the shortest candidate.
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
CONTEXT = 64
#: Characters on each side that the compressor may draw on.
SURROUNDING = 512
#: Least marginal bytes per character of a reported candidate.
NOVELTY = 0.62
#: The same for letters of one case.
ONE_CASE = 0.7
#: Runs beyond this are measured in pieces of this length.
PIECE = 4096

#: Common identifiers and word parts that prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret"
    " authorization bearer credential signature username user_name hostname localhost database"
    " connection_string configuration environment production development application default"
    " timestamp created_at updated_at description identifier reference repository https://www."
    " http:// example.com /usr/local/ /var/log/ index.html function return import export class"
    " public static void string integer boolean null true false undefined self this value key"
    " name type data id 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    " AAAAAAAA 00000000 xxxxxxxx XXXXXXXX -------- ======== ________"
    " international communication representation responsibility understanding establishment"
    " administration characteristic implementation initialization transformation interpretation"
    " authentication compatibility serialization synchronization specification"
    " verschiedenheit gesellschaft entwicklung wissenschaftlich möglichkeiten"
    " gouvernement développement naturellement desarrollo conocimiento universidad"
    " ABSTRACT INTERFACE IMPLEMENTATION CONFIGURATION INTERNATIONAL ENVIRONMENT_VARIABLE"
)


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(
        IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    return zstandard.ZstdCompressor(
        level=19, dict_data=primer, write_checksum=False, write_content_size=False
    )


def marginal_bytes(candidate: str, surroundings: str, known: int | None = None) -> int:
    """Bytes that the candidate adds to its compressed surroundings, which take ``known``."""
    if known is None:
        known = compressed_size(surroundings)
    return compressed_size(surroundings + candidate) - known


def compressed_size(text: str) -> int:
    return len(_compressor().compress(text.encode()))


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether every piece of the run costs at least ``NOVELTY`` bytes a character.

    Letters of one case are as often long words as keys: they must cost ``ONE_CASE``.
    """
    run = text[start:end]
    around = text[max(0, start - SURROUNDING) : start] + " " + text[end : end + SURROUNDING]
    around = around.replace(run, " ")
    least = ONE_CASE if run.isalpha() and (run.islower() or run.isupper()) else NOVELTY
    known = compressed_size(around)
    for at in range(0, len(run), PIECE):
        piece = run[at : at + PIECE]
        if len(piece) >= SHORTEST and marginal_bytes(piece, around, known) < least * len(piece):
            return False
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(x in low for x in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_SHORTEST:
                found.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_SHORTEST:
                found.append(("access", m.start(), m.end()))
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts, ends = [], []
    for start, end in sorted((s, e) for _, s, e in spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def novel_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates after a sensitive word that no base span touches and that are novel.

    A distinct candidate is measured once, where it comes first. Only the characters within reach of
    a sensitive word are searched, so the time grows with the text.
    """
    low = text.lower()
    if not any(x in low for x in STEMS):
        return []
    found, known = [], {}
    done = 0
    starts, ends = _merged(base)
    for word in SENSITIVE.finditer(text):
        at, stop = max(done, word.end()), word.end() + CONTEXT
        while at < stop:
            m = CANDIDATE.search(text, at, stop + SHORTEST)
            if m is None or m.start() >= stop:
                break
            m = CANDIDATE.match(text, m.start())  # the whole run
            at = done = m.end()
            before = bisect_right(starts, m.end() - 1)
            if before and ends[before - 1] > m.start():
                continue
            run = m[0]
            if run not in known:
                known[run] = is_novel(text, m.start(), m.end())
            if known[run]:
                found.append((NOVEL, m.start(), m.end()))
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered(spans))


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with each stretch of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for _, start, end in ordered(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


_FOUND = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string,"
    " n_novel long, masked string"
)
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def scan_secrets(
    docs: DataFrame, mask: str | None = None, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Spans of secrets in every whole text: counts, a digest of the base spans, all spans.

    Spans are ``kind:start:end`` in code points, end exclusive. ``masked`` is the text with the
    spans replaced by ``mask`` (null without a mask, or for a null text). A null text is empty
    and has no spans; repeated rows give repeated results. ``keep`` are columns passed on.
    """
    read = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = [name for name in keep if name not in _NAMES]
    schema = T.StructType([*(read.schema[x] for x in kept), *T.StructType.fromDDL(_FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch["__text"].to_pylist():
                base = base_spans(text) if text else []
                more = novel_spans(text, base) if text else []
                n = [sum(x[0] == kind for x in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                clean = masked(text, base + more, mask) if text is not None and mask else None
                rows.append((*n, digest, joined(base + more), len(more), clean))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch[x] for x in kept]
                + [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
                kept + _NAMES,
            )

    return read.mapInArrow(run, schema)
