"""Operator 8: secret scans by token efficiency.

Base patterns find assigned values, access keys and hexadecimal runs.  The method adds random strings:
ordinary text takes few tokens of a byte-level BPE vocabulary for its length, random characters take many,
so a run of ``RUN_CHARS`` or more characters of an encoded value with under ``CHARS_PER_TOKEN`` characters a
token is a secret unless it is a known digest or identifier (a UUID, a hexadecimal digest, a number, a date)
or lies in a base span.  Rare words can take as many tokens, so runs that are spelled as words are (letters of one case,
or with a capital first, any marks between) must also have letters that follow each other as those of words don't: the
odds of drawing them blindly against those of the vocabulary's own words must be over e to the ``BLIND_ODDS``.  Odds
grow with a run's length by themselves, so one bound serves all lengths.

The vocabulary file is read by the driver and sent to the tasks, so that executors need no copy of it.

Defined results: a null text is empty and has no spans; every row gives a row, repeated ones the same; offsets count
code points; spans that start together come in the order of the kinds; a long text is scanned in one go, a long run
of one piece is cut into pieces of ``PIECE_CHARS`` for counting tokens; an empty table gives an empty table; columns
other than key and text don't matter.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RUN_CHARS, CHARS_PER_TOKEN = 12, 2.2
BLIND_ODDS = 6.0
#: The base patterns.  Only ASCII letters of the names ignore case.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN_CHARS)
#: Letters as words have them, with any marks between.
WORDLIKE = re.compile(r"[+/_=-]*[A-Za-z](?:[a-z+/_=-]*|[A-Z+/_=-]*)")
#: Known digests and identifiers.
KNOWN = re.compile(
    r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9+/_=-]+|\d{4}-\d\d-\d\dT.*"
)
KINDS = ("assign", "access", "hex", "random")
#: The GPT-2 style split of text before BPE, for the vocabulary above.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

Span = tuple[int, int, int]  # start, kind, end


PIECE_CHARS = 2048


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """A .tiktoken file: a token in base64 and its rank a line."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise FileNotFoundError(f"the vocabulary {path} can't be read by the driver: {e}") from e


@functools.lru_cache(maxsize=4)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(run: str, vocabulary: bytes) -> int:
    encode = _encoder(vocabulary).encode_ordinary
    return sum(len(encode(run[at : at + PIECE_CHARS])) for at in range(0, len(run), PIECE_CHARS))


@functools.lru_cache(maxsize=4)
def _letter_odds(vocabulary: bytes) -> dict[str, float]:
    """For each pair of letters: the log of a blind draw's probability against that of the second after the first in the vocabulary's words."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {a + b: 0.5 for a in letters for b in letters}
    for line in vocabulary.splitlines():
        token = base64.b64decode(line.split()[0]).strip().lower()
        if token.isalpha():  # of bytes: ASCII letters
            word = token.decode()
            for a, b in zip(word, word[1:]):
                counts[a + b] += 1
    after = {a: sum(counts[a + b] for b in letters) for a in letters}
    return {ab: math.log(after[ab[0]] / (len(letters) * n)) for ab, n in counts.items()}


def blind_odds(run: str, vocabulary: bytes) -> float:
    """The log odds that the letters of ``run`` were drawn blindly rather than as words have them; marks don't count."""
    odds = _letter_odds(vocabulary)
    letters = [c for c in run.lower() if c.isalpha()]
    return sum(odds[a + b] for a, b in zip(letters, letters[1:]))


def base_spans(text: str) -> list[Span]:
    """Matches, leftmost and not overlapping in each kind, less those too short."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[Span], vocabulary: bytes) -> list[Span]:
    """Runs that take many tokens, outside ``base``, which is in order."""
    out, at, covered = [], 0, 0
    for m in RUN.finditer(text):
        run = m[0]
        while at < len(base) and base[at][0] < m.end():  # spans that start before the run's end; covered: how far they reach
            covered, at = max(covered, base[at][2]), at + 1
        if covered > m.start() or KNOWN.fullmatch(run):
            continue
        if WORDLIKE.fullmatch(run) and blind_odds(run, vocabulary) <= BLIND_ODDS:
            continue
        if len(run) < CHARS_PER_TOKEN * count_tokens(run, vocabulary):
            out.append((m.start(), 3, m.end()))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, base, spans, counts) of every row; spans are arrays of (start, kind, end) in code points."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # under 1 MB

    def of(parts: Iterator[tuple]) -> Iterator[tuple]:
        for key_, t in parts:
            base = base_spans(t or "")
            yield key_, base, sorted(base + random_spans(t or "", base, shared.value))

    span = "array<struct<start: int, kind: int, end: int>>"
    return map_rows(rows, lambda p: ((k, _dicts(b), _dicts(s)) for k, b, s in of(p)), f"key {rows.schema['key'].dataType.simpleString()}, base {span}, spans {span}")


def _dicts(spans: list[Span]) -> list[dict]:
    return [{"start": s, "kind": k, "end": e} for s, k, e in spans]


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
    return found.select(
        F.col("key").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )
