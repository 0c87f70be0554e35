"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

A candidate's context is sensitive with a sensitive word before or after it, or where it adjoins such a candidate with
only line breaks between, as the lines of a key block do. For each candidate in one, zstandard, primed with a dictionary
of code words and identifiers, compresses the surrounding text, without other candidates, with it and without it. The
extra bytes, as a share of those that random strings of its length and alphabet need in the same place, are its novelty:
words and paths need less. The context is CONTEXT characters on each side, the surroundings are REACHES characters on
each side, the mean of three. Work grows in proportion to a text's length.

Results for odd rows: a null text counts as empty (no spans, the hash of an empty string); very long texts are scanned
whole; spans that begin together (ties) come in the order assign, access, hex, novel; a null doc_id stays null; repeated
rows give one row each; an empty table gives an empty table; columns besides doc_id and text are not read, whatever their names. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.common import SLICE_BYTES, ship, table, text_slices

KINDS = ("assign", "access", "hex", "novel")

#: The base patterns. A run of hex or of an access key that is too short cannot hide a longer one, so those two carry their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: A candidate of the novelty measure: one string of key material; what stands before an equals sign is its name.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What makes a context sensitive, within CONTEXT characters before or after the candidate, in any case.
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|auth|bearer|credential|private|access.?key|signature|session|client.?id|license.?key|ssh-|BEGIN", re.IGNORECASE | re.ASCII)
CONTEXT = 96
#: What parts candidates that adjoin, as the lines of a key block: a line break, or one written as an escape (its letter belongs to the next).
ADJOINING = re.compile(r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\)[ \t]*")
#: Least novelty: of a candidate with a digit, of one of letters alone, and of letters with signs between, as names are written.
NOVELTY, NOVELTY_LETTERS, NOVELTY_NAMES = 0.7, 0.79, 0.94
#: How many random strings a candidate is held against, and characters of surroundings on each side.
REFERENCES, REACHES = 4, (CONTEXT, 2 * CONTEXT, 4 * CONTEXT)
#: Kinds of characters that an alphabet is made of.
LETTERS = [(re.compile(f"[{letters}]"), letters) for letters in (string.ascii_lowercase, string.ascii_uppercase, string.digits)]
SYMBOLS = "+/_=-"
SPELT_HEX = re.compile("[0-9A-F]+|[0-9a-f]+")

#: Words of code and configuration that prime the compressor, in capitals too, as constants are written.
WORDS = """
abstract account access address admin algorithm api append application argument array async attribute auth authorization
await backend base64 bearer begin body boolean branch buffer bucket build byte cache callback catch certificate char class
client close cloud cluster code collection column command comment commit config connection const constructor container
content context continue controller cookie count create credential current data database date debug decode default delete
deploy description digest directory disable docker document domain double driver email enable encode encoding encrypt
endpoint enum environment error event example except exception execute export expires extends factory false field file
filter final finally float folder format function gateway generate global group handler hash header hidden host html http
https identifier image implements import include index info init input insert instance integer interface internal invalid
items join json kernel key label lambda language length level library license limit link list load local localhost lock
login logout main manager mapping master message metadata method model module name namespace network null number object
option order origin output override package page parameter parent parse passphrase password path pattern payload permission
platform plugin pointer policy port prefix private process production profile project property protected protocol provider
proxy public query queue random read record redirect reference refresh region register release remote remove repository
request require reset resource response result return role root route runtime save schema scope script search secret secure
select sequence serial server service session settings signature size source static status storage stream string struct
submit suffix super switch system table tag target template test text thread throw timeout timestamp token trace
transaction transfer trigger true type undefined union update upload url user username utils uuid valid value variable
vector vendor version view virtual void volume warning window worker write www yaml
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
"""
_prime: list[zstandard.ZstdCompressor] = []


def compressor() -> zstandard.ZstdCompressor:
    if not _prime:
        primed = zstandard.ZstdCompressionDict((WORDS.upper() + WORDS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _prime.append(zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False))
    return _prime[0]


def alphabet(body: str) -> str:
    """The characters that a string of these kinds of characters is drawn from."""
    symbols = "".join(c for c in SYMBOLS if c in body)
    if SPELT_HEX.fullmatch(plain := body.translate({ord(c): None for c in SYMBOLS})):
        return string.digits + ("ABCDEF" if plain.isupper() else "abcdef") + symbols
    return "".join(letters for kind, letters in LETTERS if kind.search(body)) + (symbols if plain else SYMBOLS + string.digits)


@lru_cache(maxsize=1024)
def random_ones(letters: str, n: int) -> list[bytes]:
    """The random strings that candidates of an alphabet and length are held against."""
    return ["".join(random.Random(k).choices(letters, k=n)).encode() for k in range(REFERENCES)]


def novelty(text: str, start: int, end: int) -> float:
    """Extra bytes of text[start:end] against its surroundings and the dictionary, as a share of those of random strings of its kind. Other candidates, which may be secrets too, are no surroundings."""
    size = lambda s: len(compressor().compress(s))
    body = text[start:end]
    others = (random_ones if len(body) <= 256 else random_ones.__wrapped__)(alphabet(body), len(body))
    extra, expected = 0, 0.0
    for reach in REACHES:  # a few bytes hang on how the surroundings happen to be coded
        around = CANDIDATE.sub(" ", text[end : end + reach]) + CANDIDATE.sub(" ", text[max(0, start - reach) : start])
        around = around.encode()
        without = size(around)
        extra += size(around + body.encode()) - without
        expected += sum(size(around + x) - without for x in others) / REFERENCES
    return extra / max(1.0, expected)


def least_novelty(body: str) -> float:
    if any(c.isdigit() for c in body):
        return NOVELTY
    return NOVELTY_LETTERS if body.isalpha() else NOVELTY_NAMES


def in_sensitive_context(text: str) -> Iterator[re.Match]:
    """Candidates near a sensitive word, and all that adjoin one of them in an unbroken row."""
    row: list[re.Match] = []
    sensitive = False
    for m in CANDIDATE.finditer(text):
        if row and not ADJOINING.fullmatch(text, row[-1].end(), m.start()):
            yield from row if sensitive else ()
            row, sensitive = [], False
        row.append(m)
        sensitive = sensitive or bool(SENSITIVE.search(text, max(0, m.start() - CONTEXT), m.start()) or SENSITIVE.search(text, m.end(), m.end() + CONTEXT))
    yield from row if sensitive else ()


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) in order; the base kinds, then what novelty adds outside of them."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if SENSITIVE.search(text):
        begins, ends = [], []  # of the stretches that the base kinds cover, in order
        for s, _, e in sorted(found):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                begins.append(s)
                ends.append(e)
        for m in in_sensitive_context(text):
            k = bisect_left(begins, m.end())
            if k and ends[k - 1] > m.start():
                continue
            if novelty(text, m.start(), m.end()) >= least_novelty(m.group()):
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds and of the method's own, hash of the base spans, all spans, redacted text."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            rows = [spans_of(t) if t else [] for t in b.column("text").to_pylist()]
            count = lambda k: pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64())
            base = [hashlib.sha256(shown([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array(map(shown, rows), pa.string()), count(3)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in text replaced, and n_chars, where there is one, counted anew."""
    ship(spark)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, SLICE_BYTES):
                texts = b.column("text").to_pylist()
                fixed = [redact(t, s) if t and (s := spans_of(t)) else t for t in texts]
                cols = dict(zip(names, b.columns, strict=True)) | {"text": pa.array(fixed, pa.string())}
                if "n_chars" in cols:
                    kind, old = cols["n_chars"].type, cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([o if f is t or f == t else len(f) for o, t, f in zip(old, texts, fixed, strict=True)], kind)
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
