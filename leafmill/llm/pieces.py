"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (each space becomes the mark, one mark before all) and cut where no piece of the vocabulary can cross.
The distinct marked words of a slice of texts are sorted, which lays their trie out depth-first: for each prefix the
forward pass keeps the one surviving path, and a word only extends the prefix that it shares with the word before it.

With a vocabulary of the unigram kind, a prefix keeps the greatest sum of scores of a path to its end, carried forward
from shorter prefixes (Viterbi), and that path's last piece; on a tie the longest piece.

The scores of a vocabulary of the BPE kind, such as the one at hand, are merge ranks: the path with the greatest sum of
scores is not what its library returns. There a path survives if its last two pieces are also what merging gives for the
two alone; exactly one path does at each prefix, and it is the library's own encoding. (Merges stop at the ends of the
pieces that are left at last, so the pieces of a prefix that ends with one of them are the prefix's own encoding.)

Results for odd rows: a null text counts as empty (no ids); characters outside the vocabulary become byte pieces, or
where it has none one unknown id for each run of them; a mark in the text itself comes back as a space (round_trip false),
as in the library; very long texts and words are encoded whole; a null doc_id stays null; repeated rows give one row each;
an empty table gives an empty table; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import SLICE_BYTES, ship, table, text_slices

#: The mark of the vocabulary, and the space that stands for it here: words of Latin letters then take one byte a letter.
WRITTEN, MARK = "▁", " "
#: Words and pairs of pieces kept in a worker's tables; longest word kept.
TABLE_WORDS, TABLE_PAIRS, KEPT_CHARS = 500_000, 300_000, 64

#: Of a serialised vocabulary, the fields of the trainer's settings and of the kind in them, and the unigram kind; how far an unknown character scores below the least piece.
TRAINER, KIND, UNIGRAM, UNKNOWN_BELOW = 2, 3, 1, 10.0

_models: dict[int, PieceModel] = {}


def fields_of(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message; those of fixed size are passed over."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        number, form = divmod(varint(), 8)
        if form == 0:
            yield number, varint()
        elif form == 2:
            n = varint()
            yield number, raw[at : at + n]
            at += n
        else:
            at += 8 if form == 1 else 4


def is_unigram(raw: bytes) -> bool:
    trainer = [v for n, v in fields_of(raw) if n == TRAINER]
    return UNIGRAM == next((v for t in trainer[-1:] for n, v in fields_of(t) if n == KIND), UNIGRAM)


class PieceModel:
    def __init__(self, raw: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        if sp.normalize("  ﬁ A ") != "   ﬁ A ".replace(MARK, WRITTEN):
            raise ValueError("only vocabularies that keep texts as they are, with one mark before, are known here")
        if sys.byteorder != "little":
            raise OSError("ids are written in little-endian order")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i).replace(WRITTEN, MARK) for i in range(n)]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.unigram = is_unigram(raw)
        if self.unigram:  # sums of scores as the library has them
            self.score = {name: np.float32(x) for name, x in self.score.items()}
        self.worst = np.float32(min(self.score.values(), default=0.0) - UNKNOWN_BELOW)
        if any(MARK in name.lstrip(MARK) for name in self.id):
            raise ValueError("a piece holds a mark after other characters")
        # every end of a piece, and whether it is one itself: longer strings need no look
        self.tails = {name[k:]: False for name in self.id for k in range(1, len(name))} | dict.fromkeys(self.id, True)
        inside = {c for name in self.id for c in name} - {MARK}
        # signs that no piece has after a letter end a word of letters: the word is then the same with and without them
        signs = {c for c in inside if not c.isalpha()} - {b for name in self.id for a, b in zip(name, name[1:], strict=False) if a.isalpha()}
        of = lambda chars: "".join(map(re.escape, sorted(chars)))
        word = f"{MARK}*[{of(c for c in inside if c.isalpha())}]++(?=[{of(signs)}])|" if signs else ""
        self.units = re.compile(f"{word}{MARK}*[{of(inside)}]+|{MARK}+|.", re.DOTALL)
        self.text_of = [b"" if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].encode() for i in range(n)]
        self.table: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """Merging as defined: the adjacent pair of the best score, then leftmost, until none is a piece. For short strings."""
        parts, score = list(word), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the two stay apart and whole when their string is merged; left is empty at a word's begin."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > TABLE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def best_paths(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, its pieces) of distinct words by greatest sum of scores, in sorted order, going through their trie depth-first."""
        tails, score, worst, before = self.tails, self.score, self.worst, ""
        begin, best = [0], [np.float32(0)]  # of each prefix: where its best path's last piece begins, and the sum of scores so far
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del begin[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                at = end - 1
                c = word[at:end]
                sum_, from_ = best[at] + (score[c] if c in score else worst), at
                while at and word[at:end] in tails:
                    at -= 1
                    if (s := score.get(word[at:end])) is not None and best[at] + s >= sum_:
                        sum_, from_ = best[at] + s, at
                begin.append(from_)
                best.append(sum_)
            out, end = [], len(word)
            while end:
                out.append(word[begin[end] : end])
                end = begin[end]
            before = word
            yield word, out[::-1]

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, its pieces) of distinct words, in sorted order, going through their trie depth-first."""
        tails, known, follows, before = self.tails, self.pairs, self.follows, ""
        begin, last = [0], [""]  # of each prefix's surviving path: where its last piece begins, and that piece
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del begin[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                at = end - 1
                while True:
                    piece = word[at:end]
                    whole = tails.get(piece)
                    if whole or at == end - 1:
                        left = last[at]
                        ok = known.get((left, piece))
                        if follows(left, piece) if ok is None else ok:
                            break
                    if (whole is None and at < end - 1) or not at:
                        raise AssertionError(f"no path survives in {word[:end]!r}")
                    at -= 1
                begin.append(at)
                last.append(piece)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end = begin[end]
            before = word
            yield word, out[::-1]

    def ids_of(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            if (i := self.id.get(p)) is not None:
                ids.append(i)
            else:
                ids += [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]
        return array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, 4 bytes each."""
        cut = [self.units.findall(MARK + t.replace(WRITTEN, MARK)) if t else [] for t in texts]
        used = set().union(*cut)
        new = used.difference(self.table)
        if len(self.table) + len(new) > TABLE_WORDS:
            # the words met first are the common ones; they stay, with those of this slice
            stay = dict(islice(self.table.items(), TABLE_WORDS // 2))
            self.table = stay | {w: self.table[w] for w in used.difference(new) if w not in stay}
        known = self.table
        for w, p in (self.best_paths if self.unigram else self.encode_words)(list(new)):
            known[w] = self.ids_of(p)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        if not self.byte:  # a run of unknown characters is one id
            out = [x[np.append(True, (x[1:] != self.unknown) | (x[:-1] != self.unknown))].tobytes() if len(x) else b"" for x in (np.frombuffer(o, "<u4") for o in out)]
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def model_for(raw: bytes) -> PieceModel:
    key = hash(raw)
    if key not in _models:
        _models[key] = PieceModel(raw)
    return _models[key]


def encoded(spark: SparkSession, docs: DataFrame, vocabulary: str, ids: str = "__ids", decoded: str = "__round_trip") -> DataFrame:
    """The rows of docs with the ids of their text (4 bytes each, little-endian), and whether decoding gives it back."""
    ship(spark)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_for(raw.value)
        for b in batches:
            for part in text_slices(b, SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                out = model.encode(texts)
                same = [model.decode(i) == t for i, t in zip(out, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary()), pa.array(same, pa.bool_())], [*names, ids, decoded])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BooleanType())]))


def digest(found: DataFrame, ids: str = "__ids", decoded: str = "__round_trip") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip."""
    return found.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_pieces"), F.crc32(ids).alias("ids_crc32"), F.col(decoded).alias("round_trip"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(encoded(spark, docs, public_tokenizers.path("piece_bpe_32k.model")))
