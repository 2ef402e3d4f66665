"""BPE encoding and decoding with a public vocabulary file.

``Bpe`` reads the vocabulary of a BPE-with-word-ends tokenizer file. A word is
a doubly linked list of symbols; a priority queue holds the merges of
neighbouring symbols by (rank, position), and entries whose symbols have
changed since are skipped as stale. Words repeat, so finished words are kept
in a memo of bounded size; the memo never changes a result. Decoding
concatenates vocabulary strings, one blank between them, as the file has no
decoder of its own.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: White space as the tokenizer sees it; str.split() also splits at U+001C-1F.
SPACE = "[\t-\r \x85\xa0  -     　]+"
#: Words of texts within Latin-1, where no normal form or Unicode version matters.
LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
LATIN = re.compile("[!-~\xa1-\xac\xae-\xff]+")
MEMO_CHUNKS = 250_000
MEMO_WORDS = 500_000
MEMO_CHARS = 48
LOW = (1 << 32) - 1


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte, where that is another one."""
    hidden = [*range(33), *range(127, 161), 173]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder for one tokenizer file."""

    _loaded: dict[str, Bpe] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        """One per path and worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        #: (left id, right id) -> (rank, merged id), both packed into one integer.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = rank << 32 | self.vocab[a + b]
        # The file's own normaliser and word splitter, so that Unicode versions agree.
        pieces = Tokenizer.from_file(path)
        self.normalize = pieces.normalizer.normalize_str
        self.split = pieces.pre_tokenizer.pre_tokenize_str
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.odd = re.compile("[\x1c-\x1f]")
        self.space = re.compile(SPACE)
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.memo_words: dict[str, tuple[bytes, str]] = {}
        self.alphabet = byte_alphabet()

    def word(self, raw: str) -> list[int]:
        """Ids of one word, given in the alphabet that stands for its UTF-8 bytes."""
        ids = [self.vocab[c] for c in raw[:-1] if c in self.vocab]
        if (last := raw[-1] + self.suffix) in self.vocab:  # symbols the vocabulary lacks leave no token
            ids.append(self.vocab[last])
        n = len(ids)
        if n < 2:
            return ids
        get = self.merges.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m >> 32) << 32 | k for k in range(n - 1) if (m := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            k = entry & LOW
            j = right[k]
            if j < 0 or ids[k] < 0 or (m := get(ids[k] << 32 | ids[j])) is None or m >> 32 != entry >> 32:
                continue  # stale: one of the two symbols is gone or has grown
            new, nxt, before = m & LOW, right[j], left[k]
            ids[k], ids[j], right[k], right[j] = new, -1, nxt, -1
            if nxt >= 0:
                left[nxt] = k
                if (m := get(new << 32 | ids[nxt])) is not None:
                    heappush(queue, (m >> 32) << 32 | k)
            if before >= 0 and (m := get(ids[before] << 32 | new)) is not None:
                heappush(queue, (m >> 32) << 32 | before)
        return [i for i in ids if i >= 0]

    def known(self, word: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded) of one word, by the memo."""
        if (out := self.memo_words.get(word)) is None:
            ids = self.word(word)
            out = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
            if len(word) <= MEMO_CHARS:
                if len(self.memo_words) >= MEMO_WORDS:
                    self.memo_words.clear()
                self.memo_words[word] = out
        return out

    def chunk(self, raw: str) -> tuple[bytes, str]:
        """What ``known`` gives, for a run without white space, which may hold several words."""
        if raw.isascii() and raw.isalpha():
            words = [raw.lower()]
        elif LATIN.fullmatch(raw):
            words = LATIN_WORDS.findall(raw.lower())
            if not raw.isascii():
                words = [w.encode().decode("latin-1").translate(self.alphabet) for w in words]
        else:
            words = [w for w, _ in self.split(self.normalize(raw))]
        found = [self.known(w) for w in words]
        out = found[0] if len(found) == 1 else (b"".join([p[0] for p in found]), " ".join([p[1] for p in found if p[0]]))
        if len(raw) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_CHUNKS:
                self.memo.clear()
            self.memo[raw] = out
        return out

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        """What ``known`` gives, for every run of a whole text."""
        get, chunk, at, out = self.memo.get, self.chunk, 0, []
        for m in [*self.specials.finditer(text), None]:
            piece = text[at : m.start()] if m else text[at:]
            raws = piece.split() if not self.odd.search(piece) else [r for r in self.space.split(piece) if r]
            out += [get(r) or chunk(r) for r in raws]
            if m:
                out.append((struct.pack("<I", self.special[m[0]]), m[0]))
                at = m.end()
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        return b"".join([p[0] for p in self.parts(text)])

    def encode(self, text: str) -> list[int]:
        raw = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, concatenated with a blank between them; unknown ids leave nothing."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded text per row.

    Null and empty texts give no tokens and an empty decoded text. Each row is
    handled by itself, in input order, so ties and repeated rows give equal
    rows. Whole texts are encoded, however long; other columns, whatever their
    names, are ignored; an empty table gives an empty result; no shuffle takes
    place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(tokenizer)
        for batch in batches:
            for lo in range(0, len(batch), 256):  # outputs are larger than inputs: send them in small batches
                part = batch.slice(lo, 256)
                ids, decoded = [], []
                for text in part.column(1).to_pylist():
                    found = bpe.parts(text or "")
                    ids.append(b"".join([p[0] for p in found]))
                    decoded.append(" ".join([p[1] for p in found if p[0]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the operator's outputs as digests."""
    out = encode_decode(docs, tokenizer, id_col, text_col)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
