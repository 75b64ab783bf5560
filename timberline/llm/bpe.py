"""BPE encoding by backtracking and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at every place of a word. The encoder takes
the longest token that is compatible with the one before it, falls back to the next shorter one, and steps back when
none is left; a place that failed is never tried again, so the work is linear in the word. Two neighbours are
compatible when applying the merges in rank order could not have joined anything across their border, which is
looked up pair by pair by undoing both tokens' merges. The result equals merging pair by pair in rank order.

The vocabulary file is the "tokenizers" JSON of a BPE with word ends; its path is a parameter. Text is normalised as
the file says (NFC, lower case; white space only separates words), special tokens are cut out of the raw text first.
Words repeat, so each worker keeps the ids of words it has met, in two tables of bounded size: when the newer one is
full, it takes the place of the older one, and what is met again moves to the newer. So words of every text are kept,
however many others occur once.

Defined cases: null text is empty and has no ids; very long texts and words are handled whole; repeated rows each
give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, batches, sha_hex

#: Words of the tokenizer: contractions, letters, single numbers, other signs. Fixed value.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
_UNICODE_SPACE = regex.compile(r"\p{White_Space}+")
_END = "\ue000"  # stands for the end of a word; byte-level text never holds it


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + more)
            more += 1
    return [out[b] for b in range(256)]


class WordBPE:
    """A BPE with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str, memo: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.memo_size = spec["model"], memo
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank_of: dict[tuple[int, int], int] = {}  # pair -> the token it merges into; ids follow the merges' order
        self.halves: dict[int, tuple[int, int]] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merged = vocab[a + b]
            self.rank_of[vocab[a], vocab[b]] = merged
            self.halves[merged] = vocab[a], vocab[b]
        if list(self.halves) != sorted(self.halves):
            raise ValueError("token ids don't follow the order of the merges")
        plain = {t: i for t, i in vocab.items() if i not in self.special.values()}
        spelled = {i: t[: -len(suffix)] + _END if t.endswith(suffix) else t for t, i in plain.items()}
        self.length = {i: len(t) for i, t in spelled.items()}
        self.machine = ahocorasick.Automaton()
        for i, t in spelled.items():
            self.machine.add_word(t, i)
        self.machine.make_automaton()
        self.by_text = by_text = {t: i for i, t in spelled.items()}
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix
        for i, t in spelled.items():
            for k in range(len(t) - 1, 0, -1):
                if t[:k] in by_text:
                    self.shorter[i] = by_text[t[:k]]
                    break
        # Decoding: all tokens in one buffer, and where each starts.
        size = max([*vocab.values(), *self.special.values()]) + 1
        texts = [""] * size
        for t, i in (vocab | self.special).items():
            texts[i] = t
        blob, at, self.offsets = [], 0, [0]
        for t in texts:
            raw = t.encode()
            blob.append(raw)
            at += len(raw)
            self.offsets.append(at)
        self.buffer = b"".join(blob)
        self.chars = _byte_chars()
        self.tokens = texts
        self.fits: dict[tuple[int, int], bool] = {}
        # Words and stretches of words: a word that stands alone is a stretch with the same ids.
        self.memo: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order leaves the border between tokens a and b alone."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right, limit = a, b, 1 << 62
        while True:
            joined = self.rank_of.get((left, right))
            if joined is not None and joined < limit:
                ok = False
                break
            # Undo the later of the two merges: before it, its inner half stood at the border.
            later_left = left if left in self.halves else -1
            later_right = right if right in self.halves else -1
            if later_left < 0 and later_right < 0:
                ok = True
                break
            if later_left > later_right:
                limit, left = left, self.halves[left][1]
            else:  # of equal ranks the left one came first
                limit, right = right + 1, self.halves[right][0]
        if len(self.fits) >= 250_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (no white space inside)."""
        if word.isascii() and word.isprintable():
            text = word + _END
        else:
            text = "".join([self.chars[b] for b in word.encode("utf-8", "surrogatepass")]) + _END
        whole = self.by_text.get(text)
        if whole is not None:  # the longest match at the start is the whole word
            return [whole]
        n, length = len(text), self.length
        longest, lengths = [0] * n, [0] * n
        for end, token in self.machine.iter(text):
            k = length[token]
            start = end - k + 1
            if k > lengths[start]:
                lengths[start], longest[start] = k, token
        ids: list[int] = []
        failed, fits = bytearray(n + 1), self.fits
        at, token = 0, longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while True:
                end = at + length[token]
                fit = not failed[end] and (end == n or lengths[end])
                if fit and last >= 0:
                    fit = fits.get((last, token))
                    if fit is None:
                        fit = self.compatible(last, token)
                if fit:
                    ids.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if token in self.shorter:
                    token = self.shorter[token]
                    continue
                failed[at] = 1
                if not ids:
                    raise ValueError(f"no encoding of {word!r}")
                token = ids.pop()
                at -= length[token]
                break
        return ids

    def decode_token(self, i: int) -> str:
        return self.buffer[self.offsets[i] : self.offsets[i + 1]].decode()

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens, joined by one space."""
        return " ".join([self.decode_token(i) for i in ids])

    def _keep(self, text: str, made: tuple[str, str]) -> tuple[str, str]:
        if len(text) <= 64:
            if len(self.memo) >= self.memo_size:
                self.older = self.memo.copy()
                self.memo.clear()  # the same object, as callers hold its methods
            self.memo[text] = made
        return made

    def _word(self, word: str) -> tuple[str, str]:
        made = self.older.get(word)
        if made is None:
            ids = self.encode_word(word)
            made = " ".join(map(str, ids)), self.decode(ids)
        return self._keep(word, made)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids in decimal and decoded tokens of a stretch without white space that memo does not hold."""
        if chunk.isalpha():
            return self._word(chunk)
        made = self.older.get(chunk)
        if made is None:
            known = self.memo
            parts = [known.get(w) or self._word(w) for w in _WORDS.findall(chunk)]
            made = parts[0] if len(parts) == 1 else (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
        return self._keep(chunk, made)

    def _plain(self, text: str) -> list[tuple[str, str]]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased by itself, without a look at its neighbours
                text = text.replace("Σ", "σ")
        text = text.lower()
        chunks = [c for c in _UNICODE_SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()
        get, chunk = self.memo.get, self._chunk
        return [get(c) or chunk(c) for c in chunks]

    def written(self, text: str | None) -> tuple[str, str]:
        """The ids of a text in decimal and its decoded text, each joined by one space."""
        if not text:
            return "", ""
        if not self._special or not any(s in text for s in self.special):
            parts = self._plain(text)
        else:
            parts = []
            for part in self._special.split(text):
                parts += [(str(self.special[part]), part)] if part in self.special else self._plain(part)
        if not parts:
            return "", ""
        ids, decoded = zip(*parts, strict=True)
        return " ".join(ids), " ".join(decoded)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.written(text)[0].split()]


def load(path: str) -> WordBPE:
    """One tokenizer for each worker process and file, until another operator makes room."""
    if path not in KEPT:
        KEPT[path] = WordBPE(path)
    return KEPT[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)

        def make(c: dict) -> dict:
            out: dict[str, list] = {"doc_id": c["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in c["text"]:
                ids, decoded = bpe.written(text)
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(sha_hex(ids.encode()))
                out["decoded_sha256"].append(sha_hex(decoded.encode()))
            return out

        return batches(it, schema, make)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (text, ...) -> the same columns, ids (array of int), n_tokens and decoded; columns of these names give way."""
    path = path or default_path()
    docs = docs.drop("ids", "n_tokens", "decoded")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in (whole.slice(lo, 256) for whole in it for lo in range(0, whole.num_rows, 256)):  # few lists at a time
            ids = [np.array(bpe.encode(t), dtype=np.int32) for t in batch.column("text").to_pylist()]
            batch = batch.append_column("ids", pa.array(ids, pa.list_(pa.int32())))
            batch = batch.append_column("n_tokens", pa.array([len(i) for i in ids], pa.int64()))
            yield batch.append_column("decoded", pa.array([bpe.decode(i.tolist()) for i in ids], pa.string()))

    fields = "".join(f"`{c}` {t}, " for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}ids array<int>, n_tokens long, decoded string")
