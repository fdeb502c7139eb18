"""BPE encoding and decoding by batched numpy merge rounds.

The words of a whole Arrow batch lie in one flat array of symbol ids. A round looks up the rank of every adjacent pair
by binary search over the sorted pair keys of the merge table, finds the lowest rank of each word, and merges all
places of that rank, left to right. Words drop out when no pair has a rank. Words are merged once per batch and kept
in a bounded cache of the Python worker; each text is then a list of cached pieces.

Equality with the tokenizer file's own library: the rounds need every merge rule to rank after the rules that make
its two parts (checked on load; otherwise one place per round is merged). Texts of plain Latin letters take a fast path;
texts with other characters go through the file's normalizer and pre-tokenizer. Special tokens are cut out first.

Rows: a null text counts as empty and has no ids (zero tokens, the digest of the empty string). Repeated rows give
equal rows, an empty table gives an empty one, extra columns are ignored by ``encode_documents``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import ship

#: Words kept in a worker's cache before it is emptied.
CACHE_WORDS = 400_000
#: Characters of text that are split and merged together.
CHUNK_CHARS = 4_000_000
#: Outside these characters a text takes the file's own normalizer and pre-tokenizer.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*\Z")
#: The split pattern of lower-cased plain text; a fixed value of the tokenizer file, which is compared on load.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level tokenizers use for each byte: itself where visible, else 256 upwards."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in visible)
    other = {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(b if b in visible else other[b]) for b in range(256)]


class MergeTable:
    """Merge rules as sorted pair keys with their ranks and results."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        made_at = np.full(max(vocab.values()) + 1, -1, np.int64)
        latest = made_at.copy()
        np.maximum.at(latest, made, np.arange(len(made)))
        at = np.arange(len(made))
        #: Every rule ranks after all rules that make its parts: all places of one rank can be merged in a round.
        self.ordered = bool(np.all(latest[left] < at) and np.all(latest[right] < at))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)


NO_RANK = np.int64(1 << 40)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, rules: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge many words at once; ``symbols`` holds them one after another. Returns the ids and their number by word."""
    count = len(lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    word = np.repeat(np.arange(count), lengths)
    symbols = symbols.astype(np.int64)
    while len(symbols):
        inner = word[:-1] == word[1:]
        ranks = np.full(len(symbols), NO_RANK)
        ranks[:-1][inner] = rules.rank(symbols[:-1][inner], symbols[1:][inner])
        starts = np.flatnonzero(np.r_[True, ~inner])
        best = np.minimum.reduceat(ranks, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        live = np.repeat(best < NO_RANK, sizes)
        if not live.all():
            done.append((word[~live], symbols[~live]))
            symbols, word, ranks = symbols[live], word[live], ranks[live]
            keep = best < NO_RANK
            best, sizes = best[keep], sizes[keep]
            if not len(symbols):
                break
        hit = ranks == np.repeat(best, sizes)
        if rules.ordered:
            # of touching places (x x x) every second one from the left merges
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) != 1])
            first = at[np.r_[True, np.diff(run) != 0]]
            at = at[(at - first[run - 1]) % 2 == 0]
        else:
            at = np.flatnonzero(hit)
            at = at[np.r_[True, word[at][1:] != word[at][:-1]]]
        symbols[at] = rules.made[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done:
        return np.empty(0, np.int64), np.zeros(count, np.int64)
    words, ids = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(words, kind="stable")
    return ids[order], np.bincount(words, minlength=count)


class Codec:
    """A word-end BPE tokenizer file: texts to ids and back."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rules = MergeTable(self.vocab, model["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        ordered = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, ordered))) if ordered else None
        alphabet = byte_alphabet()
        self._inner = np.array([self.vocab[c] for c in alphabet], np.int64)
        self._last = np.array([self.vocab[c + self.suffix] for c in alphabet], np.int64)
        self._bytes = {c: b for b, c in enumerate(alphabet)}
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self._plain = any((p.get("pattern") or {}).get("Regex") == _SPLIT for p in parts)
        self._split = regex.compile(_SPLIT)
        self._cache: dict[str, tuple[int, str, str]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text, as strings; their UTF-8 bytes are the first symbols."""
        if self._plain and _PLAIN.match(text):
            return self._split.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        parts = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self._bytes[c] for c in part).decode("utf-8", "surrogateescape") for part, _ in parts]

    def pieces(self, text: str) -> list:
        """Words, and special tokens as their integer ids."""
        if self._special is None or "<|" not in text and not self._special.search(text):
            return self.words(text)
        out: list = []
        at = 0
        for match in self._special.finditer(text):
            out += self.words(text[at : match.start()])
            out.append(self.special[match[0]])
            at = match.end()
        return out + self.words(text[at:])

    def learn(self, words: set[str]) -> None:
        """Merge the words that the cache lacks."""
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        new = [w for w in words if w not in self._cache]
        if not new:
            return
        raw = [w.encode("utf-8", "surrogateescape") for w in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self._inner[flat]
        last = np.cumsum(lengths) - 1
        symbols[last] = self._last[flat[last]]
        ids, counts = merge_words(symbols, lengths, self.rules)
        at = 0
        listed = ids.tolist()
        for w, n in zip(new, counts.tolist(), strict=True):
            own = listed[at : at + n]
            at += n
            self._cache[w] = (n, " ".join(map(str, own)), " ".join([self.texts[i] for i in own]))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text (null: none)."""
        return [[int(i) for i in ids.split(" ")] if ids else [] for _, ids, _ in self.rows(texts)]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by one space; unknown ids are skipped."""
        return " ".join(self.texts[i] for i in ids if i in self.texts)

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of ids, the decimal ids joined by a space, the decoded text."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            split = [self.pieces(t) if t else [] for t in texts[at:end]]
            self.learn({w for p in split for w in p if w.__class__ is str})
            cache = self._cache
            for p in split:
                got = [cache[w] if w.__class__ is str else (1, str(w), self.texts[w]) for w in p]
                got = [g for g in got if g[0]]
                yield sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])
            at = end


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies on this machine; executors resolve it for themselves."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode every text.

    Returns the id column, ``n_tokens``, and ``ids`` (decimal, joined by one space) with ``decoded``; with ``digests``
    their SHA-256 instead, computed where the strings are, which are larger than the texts. One narrow stage.
    """
    ship(docs.sparkSession)
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    source = docs.select(docs[id_column].alias("key"), docs[text_column].alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, first, second = [], [], []
                for n, ids, decoded in own.rows(part.column("text").to_pylist()):
                    counts.append(n)
                    first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else ids)
                    second.append(hashlib.sha256(decoded.encode("utf-8", "surrogateescape")).hexdigest() if digests else decoded)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], [id_column, "n_tokens", *names])

    return source.mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, {names[0]} string, {names[1]} string")
