"""BPE encoding and decoding by prefix-sharing trie traversal.

The vocabulary is a public one with word ends (``word_bpe_49k.json`` by default; its
path is a parameter).  The canonical encoding of a word has one last token for each
of its prefixes: the only token that ends the prefix and is compatible with the last
token of what stands before it (two tokens are compatible if encoding their
concatenation gives just them).  So the distinct words of a batch are put into a trie
and the trie is walked depth first: a node's last token is found from those of its
ancestors, and a prefix that many words share is encoded once.  Words end in tokens
marked as word ends, which are found the same way at the node where the word ends;
its tokens are then read backwards along the path.

Text is cut at white space before the cache lookup.  The tokenizer's normaliser and
splitter never join across white space, so a chunk always encodes alike.

Spark partitions the documents; a task holds one slice of texts, that slice's trie
and a cache of at most CACHE chunks.

Edge cases: a null text is an empty one (no tokens, empty decoded text); white space
alone gives no tokens; a very long text is one row, and a very long word is one path of the
trie, encoded in linear time; special-token strings in a text become their ids, as in the
tokenizers library; equal rows give equal rows (there are no
ties to break); an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, table

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
NEVER = 1 << 60
#: Chunks that a Python worker keeps between slices.
CACHE = 200_000
#: Letters above which a word is not merged in rounds.
LONG = 256
#: Text bytes of a slice.
SLICE = 4 << 20

#: Fixed values of the tokenizer: its splitter and its white space.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WHITE_CODES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITE = "[" + "".join(map(chr, WHITE_CODES)) + "]+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: bytes that print stand for
    themselves, the others for the letters from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words of one vocabulary; see the module's text for the method."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = {t for t in self.vocab if not t.endswith(END)}
        self.last = {t[: -len(END)]: t for t in self.vocab if t.endswith(END)}
        self.longest = max(map(len, self.inner | set(self.last)))
        self.fits: dict[tuple[str, str], bool] = {}
        self.halves = {a + b: (a, b) for a, b in merges}
        self.spines: dict[tuple[str, bool], list] = {}
        self.split = regex.compile(SPLITTER).findall
        self.letters = byte_letters()  # of Latin-1 letters, for str.translate
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.white = re.compile(WHITE)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank: tells which tokens encode to themselves, never encodes a word."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def spine(self, token: str, right: bool) -> list[tuple[str, int, int]]:
        """The symbols that stand at one end of a token while it is built, from the whole
        token down: (symbol, rank that makes it, rank that merges it on)."""
        key = (token, right)
        out = self.spines.get(key)
        if out is None:
            out, later = [], NEVER
            part = token
            while part is not None:
                halves = self.halves.get(part)
                made = self.rank[halves] if halves else -1
                out.append((part, made, later))
                later = made
                part = halves[right] if halves else None
            self.spines[key] = out
        return out

    def compatible(self, before: str, token: str) -> bool:
        """Whether encoding the concatenation gives the two tokens. It does unless a merge
        across the border comes up while both its sides stand there; of equal merges the
        left one goes first.  With an empty ``before`` the token has to encode to itself."""
        key = (before, token)
        out = self.fits.get(key)
        if out is not None:
            return out
        if len(self.fits) > 4 * CACHE:
            self.fits.clear()
        if not before:
            out = self.merged(self.symbols(token)) == [token]
        else:
            out, rank = self.compatible("", before) and self.compatible("", token), self.rank
            for x, made_x, later_x in self.spine(before, True) if out else ():
                for y, made_y, later_y in self.spine(token, False):
                    r = rank.get((x, y))
                    if r is not None and max(r, made_x, made_y) < later_x and max(r, made_x, made_y) <= later_y:
                        out = False
                        break
                if not out:
                    break
        self.fits[key] = out
        return out

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The tokens of each distinct word (of byte letters). Sorted words are the
        trie in depth-first order; ``path`` holds the last tokens from the root to the
        current node, and a step back to a shared prefix cuts it."""
        inner, ends, fits, compatible = self.inner, self.last, self.fits, self.compatible
        longest = self.longest
        path, above = [""], ""
        words.sort()
        for word in words:
            n, shared = len(word), 0
            most = min(n - 1, len(path) - 1)
            while shared < most and word[shared] == above[shared]:
                shared += 1
            del path[shared + 1 :]
            for d in range(shared + 1, n):
                for start in range(d - longest if d > longest else 0, d):
                    token = word[start:d]
                    if token in inner:
                        ok = fits.get((path[start], token))
                        if ok or ok is None and compatible(path[start], token):
                            path.append(token)
                            break
            above = word
            for start in range(n - longest if n > longest else 0, n):
                token = ends.get(word[start:])
                if token is not None:
                    ok = fits.get((path[start], token))
                    if ok or ok is None and compatible(path[start], token):
                        break
            tokens, at = [token], start
            while at:
                tokens.append(path[at])
                at -= len(path[at])
            tokens.reverse()
            yield word, tokens

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, in byte letters."""
        if chunk.isascii() and chunk.isprintable():  # such bytes stand for themselves
            chunk = chunk.lower()
            if chunk.isalpha():
                return [chunk]
            return [chunk[:-1], chunk[-1]] if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?" else self.split(chunk)
        if not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join([c.lower() for c in chunk]) if "\u03a3" in chunk else chunk.lower()
        words = [chunk] if chunk.isalpha() else [chunk[:-1], chunk[-1]] if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?" else self.split(chunk)
        return [w.encode().decode("latin-1").translate(self.letters) for w in words]

    def chunks(self, text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [c for c in self.white.split(text) if c]
        return text.split()

    def pieces(self, text: str) -> list[str]:
        """Chunks and special tokens of a text, in order."""
        if "<|" in text and self.specials is not None:
            return [p for part in self.specials.split(text) for p in ([part] if part in self.special else self.chunks(part))]
        return self.chunks(text)


class ChunkCache:
    """Chunk -> values and word -> value, with a bounded number of kept entries.
    ``value`` gives the value of a word's tokens, ``join`` joins those of a chunk's words;
    a value of several parts is kept in as many maps."""

    def __init__(self, encoder: TrieEncoder, encode: Callable, value: Callable[[list], object], join: Callable[[list], object], width: int, most: int):
        self.encoder, self.encode, self.value, self.join, self.most = encoder, encode, value, join, most
        self.words: dict[str, object] = {}
        self.chunks: list[dict[str, object]] = [{} for _ in range(width)]

    def batch(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, after which every piece is in ``chunks``."""
        if len(self.words) > self.most:
            self.words.clear()
        if len(self.chunks[0]) > self.most:
            for m in self.chunks:
                m.clear()
        encoder, words, maps, join = self.encoder, self.words, self.chunks, self.join
        parts = [encoder.pieces(t) if t else [] for t in texts]
        missing = set().union(*parts).difference(maps[0])
        special = missing & encoder.special.keys()
        missing -= special
        new = {c: encoder.words_of(c) for c in missing}
        value = self.value
        for word, tokens in self.encode(list({w for ws in new.values() for w in ws}.difference(words))):
            words[word] = value(tokens)
        got = {c: words[ws[0]] if len(ws) == 1 else join([words[w] for w in ws]) for c, ws in new.items()}
        got |= {c: value([c]) for c in special}
        if len(maps) == 1:
            maps[0].update(got)
        else:
            for i, m in enumerate(maps):
                m.update((c, v[i]) for c, v in got.items())
        return parts


_encoders: dict[tuple, ChunkCache] = {}


def cached(path: str, kind: str) -> ChunkCache:
    """One cache for each vocabulary and kind of values in a Python worker."""
    key = (path, kind)
    if key not in _encoders:
        encoder = next((c.encoder for (p, _), c in _encoders.items() if p == path), None) or TrieEncoder(path)
        _encoders[key] = ChunkCache(encoder, *(id_text(encoder) if kind == "text" else id_bytes(encoder)))
    return _encoders[key]


def id_text(encoder: TrieEncoder) -> tuple:
    """Ids in decimal and token strings, each joined by spaces, by the trie."""
    ids = {t: str(i) for t, i in (encoder.vocab | encoder.special).items()}
    return encoder.encode_words, lambda tokens: (" ".join([ids[t] for t in tokens]), " ".join(tokens)), lambda pairs: (" ".join([i for i, _ in pairs]), " ".join([t for _, t in pairs])), 2, CACHE


def id_bytes(encoder: TrieEncoder) -> tuple:
    """Ids as little-endian unsigned 32-bit numbers, by rounds of merges over all words of a batch."""
    special = {t: i.to_bytes(4, "little") for t, i in encoder.special.items()}
    return RoundMerger(encoder).encode_words, lambda x: special[x[0]] if isinstance(x, list) else x, b"".join, 1, 2 * CACHE


class RoundMerger:
    """Encodes many words at once where only ids are asked for: every round, each word
    that still has a known pair merges the leftmost pair of lowest rank."""

    def __init__(self, encoder: TrieEncoder):
        self.encoder = encoder
        vocab = encoder.vocab
        size = len(vocab) + len(encoder.special)
        self.size = size
        pairs = np.array([vocab[a] * size + vocab[b] for a, b in encoder.rank], np.int64)
        ranks = np.fromiter(encoder.rank.values(), np.int64, len(pairs))
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], ranks[order]
        self.made = np.array([vocab[a + b] for a, b in encoder.rank], np.int64)
        self.first = np.zeros(1024, np.int64)
        self.final = np.zeros(1024, np.int64)
        for letter in encoder.letters.values():
            self.first[ord(letter)], self.final[ord(letter)] = vocab[letter], vocab[letter + END]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER)

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        long = [w for w in words if len(w) > LONG]  # rounds over a long word add up to its square
        for word, tokens in self.encoder.encode_words(long):
            yield word, b"".join([self.encoder.vocab[t].to_bytes(4, "little") for t in tokens])
        words = [w for w in words if len(w) <= LONG] if long else words
        if not words:
            return
        letters = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.first[letters]
        last = np.cumsum(lengths) - 1
        ids[last] = self.final[letters[last]]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word = np.arange(len(words))
        ranks = np.full(len(ids), NEVER)
        ranks[:-1] = self.rank_of(ids[:-1], ids[1:])
        ranks[last] = NEVER
        while len(word):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(ranks, starts)
            going = best < NEVER
            if not going.all():
                kept = np.repeat(going, lengths)
                done.append((word[~going], lengths[~going], ids[~kept]))
                word, lengths, ids, ranks, best = word[going], lengths[going], ids[kept], ranks[kept], best[going]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(ranks == np.repeat(best, lengths))
            of = np.searchsorted(starts, hits, "right") - 1
            at = hits[np.unique(of, return_index=True)[1]]
            ids[at] = self.made[best]
            gone = np.ones(len(ids), bool)
            gone[at + 1] = False
            ids, ranks = ids[gone], ranks[gone]
            lengths = lengths - 1
            at = at - np.arange(len(at))
            starts = np.cumsum(lengths) - lengths
            ends = starts + lengths - 1
            right = at < ends
            ranks[at] = NEVER
            ranks[at[right]] = self.rank_of(ids[at[right]], ids[at[right] + 1])
            left = at > starts
            ranks[at[left] - 1] = self.rank_of(ids[at[left] - 1], ids[at[left]])
        for numbers, sizes, flat in done:
            raw = flat.astype("<u4").tobytes()
            stops = (np.cumsum(sizes) * 4).tolist()
            start = 0
            for n, stop in zip(numbers.tolist(), stops, strict=True):
                yield words[n], raw[start:stop]
                start = stop


def decode(encoder: TrieEncoder, ids: list[int]) -> str:
    """The text of ids: with no decoder in the file, token strings joined by spaces."""
    return " ".join(encoder.name[i] for i in ids if i in encoder.name)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded of every row, or their digests with with_ids=False."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached(path or default_path(), "text")
        as_ids, as_text = (m.__getitem__ for m in cache.chunks)
        for batch in slices(batches, "text", SLICE):
            parts = cache.batch(batch.column(1).to_pylist())
            ids = [" ".join(map(as_ids, p)) for p in parts]
            counts = [s.count(" ") + 1 if s else 0 for s in ids]
            decoded = (" ".join(map(as_text, p)) for p in parts)
            if with_ids:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([[int(x) for x in s.split()] for s in ids], pa.list_(pa.int32())), pa.array(list(decoded), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in ids], pa.string()), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in decoded], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, " + ("ids array<int>, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES: dict[str, Callable] = {"op6_bpe": op6_bpe}
ORACLE: dict[str, str] = {}
