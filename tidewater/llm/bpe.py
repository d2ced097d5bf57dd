"""Byte-level BPE by prefix-sharing traversal of a trie.

The encoding of every prefix of a word is determined by its last token: that token starts where some
shorter prefix ends, and the two tokens that meet there must be such that the merges keep them apart.
So distinct words are visited as a trie of bytes, depth first, which is their sorted order; each node
finds its last token from those on the path above it, and prefixes that words share are encoded once.
Only the path is held. A word's ids are read back from its node along the last tokens.

The results equal those of the tokenizers library for the vocabulary file given, with special tokens
recognised in the text, nothing added, no truncation and no padding.

Defined results: null is encoded as the empty text: no ids, digests of nothing. Lone surrogates
can't occur in Spark's strings. Repeated rows get one result each; extra columns are left out, or
kept where asked for, whatever their names; an empty table gives no rows. Words of any length are
encoded whole, in time proportional to their length; those of over TRIE_BYTES bytes share no trie, so
that memory stays at a few bytes for each byte of a word. Where several tokens could end a prefix,
the merges decide; there are no ties. Files with another normalizer, splitting rule or model than
byte-level BPE as described here are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common

#: White_Space of Unicode; letters and numbers of the Latin blocks, for texts that have no others.
_WS = "\t-\r \x85\xa0  -     　"
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_WS}{_L}{_N}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BEYOND = re.compile("[ɐ-\U0010ffff]")
_ANY = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Words whose ids a worker keeps, besides those of the texts at hand, and characters of text that it splits at once.
CACHE_WORDS, CHUNK_CHARS = 100_000, 512 << 10
#: Longest word that goes into the trie.
TRIE_BYTES = 1024


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where it's printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse(spec: dict) -> None:
    """Raises if a vocabulary file asks for what this module doesn't do."""
    model, split, step = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    wrong += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE":
        wrong.append("model")
    if step is not None:
        wrong.append("normalizer")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("decoder")
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if wrong:
        raise ValueError(f"not a vocabulary of plain byte-level BPE: {', '.join(wrong)}")


class Coder:
    """Encoder and decoder of one vocabulary file (a tokenizers JSON with a byte-level BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole, pair = vocab[a + b], (vocab[a], vocab[b])
            self.merged.setdefault(pair, (rank, whole))
            self.made_of.setdefault(whole, (rank, *pair))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Every suffix of a token, with the token that it is itself, or -1.
        self.suffix: dict[bytes, int] = {}
        for t in vocab.values():
            b = self.bytes_of[t]
            for i in range(1, len(b)):
                self.suffix.setdefault(b[i:], -1)
        self.own: dict[int, bool] = {}
        for t in vocab.values():
            self.suffix[self.bytes_of[t]] = t
        self.longest = max(map(len, self.suffix))
        self.apart: dict[tuple[int, int], bool] = {}
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._any = None

    def merge_up(self, word: bytes) -> list[int]:
        """Plain merging by rank, for single tokens when the tables are checked."""
        parts = [self.suffix[bytes((b,))] for b in word]
        while len(parts) > 1:
            rank, i = min((self.merged.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [self.merged[parts[i], parts[i + 1]][1]]
        return parts

    def itself(self, t: int) -> bool:
        """Whether the bytes of token t are encoded as t."""
        if (found := self.own.get(t)) is None:
            found = self.own[t] = self.merge_up(self.bytes_of[t]) == [t]
        return found

    def keeps_apart(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no merge across their border comes before those that make a and b.

        The pieces that touch at the border are taken apart again, latest merge first. While a piece
        made by merge r stood there, only merges before r can have crossed; of equal merges the left comes first.
        """
        if (found := self.apart.get((a, b))) is not None:
            return found
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        key, found = (a, b), True
        #: (rank, 0 for the left piece, 1 for the right): what crosses must come before it.
        before = (1 << 60, 0)
        while True:
            crossing = self.merged.get((a, b))
            # a merge that crosses happens left of the right piece's own merge of the same rank, right of the left's
            if crossing is not None and (crossing[0], 0.5) < before:
                found = False
                break
            left, right = self.made_of.get(a), self.made_of.get(b)
            if left is None and right is None:
                break
            if right is None or (left is not None and left[0] > right[0]):
                before, a = (left[0], 0), left[2]
            else:
                before, b = (right[0], 1), right[1]
        self.apart[key] = found
        return found

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words, depth first through their trie.

        Sorted words come in that order, each from where it leaves the path of the one before, so that no node is stored.
        """
        suffix, longest, apart = self.suffix, self.longest, self.apart
        last, start, path = [0], [0], b""  # by depth: the prefix's last token and where it starts
        for w in sorted(words):  # by code points, which is the order of their bytes
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) > TRIE_BYTES:
                yield w, self.line(raw)
                continue
            shared = 0
            for x, y in zip(path, raw):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            path = raw
            for depth in range(shared + 1, len(raw) + 1):
                found = []
                for i in range(1, min(longest, depth) + 1):
                    t = suffix.get(raw[depth - i : depth])
                    if t is None:
                        break
                    if t >= 0:
                        found.append((i, t))
                for i, t in reversed(found):
                    s = depth - i
                    if s:
                        ok = apart.get((last[s], t))
                        if ok is None:
                            ok = self.keeps_apart(last[s], t)
                    else:
                        ok = self.itself(t)
                    if ok:
                        last.append(t), start.append(s)
                        break
                else:
                    raise ValueError("a prefix has no last token: the vocabulary lacks bytes")
            out, d = [], len(raw)
            while d:
                out.append(last[d])
                d = start[d]
            yield w, out[::-1]

    def line(self, raw: bytes) -> list[int]:
        """The ids of one word, prefix by prefix, without a trie."""
        suffix, longest = self.suffix, self.longest
        last, start = array("i", [0]), array("i", [0])
        for depth in range(1, len(raw) + 1):
            found = []
            for i in range(1, min(longest, depth) + 1):
                t = suffix.get(raw[depth - i : depth])
                if t is None:
                    break
                if t >= 0:
                    found.append((i, t))
            for i, t in reversed(found):
                s = depth - i
                if self.keeps_apart(last[s], t) if s else self.itself(t):
                    last.append(t), start.append(s)
                    break
            else:
                raise ValueError("a prefix has no last token: the vocabulary lacks bytes")
        out, d = [], len(raw)
        while d:
            out.append(last[d])
            d = start[d]
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if _BEYOND.search(text):
            if self._any is None:
                import regex

                self._any = regex.compile(_ANY)
            return self._any.findall(text)
        return _LATIN.findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens between them."""
        if self.at_special is None or not self.at_special.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [*self.split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.split(text[at:])

    def learn(self, words: set) -> None:
        """The ids of all these words, in the cache; when it grows too large, what no text has asked for of late goes."""
        if len(self.ids) > CACHE_WORDS // 2:
            self.ids, self.older = {}, self.ids
        ids, older, missing = self.ids, self.older, []
        for w in words:
            if w not in ids:
                if (found := older.get(w)) is not None:
                    ids[w] = found
                elif isinstance(w, int):
                    ids[w] = array("I", [w]).tobytes()
                else:
                    missing.append(w)
        for w, found in self.walk(missing):
            ids[w] = array("I", found).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, i = [], 0
        while i < len(texts):
            chunk, size = [], 0
            while i < len(texts) and (not chunk or size + len(texts[i]) <= CHUNK_CHARS):
                chunk.append(self.pieces(texts[i]))
                size += len(texts[i])
                i += 1
            words: set = set()
            words.update(*chunk)
            self.learn(words)
            get = self.ids.__getitem__
            out += [b"".join(map(get, p)) for p in chunk]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_CODERS: dict[str, Coder] = common.kept_in_worker()


def coder(path: str) -> Coder:
    common.make_room(_CODERS)
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """keep columns, ids (array<int>, if asked for), n_tokens, ids_sha256 and decoded_sha256 of each row's whole text.

    path names the vocabulary file on every machine.
    """
    common.bound_batches(docs.sparkSession)
    path = path or default_path()
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            found = c.encode_batch([t or "" for t in b.column("text_").to_pylist()])
            cols = list(b.columns[:-1])
            names = [f"k{i}" for i in range(len(keep))]
            if with_ids:
                ends = pa.array(accumulate((len(x) // 4 for x in found), initial=0), pa.int32())
                cols.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(found))])))
                names.append("ids")
            cols += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array([hashlib.sha256(c.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in found])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = common.with_fields(rows.drop("text_").schema, ("ids array<int>, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op9(spark, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), with_ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their digests of every document."""
    return encode(docs)
