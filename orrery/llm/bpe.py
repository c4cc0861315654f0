"""Operator 9: byte-pair encoding and decoding by prefix-sharing trie traversal.

A text is cut at ASCII white space, which no token of the vocabulary crosses. Each
distinct piece is normalised and cut into pre-tokens; the distinct pre-tokens form a
trie (laid out as sorted words with their common prefixes) that is walked depth first.
The state of a node is the last token of the encoding of its prefix: the one token
ending there that is compatible with the last token of the prefix before it. A prefix
that words share is thus encoded once, and a word costs one state per new character.

Defined results: a null or empty text has no tokens and decodes to ''. Repeated rows
give repeated rows. Texts of any length are encoded whole. Literal special tokens in a
text are those tokens. A vocabulary file with another normaliser, pre-tokeniser, decoder or
kind of model is refused with ValueError. An empty table gives an empty table. Other columns of the input
are not read, so clashing names don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.words import PieceCache, slices
from orrery.runtime import table

SPACE = "\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: What a vocabulary file must state, as the code follows it; another one is refused.
SUPPORTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "decoder": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False},
}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class TrieBPE:
    """Encoder and decoder for a word-end BPE vocabulary in the tokenizers library's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        for what, want in SUPPORTED.items():
            found = model if what == "model" else spec.get(what)
            if (found if what != "model" else {k: found.get(k) for k in want}) != want:
                raise ValueError(f"{path}: the {what} is not the one that this encoder follows")
        if not model.get("end_of_word_suffix") or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: a suffix at words' ends and plain special tokens are expected")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in (*self.vocab.items(), *self.special.items())}
        self.rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.width = {i: len(self.parts(t)) for t, i in self.vocab.items()}
        self.symbols = dict(enumerate(byte_symbols()))
        self.suffixes: tuple[dict, dict] = {}, {}
        for t, i in self.vocab.items():
            final = t.endswith(self.end) and t != self.end
            node = self.suffixes[final]
            for s in reversed(t.removesuffix(self.end) if final else t):
                node = node.setdefault(s, {})
            node[""] = i
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits: dict[int, bool] = {}

    def merged(self, parts: list[str]) -> list[str]:
        """Symbols after all merges, the lowest rank first; only for short sequences."""
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def parts(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            body = [*token.removesuffix(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`: the two stay apart when their symbols are merged together. -1: nothing is left of it."""
        key = left * 65536 + right
        if (known := self.fits.get(key)) is None:
            tokens = [self.text[i] for i in (left, right) if i >= 0]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self.merged([s for t in tokens for s in self.parts(t)]) == tokens
        return known

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Token ids of each distinct pre-token (as byte symbols), by one depth-first walk over their trie.

        states[d] is the last token of the encoding of the current path's first d symbols.
        """
        done: dict[str, list[int]] = {}
        states, path, fits, width = [-1], "", self.fits, self.width
        inner, final = self.suffixes
        for word in sorted(words):
            shared, size = 0, len(word)
            for a, b in zip(word[: len(states) - 1], path, strict=False):
                if a != b:
                    break
                shared += 1
            if shared == size:
                shared -= 1
            del states[shared + 1 :]
            for depth in range(shared + 1, size + 1):
                # tokens that end here, found from their last symbol backwards; the longest that is compatible is the one
                node, at, found = final if depth == size else inner, depth, []
                while at > 0 and (node := node.get(word[at - 1])) is not None:
                    at -= 1
                    if (token := node.get("")) is not None:
                        found.append((at, token))
                for at, token in reversed(found):
                    before = states[at]
                    if (ok := fits.get(before * 65536 + token)) is None:
                        ok = self.compatible(before, token)
                    if ok:
                        states.append(token)
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:depth]!r}")
            path = word
            ids, at = [states.pop()], size - width[token]
            while at > 0:
                ids.append(token := states[at])
                at -= width[token]
            ids.reverse()
            done[word] = ids
        return done

    def pretokens(self, piece: str) -> list[str | int]:
        """Of a piece without ASCII white space: special ids, and pre-tokens as byte symbols."""
        out: list[str | int] = []
        if piece.isalpha() and piece.isascii():
            return [piece.lower()]
        for part in self.cut.split(piece) if self.cut and "<|" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                out += PRETOKEN.findall(part.lower())
                continue
            # a capital sigma's lower case doesn't depend on its place here
            part = unicodedata.normalize("NFC", part)
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            out += [t.encode().decode("latin-1").translate(self.symbols) for t in PRETOKEN.findall(part)]
        return out

    def encode(self, pieces: list[str]) -> list[list[int]]:
        cut = [self.pretokens(p) for p in pieces]
        known = self.encode_words({t for c in cut for t in c if isinstance(t, str)})
        return [[i for t in c for i in ((t,) if isinstance(t, int) else known[t])] for c in cut]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens, joined by a space."""
        return " ".join(self.text[i] for i in ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[TrieBPE, PieceCache, pa.Array, pa.Array]:
    """A worker's encoder, what it remembers, and each token id as decimal and as text."""
    bpe = TrieBPE(path)
    names = [bpe.text.get(i, "") for i in range(max(bpe.text) + 1)]
    return bpe, PieceCache(bpe.encode), pa.array(map(str, range(len(names))), pa.large_string()), pa.array(names, pa.large_string())


def encode_arrow(texts: pa.Array, path: str, columns: tuple[str, ...]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, rows) with `columns` of each text of a bounded slice."""
    _, known, decimals, names = encoder(path)
    for first, part in slices(texts):
        ids, bounds = known.tokens(part)
        at, flat = pa.array(bounds, pa.int32()), pa.array(ids)
        made = {"n_tokens": lambda: pa.array(np.diff(bounds)), "ids": lambda: pa.ListArray.from_arrays(at, flat)}
        for c, each in (("ids_text", decimals), ("decoded", names)):
            made[c] = lambda each=each: pc.binary_join(pa.ListArray.from_arrays(at, each.take(flat)), pa.scalar(" ", pa.large_string()))
        yield first, pa.RecordBatch.from_arrays([made[c]() for c in columns], [*columns])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns id_col and, of `columns`: n_tokens long, ids array<int>, ids_text string
    (decimal, joined by a space), decoded string.
    """
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_text": "string", "decoded": "string"}
    plain = {"ids": pa.list_(pa.int32()), "ids_text": pa.string(), "decoded": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in encode_arrow(batch.column(1), path, columns):
                kept = [part.column(c).cast(plain[c]) if c in plain else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), *kept], ["id", *columns])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {read.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), columns=("n_tokens", "ids_text", "decoded"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
