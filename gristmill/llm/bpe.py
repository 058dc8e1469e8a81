"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that stands inside no token of the vocabulary can never be merged across,
so every such pair marks a certain cut. Words are cut there, the fragments are encoded on their own
(and remembered, since fragments repeat far more than words), and their ids are concatenated.

Rows never meet: the job is one narrow pass over the documents without a shuffle, so a lost executor
costs only its own tasks. Each Python worker keeps at most ``cache_entries`` words of MOST_CACHED characters at most.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What may be asked of encode(), with its type.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


#: The rank of a pair that is never joined.
NEVER = 1 << 60


class WordBpe:
    """A word-end BPE vocabulary file: NFC, white space folded, lower case, split into words, bytes, merges."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-casing word-end BPE vocabulary")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.alphabet = byte_alphabet()
        self.inside = {t[i : i + 2] for t in (k.removesuffix(self.end) for k in self.vocab) for i in range(len(t) - 1)}
        self.words = _Memo(self.encode_word, cache_entries)
        self.fragments = _Memo(self.merge, cache_entries // 4)

    def merge(self, fragment: tuple[str, ...]) -> tuple[str, ...]:
        """Tokens of one fragment: the best-ranked pair is joined, everywhere at once, until none is left. A pair met once changes its neighbours' ranks only."""
        parts, rank = list(fragment), self.rank.get
        ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            if ranks.count(best) == 1:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
                continue
            pair, joined, i = (parts[i], parts[i + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == pair[0] and parts[i + 1] == pair[1]:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
            ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        return tuple(parts)

    def cuts(self, symbols: str) -> list[int]:
        """Places where a word must be cut."""
        return [i for i in range(1, len(symbols)) if symbols[i - 1 : i + 1] not in self.inside]

    def encode_word(self, word: str) -> tuple[int, str, str]:
        """(number of tokens, ids joined by blanks, tokens joined by blanks) of one piece of the split."""
        plain = word.isascii() and word.isprintable() and " " not in word  # bytes that stand for themselves
        symbols = word if plain else "".join([self.alphabet[b] for b in word.encode()])
        at = [0, *self.cuts(symbols), len(symbols)]
        tokens: list[str] = []
        for a, b in zip(at, at[1:]):
            fragment = (*symbols[a : b - 1], symbols[b - 1] + self.end) if b == len(symbols) else tuple(symbols[a:b])
            tokens += self.fragments[fragment]
        return len(tokens), " ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens)

    def normalize(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """As encode_word, for a whole text (null: empty). Strings of special tokens in the text give their ids."""
        text = text or ""
        if not any(s in text for s in self.special):
            found = [self.words[w] for w in self.pieces.findall(self.normalize(text))]
        else:
            found = []
            for k, part in enumerate(self.special_at.split(text)):
                found += [(1, str(self.special[part]), part)] if k % 2 else [self.words[w] for w in self.pieces.findall(self.normalize(part))]
        if not found:
            return 0, "", ""
        counts, ids, tokens = zip(*found)
        return sum(counts), " ".join(ids), " ".join(tokens)


#: Longer words and fragments are not remembered, so that a cache's bytes are bounded.
MOST_CACHED = 64


class _Memo(dict):
    """A dict that computes what it lacks, and starts anew when it holds ``most`` entries; long keys are not kept."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(key) > MOST_CACHED:
            return self.compute(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


@lru_cache(maxsize=2)
def _loaded(path: str, cache_entries: int) -> WordBpe:
    return WordBpe(path, cache_entries)


def encode(df: DataFrame, text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep: tuple[str, ...] = ("doc_id",), tokenizer_path: str | None = None, cache_entries: int = 400_000) -> DataFrame:
    """One row per input row: the columns of ``keep`` and the asked outputs.

    ids: token ids. decoded: the text that these ids decode to (the tokens, joined by blanks). The
    *_sha256 outputs are lower-case hex digests of the decimal ids joined by blanks and of decoded.
    A null or empty text, or one of white space only, gives 0 tokens and empty results. Repeated rows
    are encoded each. Other columns of df are ignored, whatever their names. The vocabulary file must
    be at ``tokenizer_path`` on every executor, as an installed package is.
    """
    path = tokenizer_path or default_tokenizer_path()
    fields = [df.schema[c] for c in keep] + [T.StructField(c, OUTPUTS[c]) for c in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, cache_entries)
        make = {
            "n_tokens": lambda e: e[0],
            "ids": lambda e: [int(x) for x in e[1].split()],
            "decoded": lambda e: e[2],
            "ids_sha256": lambda e: hashlib.sha256(e[1].encode()).hexdigest(),
            "decoded_sha256": lambda e: hashlib.sha256(e[2].encode()).hexdigest(),
        }
        for batch in batches:
            made: dict[str, list] = {c: [] for c in outputs}
            for text in batch.column(len(keep)):
                encoded = bpe.encode(text.as_py())
                for c in outputs:
                    made[c].append(make[c](encoded))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(made[c], _ARROW[c]) for c in outputs)], names=[*keep, *outputs])

    return df.select(*keep, df[text_col].alias("__text")).mapInArrow(run, T.StructType(fields))
