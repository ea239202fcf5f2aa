"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is put through the tokenizer alone; those that come out
as their own single id are proven: wherever such a string is a pre-token it is one token,
because merges never cross pre-tokens. A text is then cut into pre-tokens, proven ones
count one, and only the rest is merged (by the tokenizer's own model, remembered).

The cut is made word by word, which is exact: the tokenizer's pre-tokens hold no white
space and its normaliser acts on each character. Words with characters outside a set for
which our cut is proven equal to the tokenizer's go to the tokenizer whole.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, only, ready, table, texts

# The pre-token pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"
# Code points tried when the character set is proven; texts beyond go to the tokenizer.
PROVEN_BELOW = 0x250


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def proven_single(path: str) -> list[str]:
    """Vocabulary strings that, as a pre-token, are exactly one token."""
    from tokenizers import decoders

    tok = tokenizer(path)
    bytes_of = decoders.ByteLevel()
    ids, strings = [], []
    for piece, at in tok.get_vocab(with_added_tokens=False).items():
        if piece.endswith(END_OF_WORD):
            text = bytes_of.decode([piece.removesuffix(END_OF_WORD)])
            if text and "�" not in text and not any(c.isspace() for c in text):
                ids.append(at)
                strings.append(text)
    found = tok.encode_batch_fast(strings, add_special_tokens=False)
    return [s for s, at, e in zip(strings, ids, found) if e.ids == [at]]


def proven_characters(path: str) -> frozenset[str]:
    """Characters that the tokenizer lower-cases and cuts exactly as ``PATTERN`` here does."""
    tok, pattern = tokenizer(path), regex.compile(PATTERN)
    good = set()
    for point in range(PROVEN_BELOW):
        c = chr(point)
        low = c.lower()
        if len(low) != 1 or tok.normalizer.normalize_str(f"x{c}x") != f"x{low}x":
            continue
        if all(len(tok.pre_tokenizer.pre_tokenize_str(t)) == len(pattern.findall(t)) for t in (f"x{low}x", f"1{low}1", f"!{low}!")):
            good.add(c)
    return frozenset(good)


@functools.lru_cache(maxsize=2)
def counter(path: str, single: frozenset[str]):
    """bytes of a word -> its tokens, remembered per worker."""
    tok, pattern, plain = tokenizer(path), regex.compile(PATTERN), proven_characters(path)

    def merged(piece: str) -> int:
        return len(tok.encode(piece, add_special_tokens=False).ids)

    def count(word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        # "<|" may begin a special string, which the tokenizer takes out first.
        if "<|" not in text and plain.issuperset(text):
            return sum(1 if p in single else merged(p) for p in pattern.findall(text.lower()))
        return merged(text)

    return Remembered(count)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    are counted each; an empty table gives no row; further columns are ignored.
    """
    spark = ready(docs.sparkSession)
    # Bounded by the vocabulary.
    single = spark.sparkContext.broadcast(frozenset(proven_single(path)))

    def count(batches):
        per_word = None
        for batch in batches:
            per_word = per_word if per_word is not None else counter(path, single.value)
            n_bytes, n_tokens = [], []
            for text in texts(batch):
                n_bytes.append(len(text))
                n_tokens.append(sum(map(per_word.__getitem__, text.split())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    src = only(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark, folder):
    return count_tokens(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
