"""Token counts (operator 10): map-side two-tier lookup of pre-token lengths.

A text is cut into pre-tokens as the tokenizer cuts it, and its count is the sum of their lengths in tokens. Tier 1 is a broadcast
hash table with the lengths of the most frequent pre-tokens of a bounded sample; tier 2 is a cache of the task,
filled by encoding what the table lacks, once each. No pre-token of the corpus is ever
shuffled. The table only saves work: any table gives the same counts. This holds for all scripts whose letters the tokenizer's rules are sure about; texts
with other signs, or special strings, go by their white-space-free runs ("chunks") through the whole tokenizer.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, table, top_counts
from .kernels import lean

#: The split pattern of the word-level byte-pair tokenizer, as its file states it,
#: and the same pattern for texts of ASCII and Latin-1 letters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "a-zß-öø-ÿ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+").findall
_SIMPLE = re.compile(r"[\t-\r -~ß-öø-ÿÀ-ÖØ-Þ]*").fullmatch
#: Ranges of signs that all versions of Unicode of the last years sort, compose and lower-case alike, one by one: Latin, Greek but for the sigma that looks at its
#: neighbours, Cyrillic, punctuation, symbols, Chinese, Japanese, Korean, pictures.
_SETTLED = re.compile("[\t-\r -~\xa1-\u012f\u0131-\u03a2\u03a4-\u052f\u1e00-\u1e95\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u2bff\u3001-\u9fef\uac00-\ud7a3\uff01-\uffdc\U0001f300-\U0001f64f]*").fullmatch
_WORDS = regex.compile(WORD_PATTERN).findall


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Encoder:
    """Values (``of`` their token ids) of pre-tokens and of white-space-free chunks. Texts of settled signs are cut into pre-tokens here, as the
    tokenizer would, and each is encoded once by the tokenizer's model; of all others, the chunks go through the whole tokenizer."""

    def __init__(self, path: str, of=len, limit_bytes: int = 30_000_000):
        import json

        from tokenizers import Tokenizer

        self.whole, self.of = Tokenizer.from_file(path), of
        self.pieces, self.chunks = Cache(self.piece, limit_bytes), Cache(self.chunk, limit_bytes)
        parts = json.loads(self.whole.to_str()).get("pre_tokenizer") or {}
        self.simple = any((p.get("pattern") or {}).get("Regex") == WORD_PATTERN for p in parts.get("pretokenizers", []))
        before = json.loads(self.whole.to_str()).get("normalizer") or {}
        self.settled = self.simple and [n.get("type") for n in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def piece(self, piece: str):
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        return self.of([t.id for t in self.whole.model.tokenize(shown)])

    def chunk(self, chunk: bytes):
        return self.of(self.whole.encode(chunk.decode(), add_special_tokens=False).ids)

    def cut(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None if it must go through the whole tokenizer."""
        if not self.simple or "<|" in text:
            return None
        if _SIMPLE(text):
            return _PIECES(text.lower())
        return _WORDS(unicodedata.normalize("NFC", text).lower()) if self.settled and _SETTLED(text) else None

    def values(self, text: str) -> list:
        """What ``of`` gives for the parts of a text, in order."""
        pieces = self.cut(text)
        if pieces is not None:
            known, find = self.pieces.new, self.pieces.find
            return [known[p] if p in known else find(p) for p in pieces]
        known, find = self.chunks.new, self.chunks.find
        return [known[c] if c in known else find(c) for c in chunks_of(text.encode())]


class Cache:
    """A cache of two generations, each bounded in bytes: a full new one takes the place of the old one, whose
    entries come back as they are asked for. So frequent keys stay, and rare ones cost time only."""

    def __init__(self, make, limit_bytes: int):
        self.make, self.limit, self.size, self.new, self.old = make, limit_bytes, 0, {}, {}

    def find(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.size += 150 + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.size > self.limit:
            self.old, self.size = dict(self.new), 0
            self.new.clear()
        self.new[key] = value
        return value


def chunks_of(text: bytes) -> list[bytes]:
    """bytes.split() cuts at the six ASCII white-space bytes only."""
    return text.split()


def frequent_lengths(docs: DataFrame, tokenizer: str, sample_docs: int = 2000, sample_bytes: int = 16_000_000, size: int = 20_000) -> dict[str, int]:
    """Tier 1: lengths of the ``size`` most frequent pre-tokens of a sample: texts whose hash is low enough for about ``sample_docs`` of them,
    of which a task leaves out those beyond ``sample_bytes``. Tasks cut and encode; the driver gets the table only."""
    rows = docs.count()
    low = F.xxhash64("doc_id", "text").cast("double") / 2.0**64 + 0.5 <= sample_docs / max(1, rows)

    def run(batches):
        encoder, seen, room = Encoder(tokenizer), Counter(), sample_bytes
        for batch in batches:
            for text in batch.column(0).to_pylist():
                room -= len(text)
                if room >= 0:
                    seen.update(encoder.cut(text) or ())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([encoder.piece(p) for p in seen], pa.int32())], ["piece", "n", "length"])

    found = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").where(low).mapInArrow(lean(run), "piece string, n long, length int")
    counts = found.groupBy("piece").agg(F.sum("n").alias("n"), F.min("length").alias("length"))
    counts = cut(counts)  # else every task sends its own best to the driver
    best = {r.piece: r.length for r in top_counts(counts, size).collect()}
    discard(counts)
    return best


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, sample_docs: int = 2000, table_size: int = 20_000) -> DataFrame:
    """Tokens of every whole text -> (doc_id, n_bytes, n_tokens, over_limit).

    Null and empty texts have no tokens. Rows are kept one to one, repeated and
    null ids included; other columns are ignored. Special strings count as the
    tokenizer's default handles them. An empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, sample_docs, size=table_size))

    def run(batches):
        table, encoder = known.value, Encoder(tokenizer)
        rare, find = encoder.pieces.new, encoder.pieces.find

        def tokens(text: str) -> int:
            pieces = encoder.cut(text)
            if pieces is None:
                return sum(encoder.values(text))
            return sum([table[p] if p in table else rare[p] if p in rare else find(p) for p in pieces])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens = [tokens(t) for t in texts]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_token_counts": op10_token_counts}
