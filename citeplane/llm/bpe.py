"""Operator 8, BPE encoding and decoding.

Every pre-token is merged with a segment tree over the ranks of its adjacent pairs: a leaf holds
``rank << 32 | position``, an inner node the minimum of its children, so the root is the leftmost pair of lowest
rank. A merge changes three leaves, each in logarithmic time, and the loop ends when the root holds no pair. A
pre-token of n bytes takes O(n log n), however long it is.

Rows never meet, so nothing is shuffled: one pass over the text, whatever its skew.

Defined results: a null text counts as the empty text (no ids, empty decoding); repeated rows are encoded each;
texts of any length are encoded whole; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_SPACES = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_NONE = 1 << 62


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class PairTree:
    """Minimum over adjacent pairs, by rank and then by position."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = node = [_NONE] * self.size + keys + [_NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def root(self) -> int:
        return self.node[1]

    def put(self, at: int, key: int) -> None:
        node, i = self.node, at + self.size
        node[i] = key
        while i > 1:
            i >>= 1
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                return
            node[i] = low


#: What a file may declare besides its vocabulary: the steps that ``WordBpe`` takes.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class WordBpe:
    """Encoder and decoder of a word-end BPE vocabulary in the tokenizers library's JSON form.

    A file whose normalizer, pre-tokenizer, decoder, model options or added tokens ask for anything else is refused.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        for what, own, wanted in (
            ("normalizer", (spec.get("normalizer") or {}).get("normalizers"), NORMALIZERS),
            ("pre-tokenizer", (spec.get("pre_tokenizer") or {}).get("pretokenizers"), PRE_TOKENIZERS),
            ("decoder", spec.get("decoder"), None),
            ("model", [model.get("type")] + [model.get(k) or None for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")], ["BPE"] + [None] * 6),
            ("added tokens", [x["content"] for x in spec["added_tokens"] if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]], []),
        ):
            if own != wanted:
                raise ValueError(f"this vocabulary file declares another {what} than this encoder has: {own}")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.first: list[int | None] = [vocab.get(c) for c in byte_letters()]
        self.last: list[int | None] = [vocab.get(c + self.suffix) for c in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.added = added
        #: What all added tokens begin with: a text without it needs no search for them.
        self.sign = commonprefix(list(added))
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        #: Ids of pre-tokens, as machine words.
        self.memo = common.Memo(lambda word: self.merge(word.encode()).tobytes())

    def merge(self, data: bytes) -> array:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return array("I", ids)
        merges = self.merges
        found = [merges.get(p) for p in zip(ids, ids[1:])]
        tree = PairTree([m[0] << 32 | i if m else _NONE for i, m in enumerate(found)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree.root()) != _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, _NONE)
            if k < n:
                before[k] = i
                m = merges.get((ids[i], ids[k]))
                tree.put(i, m[0] << 32 | i if m else _NONE)
            else:
                tree.put(i, _NONE)
            if (h := before[i]) >= 0:
                m = merges.get((ids[h], ids[i]))
                tree.put(h, m[0] << 32 | h if m else _NONE)
        return array("I", [i for i in ids if i >= 0])

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of text that holds no added token."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _WORDS.findall(text.lower())

    def encode(self, text: str) -> array:
        out = bytearray()
        for part in self.cut.split(text) if self.cut and self.sign in text else (text,):
            if part in self.added:
                out += array("I", [self.added[part]]).tobytes()
                continue
            for word in self.pieces(part):
                out += self.memo[word]
        return array("I", bytes(out))

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the ids, a space between each two: the vocabulary names no decoder that would do more."""
        return " ".join(map(self.names.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(key: str, raw) -> WordBpe:
    if key not in _LOADED:
        _LOADED[key] = WordBpe(raw())
    return _LOADED[key]


def encode(docs: DataFrame, id_cols: list[str], path: str | None = None, text_col: str = "text", outputs: tuple[str, ...] = ("token_ids",)) -> DataFrame:
    """``id_cols`` and, per row, what ``outputs`` names: token_ids (array of int), decoded, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    with open(path or vocabulary_path(), "rb") as f:
        raw = f.read()
    if len(raw) > common.BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    key, sent = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    kinds = {"token_ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    rows = common.texts(docs, id_cols, text_col)
    schema = T.StructType([*rows.drop("__text").schema.fields, *(T.StructField(o, kinds[o]) for o in outputs)])
    arrow = {"token_ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(key, lambda: sent.value)
        little = array("I", [1]).tobytes()[0] == 1
        for batch in batches:
            for part in common.slices(batch, batch.num_columns - 1):
                made: dict[str, list] = {o: [] for o in outputs}
                for text in part.column(part.num_columns - 1):
                    ids = bpe.encode(text.as_py())
                    if "token_ids" in made:
                        made["token_ids"].append(pa.array(ids, pa.int32()))
                    if "n_tokens" in made:
                        made["n_tokens"].append(len(ids))
                    if "ids_sha256" in made:
                        if not little:
                            ids.byteswap()
                        made["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                        if not little:
                            ids.byteswap()
                    if "decoded" in made or "decoded_sha256" in made:
                        decoded = bpe.decode(ids)
                        if "decoded" in made:
                            made["decoded"].append(decoded)
                        if "decoded_sha256" in made:
                            made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if "token_ids" in made:
                    lists = made["token_ids"]
                    ends = pa.array([0, *_sums(map(len, lists))], pa.int32())
                    made["token_ids"] = pa.ListArray.from_arrays(ends, pa.concat_arrays(lists) if lists else pa.array([], pa.int32()))
                columns = [*part.columns[:-1], *(v if isinstance(v, pa.Array) else pa.array(v, arrow.get(o, pa.string())) for o, v in made.items())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _sums(sizes: Iterable[int]) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def decode(rows: DataFrame, id_cols: list[str], path: str | None = None, ids_col: str = "token_ids") -> DataFrame:
    """``id_cols`` and the text ``decoded`` of an array of ids (null: empty text)."""
    spark = rows.sparkSession
    with open(path or vocabulary_path(), "rb") as f:
        raw = f.read()
    key, sent = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    rows = rows.select(*id_cols, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([*rows.drop("__ids").schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(key, lambda: sent.value)
        for batch in batches:
            out = pa.array([bpe.decode(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests."""
    docs = common.table(spark, sf_dir, "documents")
    return encode(docs, ["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}
