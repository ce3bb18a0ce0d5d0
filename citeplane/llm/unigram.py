"""Operator 7, token counts under a unigram model.

The distinct pre-tokens of a slice are walked in sorted order, which is a depth-first walk of their trie: the forward
state of a shared prefix (best score, fewest pieces, open pieces) is computed once and kept on a stack, and the count
at a terminal is stored for every document that holds the pre-token. The memo of a worker is emptied at a bound in bytes, so
memory is bounded and no result depends on it. Rows never meet: nothing is shuffled, whatever the skew.

The model: pieces of a public vocabulary in their order there; no tokenizer is trained, so a piece of rank r gets
Zipf's probability 1 / ((r + 1) H). A character that no piece covers costs one token per UTF-8 byte. Among
segmentations of equal score the one with fewer pieces counts.

Defined results: a null or blank text has no words and no tokens; repeated rows are counted each; texts and words of
any length are counted whole; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Bytes of words that a worker remembers, and of those that it works on at once.
MEMO_BYTES, SLICE_BYTES = 32 << 20, 1 << 20
START = "▁"
#: Log-probability of a byte that stands for a part of an unknown character, below that of every piece.
BYTE_LOG_P = -40.0


def pieces_of(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece file, the likeliest first, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]


def zipf(pieces: list[str]) -> dict[str, float]:
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(pieces)}


class PieceTrie:
    def __init__(self, scores: dict[str, float]):
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Token count of each distinct word; ``words`` may come in any order."""
        root, out = self.root, {}
        before, stack = "", [(0.0, 0, [(root, 0.0, 0)])]
        for word in sorted(words):
            path, shared = START + word, 0
            for a, b in zip(path, before):
                if a != b:
                    break
                shared += 1
            del stack[shared + 1 :]
            for c in path[shared:]:
                score, count, open_pieces = stack[-1]
                size = len(c.encode())
                best, fewest, going = score + size * BYTE_LOG_P, count + size, []
                for node, s, n in open_pieces:
                    node = node.get(c)
                    if node is None:
                        continue
                    going.append((node, s, n))
                    if "" in node and ((t := s + node[""]) > best or t == best and n + 1 < fewest):
                        best, fewest = t, n + 1
                going.append((root, best, fewest))
                stack.append((best, fewest, going))
            out[word] = stack[-1][1]
            before = path
        return out


def token_counts(docs: DataFrame, id_cols: list[str], path: str | None = None, text_col: str = "text") -> DataFrame:
    """``id_cols``, ``n_words`` and ``n_tokens`` of every row."""
    scores = zipf(pieces_of(path))
    if sum(len(p.encode()) + 8 for p in scores) > common.BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    sent = docs.sparkSession.sparkContext.broadcast(scores)
    rows = common.texts(docs, id_cols, text_col)
    schema = T.StructType([*rows.drop("__text").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo, held = PieceTrie(sent.value), {}, 0
        for batch in batches:
            for part in common.slices(batch, batch.num_columns - 1, SLICE_BYTES):
                split = [t.as_py().encode().split() for t in part.column(part.num_columns - 1)]
                distinct = {w for ws in split for w in ws}
                if new := distinct - memo.keys():
                    if held + sum(map(len, new)) + 120 * len(new) > MEMO_BYTES:
                        memo, new, held = {}, distinct, 0
                    held += sum(map(len, new)) + 120 * len(new)
                    memo |= {w.encode(): n for w, n in trie.counts(w.decode() for w in new).items()}
                columns = [*part.columns[:-1], pa.array(map(len, split), pa.int64()), pa.array([sum(map(memo.__getitem__, ws)) for ws in split], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
