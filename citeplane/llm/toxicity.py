"""Operator 4, toxicity by noisy-channel deobfuscation.

A token with digits, symbols or letters repeated three times and more is a lattice of characters: each sign may stand
for some letters, for none, or for a border, each run for one letter, two, or itself; single characters set apart by
white space form one token, with a border or none at each gap. Viterbi's algorithm finds the likeliest letters under a character trigram model that is counted
over all documents (64 classes of characters, so at most 2^18 counts reach the driver and the executors). A token
without such signs is its own only path and needs no search.

The scorer: features of restored words are the word and its beginnings, hashed to 2^20. Their evidence, a shrunken
log-odds, comes from at most ``SAMPLE`` labelled documents, as counts; the score is a logistic function of a document's
three strongest words and its length, fitted by Newton's method to evidence from the other half of the sample.

A slice of about ``SLICE_BYTES`` of texts is worked on at a time and nothing else is remembered, so a worker's memory is bounded.
Documents never move: the sample's ids, bounded by ``SAMPLE``, are broadcast; each pass is one scan. Defined results: a
null text is empty and gets the score of no evidence; repeated rows are scored each; a null doc_id is not held out and
has no label; of repeated labels 1 decides; null labels are left out; without labels of both kinds every score is the
smoothed share of 1, or 0.05 where there is none; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bound on the labelled documents that the classifier is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.3
BITS = 20
TOP = 3
SHRINK = 4.0
#: Edges after which the search settles on the best path so far, so that its memory is bounded on tokens of any length.
SETTLE = 256
#: Bytes of texts that a task works on at once.
SLICE_BYTES = 1 << 20
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåçéèêëíìîïñóòôöõúùûüýÿœæßø"
_CLASS = np.full(0x250, 63, dtype=np.int32)
for _c in range(0x250):
    _CLASS[_c] = LETTERS.index(chr(_c)) + 1 if chr(_c) in LETTERS else 63 if chr(_c).isalpha() else 0
_OF = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a sign may stand for, besides nothing and a border.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h", "&": "e"}
LETTER_COST, NOTHING_COST, BORDER_COST, KEEP_COST, GAP_COST = 1.0, 2.5, 3.0, 4.0, 0.5
_TRIPLE = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S\s{1,3}){2,}\S(?!\S)")
_BLANKS = re.compile(r"\s+")
#: What stands between the letters of a spaced run: one blank, more likely no border, or more than that, more likely one.
NARROW, WIDE = "\0", "\1"
#: Stripped from both ends of a token; signs inside it, and dollar and at signs at its ends, may stand for letters.
_EDGES = ".,;:!?\"'`()[]{}<>*#%&$@|~^_-+=/\\…–—«»„“”"
_PLAIN = re.compile(r"[^\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Trigram codes of a text: two borders stand before each word and behind it."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    codes = np.zeros(len(points) + 2, dtype=np.int32)
    codes[1:-1] = np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], 63)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    codes = np.repeat(codes, np.where(codes == 0, 2, 1))
    return codes[:-2] << 12 | codes[1:-1] << 6 | codes[2:]


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at blanks."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        yield text[at : end if end >= 0 else len(text)]
        at = end if end >= 0 else len(text)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n) over all documents; each task adds its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, dtype=np.int64)
        for batch in batches:
            for part in common.slices(batch, 0, SLICE_BYTES):
                for text in pieces(" ".join(part.column(0).to_pylist())):
                    total += np.bincount(trigrams(text), minlength=1 << 18)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return common.texts(docs, [], text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_model(code: np.ndarray | list[int], n: np.ndarray | list[int]) -> np.ndarray:
    """Log-probabilities of the third class after the first two, smoothed by shorter contexts."""
    c3 = np.zeros(1 << 18)
    c3[code] = n
    c3 = c3.reshape(64, 64, 64)
    c2 = c3.sum(axis=0)
    c1 = c2.sum(axis=0)
    p1 = (c1 + 1) / (c1.sum() + 64)
    p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _spelled(path: tuple) -> str:
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def _edges(self, token: str) -> Iterator[list[tuple[str, float]]]:
        at = 0
        while at < len(token):
            c, end = token[at], at + 1
            while end < len(token) and token[end] == c:
                end += 1
            n = end - at
            if c in (NARROW, WIDE):
                yield [("", GAP_COST * (c == WIDE)), (" ", GAP_COST * (c == NARROW))]
            elif c.isalpha():
                yield [(c * n, 0.0)] if n < 3 else [(c, LETTER_COST), (c * 2, LETTER_COST), (c * n, KEEP_COST)]
            else:
                out = [("", NOTHING_COST), (" ", BORDER_COST)]
                for x in SIGNS.get(c, ""):
                    out.append((x, LETTER_COST if c != "*" else NOTHING_COST))
                    if n > 1:
                        out.append((x * 2, LETTER_COST))
                yield out
            at = end

    def viterbi(self, token: str) -> str:
        """The likeliest letters of a token in lower case; a border is a space."""
        model = self.model
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        settled: list[str] = []
        for at, options in enumerate(self._edges(token), 1):
            now: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                for text, cost in options:
                    s, x, y = score - cost, a, b
                    for c in text:
                        k = 0 if c == " " else _OF.get(c, 63)
                        s += model[x][y][k]
                        x, y = (y, k) if k else (0, 0)
                    if (x, y) not in now or s > now[x, y][0]:
                        now[x, y] = s, (path, text) if text else path
            best = now
            if at % SETTLE == 0:
                end = max(best, key=lambda k: (best[k][0], k))
                settled.append(_spelled(best[end][1]))
                best = {end: (0.0, ())}
        end = max(best, key=lambda k: (best[k][0] + (model[k[0]][k[1]][0] if k != (0, 0) else 0.0), k))
        return "".join([*settled, _spelled(best[end][1])])

    def words(self, token: str) -> set[str]:
        """Words of a token as it stands and as restored, in lower case."""
        token = token.lower()
        if NARROW in token or WIDE in token:
            return {x for part in token.split(WIDE) if (x := part.replace(NARROW, "")).isalpha()} | set(self.viterbi(token).split())
        if token.isalpha() and not _TRIPLE.search(token):
            return {token}
        found = set(_PLAIN.findall(token))
        core = token.strip(_EDGES)
        wide = token.strip(_EDGES.replace("$", "").replace("@", ""))
        if core.isalpha() and not _TRIPLE.search(core):
            found.add(core)
            if core == wide:
                return found
        found.update(self.viterbi(wide).split())
        return found


def tokens_of(text: str) -> set[str]:
    found = set(text.split())
    for run in _SPACED.findall(text):
        found.add("".join(run.split()))
        found.add(_BLANKS.sub(lambda m: NARROW if m[0] in " \t" else WIDE, run))
    return found


def features_of(words: list[str]) -> np.ndarray:
    """A row for each word: hashes of the word and of its beginnings of 3 to 7 letters; 2^BITS where it has no such beginning."""
    mask = np.uint64((1 << BITS) - 1)
    letters = np.array(words, dtype="U7").view(np.uint32).reshape(-1, 7).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), 6), 1 << BITS, dtype=np.int64)
    out[:, 0] = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) & int(mask)
    h = np.full(len(words), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for n in range(7):
        h = (h ^ letters[:, n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        if n >= 2:
            out[:, n - 1] = np.where(size > n, (h & mask).astype(np.int64), 1 << BITS)
    return out


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _evidence(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    base = n1 / max(1, n1 + n0)
    p = (c1 + SHRINK * base) / (c1 + c0 + SHRINK)
    return (np.log(p / (1 - p)) - math.log(base / (1 - base))).astype(np.float32)


def spelled_out(restorer: Restorer, texts: list[str]) -> tuple[list[set[str]], dict[str, int], list[str], np.ndarray]:
    """The tokens of each text; a number for each distinct token; all their words in a row, and where each token's begin."""
    tokens = [tokens_of(t) for t in texts]
    number = {t: i for i, t in enumerate(set().union(*tokens))}
    words, ends = [], [0]
    for token in number:
        words += restorer.words(token)
        ends.append(len(words))
    return tokens, number, words, np.array(ends)


class Scorer:
    """Strongest words of documents, by tables of evidence for each way of scoring; nothing is kept between calls."""

    def __init__(self, model: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.restorer = Restorer(model)
        self.tables = []
        for i, v in tables:
            table = np.zeros((1 << BITS) + 1, dtype=np.float32)
            table[i] = v
            self.tables.append(table)

    def inputs(self, texts: list[str], which: list[int] | None = None) -> np.ndarray:
        """A row for each text: its strongest words' evidence and the logarithm of its tokens; ``which`` names their tables."""
        tokens, number, words, ends = spelled_out(self.restorer, texts)
        found = features_of(words)
        out = np.zeros((len(texts), TOP + 1))
        for t in sorted(set(which or [0])):
            best = self.tables[t][found].max(axis=1, initial=0)
            known = np.flatnonzero(best)
            owner, names = np.searchsorted(ends, known, "right") - 1, list(number)
            strong: dict[str, list[tuple[str, float]]] = {}
            for o, w in zip(owner.tolist(), known.tolist()):
                strong.setdefault(names[o], []).append((words[w], float(best[w])))
            keys = set(strong)
            for row, (own, k) in enumerate(zip(tokens, which or [0] * len(texts))):
                if k == t:
                    top = sorted(dict(x for token in own & keys for x in strong[token]).values(), reverse=True)[:TOP]
                    out[row, : len(top)] = top
        out[:, TOP] = np.log1p([len(own) for own in tokens])
        return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic function of ``x``, the last one constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, names: list[str] = ["doc_id"], key: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:  # noqa: B006
    """``names``, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    counts = count_trigrams(docs, text_col).toArrow()
    model = spark.sparkContext.broadcast(log_model(counts.column("code").to_numpy(), counts.column("n").to_numpy()))
    known = common.pick(labels, [key, label]).toDF("k", "y").where("k is not null and y is not null").where(~held_out("k"))
    known = known.groupBy("k").agg(F.max("y").cast("int").alias("y")).where("y in (0, 1)").orderBy(F.xxhash64("k"), "k").limit(sample)
    known = common.materialize(known.withColumn("fold", F.shiftright(F.xxhash64("k"), 7).bitwiseAND(F.lit(1)).cast("int")))
    texts = common.texts(docs, [key], text_col).toDF("k", "__text").join(F.broadcast(known), "k").select("y", "fold", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(model.value), np.zeros((4, (1 << BITS) + 1), dtype=np.int32)
        for batch in batches:
            for part in common.slices(batch, 2, SLICE_BYTES):
                tokens, number, words, ends = spelled_out(restorer, part.column(2).to_pylist())
                found = features_of(words)
                for y, fold, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tokens):
                    rows = [found[ends[n] : ends[n + 1]].ravel() for n in map(number.__getitem__, own)]
                    seen[2 * fold + y, np.unique(np.concatenate([*rows, [1 << BITS]]))] += 1
        f = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(f), *(pa.array(n[f].astype(np.int64)) for n in seen)], names=["f", *kinds])

    # Documents with a feature, by fold and label; one feature more, 2^BITS, is had by all.
    kinds = ("n00", "n01", "n10", "n11")
    sums = texts.mapInArrow(count, "f long, " + ", ".join(f"{k} long" for k in kinds)).groupBy("f").agg(*(F.sum(k).alias(k) for k in kinds))
    # At most 2^BITS rows, fewer as only features of two toxic documents or more are evidence; as arrays.
    rows = sums.where(f"f = {1 << BITS} or n01 + n11 >= 2").toArrow()
    f = rows.column("f").to_numpy()
    order = np.argsort(f)
    f, c = f[order], {k: rows.column(k).to_numpy()[order].astype(np.float64) for k in kinds}
    every = len(f) > 0 and f[-1] == 1 << BITS
    total = {k: int(v[-1]) if every else 0 for k, v in c.items()}
    if every:
        f, c = f[:-1], {k: v[:-1] for k, v in c.items()}

    def made(*folds: int) -> tuple[np.ndarray, np.ndarray]:
        n1, n0 = (sum(total[f"n{i}{y}"] for i in folds) for y in (1, 0))
        if not (n1 and n0 and len(f)):
            return f[:0], np.zeros(0, np.float32)
        v = _evidence(sum(c[f"n{i}1"] for i in folds), sum(c[f"n{i}0"] for i in folds), n1, n0)
        return f[v > 0.5], v[v > 0.5]

    n1, n0 = total["n01"] + total["n11"], total["n00"] + total["n10"]
    sent = spark.sparkContext.broadcast([made(0, 1), made(1), made(0)])

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, sent.value)
        for batch in batches:
            for part in common.slices(batch, 2, SLICE_BYTES):
                x = scorer.inputs(part.column(2).to_pylist(), [1 + fold for fold in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy().astype(np.float64)), *map(pa.array, x.T)], names=[f"x{i}" for i in range(TOP + 2)])

    weights = np.array([0.0] * (TOP + 1) + [math.log((n1 + 0.5) / (n0 + 0.5)) if n1 or n0 else math.log(0.05 / 0.95)])
    if n1 and n0:
        # A row of TOP + 2 numbers for each sampled document.
        x = np.column_stack([v.to_numpy() for v in texts.mapInArrow(inputs, ", ".join(f"x{i} double" for i in range(TOP + 2))).toArrow().columns])
        x = x[np.lexsort(x.T)]
        weights = _fit(x[:, 1:], x[:, 0])

    # The text goes along once: as one of the names, or else only into the task.
    columns = list(dict.fromkeys([*names, key, text_col]))
    rows = common.pick(docs, columns)
    at, out = columns.index(text_col), [i for i, n in enumerate(columns) if n in (*names, key)]
    schema = T.StructType([*(rows.schema.fields[i] for i in out), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, sent.value[:1])
        for batch in batches:
            for part in common.slices(batch, at, SLICE_BYTES):
                x = scorer.inputs([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in out), pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).select(*names, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those predicted to be toxic."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    k, t = f"c{names.index(key)}", f"c{names.index(text_col)}"
    label = options.pop("label", "toxic")
    known = common.pick(labels, [key, label]).toDF(k, label)
    return score(plain, known, plain.columns, k, t, label, **options).where("predicted = 0").select(*plain.columns).toDF(*names)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
