"""The pipeline against its stages put together from plain functions, and inputs that stages must bear."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest

from citeplane.llm import bpe, chat, common, components, decontaminate, simhash, toxicity, urls

from .conftest import DOCS, rows
from .test_operators import SPACE, brute_components, brute_matches, brute_print

LABELS = [(100 + i, int(i % 2)) for i in range(40)]
ITEMS = [(1, " ".join(f"bench{i}" for i in range(20))), (2, " ".join(f"other{i}" for i in range(13))), (3, None)]


def documents() -> list[tuple]:
    """Rows of conftest, labelled ones half of which are toxic, some with benchmark passages, near copies and repeated lines."""
    r = random.Random(4)
    word = lambda: r.choice("ba ko mi stra und or lesh tion".split()) + r.choice("n ter la dis go pa".split())
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [(d, t, None, None, None) for d, t, *_ in (x[:2] for x in rows()) if len(t or "") < 20_000]
    out += [(100 + i, prose(30) + (" you worthless idiot scum idiot" if i % 2 else "") + " " + prose(30), "en", "s", 1) for i in range(40)]
    out += [(200 + i, f"{prose(20)} {ITEMS[i % 2][1] if i < 4 else ''} {prose(300)}", "en", "s", 1) for i in range(8)]
    line = "\n".join(prose(12) for _ in range(4))
    out += [(300 + i, f"{prose(25)}\n{line}\n{prose(25)}", "en", "s", 1) for i in range(3)]
    return out


def tables(spark, folder, docs, schema=DOCS) -> str:
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS if docs else [], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS if docs else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain_repeats(docs: list[tuple], run=3, long=50) -> list[tuple]:
    """Line dedup by all runs of lines: (id, text, ...) in the order of ids, nulls first."""
    def lines(t):
        return [x.strip() for x in (t or "").split("\n") if x.strip()]

    import xxhash

    key = lambda x: (x[0] is not None, x[0] or 0)
    size = lambda w: sum(len(x.encode().split()) for x in w)
    first: dict = {}
    every = sorted({(d[0], d[1] or "") for d in docs}, key=key)
    del xxhash
    for d, t in every:
        ls = lines(t)
        for n in range(1, run + 1):
            for p in range(len(ls) - n + 1):
                w = tuple(ls[p : p + n])
                if n == run or size(w) >= long:
                    first.setdefault(w, (d, t, p))
    gone = {}
    for d, t in every:
        ls = lines(t)
        gone[d, t] = {q for n in range(1, run + 1) for p in range(len(ls) - n + 1) for w in [tuple(ls[p : p + n])] if w in first and first[w] != (d, t, p) for q in range(p, p + n)}
    return [(d, [x for i, x in enumerate(lines(t)) if i not in gone[d, t or ""]]) for d, t, *_ in docs]


def test_stages_equal_plain_functions(spark, tmp_path):
    """Each stage on what the one before it has kept, against all pairs, all windows, all lines and the tokenizers library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = tables(spark, tmp_path, documents())
    stage = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, sf, "documents")
    ids = lambda df: sorted((x["doc_id"] for x in df.collect()), key=str)
    # Toxicity: the scores are tested against a plain computation below; here that its decisions take effect.
    kept = common.materialize(stage["toxicity"](spark, docs, sf))
    judged = toxicity.score(docs, common.table(spark, sf, "labels")).collect()
    assert ids(kept) == sorted((x["doc_id"] for x in judged if not x["predicted"]), key=str) and kept.columns == docs.columns
    assert not {100 + i for i in range(1, 40, 2)} & set(ids(kept)) and {100 + i for i in range(0, 40, 2)} <= set(ids(kept))
    before = [tuple(x) for x in kept.collect()]
    lined = common.materialize(stage["line dedup"](spark, kept, sf))
    got = sorted(((x["doc_id"], [y.strip() for y in (x["text"] or "").split("\n") if y.strip()]) for x in lined.collect()), key=str)
    assert got == sorted(plain_repeats(before), key=str) and lined.columns == docs.columns
    before = lined.collect()
    one = common.materialize(stage["simhash near-dedup"](spark, lined, sf))
    prints = {x["text"]: brute_print(x["text"]) for x in before}
    root = brute_components(set(prints.values()))
    groups: dict = {}
    for x in before:
        groups.setdefault(root[prints[x["text"]]], []).append(x["doc_id"])
    least = [min((k for k in ks if k is not None), default=None) for ks in groups.values()]
    assert ids(one) == sorted(least, key=str) and one.columns == docs.columns
    clean = common.materialize(stage["benchmark decontamination"](spark, one, sf))
    items = [(str(i), t) for i, t in ITEMS]
    want = [x["doc_id"] for x in one.collect() if not brute_matches(x["text"], items)[1]]
    assert ids(clean) == sorted(want, key=str) and not {200, 201, 202, 203} & set(ids(clean)) and {204, 205, 206, 207} <= set(ids(clean))
    library = Tokenizer.from_file(bpe.vocabulary_path())
    told = {x["doc_id"]: x for x in stage["bpe encoding and decoding"](spark, clean, sf).collect()}
    for x in clean.collect():
        ids_ = library.encode(x["text"] or "", add_special_tokens=False).ids
        assert told[x["doc_id"]]["token_ids"] == ids_ and told[x["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids_, "<u4").tobytes()).hexdigest()
    assert sorted(map(str, (x["doc_id"] for x in corpus_pipeline.run(spark, sf).collect()))) == sorted(map(str, told))


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = documents()[-51:]
    few = corpus_pipeline.run(spark, tables(spark, tmp_path / "plain", docs))
    wide = corpus_pipeline.run(spark, tables(spark, tmp_path / "wide", [(*d, 2, 3, 4, "u", "v") for d in docs], DOCS + ", k long, h long, fp long, `__text` string, c0 string"))
    read = lambda df: sorted(tuple(x) for x in df.select("doc_id", "n_tokens", "ids_sha256").collect())
    assert read(few) == read(wide) and few.count() > 0
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [])).count() == 0


# 4


def plain_inputs(restorer: toxicity.Restorer, evidence: dict[int, float], text: str) -> list[float]:
    """The inputs of a score, word by word."""
    strong = {}
    tokens = toxicity.tokens_of(text)
    for token in tokens:
        for word in restorer.words(token):
            best = max(evidence.get(int(f), 0.0) for f in toxicity.features_of([word])[0])
            if best > 0:
                strong[word] = best
    top = sorted(strong.values(), reverse=True)[: toxicity.TOP]
    return [*top, *[0.0] * (toxicity.TOP - len(top)), np.log1p(len(tokens))]


def test_scores_equal_a_plain_computation():
    texts = [x[1] or "" for x in documents()] + ["", "i d i o t  y o u", "1d10t!!"]
    codes = np.bincount(toxicity.trigrams(" ".join(texts)), minlength=1 << 18)
    model = toxicity.log_model(np.flatnonzero(codes), codes[codes > 0])
    r = np.random.default_rng(1)
    tables_ = [(np.unique(r.integers(0, 1 << toxicity.BITS, 60_000)), None) for _ in range(2)]
    tables_ = [(i, r.random(len(i)).astype(np.float32) + 0.5) for i, _ in tables_]
    scorer = toxicity.Scorer(model, tables_)
    which = [i % 2 for i in range(len(texts))]
    got = scorer.inputs(texts, which)
    for text, w, row in zip(texts, which, got):
        assert row == pytest.approx(plain_inputs(scorer.restorer, dict(zip(tables_[w][0].tolist(), tables_[w][1].tolist())), text))


def test_spaced_words_are_told_apart():
    text = "that idiot is an awful clown and you are a stupid loser of trash in here " * 300
    codes = np.bincount(toxicity.trigrams(text), minlength=1 << 18)
    restorer = toxicity.Restorer(toxicity.log_model(np.flatnonzero(codes), codes[codes > 0]))
    found = lambda t: {w for token in toxicity.tokens_of(t) for w in restorer.words(token)}
    for spaced, word in (("a n i d i o t", "idiot"), ("s t u p i d t r a s h", "trash"), ("i d i o t  h e r e", "idiot"), ("c\nl\no\nw\nn", "clown"), ("1 d 1 0 t", "idiot")):
        assert word in found(spaced), (spaced, found(spaced))
    assert len(restorer.viterbi("4$" * 5000)) <= 20_000


def test_trigrams_of_pieces_are_those_of_the_whole():
    text = "".join(random.Random(1).choice("ab c,  \nà") for _ in range(5000))
    count = lambda x: np.bincount(toxicity.trigrams(x), minlength=1 << 18)
    assert (count(text) == sum(count(p) for p in toxicity.pieces(text, 100))).all()


# 2, 8, 9, 10 and what they share


def test_memo_is_bounded_and_right():
    made = []
    memo = common.Memo(lambda k: made.append(k) or k * 2, limit=60_000)
    for i in range(5000):
        assert memo[f"k{i % 700}"] == f"k{i % 700}" * 2 and memo.held <= 60_000 and len(memo.older) < 700
    assert len(made) > 700 and memo["x" * 100_000] == "x" * 200_000 and "x" * 100_000 not in memo


def test_affected_documents_go_however_long(spark):
    item = " ".join(f"bench{i}" for i in range(13))
    docs = [(1, "word " * 900 + item), (2, "word " * 900), (3, None), (None, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    left = lambda **k: sorted(map(str, (x["doc_id"] for x in decontaminate.without_affected(df, bench, **k).collect())))
    assert left() == left(block_bytes=60) == ["2", "3"] and {x["doc_id"] for x in decontaminate.decontaminate(df, bench).collect()} == {1, 2, 3}


def test_another_tokenizer_is_refused():
    with open(bpe.vocabulary_path(), "rb") as f:
        spec = json.load(f)
    for key, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", {"type": "BPEDecoder"}), ("added_tokens", [{**spec["added_tokens"][0], "lstrip": True}]), ("model", {**spec["model"], "byte_fallback": True})):
        with pytest.raises(ValueError, match="declares another"):
            bpe.WordBpe(json.dumps(spec | {key: value}).encode())


def test_components_of_odd_tables(spark):
    links = lambda rows_: {(x["node"], x["root"]) for x in components.components(spark.createDataFrame(rows_, "a long, b long")).collect()}
    assert links([]) == set() and links([(1, 1)]) == set()
    assert links([(3, 2), (2, 3), (2, 3), (1, 2), (9, 8), (8, 8)]) == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert links([(i, i + 1) for i in range(40)]) == {(i, 0) for i in range(41)}


def test_one_hot_component(spark):
    """A third of all rows near one another, the others alone: everyone has the least id reachable."""
    base = " ".join(f"w{i}" for i in range(200))
    data = [(i, base if i % 3 == 0 else f"{base} x{i}" if i % 3 == 1 else " ".join(f"{i}v{j}" for j in range(30))) for i in range(90)]
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), ["doc_id"]).collect()}
    prints = {i: brute_print(t) for i, t in data}
    root, least = brute_components(set(prints.values())), {}
    for i, _ in data:
        least[root[prints[i]]] = min(least.get(root[prints[i]], i), i)
    assert found == {i: least[root[p]] for i, p in prints.items()} and SPACE.findall("a b") == ["a", "b"]


def test_registered_domains(spark):
    from pyspark.sql import functions as F

    want = {
        "a.b.example.com": ("example.com", "com"), "shop.co.uk": ("shop.co.uk", "co.uk"), "www.shop.co.uk:80": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com.au": ("x.com.au", "com.au"), "localhost": ("localhost", "localhost"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "u:p@www.x.org.": ("x.org", "org"), "": ("", ""), "a.github.example": ("a.github.example", "github.example"), "com.de": ("com.de", "com.de"), "xco.uk": ("xco.uk", "uk"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string").withColumn("s", urls.suffix_of(F.col("h"), ("github.example",))).withColumn("d", urls.domain_of(F.col("h"), F.col("s")))
    assert {x["h"]: (x["d"], x["s"]) for x in df.collect()} == want
    # Hosts of two domains below co.uk don't decide for each other.
    pages = [(i, f"http://a{i % 3}.bad.co.uk/{i}") for i in range(90)] + [(200 + i, f"http://b{i % 3}.good.co.uk/{i}") for i in range(90)] + [(500, "http://new.bad.co.uk/"), (501, "http://new.good.co.uk/"), (502, None)]
    labels = [(i, 0) for i in range(90)] + [(200 + i, 1) for i in range(90)]
    got = {x["page_id"]: x["verdict"] for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[0] == "block" and got[200] == got[501] == got[502] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    clash = spark.createDataFrame([(1, "http://a.com/", "x", 2, "y")], "page_id long, url string, URL string, n long, host string")
    assert urls.judge(clash, spark.createDataFrame([(1, 0, 5)], "doc_id long, quality int, bad int")).first()["host"] == "a.com"


def test_chat_on_clashing_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", "x", 2), (1, 2, "assistant", None, "y", 3)], "conv_id long, turn int, role string, text string, TEXT string, formatted int")
    laid = chat.apply_template(chat.canonical_rows(df), ["conv_id"])
    assert [t["text"] for t in chat.read_back(laid, ["conv_id"]).first()["turns"]] == ["a", ""]
    assert chat.read_back(chat.apply_template(chat.canonical_rows(df.limit(0)), ["conv_id"]), ["conv_id"]).count() == 0
