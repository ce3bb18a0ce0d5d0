from __future__ import annotations

import hashlib
import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeplane.llm import bpe, chat, common, decontaminate, lines, quality, repeats, simhash, suffixes, toxicity, unigram, urls

from .conftest import plain, rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# 1


def brute_passages(data, size, split):
    """(id, text) -> covered token numbers, by all windows."""
    places = defaultdict(set)
    docs = {(d, t or "") for d, t in data}
    for d, t in docs:
        w = split(t)
        for p in range(len(w) - size + 1):
            places[tuple(w[p : p + size])].add((d, t, p))
    hit = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for d, t, p in found:
                hit[d, t].update(range(p, p + size))
    return {k: v for k, v in hit.items()}


@pytest.mark.parametrize(("size", "gram"), [(50, 16), (5, 2), (3, 1), (8, 8)])
def test_repeats_equal_brute_force(docs, size, gram):
    found = suffixes.repeated_passages(docs, passage=size, gram=gram).collect()
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_passages(data, size, lambda t: SPACE.findall(t))
    got = defaultdict(list)
    for r in found:
        got[r["k"]].append(sorted(x for s in r["spans"] for x in range(s["start"], s["end"])))
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    expect = defaultdict(list)
    for (d, _), v in want.items():
        expect[d].append(sorted(v))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expect.items()}


def test_repeats_random_small_alphabet(spark):
    r = random.Random(3)
    data = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for i in range(80)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {x["k"]: {p for s in x["spans"] for p in range(s["start"], s["end"])} for x in suffixes.repeated_passages(df, passage=7, gram=3).collect()}
    assert found == {d: v for (d, _), v in brute_passages(data, 7, str.split).items()}


@pytest.mark.parametrize(("partitions", "group"), [(1, 4000), (7, 3), (3, 0), (40, 20)])
def test_sorted_suffixes_over_any_partitions_and_groups(spark, partitions, group):
    """Hot contexts and grams over the ends of partitions, in tasks of few rows and of many, and by windows where a group is large."""
    r = random.Random(partitions)
    hot = " ".join(f"hot{i % 7}" for i in range(12))
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(60)] + [hot] * 30 + [f"x{i} {hot} y{i % 3}" for i in range(25)] + [None, "", "a"]
    data = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 20
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffixes.repeated_passages(df, passage=7, gram=3, group=group).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got, want = defaultdict(list), defaultdict(list)
    for x in found:
        got[x["k"]].append(sorted({p for s in x["spans"] for p in range(s["start"], s["end"])}))
    for (d, _), v in brute_passages(data, 7, str.split).items():
        want[d].append(sorted(v))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize(("group", "written"), [(4000, 0), (0, 1)])
def test_contexts_are_written_only_if_two_passes_read_them(spark, monkeypatch, group, written):
    r = random.Random(5)
    data = [(i, " ".join(r.choice("abc") for _ in range(30))) for i in range(40)]
    tables, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df: (tables.append(df.columns), write(df))[1])
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {x["k"]: {p for s in x["spans"] for p in range(s["start"], s["end"])} for x in suffixes.repeated_passages(df, passage=7, gram=3, group=group).collect()}
    assert found == {d: v for (d, _), v in brute_passages(data, 7, str.split).items()}
    assert sum("words" in columns for columns in tables) == written


def test_minimiser_rows_tile_the_windows():
    x = np.random.default_rng(1).integers(0, 4, 500).astype(np.uint64)
    _, _, m, first, last = repeats.minimisers(x, 20, 6)
    assert first[0] == 0 and last[-1] == 480 and (first[1:] == last[:-1] + 1).all() and ((m >= last) & (m <= first + 14)).all()


# 2


def brute_matches(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        for g in {tuple(w[p : p + window]) for p in range(max(1, len(w) - window + 1))} if w else ():
            for p in range(len(words) - len(g) + 1):
                if tuple(words[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    found.add(item)
    return len(words), len(hit), sorted({i for i in found if i is not None})


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 150])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(5)
    word = lambda: r.choice(["Alpha", "beta", "Gamma,", "ÉTÉ", "x9"])
    items = [("7", " ".join(word() for _ in range(n))) for n in (40, 20, 13)] + [("8", "Alpha beta x9"), ("9", "..."), ("10", None), (None, "Gamma x9 x9"), ("8", "Alpha beta x9")]
    texts = [" ".join(word() for _ in range(r.randrange(30))) for _ in range(20)] + [items[0][1].upper(), f"x {items[1][1]} y", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {x["doc_id"]: x for x in decontaminate.matches(df, bench, block_bytes=block).collect()}
    for i, t in enumerate(texts):
        x = found[i]
        assert (x["n_words"], sum(x["spans"][1::2]) - sum(x["spans"][::2]), x["items"]) == brute_matches(t, items), t
    kept = {x["doc_id"] for x in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not ((n := brute_matches(t, items))[1] and 20 * n[1] >= n[0])}
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(texts)


# 3


def test_chat_round_trip(spark):
    r = random.Random(11)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "<\\|im_end|>", "[INST]", "[\\\\/INST]", "</s>", "é", "<<SYS>>", "assistant", " "]
    data = [(c, t, r.choice(["user", "assistant", "sys\ntem", "a\\nb\\b", "", None]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randrange(9)))])) for c in range(60) for t in range(r.randrange(1, 6))]
    data += [(None, 1, "user", "x"), (5, 0, "user", "tie"), (5, 0, "assistant", "tie")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    laid = chat.apply_template(chat.canonical_rows(df), ["conv_id"])
    found = {x["conv_id"]: x for x in chat.read_back(laid, ["conv_id"]).collect()}
    masks = {x["conv_id"]: x for x in laid.collect()}
    none = lambda v: (v is not None, v if v is not None else "")
    for c in {x[0] for x in data}:
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in data if x[0] == c), key=lambda x: (x[1], none(x[2]), none(x[3])))]
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == want
        assert found[c]["loss_texts"] == [t for role, t in want if role == "assistant"]
        text = masks[c]["formatted"]
        assert len(text) == found[c]["formatted_chars"] == sum(m["lead"] + m["loss"] + m["tail"] for m in masks[c]["mask"])
        assert text.count("<|im_end|>") == len(want) and "[INST]" not in text and "</s>" not in text


def test_layouts_are_told_apart_by_their_paths(spark):
    data = {
        "messages": '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        "conversations": '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        "turns": '{"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}], "more": {"x": []}}',
        "instruction": '{"instruction": "q", "output": "a"}',
        "instruction_input": '{"instruction": "q", "input": "", "output": "a"}',
        "prompt_response": '{"prompt": "q", "response": "a"}',
        "prompt_completion": '{"completion": "a", "prompt": "q"}',
        "question_answer": '{"question": "q", "answer": "a", "z": 3}',
    }
    bad = {"x1": "[1]", "x2": "no json", "x3": None, "x4": '{"prompt": "only"}'}
    df = spark.createDataFrame(list({**data, **bad}.items()), "id string, j string")
    for x in chat.canonical_records(df, ["id"], "j").collect():
        if x["id"] in bad:
            assert x["layout"] is None and x["turns"] is None
        else:
            assert x["layout"] == x["id"] and [(t["role"], t["text"]) for t in x["turns"]] == [("user", "q"), ("assistant", "a")]


def test_records_of_mixed_layouts_lose_nothing_silently(spark):
    said = '[{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]'
    data = {
        "both": (f'{{"messages": {said}, "prompt": "p", "response": "r"}}', "messages", [("user", "q"), ("assistant", "a")], ["$.prompt", "$.response"]),
        "system": (f'{{"system": "s", "messages": {said}}}', "system_messages", [("system", "s"), ("user", "q"), ("assistant", "a")], []),
        "output": (f'{{"messages": {said}, "output": "o"}}', "messages", [("user", "q"), ("assistant", "a")], ["$.output"]),
        "empty": ('{"messages": []}', "messages", [], []),
        "late": ('{"turns": [{"text": "x"}, {"role": "assistant", "text": null}]}', "turns", [("", "x"), ("assistant", "")], []),
        "null": ('{"prompt": null, "response": "r"}', "prompt_response", [("user", ""), ("assistant", "r")], []),
        "input": ('{"instruction": "i", "input": "j", "output": "o", "system": "s"}', "instruction_input", [("user", "i\n\nj"), ("assistant", "o")], ["$.system"]),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in data.items()], "id string, j string")
    for x in chat.canonical_records(df, ["id"], "j").collect():
        assert (x["layout"], [(t["role"], t["text"]) for t in x["turns"]], x["unused"]) == data[x["id"]][1:], x["id"]


def test_structs_and_rows_with_further_columns(spark):
    kind = "id long, r struct<messages: array<struct<role: string, content: string, extra: int>>, prompt: string>"
    df = spark.createDataFrame([(1, ([("human", "q", 1), (None, None, None)], "p")), (2, (None, "p")), (3, None), (4, ([], None))], kind)
    got = {x["id"]: (x["layout"], x["turns"] and [tuple(t) for t in x["turns"]]) for x in chat.canonical_structs(df, ["id"], "r").collect()}
    assert got == {1: ("messages", [("user", "q"), ("", "")]), 2: (None, None), 3: (None, None), 4: ("messages", [])}
    rows = spark.createDataFrame([(1, 2, "assistant", "b", "z", "Z"), (1, 1, "user", "a", "z", "Z")], "conv_id long, turn int, role string, text string, content string, Text string")
    for renamed in (rows, rows.drop("text", "Text").toDF("conversation_id", "message_index", "role", "content").withColumn("x", F.lit(1))):
        (x,) = chat.canonical_rows(renamed).collect()
        assert x["layout"] == "turns" and [t["role"] for t in x["turns"]] == ["user", "assistant"]
    assert chat.canonical_rows(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_rows(rows.drop("turn"))


def test_chat_plan_has_no_python(spark):
    from citeplane.llm.chat import op3_chat

    assert "Python" not in op3_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


# 4


def test_restores_obfuscated_words():
    text = "that idiot is worthless and the clown was a stupid loser of trash " * 200 + "other words stand here for the model to count "
    codes = np.bincount(toxicity.trigrams(text), minlength=1 << 18)
    restorer = toxicity.Restorer(toxicity.log_model(np.flatnonzero(codes).tolist(), codes[codes > 0].tolist()))
    for token, word in {"1d10t": "idiot", "tr4sh": "trash", "w0rthle$$": "worthless", "stuuuupid": "stupid", "c.l.o.w.n": "clown", "l*ser": "loser", "IDIOT!!": "idiot"}.items():
        assert word in restorer.words(token), (token, restorer.words(token))
    assert "idiot" in toxicity.tokens_of("an i d i o t here") and restorer.words("plain") == {"plain"}


def test_viterbi_finds_the_best_of_all_paths():
    codes = np.bincount(toxicity.trigrams("see the seat eats tea at a set " * 9), minlength=1 << 18)
    restorer = toxicity.Restorer(toxicity.log_model(np.flatnonzero(codes).tolist(), codes[codes > 0].tolist()))
    for token in ("s3at", "7e4", "$eee7", "4t@"):
        best = {}
        for path in itertools.product(*restorer._edges(token)):
            s, x, y = 0.0, 0, 0
            for text, cost in path:
                s -= cost
                for c in text:
                    k = 0 if c == " " else toxicity._OF.get(c, 63)
                    s += restorer.model[x][y][k]
                    x, y = (y, k) if k else (0, 0)
            s += restorer.model[x][y][0] if (x, y) != (0, 0) else 0
            out = "".join(t for t, _ in path)
            best[out] = max(best.get(out, -1e9), s)
        assert best[restorer.viterbi(token)] == pytest.approx(max(best.values()))


def test_toxicity_held_out_accuracy(spark):
    found = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x["toxic"], x["predicted"]): x["count"] for x in found}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.98


# 5


def brute_measures(t):
    t = t or ""
    w = SPACE.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {q for i, g in enumerate(grams) if grams.count(g) > 1 for q in range(i, i + 5)}
    seen = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in seen[:i] for i, x in enumerate(seen)), len(hit), len(seen)


def test_quality_measures():
    texts = [x[1] for x in rows() if len(x[1] or "") < 5000] + ["a b c d e a b c d e", "x" * 9 + "\x1c y\x0bz", "#1 <b>\n#1 <b>\n\n", "r " * 30]
    for t in texts:
        assert quality.measures_of(t or "") == brute_measures(t)


def test_quality_quantiles_are_near(spark):
    r = random.Random(1)
    values = [int(r.lognormvariate(6, 2)) for _ in range(5000)]
    df = spark.createDataFrame([("en", "s", v, 1, 1, 0, 0, 0) for v in values], "lang string, source string, n_symbols long, n_words long, n_lines long, n_dup_lines long, n_repeat_words long, word_chars long")
    got = {x["rate"]: x for x in quality.quantiles(quality.sketches(df, ["lang", "source"]), ["lang", "source"], (50, 90)).collect()}["symbols"]
    for q in (50, 90):
        true = 1000 * sorted(values)[5000 * q // 100 - 1]
        assert true * 0.984 <= got[f"q{q}"] <= true


def test_fences_follow_the_source_within_those_of_its_language(spark):
    """Short words are usual in one source; one full of junk doesn't lift its fence; the few documents of a small one are judged by the language."""
    r = random.Random(2)
    text = lambda n, symbols=0: " ".join("".join(r.choice("abcdefgh") for _ in range(n + r.randrange(2))) for _ in range(60)) + " #" * symbols
    data = [(i, text(5), "en", "plain") for i in range(400)] + [(1000 + i, text(8), "en", "long") for i in range(150)]
    data += [(2000 + i, text(5, 30 * (i % 2)), "en", "junk") for i in range(200)] + [(3000, text(5), "en", "few"), (3001, text(25), "en", "few"), (3002, text(5), None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = {x["doc_id"]: x["kept"] for x in quality.judged(df, ["doc_id"]).collect()}
    assert all(kept[i] for i in range(400)) and all(kept[1000 + i] for i in range(150))
    assert all(kept[2000 + i] == (i % 2 == 0) for i in range(200)) and kept[3000] and not kept[3001] and kept[3002]


# 6


def brute_lines(data, run):
    key = lambda d: (d[0] is not None, d[0] or 0)
    first, place, out = {}, {}, {}
    docs = sorted({(d, t or "") for d, t in data}, key=lambda x: (key(x), 0))
    for d, t in docs:
        l = [x.strip() for x in t.split("\n") if x.strip()]
        for p in range(len(l) - run + 1):
            first.setdefault(tuple(l[p : p + run]), (d, t, p))
    for d, t in docs:
        l = [x.strip() for x in t.split("\n") if x.strip()]
        gone = {q for p in range(len(l) - run + 1) if first[tuple(l[p : p + run])] != (d, t, p) for q in range(p, p + run)}
        out[d, t] = len(l), len(gone), [x for i, x in enumerate(l) if i not in gone]
    return out


@pytest.mark.parametrize("run", [3, 1, 2])
def test_line_dedup_equals_brute_force(spark, docs, run):
    r = random.Random(run)
    more = [(100 + i, "\n".join(r.choice(["aa", "bb", "cc", "dd", " aa ", ""]) for _ in range(r.randrange(14)))) for i in range(60)]
    df = docs.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    data = [(x["doc_id"], x["text"]) for x in df.collect()]
    want = brute_lines(data, run)
    joined = lines.dedup_lines(df, run=run, long=None).collect()
    assert len(joined) == len(data)
    by = defaultdict(list)
    for (d, _), v in want.items():
        by[d].append(v)
    for x in joined:
        left = [y.strip() for y in (x["text"] or "").split("\n") if y.strip()]
        assert (x["n_lines"], x["n_deleted"], left) in by[x["doc_id"]]


def test_pipeline_drops_long_runs_of_one_or_two_lines(spark):
    import corpus_pipeline

    r = random.Random(5)
    line = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(n))
    pool = [line(n) for n in (50, 49, 30, 30, 20, 19, 60, 5, 5, 5)]
    data = [(1, pool[0]), (2, pool[0]), (3, pool[1]), (4, pool[1]), (5, f"{pool[2]}\n\n {pool[4]}"), (6, f"x\n{pool[2]} \n{pool[4]}\ny"), (7, f"{pool[3]}\n{pool[5]}"), (8, f"{pool[3]}\n{pool[5]}"), (9, None), (10, "")]
    data += [(20 + i, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for i in range(60)]
    words, first, want = (lambda run: sum(len(x.split()) for x in run)), {}, {}
    split = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in data}
    windows = [(d, p, n, tuple(l[p : p + n])) for d, l in split.items() for n in (1, 2, 3) for p in range(len(l) - n + 1)]
    windows = [w for w in windows if w[2] == 3 or words(w[3]) >= 50]
    for d, p, _, w in windows:
        first[w] = min(first.get(w, (d, p)), (d, p))
    for d, l in split.items():
        gone = {q for e, p, n, w in windows if e == d and first[w] != (d, p) for q in range(p, p + n)}
        want[d] = [x for i, x in enumerate(l) if i not in gone]
    assert want[2] == [] and want[4] == [pool[1]] and want[6] == ["x", "y"] and want[8] == [pool[3], pool[5]]
    got = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), "").collect()
    assert {x["doc_id"]: [y.strip() for y in (x["text"] or "").split("\n") if y.strip()] for x in got} == want


def test_untouched_text_keeps_every_character():
    assert lines.without("a\n\n b \n", []) == ("a\n\n b \n", 2, 0)
    assert lines.without("a\n\nb\n\nc\n\nd", [(1, 3)])[0] == "a\n\n\nd"


# 7


def brute_count(word, scores):
    path = unigram.START + word
    best = [(0.0, 0)] + [None] * len(path)
    for end in range(1, len(path) + 1):
        size = len(path[end - 1].encode())
        options = [(best[end - 1][0] + size * unigram.BYTE_LOG_P, best[end - 1][1] + size)]
        options += [(best[at][0] + scores[path[at:end]], best[at][1] + 1) for at in range(max(0, end - 16), end) if path[at:end] in scores]
        best[end] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


def test_unigram_counts_equal_plain_dynamic_programming(docs):
    scores = unigram.zipf(unigram.pieces_of())
    words = {w for x in rows() for w in SPACE.findall(x[1] or "")} | {"日本語x", "a" * 400, "\u200b"}
    assert unigram.PieceTrie(scores).counts(words) == {w: brute_count(w, scores) for w in words}
    for x in unigram.token_counts(docs.where("n_chars > 9"), ["doc_id", "text"]).collect():
        w = SPACE.findall(x["text"] or "")
        assert (x["n_words"], x["n_tokens"]) == (len(w), sum(brute_count(v, scores) for v in w))


# 8


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    r = random.Random(2)
    odd = ["".join(r.choice("aàÀÉİΣσßﬁǅ1²Ⅻ一ぁ ̧'!?$\n\t\x1c\x85\u3000😀sStT") for _ in range(30)) for _ in range(300)] + ["x<|endoftext|>y <|startoftext|>", "it's we'LL", "q" * 3000]
    df = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    found = bpe.encode(df, ["text"], outputs=("token_ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    back = {x["text"]: x["decoded"] for x in bpe.decode(found.drop("decoded"), ["text"]).collect()}
    for x in found.collect():
        want = library.encode(x["text"] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert x["token_ids"] == want and x["n_tokens"] == len(want)
        assert x["decoded"] == text == back[x["text"]]
        assert x["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pair_tree_root_is_the_leftmost_least():
    r = random.Random(4)
    keys = [r.randrange(9) << 32 | i for i in range(37)]
    tree = bpe.PairTree(list(keys))
    for _ in range(200):
        i = r.randrange(37)
        keys[i] = r.choice([bpe._NONE, r.randrange(9) << 32 | i])
        tree.put(i, keys[i])
        assert tree.root() == min(keys)


# 9


def brute_print(text):
    import xxhash

    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    prints, root = sorted(prints), {}
    for p in prints:
        root[p] = p

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_simhash_equals_brute_force(docs):
    found = simhash.near_duplicates(docs, ["doc_id", "text"]).collect()
    prints = {x["text"]: brute_print(x["text"]) for x in found}
    assert all(x["fp"] == simhash._signed(prints[x["text"]]) for x in found)
    root = brute_components(set(prints.values()))
    least = {}
    for x in found:
        if x["doc_id"] is not None:
            k = root[prints[x["text"]]]
            least[k] = min(least.get(k, x["doc_id"]), x["doc_id"])
    assert all(x["component_id"] == least[root[prints[x["text"]]]] for x in found)
    kept = simhash.keep_one(docs).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(least.values())


def test_one_of_each_group_stays_without_an_id_or_with_a_shared_one(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in ("one", "two", "three"))
    data = [(None, one, "a"), (None, one, "a"), (None, two, None), (None, two, "b"), (7, one.upper(), "a"), (8, two[::-1], "a"), (8, three, "a"), (8, three, "a"), (None, "x y z", "a"), (None, "v w", "a")]
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)).collect()
    want = [(7, one.upper()), (8, three), (8, two[::-1]), (None, two), (None, "v w"), (None, "x y z")]
    assert sorted((str(x["doc_id"]), x["text"]) for x in kept) == sorted((str(d), t) for d, t in want)


@pytest.mark.parametrize("small", [4, 40, 10_000])
def test_links_connect_all_within_the_radius(spark, small):
    r = random.Random(small)
    base = [r.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << r.randrange(60) for _ in range(r.randrange(8))) & (2**64 - 1) for b in base for _ in range(250)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = [(x["a"] & (2**64 - 1), x["b"] & (2**64 - 1)) for x in simhash.links(df, small=small).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == brute_components(prints)


def test_covering_masks_miss_no_pair():
    for free in ((1 << 64) - 1, 0xF0F0_0FFF, 0b111):
        bits = [i for i in range(64) if free >> i & 1]
        masks = simhash.covering_masks(free)
        for c in itertools.combinations(bits, 3):
            assert any(not m & sum(1 << i for i in c) for m in masks)


# 10


def test_url_parts_and_rules(spark):
    data = ["http://WWW.Example.com/en/x?y#z", "https://a.example.com/en/", "https://www.example.com/en/../", "http://example.com/EN/", "ftp://x.net/es/1", "x.net/es/1", None, "http://net/fr/", "http://a.b", "a://b://c/d", "http://xnet/es/", "http://É.COM/", "http://u:p@x.com:80/a", "http://example.com/en"]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {x["page_id"]: x for x in urls.judge(df, labels).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(data))] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("www.example.com", "/en/../", "www.example.com/en/", "allow"),
        ("example.com", "/EN/", "com/", "allow"), ("x.net", "/es/1", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/fr/", "net/fr/", "block"), ("a.b", "", None, "allow"),
        ("b:", "//c/d", None, "allow"), ("xnet", "/es/", None, "allow"), ("É.com", "/", "com/", "allow"), ("u:p@x.com:80", "/a", None, "allow"), ("example.com", "/en", "com/", "allow"),
    ]


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    pages = [(i, f"http://spam.bad.org/{i}") for i in range(60)] + [(100 + i, f"http://h{i % 20}.good.org/{i}") for i in range(400)] + [(900, "http://h3.good.org/new"), (901, "http://new.bad.org/")]
    labels = [(i, 0) for i in range(60)] + [(100 + i, 0 if i == 3 else 1) for i in range(400)] + [(None, 0), (900, None)]
    got = {x["page_id"]: x["verdict"] for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got[0] == "block" and got[100] == "allow" and got[900] == "allow" and len(got) == len(pages)


# all

LABELS = [(0, 1, 0), (1, 1, 0), (22, 0, 1), (22, 0, 1), (None, 1, 1), (2, None, None), (4, 1, 0)]


def operators(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(f"shared{i}" for i in range(60))), (2, None)], "item_id long, text string")
    return {
        "suffixes": suffixes.repeated_passages,
        "decontaminate": lambda d: decontaminate.matches(common.pick(d, ["doc_id", "text"]), bench),
        "decontaminated": lambda d: common.pick(decontaminate.decontaminate(d, bench), ["doc_id", "text"]),
        "toxicity": lambda d: toxicity.score(d, labels),
        "without_toxic": lambda d: common.pick(toxicity.without_toxic(d, labels), ["doc_id", "text"]),
        "quality": lambda d: quality.judged(d, ["doc_id"]),
        "lines": lambda d: common.pick(lines.dedup_lines(d), ["doc_id", "text", "n_deleted"]),
        "unigram": lambda d: unigram.token_counts(d, ["doc_id"]),
        "bpe": lambda d: bpe.encode(d, ["doc_id"]),
        "simhash": lambda d: simhash.near_duplicates(d, ["doc_id"]),
        "keep_one": lambda d: common.pick(simhash.keep_one(d), ["doc_id", "text"]),
    }


@pytest.mark.parametrize("name", ["suffixes", "decontaminate", "decontaminated", "toxicity", "without_toxic", "quality", "lines", "unigram", "bpe", "simhash", "keep_one"])
def test_extra_columns_and_empty_tables(spark, docs, clashing, empty, name):
    op = operators(spark)[name]
    assert plain(op(clashing)) == plain(op(docs))
    assert op(empty).count() == 0


def test_words_of_unicode_are_composed():
    assert unicodedata.normalize("NFC", "e\u0301") == "é" and Counter(decontaminate.words_of("É-é a_b"))[b"b"] == 1
