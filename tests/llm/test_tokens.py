"""Encoding and decoding, chat formatting, decontamination."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tillsight.llm import chat, decontaminate, encode, pieces

TEXTS = ["", " ", "  two  blanks ", "the cat sat", "▁ literal ▁▁", "日本語 tést\n\n\tñ  ", "x" * 700,
         "a\u0000b￿￾", "😀😀 é", "don't — stop… 1,234.5", "Ünïcödé " * 40]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return encode.Encoder(vocabulary)


def split_ids(encoder, texts):
    ids, n = encoder.texts(texts)
    out, at = [], 0
    for k in n:
        out.append(ids[at:at + k])
        at += k
    return out


def test_round_trip(encoder, small):
    texts = TEXTS + [r.text for r in small.limit(60).collect()]
    ids, n = encoder.texts(texts)
    assert [t.decode() for t in encoder.decode(ids, n)] == texts


def test_long_words_one_by_one_or_together(encoder, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a, n in (
        ("abcdefghijklmnop", 3000), ("etaoin", 3000), ("ab日本語é", 700), ("x", 1500), ("日本", 300), ("▁a", 400))]
    want, sizes = encoder.texts(texts)
    monkeypatch.setattr(encode, "LONG_WORD", 10 ** 9)
    got, numbers = encoder.texts(texts)
    assert (want == got).all() and (sizes == numbers).all()
    assert [t.decode() for t in encoder.decode(want, sizes)] == texts


def test_scores_equal_the_best_of_all_segmentations(encoder, vocabulary):
    """Against a plain search over every segmentation of short words."""
    score = dict(zip(vocabulary["pieces"], vocabulary["scores"]))
    by_id = dict(zip(vocabulary["ids"], vocabulary["scores"]))

    def best(word):
        top = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                s = score.get(word[start:end])
                if s is None and end - start == 1:
                    s = encoder.unknown
                if s is not None:
                    top[end] = max(top[end], top[start] + s)
        return top[-1]

    for w in ["the", "retitioning", "Überraschung", "qqzzx", "naïve"]:
        ids = split_ids(encoder, [w])[0]
        assert sum(by_id[int(i)] for i in ids) == pytest.approx(best(pieces.SPACE + w))


def test_same_total_as_the_library(encoder, vocabulary, small):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # unigram: the library's own Viterbi search
    for i, s in zip(vocabulary["ids"], vocabulary["scores"]):
        model.pieces[i].score = s
    library = sentencepiece.SentencePieceProcessor()
    library.LoadFromSerializedProto(model.SerializeToString())
    texts = [r.text for r in small.limit(40).collect()]
    by_id = dict(zip(vocabulary["ids"], vocabulary["scores"]))
    total = lambda ids: sum(by_id.get(int(i), 0.0) for i in ids)
    same = 0
    for t, own in zip(texts, split_ids(encoder, texts)):
        theirs = library.encode(t)
        assert len(own) == len(theirs)
        assert total(own) == pytest.approx(total(theirs), rel=1e-5)
        same += own.tolist() == theirs
    assert same > 0.8 * len(texts)  # the rest differ in ties only


def test_encoding_odd_rows(odd, empty):
    rows = encode.encoding_report(odd).collect()
    assert len(rows) == odd.count() and all(r.restored for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 0
    assert encode.encoding_report(empty).collect() == []
    clash = odd.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    assert encode.decode(encode.encode(clash)).dtypes[-2:] == [("ids", "array<int>"),
                                                               ("decoded", "string")]


# chat

def brute_chat(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


CHAT = [(1, 1, "assistant", "hi </s> there"), (1, 0, "user", "<s>[INST]"), (1, 2, "tool", None),
        (2, 0, "assistant", "<\\s> <\\\\/s> [\\/INST] ["), (2, 1, "assistant", "s></s"),
        (2, 1, "assistant", "s></s"), (3, 0, None, "no role"), (None, 0, "user", "lost"),
        (4, None, "assistant", ""), (4, 0, "[/INST]", "role </s>"), (5, 0, "user", "é😀" * 40_000),
        (5, 1, "assistant", "[INST" * 30_000)]


def test_chat_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHAT],
                               "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.conversation_report(df).collect()}
    want = brute_chat(CHAT)
    assert set(got) == set(want)
    for conv, w in want.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == w
    assert chat.conversation_report(df.limit(0)).collect() == []


def test_escape_is_exact_and_leaves_no_control():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices(["<", "s", ">", "/", "\\", "[", "]", "INST", "x"], k=9))
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROLS)


# decontamination

def brute_hits(text, items, window):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = norm(text), set(), set()
    for item, t in items:
        v = norm(t)
        for i in range(max(1, len(v) - window + 1) if v else 0):
            g = v[i:i + window]
            for j in range(len(w) - len(g) + 1):
                if w[j:j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [32 << 20, 60])
def test_hits_against_brute_force(spark, odd, block_bytes):
    items = [(1, "The quick BROWN fox; jumps over the lazy dog again and again"), (2, "tiny item"),
             (3, None), (4, "... !!"), (2, "tiny item"), (None, "élan vital 99"), (10, "tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["a the quick brown fox jumps over the lazy dog again and again z", "TINY—item tiny, item",
             "the quick brown fox jumps over the lazy dog", "Élan élan vital 99!", None, "", "é" * 999]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, items string")
    rows = decontaminate.find_contamination(docs, bench, block_bytes=block_bytes).collect()
    for r in rows:
        n, hit, found = brute_hits(r.text, items, 10)
        assert (r.n_words, sorted(r.hit_words), sorted(r["items"])) == (n, hit, found)
        for a, b in ((s["start"], s["end"]) for s in r.spans):
            assert decontaminate.words_of(r.text[a:b].encode())
    got = {r.doc_id: [r.text[s["start"]:s["end"]] for s in r.spans] for r in rows}
    assert got[0] == ["the quick brown fox jumps over the lazy dog again and again"]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]
    assert kept.columns == docs.columns
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.contamination_report(docs.limit(0), bench).collect() == []
    assert decontaminate.contamination_report(odd, bench).count() == odd.count()
