from __future__ import annotations

import math
import random
import zlib

from pyspark.sql import functions as F

from driftwell.llm import langid
from driftwell.llm.common import table
from driftwell.llm.langid import Parser, fit, predict, suffix_automaton
from driftwell.llm.q_langid import op10_language_id

SCHEMA = "doc_id long, text string, lang string, source string, score string, lang_pred long"


def slow_phrases(reference, text):
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in reference:
            n += 1
        at += max(n, 1)
        count += 1
    return count


def test_automaton_spells_substrings_only():
    text = b"abracadabra abba"
    moves = suffix_automaton(text)

    def accepts(s):
        state = 0
        for b in s:
            if b not in moves[state]:
                return False
            state = moves[state][b]
        return True

    for i in range(len(text)):
        for j in range(i, len(text) + 1):
            assert accepts(text[i:j])
    assert not accepts(b"abc") and not accepts(b"bb ")


def test_phrases_of_whole_texts_as_by_substring_search():
    rnd = random.Random(4)
    references = {x: bytes(rnd.choice(b"abcd ") for _ in range(300)) for x in ("p", "q")} | {"r": b"a", "s": b"abcd" * 90}
    texts = [bytes(rnd.choice(b"abcde ") for _ in range(n)) for n in (0, 1, 5, 40, 99, 100, 700)] + [b"abcd" * 80, b"e" * 130, references["p"] * 2]
    slow = [[slow_phrases(references[x], t) for x in "pqrs"] for t in texts]
    parser = Parser(references)
    assert parser.phrases(texts).tolist() == slow
    for window, prefix in ((40, 7), (40, 1), (3, 1), (64, 64)):
        assert parser.phrases(texts, window, prefix).tolist() == slow


def test_sixty_languages_are_small():
    rnd = random.Random(2)
    alphabets = [bytes(range(32 + 3 * i, 72 + 3 * i)) for i in range(60)]
    references = {f"l{i:02d}": b" ".join(bytes(rnd.choices(a, k=rnd.randint(2, 9))) for _ in range(700)) for i, a in enumerate(alphabets)}
    parser = Parser(references)
    size = sum(map(len, references.values()))
    assert parser.nbytes < 60 * size and parser.nbytes / size * 60 * langid.REFERENCE < 500 << 20
    some = {x: references[x] for x in ("l03", "l41")}
    text = references["l03"][500:900] + references["l41"][:300]
    whole = parser.phrases([text])[0]
    assert [whole[3], whole[41]] == [slow_phrases(r, text) for r in some.values()]


def test_marks_belong_to_words():
    assert langid.normalise("हिन्दी भाषा, 12 ไทยนี้!") == "हिन्दी भाषा ไทยนี้".encode()
    assert langid.normalise(" It's 5\n\tOK ") == b"it s ok" and langid.normalise("ÉTÉ--été") == "été été".encode()


def test_answers_as_by_a_slow_cross_parser(spark):
    """The query itself, on documents of its own, against substring search over whole texts."""
    rnd = random.Random(7)
    words = {"x": ["tarim", "solek", "banu", "ir", "mo"], "y": ["quess", "lorin", "ax", "ubet"], "z": ["ñandú", "été", "ço", "ir"]}
    rows = [(i, " ".join(rnd.choices(words[x], k=rnd.choice((1, 5, 60, 150)))), x) for i in range(120) for x in [rnd.choice("xyz")]]
    rows += [(500, None, "x"), (501, "12 -- ", "y"), (502, "ax " * 400 + "tarim", None), (503, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    references = fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    taught = [r for r in rows if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for x, reference in references.items():
        assert len(reference) <= langid.REFERENCE and all(w in {v for r in taught if r[2] == x for v in r[1].split()} for w in reference.decode().split())
    longest = max(map(len, references.values()))
    got = {r.doc_id: r for r in predict(docs, references).collect()}
    for i, text, _ in rows:
        plain = langid.normalise(text or "")
        if not plain:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cost = {x: slow_phrases(r, plain) * math.log2(longest + 1) + 8 * sum(b not in r for b in plain) for x, r in references.items()}
        best = sorted(cost.values())
        assert cost[got[i].lang_pred] == best[0] and abs(got[i].score - best[1] / (best[0] + best[1])) < 1e-9


def test_whole_texts_teach_within_the_bound(spark):
    rows = [(i, "x" * 40 + f" {'ab'[i % 2]}" * 30, "p") for i in range(40)] + [(100 + i, "y" * 3000, "q") for i in range(5)] + [(200, "z" * 2000, "q")] + [(300, "w", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = fit(docs, reference=1000, languages=2)
    assert set(got) == {"p", "q"}  # those with the most documents
    assert 800 <= len(got["p"]) <= 1000 and got["p"].startswith(b"x" * 40) and got["p"].endswith((b"a", b"b"))
    assert got["q"] == b"z" * 2000  # none fits: the shortest, whole


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    got = op10_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, "le la les des une " * 9, "fr", "s", "clash", 5) for i in range(8)] + [(9, "der die das und ein " * 9, "de", "s", None, None)]
    parser = fit(spark.createDataFrame(rows, SCHEMA).filter("doc_id = 9"))
    assert list(parser) == ["de"]


def test_odd_rows(spark):
    rows = [(1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "", "de"), (5, "123 %%% --", None), (6, "THE AND OF " * 50_000, None), (None, "und der", None), (7, "日本語", None), (7, "日本語", None)]
    docs = spark.createDataFrame([(d, t, x, "s", "clash", 1) for d, t, x in rows], SCHEMA)
    got = {(r.doc_id, r.lang_pred) for r in predict(docs, fit(docs)).collect()}
    assert got == {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de"), (7, "en")}
    assert predict(docs, fit(docs.filter("lang = 'en'"))).filter("doc_id = 1").first().score == 1.0
    empty = docs.filter("doc_id > 99")
    assert predict(empty, fit(empty)).count() == 0
    assert {r.lang_pred for r in predict(docs, fit(empty)).collect()} == {"und"}


def test_a_language_with_hardly_any_text_takes_over_no_other(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    usual = {r.doc_id: r.lang_pred for r in predict(docs, fit(docs)).collect()}
    for tiny in ("a", "ok", "hi"):
        more = docs.unionByName(spark.createDataFrame([(-1, tiny, "aa")], docs.schema))
        got = {r.doc_id: r.lang_pred for r in predict(docs, fit(more)).collect()}
        assert sum(got[i] == usual[i] for i in usual) >= 0.98 * len(usual)
    foreign = docs.limit(1).withColumn("text", F.lit("привет мир"))
    assert predict(foreign, fit(docs.unionByName(spark.createDataFrame([(-1, "a", "aa")], docs.schema)))).first().score < 0.505
