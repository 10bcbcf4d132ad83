"""Quality rules, exact dedup, secrets and language identification against plain versions."""

import random
import re

import pytest

from batchtrace.llm import exact, langid, quality, secret_scan
from batchtrace.llm.queries import QUERIES, op10_language_id

from .brute import ascii_lower, base, histograms, js, language, sha

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int, `a.b` int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1, 2) for i, t, lang in rows], SCHEMA)


EDGE = [
    (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, "Ünïcode ÀÉ words", None), (None, "the same text", "en"),
    (5, "The Same Text", "en"), (6, "the same text", "xx"), (6, "the same text", "xx"), (7, "a b c d e f a b c d e f a b c d e f", "en"),
    (8, "line one\nline one\n\nline two\nline one\n", "de"), (9, "w" * 50_000, "fr"), (10, " ".join(f"word{i % 997}" for i in range(60_000)), "en"),
    (11, "token=secret=abcdefgh api_KEY: 'abc' PassWord = zzzzzz", "en"), (12, "x AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 2, None),
    (13, "token=token : abcdefgh token==abcdefg Key", "en"), (None, "secret: hunter2hunter2", None),
]


def test_quality_base_counts_and_distances(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert len(got) == len(docs)
    hist = {r.doc_id: histograms(r.text, quality.CLASSES, quality.WORD_LIST) for r in docs}
    good = [r for r in docs if not base(r.text)[-1]]
    for r in docs:
        own = [x for x in good if x.lang == r.lang] if r.lang in quality.COMMON else good
        ref = [[sum(v) for v in zip(*(hist[x.doc_id][k] for x in own), strict=True)] for k in (0, 1)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base(r.text)
        a, b = (js(hist[r.doc_id][k], ref[k]) for k in (0, 1))
        assert (g.char_js, g.word_js) == pytest.approx((a, b), abs=2e-6)
        far = (len(r.text) >= quality.MIN_CHARS and a > quality.MAX_CHAR_JS) or (
            len(words_of(r.text)) >= quality.MIN_WORDS and b > quality.MAX_WORD_JS + quality.WORD_NOISE / len(words_of(r.text)) ** 0.5)
        assert g.kept == (not g.base_failed and not far)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def test_quality_keeps_good_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    bad = got.where("quality = 1 and not base_failed and not kept").count()
    assert bad == 0
    assert got.where("quality = 0 and not kept").count() > 0.6 * got.where("quality = 0").count()


def test_quality_edge_cases(spark):
    out = quality.quality_rules(rows_of(spark, EDGE))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.columns.count("kept") == 1
    rows = out.collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
    assert quality.quality_rules(rows_of(spark, [])).count() == 0


def test_exact_dedup_edge_cases(spark):
    for bits in (None, 64):  # a full filter only shuffles more rows
        out = exact.exact_dedup(rows_of(spark, EDGE), bits=bits)
        rows = out.collect()
        assert len(rows) == len(EDGE) and out.columns.count("kept") == 1 and "a.b" in out.columns
        by = {}
        for r in rows:
            by.setdefault(ascii_lower(r.text), []).append(r)
            assert r.text_sha256 == sha(ascii_lower(r.text))
        for group in by.values():
            ids = [r.doc_id for r in group if r.doc_id is not None]
            assert {r.keep_id for r in group} == {max(ids, default=None)} and {r.group_size for r in group} == {len(group)}
            kept = [r for r in group if r.kept]
            assert len(kept) == 1 and kept[0].doc_id == max(ids, default=None)
    assert exact.exact_dedup(rows_of(spark, [])).count() == 0


def plain_spans(text, rules):
    out = []
    for o, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= max(1, rule.min_length):
                out.append((m.start(), o, rule.kind, m.end()))
    return sorted(out)


def check_spans(docs, rows):
    texts = {}
    for i, t in docs:
        texts.setdefault((i, t), []).append(t)
    rules = (*secret_scan.BASE, *secret_scan.MORE)
    for r, (_, t) in zip(rows, docs, strict=True):
        line = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        base_ = plain_spans(t, rules[:3])
        assert r.spans == line(plain_spans(t, rules)) and r.base_sha256 == sha(line(base_))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base_) for k in range(3)]


def test_secrets_match_plain_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    check_spans(docs, QUERIES["op7_secrets"](spark, SF).orderBy("doc_id").collect())


def test_secrets_edge_cases(spark):
    rng = random.Random(1)
    bits = ["token", "=", " ", ":", "'", "passwd", "api_key", "APIKEY", "abcdef", "ghp_" + "a" * 36, "xoxb-1234567890", "ff" * 12,
            "-----BEGIN RSA PRIVATE KEY-----", "AKIA" + "B" * 16, "é", "\n", "eyJ" + "a" * 10 + ".bbbbbbbbbbb.cccccccccc", "secret"]
    docs = [(i, t) for i, t, _ in EDGE] + [(100 + k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for k in range(150)]
    frame = rows_of(spark, [(i, t, None) for i, t in docs])
    rows = {(r.doc_id, r.text): r for r in secret_scan.scan_secrets(frame).collect()}
    assert secret_scan.scan_secrets(frame).count() == len(docs)
    check_spans(docs, [rows[d] for d in docs])
    assert secret_scan.scan_secrets(rows_of(spark, [])).count() == 0


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in (*secret_scan.BASE, *secret_scan.MORE)}
    assert q["hex"] == [] and q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and len(q["assign"]) == 6


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and 0.2 < len(held) / len(got) < 0.3
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    train = rows_of(spark, [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "x", None)])
    model = langid.train(train)
    assert model.langs == ["de", "en"]
    out = {r.text: (r.lang_pred, r.score) for r in langid.identify(rows_of(spark, EDGE), model).collect()}
    assert out[None] == out[""] == out["   \n\t "] == ("und", 0.0)
    assert out["the same text"][0] == "en"
    pred = {t: model.score(t)[0] for t in ("12 34 !!", "hundes", "the", "Katzen")}
    assert pred == {"12 34 !!": "und", "hundes": "de", "the": "en", "Katzen": "de"}
    none = langid.train(rows_of(spark, []))
    assert none.score("the") == ("und", 0.0) and langid.identify(rows_of(spark, []), none).count() == 0


def test_language_backoff_takes_longest_known():
    m = langid.Model(["a", "b"], [0.0, 0.0], {"known": (-1.0, -9.0)}, {" abc ": (-5.0, -1.0), "abc": (-1.0, -5.0), "z": (-2.0, -1.0)})
    assert m.vector("known") == (-1.0, -9.0) and m.vector("abc") == (-5.0, -1.0)  # " abc " is a 5-gram
    assert m.vector("xabcx") == (-1.0, -5.0) and m.vector("qz") == (-2.0, -1.0) and m.vector("qq") is None


@pytest.mark.parametrize("max_words,max_grams", [(60_000, 60_000), (400, 800)])
def test_language_matches_plain_version(spark, max_words, max_grams):
    import zlib
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    out = zlib.crc32
    learn = [(r.text, r.lang) for r in docs if out(str(r.doc_id).encode()) % 4 != 2]
    texts = [r.text for r in docs] + ["", None, "12 !", "the zzxq", "x", "WORDS ünd mehr Wörter"]
    want = language(learn, texts, max_words, max_grams)
    model = langid.train(spark.createDataFrame(learn, "text string, lang string"), max_words=max_words, max_grams=max_grams)
    got = langid.identify(spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)],
                                                "doc_id long, text string, lang_pred string, score int"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert [r.score for r in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    assert list(got[0].asDict()) == ["doc_id", "text", "lang_pred", "score"]


def test_language_keeps_rare_languages_and_bounds_copies(spark):
    """A text held by most rows does not fill the sample, and a rare language keeps its keys."""
    hot = "the same old story told again"
    rows = [(hot, "en")] * 3000 + [(f"english words number {i} about things", "en") for i in range(300)] + [
        (f"svenska orden nummer {i} om saker", "sv") for i in range(5)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4), max_train=100, max_words=40, max_grams=200)
    assert model.langs == ["en", "sv"]
    assert {"svenska", "orden", "nummer", "om", "saker"} <= set(model.words) and len(model.words) <= 40 and len(model.grams) <= 200
    assert model.score("svenska orden nummer 77 om saker")[0] == "sv" and model.score("about english things")[0] == "en"
    assert model.prior[1] == pytest.approx(__import__("math").log(5 / 3305))


def test_language_ties_go_to_the_first(spark):
    model = langid.train(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    assert model.score("same words") == ("a", 0.5)
