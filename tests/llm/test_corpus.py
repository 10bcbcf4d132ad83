"""SimHash, spans, packing, mixing, rollup, chat and the pipeline against plain versions."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from batchtrace.llm import chat, exact, mix, pack, quality, rollup, simhash, spans
from batchtrace.llm.queries import QUERIES, TARGETS, labelled_domains
from batchtrace.llm.shared import scratch

from .brute import dedup_spans, fingerprint, groups, sha
from .test_filters import EDGE, SF, rows_of


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def test_simhash_query_matches_brute_force(spark):
    docs = documents(spark)
    fps = [fingerprint(r.text) for r in docs]
    want = [(r.doc_id, f"{f:016x}", docs[g].doc_id) for r, f, g in zip(docs, fps, groups(fps, 4), strict=True)]
    got = QUERIES["op6_simhash"](spark, SF).orderBy("doc_id").collect()
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == want


@pytest.mark.parametrize("max_bits,max_leaf", [(4, 2048), (4, 20), (3, 2048), (6, 50)])
def test_near_links_find_every_component(spark, max_bits, max_leaf):
    rng = random.Random(max_bits)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:  # chains and stars around some, and a dense group around one
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, max_bits + 2))))
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)]
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits, max_leaf)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    got, want = {}, {}
    for f, g in zip(signed, groups(fps, max_bits), strict=True):
        got.setdefault(roots.get(f, f), set()).add(f)
        want.setdefault(g, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_edge_cases(spark):
    rows = simhash.simhash_groups(rows_of(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and all(r.fingerprint == f"{fingerprint(r.text):016x}" for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.component_id, r.fingerprint if r.component_id is None else ""), []).append(r)
    for (c, _), group in by.items():
        assert sum(r.kept for r in group) == 1
        assert c is None or min(r.doc_id for r in group if r.doc_id is not None) == c
    assert simhash.simhash_groups(rows_of(spark, [])).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.root) for r in simhash.components(links).collect()} == {0}


def test_spans_match_plain_version(spark):
    docs = {r.doc_id: r.text for r in documents(spark)}
    got = {r.doc_id: r.text for r in QUERIES["op4_sentence_spans"](spark, SF).collect()}
    assert got == dedup_spans(docs, spans.RUN, spans.MIN_WORDS, spans.WINDOW)
    assert sum(got[i] != docs[i] for i in docs) > 0


def test_spans_edge_cases(spark):
    passage = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen. Sixteen seventeen eighteen."
    rows = [*EDGE, (20, "Start here. " + passage + " End.", None), (21, passage, None), (22, "Other words.\n" + passage + "\nTail of it.", None),
            (23, passage + " " + passage, None), (24, passage, None), (24, passage, None)]
    frame = rows_of(spark, rows)
    out = spans.dedup_spans(frame, run=2, min_words=10)
    got = out.collect()
    assert len(got) == len(rows) and out.columns.count("text") == 1
    text = {r.doc_id: r.text for r in got}
    assert text[20] == rows[len(EDGE)][1] and text[1] is None and text[2] == ""
    assert text[21] == "" and text[22] == "Other words.\nTail of it." and text[23] == ""
    own = spans.dedup_spans(rows_of(spark, [(1, passage + " " + passage + " Last one.", None)]), run=2, min_words=10).first()
    assert own.text == passage + " Last one." and own.n_removed == 3
    same = spans.dedup_spans(rows_of(spark, [(1, passage, None), (1, passage, None)]), run=2, min_words=10).collect()
    assert sorted(r.text for r in same) == ["", passage]
    assert spans.dedup_spans(rows_of(spark, [])).count() == 0


def test_passages_of_short_lines_and_inside_long_sentences(spark):
    rng = random.Random(4)

    def some(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10 ** 6)}" for _ in range(n)]

    lines = "".join(" ".join(some(7)) + "\n" for _ in range(10))
    texts = {1: "A heading\n" + lines + "The end.", 2: "Other words first.\n" + lines + "And a tail."}
    for k in range(10, 50, 2):  # 51 words from within one long sentence to within another one
        part = some(51)
        texts[k] = " ".join([*some(9), *part, *some(30)]) + "."
        texts[k + 1] = " ".join([*some(40), *part, *some(3)]) + "."
    texts |= {90: None, 91: "", 92: " \n ", 93: "\n" + lines, 94: "one two " * 40, 95: "x" * 50_000}
    frame = rows_of(spark, [(i, t, None) for i, t in texts.items()])
    rows = spans.dedup_spans(frame).collect()
    got = {r.doc_id: r.text for r in rows}
    assert got == dedup_spans(texts, spans.RUN, spans.MIN_WORDS, spans.WINDOW) and len(rows) == len(texts)
    assert got[2] == "Other words first.\nAnd a tail." and got[1] == texts[1] and got[93] == ""
    for k in range(10, 50, 2):
        assert got[k] == texts[k] and len(texts[k + 1].split()) - len(got[k + 1].split()) >= 51 - 2 * spans.WINDOW + 1
    twice = spans.dedup_spans(rows_of(spark, [(1, lines, None), (1, lines, None)])).collect()
    assert sorted(r.text for r in twice) == ["", lines]
    assert spans.dedup_spans(rows_of(spark, [])).count() == 0


def check_packing(rows, texts):
    """Rows hold each text's ids whole, gapless and within 2048; returns the number of sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, min(2048, len(ids) - a), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= 2048
    return len(at), -(-sum(at.values()) // 2048)


def test_packing_round_trip(spark):
    used, least = check_packing(QUERIES["op5_packing"](spark, SF).collect(), [(r.doc_id, r.text) for r in documents(spark)])
    assert used <= least + max(2, least // 50)


def test_packing_edge_cases(spark):
    odd = [(30, "<|endoftext|> A<|ENDOFTEXT|>b", None), (31, "x.1, y.,z é k\x1cq İ", None), (32, "it's don't 5.6.7 a,b.", None)]
    rows = [*EDGE, *odd]
    check_packing(pack.pack(rows_of(spark, rows)).collect(), [(i, t) for i, t, _ in rows])
    assert pack.pack(rows_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_histogram_packing_is_whole_and_tight(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(4 + seed, 1.2)))) for _ in range(3000))
    counts[700] += 100_000 * (seed == 3)  # one hot length
    got = Counter()
    for lengths, n in (runs := pack.pack_histogram(dict(counts))):
        assert sum(lengths) <= 2048 and n > 0
        for s in lengths:
            got[s] += n
    assert got == counts
    used = sum(n for _, n in runs)
    assert used <= 1.005 * sum(n for _, n in pack.best_fit([], counts, 2048)) + 1


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    out = mix.mix(spark.read.parquet(f"{sf}/documents.parquet"), labelled_domains(spark, sf), TARGETS, carry=["doc_id"]).toPandas()
    p = out[[f"p_{d}" for d in TARGETS]].to_numpy()
    t = out.n_tokens.to_numpy()
    assert len(out) == 1000 and (out.rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    total = (out.rate.to_numpy() * t) @ p
    assert np.allclose(total / total.sum(), list(TARGETS.values()), atol=2e-3) and total[0] == pytest.approx((t @ p)[0], rel=2e-3)
    assert (out.rate.to_numpy()[p[:, 0] > 0.999] > 0.99).all()
    labels = {r.doc_id: r.domain for r in labelled_domains(spark, sf).collect()}
    known = out[out.doc_id.isin(labels)]
    assert np.mean([labels[i] == d for i, d in zip(known.doc_id, known.domain, strict=True)]) > 0.95


def test_rates_are_the_constrained_least_squares_fit(spark):
    rng = np.random.default_rng(5)
    t, p = rng.integers(1, 500, 300), rng.dirichlet([0.5, 0.5, 0.5], 300)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    for targets in ([0.5, 0.3, 0.2], [0.1, 0.1, 0.8], [0.98, 0.01, 0.01]):
        steps = mix.fit_rates(rows, targets)
        got = rows.select("n_tokens", "p", mix.rate(F.col("p"), steps).alias("r")).toPandas()
        q, r, n = np.array(got.p.tolist()), got.r.to_numpy(), got.n_tokens.to_numpy()
        start = n @ q
        goal = np.array(targets) * start[0] / targets[0]
        # plain projected gradient from the same start
        x = np.ones(len(n))
        h = (q * n[:, None]).T @ q / np.sqrt(np.outer(start, start))
        for _ in range(20_000):
            x = np.maximum(0, x - q @ (((x * n) @ q - goal) / start) / np.linalg.eigvalsh(h)[-1])
        error = lambda v: ((((v * n) @ q - goal) / start) ** 2).sum()
        assert (r >= 0).all() and error(r) <= error(x) * 1.01 + 1e-6


def test_mixing_edge_cases(spark):
    labels = spark.createDataFrame([(10, "clean"), (7, "poor"), (None, "poor"), (5, None)], "doc_id long, domain string")
    out = mix.mix(rows_of(spark, EDGE), labels, TARGETS)
    rows = out.collect()
    assert len(rows) == len(EDGE) and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert [r.n_tokens for r in rows if not (r.text or "").strip()] == [0, 0, 0]
    assert mix.mix(rows_of(spark, EDGE), labels.where("false"), TARGETS).count() == len(EDGE)
    assert mix.mix(rows_of(spark, []), labels, TARGETS).count() == 0


def test_rollup_is_additive_and_idempotent(spark):
    none = None
    img = lambda t, s="a", lang="en": (t, s, lang)
    schema = f"op string, before {rollup.IMAGE}, after {rollup.IMAGE}, extra int"
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    first = frame([("insert", none, img("one two three")), ("insert", none, img("four", None, None)), ("insert", none, img(None)),
                   ("insert", none, none), (None, img("x"), img("y")), ("move", img("x"), img("y"))])
    second = frame([("revise", img("one two three"), img("one two", "b")), ("delete", img("four", None, None), none)])
    root = scratch(spark, "rollup-test")
    assert rollup.totals(spark, root).count() == 0
    assert rollup.commit(first, root, 1) and rollup.commit(second, root, 2)
    want = {("a", "en", "word_bpe_49k", 1, 0), ("b", "en", "word_bpe_49k", 1, 2), ("a", "en", "byte_bpe_50k", 1, 0), ("b", "en", "byte_bpe_50k", 1, 2)}
    got = lambda: {tuple(r) for r in rollup.totals(spark, root).collect()}
    assert got() == want
    assert not rollup.commit(second, root, 2) and got() == want  # sent again
    # an attempt that broke before its commit leaves no trace and can be repeated
    first.limit(0).write.parquet(f"{root}/batch=3")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=3/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert got() == want
    assert rollup.commit(frame([("insert", none, img("one"))]), root, 3)
    assert ("a", "en", "word_bpe_49k", 2, 1) in got()
    assert rollup.commit(frame([]), root, 4)


def test_rollup_query_equals_direct_count(spark):
    import tiktoken  # noqa: F401
    from batchtrace.llm.tokens import byte_tokens, word_tokens

    want = Counter()
    for r in documents(spark):
        text = r.text[:len(r.text) // 2] if r.doc_id % 16 in (3, 5) else r.text
        for v, e in (("word_bpe_49k", word_tokens("word_bpe_49k.json")), ("byte_bpe_50k", byte_tokens("byte_bpe_50k.tiktoken"))):
            want[r.source, r.lang, v, "docs"] += 1
            want[r.source, r.lang, v, "tokens"] += e.count(text)
    got = Counter()
    for r in QUERIES["op3_token_rollup"](spark, SF).collect():
        got[r.source, r.lang, r.tokenizer, "docs"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.n_docs, r.n_tokens
    assert got == want


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[SEP]", "[ROLE]", "\\", "<", "[", "<\\", "s>", "INST]", "ok", " ", "\n", "é$1"]
    roles = ["user", "assistant", "system", "tool", "[SEP]x", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]), "x")
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "no id", "x"), (77, None, "assistant", "no turn", "x"), (77, 1, "assistant", "b", "x"), (77, 1, "assistant", "b", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(frame)
    got = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                     chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        want = [(b, c) for _, b, c in sorted(by[r.conv_id])]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
    merged = next(r for r in got if r.conv_id == 77)
    assert merged.formatted == "<s>no turn[SEP]b[SEP]b</s>"
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_of_many_turns_and_long_texts(spark):
    rows = [(1, t, "assistant" if t % 3 else "user", f"turn {t} [SEP] of many") for t in range(600)]
    rows += [(2, 0, "user", "[INST]" * 20_000), (2, 1, "assistant", "word </s> " * 30_000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"),
                        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        want = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")


def test_rollup_of_a_very_long_text(spark):
    from batchtrace.llm.tokens import byte_tokens, word_tokens
    text = "".join(f"word{i % 777} and, " for i in range(60_000))
    rows = spark.createDataFrame([("insert", None, (text, "a", "en"))], f"op string, before {rollup.IMAGE}, after {rollup.IMAGE}")
    got = {r.tokenizer: (r.n_docs, r.n_tokens) for r in rollup.deltas(rows).collect()}
    assert got == {"word_bpe_49k": (1, word_tokens("word_bpe_49k.json").count(text)), "byte_bpe_50k": (1, byte_tokens("byte_bpe_50k.tiktoken").count(text))}


def test_mixing_ties_go_to_the_first_domain(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    for r in mix.mix(rows_of(spark, EDGE), none, TARGETS).collect():
        assert r.domain == next(iter(TARGETS)) and [r[f"p_{d}"] for d in TARGETS] == pytest.approx([1 / len(TARGETS)] * len(TARGETS))


def test_pipeline_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_rules(docs, ["doc_id"]).where("kept").collect()}
    texts = {r.doc_id: r.text for r in documents(spark) if r.doc_id in kept}
    last = {}
    for i in sorted(texts):
        last[sha("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i]))] = i
    ids = sorted(last.values())
    fps = [fingerprint(texts[i]) for i in ids]
    near = [i for k, (i, g) in enumerate(zip(ids, groups(fps, 4), strict=True)) if g == k]
    after, x = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, SF)
        assert x.columns == docs.columns
        after.append(x)
    assert sorted(r.doc_id for r in after[0].collect()) == sorted(kept)
    assert sorted(r.doc_id for r in after[1].collect()) == ids
    assert sorted(r.doc_id for r in after[2].collect()) == near
    sources = Counter()
    copies = {r.doc_id: r.copies for r in mix.mix(after[2], labelled_domains(spark, SF), TARGETS, carry=["doc_id"]).collect()}
    for r in after[3].collect():
        sources[r.doc_id] += 1
    assert sources == Counter({i: n for i, n in copies.items() if n})
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, [(i, texts[i]) for i, n in sources.items() for _ in range(n)])


def test_pipeline_stages_take_odd_tables(spark):
    """Nulls, empty and long texts and repeated rows go through each stage as the operators judge them."""
    rng = random.Random(8)
    long_ = "".join(" ".join(rng.choice(["the", "of", "and", f"word{rng.randrange(9999)}", f"more{rng.randrange(9999)}"]) for _ in range(12)) + ". "
                    for _ in range(3000))
    rows = [*EDGE, (40, long_, "en"), (41, long_.replace("the", "THE", 5), "en"), (42, long_, None), (42, long_, None), (43, None, "en"), (None, long_[:9000], "en")]
    frame = rows_of(spark, rows)
    kept = Counter((r.doc_id, r.text) for r in quality.quality_rules(frame).where("kept").collect())
    assert kept[42, long_] == 2 and not any(not (t or "").strip() for _, t in kept)
    x = corpus_pipeline.STAGES[0][1](spark, frame, SF)
    assert Counter((r.doc_id, r.text) for r in x.collect()) == kept and x.columns == frame.columns
    x = corpus_pipeline.STAGES[1][1](spark, x, SF)
    low = {}
    for i, t in kept:
        low.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t), []).append(i)
    want = {t: max((i for i in ids if i is not None), default=None) for t, ids in low.items()}
    assert Counter(r.doc_id for r in x.collect()) == Counter(want.values())
    x = corpus_pipeline.STAGES[2][1](spark, x, SF)
    ids = sorted(want.items(), key=lambda e: (e[1] is None, e[1] or 0))
    prints = [fingerprint(t) for t, _ in ids]
    near = [i for k, ((_, i), g) in enumerate(zip(ids, groups(prints, 4), strict=True)) if g == k]
    assert Counter(r.doc_id for r in x.collect()) == Counter(near)
    mixed = corpus_pipeline.STAGES[3][1](spark, x, SF)
    assert set(r.doc_id for r in mixed.collect()) <= set(near) and mixed.columns == frame.columns
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    texts = [(r.doc_id, r.text) for r in mixed.collect()]
    check_packing(packed.collect(), texts)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, rows_of(spark, []), SF)
        assert nothing.count() == 0


def test_pipeline_runs_may_take_turns(spark, tmp_path):
    """A stage deletes what its own predecessor stored, once the written copy is read, and nothing else."""
    from batchtrace.llm.shared import forget, tables_of
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")]
    want = [[r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, p, SF), SF).collect()] for p in parts]
    first = [corpus_pipeline.STAGES[0][1](spark, p, SF) for p in parts]
    first[1].write.parquet(f"{tmp_path}/b")
    copy = spark.read.parquet(f"{tmp_path}/b")
    assert tables_of(copy) == tables_of(first[1]) != []
    second = corpus_pipeline.STAGES[1][1](spark, copy, SF)  # the other run's first stage is still unread
    first[0].write.parquet(f"{tmp_path}/a")
    other = corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{tmp_path}/a"), SF)
    assert [sorted(r.doc_id for r in x.collect()) for x in (other, second)] == [sorted(w) for w in want]
    for path in tables_of(copy):
        assert not os.path.exists(path.removeprefix("file://"))
    for x in (other, second):
        assert all(os.path.exists(p.removeprefix("file://")) for p in tables_of(x))
        forget(x)
        assert not any(os.path.exists(p.removeprefix("file://")) for p in tables_of(x))


def test_labelled_sample_counts_each_id_once(spark):
    """Repeated labels and repeated documents don't enlarge the classifier's sample."""
    from batchtrace.llm.shared import storing
    docs = rows_of(spark, [(i % 3, f"word{i % 3} of text {'a' if i % 2 else 'b'}", "en") for i in range(300)])
    labels = spark.createDataFrame([(i % 3, "good" if i % 3 else "bad") for i in range(60)] + [(0, "good")], "doc_id long, domain string")
    with storing() as paths:
        bias, kept, weights = mix.fit_classifier(docs, labels, ["good", "bad"], max_labelled=9)
    rows = spark.read.parquet(*paths).collect()
    assert sorted((r.domain, sorted(r.w)) for r in rows) == sorted(
        [("good", sorted([f"word{k}", "of", "text", "a"])) for k in (0, 1, 2)])


def test_unsettled_rates_are_told(spark):
    rows = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.2, 0.8])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="did not settle"):
        mix.fit_rates(rows, [0.5, 0.5], max_rounds=1, tolerance=1e-12)


def test_exact_stage_uses_every_row(spark):
    assert exact.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id"]).count() == len(documents(spark))
