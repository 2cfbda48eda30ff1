"""The training-data operators against brute force, libraries, DuckDB and odd rows."""

from __future__ import annotations

import zlib
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import (
    cross_parsing,
    exact_topk,
    huffman,
    mixing,
    multi_index,
    order_minhash,
    piece_lattice,
    recurrent_lm,
    url_rules,
    vectors,
    wrapper_induction,
)
from sitelens.llm.common import worker_cache

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, part int"
ODD = [
    (1, None, "en", None, 0, 0.5, 1),
    (2, "", "en", "a", 0, 0.5, 1),
    (3, "12 34 !!", None, "a", 8, 0.5, 1),
    (4, "the cat sat on the mat and the dog sat on the log", "en", "b", 9, 0.5, 1),
    (4, "the cat sat on the mat and the dog sat on the log", "en", "b", 9, 0.5, 1),
    (None, "le chat est sur la table et le chien est dans la maison", "fr", "b", 9, 0.5, 1),
    (6, "le chat est sur la table et le chien est dans la maison", "fr", "c", 9, 0.5, 1),
    (7, "word " * 30_000, "en", "c", 9, 0.5, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def duck(sql: str) -> list[tuple]:
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("module", [mixing, exact_topk, url_rules])
def test_equals_duckdb(spark, module):
    got = module.query(spark, SMALL)
    want = duck(f"SELECT {', '.join(got.columns)} FROM ({module.SQL})")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_suffix_automaton_finds_longest_matches():
    text, word = "abracadabra banana ", "cadabananabrax "
    at = count = 0
    while at < len(word):
        n = max([k for k in range(len(word) - at + 1) if word[at : at + k] in text])
        at, count = at + max(1, n), count + 1
    assert cross_parsing.SuffixAutomaton(text).phrases(word) == count


def test_language_of_held_out_and_odd_rows(spark, docs, odd):
    samples = cross_parsing.training_samples(docs.where(~cross_parsing.held_out()))
    rows = cross_parsing.predict(docs, samples).where(cross_parsing.held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = cross_parsing.predict(odd, samples)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "part", "lang_pred", "score", "bits_per_letter"]
    assert [r["lang_pred"] for r in got.collect()][:3] == ["und"] * 3
    assert cross_parsing.training_samples(odd.where("false")) == {}
    assert cross_parsing.predict(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_main_text_drops_what_is_not_the_article(spark):
    page = (
        "<html><body><nav><a>Menu {0}</a></nav><div class='cookie-notice'>We {0}</div><aside>Side {0}</aside>"
        "<article><h1>T{0} &amp;  x</h1><p>Share this page</p><p>Body <b>{0}<br>on<p>Next{0}</p><form>F</form>"
        "<script>var t='</p>';</script><!-- <p>c</p> --></article><div id=comments><p>Nice {0}</p></div><footer>F</footer>"
    )
    rows = [(k, "http://a.b/", page.format(k), "extra") for k in range(6)] + [(7, None, None, ""), (8, "x", "", ""), (8, "x", "<p", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in wrapper_induction.main_texts(pages).collect()}
    assert {g for g in got if g[0] < 6} == {(k, t := f"T{k} & x\nBody {k} on\nNext{k}", len(t)) for k in range(6)}
    assert {g for g in got if g[0] > 6} == {(7, "", 0), (8, "", 0)}
    assert wrapper_induction.main_texts(pages.where("false")).count() == 0


def test_code_lengths_are_optimal_within_the_limit():
    counts = {k: 2**k for k in range(8)}
    free, tight = huffman.code_lengths(counts, 20), huffman.code_lengths(counts, 4)
    assert sum(2.0**-n for n in free.values()) == 1 and max(free.values()) == 7
    best = min(
        sum(n * counts[k] for k, n in enumerate(x)) for x in product(range(1, 5), repeat=8) if sum(2.0**-n for n in x) <= 1
    )
    assert max(tight.values()) <= 4 and sum(n * counts[k] for k, n in tight.items()) == best
    assert huffman.code_lengths({}) == {} and huffman.code_lengths({5: 9}) == {5: 1}


def test_id_files_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    lengths = huffman.write_ids(odd, f"{tmp_path}/ids")
    rows = sorted(huffman.read_ids(spark, f"{tmp_path}/ids", lengths).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(huffman.tokenizer_path())
    want = sorted(((d[0] is not None, d[0] or 0, d[1]) for d in ODD), key=lambda d: d[:2])
    at = 0
    for (known, doc_id, text), r in zip(want, rows, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, huffman.END]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id if known else None, at, len(ids))
        assert list(np.frombuffer(r["ids"], dtype="<u4")) == ids
        at += len(ids)
    assert huffman.read_ids(spark, f"{tmp_path}/none", huffman.write_ids(odd.where("false"), f"{tmp_path}/none")).count() == 0


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, j in product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        want = int(table[-1, -1])
        apart = len(a) + len(b) - 2 * want
        assert order_minhash.common_subsequence(a, b, apart) == want
        assert apart == 0 or order_minhash.common_subsequence(a, b, apart - 1) is None


def test_near_duplicates_equal_brute_force(spark, docs, odd):
    rows = docs.select("doc_id", "text").collect()
    hashes = {r["doc_id"]: order_minhash.word_hashes(r["text"]) for r in rows}
    root = {k: k for k in hashes}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(hashes)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if order_minhash.similarity(hashes[a], hashes[b]) is not None:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs).collect()}
    assert got == {k: find(k) for k in ids}
    kept = order_minhash.classes(odd).collect()
    assert len(kept) == len(ODD)
    assert sorted((r["doc_id"], r["class_id"]) for r in kept if r["doc_id"] is not None) == [(k, k) for k in (1, 2, 3, 4, 4, 6, 7)]
    assert order_minhash.classes(odd.where("false")).count() == 0


def test_mix_reaches_its_targets(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(odd.where("false")).count() == 0
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


VECTORS = [(k, [float(x) for x in np.random.default_rng(k).standard_normal(8)]) for k in range(120)]
BAD = [(200, None), (220, [None] * 8), (240, [float("nan")] * 8), (260, [0.0] * 8), (None, [1.0] * 8), (280, [1.0, 2.0])]


def brute(rows: list, k: int, score) -> dict[int, list]:
    return {
        q: [v for _, v in sorted((-score(x, y), v) for v, y in rows if v != q)][:k] for q, x in rows if q % 20 == 0
    }


def test_exact_search_equals_brute_force(spark):
    df = spark.createDataFrame(VECTORS + VECTORS[:3] + BAD, "vec_id long, embedding array<float>")
    v = exact_topk.quantised(df)
    got: dict = {}
    for r in sorted(exact_topk.search(v, v.where("vec_id % 20 = 0"), 7).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    ints = [(k, np.floor(64 * np.array(x, dtype=np.float32).astype(float))) for k, x in [*VECTORS, (260, [0.0] * 8)]]
    assert got == brute(ints, 7, lambda x, y: float(x @ y))
    assert exact_topk.search(v.where("false"), v.where("false")).count() == 0


def test_multi_index_recall(spark):
    df = spark.createDataFrame(VECTORS + BAD, "vec_id long, embedding array<float>")
    v = vectors.usable(df, zero=False)
    rows = multi_index.Index(v).search(v.where("vec_id % 20 = 0"), 5, share=0.8).collect()
    want = brute([(k, np.array(x, dtype=np.float32).astype(float)) for k, x in VECTORS], 5, lambda x, y: float(x @ y))
    assert np.mean([r["vec_id"] in want[r["query_id"]] for r in rows if r["query_id"] in want]) >= 0.9
    assert multi_index.Index(v.where("false")).search(v.where("false")).count() == 0


def test_url_rules_on_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?q#f"), (4, "a://net"), (5, "a://xnet/"), (6, "a://b.org/fr/"), (7, "a://net/://org/fr/")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, url_rules.RULES).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("net", "", None, "allow") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("org/fr/", "allow") and got[7] == ("net", "/://org/fr/", "net/", "block")
    assert url_rules.judge(df.where("false"), url_rules.RULES).count() == 0
    assert url_rules.judge(df, []).where("verdict <> 'allow'").count() == 0


def test_model_is_a_distribution_and_slopes_are_right():
    counts = [(b"", 9), *((b"w%d" % k, 40 - k) for k in range(20))]
    vocabulary = recurrent_lm.Vocabulary(counts, 900)
    model = recurrent_lm.Model(vocabulary)
    state = np.random.default_rng(1).standard_normal((1, recurrent_lm.STATE)).astype(np.float32)
    every = np.arange(vocabulary.size)
    logp, _ = model.output(np.repeat(state, len(every), axis=0), every)
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)
    grad = model.like()
    _, back = model.output(state, np.array([3]), grad)
    for k in range(3):
        step = np.zeros_like(state)
        step[0, k] = 1e-2
        slope = (model.output(state + step, np.array([3]))[0] - model.output(state - step, np.array([3]))[0])[0] / 2e-2
        assert slope == pytest.approx(back[0, k], abs=2e-3)


def test_scores_carry_state_over_whole_texts(spark, odd):
    rows = recurrent_lm.score(odd, F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(r["n_known"] == r["n_tokens"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 7} == {30_001}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    none = recurrent_lm.score(odd, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert recurrent_lm.score(odd.where("false"), F.lit(True)).count() == 0


def test_pieces_equal_the_library(spark, odd):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_lattice.model_path())
    more = [(20, " a  b\n\tc é漢字 🎉 "), (21, "x" * 90), (22, "abc" * 70)]
    texts = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted((repr(r["doc_id"]), library.encode(r["text"] or ""), r["text"] or "") for r in texts.collect())
    got = piece_lattice.decode(piece_lattice.encode(texts)).collect()
    assert sorted((repr(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in got) == want
    assert piece_lattice.encode(texts.where("false")).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SMALL).cache()
        assert now.columns == docs.columns, name
        assert now.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name == "language":
            assert now.count() == docs.count()
        if name == "near_duplicates":
            classes = order_minhash.classes(before).select("class_id").distinct().count()
            assert now.count() == classes
        if name == "mix":
            taken = mixing.mix(before).agg(F.sum("taken")).first()[0]
            assert now.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] == pytest.approx(taken, rel=0.001)
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert last.count() == now.count()


def test_checksums_are_unsigned_and_little_endian(spark):
    row = spark.range(1).select(F.crc32(F.unhex(F.lit("0200000001000000"))).alias("x")).first()
    assert row["x"] == zlib.crc32(np.array([2, 1], dtype="<u4").tobytes())


def test_word_hashes_depend_on_the_word_alone():
    hashes = order_minhash.word_hashes
    a, b = hashes("ab  cd\tab é\n"), hashes("x" * 5000 + " ab é")
    assert a[0] == a[2] == b[1] and a[3] == b[2] and len({*a.tolist()}) == 3
    assert len(hashes(None)) == len(hashes(" \n")) == 0
    words = sorted({f"{x:x}" for x in range(50_000)})
    assert len({*hashes(" ".join(words)).tolist()}) == len(words)


def test_scattered_edits_are_near_by_shingles_only(spark):
    words = [f"w{k}" for k in range(500)]
    seldom = [f"x{k}" if k % 100 == 50 else w for k, w in enumerate(words)]
    often = [f"x{k}" if k % 25 == 12 else w for k, w in enumerate(words)]
    more = [f"y{k}" if k % 9 == 4 else w for k, w in enumerate(words)]
    rows = [(k, " ".join(x)) for k, x in enumerate([words, seldom, often, more])]
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 3}
    a, b, c, _ = (order_minhash.word_hashes(text) for _, text in rows)
    assert order_minhash.similarity(a, b) == pytest.approx(471 / 521)
    assert order_minhash.similarity(a, c) is None
    # A passage moved past the rest is shared but can't be aligned.
    assert order_minhash.similarity(a, order_minhash.word_hashes(" ".join(words[250:] + words[:250]))) is None


def test_short_texts_fit_the_model_and_partitions_do_not_matter(spark):
    rows = [(k, "the cat sat on the mat " * (k % 4 + 1)) for k in range(40)]
    docs = spark.createDataFrame(rows, "key long, text string")
    n_all = sum(len(recurrent_lm.words(text)) for _, text in rows)
    vocabulary = recurrent_lm.Vocabulary(recurrent_lm.frequent(recurrent_lm.word_counts(docs)), n_all)
    one, many = (recurrent_lm.fit(docs.repartition(n), vocabulary, n_all) for n in (1, 20))
    assert not np.array_equal(one, recurrent_lm.Model(vocabulary).flat)
    assert np.array_equal(one, many)


def test_language_stage_rejects_by_its_measure(spark, docs):
    rng = np.random.default_rng(5)
    gibberish = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(80))
    foreign = "съешь же ещё этих мягких французских булок да выпей чаю " * 5
    odd = spark.createDataFrame([(10_000_001, gibberish), (10_000_002, foreign), (10_000_003, "12 34")], "doc_id long, text string")
    every = docs.unionByName(odd, allowMissingColumns=True)
    assert cross_parsing.stage(spark, every, SMALL).where("doc_id > 10000000").count() == 0
    unlabelled = every.withColumn("lang", F.lit(None).cast("string"))
    kept = cross_parsing.stage(spark, unlabelled, SMALL).where("doc_id > 10000000").collect()
    assert {r["doc_id"] for r in kept} == {10_000_001, 10_000_002}


def test_copies_do_not_use_up_the_pages_of_a_wrapper(spark):
    page = "<body><p>Our menu</p><p>Story {0}</p><p>All rights</p></body>"
    texts = [page.format(k) for k in range(5) for _ in range(30)]
    pages = spark.createDataFrame([(k, "http://a.b/", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r["text"] for r in wrapper_induction.main_texts(pages).collect()}
    assert got == {f"Story {k}" for k in range(5)}


def test_the_wrapper_finds_articles_without_their_tags(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    articles = {r["page_id"]: r["html"].split("<article>")[1].split("</article>")[0] for r in pages.collect()}
    plain = F.replace(F.regexp_replace("html", r"<(/?)(?:article|nav|footer)\b", "<$1div"), F.lit('class="ad"'), F.lit('class="x1"'))
    named, unnamed = ({r["page_id"]: r["text"] for r in wrapper_induction.main_texts(x).collect()} for x in (pages, pages.withColumn("html", plain)))
    alone = {k: wrapper_induction.extract(f"<article>{x}</article>", None) for k, x in articles.items()}
    assert named == alone
    assert sum(unnamed[k] == alone[k] for k in alone) >= 0.95 * len(alone)


def test_pages_that_are_deep_wide_or_left_open(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    wide = "".join(f"<div>a{k}</div><section>b{k}</section>" for k in range(300))
    texts = {1: deep, 2: '<p>x</p><a "' + '<a "' * 100_000, 3: "<p>x</p>" + "<a href='" * 100_000, 4: wide, 5: "1 < 2 <3", 6: "<p>a" * 3000}
    pages = spark.createDataFrame([(k, "http://a.b/", t) for k, t in texts.items()] * 2, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in wrapper_induction.main_texts(pages).collect())
    assert got[::2] == got[1::2]
    got = dict(got)
    assert got[1] == "deep" and got[2] == got[3] == "x" and got[5] == "1 < 2 <3"
    assert got[4].count("\n") == 599 and got[6] == "\n".join("a" * 3000)


def test_many_copies_of_one_page_do_not_make_its_article_template(spark):
    page = "<body><div><h1>T{0}</h1><p>Story of the {0} and what came of it</p></div><div>Sign up</div></body>"
    texts = [page.format(k) for k in (0, 1, 2, 3, *[4] * 200)]
    pages = spark.createDataFrame([(k, "http://a.b/", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r["text"] for r in wrapper_induction.main_texts(pages).collect()}
    assert got == {f"T{k}\nStory of the {k} and what came of it" for k in range(5)}


def test_near_duplicates_keep_each_text_of_an_id(spark):
    one, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "vw")
    rows = [(1, one), (1, other), (1, one.replace(" ", "  ")), (2, one), (None, one)]
    kept = order_minhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, " ".join(r["text"].split())) for r in kept) == [(0, one), (1, one), (1, other)]


def test_a_wrapper_is_made_of_all_pages_of_a_host(spark):
    page = "<body><section class='x{1}'><p>Story {0} of a kind</p></section><div id='post-{0}'>{0}</div></body>"
    rows = [(k, "http://a.b/", page.format(k, k % 30)) for k in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    read = pages.select(F.lit("a.b").alias("group"), F.xxhash64("html").alias("hash"), "html")
    held = [r["wrapper"] for r in wrapper_induction.wrappers(read).collect()]
    assert len(held) == 1
    slots = wrapper_induction.loads(held[0])
    pages_of = {s.label: s.sums.pages for s in slots if s.label.startswith("section")}
    assert slots[0].seen == 900 and pages_of == {f"section x{k}": 30 for k in range(30)}
    # Labels of one page each are not held, so the wrapper doesn't grow with the pages.
    assert not any("post" in s.label for s in slots)


def test_template_texts_are_counted_on_all_pages(spark):
    story = "<body><div><p>Story {0} and what came of it</p>{1}</div></body>"
    made = [(k, story.format(k, "<p>Printed on our own press</p>" if k % 2 else "")) for k in range(400)]
    hashed = spark.createDataFrame(made, "page_id long, html string").withColumn("hash", F.xxhash64("html")).orderBy("hash").collect()
    # The first pages by hash lack the notice, nearly all have it.
    rows = [r for r in hashed if r["page_id"] % 2 == 0][:2] + [r for r in hashed if r["page_id"] % 2][-40:]
    pages = spark.createDataFrame([(r["page_id"], "http://a.b/", r["html"]) for r in rows], "page_id long, url string, html string")
    got = {(r["page_id"], r["text"]) for r in wrapper_induction.main_texts(pages).collect()}
    assert got == {(r["page_id"], f"Story {r['page_id']} and what came of it") for r in rows}


def test_blocks_hold_only_what_is_to_be_compared(spark):
    rows = [(7, 1, 1, 10), (7, 2, 1, 10), (7, 3, 3, 10), (8, 4, 4, 10), (8, 5, 5, 10), (8, 6, 6, 10), (9, 7, 7, 10), (9, 8, 7, 10)]
    dealt = order_minhash.blocks(spark.createDataFrame(rows, "sketch long, rep long, component long, chars long")).collect()
    found = {}
    for r in dealt:
        found.setdefault((r["sketch"], r["i"], r["j"]), set()).add((r["chunk"], r["rep"]))
    pairs = set()
    for (sketch, i, j), own in found.items():
        here = {(sketch, *sorted((a, b))) for c, a in own for d, b in own if a != b and sorted((c, d)) == [i, j]}
        assert here, "a block without a pair"
        assert not here & pairs
        pairs |= here
    component = {r[1]: r[2] for r in rows}
    apart = {(s, a, b) for s, a, _, _ in rows for t, b, _, _ in rows if s == t and a < b and component[a] != component[b]}
    assert apart <= pairs and not any(component[a] == component[b] for _, a, b in pairs)


def test_ids_that_also_have_a_text_without_words(spark):
    words = [f"w{k}" for k in range(400)]
    other = [w if k % 25 else f"x{k}" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (1, ""), (2, " ".join(other)), (2, " ")]
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(1, 1, 0)] * 2 + [(2, 2, 0)] * 2


def test_a_worker_keeps_what_one_operator_needs():
    worker_cache("one")["big"] = [0]
    assert worker_cache("one") == {"big": [0]}
    assert worker_cache("two") == {}
    worker_cache("two")["own"] = 1
    assert worker_cache("two") == {"own": 1} and worker_cache("one") == {}


def test_ids_of_chunks_cut_and_coded_together():
    """Words go to the tokenizer's model, documents are coded side by side; both as one by one."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    signs = " ".join(f"{chr(a)}{b}" for a in range(33, 400) for b in "a.'\u0301\u00e9")
    texts = [signs, None, "", " ", "STRASSE straße ÀÖØßöøÿ.,;:!?|)###", "İ Σς X's don't'", "<|endoftext|>a 漢字\r\x0b…", "word###\nword### Word"]
    library = Tokenizer.from_file(huffman.tokenizer_path())
    own = huffman.Encoder(huffman.tokenizer_path())
    assert own.plain
    kind = own.kind
    column = own.ids(pa.array(["left out", *texts]).slice(1))
    want = [[*library.encode(x or "", add_special_tokens=False).ids, huffman.END] for x in texts]
    assert [np.frombuffer(x, kind).tolist() for x in column.to_pylist()] == want
    flat, n = huffman.flat_ids(column, kind)
    assert flat.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    seen, many = np.unique(flat, return_counts=True)
    code = huffman.Code(huffman.code_lengths(dict(zip(seen.tolist(), many.tolist(), strict=True))))
    bits, starts, begins = code.encode(flat, n)
    first = np.cumsum(n) - n
    assert not begins[first].any()
    assert np.array_equal(code.decode(bits, 32 * starts[:-1], n), flat)
    for k, ids in enumerate(want):
        alone, _, _ = code.encode(np.array(ids, dtype=kind), np.array([len(ids)]))
        assert alone.tobytes() == bits[starts[k] : starts[k + 1]].tobytes()


def test_words_of_a_sample_have_no_states_across_them():
    """An automaton of the words alone parses as one of the whole sample, in far fewer states."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 9))) for _ in range(3000)]
    sample = " " + " ".join(words) + " "
    whole, own = cross_parsing.SuffixAutomaton(sample), cross_parsing.Parser({"x": sample}).automata[0]
    assert 2 * len(own.step) < len(whole.step)
    for _ in range(500):
        word = "".join(rng.choice(list("abcdéz"), rng.integers(0, 14))) + " "
        assert own.phrases(word) == whole.phrases(word)


def test_texts_of_ids_at_once_and_workers_without_pandas(spark):
    """Lists of ids are decoded together as one by one; what the workers import loads no pandas."""
    import subprocess
    import sys

    import pyarrow as pa

    own = piece_lattice.Pieces(piece_lattice.model_path())
    rng = np.random.default_rng(3)
    plain = np.flatnonzero(~own.is_byte)
    some = sorted(own.bytes_of)
    lists = [None, [], *(rng.choice(plain, n).tolist() for n in (1, 9, 40)), [*some[60:70], 500, *some[200:204]], [0, 1, 2, 700], None, [some[65]]]
    column = pa.array([[3, 4], *lists], pa.list_(pa.int32())).slice(1)
    want = [None if x is None else own.decode(np.array(x, dtype=np.int64)) for x in lists]
    assert own.decoded(column).to_pylist() == want
    rows = spark.createDataFrame([(k, x, "kept") for k, x in enumerate(lists)], "k long, ids array<int>, other string")
    assert [r["decoded"] for r in sorted(piece_lattice.decode(rows).collect(), key=lambda r: r["k"])] == want
    loads = "import sys, sitelens.llm.piece_lattice; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", loads], env={"PYTHONPATH": ":".join(sys.path)}).returncode == 0
