"""Clashing column names, rows without ids, deep and long inputs, and the pipeline's stages on such tables."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import html_extract, langid, line_dedup, mixing, packing, quality_mil, quality_rules, samples, simhash, toxicity

#: Names that the operators use inside.
INSIDE = ["d", "t", "h", "i", "o", "k", "n", "u", "w", "row", "units", "rest", "starts", "tie", "fp", "text_", "paths", "path", "sid", "copies_", "at", "part", "__d", "__t", "p", "q", "s"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["Uno dos tres.\nDas ist gut.\nThree lines here.\nOwn end.", "Other first.\nDas ist gut.\nThree lines here.\nOwn end.\nMore words to follow.", "A third text, of one line only."]


@pytest.fixture(scope="module")
def clashing(spark):
    df = spark.createDataFrame([(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(TEXTS * 2)], DOCS)
    return df.withColumns({name: F.lit(f"kept {name}") for name in INSIDE}).withColumn("a.b", F.lit(1))


def test_extra_columns_survive(spark, clashing):
    model = langid.fit(clashing)
    lexicon = toxicity.Lexicon({"uno": 3.0})
    fitted = quality_mil.Model({}, np.zeros(quality_mil.FEATURES), np.ones(quality_mil.FEATURES))
    results = {
        "lines": line_dedup.dedup_lines(clashing),
        "keep": simhash.keep_one(clashing),
        "rules": quality_rules.apply_rules(clashing),
        "counts": mixing.count_copies(clashing),
        "mix": mixing.mix(clashing),
        "language": langid.predict(clashing, model),
        "recognised": langid.recognised(clashing, model),
        "toxic": toxicity.score(clashing, lexicon),
        "quality": quality_mil.score(clashing, fitted),
        "pages": html_extract.extract_pages(clashing.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})),
    }
    for name, df in results.items():
        rows = df.collect()
        assert rows, name
        for r in rows:
            for c in INSIDE:
                assert r[c] == f"kept {c}", (name, c)
            assert r["a.b"] == 1
    assert packing.pack(clashing).count() >= 6 and simhash.near_duplicates(clashing).count() == 6


def test_rows_without_ids_are_documents(spark):
    df = spark.createDataFrame([(None, t, "en", "a", 0) for t in [*TEXTS, TEXTS[0]]], DOCS)
    cut = Counter(r["n_removed"] for r in line_dedup.dedup_lines(df).collect())
    assert sum(n for n in cut) == 3 and (cut[3] in (1, 2))  # of two different texts that share a window, one loses it
    assert simhash.keep_one(df).count() == 3
    counts = mixing.count_copies(df)
    assert counts.count() == 4 and mixing.mix(df).count() == counts.agg(F.sum("copies")).first()[0]
    assert packing.pack(df).where("doc_id IS NULL").count() >= 4


def test_repeated_ids_keep_one_row_whatever_the_order(spark):
    rows = [(1, TEXTS[0], "en", "a", 1), (1, TEXTS[0], "en", "b", 2), (1, TEXTS[0], "de", "a", 3), (2, TEXTS[0], "en", "a", 1), (2, TEXTS[0], "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    first = simhash.keep_one(df).collect()
    assert len(first) == 1 and first[0]["doc_id"] == 1
    assert all(simhash.keep_one(df.repartition(n)).collect() == first for n in (2, 5))


def test_samples_are_bounded_and_repeatable(spark):
    rows = [(k % 40, "x" * (1 + k % 7), k % 2) for k in range(400)] + [(None, "none", 1), (7, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")

    def take(df, n, chars):
        got = samples.sampled(df, "doc_id", "text", F.col("y"), n, chars, {"size": F.length("text")}, "test-sample")
        return [(r["id"], r["label"], r["size"]) for r in got]

    got = take(df, 25, 10**6)
    assert len(got) == 25 and got == take(df.repartition(5), 25, 10**6) and None not in {i for i, _, _ in got}
    some = take(df, 25, 40)
    assert some == got[: len(some)] and sum(n for _, _, n in some) <= 40 and take(df, 25, 0) == got[:1]
    assert take(df.limit(0), 5, 100) == []


def test_one_hot_language_is_thinned(spark):
    rows = [(k, "the cat and the dog", "en") for k in range(5000)] + [(6000 + k, "le chat et le chien", "fr") for k in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert set(model.languages) == {"en", "fr"}
    assert [model.predict([t])[0][0] for t in ("the dog", "le chien")] == ["en", "fr"]


def test_links_of_a_hot_block_and_all_choices(spark):
    assert len(simhash._masks(3, 2)) == 10 and all(bin(m & 2**64 - 1).count("1") in (25, 26) for m in simhash._masks(3, 2))
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    hot = {base ^ int(x) << 40 for x in rng.integers(0, 2**22, 900)}  # one value in the low 40 bits
    df = spark.createDataFrame([(k, f - 2**64 if f >> 63 else f) for k, f in enumerate(sorted(hot))], "doc_id long, fp long")
    for group_rows in (64, 2048):
        got = {r["fp"]: r["component_id"] for r in simhash.classes(df, group_rows=group_rows).collect()}
        fps = np.array([r["fp"] for r in df.orderBy("doc_id").collect()], dtype=np.int64).view(np.uint64)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
        label = np.arange(len(fps))
        while True:
            new = np.where(near, label[None, :], len(fps)).min(axis=1)
            if (new == label).all():
                break
            label = new
        assert got == {int(f.astype(np.int64)): int(label[k]) for k, f in enumerate(fps)}


def test_long_texts_are_encoded_in_parts():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    exact, encode = Tokenizer.from_file(path), packing.encoder(path, added=True)
    text = "It's a word  and  two\n\n spaces , 12 34 é漢字 <|endoftext|> ünd so weiter 's t " * 40
    for size in (1, 7, 100, 10**6):
        assert "".join(packing.parts(text, size)) == text
        ids = np.concatenate([np.array(encode(p)) for p in packing.parts(text, size)])
        assert ids.tolist() == exact.encode(text, add_special_tokens=False).ids
    assert list(packing.parts("x" * 50, 10)) == ["x" * 50] and list(packing.parts("", 10)) == [""]


def test_ids_only_where_asked(spark):
    docs = spark.createDataFrame([(k, "some words " * (k * 300)) for k in range(12)], "doc_id long, text string")
    full, thin = packing.pack(docs), packing.pack(docs, with_ids=False)
    assert thin.columns == full.columns[:-1] and sorted(thin.collect()) == sorted(full.drop("ids").collect())


def test_folding():
    fold, bold = toxicity.fold, "".join(chr(0x1D41A + ord(c) - 97) for c in "idiot")
    for text in (bold, "1d10t", "IDI0T", "idiоt", "ｉｄｉｏｔ", "i̇diot", "id​iot", "іdiot!!!", "ⓘⓓⓘⓞⓣ", "id!ot"):
        assert toxicity.plain(fold(f"an {text} here")) == " an idiot here", text
    assert toxicity.plain(fold("ïdiôt")) == toxicity.plain(fold("ïdiôt")) == " idiot"
    assert fold("in 2014 (42%) we") == " in we" and fold("a★b") == " a b" and fold("Straße été") == " straße été" and fold("$$$ ### !!!") == "" and fold(None) == ""
    assert fold("wow!! so!") == " wow so" and fold("ca$h") == " cash"


def test_learned_entries_are_whole_beginnings():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgorst"), int(rng.integers(2, 8))))
    text = lambda *extra: " " + " ".join([*(word() for _ in range(60)), *extra])
    toxic = [text(*rng.choice(["trash", "idiot", "zork" + word(), "zorkly"], 3)) for _ in range(120)]
    clean = [text("tras", "idioma") if k % 5 == 0 else text() for k in range(400)]
    lexicon = toxicity.fit_texts(toxic, clean)
    assert {"trash", "idiot"} <= set(lexicon.weights) and any(e in lexicon.weights for e in ("zork", "zor"))
    assert not {"tras", "idio", "tra"} & set(lexicon.weights)
    for harmless in ("El idioma cambia tras la guerra y tras la paz.", "an idiom of the region"):
        assert lexicon.score(harmless)[0] < 0.5
    for foul in ("you ïdiot", "TR4SH", "such a zorkish thing"):
        assert lexicon.score(foul)[0] > 0.5
    again = lexicon.weights
    assert toxicity.fit_texts(toxic, clean).weights == again


def test_learned_phrases():
    toxic = [f" you clown number{k}" for k in range(20)]
    clean = [f" a clown wrasse swims in tank{k}" for k in range(5)] + [f" some text of day{k}" for k in range(60)]
    lexicon = toxicity.Lexicon({"clown": 5.0})
    assert ("clown", "wrasse") in toxicity._phrases(lexicon, toxic, clean) and ("a", "clown") in toxicity._phrases(lexicon, toxic, clean)
    assert ("clown", "wrasse") not in toxicity._phrases(lexicon, [*toxic, " the clown wrasse"], clean)


def test_forms_and_wrappers():
    extract = html_extract.extract
    assert extract("<body><form><label>User name</label><input><p>Please sign in</p></form></body>") == ""
    long = "word " * 30
    assert extract(f"<body><a href=#c>Skip</a><form id=aspnet><div id=c><h1>Title</h1><p>{long}</p><label>Name</label></div></form></body>") == f"Title\n\n{long.strip()}"
    for name in ("content-with-sidebar", "left-sidebar", "page-modal"):
        assert extract(f"<body><div class='{name}'><article><p>{long}</p></article><div class='sidebar'>{long}</div></div></body>") == long.strip()
    comments = f"<section class='comments'><article><p>{long * 3}</p></article></section>"
    assert extract(f"<body><div class='post'><p>The post itself.</p></div>{comments}</body>") == "The post itself."


@pytest.mark.parametrize("pair", [("<div>", "</div>"), ("<span>", "</span>"), ("<ul><li>", "</li></ul>"), ("<blockquote>", "</blockquote>"), ("<b></i>", "")])
def test_deep_pages_take_linear_time(pair):
    spent = []
    for n in (2_000, 32_000):
        page = "<body>" + (pair[0] + "text ") * n + pair[1] * n
        began = time.process_time()
        assert html_extract.extract(page, ["body>div>div"]).count("text") >= 1
        spent.append(time.process_time() - began)
    assert spent[1] < 100 * max(spent[0], 0.02)  # sixteen times the page; 256 times the work if it were quadratic


def test_hosts_without_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.example/", f"<body><div class=c><p>Text of page {k}.</p></div></body>", "x") for k in range(9)], "page_id long, url string, html string, paths string")
    usual = sorted(html_extract.extract_pages(pages).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert sorted(html_extract.extract_pages(pages).collect()) == usual and all(r["paths"] == "x" for r in usual)


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    odd = [(None, None, None, None, None), (None, "", None, "a", 0), (1, "words and words", "en", None, 1), (1, "words and words", "en", None, 1), (2, " \n ", "fr", "a", 3), (3, "The only long line. " * 5000, "en", "a", 9)]
    extra = lambda df: df.withColumns({c: F.lit(c) for c in ("row", "d", "tie", "__d", "size", "copies", "score", "n_units")})
    for rows in (odd, []):
        df = extra(spark.createDataFrame(rows, DOCS))
        got = STAGES[name](spark, df, "")
        out = got.collect()
        if name == "packing":
            assert (len(out) > 0) == bool(rows)
            continue
        assert got.columns == df.columns
        assert all(r[c] == c for r in out for c in ("row", "d", "tie", "__d", "size", "copies", "score", "n_units"))
        kept = Counter(r["doc_id"] for r in out)
        if rows and name == "language_id":
            assert kept == {1: 2, 3: 1}
        if rows and name == "line_dedup":
            assert sum(kept.values()) == len(rows)
        if rows and name == "simhash_near_dedup":
            assert kept == {1: 1, 2: 1, 3: 1}
        if rows and name == "mixing":
            assert all(n <= 3 * sum(r[0] == i for r in rows) for i, n in kept.items())


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
