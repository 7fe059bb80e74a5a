"""Nulls, empty and repeated rows, empty tables and clashing columns for every operator, on tiny tables."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import avi, html_extract, jpeg, langid, line_dedup, mixing, packing, quality_mil, quality_rules, simhash, toxicity
from lamina.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} the of" for k in range(30_000))
ROWS = [
    (1, "The cat sat on the mat.\nSecond line here.\nThird line there.\nFourth line.", "en", "a"),
    (2, "Other first.\nSecond line here.\nThird line there.\nFourth line.\nOwn end.", "en", "a"),
    (2, "Other first.\nSecond line here.\nThird line there.\nFourth line.\nOwn end.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "b"),
    (None, "A text without an id.", "fr", "c"),
    (6, LONG, "en", "a"),
    (7, "12345 67890 !!!", None, "c"),
    (8, "Le chat et la souris sont dans la maison avec les enfants.", "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_tokenizer())
    exact.encode_special_tokens = True
    clash = docs.withColumns({"start": F.lit("x"), "open": F.lit(1), "ids": F.lit("y")})
    rows = packing.pack(clash.repartition(3)).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    texts = defaultdict(list)
    for i, text, *_ in ROWS:
        texts[i].append(text)
    for i, same in texts.items():
        ids = exact.encode(same[0] or "", add_special_tokens=False).ids + [1]
        got = [np.frombuffer(bytes(p["ids"]), dtype="<u4") for p in sorted(by_doc[i], key=lambda p: p["start"])]
        if len(same) == 1:
            assert np.concatenate(got).tolist() == ids
        assert sum(map(len, got)) == len(ids) * len(same)
        assert {p["doc_tokens"] for p in by_doc[i]} == {len(ids)}
    assert packing.pack(none).count() == 0


def test_packer_fills_windows():
    rng, out = np.random.default_rng(1), []
    packer = packing.Packer(out.append, length=64, open_windows=4, max_waste=2)
    sizes = rng.integers(1, 150, 500)
    for doc, n in enumerate(sizes):
        for _ in packer.add(doc, np.arange(n, dtype="<u4")):
            pass
        assert len(packer.windows) <= 4
    used = [sum(len(p[2]) for p in w) for w in out]
    assert min(used) >= 62 and max(used) == 64
    last = packer.merge()
    pieces = sorted((p[0], p[1], len(p[2])) for w in [*out, *([last] if last else [])] for p in w)
    ends = {}
    for doc, start, n in pieces:
        assert ends.get(doc, 0) == start
        ends[doc] = start + n
    assert ends == dict(enumerate(sizes.tolist()))


def test_tokenizers_agree():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_tokenizer())
    exact.encode_special_tokens = True
    encode = packing.encoder(packing.default_tokenizer())
    for text in ["", " ", "a  b\n\n\tc", "<|endoftext|>", "é漢字🙂👩‍👩‍👧", "it's I'LL we've 12,345.67", "x" * 3000, "\x00​  ", "  lead and trail  "]:
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids


def test_added_tokens_become_their_ids(spark):
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer(), added=True)
    texts = ["plain text first", "end <|endoftext|> begin", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", " it's  <|ENDOFTEXT|> é漢🙂"]
    for text in ["", *texts]:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in encode(texts[1])
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        ids = plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [packing.END_ID]
        assert bytes(r["ids"]) == np.array(ids, dtype="<u4")[r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(ids)


def slow_lines(rows):
    """Brute force: cut later repeats of three-unit windows."""
    units = []
    for doc, text in rows:
        own = []
        for line in (text or "").split("\n") if text else []:
            has_word = bool(line.strip(" \t\n\x0b\x0c\r"))
            if own and not has_word:
                own[-1] += "\n" + line
            else:
                own.append(line)
        units.append((doc, own))
    first = {}
    for n, (doc, own) in sorted(enumerate(units), key=lambda e: (e[1][0] is None, e[1][0] or 0)):
        for k in range(len(own) - 2):
            first.setdefault(tuple(u.strip(" \t\n\x0b\x0c\r") for u in own[k : k + 3]), (doc, k))
    out = []
    for (doc, own), (_, text) in zip(units, rows, strict=True):
        cut = set()
        for k in range(len(own) - 2):
            owner, at = first[tuple(u.strip(" \t\n\x0b\x0c\r") for u in own[k : k + 3])]
            if owner != doc or at != k:
                cut |= {k, k + 1, k + 2}
        out.append((doc, "\n".join(u for k, u in enumerate(own) if k not in cut) if cut else text))
    return out


def test_line_dedup(spark, docs, none):
    got = line_dedup.dedup_lines(docs.withColumns({"n_removed": F.lit("x"), "extra": F.lit(1)}))
    assert got.columns == [*docs.columns, "extra", "n_units", "n_removed"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted(slow_lines([r[:2] for r in ROWS]), key=key)
    cut = {r["doc_id"]: r["text"] for r in got.collect()}
    assert cut[2] == "Other first.\nOwn end." and cut[3] is None and cut[4] == ""
    rng = np.random.default_rng(3)
    rows = [(int(k), "\n".join(rng.choice(["a", "b", "c d", "", " "], int(rng.integers(0, 14))))) for k in range(60)] + [(99, "q\n" * 4000)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(many).collect()) == sorted(slow_lines(rows))
    assert line_dedup.dedup_lines(none).count() == 0


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs.withColumns({"fp": F.lit("x"), "component_id": F.lit(9)})).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert len(got) == len(ROWS) and by[3] == by[4] == by[5] == {(0, 3)} and len(by[2]) == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 4 not in ids and 5 not in ids
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("group_rows", [2048, 3])
def test_simhash_links_are_exact(spark, group_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = lambda x: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)))
    fps = np.unique(np.array([flips(flips(b)) for b in base for _ in range(6)], dtype=np.uint64))
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3), strict=True):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(k, int(f.astype(np.int64))) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df, group_rows=group_rows).collect()}
    assert got == {int(f.astype(np.int64)): find(k) for k, f in enumerate(fps)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(1000, 1000), (2000, 2001)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[k] for k in range(301)} == {0} and got[2001] == 2000 and 1000 not in got


def test_quality_rules(spark, docs, none):
    got = {(r["doc_id"]): r for r in quality_rules.apply_rules(docs.withColumns({"kept": F.lit("x"), "n_words": F.lit("y")})).collect()}
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_words"] == 0 and got[3]["base_failed"]
    assert got[6]["n_words"] == 90_000 and got[6]["base_failed"]
    text = "a b c x a b c y"
    r = quality_rules.apply_rules(spark.createDataFrame([(1, text), (2, "a a a a a"), (3, "a b c")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x["n_repeat_words"] for x in r] == [6, 5, 0]
    clean = " ".join(f"word{k} and the" for k in range(40))
    bad = {"symbols": clean.replace("the", "the###"), "shouting": clean.replace(" ", "!! "), "stop_words": " ".join(f"word{k}" for k in range(90)), "word_length": " ".join(f"{k % 10} a {k // 10}" for k in range(90))}
    judged = quality_rules.apply_rules(spark.createDataFrame([("clean", clean), *bad.items()], "doc_id string, text string")).collect()
    assert {x["doc_id"]: x["kept"] for x in judged} == {"clean": True} | dict.fromkeys(bad, False)
    assert all(x["doc_id"] in x["failed_rules"] for x in judged if x["doc_id"] != "clean")
    assert quality_rules.apply_rules(none).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.count_copies(docs.withColumns({"size": F.lit("x"), "copies": F.lit("y")})).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in got)
    total = sum(len((r[1] or "").split()) for r in ROWS)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total) and all(t <= 3 * s + 1e-9 for t, s in targets.values())
    assert targets[None] == (0.0, 0)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.count_copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_does_not_depend_on_parts(spark):
    rows = [(k, "w " * (1 + (k * 7919) % 97), f"s{k % 4}" if k % 2 else "big") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for parts in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            seen.append(sorted(mixing.count_copies(df.repartition(7), keep=["doc_id"]).select("doc_id", "copies").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]
    taken, target = defaultdict(int), {}
    for r in mixing.count_copies(df).collect():
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.02) for s in target)
    mixed = {(r["doc_id"]): r["n"] for r in mixing.mix(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed == {k: n for k, n in seen[0] if n}


def test_mixing_rates():
    sizes, source, target = [90, 40, 30], 1000, 700.0  # three large documents, then documents of one word
    took, ends = [], []
    for u in np.linspace(0, 1, 200, endpoint=False):
        copies, prefix, rate = mixing.fold_large(sizes, source, target, float(u))
        rest = [math.floor(prefix + (k + 1) * rate + u) - math.floor(prefix + k * rate + u) for k in range(source - sum(sizes))]
        assert {*copies, *rest} <= {0, 1}
        took.append(sum(c * s for c, s in zip(copies, sizes, strict=True)) + sum(rest))
        ends.append(copies[0])
    assert max(abs(t - target) for t in took) <= 2 and np.mean(ends) == pytest.approx(0.7, abs=0.01)
    # without large documents every document is taken at exactly the plain rate
    _, prefix, rate = mixing.fold_large([], 500, 700.0, 0.3)
    assert (prefix, rate) == (0.0, 1.4)
    mean = np.mean([[math.floor((k + 1) * rate + u) - math.floor(k * rate + u) for k in range(500)] for u in np.linspace(0, 1, 500, endpoint=False)], axis=0)
    assert np.abs(mean - 1.4).max() < 0.01
    assert mixing.fold_large([], 0, 0.0, 0.5) == ([], 0.0, 0.0)


def test_language_id(spark, docs, none):
    model = langid.fit(docs.where("doc_id <> 7"))
    got = {r["doc_id"]: r for r in langid.predict(docs.withColumn("score", F.lit("x")), model).collect()}
    for k in (3, 4, 5, 7):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True)
    assert got[8]["lang_pred"] == "fr" and 0 <= got[8]["score"] <= 1 and got[1]["lang_pred"] == "en"
    assert langid.predict(none, model).count() == 0
    unfit = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(docs, unfit).collect()} == {"und"}


def invented(rng, letters, syllables, n):
    """``n`` characters of words of two or three of ``syllables`` syllables over ``letters``."""
    parts = ["".join(rng.choice(list(letters), int(rng.integers(1, 4)))) for _ in range(syllables)]
    picked = rng.choice(parts, n)
    return "".join(p + " " * (k % 5 in (1, 4)) for k, p in enumerate(picked))[:n]


def test_language_rejects_by_distance():
    import base64

    rng = np.random.default_rng(3)
    alphabets = {"en": "etaoinshrd", "de": "enisratühß"}
    all_of = {lang: invented(rng, letters, 60, 400_000) for lang, letters in alphabets.items()}
    speech = {lang: [text[k * 4000 :][: int(n)] for k, n in enumerate(rng.integers(30, 4000, 100))] for lang, text in all_of.items()}
    train = [(t, lang) for lang, texts in speech.items() for t in texts[:60]]
    model = langid.fit_arrays(np.stack([langid.ngram_counts(t) for t, _ in train]), [lang for _, lang in train], heads=[t for t, _ in train])
    for lang, texts in speech.items():
        own = model.predict([t[:n] for t in texts[60:] for n in (60, 4000)])
        assert sum(r for _, _, r in own) <= 1 and np.mean([p == lang for p, _, _ in own]) > 0.9
    word = lambda letters, n: " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 10)))) for _ in range(n))[:n]
    for n in (60, 3000, 20_000):
        noise = [word("abcdefghijklmnopqrstuvwxyz", n), base64.b64encode(rng.bytes(n)).decode()[:n], "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n))), word("абвгдежзийклмнопрстуфхцчшщъыьэюя", n)]
        assert [r for _, _, r in model.predict(noise)] == [True] * 4, n
    assert not model.predict([speech["en"][0][:300] + " " + "eta. " * 2000])[0][2]  # one word, repeated, is not another language


def test_language_vectors_do_not_depend_on_chunks(monkeypatch):
    text = "Ünïcode Wörter und ein paar Zahlen 123 " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 37)
    assert np.array_equal(whole, langid.ngram_counts(text))


def labelled(spark, rows, label):
    return spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], f"doc_id long, text string, {label} int")


def test_toxicity(spark, docs, none):
    fine = [(f"you are such a nice person number{k} and nobody likes rivers in the garden here", 0) for k in range(60)]
    foul = [(f"you are such a {w} person number{k} and nobody likes rivers here", 1) for k in range(20) for w in ("grimblot", "snarkle")]
    lexicon = toxicity.fit(labelled(spark, fine + foul + [(None, 0), ("", 0)], "toxic"))
    assert any(e.startswith("grim") for e in lexicon.weights) and any(e.startswith("snar") for e in lexicon.weights)
    probes = spark.createDataFrame([(1, "what a GR1MBLOT you are"), (2, "what a gаrden you have"), (3, "snаrklе!"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(probes.withColumn("matches", F.lit("x")), lexicon).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[2] < 0.5 and got[4] == got[5] < 0.5
    assert toxicity.score(docs, lexicon).count() == len(ROWS) and toxicity.score(none, lexicon).count() == 0
    empty = toxicity.fit(labelled(spark, fine[:3], "toxic"))
    assert not empty.weights and toxicity.score(docs, empty).count() == len(ROWS)


def test_toxicity_exceptions_cancel():
    lexicon = toxicity.Lexicon({"clown": 5.0}, {("clown", "fish")})
    assert lexicon.density(toxicity.fold("a clown fish swims"))[1] == 0
    assert lexicon.density(toxicity.fold("a clown walks"))[1] == 1
    assert lexicon.density(toxicity.fold("clown"))[1] == 1 and lexicon.density(toxicity.fold("uptownclown"))[1] == 0


def test_quality_learns_from_document_labels(spark, docs, none):
    good = [(" ".join(f"word{(k * j) % 97} flows" for j in range(150)), 1) for k in range(1, 40)]
    bad = [(" ".join(f"word{(k * j) % 97} flows" for j in range(100)) + " ### $$$ ### &&&" * 20, 0) for k in range(1, 40)]
    model = quality_mil.fit(labelled(spark, good + bad, "quality"))
    probes = spark.createDataFrame([(1, good[3][0] + " more"), (2, bad[3][0] + " ###"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_mil.score(probes.withColumn("score", F.lit("x")), model).collect()}
    assert got[1] > 0.7 > 0.3 > got[2] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality_mil.score(docs, model).where("n_passages >= 1").count() == len(ROWS)
    assert quality_mil.score(none, model).count() == 0
    assert {r["score"] for r in quality_mil.score(docs, quality_mil.fit(labelled(spark, good[:2], "quality"))).collect()} == {0.5}


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, sizes, y = rng.normal(size=(7, quality_mil.FEATURES)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    p = {"W": rng.normal(size=(quality_mil.FEATURES, 3)) * 0.1, "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": np.array(0.3)}

    def loss():
        s = quality_mil._forward(p, x, sizes)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, gradient in quality_mil._gradients(p, x, sizes, y, 0.0).items():
        at = tuple(0 for _ in np.shape(p[name]))
        value = float(p[name][at])
        p[name][at] = value + 1e-6
        up = loss()
        p[name][at] = value - 1e-6
        down = loss()
        p[name][at] = value
        assert np.asarray(gradient)[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


PAGE = """<html><body class="has-sidebar"><header><h1>Site name</h1></header><div class="cookie-notice">We use cookies</div><nav>Menu</nav>
<div id=wrap><main><article class="post"><header><h1>Title &amp; more</h1></header><div class="entry-content"><p>First para &lt;b&gt; text that is long
 enough.<p>Second <b>bold</b> para.<ul><li>one<li>two</ul><div class="ad">Buy!</div><table><tr><td>cell a<td>cell b</table></div>
<form>Email: <input></form><section class="comments"><p>A very long reader comment that must not be part of the text of the page at all.</p></section></article></main>
<aside>Related</aside></div><footer>&copy;</footer><script>if(a<b){write("<p>no</p>")}</script></body></html>"""


def test_html(spark):
    text = "Title & more\n\nFirst para <b> text that is long enough.\n\nSecond bold para.\n\none\n\ntwo\n\ncell a\n\ncell b"
    pages = [(1, "https://www.a.example/x", PAGE), (2, None, None), (3, "no url", ""), (4, "https://a.example/y", PAGE), (4, "https://a.example/y", PAGE), (5, "http://b.example", "plain &#65; text"), (6, "http://b.example", "<p>unclosed <div"), (7, "http://c.example", "<nav>only menu</nav>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "extra": F.lit(1)})
    got = html_extract.extract_pages(df).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages) and by[1]["text"] == by[4]["text"] == text and by[1]["n_chars"] == len(text) and by[1]["host"] == "a.example"
    assert by[2]["text"] == by[3]["text"] == by[7]["text"] == "" and by[2]["n_chars"] == 0 and by[5]["text"] == "plain A text" and by[6]["text"].startswith("unclosed")
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_inline_controls_and_wrapping_forms():
    assert html_extract.extract("<article><p>Read <button>Share</button><span class='ad-label'>Ad</span> this <a href=x>link</a>.</p></article>") == "Read this link."
    assert html_extract.extract("<body><form action=x><div class=content><p>All text sits in a form.</p></div></form></body>") == "All text sits in a form."


def test_host_paths_win_over_a_page_of_its_own(spark):
    usual = "<html><body><div class='c1'><p>The article text of page {k}, long enough to win.</p></div><div class='x'><p>short</p></div></body></html>"
    odd = "<html><body><div class='c2'><p>Brief.</p></div><div class='x'><p>A block that is longer than the article of this page.</p></div></body></html>"
    pages = [(k, "http://h.example/", usual.replace("{k}", str(k))) for k in range(9)] + [(9, "http://h.example/", odd)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "Brief." and got[0].startswith("The article text of page 0")


def test_clip_times(spark):
    dark, light = b"\x10" * 64 * avi.HEIGHT * 5, b"\xf0" * 64 * avi.HEIGHT * 2
    media = spark.createDataFrame([(7, bytearray(avi.write_avi(dark + light)))], "id long, media binary")
    rows = [(r["clip"], r["first_frame"], r["last_frame"], r["start_s"], r["end_s"]) for r in avi.clips(media, "id", "media").collect()]
    assert rows == [(0, 0, 4, 0.0, 0.2), (1, 5, 6, 0.2, 0.28)]
    assert media.select(avi.media_features(F.col("media"))["feature"]).first()[0].endswith("clips=0-4@0.00-0.20,5-6@0.20-0.28")


def test_media(spark, docs, none):
    stored = docs.withColumn("media", avi.media_column(F.col("text")))
    rows = stored.select("doc_id", "text", "media", avi.media_features(F.col("media")).alias("f")).collect()
    for r in rows:
        payload = avi.padded((r["text"] or "").encode())
        video = avi.read_avi(bytes(r["media"]))
        assert len(payload) % 64 == 0 and payload and avi.payload_of(video, video.decoded()) == payload
        assert r["f"]["payload_bytes"] == len(payload) and r["f"]["tail_crc32"] == zlib.crc32(payload[-64:]) and r["f"]["media_bytes"] == len(r["media"])
    assert avi.clips(stored, "doc_id", "media").count() >= len(ROWS)
    broken = spark.createDataFrame([(1, None), (2, b"no video"), (3, bytes(rows[0]["media"])[:200])], "id long, media binary")
    assert broken.select(avi.media_features(F.col("media")).alias("f")).where("f.payload_bytes IS NULL").count() == 3
    assert avi.clips(broken, "id", "media").count() == 0
    assert none.select(avi.media_features(avi.media_column(F.col("text")))).count() == 0


def test_shots_and_frames():
    dark, light = np.full((8, 8), 20, np.uint8), np.full((8, 8), 220, np.uint8)
    assert avi.shots([dark] * 5 + [light] * 4 + [dark]) == [(0, 4), (5, 8), (9, 9)]
    assert avi.shots([]) == [] and avi.shots([dark]) == [(0, 0)]
    noise = np.random.default_rng(0).integers(0, 256, (2, 16, 24), dtype=np.uint8)
    for frame, data in zip(noise, jpeg.encode_lossless(noise), strict=True):
        assert np.array_equal(jpeg.decode(data), frame)


def test_slow_lossless_decoding_agrees(monkeypatch):
    noise = np.random.default_rng(0).integers(0, 256, (1, 8, 8), dtype=np.uint8)
    data = jpeg.encode_lossless(noise)[0]
    monkeypatch.setattr(jpeg, "_COUNTS", b"")
    assert np.array_equal(jpeg.decode(data), noise[0])


def baseline(plane: np.ndarray, quant: int = 2) -> bytes:
    """A small baseline encoder for the test: 8-bit codes for all symbols in use, DC and AC."""
    symbols = list(range(12)) + [(run << 4) | size for run in range(16) for size in range(1, 11)] + [0xF0]
    symbols = list(dict.fromkeys(symbols))
    counts = [0] * 16
    counts[7] = len(symbols)
    code = {s: format(k, "08b") for k, s in enumerate(symbols)}
    bits, last = "", 0

    def value(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for y in range(0, plane.shape[0], 8):
        for x in range(0, plane.shape[1], 8):
            block = np.rint(jpeg._DCT @ (plane[y : y + 8, x : x + 8].astype(float) - 128) @ jpeg._DCT.T / quant).astype(int).ravel()
            zz = [int(block[k]) for k in jpeg._ZIGZAG]
            size, extra = value(zz[0] - last)
            bits, last, run = bits + code[size] + extra, zz[0], 0
            for v in zz[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + code[0xF0], run - 16
                size, extra = value(v)
                bits, run = bits + code[(run << 4) | size] + extra, 0
            if run:
                bits += code[0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    h, w = plane.shape
    table = bytes(counts) + bytes(symbols)
    return (
        b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [quant] * 64)) + jpeg._segment(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + jpeg._segment(0xC4, b"\x00" + table) + jpeg._segment(0xC4, b"\x10" + table) + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    )


def test_baseline_frames():
    y, x = np.mgrid[0:16, 0:24]
    plane = np.clip(128 + 60 * np.sin(x / 5) + 40 * np.cos(y / 3), 0, 255).astype(np.uint8)
    assert np.abs(jpeg.decode(baseline(plane)).astype(int) - plane).max() <= 4
