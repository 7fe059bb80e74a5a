"""The registered queries and the pipeline over the driver's smallest tables, against SQL or brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lamina.llm import langid, packing, quality_mil, queries, toxicity
from tests.llm.test_small import slow_lines
from tests.oracle import SMALL, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(connect(SMALL), queries.oracle_sql()[name], queries.queries()[name](spark, SMALL))


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """doc_id -> (fingerprint, smallest doc_id reachable)."""
    prints = {i: slow_fingerprint(t) for i, t in rows}
    left, out = set(prints), {}
    while left:
        seed = min(left)
        group, front = {seed}, [seed]
        while front:
            at = front.pop()
            near = {j for j in left - group if (prints[at] ^ prints[j]).bit_count() <= 3}
            group |= near
            front += near
        out |= {j: (prints[j], seed) for j in group}
        left -= group
    return out


def test_simhash(spark, docs):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op3_simhash(spark, SMALL).collect()}
    assert got == slow_components([(d["doc_id"], d["text"]) for d in docs])


_PLAIN = []


def tokens(text):
    """Ids by ``tokenizers`` alone."""
    if not _PLAIN:
        _PLAIN.append(Tokenizer.from_file(packing.default_tokenizer()))
    return np.array(_PLAIN[0].encode(text or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4")


def check_pieces(rows, copies):
    """Gapless windows of at most 2048, and each document's tokens in pieces, as often as it has copies."""
    windows, by_doc = defaultdict(list), defaultdict(Counter)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for r in rows:
        ids = tokens(copies[r["doc_id"]][0])
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert by_doc == {i: Counter(dict.fromkeys(range(len(tokens(t))), n)) for i, (t, n) in copies.items() if n}
    assert sum(r["length"] for r in rows) > 0.97 * 2048 * (len(windows) - 2)


def test_packing(spark, docs):
    check_pieces(queries.op1_packing(spark, SMALL).collect(), {d["doc_id"]: (d["text"], 1) for d in docs})


def test_media(spark, docs):
    got = {r["doc_id"]: r for r in queries.op10_avi_media(spark, SMALL).collect()}
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]


def test_pages(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op6_html_extraction(spark, SMALL).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_models_on_held_out_documents(spark, docs):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/labels.parquet").collect()}
    folder = SMALL.replace("0.001", "0.1")
    language = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}

    def rate(rows, truth):
        rows = [(r, truth(r)) for r in rows if r["held_out"] and truth(r) is not None]
        return rows, np.mean([y == p for (_, y), p in zip(rows, [r.asDict().get("lang_pred", r.asDict().get("predicted")) for r, _ in rows], strict=True)])

    assert rate(queries.op9_language_id(spark, folder).collect(), lambda r: language[r["doc_id"]])[1] > 0.99
    assert rate(queries.op5_quality_mil(spark, folder).collect(), lambda r: labels[r["doc_id"]]["quality"] if r["doc_id"] in labels else None)[1] > 0.98
    rows, accuracy = rate(queries.op4_toxicity(spark, folder).collect(), lambda r: labels[r["doc_id"]]["toxic"] if r["doc_id"] in labels else None)
    toxic = [r["predicted"] for r, y in rows if y == 1]
    assert accuracy > 0.98 and np.mean(toxic) > 0.88


def slow_mixing(rows):
    """Copies of each row (doc_id, text, source) by the documented rules."""
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[k] for k, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    target, free, total = {}, set(sources), sum(own.values())
    while True:
        level = (total - sum(target.values())) / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if weight[s] * level >= 3 * own[s]}
        if not over:
            break
        target |= {s: 3.0 * own[s] for s in over}
        free -= over
    left = total - sum(int(target[s]) for s in sources if s not in free)
    target |= {s: float(weight[s] * left) / float(sum(weight[s] for s in free)) for s in free}
    copies = {}
    for s in sources:
        u = int(hashlib.md5(f"mix-1:{s or ''}".encode()).hexdigest()[:8], 16) / 4294967296.0
        mine = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (-size[k], rows[k][0]))
        large = [k for k in mine if size[k] * 20 > own[s]]
        prefix, taken, seen = 0.0, 0, 0

        def rate():
            return min(max((target[s] - taken) / (own[s] - seen), 0.0), 3.0) if own[s] > seen else min(target[s] / own[s], 3.0) if own[s] else 0.0  # noqa: B023

        for k in large:
            after = prefix + rate()
            copies[k] = math.floor(after + u) - math.floor(prefix + u)
            prefix, taken, seen = after, taken + copies[k] * size[k], seen + size[k]
        rest = rate()
        copies |= {k: math.floor(prefix + (n + 1) * rest + u) - math.floor(prefix + n * rest + u) for n, k in enumerate(mine[len(large) :])}
    return copies


def test_mixing(spark, docs):
    rows = [(d["doc_id"], d["text"], d["source"]) for d in docs]
    copies = slow_mixing(rows)
    got = {r["doc_id"]: r["taken"] for r in queries.op8_mixing(spark, SMALL).collect()}
    assert got == {r[0]: copies[k] * len(WORD.findall(r[1] or "")) for k, r in enumerate(rows)}


def test_language_against_plain_cosines(spark, docs):
    """Every prediction of the query from n-gram counts taken one by one and a loop over the centroids."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(table.where(langid.remainder("doc_id", 4) != 2))
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SMALL).collect()}

    def place(gram, salt):
        code = 0
        for k, c in enumerate(reversed(gram)):
            code ^= ord(c) * (2654435761, 2246822519, 3266489917)[k] & 0xFFFFFFFF
        return ((code ^ salt) * 0x27D4EB2F & 0xFFFFFFFF) >> 15 & langid.DIMS - 1

    for d in docs[:60]:
        letters = "  " + "".join(c.lower() if c.isalpha() else " " for c in d["text"])
        letters = letters[:2] + "".join(b for a, b in zip(letters[1:], letters[2:], strict=False) if (a, b) != (" ", " "))
        counts = Counter()
        for n, salt in ((1, 0), (2, 0x9E3779B9), (3, 0x85EBCA6B)):
            counts.update(place(letters[k - n + 1 : k + 1], salt) for k in range(2, len(letters)))
        if not letters.strip():
            assert got[d["doc_id"]]["lang_pred"] == "und"
            continue
        weight = {p: math.log1p(n) * float(model.idf[p]) for p, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        cosines = [sum(w * float(c[p]) for p, w in weight.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[d["doc_id"]]["lang_pred"] == model.languages[best]
        assert got[d["doc_id"]]["score"] == pytest.approx(cosines[best], abs=0.02)


def test_toxicity_against_a_naive_scan(spark, docs):
    """Every score of the query from its lexicon, word by word and entry by entry."""
    lexicon = toxicity.fit(queries._labelled(spark, SMALL, "toxic", 5, 0))
    assert lexicon.weights
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SMALL).collect()}
    for d in docs:
        words = toxicity.fold(d["text"]).split()
        plain = [toxicity.plain(w) for w in words]
        total = count = 0
        for k in range(len(words)):
            best = 0.0
            for form in (words, plain):
                before, after = form[k - 1] if k else "", form[k + 1] if k + 1 < len(words) else ""
                for entry, weight in lexicon.weights.items():
                    usable = form is words or entry.isascii()
                    if usable and form[k].startswith(entry) and (before, form[k]) not in lexicon.exceptions and (form[k], after) not in lexicon.exceptions:
                        best = max(best, weight)
            total, count = total + best, count + (best > 0)
        x = math.log1p(100 * total / (len(words) + 20))
        r = got[d["doc_id"]]
        assert r["matches"] == count and r["score"] == pytest.approx(1 / (1 + math.exp(-(lexicon.slope * x + lexicon.bias))))


def test_quality_against_looped_attention(spark, docs):
    """Every score of the query, document by document and passage by passage."""
    model = quality_mil.fit(queries._labelled(spark, SMALL, "quality", 4, 2))
    p = {k: v.astype(float) for k, v in model.weights.items()}
    got = {r["doc_id"]: r for r in queries.op5_quality_mil(spark, SMALL).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for d in docs:
        parts = (d["text"] or "").split()
        assert got[d["doc_id"]]["n_passages"] == max(1, -(-len(parts) // 100))
        hidden, weights = [], []
        for row in quality_mil.passages(d["text"]):
            h = np.tanh(np.clip((row - model.mean) / model.scale, -5, 5) @ p["W"] + p["b"])
            hidden.append(h)
            weights.append(math.exp(float((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"])))
        pooled = sum(w * h for w, h in zip(weights, hidden, strict=True)) / sum(weights)
        assert got[d["doc_id"]]["score"] == pytest.approx(float(sigmoid(pooled @ p["c"] + p["d"])), abs=1e-4)


def test_pipeline(spark, docs):
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet").where(langid.remainder("doc_id", 4) != 2))
    rows = [(d["doc_id"], d["text"], d["source"]) for d in docs if not model.predict([d["text"]])[0][2]]
    cut = slow_lines([r[:2] for r in rows])
    rows = [(i, t, r[2]) for (i, t), r in zip(cut, rows, strict=True)]
    component = slow_components([r[:2] for r in rows])
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    copies = slow_mixing(rows)
    check_pieces(corpus_pipeline.run(spark, SMALL).collect(), {r[0]: (r[1], copies[k]) for k, r in enumerate(rows)})
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
